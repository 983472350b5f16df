"""Files the results are written to."""

from pyspark.sql import DataFrame, functions as F

from reviewloom.operators.filters import project_columns


def write_reviews_csv(df: DataFrame, path: str) -> None:
    """The fixed columns with a header; quotes are doubled, line breaks kept."""
    (
        project_columns(df).write.mode("overwrite").option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
        .csv(path, header=True)
    )


def write_reviews_json(df: DataFrame, path: str) -> None:
    """One JSON object per line, characters as they are, missing values as null."""
    project_columns(df).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_report(report: DataFrame, path: str) -> None:
    """A report of one row, as one JSON object in one file."""
    report.coalesce(1).write.mode("overwrite").json(path)


def write_counts(counts: DataFrame, path: str) -> None:
    """Long frequency tables of any size, one JSON object per label."""
    counts.write.mode("overwrite").json(path)


def write_metrics(counts: DataFrame, path: str, batch: int, writer: str = "batches") -> None:
    """The counts of one ingest run, stamped with the time.

    A folder per writer and batch, as in the store: a batch that is run again
    replaces its counts.
    """
    counts.withColumn("logged_at", F.current_timestamp()).write.mode("overwrite").parquet(
        f"{path}/writer={writer}/batch={batch}")
