"""Tables and files the operators read. Schemas are declared, never inferred."""

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, DataFrameReader, SparkSession, functions as F, types as T
from pyspark.sql.types import StructType

from reviewloom.schema import LISTING_OPTIONS, LISTING_SCHEMA, PAGE_SCHEMA, REVIEW_SCHEMA

#: Splits of a scan that are enough on any cluster.
FEW = 64


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for a scan that yields fewer splits than there are cores.

    Text work is bound by the processor, and one small file is one split. A
    scan of FEW splits or more, as any table of some gigabytes is, stays as it
    is on any number of cores: no shuffle. ``df`` must be a plain scan.
    """
    wanted = min(2 * df.sparkSession.sparkContext.defaultParallelism, FEW)
    return df if df.rdd.getNumPartitions() >= wanted else df.repartition(wanted)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table with long texts, split finely enough for text work."""
    return spread(spark.read.parquet(path))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Captured pages: page_id, url, html."""
    return spread(spark.read.schema(PAGE_SCHEMA).parquet(path))


def read_html_files(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Saved page files, one page per file, addressed by their path."""
    files = spark.read.text(paths, wholetext=True)
    url = F.col("_metadata.file_path")
    return files.select(
        F.xxhash64(url).alias("page_id"), url.alias("url"), F.col("value").alias("html"))


def read_page_files(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Saved page files in whatever encoding: page_id, url, html, error.

    The encoding is told by a byte order mark, else by the page's own meta tag, else
    it is UTF-8. A file that can't be decoded has no html but an error, and ends
    nothing. UTF-8, as most are, stays an expression; Python sees the others.
    """
    reader, where = _listed(spark, paths)
    files = reader.format("binaryFile").load(where)
    url = F.col("path")
    plain = F.col("content").cast("string")
    named = F.lower(F.regexp_extract(
        F.decode(F.substring("content", 1, HEAD_BYTES), "ISO-8859-1"), CHARSET, 1))
    # Half a character order mark is no valid UTF-8, so these never pass as such.
    utf8 = named.isin("", "utf-8", "utf8") & F.is_valid_utf8(plain)
    read = F.when(~utf8, _decoded(F.when(~utf8, F.col("content")), named))
    return files.select(
        F.xxhash64(url).alias("page_id"), url.alias("url"),
        F.when(utf8, F.regexp_replace(plain, "^\ufeff", "")).otherwise(read["html"]).alias("html"),
        read["error"].alias("error"))


def unreadable_files(pages: DataFrame) -> DataFrame:
    """(page_id, strategy, error) of the files that couldn't be decoded."""
    return pages.where("error IS NOT NULL").select("page_id", F.lit("file").alias("strategy"), "error")


#: Where a page may name its encoding, and how (fixed values).
HEAD_BYTES = 1024
CHARSET = r"(?i)<meta[^>]*?charset\s*=\s*[\"']?\s*([a-z0-9_:.-]+)"
_MARKS = ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"))


@F.pandas_udf(T.StructType([T.StructField(c, T.StringType()) for c in ("html", "error")]))
def _decoded(contents: pd.Series, names: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([decoded(c, n) for c, n in zip(contents, names, strict=True)],
                        columns=["html", "error"])


def decoded(content: bytes | None, named: str) -> tuple[str | None, str | None]:
    """The text of a page's bytes, or what is wrong with them."""
    if content is None:
        return None, None
    for mark, encoding in _MARKS:
        if content.startswith(mark):
            content = content[len(mark):]
            break
    else:
        # A tag that could be read as it stands isn't in UTF-16 itself.
        encoding = "utf-8" if not named or named.startswith("utf-16") else named
    try:
        return content.decode(encoding), None
    except (LookupError, UnicodeError, ValueError) as error:
        return None, f"{encoding}: {type(error).__name__}"


def read_notes(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Whole text files of review notes; names and patterns without a file are skipped.

    A file is read by one task.
    """
    there = [p for p in ([paths] if isinstance(paths, str) else paths) if _exists(spark, p)]
    if not there:
        return spark.createDataFrame([], "path string, value string")
    reader, where = _listed(spark, there)
    return reader.text(where, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), "value")


def _listed(spark: SparkSession, paths: str | Sequence[str]) -> tuple[DataFrameReader, str | list[str]]:
    """A reader and its paths; the files of one folder are listed at once.

    Spark lists each file that a pattern names by a task of its own. A pattern of
    names in a folder without subfolders is a filter of that folder instead.
    """
    given = [paths] if isinstance(paths, str) else list(paths)
    folder, _, name = given[0].rpartition("/") if len(given) == 1 else ("", "", "")
    if not (set(name) & set("*?[{") and folder and not set(folder) & set("*?[]{}\\")):
        return spark.read, given
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not _exists(spark, given[0]) or files.getContentSummary(where).getDirectoryCount() != 1:
        return spark.read, given
    return spark.read.option("pathGlobFilter", name), [folder]


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return bool(files.globStatus(where))


def read_listings(spark: SparkSession, path: str) -> DataFrame:
    """The caller's seed table: host_name, city, region, platform, url.

    It may have profile, source_priority and max_pages besides; other columns
    are carried along as text.
    """
    return _csv(spark, path, LISTING_SCHEMA, LISTING_OPTIONS)


def read_reviews_csv(spark: SparkSession, path: str) -> DataFrame:
    """Reviews as one CSV row each; texts may hold quotes and line breaks.

    A file whose texts have line breaks is read by one task; write large tables
    as many files, as :func:`~reviewloom.sources.writers.write_reviews_csv` does.
    """
    return _csv(spark, path, REVIEW_SCHEMA).select(*REVIEW_SCHEMA.names)


def _csv(
    spark: SparkSession, path: str, schema: StructType, options: StructType = StructType([])
) -> DataFrame:
    """Columns by the names in the header, in the declared types.

    Files with headers that differ from each other are refused, and so is one
    without a declared column.
    """
    found = (
        spark.read.option("header", True).option("multiLine", True).option("escape", '"')
        .option("enforceSchema", False).csv(path)
    )
    missing = set(schema.names) - set(found.columns)
    if missing:
        raise ValueError(f"{path} has no column {', '.join(sorted(missing))}")
    types = {f.name: f.dataType for f in [*schema.fields, *options.fields]}
    return found.select(*[
        F.col(f"`{c}`").try_cast(types[c]).alias(c) if c in types else F.col(f"`{c}`")
        for c in found.columns])


def read_reviews_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REVIEW_SCHEMA).json(path)
