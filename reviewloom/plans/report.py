"""The summary report, in long form and as one row."""

from pyspark.sql import Column, DataFrame, functions as F

from reviewloom.functions.text import word_count
from reviewloom.lookups import LONG_REVIEW_WORDS, TOP_LABELS
from reviewloom.operators.frequency import dimension_counts, top_per_dimension
from reviewloom.session import staged
from reviewloom.sources.writers import write_counts, write_report

# Report field -> dimension.
WHOLE = {
    "by_region": "region", "by_platform": "platform", "by_country": "reviewer_country",
    "by_language": "language", "by_occasion": "occasion",
}
TOPS = {"top_hosts": "host_name", "top_cities": "city"}


def report_scalars(reviews: DataFrame) -> DataFrame:
    """Totals and rating figures; the latter are null if nothing is rated."""
    rating = F.when(~F.isnan("rating"), F.col("rating"))
    five = F.when(rating.isNotNull(), F.when(rating == 5.0, 1.0).otherwise(0.0))
    return reviews.agg(
        F.count("*").alias("total_reviews"),
        F.count_if(word_count(F.col("review_text")) >= LONG_REVIEW_WORDS)
        .alias("reviews_20_words_plus"),
        F.round(F.avg(rating), 2).alias("rating_mean"),
        F.nullif(F.count(rating), F.lit(0)).alias("rating_count"),
        F.round(100 * F.avg(five), 1).alias("five_star_pct"),
    )


def report_counts(reviews: DataFrame, k: int = TOP_LABELS) -> DataFrame:
    """All frequency tables of the report, of any size: field, label, n.

    Reads the seven label columns once; the totals read the others.
    """
    return field_counts(staged(dimension_counts(reviews, [*WHOLE.values(), *TOPS.values()])), k)


def field_counts(counts: DataFrame, k: int = TOP_LABELS) -> DataFrame:
    """The report's fields out of counts by dimension and label."""
    fields = F.create_map(
        *[F.lit(x) for field, dim in {**WHOLE, **TOPS}.items() for x in (dim, field)])
    top = F.col("dimension").isin(list(TOPS.values()))
    kept = counts.where(~top).unionByName(
        top_per_dimension(counts.where(top), k).drop("place"))
    return kept.select(fields[F.col("dimension")].alias("field"), "label", "n")


def _label_map(field: str) -> Column:
    """Label -> count of one field, by falling count, then by label."""
    entries = F.sort_array(F.collect_list(
        F.when(F.col("field") == field, F.struct((-F.col("n")).alias("order"), "label", "n"))))
    return F.map_from_entries(
        F.transform(entries, lambda e: F.struct(e["label"], e["n"]))).alias(field)


def summary_report(reviews: DataFrame) -> DataFrame:
    """The whole report as one row with a map per frequency table.

    The labels of these tables come from dictionaries and from the caller's
    listings. For columns with any number of labels there is
    :func:`report_counts`, which has the same tables in long form.
    """
    return report_row(report_counts(reviews), report_scalars(reviews))


def report_row(counts: DataFrame, scalars: DataFrame) -> DataFrame:
    """One row out of the report's counts by field and its scalar figures."""
    figures, types = scalars.first(), scalars.schema
    maps = counts.agg(*[_label_map(field) for field in {**WHOLE, **TOPS}])

    def figure(name: str) -> Column:
        return F.lit(figures[name]).cast(types[name].dataType).alias(name)

    ahead = ["total_reviews", "reviews_20_words_plus"]
    behind = ["rating_mean", "rating_count", "five_star_pct"]
    return maps.select(*map(figure, ahead), *{**WHOLE, **TOPS}, *map(figure, behind))


def export_report(reviews: DataFrame, path: str) -> None:
    """The report as a JSON file; absent figures are left out."""
    write_report(summary_report(reviews), path)


def export_counts(reviews: DataFrame, path: str) -> None:
    write_counts(report_counts(reviews), path)
