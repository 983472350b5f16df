"""Counts, frequency tables and statistics over reviews."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from reviewloom.functions.dates import strict_date
from reviewloom.functions.text import word_count
from reviewloom.lookups import LONG_REVIEW_WORDS, TOP_LABELS
from reviewloom.operators.filters import dated, rated
from reviewloom.operators.skew import WINDOW_LIMIT, ranked_within, running_sum
from reviewloom.session import staged

DIMENSIONS = [
    "region", "city", "host_name", "reviewer_country", "language", "occasion", "platform",
]


def totals(df: DataFrame, long_words: int = LONG_REVIEW_WORDS) -> DataFrame:
    """Number of reviews, and of those with at least ``long_words`` words."""
    return df.agg(
        F.count("*").alias("total_reviews"),
        F.count_if(word_count(F.col("review_text")) >= long_words)
        .alias("reviews_20_words_plus"),
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Labels of one column by falling count, then by label; nulls are left out."""
    return (
        df.where(F.col(column).isNotNull())
        .groupBy(F.col(column).alias("label")).agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "label")
    )


def top_values(df: DataFrame, column: str, k: int = TOP_LABELS) -> DataFrame:
    return value_counts(df, column).limit(k)


def dimension_counts(df: DataFrame, dimensions: Sequence[str] = tuple(DIMENSIONS)) -> DataFrame:
    """Frequency tables of many columns from one pass, as long rows.

    A null label is dropped in its own dimension only.
    """
    dims = list(dimensions)
    sets = [[F.col(d)] for d in dims]
    grouped = df.groupingSets(sets, *[F.col(d) for d in dims]).agg(
        F.count("*").alias("n"), F.grouping_id().alias("_gid"))
    # The bit of the active column is the only one that is 0.
    full = (1 << len(dims)) - 1
    active = [F.col("_gid") == (full ^ (1 << (len(dims) - 1 - i))) for i in range(len(dims))]
    return (
        grouped.select(
            _pick(active, [F.lit(d) for d in dims]).alias("dimension"),
            _pick(active, [F.col(d) for d in dims]).alias("label"), "n")
        .where(F.col("label").isNotNull())
    )


def _pick(conditions: Sequence[Column], values: Sequence[Column]) -> Column:
    chosen = F.when(conditions[0], values[0])
    for condition, value in zip(conditions[1:], values[1:]):
        chosen = chosen.when(condition, value)
    return chosen


def top_per_dimension(counts: DataFrame, k: int = TOP_LABELS) -> DataFrame:
    """The ``k`` most frequent labels of every dimension, with their place.

    Where ``k`` is more than Spark cuts down ahead of a window, places are counted
    over ranges, so that no dimension is sorted by one task.
    """
    if k > WINDOW_LIMIT:
        ranked = ranked_within(counts, ["dimension"], [F.desc("n"), F.asc("label")], "place")
        return ranked.where(F.col("place") <= k)
    place = F.row_number().over(
        Window.partitionBy("dimension").orderBy(F.desc("n"), F.asc("label")))
    return counts.withColumn("place", place).where(F.col("place") <= k)


#: Values a quantile sketch keeps of each level: its median is off by less than
#: 1.5 % of the ranks.
SKETCH_SIZE = 200
SKETCH_ERROR = 0.015


def rating_sketch(rating: Column, size: int = SKETCH_SIZE) -> Column:
    """A quantile sketch of the ratings that aren't null; sketches can be merged."""
    return F.kll_sketch_agg_double(rating, F.lit(size))


def sketched_median(sketch: Column, count: Column) -> Column:
    """The median by a sketch of ``count`` values, null for none."""
    return F.when(count > 0, F.kll_sketch_get_quantile_double(sketch, F.lit(0.5)))


def approximate_median(df: DataFrame, size: int = SKETCH_SIZE) -> DataFrame:
    """rating_median of the rated rows in one pass, by a sketch of bounded size.

    Of all values it is one whose rank is less than SKETCH_ERROR from the middle,
    at the default size. :func:`rating_stats` has the exact one.
    """
    rating = F.when(~F.isnan("rating"), F.col("rating"))
    return df.agg(sketched_median(rating_sketch(rating, size), F.count(rating)).alias("rating_median"))


def rating_stats(df: DataFrame) -> DataFrame:
    """Count, mean, exact median, and share of five and four star ratings.

    One row, or none if nothing is rated. Ratings are counted per value first;
    all figures come from that small table.
    """
    values = staged(rated(df).groupBy("rating").agg(F.count("*").alias("n")))
    count = F.sum("n")
    five = F.sum(F.when(F.col("rating") == 5.0, F.col("n")).otherwise(0))
    four = F.sum(F.when(F.col("rating") == 4.0, F.col("n")).otherwise(0))
    median = F.lit(median_by_running_sum(values)).cast("double")
    return values.agg(
        count.alias("rating_count"),
        F.round(F.sum(F.col("rating") * F.col("n")) / count, 2).alias("rating_mean"),
        median.alias("rating_median"),
        five.alias("five_star"), F.round(100 * five / count, 1).alias("five_star_pct"),
        four.alias("four_star"), F.round(100 * four / count, 1).alias("four_star_pct"),
    ).where(F.col("rating_count") > 0)


def median_by_running_sum(values: DataFrame) -> float | None:
    """Exact median of ``rating`` weighted by ``n`` for any number of values.

    The mean of the two values that hold the middle positions, which are found
    through a distributed running sum.
    """
    total = values.agg(F.sum("n")).first()[0]
    if not total:
        return None
    low, high = (total + 1) // 2, (total + 2) // 2
    upto = F.col("_upto")
    middle = (
        running_sum(values, ["rating"], "n", "_upto")
        .where((upto >= low) & (upto - F.col("n") < high))
    )
    return middle.agg((F.min("rating") + F.max("rating")) / 2).first()[0]


def date_range(df: DataFrame) -> DataFrame:
    """First and last date as strings, so ``2024`` comes ahead of ``2024-01``."""
    return dated(df).agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def strict_date_range(df: DataFrame) -> DataFrame:
    """First and last of the complete and valid dates."""
    day = strict_date(F.col("date"))
    return df.agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"))


def ingest_counts(df: DataFrame) -> DataFrame:
    """Reviews per platform, region and host."""
    return df.groupBy("platform", "region", "host_name").agg(F.count("*").alias("n"))


def ingest_rollup(df: DataFrame) -> DataFrame:
    """Reviews per platform and region, per platform, and in all."""
    return df.rollup("platform", "region").agg(
        F.count("*").alias("n"), F.grouping_id().cast("long").alias("level"))


def running_total(counts: DataFrame, order: Sequence[str]) -> DataFrame:
    """Size of the table after each source."""
    return running_sum(counts, order, "n", "total")
