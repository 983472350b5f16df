"""The report from partial results of each batch, without reading a review again.

A batch leaves its counts by label, its figures, and a sketch of its ratings, a
folder per writer and batch as in the store. Counts and figures add up, and
sketches merge, so the report over any number of batches is made of them alone.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from reviewloom.functions.text import word_count
from reviewloom.lookups import LONG_REVIEW_WORDS, TOP_LABELS
from reviewloom.operators.frequency import dimension_counts, rating_sketch, sketched_median
from reviewloom.plans.report import TOPS, WHOLE, field_counts, report_row
from reviewloom.session import staged


def batch_figures(reviews: DataFrame) -> DataFrame:
    """What adds up of some reviews, as one row."""
    rating = F.when(~F.isnan("rating"), F.col("rating"))
    dated = F.when(F.col("date") != "", F.col("date"))
    return reviews.agg(
        F.count("*").alias("total_reviews"),
        F.count_if(word_count(F.col("review_text")) >= LONG_REVIEW_WORDS).alias("reviews_20_words_plus"),
        F.count(rating).alias("rating_count"), F.sum(rating).alias("rating_sum"),
        F.count_if(rating == 5.0).alias("five_star"),
        F.min(dated).alias("first_date"), F.max(dated).alias("last_date"),
        rating_sketch(rating).alias("rating_sketch"))


def write_partials(added: DataFrame, path: str, batch: int, writer: str = "batches") -> None:
    """Keep the partial results of the reviews that a batch has added."""
    counts = dimension_counts(added, [*WHOLE.values(), *TOPS.values()])
    for name, part in (("counts", counts), ("figures", batch_figures(added))):
        part.write.mode("overwrite").parquet(f"{path}/{name}/writer={writer}/batch={batch}")


def merged_counts(spark: SparkSession, path: str) -> DataFrame:
    """dimension, label, n over all batches."""
    return spark.read.parquet(f"{path}/counts").groupBy("dimension", "label").agg(F.sum("n").alias("n"))


def merged_figures(spark: SparkSession, path: str) -> DataFrame:
    """The scalar figures of the report, the span of dates, and the sketched median."""
    parts = spark.read.parquet(f"{path}/figures")
    count = F.sum("rating_count")
    return parts.agg(
        F.sum("total_reviews").alias("total_reviews"),
        F.sum("reviews_20_words_plus").alias("reviews_20_words_plus"),
        F.round(F.sum("rating_sum") / F.nullif(count, F.lit(0)), 2).alias("rating_mean"),
        F.nullif(count, F.lit(0)).alias("rating_count"),
        F.round(100 * F.sum("five_star") / F.nullif(count, F.lit(0)), 1).alias("five_star_pct"),
        F.min("first_date").alias("first_date"), F.max("last_date").alias("last_date"),
        sketched_median(F.kll_merge_agg_double("rating_sketch"), count).alias("rating_median"))


def report_of_batches(spark: SparkSession, path: str, k: int = TOP_LABELS) -> DataFrame:
    """The summary report of all batches; equal to the one over their reviews."""
    return report_row(field_counts(staged(merged_counts(spark, path)), k), merged_figures(spark, path))
