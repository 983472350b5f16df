"""Reports from partial results, sketches of quantiles, and places in large groups."""

import random

from pyspark.sql import functions as F

from checks import inputs
from reviewloom.operators import frequency, frontier
from reviewloom.operators.skew import ranked_within
from reviewloom.plans import ingest, partials, report
from reviewloom.schema import PAGE_SCHEMA
from reviewloom.sources import store
from tests.test_store import listings, page


def test_report_after_ten_batches_is_that_of_all_reviews(spark, tmp_path):
    path = str(tmp_path / "p")
    rows = inputs.reviews(spark, "/root/testdata/sf0.001")
    for batch in range(10):
        partials.write_partials(rows.where(F.col("id") % 10 == batch), path, batch)
    partials.write_partials(rows.where(F.col("id") % 10 == 3), path, 3)  # again
    assert partials.report_of_batches(spark, path).collect() == report.summary_report(rows).collect()
    figures = partials.merged_figures(spark, path).first()
    assert tuple(frequency.date_range(rows).first()) == (figures["first_date"], figures["last_date"])


def test_report_of_nothing(spark, tmp_path):
    path = str(tmp_path / "p")
    none = inputs.reviews(spark, "/root/testdata/sf0.001").limit(0)
    partials.write_partials(none, path, 0)
    assert partials.report_of_batches(spark, path).collect() == report.summary_report(none).collect()
    assert partials.merged_figures(spark, path).first()["rating_median"] is None


def test_ingest_leaves_its_part_of_the_report(spark, tmp_path):
    path, parts = str(tmp_path / "s"), str(tmp_path / "p")
    for number, names in enumerate((("Ann", "Bob"), ("ann", "Cy"))):
        ingest.ingest(spark.createDataFrame([page(number, *names)], PAGE_SCHEMA),
                      listings(spark, range(9)), path, partials_path=parts)
    assert partials.report_of_batches(spark, parts).collect() \
        == report.summary_report(store.read_store(spark, path)).collect()


def test_merged_sketches_keep_their_error(spark, tmp_path):
    rng = random.Random(3)
    values = [rng.random() ** 3 for _ in range(100_000)]
    table = spark.createDataFrame([(i % 10, v) for i, v in enumerate(values)], "part long, rating double")
    alone = frequency.approximate_median(table).first()[0]
    merged = table.groupBy("part").agg(frequency.rating_sketch(F.col("rating")).alias("k")).agg(
        frequency.sketched_median(F.kll_merge_agg_double("k"), F.lit(1))).first()[0]
    for found in (alone, merged):
        rank = sum(v < found for v in values) / len(values)
        assert abs(rank - 0.5) < frequency.SKETCH_ERROR
    assert frequency.approximate_median(table.limit(0)).first()[0] is None


def test_places_in_a_hot_group(spark):
    table = spark.range(30_000).select(
        F.when(F.col("id") % 100 == 0, F.lit(None)).otherwise(F.lit("hot")).alias("dimension"),
        F.col("id").cast("string").alias("label"), (F.col("id") % 1000).alias("n"))
    top = frequency.top_per_dimension(table, 5000).where("dimension = 'hot'").collect()
    want = sorted(((-(i % 1000), str(i)) for i in range(30_000) if i % 100))[:5000]
    assert [(r["place"], r["label"]) for r in sorted(top, key=lambda r: r["place"])] \
        == [(p, label) for p, (_, label) in enumerate(want, 1)]
    merging = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(merging, "false")
    try:
        placed = ranked_within(table, ["dimension"], [F.desc("n"), "label"])
        parts = placed.groupBy(F.spark_partition_id(), "dimension").count()
        assert parts.where("dimension = 'hot'").count() > 1
    finally:
        spark.conf.set(merging, "true")
    assert placed.where("dimension IS NULL").agg(F.max("place")).first()[0] == 300


def test_more_pages_than_a_window_is_cut_down_to(spark):
    pages = spark.range(2500).select(
        F.lit("l").alias("listing"), F.col("id").alias("page_id"),
        F.concat(F.lit("http://t/g-or"), (F.lit(2499) - F.col("id")) * 10, F.lit("-Reviews-x.html")).alias("url"))
    capped = frontier.cap_pages(pages, "listing", 2000)
    assert sorted((r["place"], r["page_id"]) for r in capped.collect()) \
        == [(i + 1, 2499 - i) for i in range(2000)]
