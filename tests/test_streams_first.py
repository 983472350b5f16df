"""The first review in order, whatever arrives first."""

import json

from pyspark.sql import functions as F

from reviewloom.operators.dedup import dedup_first, with_keys
from reviewloom.streaming.first import first_in_order, read_first, settle_first, write_first
from reviewloom.streaming.ingest import read_arrivals
from tests.test_extraction import LONG

SCHEMA = "seq long, reviewer_name string, review_text string, s long"


def arrive(spark, folder, *rows):
    table = spark.createDataFrame([(n, name, LONG, s) for n, name, s in rows], SCHEMA)
    table.coalesce(1).withColumn("arrived", F.timestamp_seconds("s")).write.mode("append").parquet(
        str(folder / "in"))


def run(spark, folder, delay="1 day"):
    schema = spark.read.parquet(str(folder / "in")).schema
    query = write_first(
        first_in_order(read_arrivals(spark, str(folder / "in"), schema, 1), ["seq"], "arrived", delay),
        str(folder / "out"), str(folder / "c"))
    query.awaitTermination()
    return [json.loads(p.json) if hasattr(p, "json") else p for p in query.recentProgress]


def firsts(spark, folder):
    return sorted((r["reviewer_name"], r["seq"]) for r in read_first(
        spark, str(folder / "out"), ["seq"]).collect())


def test_the_winner_may_come_late_and_after_a_restart(spark, tmp_path):
    arrive(spark, tmp_path, (9, "Ann", 100), (7, "Bob", 101), (8, "Ann", 102))
    arrive(spark, tmp_path, (5, "ann ", 103), (11, "Bob", 104))
    run(spark, tmp_path)
    assert firsts(spark, tmp_path) == [("Bob", 7), ("ann ", 5)]
    arrive(spark, tmp_path, (3, "Bob", 105), (6, "Ann", 106), (20, "Cy", 107))
    run(spark, tmp_path)
    whole = spark.read.parquet(str(tmp_path / "in"))
    want = dedup_first(with_keys(whole), ["seq"])
    assert firsts(spark, tmp_path) == sorted((r["reviewer_name"], r["seq"]) for r in want.collect()) \
        == [("Bob", 3), ("Cy", 20), ("ann ", 5)]


def test_settling_changes_nothing(spark, tmp_path):
    arrive(spark, tmp_path, (2, "Ann", 100), (1, "Bob", 101))
    run(spark, tmp_path)
    before = firsts(spark, tmp_path)
    for _ in range(2):
        settle_first(spark, str(tmp_path / "out"), ["seq"])
        assert firsts(spark, tmp_path) == before
    assert not list((tmp_path / "out" / "changes").glob("batch=*"))
    arrive(spark, tmp_path, (1, "Ann", 102))
    run(spark, tmp_path)
    assert firsts(spark, tmp_path) == [("Ann", 1), ("Bob", 1)]
    settle_first(spark, str(tmp_path / "out"), ["seq"])
    assert firsts(spark, tmp_path) == [("Ann", 1), ("Bob", 1)]


def test_state_is_dropped_behind_the_watermark(spark, tmp_path):
    day = 86_400
    arrive(spark, tmp_path, *[(n, f"p{n}", day) for n in range(50)])
    arrive(spark, tmp_path, (99, "late", 9 * day))
    arrive(spark, tmp_path, (100, "later", 20 * day))
    progress = run(spark, tmp_path)
    held = [p["stateOperators"][0]["numRowsTotal"] for p in progress if p["stateOperators"]]
    assert max(held) >= 50 and held[-1] <= 2
