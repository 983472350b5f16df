"""Merging the folders of a store: what is read, what is left, and what a crash shows."""

import os
import shutil

from pyspark.sql import functions as F

from reviewloom.plans import ingest
from reviewloom.sources import folders, store
from reviewloom.sources.folders import Folder, compact, files_of, joined_ranges, write_note
from tests.test_extraction import LONG
from tests.test_store import names

FIELDS = "page_id long, reviewer_name string, review_text string, platform string, region string, " \
    "city string, host_name string, reviewer_location string, date_raw string, rating double, url string"


def candidates(spark, *people):
    rest = ("Viator", "Como", "Como", "h", "", "2024", 5.0, "u")
    return spark.createDataFrame(
        [(i, p, f"{p} {LONG}", *rest) for i, p in enumerate(people)], FIELDS)


def add(spark, path, batch, *people, **more):
    return store.append_reviews(candidates(spark, *people), path, batch, ["page_id"], fan=3, **more)


def kept(spark, path):
    return sorted((f.level, f.batches) for f in folders.folders(spark, path))


def test_ranges():
    assert joined_ranges([(4, 5), (0, 2), (3, 3), (9, 9)]) == [[0, 5], [9, 9]]


def test_folders_are_merged_level_by_level(spark, tmp_path):
    path = str(tmp_path / "s")
    for n in range(11):
        added = add(spark, path, n, f"p{n}", f"p{n - 1}", "all")
        assert [r["reviewer_name"] for r in added.orderBy("id").collect()] == (
            ["p0", "p-1", "all"] if n == 0 else [f"p{n}"])
    assert kept(spark, path) == [(0, ((9, 9),)), (0, ((10, 10),)), (2, ((0, 8),))]
    want = ["p0", "p-1", "all"] + [f"p{n}" for n in range(1, 11)]
    assert names(spark, path) == [(i, p) for i, p in enumerate(want, 1)]
    assert store.stored_rows(spark, path) == 13
    assert store.next_batch(spark, path) == 11
    rows = store.read_store(spark, path)
    assert [r["batch"] for r in rows.orderBy("id").collect()] == [0, 0, 0, *range(1, 11)]
    # A merged batch that comes again adds nothing, one that is still alone is replaced.
    assert add(spark, path, 4, "new").count() == 1
    assert [r["reviewer_name"] for r in add(spark, path, 4, "new").collect()] == ["p4"]
    add(spark, path, 10, "other")
    assert names(spark, path)[-1] == (13, "other") and store.stored_rows(spark, path) == 13


def test_stored_keys_stay_where_they_are(spark, tmp_path):
    path = str(tmp_path / "s")
    for n in range(4):
        add(spark, path, n, *[f"p{n}-{i}" for i in range(5)])
    held = [f for f in folders.folders(spark, path) if f.level]
    first = store.with_keys(candidates(spark, "p1-3", "x")).select("k_name", "k_text")

    def plan(named):
        known = store._known_keys(first, path, held, named)
        assert [r["k_name"] for r in known.collect()] == ["p1-3"]
        return known._jdf.queryExecution().explainString(
            spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))

    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        whole, pruned = plan(0), plan(10)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)

    def stored_side(text):
        lines = text.splitlines()
        scan = next(i for i, line in enumerate(lines) if "Bucketed: true" in line)
        depth = lines[scan].index("FileScan")
        above = [line for line in lines[:scan] if len(line) - len(line.lstrip(" :+-")) < depth]
        return lines[scan], " ".join(line for line in lines[:scan] if "SortMergeJoin" in line or line in above)

    scan, above = stored_side(whole)
    assert "SelectedBucketsCount: 8 out of 8" in scan
    assert "SortMergeJoin" in above and "Exchange" not in above.split("SortMergeJoin [k")[-1]
    scan, _ = stored_side(pruned)
    assert int(scan.split("SelectedBucketsCount: ")[1].split()[0]) <= 2


def crashed(spark, path, upto):
    """A merge of three batches that ended at one of its steps."""
    for n in range(3):
        add(spark, path, n, f"p{n}")
    some = [f for f in folders.folders(spark, path) if f.writer == store.BATCHES]
    saved = path + "-old"
    shutil.copytree(path, saved)
    compact(spark, path, 3)
    target = next(f for f in folders.folders(spark, path) if f.level).path.removeprefix("file:")
    for f in some:  # as they were before they were removed
        name = f.path.removeprefix("file:")
        shutil.copytree(name.replace(path, saved), name)
    if upto == "rows":
        for part in ("_held", "._held.crc"):
            if os.path.exists(f"{target}/{part}"):
                os.remove(f"{target}/{part}")
    return target


def test_a_merge_that_ended_ahead_of_its_note_is_not_read(spark, tmp_path):
    path = str(tmp_path / "s")
    target = crashed(spark, path, "rows")
    want = [(1, "p0"), (2, "p1"), (3, "p2")]
    assert names(spark, path) == want
    add(spark, path, 3, "p3", "p1")
    assert names(spark, path) == [*want, (4, "p3")]
    assert os.path.exists(target) and kept(spark, path) == [(0, ((3, 3),)), (1, ((0, 2),))]


def test_a_merge_that_ended_ahead_of_the_removal_shows_rows_once(spark, tmp_path):
    path = str(tmp_path / "s")
    crashed(spark, path, "note")
    assert names(spark, path) == [(1, "p0"), (2, "p1"), (3, "p2")]
    add(spark, path, 3, "p3", "p1")
    assert names(spark, path) == [(1, "p0"), (2, "p1"), (3, "p2"), (4, "p3")]
    assert not os.path.exists(f"{path}/writer=batches/batch=1")


def test_merging_leaves_other_writers_alone(spark, tmp_path):
    path = str(tmp_path / "s")
    for n in range(3):
        add(spark, path, n, f"a{n}")
        add(spark, path, n, f"b{n}", f"a{n}", writer="stream-x")
    add(spark, path, 3, "b0", "a2", "c")
    assert [n for _, n in names(spark, path)] == ["a0", "b0", "a1", "b1", "a2", "b2", "c"]
    assert sorted((f.writer, f.level) for f in folders.folders(spark, path)) == [
        ("batches", 0), ("batches", 1), ("stream-x", 1)]


def test_a_store_of_the_earlier_layout_goes_on(spark, tmp_path):
    path = str(tmp_path / "s")
    old = add(spark, str(tmp_path / "made"), 0, "Ann", "Bob").drop("writer", "batch")
    old.write.parquet(f"{path}/batch=0")
    add(spark, path, 0, "ann", "Cy")
    assert names(spark, path) == [(1, "Ann"), (2, "Bob"), (3, "Cy")]
    assert store.stored_rows(spark, path) == 3


def test_totals_come_from_the_writes(spark, tmp_path):
    path, metrics = str(tmp_path / "s"), str(tmp_path / "m")
    for n in range(5):
        added = add(spark, path, n, f"p{n}", f"q{n}", "p0")
        ingest.log_added(added, path, metrics, n)
    rows = spark.read.parquet(metrics).orderBy("batch").collect()
    assert [(r["n"], r["total"]) for r in rows] == [(2, 2), (2, 4), (2, 6), (2, 8), (2, 10)]


def test_a_lost_note_is_made_again(spark, tmp_path):
    path = str(tmp_path / "s")
    add(spark, path, 0, "Ann", "Bob")
    os.remove(f"{path}/writer=batches/batch=0/_held")
    assert store.stored_rows(spark, path) == 2
    assert os.path.exists(f"{path}/writer=batches/batch=0/_held")


def test_notes_are_replaced(spark, tmp_path):
    folder = str(tmp_path / "f")
    for n in (1, 2):
        write_note(spark, folder, {"rows": n, "last_id": n})
    files, where = files_of(spark, folder)
    assert [s.getPath().getName() for s in files.listStatus(where)] == ["_held"]
    assert Folder(folder, "w", 0, ((3, 3),), 0, 0).holds(3)


def test_a_store_made_anew_with_other_buckets(spark, tmp_path):
    path, setting = str(tmp_path / "s"), "spark.sql.shuffle.partitions"
    before = spark.conf.get(setting)
    try:
        for buckets in ("8", "3"):
            spark.conf.set(setting, buckets)
            for n in range(4):
                add(spark, path, n, f"p{n}", "p0")
            add(spark, path, 4, "p0", "p1", "p2", "p3", "p4")
            assert [n for _, n in names(spark, path)] == ["p0", "p1", "p2", "p3", "p4"]
            shutil.rmtree(path)
    finally:
        spark.conf.set(setting, before)
