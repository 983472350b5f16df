"""Files, the store, and streams into it."""

import os

from pyspark.sql import functions as F

from reviewloom.functions.text import review_key
from reviewloom.plans import ingest
from reviewloom.schema import COLUMNS, PAGE_SCHEMA, REVIEW_SCHEMA
from reviewloom.sources import readers, store, writers
from reviewloom.streaming.ingest import ingest_stream, read_arrivals, stream_dedup
from tests.test_extraction import LONG, ld, review

ODD = 'say "hi", ok\nnext — ü ' + LONG


def page(number, *names):
    return (number, f"http://p/{number}", ld([review(f"{n} {LONG}", author=n) for n in names]))


def listings(spark, numbers):
    return spark.createDataFrame(
        [(f"h{n}", "c", "r", "Cesarine", f"http://p/{n}") for n in numbers],
        "host_name string, city string, region string, platform string, url string")


def test_csv_and_json_keep_quotes_breaks_and_blanks(spark, tmp_path):
    row = tuple({"id": 1, "review_text": ODD, "date": "yesterday ", "rating": 4.5}.get(c)
                for c in COLUMNS)
    df = spark.createDataFrame([row], REVIEW_SCHEMA)
    writers.write_reviews_csv(df, str(tmp_path / "csv"))
    writers.write_reviews_json(df, str(tmp_path / "json"))
    assert readers.read_reviews_csv(spark, str(tmp_path / "csv")).collect() == df.collect()
    assert readers.read_reviews_json(spark, str(tmp_path / "json")).collect() == df.collect()


def test_whole_files(spark, tmp_path):
    (tmp_path / "a.md").write_text(f"**Ann** from Rome — 2024\n{LONG}\n", encoding="utf-8")
    (tmp_path / "a.html").write_text("<p>x</p>\n<p>y</p>", encoding="utf-8")
    files = readers.read_notes(spark, f"{tmp_path}/*.md")
    assert files.first()["value"].count("\n") == 2
    assert ingest.note_candidates(files).first()["reviewer_location"] == "Rome"
    saved = readers.read_html_files(spark, f"{tmp_path}/*.html").first()
    assert saved["html"].endswith("y</p>") and saved["url"].endswith("a.html")


def test_listings_file(spark, tmp_path):
    (tmp_path / "l.csv").write_text("host_name,city,region,platform,url\nh,c,r,Viator,u\n")
    assert readers.read_listings(spark, str(tmp_path / "l.csv")).first()["platform"] == "Viator"


def test_ingest_twice_adds_nothing_and_ids_go_on(spark, tmp_path):
    target, metrics = str(tmp_path / "store"), str(tmp_path / "metrics")
    seeds = listings(spark, range(5))

    def run(*pages, **more):
        table = spark.createDataFrame(list(pages), PAGE_SCHEMA)
        return ingest.ingest(table, seeds, target, metrics_path=metrics, **more)

    assert run(page(1, "Ann", "Bob"), page(0, "ann", "Cy")).count() == 3
    assert run(page(1, "Ann", "Bob")).count() == 0
    run(page(2, "Dan", "Bob"))
    rows = store.read_store(spark, target).orderBy("id").collect()
    assert [(r["id"], r["reviewer_name"], r["host_name"]) for r in rows] \
        == [(1, "ann", "h0"), (2, "Cy", "h0"), (3, "Bob", "h1"), (4, "Dan", "h2")]
    assert spark.read.parquet(metrics).agg(F.sum("n")).first()[0] == 4


def test_result_pages_share_a_listing_up_to_its_cap(spark):
    html = page(0, "Ann")[2]
    pages = spark.createDataFrame(
        [(i, f"http://p/1{part}.html", html) for i, part in enumerate(["", "-or10", "-or20"])],
        PAGE_SCHEMA)
    seed = listings(spark, [1]).withColumn("url", F.lit("http://p/1.html"))
    assert ingest.page_candidates(pages, seed).count() == 3
    capped = ingest.page_candidates(pages, seed.withColumn("max_pages", F.lit(2)))
    assert sorted(r["url"] for r in capped.collect()) == ["http://p/1-or10.html", "http://p/1.html"]


def test_notes_come_ahead_of_pages(spark, tmp_path):
    files = spark.createDataFrame(
        [("n.md", f"**Ann** from Rome — 2024\nAnn {LONG}\n")], "path string, value string")
    pages = spark.createDataFrame([page(1, "Ann", "Bob")], PAGE_SCHEMA)
    added = ingest.ingest(pages, listings(spark, [1]), str(tmp_path / "s"), notes=files)
    assert [r["platform"] for r in added.orderBy("id").collect()] == ["Блог", "Cesarine"]


def write_slice(spark, folder, name, *pages):
    """One more arrival, later than those before it."""
    part = str(folder / name)
    spark.createDataFrame(list(pages), PAGE_SCHEMA).coalesce(1).write.parquet(part)
    (file,) = [f for f in os.listdir(part) if f.endswith(".parquet")]
    target = folder / "arrivals" / f"{name}.parquet"
    target.parent.mkdir(exist_ok=True)
    target.write_bytes((folder / name / file).read_bytes())
    age = 1_700_000_000 + int(name)
    os.utime(target, (age, age))


def stream(spark, folder):
    ingest_stream(
        spark, str(folder / "arrivals"), listings(spark, range(9)), str(folder / "store"),
        str(folder / "checkpoint"), files_per_batch=1).awaitTermination()
    rows = store.read_store(spark, str(folder / "store")).orderBy("id").collect()
    return [(r["id"], r["reviewer_name"], r["batch"]) for r in rows]


def test_stream_equals_batch_and_resumes(spark, tmp_path):
    write_slice(spark, tmp_path, "1", page(1, "Ann", "Bob"))
    write_slice(spark, tmp_path, "2", page(2, "bob", "Cy"), page(3, "Dan"))
    first = stream(spark, tmp_path)
    assert first == [(1, "Ann", 0), (2, "Bob", 0), (3, "Cy", 1), (4, "Dan", 1)]
    write_slice(spark, tmp_path, "3", page(4, "Eve", "Ann"))
    assert stream(spark, tmp_path) == [*first, (5, "Eve", 2)]
    pages = spark.createDataFrame(
        [page(1, "Ann", "Bob"), page(2, "bob", "Cy"), page(3, "Dan"), page(4, "Eve", "Ann")],
        PAGE_SCHEMA)
    batch = ingest.ingest(pages, listings(spark, range(9)), str(tmp_path / "batch"))
    assert [(r["id"], r["reviewer_name"]) for r in batch.orderBy("id").collect()] \
        == [(i, n) for i, n, _ in stream(spark, tmp_path)]


def test_a_batch_run_again_replaces_itself(spark, tmp_path):
    target = str(tmp_path / "store")
    seeds = listings(spark, range(5))
    pages = spark.createDataFrame([page(1, "Ann", "Bob")], PAGE_SCHEMA)
    for _ in range(2):
        candidates = ingest.page_candidates(pages, seeds)
        store.append_reviews(candidates, target, 0, ingest.ORDER)
    rows = store.read_store(spark, target).orderBy("id").collect()
    assert [(r["id"], r["reviewer_name"]) for r in rows] == [(1, "Ann"), (2, "Bob")]


def test_stream_dedup_keeps_one_row_per_key(spark, tmp_path):
    rows = [("Ann", LONG, 100), ("ann ", LONG, 101), ("Bob", LONG, 102)]
    source = str(tmp_path / "in")
    spark.createDataFrame(rows, "reviewer_name string, review_text string, s long") \
        .withColumn("arrived", F.timestamp_seconds("s")).write.parquet(source)
    schema = spark.read.parquet(source).schema
    out = str(tmp_path / "out")
    (
        stream_dedup(read_arrivals(spark, source, schema), "arrived", "1 day")
        .writeStream.format("parquet").option("path", out)
        .option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True)
        .start().awaitTermination()
    )
    assert sorted(r["k_name"] for r in spark.read.parquet(out).collect()) == ["ann", "bob"]


def test_stored_keys_are_the_review_keys(spark, tmp_path):
    pages = spark.createDataFrame([page(1, "Ann", "Bob")], PAGE_SCHEMA)
    added = ingest.ingest(pages, listings(spark, [1]), str(tmp_path / "s"))
    name, text = review_key(F.col("reviewer_name"), F.col("review_text"))
    assert added.where((F.col("k_name") != name) | (F.col("k_text") != text)).count() == 0


def test_appending_leaves_no_scratch_files(spark, tmp_path):
    base = spark.conf.get("spark.checkpoint.dir").removeprefix("file:")
    before = set(os.listdir(base))
    pages = spark.createDataFrame([page(1, "Ann", "Bob")], PAGE_SCHEMA)
    ingest.ingest(pages, listings(spark, [1]), str(tmp_path / "s"))
    assert set(os.listdir(base)) == before


def names(spark, target):
    rows = store.read_store(spark, target).orderBy("id").collect()
    return [(r["id"], r["reviewer_name"]) for r in rows]


def test_streams_and_batches_share_a_store(spark, tmp_path):
    target = str(tmp_path / "store")

    def batch(*pages):
        ingest.ingest(spark.createDataFrame(list(pages), PAGE_SCHEMA), listings(spark, range(9)), target)

    def arriving(name):
        ingest_stream(
            spark, str(tmp_path / "arrivals"), listings(spark, range(9)), target,
            str(tmp_path / name), files_per_batch=1).awaitTermination()

    batch(page(1, "Ann", "Bob"))
    write_slice(spark, tmp_path, "1", page(2, "bob", "Cy"))
    arriving("one")
    batch(page(3, "Dan", "Cy"))
    write_slice(spark, tmp_path, "2", page(4, "Eve", "Dan"))
    arriving("one")
    arriving("two")  # sees both files again and adds nothing
    write_slice(spark, tmp_path, "3", page(5, "Fay"))
    arriving("two")
    arriving("one")
    assert names(spark, target) == [
        (1, "Ann"), (2, "Bob"), (3, "Cy"), (4, "Dan"), (5, "Eve"), (6, "Fay")]


def test_a_replayed_stream_batch_is_stored_once(spark, tmp_path):
    target, metrics = str(tmp_path / "store"), str(tmp_path / "metrics")
    write_slice(spark, tmp_path, "1", page(1, "Ann", "Bob"))

    def run():
        ingest_stream(
            spark, str(tmp_path / "arrivals"), listings(spark, range(9)), target,
            str(tmp_path / "c"), metrics_path=metrics).awaitTermination()

    run()
    # As if the stream had been ended ahead of its commit.
    for part in ("0", ".0.crc"):
        (tmp_path / "c" / "commits" / part).unlink()
    run()
    assert names(spark, target) == [(1, "Ann"), (2, "Bob")]
    assert [(r["n"], r["total"]) for r in spark.read.parquet(metrics).collect()] == [(2, 2)]


def test_a_second_writer_is_refused(spark, tmp_path):
    target = str(tmp_path / "store")
    with store.locked(spark, target, "one"):
        try:
            with store.locked(spark, target, "two"):
                raise AssertionError("two writers at once")
        except RuntimeError as refused:
            assert "another writer" in str(refused)
        with store.locked(spark, target, "one"):
            pass
    with store.locked(spark, target, "two"):
        pass


def test_saved_reviews_keep_their_ids(spark, tmp_path):
    target = str(tmp_path / "store")
    row = {"id": 7, "reviewer_name": "Ann", "review_text": f"Ann {LONG}", "language": "IT"}
    saved = spark.createDataFrame([tuple(row.get(c) for c in COLUMNS)], REVIEW_SCHEMA)
    writers.write_reviews_csv(saved, str(tmp_path / "csv"))
    store.import_reviews(readers.read_reviews_csv(spark, str(tmp_path / "csv")), target)
    pages = spark.createDataFrame([page(1, "ann", "Bob")], PAGE_SCHEMA)
    ingest.ingest(pages, listings(spark, [1]), target)
    rows = store.read_store(spark, target).orderBy("id").collect()
    assert [(r["id"], r["reviewer_name"], r["language"]) for r in rows] == [(7, "Ann", "IT"), (8, "Bob", "EN")]


def test_metrics_of_a_batch_run_again_count_once(spark, tmp_path):
    target, metrics = str(tmp_path / "store"), str(tmp_path / "metrics")
    pages = spark.createDataFrame([page(1, "Ann", "Bob")], PAGE_SCHEMA)
    for _ in range(2):
        ingest.ingest(pages, listings(spark, [1]), target, metrics_path=metrics, batch=0)
    assert [(r["n"], r["total"]) for r in spark.read.parquet(metrics).collect()] == [(2, 2)]


def test_files_are_read_by_column_name(spark, tmp_path):
    (tmp_path / "l.csv").write_text(
        "url,platform,region,city,host_name,max_pages,note\nu,Viator,r,c,h,3,x\n")
    row = readers.read_listings(spark, str(tmp_path / "l.csv")).first()
    assert (row["host_name"], row["url"], row["max_pages"], row["note"]) == ("h", "u", 3, "x")
    (tmp_path / "bad.csv").write_text("url,platform\nu,Viator\n")
    try:
        readers.read_listings(spark, str(tmp_path / "bad.csv"))
    except ValueError as refused:
        assert "host_name" in str(refused)
    else:
        raise AssertionError("a column is missing")


def test_absent_notes_are_skipped(spark, tmp_path):
    (tmp_path / "a.md").write_text("x", encoding="utf-8")
    found = readers.read_notes(spark, [f"{tmp_path}/a.md", f"{tmp_path}/b.md", f"{tmp_path}/*.txt"])
    assert [r["value"] for r in found.collect()] == ["x"]
    assert readers.read_notes(spark, f"{tmp_path}/none.md").count() == 0


def test_a_listing_whose_own_address_has_an_offset(spark):
    html = page(0, "Ann")[2]
    pages = spark.createDataFrame(
        [(1, "http://p/tour-or2-days", html), (2, "http://p/tour-or2-days-or10-x", html),
         (3, "http://q/other", html)], PAGE_SCHEMA)
    seed = listings(spark, [1]).withColumn("url", F.lit("http://p/tour-or2-days"))
    assert [r["page_id"] for r in ingest.page_candidates(pages, seed).collect()] == [1]
