"""Frequency tables, deduplication, ids, phrases and lookups on small data."""

import itertools
import statistics
from collections import Counter

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from reviewloom.functions.enrichment import language_code
from reviewloom.operators import (
    dedup, filters, frequency, language, lookup, phrases,
)
from reviewloom.plans import report
from reviewloom.schema import COLUMNS, REVIEW_SCHEMA


def reviews(spark, rows):
    """Reviews from dicts; columns not given are null."""
    return spark.createDataFrame([tuple(r.get(c) for c in COLUMNS) for r in rows], REVIEW_SCHEMA)


def pairs(df):
    return [tuple(r) for r in df.collect()]


def test_value_counts_leave_out_nulls_and_break_ties_by_label(spark):
    df = reviews(spark, [{"city": c} for c in ["b", "a", None, "c", "c"]])
    assert pairs(frequency.value_counts(df, "city")) == [("c", 2), ("a", 1), ("b", 1)]
    assert pairs(frequency.top_values(df, "city", 1)) == [("c", 2)]


def test_dimension_counts_drop_nulls_per_dimension(spark):
    df = reviews(spark, [
        {"city": "a", "language": None}, {"city": None, "language": "EN"},
        {"city": "a", "language": "EN"}])
    got = {(d, label): n for d, label, n in pairs(frequency.dimension_counts(df))}
    assert got == {("city", "a"): 2, ("language", "EN"): 2}
    single = {(c, label): n for c in frequency.DIMENSIONS
              for label, n in pairs(frequency.value_counts(df, c))}
    assert got == single


def test_totals_count_null_text_as_short(spark):
    df = reviews(spark, [{"review_text": t} for t in [None, "w " * 20, "w " * 19]])
    assert pairs(frequency.totals(df)) == [(3, 1)]


def test_rating_stats(spark):
    df = reviews(spark, [{"rating": r} for r in [5.0, 4.5, 4.0, None, float("nan")]])
    row = frequency.rating_stats(df).first()
    assert (row["rating_count"], row["rating_mean"], row["rating_median"]) == (3, 4.5, 4.5)
    assert (row["five_star_pct"], row["four_star"]) == (33.3, 1)
    assert frequency.rating_stats(reviews(spark, [{}])).count() == 0


@settings(max_examples=6, deadline=None)
@given(st.lists(st.integers(-50, 50), min_size=1, max_size=60))
def test_median_by_running_sum_is_the_median(spark, numbers):
    df = reviews(spark, [{"rating": n / 2} for n in numbers])
    row = frequency.rating_stats(df).first()
    assert row["rating_median"] == statistics.median(n / 2 for n in numbers)


def test_date_ranges(spark):
    df = reviews(spark, [{"date": d} for d in ["2024-01", "2024", "", None, "2024-02-30", "2024-01-05"]])
    assert pairs(frequency.date_range(df)) == [("2024", "2024-02-30")]
    assert str(frequency.strict_date_range(df).first()["last_day"]) == "2024-01-05"


def test_running_total_and_ids_for_many_rows(spark):
    df = spark.range(5000).select(
        F.pmod(F.hash("id"), F.lit(10_007)).alias("a"), "id", F.lit(2).alias("n"))
    got = pairs(frequency.running_total(df, ["a", "id"]).orderBy("a", "id").select("total"))
    assert [t for (t,) in got] == list(range(2, 10_001, 2))
    numbered = dedup.assign_ids(df.withColumnRenamed("id", "b"), ["a", "b"], 7)
    ids = [r["id"] for r in numbered.orderBy("a", "b").collect()]
    assert ids == list(range(8, 5008))


def test_dedup_first(spark):
    rows = [(3, "Ann ", "Same text"), (1, "ann", "same TEXT "), (2, "Bob", "same text"),
            (4, None, None)]
    df = spark.createDataFrame(rows, "seq int, reviewer_name string, review_text string")
    kept = dedup.dedup_first(df, ["seq"])
    assert sorted(r["seq"] for r in kept.collect()) == [1, 2, 4]
    again = dedup.dedup_first(kept, ["seq"])
    assert sorted(pairs(again)) == sorted(pairs(kept))
    assert dedup.distinct_keys(df).count() == 3


def test_dedup_does_not_depend_on_partitions(spark):
    df = spark.range(3000).select(
        F.col("id").alias("seq"), F.lit("hot").alias("reviewer_name"),
        F.concat(F.lit("t"), (F.col("id") % 17).cast("string")).alias("review_text"))
    results = [
        sorted(r["seq"] for r in dedup.dedup_first(df.repartition(n), ["seq"]).collect())
        for n in (1, 7)]
    assert results[0] == results[1] == list(range(17))


def test_merge_keeps_stored_ids(spark):
    schema = "id long, seq int, reviewer_name string, review_text string"
    stored = spark.createDataFrame([(1, 9, "Ann", "a b"), (2, 8, "Bob", "c d")], schema)
    delta = spark.createDataFrame(
        [(None, 3, "ANN ", "a b"), (None, 5, "Eve", "x"), (None, 4, "eve", "X"),
         (None, 6, "Max", "y")], schema)
    merged = dedup.merge_new(
        dedup.with_keys(stored), dedup.with_keys(delta), ["seq"]).orderBy("id")
    assert [(r["id"], r["reviewer_name"]) for r in merged.collect()] \
        == [(1, "Ann"), (2, "Bob"), (3, "eve"), (4, "Max")]


def test_merge_handles_new_rows_only(spark, monkeypatch):
    seen, plain = [], dedup.dedup_first

    def dedup_first(df, order):
        seen.append(sorted(r["seq"] for r in df.collect()))
        return plain(df, order)

    monkeypatch.setattr(dedup, "dedup_first", dedup_first)
    schema = "id long, seq int, k_name string, k_text string, note string"
    stored = spark.createDataFrame(
        [(1, 1, "ann", "a", "x"), (2, 2, None, "b", "x"), (3, 2, "dan", "d", "x")], schema)
    delta = spark.createDataFrame(
        [(None, 3, "ann", "a", "y"), (None, 4, None, "b", "z"), (None, 4, None, "b", "y"),
         (None, 6, "eve", "c", "z"), (None, 5, "eve", "c", "y"), (None, 7, "dan", "d", "y")], schema)
    merged = dedup.merge_new(stored, delta, ["seq"]).orderBy("id").collect()
    # A key without a name is nobody's, so it is always new.
    assert [(r["id"], r["seq"], r["note"]) for r in merged[3:]] == [(4, 4, "y"), (5, 5, "y")]
    assert seen == [[4, 4, 5, 6]]


def test_phrases_bridge_stop_words(spark):
    df = spark.createDataFrame([("the best pasta of the lake",)] * 2, "review_text string")
    got = dict((p, (tf, df_)) for p, tf, df_ in pairs(
        phrases.phrase_counts(df, stop_words=["the", "of"])))
    assert got == {p: (2, 2) for p in ("best pasta", "pasta lake", "best pasta lake")}
    assert phrases.phrase_counts(df.limit(1)).count() == 0


def counted_by_hand(texts, k, least):
    total, documents = Counter(), Counter()
    for words in (t.split() for t in texts):
        found = [" ".join(words[i:i + n]) for n in (2, 3, 4) for i in range(len(words) - n + 1)]
        total.update(found)
        documents.update(set(found))
    kept = [(p, n) for p, n in total.items() if documents[p] >= least]
    return sorted(kept, key=lambda x: (-x[1], x[0]))[:k]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["aa", "bb", "cc"]), max_size=9).map(" ".join),
                min_size=1, max_size=6), st.integers(1, 8), st.integers(1, 3))
def test_top_phrases_equal_a_count_by_hand(spark, texts, k, least):
    df = spark.createDataFrame([(t,) for t in texts], "review_text string")
    for parts in (1000, 0):
        got = pairs(phrases.top_phrases(
            df, k, stop_words=[], min_documents=least, max_parts=parts))
        assert got == counted_by_hand(texts, k, least)


def test_profiles(spark):
    df = spark.createDataFrame(
        [("the cat the", "en"), ("der und der", "de"), (None, "en"), ("x", None)],
        "text string, lang string")
    trained = language.train_language_profiles(df, size=2)
    model = language.collect_profiles(trained)
    assert {k: sorted(v) for k, v in model.items()} \
        == {"en": [" th", "he "], "de": [" de", "der"]}


def test_first_contained_lowest_entry_wins(spark):
    texts = spark.createDataFrame(
        [(1, "Venice, Italy"), (2, "nothing"), (3, "VERONA nice"), (4, "")], "k int, t string")
    dictionary = spark.createDataFrame(
        [(0, "nice", "France"), (1, "venice", "Italy"), (2, "verona", "Italy")],
        "ord int, needle string, label string")
    got = lookup.first_contained(texts, "k", "t", dictionary)
    assert sorted(pairs(got)) == [(1, "France"), (3, "France")]


def test_block_pages_are_dropped(spark):
    pages = spark.createDataFrame(
        [(1, "<title>Access Denied</title>"), (2, "<title>ok</title>"), (3, "x"), (4, None)],
        "page_id int, html string")
    assert sorted(r["page_id"] for r in filters.drop_block_pages(pages).collect()) == [2, 3, 4]


def test_min_words_and_plain_filters(spark):
    df = reviews(spark, [
        {"review_text": "a <b>b</b> c d e", "language": "EN", "rating": 1.0, "date": "2024"},
        {"review_text": "", "language": "IT", "date": ""}, {"rating": float("nan")}])
    assert [r["review_text"] for r in filters.min_words(df).collect()] == ["a b c d e"]
    assert filters.in_language(df).count() == filters.rated(df).count() == 1
    assert filters.dated(df).count() == 1 and filters.with_text(df).count() == 2
    assert filters.project_columns(df).columns == COLUMNS


def test_report_without_ratings_has_no_rating_fields(spark, tmp_path):
    df = reviews(spark, [{"city": "a", "region": "r", "review_text": "x"}])
    report.export_report(df, str(tmp_path / "report"))
    saved = spark.read.json(str(tmp_path / "report"))
    assert saved.count() == 1 and "rating_mean" not in saved.columns
    assert saved.first()["by_region"]["r"] == 1


def test_counts_add_up_to_the_labelled_rows(spark):
    labels = list(itertools.islice(itertools.cycle(["a", "b", None]), 50))
    df = reviews(spark, [{"platform": p} for p in labels])
    counted = frequency.dimension_counts(df).agg(F.sum("n")).first()[0]
    assert counted == sum(p is not None for p in labels)
    rollup = frequency.ingest_rollup(df).where("level = 3").first()
    assert rollup["n"] == 50


def test_languages_of_unseen_texts(spark):
    """Profiles from every other document, on the documents between them."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    profiles = language.collect_profiles(
        language.train_language_profiles(docs.where("doc_id % 2 = 0")))
    code = language_code(F.col("text"), profiles)
    unseen = docs.where("doc_id % 2 = 1").select((code == F.col("lang")).cast("int").alias("right"))
    assert unseen.agg(F.avg("right")).first()[0] >= 0.99
