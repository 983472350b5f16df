"""Cases that went wrong once."""

import hashlib

import corpus_pipeline
from pyspark.sql import functions as F

from reviewloom.llm import decontaminate, mixing, secrets


def test_a_long_item_beside_a_frequent_short_one(spark):
    words = [f"w{i}" for i in range(20_000)]
    text = " ".join(x for i in range(5_000) for x in (*words[4 * i:4 * i + 4], "a frequent little item"))
    docs = spark.createDataFrame([(1, text), (2, " ".join(words[100:140]) + " end")], "doc_id long, text string")
    items = spark.createDataFrame(
        [(7, "a frequent little item"), (8, " ".join(words))], "item_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.query(docs, items).collect()}
    assert (got[1]["n_hit"], got[1]["n_items"]) == (20_000, 1)
    assert (got[2]["n_hit"], got[2]["contaminated"]) == (40, True)
    assert got[2]["items_sha256"] == hashlib.sha256(b"8").hexdigest()


def test_an_item_that_repeats_its_words(spark):
    docs = spark.createDataFrame(
        [(1, "x " + "a b " * 40), (2, "a b " * 6 + "a c"), (3, "b " + "a b " * 6)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b " * 300)], "item_id long, text string")
    got = {r["doc_id"]: r["n_hit"] for r in decontaminate.query(docs, items).collect()}
    assert got == {1: 80, 2: 13, 3: 13}


def test_a_column_named_copy_is_replaced(spark, odd):
    mixed = mixing.mix(odd)
    assert mixed.columns == [c for c in odd.columns if c != "copy"] + ["copy"]
    assert mixed.agg(F.min("copy")).first()[0] == 1 and mixed.where("copy = 6 AND copies <> 4").isEmpty()


def test_pipeline_of_odd_rows(spark, odd, labels, benchmark, tmp_path):
    folder = str(tmp_path / "sf")
    for name, table in (("documents", odd), ("labels", labels), ("benchmark", benchmark)):
        table.write.parquet(f"{folder}/{name}.parquet")
    out = corpus_pipeline.run(spark, folder)
    rows = out.collect()
    assert out.columns == [c for c in odd.columns if c != "copy"] + ["copy"]
    given = {(r["doc_id"], r["source"]) for r in odd.collect()}
    assert {(r["doc_id"], r["source"]) for r in rows} <= given


def test_a_rule_with_letters_beyond_ascii(spark):
    docs = spark.createDataFrame([(1, "x ÉCLÉ1234 y"), (2, "éclé1234")], "doc_id long, text string")
    rules = (*secrets.RULES, secrets.Rule("own", "ÉCLÉ[0-9]{4}"))
    assert secrets.trigram_query("ÉCLÉx") == frozenset([frozenset(["Écl", "clÉ", "lÉx"])])
    found = {r["_id"]: r["rules"] for r in secrets.candidates(docs, rules).collect()}
    assert "own" in found[1] and 2 not in found
