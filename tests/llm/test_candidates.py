"""Which documents the n-gram join compares."""

import random
import time
from collections import Counter
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from reviewloom.llm import ngram_join
from reviewloom.llm.ngram_join import may_be_linked, sketch
from reviewloom.session import staged


def _texts(own: int, seed: int = 5) -> dict[int, str]:
    """Forty texts of 300 words, alike but for ``own`` ones at the end of each."""
    rng = random.Random(seed)
    common = [f"c{rng.randrange(10 ** 9)}" for _ in range(300 - own)]
    return {i: " ".join(common + [f"o{i}x{k}" for k in range(own)]) for i in range(40)}


def test_unlike_documents_with_common_signatures_are_no_candidates(spark, monkeypatch):
    seen, plain = [], ngram_join.components

    def components(edges):
        seen.append(edges.count())
        return plain(edges)

    monkeypatch.setattr(ngram_join, "components", components)
    docs = spark.createDataFrame(list(_texts(100).items()), "doc_id long, text string")
    found = ngram_join.link_documents(docs, 5, 80)
    assert {(r["doc_id"], r["root"]) for r in found.collect()} == {(i, i) for i in range(40)}
    assert seen[0] == 0


def test_a_group_of_near_copies_makes_no_pairs_of_all(spark, monkeypatch):
    seen, plain = [], ngram_join.components

    def components(edges):
        seen.append(edges.count())
        return plain(edges)

    monkeypatch.setattr(ngram_join, "components", components)
    docs = spark.createDataFrame(list(_texts(4).items()), "doc_id long, text string")
    found = ngram_join.link_documents(docs, 5, 80)
    assert {(r["doc_id"], r["root"]) for r in found.collect()} == {(i, 0) for i in range(40)}
    assert max(seen) < 3 * 40  # not 40 * 39 / 2


def test_pairs_and_stars_find_the_same_links(spark):
    texts = _texts(20) | {100 + i: t for i, t in _texts(90).items()}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for paired in (2, 8, 64):
        found = ngram_join.link_documents(docs, 5, 80, block_rows=4, blocks_at_once=1, paired=paired)
        got = {r["doc_id"]: r["root"] for r in found.collect()}
        assert got == {i: 0 if i < 100 else i for i in texts}, paired


def test_sketches_leave_out_no_linked_pair():
    rng = np.random.default_rng(3)
    for n in (1, 2, 7, 31, 33, 250, 257, 2000):
        left = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        for changed in (0, n // 20, n // 9, n // 4, n // 2, n):
            for more in (0, n // 5, n):
                right = np.concatenate([
                    left[changed:], rng.integers(0, 1 << 63, changed + more, dtype=np.uint64)])
                both = n - changed
                linked = 100 * both >= 80 * (n + len(right) - both)
                allowed = may_be_linked(n, len(right), sketch(left), sketch(right), 80)
                assert allowed or not linked
                if n >= 250 and changed >= n // 2:
                    assert not allowed


def test_bits_of_shared_signatures(spark):
    """Signatures are counted packed, three bytes each; before, each was a row of 16 bytes in a shuffle."""
    texts = list(_texts(20).values())
    docs = spark.createDataFrame(list(enumerate(texts)), "_id long, text string").repartition(3)
    column = pa.array(texts, pa.large_string())
    enum, signs = ngram_join.PartEnum(80), []
    for _, rows, values, n in ngram_join._texts([pa.RecordBatch.from_arrays([column], names=["text"])], 3):
        signs.append(enum.sign(rows, values, n)[1])
    number = Counter(np.concatenate(signs).tolist())
    packed = docs.mapInArrow(partial(ngram_join._packed_signs, size=3, percent=80), "bucket int, prints binary")
    assert packed.selectExpr("sum(length(prints))").first()[0] <= 3 * sum(number.values())
    held = ngram_join._held_bits(
        packed.repartition("bucket").sortWithinPartitions("bucket")
        .mapInArrow(ngram_join._shared_bits, "bucket int, bits binary"))
    found = docs.mapInArrow(partial(ngram_join._signs, size=3, percent=80, held=held), "sign long, _id long")
    got = Counter(r["sign"] & ngram_join.ALL for r in found.collect())
    want = Counter({sign: times for sign, times in number.items() if times > 1})
    assert want and not want - got and len(got - want) <= 0.01 * len(number)


def test_staged_tables_leave_no_shuffle_files(spark):
    def left():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {x for x in found.mkString(" ").split() if "/shuffle_" in x}

    kept = spark.range(10).repartition(3)
    assert kept.count() == 10
    before = left()
    table = staged(spark.range(1000).repartition(5).groupBy((F.col("id") % 7).alias("k")).count())
    for _ in range(50):
        if left() <= before:
            break
        time.sleep(0.2)
    assert left() <= before and table.count() == 7
    assert staged(kept).count() == kept.count() == 10


def test_rows_alone_are_not_shuffled(spark):
    """One row of each group as before, and rows without a copy pass without an exchange."""
    words = [" ".join(f"w{(i * 37 + j * j) % 997}" for j in range(30)) for i in range(40)]
    rows = [(i, t) for i, t in enumerate(words)] + [(100, words[3] + " more"), (101, words[4]), (5, words[5])]
    rows += [(None, words[6]), (None, "lone text"), (None, "lone text"), (7, " \n"), (7, None), (8, ""), (9, "!!!")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = ngram_join.one_of_each(docs)
    assert Counter(tuple(r) for r in left.collect()) == Counter(
        list(enumerate(words)) + [(None, "lone text"), (7, " \n"), (7, None), (8, ""), (9, "!!!")])
    plan = left._jdf.queryExecution().optimizedPlan().toString()
    assert "bit_get" in plan and "Union" in plan
