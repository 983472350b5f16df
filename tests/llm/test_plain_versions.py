"""Learnt and looked-up results against plain versions of the same rules."""

import bisect
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewloom.llm import licenses, ngram_join, quality, quality_rules, repeats
from reviewloom.llm.common import table
from reviewloom.llm.textnum import mix, slabs

FOLDER = "/root/testdata/sf0.01"


# 3

def test_scores_are_sums_of_table_entries(spark, documents):
    model = quality.train(documents, table(spark, "/root/testdata/sf0.001", "labels"))
    assert model.pairs and any(len(t) > 3 for t in model.tables)
    got = {r["doc_id"]: r["score"] for r in quality.score(documents, model).collect()}
    batch = documents.select("doc_id", "text").toArrow()
    ids = batch.column(0).to_pylist()
    for first, _, data, lengths in slabs(batch.column(1)):
        for i, row in enumerate(quality.features(data, lengths).tolist()):
            total = model.base + sum(
                t[bisect.bisect_right(e.tolist(), v)]
                for e, t, v in zip(model.edges, model.tables, row, strict=True))
            for (a, b), grid in zip(model.pairs, model.grids, strict=True):
                total += grid[bisect.bisect_right(model.coarse[a].tolist(), row[a]),
                              bisect.bisect_right(model.coarse[b].tolist(), row[b])]
            assert math.isclose(got[ids[first + i]], 1 / (1 + math.exp(-total)), rel_tol=1e-9)


def test_a_cyclic_round_by_hand():
    """Two features, one round: each tree is fitted to what the one before has left."""
    x = np.array([[0, 0], [0, 1], [1, 0], [1, 1], [1, 1], [0, 0]], float)
    y = np.array([0, 0, 1, 1, 1, 0], float)
    model = quality.fit(x, y, rounds=1, pair_rounds=0, pairs=0, rate=0.5)
    total = [math.log((3 + 1) / (6 + 2) / (1 - 4 / 8))] * 6
    tables = []
    for j in range(2):
        p = [1 / (1 + math.exp(-t)) for t in total]
        steps = []
        for v in (0, 1):
            rows = [i for i in range(6) if x[i][j] == v]
            steps.append(0.5 * sum(y[i] - p[i] for i in rows) / (sum(p[i] * (1 - p[i]) for i in rows) + 1))
        total = [t + steps[int(x[i][j])] for i, t in enumerate(total)]
        tables.append(steps)
    for table_, steps, edges in zip(model.tables, tables, model.edges, strict=True):
        at = [bisect.bisect_right(edges.tolist(), v) for v in (0, 1)]
        assert np.allclose(table_[at], steps)


# 5

def plain_measures(text):
    w = re.findall(r"[^\x20\x09-\x0d]+", text or "")
    windows = [tuple(w[p:p + 5]) for p in range(len(w) - 4)]
    seen = {}
    for x in windows:
        seen[x] = seen.get(x, 0) + 1
    inside = {q for p, x in enumerate(windows) if seen[x] > 1 for q in range(p, p + 5)}
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    chars = sum(map(len, w))
    share = lambda a, b: a / b if b else 0.0
    count = lambda pattern: len(re.findall(pattern, text or ""))
    return {
        "words": float(len(w)), "chars_per_word": share(chars, len(w)),
        "symbols_per_char": share(count(r"[#*$%&|<>]"), chars),
        "capitals_per_char": share(count("[A-Z]"), chars), "digits_per_char": share(count("[0-9]"), chars),
        "shouts_per_word": share(count("!"), len(w)), "repeated_lines": share(len(lines) - len(set(lines)), len(lines)),
        "repeated_words": share(len(inside), len(w)), "distinct_words": share(len(set(w)), len(w)),
    }, len(w) < 10 or 100 * len(inside) > 20 * len(w)


def test_kept_is_what_the_list_says(spark):
    documents = table(spark, FOLDER, "documents")
    stats = quality_rules.statistics(documents.select("doc_id", "text"))
    rules = quality_rules.learn(stats, table(spark, FOLDER, "labels"))
    got = {r["doc_id"]: r["kept"] for r in
           quality_rules.judge(documents, table(spark, FOLDER, "labels")).collect()}
    assert rules
    for r in documents.collect():
        measures, failed = plain_measures(r["text"])
        refused = failed or any(
            all((measures[c.measure] >= c.threshold) == c.above for c in rule) for rule in rules)
        assert got[r["doc_id"]] == (not refused)


def test_rules_tell_labels_they_did_not_learn_from(spark):
    docs, labels = table(spark, FOLDER, "documents"), table(spark, FOLDER, "labels")
    found = quality_rules.judge(docs, labels.where("doc_id % 2 = 0"))
    judged = (
        found.join(labels.where("doc_id % 2 = 1"), "doc_id").where("NOT base_failed")
        .agg(F.count_if(F.col("kept") == (F.col("quality") == 1)), F.count("*")).first())
    assert judged[0] >= 0.9 * judged[1] > 0


# 9

def plain_labels(text, cover=0.7):
    w = licenses.words_of(text or "")
    base = {label for phrase, label in licenses.PHRASES.items()
            for p in range(len(w)) if w[p:p + len(phrase.split())] == phrase.split()}
    found = {}
    for label, (template, keys) in licenses.TEMPLATES.items():
        t = licenses.words_of(template)
        for begin in range(1 - len(t), len(w)):
            same = sum(0 <= begin + i < len(w) and w[begin + i] == x for i, x in enumerate(t))
            if same / len(t) < cover:
                continue
            own = w[max(begin, 0):begin + len(t)]
            if all(any(own[p:p + len(k)] == k for p in range(len(own)))
                   for k in map(licenses.words_of, keys)):
                found[label] = max(found.get(label, 0), same / len(t))
    return ",".join(sorted(base | set(found))), max([0.5 if base else 0.0, *found.values()])


def test_templates_at_every_place(spark):
    rng = random.Random(11)
    texts = ["", None, "mit license"]
    for _ in range(40):
        parts = []
        for text, _ in rng.sample(list(licenses.TEMPLATES.values()), rng.randrange(4)):
            words = text.split()
            for i in range(len(words)):
                if rng.random() < rng.choice([0, 0.1, 0.35]):
                    words[i] = "other"
            cut = rng.randrange(5)
            parts += words[cut:] if rng.random() < 0.3 else words
            parts += ["filler"] * rng.randrange(4)
        texts.append(" ".join(parts))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.query(docs).collect()}
    want = {i: plain_labels(t) for i, t in enumerate(texts)}
    assert {i: v[0] for i, v in got.items()} == {i: v[0] for i, v in want.items()}
    assert all(math.isclose(got[i][1], want[i][1]) for i in want)
    assert len({v[0] for v in want.values()}) > 10


# 2 and 8

@pytest.mark.parametrize("size", [60, 200])
def test_unlike_sets_rarely_share_a_signature(size):
    """A pool that half of each set comes from makes a third of whole small parts alike."""
    rng = np.random.default_rng(3)
    features = lambda n: mix(rng.integers(0, 1 << 62, n).astype(np.uint64))
    pool = features(4 * size)
    sets = [np.sort(np.concatenate([
        rng.choice(pool, size // 2, replace=False),
        features(size // 2)])) for _ in range(150)]
    sizes = np.array([len(s) for s in sets])
    row, sign = ngram_join.PartEnum(80).sign(np.repeat(np.arange(150), sizes), np.concatenate(sets), sizes)
    signs = [set(sign[row == i].tolist()) for i in range(150)]
    shared = sum(bool(signs[i] & signs[j]) for i in range(150) for j in range(i))
    assert shared < 0.01 * 150 * 149 / 2


def test_five_thousand_contexts_of_one_anchor(spark):
    """A passage in many documents, each with words of its own on both sides."""
    rng = random.Random(4)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(180))
    texts = []
    for i in range(5000):
        left = "".join(rng.choice("uvwxyz ") for _ in range(60))
        right = "".join(rng.choice("uvwxyz ") for _ in range(60))
        texts.append((i, left + passage + right))
    texts += [(5000 + i, "tail " * 30 + "q" * 10 + passage + "the same ending, which is long enough") for i in range(3)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    for together in (repeats.TOGETHER, 10_000):
        spans = repeats.repeated_spans(docs, 200, together)
        got = {(r["_id"]) for r in spans.select("_id").distinct().collect()}
        assert got == {5000, 5001, 5002}
