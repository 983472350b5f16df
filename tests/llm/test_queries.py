"""The registered queries against SQL or a plain version of what they compute."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from checks.compare import rows_of
from reviewloom.llm.licenses import PHRASES, words_of
from reviewloom.llm.queries import ORACLE, QUERIES


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def rows(db):
    return db.execute("SELECT doc_id, text FROM documents").fetchall()


@pytest.mark.parametrize("name", ORACLE)
def test_query_agrees_with_its_sql(spark, db, folder, name):
    frame = QUERIES[name](spark, folder)
    result = db.execute(ORACLE[name])
    want = rows_of([d[0] for d in result.description], result.fetchall())
    assert rows_of(frame.columns, frame.collect()) == want


def test_links_by_comparing_all_sets(spark, db, folder):
    sets = {}
    for i, text in rows(db):
        w = re.findall(r"[^\x20\x09-\x0d]+", lower(text))
        sets[i] = set(zip(w, w[1:], w[2:])) if len(w) > 2 else {tuple(w)} if w else set()
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 90 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    got = QUERIES["op2_ngram_jaccard_join"](spark, folder).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} \
        == {i: (len(s), root(i)) for i, s in sets.items()}


def test_quality_on_held_out_documents(spark, db):
    folder = "/root/testdata/sf0.01"
    marks = dict(db.execute(f"SELECT doc_id, quality FROM '{folder}/labels.parquet'").fetchall())
    got = [r for r in QUERIES["op3_quality_classifier"](spark, folder).collect() if r["held_out"]]
    assert all(0 <= r["score"] <= 1 for r in got)
    judged = [(r["predicted"], marks[r["doc_id"]]) for r in got if r["doc_id"] in marks]
    assert sum(p == m for p, m in judged) >= 0.95 * len(judged) > 0
    assert all(p for p, m in judged if m)  # clean documents stay


def test_rule_statistics_by_hand(spark, db, folder):
    got = {r["doc_id"]: r for r in QUERIES["op5_quality_rules"](spark, folder).collect()}
    for i, text in rows(db):
        w = re.findall(r"[^\x20\x09-\x0d]+", text or "")
        windows = [tuple(w[p:p + 5]) for p in range(len(w) - 4)]
        often = Counter(windows)
        inside = {q for p, x in enumerate(windows) if often[x] > 1 for q in range(p, p + 5)}
        lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        failed = len(w) < 10 or 100 * len(inside) > 20 * len(w)
        r = got[i]
        assert tuple(r)[1:7] == (
            len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")),
            len(lines) - len(set(lines)), len(inside), failed)
        assert not (failed and r["kept"])


def test_rules_tell_labels(spark, db):
    folder = "/root/testdata/sf0.01"
    marks = dict(db.execute(f"SELECT doc_id, quality FROM '{folder}/labels.parquet'").fetchall())
    got = QUERIES["op5_quality_rules"](spark, folder).collect()
    judged = [(r["kept"], marks[r["doc_id"]]) for r in got
              if r["doc_id"] in marks and not r["base_failed"]]
    assert sum(k == bool(m) for k, m in judged) >= 0.95 * len(judged)


def test_repeats_by_counting_all_strings(spark, db, folder):
    texts = [(i, (t or "").encode()) for i, t in rows(db)]
    often = Counter(b[p:p + 200] for _, b in texts for p in range(len(b) - 199))
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op8_repeated_strings"](spark, folder).collect()}
    for i, b in texts:
        marked = bytearray(len(b))
        for p in range(len(b) - 199):
            if often[b[p:p + 200]] > 1:
                marked[p:p + 200] = b"\1" * 200
        kept = bytes(x for x, m in zip(b, marked) if not m)
        spans = len(re.findall(b"\1+", bytes(marked)))
        assert got[i] == (len(b), sum(marked), spans, hashlib.sha256(kept).hexdigest())


def test_license_phrases_by_hand(spark, db):
    folder = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in QUERIES["op9_license_scan"](spark, folder).collect()}
    found = defaultdict(int)
    for i, text in db.execute(f"SELECT doc_id, text FROM '{folder}/documents.parquet'").fetchall():
        w, at, labels = words_of(text or ""), [], set()
        for phrase, label in PHRASES.items():
            key = phrase.split()
            own = [p for p in range(len(w)) if w[p:p + len(key)] == key]
            at += own
            labels |= {label} if own else set()
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (
            len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels)))
        assert labels <= set(r["labels"].split(","))
        found[r["base_labels"]] += 1
    assert len(found) > 3


def test_pipeline_stages_act_and_keep_the_columns(spark, db, folder):
    docs = corpus_pipeline.table(spark, folder, "documents")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.staged(stage(spark, docs, folder))
        assert docs.columns == columns, name
        counts.append(docs.count())
    assert counts[0] > counts[1] == counts[2] > counts[3] > counts[4] > 0
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert mixed.columns == [*columns, "copy"] and mixed.agg({"copy": "max"}).first()[0] <= 3
    again = corpus_pipeline.run(spark, folder).select("doc_id", "copy").collect()
    assert sorted(again) == sorted(mixed.select("doc_id", "copy").collect())
