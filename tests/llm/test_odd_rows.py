"""Nulls, empty and long texts, ties, repeated rows, no rows, clashing columns."""

from collections import Counter

import duckdb
from pyspark.sql import functions as F

from reviewloom.llm import (
    chat, decontaminate, licenses, line_dedup, mixing, ngram_join, quality, quality_rules, repeats,
    secrets,
)
from tests.llm.conftest import LONG, PROSE


def plain(frame, *columns):
    rows = frame.select(*columns).collect() if columns else frame.collect()
    return Counter(tuple(r) for r in rows)


def test_mixing(odd, none):
    got = mixing.query(odd).collect()
    assert len(got) == odd.count()
    assert all(r["taken"] <= 3 * r["size"] and (r["size"] or not r["taken"]) for r in got)
    total = sum(r["size"] for r in got)
    targets = {r["source_size"]: r["target"] for r in got}
    assert abs(sum(targets.values()) - total) < 1e-6 * total
    rows = mixing.mix(odd)
    assert rows.columns == [*[c for c in odd.columns if c != "copy"], "copy"]
    assert rows.count() == rows.select("doc_id", "text", "source", "copy").distinct().count()
    assert mixing.query(none).count() == mixing.mix(none).count() == 0


def test_targets_stop_at_the_cap(spark):
    sources = spark.createDataFrame(
        [("a", 10), ("b", 1000), (None, 5), ("c", 0)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(sources).collect()}
    # a weighs 5 and stops at 30, b weighs 2, c weighs 1, null weighs 5 and stops at 15.
    assert got == {"a": 30.0, "b": 1015.0 - 45.0, "c": 0.0, None: 15.0}


def test_ngram_join(odd, none):
    got = plain(ngram_join.query(odd), "doc_id", "n_shingles", "component_id")
    assert got[(1, 38, 1)] == 2 and got[(2, 38, 1)] == 1 and got[(None, 38, 1)] == 2
    assert got[(8, 39, 1)] == 1  # 38 of 39 shingles
    assert got[(None, 0, None)] == 1 and got[(3, 0, 3)] == got[(4, 0, 4)] == got[(5, 0, 5)] == 1
    assert got[(6, 1, 6)] == got[(7, 1, 7)] == 1
    kept = plain(ngram_join.one_of_each(odd), "doc_id", "source")
    assert kept[(1, "a")] == 1 and kept[(3, "b")] == kept[(5, "b")] == 1
    assert (2, None) not in kept and (8, "a") not in kept and (None, "a") not in kept
    assert ngram_join.one_of_each(odd).columns == odd.columns
    assert ngram_join.query(none).count() == ngram_join.one_of_each(none).count() == 0


def test_documents_without_ids_form_groups(spark):
    docs = spark.createDataFrame(
        [(None, PROSE), (None, PROSE + " more"), (None, "something else")], "doc_id long, text string")
    assert plain(ngram_join.query(docs), "component_id") == {(None,): 3}
    assert ngram_join.one_of_each(docs).count() == 2


def test_blocks_lose_no_link(documents):
    whole = plain(ngram_join.link_documents(documents), "doc_id", "root")
    assert any(a != b for a, b in whole)
    for blocks in (1, 100):
        parts = ngram_join.link_documents(documents, block_rows=2, blocks_at_once=blocks)
        assert plain(parts, "doc_id", "root") == whole


def test_quality(odd, none, labels):
    got = quality.query(odd, labels).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] == 1}) == 1
    assert not any(r["held_out"] for r in got if r["doc_id"] is None)
    assert {r["score"] for r in quality.query(odd, labels.limit(0)).collect()} == {0.5}
    assert quality.keep_good(odd, labels).columns == odd.columns
    assert quality.query(none, labels).count() == quality.keep_good(none, labels).count() == 0


def test_secrets(spark, odd, none):
    assert {r["spans"] for r in secrets.query(odd).collect()} == {""}
    assert secrets.query(none).count() == 0
    texts = ["😀 Token = 'abcdefghijkl' token:password:abcdefghijkl",
             "AKIA" + "A" * 14 + " AKIAAKIA " + "0123456789abcdef" * 2,
             "x" * 100_000 + "api_key=" + "k" * 12, " ".join(["f" * 16] * 3000)]
    docs = spark.createDataFrame([(i % 2, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = [r["spans"] for r in secrets.query(docs).collect()]
    assert "assign:2:23" in got
    assert "access:0:18,hex:28:60" in got and "assign:100000:100020" in got
    long_one = max(got, key=len).split(",")
    assert len(long_one) == 3000 and long_one[-1] == f"hex:{2999 * 17}:{2999 * 17 + 16}"


def test_quality_rules(odd, none, labels):
    got = quality_rules.query(odd, labels).collect()
    assert len(got) == odd.count()
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[15]["n_repeat_words"] == 40_000 and by_id[15]["base_failed"]
    assert by_id[3]["n_words"] == 0 and not by_id[3]["kept"]
    assert quality_rules.query(none, labels).count() == 0
    assert quality_rules.learn(quality_rules.statistics(odd), labels.limit(0)) == []


def test_line_dedup(odd, none):
    rows = {r["row"]["doc_id"]: r for r in line_dedup.dedup_lines(odd).collect()}
    assert [rows[i]["n_dropped"] for i in (9, 10, 11, 12, 13)] == [2, 1, 1, 1, 0]
    assert rows[10]["kept"] == "own" and rows[13]["kept"] == LONG + "\n" and rows[12]["kept"] == ""
    assert rows[3]["n_lines"] == rows[4]["n_lines"] == 1 and rows[4]["kept"] == ""
    out = line_dedup.without_shared_lines(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    assert out.where("text IS NULL").count() == 2
    assert line_dedup.query(none).count() == line_dedup.without_shared_lines(none).count() == 0


def test_runs_are_compacted_and_tell_new_lines(spark):
    runs = line_dedup.LineRuns(spark, fanout=2)
    batch = lambda *ids: spark.createDataFrame(
        [(k, k, i) for k, i in ids], "_h1 long, _h2 long, doc_id long")
    for part in (batch((1, 1), (2, 1)), batch((1, 2), (3, 2)), batch((1, 3), (1, 3)), batch((4, None))):
        runs.add(part)
    assert [len(level) for level in runs.levels] == [0, 0, 1]
    got = {r["_h1"]: (r["n_docs"], r["last_doc"]) for r in runs.totals().collect()}
    assert got == {1: (3, 3), 2: (1, 1), 3: (1, 2), 4: (1, None)}
    assert [r["_h1"] for r in runs.unseen(batch((1, 9), (5, 9))).collect()] == [5]


def test_a_line_is_in_one_run(spark):
    runs = line_dedup.LineRuns(spark, fanout=2)
    batches = [[(1, 1), (2, None)], [(1, 2), (3, 2)], [(1, 3), (2, 3), (4, 3)], [(4, 4)], [(3, 1), (1, None)]]
    for ids in batches:
        runs.add(spark.createDataFrame(
            [(k, k, i) for k, i in ids], "_h1 long, _h2 long, doc_id long"))
        held = [r["_h1"] for r in runs.rows().collect()]
        assert len(held) == len(set(held))
    got = {r["_h1"]: (r["n_docs"], r["last_doc"]) for r in runs.totals().collect()}
    assert got == {1: (4, 3), 2: (2, 3), 3: (2, 2), 4: (2, 4)}


def test_decontamination(odd, none, benchmark):
    got = {(r["row"]["doc_id"], r["row"]["text"]): r
           for r in decontaminate.contamination(odd, benchmark).collect()}
    assert got[1, PROSE]["n_hit"] == 40 and got[1, PROSE]["items"] == ["1"]
    assert got[None, PROSE]["n_hit"] == 40 and got[8, PROSE + " extra"]["n_hit"] == 40
    assert got[6, "x"]["items"] == ["2"] and got[3, None]["n_words"] == 0
    assert got[15, "the same " * 20_000]["n_hit"] == 40_000
    clean = decontaminate.clean_documents(odd, benchmark)
    assert clean.columns == odd.columns
    assert {r["doc_id"] for r in clean.collect()} >= {3, 4, 5, 9, 10, 14}
    assert decontaminate.query(none, benchmark).count() == 0
    assert decontaminate.query(odd, benchmark.limit(0)).agg(F.sum("n_hit")).first()[0] == 0


def test_items_without_ids_hit(spark):
    docs = [(1, "so A b c it"), (2, "q r"), (3, "a b c q r 7th"), (4, "none"), (None, "Q, R!")]
    items = [(None, "a b c"), (None, "q r"), (None, "a b c"), (5, "7th"), (6, "it")]
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    passages = spark.createDataFrame(items, "item_id long, text string")
    got = {r["row"]["doc_id"]: (r["n_hit"], r["items"])
           for r in decontaminate.contamination(rows, passages).collect()}
    assert got == {1: (4, [None, "6"]), 2: (2, [None]), 3: (6, [None, "5"]), 4: (0, []), None: (2, [None])}
    assert [r["doc_id"] for r in decontaminate.clean_documents(rows, passages).collect()] == [4]
    db = duckdb.connect()
    for name, column, values in (("documents", "doc_id", docs[:-1]), ("benchmark", "item_id", items)):
        db.execute(f"CREATE TABLE {name} ({column} BIGINT, text VARCHAR)")
        db.executemany(f"INSERT INTO {name} VALUES (?, ?)", values)
    want = sorted(db.execute(decontaminate.ORACLE).fetchall())
    query = decontaminate.query(rows.where("doc_id IS NOT NULL"), passages)
    assert sorted(tuple(r) for r in query.collect()) == want


def test_changed_passages_are_near(spark, odd, none, benchmark):
    passage = PROSE.split()
    every = " ".join("new" if i % 6 == 5 else w for i, w in enumerate(passage))
    apart = f"{' pad' * 30} ".join(every.split())
    docs = spark.createDataFrame(
        [(2, every), (2, every), (3, apart), (4, " ".join(every.split()[::-1])), (None, every),
         (5, "z y x"), (6, "x y"), (7, None)], "doc_id long, text string")
    items = spark.createDataFrame(
        [(1, PROSE), (None, "x y z"), (3, "absent x")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.proximity(docs, items).collect()}
    assert set(got) == {(2, 1), (None, 1), (4, 1), (5, None)}
    assert got[2, 1]["n_near"] == got[4, 1]["n_near"] == got[2, 1]["n_sets"] > 1
    assert tuple(got[5, None])[3:] == (1, 1, 0, 3)
    assert decontaminate.query(docs, items).agg(F.sum("n_hit")).first()[0] == 0
    near = plain(decontaminate.proximity(odd, benchmark), "doc_id", "_th", "item_id")
    exact = plain(decontaminate.occurrences(odd, benchmark), "doc_id", "_th", "item_id")
    assert max(near.values()) == 1 and set(exact) <= set(near)
    assert decontaminate.proximity(none, benchmark).count() == 0


def test_repeats(odd, none):
    got = repeats.remove_repeats(odd).collect()
    assert len(got) == odd.count()
    of = lambda i: [r for r in got if r["doc_id"] == i]
    assert all(r["n_removed"] == r["n_bytes"] for r in of(1) + of(2) + of(8)[:0])
    assert of(8)[0]["n_removed"] == len(PROSE) and of(8)[0]["kept"] == b" extra"
    assert of(15)[0]["n_removed"] == of(15)[0]["n_bytes"] == 180_000
    assert of(3)[0]["n_bytes"] == 0 and of(6)[0]["kept"] == b"x"
    assert repeats.query(none).count() == 0


def test_frequent_anchors_give_the_same_spans(documents):
    few = plain(repeats.query(documents))
    keyed = repeats.repeated_spans(documents, together=1)
    assert keyed.count() > 0
    whole = lambda frame: {
        (r["_id"], p) for r in frame.collect() for p in range(r["start"], r["stop"])}
    assert whole(keyed) == whole(repeats.repeated_spans(documents)) and few


def test_licenses(spark, odd, none):
    assert {r["labels"] for r in licenses.query(odd).collect()} == {""}
    assert licenses.query(none).count() == 0
    notice = licenses.TEMPLATES["mit-notice"][0]
    docs = spark.createDataFrame(
        [(1, "ahead " + notice.upper() + " behind"), (2, "GNU General\nPublic License, cc-by"),
         (3, " ".join(notice.split()[::-1])), (None, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.query(docs).collect()}
    assert got[1]["labels"] == "mit-notice" and got[1]["score"] == 1.0
    assert got[2]["labels"] == "cc-by,gpl" and (got[2]["first_word"], got[2]["last_word"]) == (0, 4)
    assert got[3]["labels"] == "" and got[None]["n_words"] == 0


def test_every_notice_of_a_document_is_found(spark):
    notices = {label: text for label, (text, _) in licenses.TEMPLATES.items()}
    scattered = " ".join(
        f"w{i} {w}" for i, w in enumerate(
            w for text in notices.values() for w in licenses.words_of(text)))
    docs = spark.createDataFrame(
        [(1, "\n\n".join(notices.values())), (2, scattered),
         *[(10 + i, f"{scattered} {text} {scattered} " * 20) for i, text in enumerate(notices.values())]],
        "doc_id long, text string")
    got = {r["doc_id"]: (set(r["labels"].split(",")) - set(licenses.PHRASES.values()), r["score"])
           for r in licenses.query(docs).collect()}
    assert got[1] == (set(notices), 1.0)
    assert got[2] == ({""}, 0.0)
    for i, label in enumerate(notices):
        assert got[10 + i] == ({label}, 1.0)


def test_a_notice_without_its_rarest_words_is_found(spark):
    # Three tenths of the words are changed in one of two documents, so they are the rarest.
    text, keys = licenses.TEMPLATES["mit-notice"]
    words = licenses.words_of(text)
    kept = set(licenses.words_of(" ".join(keys)))
    other = [w for w in sorted(set(words) - kept) if words.count(w) == 1][:len(words) * 3 // 10]
    changed = " ".join("changed" if w in other else w for w in words)
    docs = spark.createDataFrame([(1, changed), (2, changed + " changed " + text)], "doc_id long, text string")
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.query(docs).collect()}
    assert len(other) == 8 and got[2] == ("mit-notice", 1.0)
    assert got[1] == ("mit-notice", (len(words) - len(other)) / len(words))


def test_chat(spark):
    rows = [(1, 0, "user", "<s>a</s>"), (1, 1, "assistant", "<\\s> [INST] <|role|>"),
            (1, 1, "assistant", "again"), (None, None, None, None), (2, 5, "", "x<"),
            (3, 0, "sys<|text|>", "[/INST]\\"), (4, 0, "assistant", "y" * 200_000)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string") \
        .withColumn("number", F.lit(1)).withColumn("output", F.lit("o"))
    got = {r["conv_id"]: r for r in chat.query(table).collect()}
    assert set(got) == {-1, 1, None, 2, 3, 4}
    assert got[1]["n_turns"] == 3 and got[1]["loss_chars"] == len("<\\s> [INST] <|role|>again")
    assert got[4]["loss_chars"] == 200_000 and got[None]["loss_chars"] == 0
    said = "</s>[INST] ok [/INST]"
    assert got[-1]["n_turns"] == 2 and got[-1]["loss_chars"] == len(said)
    turns = chat.rendered(table).where("conv_id = 1").orderBy("number").collect()
    assert turns[0]["output"] == "<s>[INST]<|role|>user<|text|><\\s>a<\\/s>[/INST]</s>"
    learnt = [t["output"][s["start"]:s["stop"]] for t in turns for s in t["learnt"]]
    assert [chat.unescape(x) for x in learnt] == ["<\\s> [INST] <|role|>", "again"]
    assert chat.query(table.limit(0)).count() == 1


def test_a_string_that_repeats_within_one_context(spark):
    docs = spark.createDataFrame(
        [(1, "ab" * 110), (2, "x" * 201), (3, PROSE), (4, "c" * 199 + "d")], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"]) for r in repeats.query(docs).collect()}
    assert got == {1: (220, 220), 2: (201, 201), 3: (len(PROSE), 0), 4: (200, 0)}
