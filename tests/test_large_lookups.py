"""Long dictionaries, distances of ranks, numbers ahead of phrases, pages as bytes."""

import random
from collections import Counter

from pyspark.sql import functions as F

from checks import inputs
from reviewloom.operators import language, lookup, phrases
from reviewloom.sources import readers


def test_a_hundred_thousand_entries(spark):
    rng = random.Random(5)
    letters = "abcdefgh"
    word = lambda n: "".join(rng.choice(letters) for _ in range(n))
    entries = [(i, word(rng.choice([1, 2, 4, 6, 7, 9, 12])) if i % 997 else "É" + word(3), f"L{i}")
               for i in range(100_000, 0, -1)]
    entries = [(o, n, v) for o, n, v in entries if len(n) > 5 or o % 9973 == 0 or n[0] == "É"]
    texts = [(i, word(rng.randrange(1, 60)) + (" éabc x" if i % 7 == 0 else "")) for i in range(300)]
    texts += [(900, ""), (901, None), (902, "É")]
    df = spark.createDataFrame(texts, "id long, text string")
    dictionary = spark.createDataFrame(entries, "ord long, needle string, label string")
    got = {r["id"]: r["label"] for r in lookup.first_indexed(df, "id", "text", dictionary).collect()}
    ordered = sorted(entries)
    want = {}
    for i, text in texts:
        for _, needle, label in ordered:
            if needle.lower() in (text or "").lower():
                want[i] = label
                break
    assert got == want and len(want) > 100
    index = lookup.rarest_grams(df, "text", dictionary)
    assert index.groupBy("needle").count().where("count > 1").isEmpty()


def test_an_empty_dictionary_or_no_texts(spark):
    df = spark.createDataFrame([(1, "abc")], "id long, text string")
    none = spark.createDataFrame([], "ord int, needle string, label string")
    some = spark.createDataFrame([(1, "b", "x"), (2, "", "y")], none.schema)
    assert lookup.first_indexed(df, "id", "text", none).collect() == []
    assert lookup.first_indexed(df.limit(0), "id", "text", some).collect() == []
    assert [tuple(r) for r in lookup.first_indexed(df, "id", "text", some).collect()] == [(1, "x")]


def test_distances_by_hand(spark):
    profiles = spark.createDataFrame(
        [("a", 1, " th"), ("a", 2, "the"), ("a", 3, "he "), ("b", 1, "the"), ("b", 4, "xyz")],
        "lang string, place int, gram string")
    texts = spark.createDataFrame([(1, "the the"), (2, "qqq"), (3, None)], "id long, text string")
    # The places of the own trigrams: by count, then by trigram.
    own = Counter(f" {t} "[i:i + 3] for t in ["the the"] for i in range(len(t)))
    places = {g: p for p, g in enumerate(sorted(own, key=lambda g: (-own[g], g)), 1)}
    known = {"a": {" th": 1, "the": 2, "he ": 3}, "b": {"the": 1, "xyz": 4}}
    want = {(1, lang): sum(abs(p - ranks[g]) if g in ranks else 300 for g, p in places.items())
            for lang, ranks in known.items()}
    got = language.rank_distances(texts, "id", profiles)
    assert {(r["id"], r["lang"]): r["distance"] for r in got.collect()} == want
    found = language.detect_by_rank(texts, "id", profiles, labels={"a": "A", "b": "B"})
    assert {r["id"]: r["language"] for r in found.collect()} == {1: "A", 2: "EN", 3: "EN"}


def test_ranks_tell_unseen_texts(spark):
    docs = inputs.documents(spark, "/root/testdata/sf0.01").where("lang IS NOT NULL")
    profiles = language.train_language_profiles(docs.where("doc_id % 2 = 0"))
    unseen = docs.where("doc_id % 2 = 1")
    told = language.detect_by_rank(unseen, "doc_id", profiles, labels={c: c for c in ("en", "de", "fr", "es")})
    right = told.join(unseen, "doc_id").agg(
        F.count_if(F.col("language") == F.col("lang")), F.count("*")).first()
    assert right[0] >= 0.99 * right[1] > 0


def test_few_numbers_change_no_count(spark):
    """With eight numbers nearly all phrases share one, and all are told apart."""
    english = inputs.raw_reviews(spark, "/root/testdata/sf0.001")
    want = sorted(map(tuple, phrases.phrase_counts(english).collect()))
    assert sorted(map(tuple, phrases.phrase_counts(english, bits=3).collect())) == want
    assert sorted(map(tuple, phrases.phrase_counts(english, bits=16).collect())) == want
    everything = phrases.phrase_counts(english, min_documents=1)
    assert sorted(map(tuple, everything.where("df >= 2").collect())) == want


def _phrases_by_hand(texts, lengths, least):
    total, documents = Counter(), Counter()
    for words in (t.split() for t in texts if t is not None):
        found = [" ".join(words[i:i + n]) for n in lengths for i in range(len(words) - n + 1)]
        total.update(found)
        documents.update(set(found))
    return sorted((p, n, documents[p]) for p, n in total.items() if documents[p] >= least)


def test_phrases_of_any_lengths_equal_a_count_by_hand(spark):
    rng = random.Random(3)
    texts = [None, "", "aa", "aa bb", "aa bb", "aa aa aa aa aa", "aa bb cc aa bb cc aa bb", "aa bbb", "aab bb"]
    texts += [" ".join(rng.choice(["aa", "aab", "a_", "bb", "éé", "cc9"]) for _ in range(rng.randrange(12)))
              for _ in range(40)]
    df = spark.createDataFrame([(t,) for t in texts], "review_text string").repartition(3)
    for lengths, least, bits in (((2, 3, 4), 2, 26), ((2, 4), 2, 1), ((3,), 1, 3), ((1, 2, 3), 3, 26), ((4, 2, 3), 1, 1)):
        got = phrases.phrase_counts(df, lengths=lengths, stop_words=[], min_documents=least, bits=bits)
        assert sorted(map(tuple, got.collect())) == _phrases_by_hand(texts, lengths, least)


def test_phrases_are_shuffled_once_a_row_for_each_word(spark, monkeypatch):
    """Of new words nothing repeats, so nothing can be left out: three phrases begin at each of them."""
    texts = [(" ".join(f"w{i}x{j}" for j in range(50)),) for i in range(20)]
    df = spark.createDataFrame(texts, "review_text string")
    monkeypatch.setattr(phrases, "staged", lambda _: 1 / 0)
    counted = phrases.phrase_counts(df, bits=3)
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and counted.count() == 0
    dealt = plan.split("Exchange")[1]
    assert dealt.count("explode") == 1 and "concat(" not in dealt
    assert phrases._openings(phrases._words(df, "review_text", []), (2, 3, 4)).count() == 20 * 49


def test_pages_in_all_encodings(spark, tmp_path):
    body = '<html><head><META charset={}></head><body>Привет «мир» — и é</body></html>'
    tag = '<html><meta http-equiv="Content-Type" content="text/html; charset=windows-1251">Привет</html>'
    files = {
        "utf8": (body.format("utf-8").encode(), body.format("utf-8")),
        "bom": (b"\xef\xbb\xbf" + body.format("utf-8").encode(), body.format("utf-8")),
        "le": (b"\xff\xfe" + body.format("x").encode("utf-16-le"), body.format("x")),
        "be": (b"\xfe\xff" + body.format("x").encode("utf-16-be"), body.format("x")),
        "cyr": (tag.encode("windows-1251"), tag),
        "none": ("é и".encode(), "é и"),
        "broken": (b"\xff\xfa\x00 <meta charset=utf-8>", None),
        "unknown": (b"<meta charset='no-such'>abc", None),
        "codec": (b"<meta charset=zlib>abc", None),
        "cut": (b"\xff\xfea", None),
    }
    for name, (data, _) in files.items():
        (tmp_path / f"{name}.html").write_bytes(data)
    read = readers.read_page_files(spark, f"{tmp_path}/*.html")
    got = {r["url"].split("/")[-1].removesuffix(".html"): r["html"] for r in read.collect()}
    assert got == {name: text for name, (_, text) in files.items()}
    failures = readers.unreadable_files(read).collect()
    assert len(failures) == 4 and all(r["strategy"] == "file" and r["error"] for r in failures)


def test_entries_are_proposed_by_long_grams(spark):
    """A text that holds every five characters of an entry, but not the entry, proposes nothing."""
    texts = spark.createDataFrame(
        [(1, "abcde bcdef cdefg defgh efghi"), (2, "xx ABCDEFGHI yy")], "id long, text string")
    dictionary = spark.createDataFrame([(1, "abcdefghi", "L")], "ord int, needle string, label string")
    assert lookup.rarest_grams(texts.where("id = 1"), "text", dictionary).isEmpty()
    assert [tuple(r) for r in lookup.first_indexed(texts, "id", "text", dictionary).collect()] == [(2, "L")]


def _exchanged(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_trigram_is_shuffled(spark):
    """A text goes to its key's task whole; before, each of its trigrams was a row of an exchange."""
    texts = spark.createDataFrame(
        [(1, "the the"), (1, "thé"), (2, None), (3, "ab"), (None, "a b")], "id long, text string")
    ranked = language.ranked_trigrams(texts, "id", size=4)
    assert _exchanged(ranked).count("Exchange") == 1 and "Generate" not in _exchanged(ranked).split("Exchange")[1]
    got = {}
    for r in sorted(ranked.collect(), key=lambda r: (str(r["id"]), r["place"])):
        got.setdefault(r["id"], []).append(r["gram"])
    assert got == {1: [" th", "he ", "the", "e t"], 3: [" ab", "ab "], None: [" a ", " b ", "a b"]}


def test_trained_profiles_are_the_most_frequent_trigrams(spark):
    texts = [("a", "Ab ab, ab"), ("a", "𝒳b"), ("b", ""), (None, "ab"), ("c", None)]
    docs = spark.createDataFrame(texts, "lang string, text string")
    want = Counter(run[i:i + 3] for run in (" ab ab ab ", " 𝒳b ") for i in range(len(run) - 2))
    trained = language.train_language_profiles(docs)
    assert "MapInPandas" in _exchanged(trained)
    assert {(r["lang"], r["place"], r["gram"], r["n"]) for r in trained.collect()} == {
        ("a", i, g, want[g]) for i, g in enumerate(sorted(want, key=lambda g: (-want[g], g)), 1)}


def test_short_dictionaries_cut_no_text(spark):
    texts = spark.createDataFrame(
        [(1, "The Lake and"), (1, "a lake"), (2, None), (3, "none"), (None, "LAKE")], "id long, text string")
    dictionary = spark.createDataFrame(
        [(2, "lake", "L"), (1, "THE ", "T"), (0, "", "E"), (3, "the ", "X")],
        "ord int, needle string, label string")
    found = lookup.first_contained(texts, "id", "text", dictionary)
    assert "Generate" not in _exchanged(found)
    assert {(r["id"], r["label"]) for r in found.collect()} == {(1, "T"), (None, "L")}


def test_a_long_index_shuffles_no_other_grams(spark, monkeypatch):
    """Beyond what is broadcast, grams of no entry were shuffled; results are the same in several turns."""
    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("abcd") for _ in range(n))
    texts = [(i % 90, " ".join(word(rng.randrange(3, 12)) for _ in range(30)) + " é𝒳éabcd") for i in range(100)]
    texts += [(900, ""), (901, None), (5, None), (None, "éabcd")]
    entries = [(o, word(rng.randrange(5, 8)), f"L{o % 50}") for o in range(3000, 1000, -1)] + [(2000, "ÉABCD", "E")]
    df = spark.createDataFrame(texts, "id long, text string")
    dictionary = spark.createDataFrame(entries, "ord long, needle string, label string")
    want = Counter()
    for i, text in texts:
        held = [(o, v, n) for o, n, v in entries if n.lower() in (text or "").lower()]
        if held and i is not None:
            want[i, min(held)[1]] += 1
    monkeypatch.setattr(lookup, "LISTED_GRAMS", 100)
    monkeypatch.setattr(lookup, "TRIED", 1)
    seen = []
    grams = lookup.text_grams
    monkeypatch.setattr(lookup, "text_grams", lambda text, lengths, held=None: seen.append(
        (out := grams(text, lengths, held), df.select(F.sum(F.size(out))).first()[0],
         df.select(F.sum(F.size(grams(text, lengths)))).first()[0])) or out)
    got = lookup.first_indexed(df, "id", "text", dictionary)
    assert Counter((r["id"], r["label"]) for r in got.collect()) == want and len(want) > 80
    assert len(seen) == 2 and all(few < 0.7 * all_of for _, few, all_of in seen)


def test_bits_let_every_gram_through(spark):
    numbers = lookup.gram_numbers("".join(chr(33 + i * i % 90) for i in range(400)), [3, 5])
    held = lookup._gram_bits(spark.createDataFrame([(int(x),) for x in numbers], "gram long"))
    others = lookup.gram_numbers("zyxwvutsrqponmlkjihgfedcba" * 3, [9])
    assert lookup._has_bits(numbers, held.value).all() and not lookup._has_bits(others, held.value).any()
