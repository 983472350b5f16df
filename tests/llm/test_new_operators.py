"""Operators 11 to 13 against plain versions, and on rows of every odd kind."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewloom.llm import periodic, prefix_trie, recompress
from reviewloom.llm.queries import QUERIES
from reviewloom.llm.textnum import STEP, mix

WORD = r"[^\x20\x09-\x0d]+"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


# 11

def plain_trie(conversations):
    """Every node, from sequences as tuples: conv_id -> [(role, text)]."""
    members, ends = defaultdict(list), defaultdict(list)
    for conv, turns in conversations.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(conv)
        ends[tuple(turns)].append(conv)
    kids = Counter(k[:-1] for k in members if k)
    out = []
    for key, some in members.items():
        below = [k for k in members if k[:len(key)] == key]
        out.append((
            min(some), len(key), min(members[key[:-1]]) if key else None, len(some), kids[key],
            sum(not kids[k] for k in below),
            sum((len(members[k]) - 1) * len(k[-1][1]) for k in below if k),
            digest(",".join(map(str, sorted(ends[key]))))))
    return sorted(out, key=str)


def conversations(spark, some):
    rows = [(c, i, r, t) for c, turns in some.items() for i, (r, t) in enumerate(turns)]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_over_many_shards(spark, seed):
    rng = random.Random(seed)
    some = {}
    for c in range(160):
        base = some[rng.choice(list(some))] if some and rng.random() < 0.7 else []
        turns = base[:rng.randrange(len(base) + 1)] + [
            ("user", rng.choice("abé") * rng.randrange(1, 4)) for _ in range(rng.randrange(1, 5))]
        some[rng.randrange(-500, 500) * 2 + c % 2] = turns
    some |= {10_000 + i: some[next(iter(some))] for i in range(40)}  # one frequent conversation
    some[77_777] = [("user", "deep")] * 40  # deeper than a block of columns
    some[77_778] = [("user", "deep")] * 33 + [("user", "other")]
    got = prefix_trie.prefix_trie(prefix_trie.turn_sequences(conversations(spark, some)), turns=20)
    assert sorted(map(tuple, got.collect()), key=str) == plain_trie(some)


def test_pieces_of_a_long_list_of_ends(spark, monkeypatch):
    rows = spark.range(3000).select(
        F.col("id").alias("conv_id"), F.array(F.lit(5).cast("long")).alias("ids"), F.array(F.lit(2)).alias("chars"))
    root, node = sorted(prefix_trie.prefix_trie(rows, turns=500).collect(), key=lambda r: r["depth"])
    assert node["ends_sha256"] == digest(",".join(map(str, range(3000))))
    assert (root["n_convs"], root["n_leaves"], node["saved_tokens"]) == (3000, 1, 2 * 2999)


def test_trie_of_odd_turns(spark):
    rows = [
        (1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, None, None), (2, 1, "user", "b"),
        (2, 0, "user", "a"), (None, 0, "user", "x"), (-150, 0, "user", "n"), (-100, 0, "user", "m"),
        (300, 0, "", ""), (399, 0, "user", "own"), (399, 1, "user", "x" * 70_000),
    ]
    table = spark.createDataFrame(
        [(*r, "k", 1, 2, 3) for r in rows],
        "conv_id long, turn int, role string, text string, key string, base int, ids int, depth int")
    turns = defaultdict(list)
    for c, t, r, x in sorted((r for r in rows if r[0] is not None), key=lambda r: (
            r[0], r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        turns[c].append((r or "", x or ""))
    rebuilt = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(np.fmod(c, 100))
        rebuilt[c] = turns[base][:h] + own[h:] if base in turns else own[h:]
    got = prefix_trie.query(table).collect()
    assert sorted(map(tuple, got), key=str) == plain_trie(rebuilt)
    assert prefix_trie.query(table.limit(0)).collect() == []
    whole = prefix_trie.prefix_trie(prefix_trie.turn_sequences(table)).collect()
    assert sorted(map(tuple, whole), key=str) == plain_trie(dict(turns))


# 12

def plain_repeats(texts, length=50):
    words = [(i, re.findall(WORD, t or "")) for i, t in texts]
    low = {}
    for i, w in words:
        for p in range(len(w) - length + 1):
            key = tuple(w[p:p + length])
            if i is not None:
                low[key] = min(low.get(key, i), i)
    out = []
    for i, w in words:
        hit = set()
        for p in range(len(w) - length + 1):
            if i is not None and low[tuple(w[p:p + length])] < i:
                hit |= set(range(p, p + length))
        kept = [x for p, x in enumerate(w) if p not in hit]
        out.append((i, len(w), len(hit), digest(" ".join(kept)), " ".join(kept)))
    return sorted(out, key=str)


def texts_of(seed):
    rng = random.Random(seed)
    words = [f"w{n}" for n in range(rng.choice([2, 3, 40, 400]))]
    pool = [[rng.choice(words) for _ in range(rng.randrange(30, 160))] for _ in range(8)]
    pool += [["a"] * 130, ["a", "b"] * 70, ["x"] * 60 + ["y"] + ["x"] * 60]
    out = []
    for i in range(60):
        parts = []
        for _ in range(rng.randrange(4)):
            piece = rng.choice(pool)
            a = rng.randrange(len(piece))
            parts += piece[a:a + rng.randrange(40, 140)] if rng.random() < 0.6 else piece
            if rng.random() < 0.3 and parts:
                parts[rng.randrange(len(parts))] = "changed"
            parts += [rng.choice(words) for _ in range(rng.randrange(5))]
        out.append((i, rng.choice([" ", "\n", " \t"]).join(parts)))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_repeats_by_comparing_all_windows(spark, monkeypatch, seed):
    texts = texts_of(seed)
    monkeypatch.setattr(recompress, "PIECE", 64 if seed % 2 else 1 << 19)
    got = recompress.remove_repeats(spark.createDataFrame(texts, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=str) == plain_repeats(texts)


def test_anchors_depend_on_their_window_alone():
    rng = np.random.default_rng(7)
    for symbols in (1, 2, 5, 1000):
        words = mix(rng.integers(0, symbols, 400).astype(np.uint64) + STEP)
        ends = np.zeros(400, bool)
        whole = recompress.anchors(words, ends, np.arange(351), 50)
        for at in range(0, 351, 25):
            own = recompress.anchors(words[at:at + 50], ends[:50], np.arange(1), 50)
            assert [own[0][0], own[1][0], own[2][0] + at] == [c[at] for c in whole]


def test_repeats_in_odd_rows(spark, odd, none):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    got = recompress.remove_repeats(odd)
    assert sorted(map(tuple, got.collect()), key=str) == plain_repeats(rows)
    assert recompress.query(none).collect() == []


# 13

def plain_runs(w):
    found = {}
    for q in range(1, len(w) // 3 + 1):
        i = 0
        while i < len(w) - q:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(24, 3 * q):
                found.setdefault((i, j + q), q)
            i = j
    return sorted((a, b - a, q) for (a, b), q in found.items())


def plain_periodic(doc_id, text):
    w = re.findall(WORD, text or "")
    n = len(w)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = sorted(plain_runs(w), key=lambda r: (r[0], r[2]))
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    dropped = {i for a, size, q in runs for i in range(a + q, a + size)}
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            digest("".join("%d,%d,%d\n" % r for r in runs)),
            digest(" ".join(x for i, x in enumerate(w) if i not in dropped)))


def test_runs_by_comparing_all_periods(spark, db):
    texts = [(i, t) for i, t in db.execute("SELECT doc_id, text FROM documents").fetchall()
             if len(re.findall(WORD, t or "")) < 1500]
    got = {r["doc_id"]: tuple(r) for r in
           QUERIES["op13_periodic_runs"](spark, "/root/testdata/sf0.001").collect()}
    assert {i: got[i] for i, _ in texts} == {i: plain_periodic(i, t) for i, t in texts}
    assert sum(r[1] > 0 for r in got.values()) > 5


def random_words(rng):
    n, k, out = rng.choice([0, 5, 30, 150, 500]), rng.choice([1, 2, 3, 50]), [1]
    while len(out) < n:
        kind = rng.random()
        if kind < 0.35:
            out += [rng.randrange(k) for _ in range(rng.randrange(1, 20))]
        elif kind < 0.6:
            root = [rng.randrange(k) for _ in range(rng.randrange(1, 60))]
            out += (root * 12)[:len(root) * rng.randrange(2, 6) + rng.randrange(len(root))]
        else:
            a = rng.randrange(len(out))
            out += out[a:a + rng.randrange(1, 80)] * rng.randrange(1, 5)
    return out[:n]


def test_runs_of_random_and_of_very_regular_words():
    rng = random.Random(3)
    fibonacci = ([0], [0, 1])
    while len(fibonacci[1]) < 600:
        fibonacci = (fibonacci[1], fibonacci[1] + fibonacci[0])
    special = [fibonacci[1], [bin(i).count("1") & 1 for i in range(512)],
               [0] * 37 + [1] + [0] * 40 + [1] + [0] * 38 + [1] + ([0] * 20 + [1]) * 20]
    for texts in [special] + [[random_words(rng) for _ in range(3)] for _ in range(60)]:
        w, begin, want = [], 0, []
        for number, x in enumerate(texts):
            want += [(a + begin, a + size + begin, q) for a, size, q in plain_runs(x)]
            w += [v + 1000 for v in x] + [10**9 + number]
            begin += len(x) + 1
        got = periodic.runs_of(mix(np.array(w, np.uint64) + STEP), np.array([len(x) for x in texts]))
        assert [tuple(r) for r in got.tolist()] == sorted(want, key=lambda r: (r[0], r[2]))


def test_runs_in_odd_rows(spark, odd, none):
    got = sorted(map(tuple, periodic.query(odd).collect()), key=str)
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    short = [r for r in rows if len(r[1] or "") < 20_000]
    want = sorted((plain_periodic(i, t) for i, t in short), key=str)
    assert len(got) == len(rows) and all(w in got for w in want)
    long = {r[0]: r for r in got if r[0] in (14, 15)}
    assert (long[14][1:6] == (1, 0, 30_000, 1, 30_000_000) or long[14][1] == 0) and long[15][2:5] == (0, 40_000, 2)
    assert periodic.query(none).collect() == []
    runs = periodic.periodic_runs(odd.where("doc_id = 15")).first()
    assert [tuple(r) for r in runs["runs"]] == [(0, 40_000, 2)]
