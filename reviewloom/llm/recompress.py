"""Long repeated word sequences, by recompression.

Texts are shortened in rounds. A round first gives each run of one symbol a name,
then each pair of neighbours of which the first is of the left half of the alphabet
and the second of the right half. A name is a hash of what it stands for and the
half a bit of a hash of the name, so all tasks name alike, over all rounds and the
whole corpus, without asking each other: what would be one shuffle of all symbols
for each round is none.

Equal sequences get equal symbols but at their ends, where a run or a pair may reach
out. Which symbols of a window of ``length`` words can't be touched by that follows
from its words alone: of each side the outermost run goes, then a symbol that
might be half of a pair. Of those left in the last round with any, the symbol
that stands for the most words is the window's anchor (of equally long ones the one
with the least hash, then the first). Equal windows have equal anchors at the same
place, whatever surrounds them.

Windows in a row with one anchor are a context. Contexts whose anchor stands in one
document only are dropped. Those that occur in a smaller document as a whole are
told by counting, and where an anchor has several contexts, the windows of each
one's least document are compared one by one.

Null, empty and blank texts have no words. A document is its doc_id: rows that share
one aren't compared with each other. Rows without a doc_id are neither compared
nor shortened. Rows that share doc_id and text get the same result. An empty
table has no rows. A long text is parsed in pieces that overlap by a window. Extra
columns are ignored. Words, symbols and windows are told apart by 64-bit hashes.
"""

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from reviewloom.llm.common import text_hash
from reviewloom.llm.textnum import AS_IS, STEP, Words, joined_digests, mix, slabs
from reviewloom.session import staged

#: Rounds of a run step and a pair step each.
ROUNDS = 4
#: Windows whose symbols are worked out at once.
PIECE = 1 << 19
#: Words of the pieces, which may overlap, that a longer stretch is told by.
SIDE = 16
_ALL = (1 << 64) - 1


def _named(a: np.ndarray, b: np.ndarray, kind: int) -> np.ndarray:
    return mix(a * np.uint64(3) + mix(b + np.uint64(kind * int(STEP) & _ALL)))


class Symbols:
    """The symbols of some words after a step: names, where each begins, and ``ends`` of texts.

    ``low[i]`` is the first symbol that is the same in whatever comes before word i,
    ``high[i]`` the end of those that are the same in whatever follows word i - 1.
    """

    def __init__(self, names, begin, ends, low, high):
        self.names, self.begin, self.ends, self.low, self.high = names, begin, ends, low, high

    def runs(self) -> "Symbols":
        first = np.flatnonzero(np.append(True, self.names[1:] != self.names[:-1]))
        sizes = np.diff(np.append(first, len(self.names)))
        named = self.names[first]
        long = sizes > 1
        named[long] = _named(named[long], sizes[long].astype(np.uint64), 1)
        of = np.repeat(np.arange(len(first)), sizes)
        of_low = of[np.minimum(self.low, len(of) - 1)]
        return Symbols(named, self.begin[first], self.ends[first],
                       np.where(self.low < len(of), of_low + 1, len(first)),
                       of[np.maximum(self.high - 1, 0)])

    def pairs(self, number: int) -> "Symbols":
        salt = np.uint64((2 * number + 5) * int(STEP) & _ALL)
        right = (mix(self.names + salt) & np.uint64(1)).astype(bool)
        inner = ~self.ends
        joined = ~right[:-1] & right[1:] & inner[:-1] & inner[1:]
        starts = np.append(True, ~joined)
        first = np.flatnonzero(starts)
        named = self.names[first]
        two = np.append(joined, False)[first]
        named[two] = _named(named[two], self.names[first[two] + 1], 2)
        of = np.cumsum(starts) - 1
        n = len(self.names)
        at, last = np.minimum(self.low, n - 1), np.maximum(self.high - 1, 0)
        low = np.where(self.low < n, of[at] + right[at], len(first))
        return Symbols(named, self.begin[first], self.ends[first], low, of[last] + right[last])


def anchors(hashes: np.ndarray, ends: np.ndarray, windows: np.ndarray, length: int):
    """(round, symbol's name, first word) of the anchor of each window.

    ``hashes`` are the words, and a value of its own where a text ``ends``;
    ``windows`` are the words at which windows begin.
    """
    n = len(hashes)
    level = Symbols(hashes, np.arange(n), ends, windows, windows + length)
    levels = [level]
    for number in range(ROUNDS):
        level = level.runs().pairs(number)
        levels.append(level)
    out = [np.zeros(len(windows), t) for t in (np.int64, np.uint64, np.int64)]
    left = np.arange(len(windows))
    for number in range(ROUNDS, -1, -1):
        level = levels[number]
        some = level.low[left] < level.high[left]
        chosen, left = left[some], left[~some]
        if len(chosen):
            at = _greatest(level, n, level.low[chosen], level.high[chosen])
            for column, value in zip(out, (number, level.names[at], level.begin[at]), strict=True):
                column[chosen] = value
    return out


def _greatest(level: Symbols, n: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The symbol of the most words in low ... high - 1; of equals the least name, then the first."""
    words = np.minimum(np.append(level.begin[1:], n) - level.begin, 255).astype(np.uint64)
    key = (np.uint64(255) - words) << np.uint64(56) | mix(level.names) >> np.uint64(8)
    size, out = high - low, np.zeros(len(low), np.int64)
    best, width = np.arange(len(key)), 1
    while True:
        fit = (size >= width) & (size < 2 * width)
        a, b = best[low[fit]], best[np.minimum(high[fit] - width, len(best) - 1)]
        out[fit] = np.where(key[b] < key[a], b, a)
        if not (size >= 2 * width).any():
            return out
        a, b = best[:-width], best[width:]
        best = np.append(np.where(key[b] < key[a], b, a), best[len(best) - width:])
        width *= 2


def _doubled(hashes: np.ndarray, width: int) -> np.ndarray:
    follows = np.concatenate([hashes[width:], np.zeros(min(width, len(hashes)), np.uint64)])
    return mix(hashes * np.uint64(3) + mix(follows + STEP))


def _block(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of ``size`` words (a power of two) from each place on."""
    width = 1
    while width < size:
        hashes, width = _doubled(hashes, width), 2 * width
    return hashes


def _span(block: np.ndarray, size: int, begin: np.ndarray, length) -> np.ndarray:
    """Hashes of the words from ``begin`` on; ``length`` is ``size`` at least."""
    length = np.broadcast_to(length, begin.shape)
    out = length.astype(np.uint64) * STEP
    for i in range(-(-int(length.max(initial=0)) // size)):
        out = mix(out * np.uint64(3) + block[begin + np.minimum(i * size, length - size)])
    return out


def contexts_of(hashes: np.ndarray, ends: np.ndarray, windows: np.ndarray, length: int):
    """(first window, windows, anchor, context) of the contexts of some windows."""
    number, name, at = anchors(hashes, ends, windows, length)
    change = np.append(True, (np.diff(windows) != 1) | (np.diff(at) != 0) | (np.diff(number) != 0))
    first = np.flatnonzero(change[:len(windows)])
    count = np.diff(np.append(first, len(windows)))
    begin, at = windows[first], at[first]
    stop = begin + count - 1 + length
    anchor = _named(name[first], number[first].astype(np.uint64), 3)
    block = _block(hashes, SIDE)
    context = _named(_span(block, SIDE, begin, stop - begin), (at - begin).astype(np.uint64), 4)
    return begin, count, anchor, context


def _places(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = [batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)]
        for first, last, data, lengths in slabs(batch.column(2)):
            words, rows = Words(data, lengths, lowered=AS_IS), last - first
            at = np.arange(len(words.starts)) + words.doc
            stops = words.bounds[1:] + np.arange(rows)
            hashes, ends = np.empty(len(at) + rows, np.uint64), np.zeros(len(at) + rows, bool)
            hashes[at], ends[stops] = words.hashes(), True
            hashes[stops] = mix(mix(np.arange(rows, dtype=np.uint64) + STEP) + STEP)
            windows = at[np.repeat(stops, words.counts) - at >= length]
            for low in range(0, len(windows), PIECE):
                some = windows[low:low + PIECE]
                a, b = int(some[0]), int(some[-1]) + length
                begin, count, anchor, context = contexts_of(hashes[a:b], ends[a:b], some - a, length)
                begin = begin + a
                row = np.searchsorted(stops, begin)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[0][first:last][row]), pa.array(keys[1][first:last][row]),
                     pa.array((begin - row - words.bounds[row]).astype(np.int32)),
                     pa.array(count.astype(np.int32)), pa.array(anchor.view(np.int64)),
                     pa.array(context.view(np.int64))],
                    names=["_id", "_th", "start", "n", "anchor", "context"])


def _windows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Every window of the given contexts, by its hash."""
    for batch in batches:
        keys = [batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)]
        for first, last, data, lengths in slabs(batch.column(2)):
            words = Words(data, lengths, lowered=AS_IS)
            block = _block(words.hashes(), SIDE)
            held = batch.column(3).slice(first, last - first)
            start, n = (held.flatten().field(k).to_numpy().astype(np.int64) for k in (0, 1))
            row = np.repeat(np.arange(last - first), held.value_lengths().to_numpy())
            step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            start, row = np.repeat(start, n) + step, np.repeat(row, n)
            window = _span(block, SIDE, words.bounds[row] + start, length)
            yield pa.RecordBatch.from_arrays(
                [pa.array(window.view(np.int64)), pa.array(keys[0][first:last][row]),
                 pa.array(keys[1][first:last][row]), pa.array(start.astype(np.int32))],
                names=["window", "_id", "_th", "start"])


def _keyed(docs: DataFrame) -> DataFrame:
    """The texts with keys that are never null: doc_id, or a hash in its place, and a hash of the text."""
    return docs.select(
        "doc_id", F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(F.lit("none"), "text")).alias("_id"),
        text_hash(F.col("text")).alias("_th"), F.coalesce("text", F.lit("")).alias("text"))


def repeated_spans(docs: DataFrame, length: int = 50) -> DataFrame:
    """(_id, _th, start, stop): words in windows of ``length`` that a smaller doc_id holds too.

    Spans may overlap. ``length`` is at least SIDE.
    """
    keyed = _keyed(docs.where("doc_id IS NOT NULL")).drop("doc_id")
    places = staged(keyed.mapInArrow(
        lambda batches: _places(batches, length),
        "_id long, _th long, start int, n int, anchor long, context long"))
    # Written tables on both sides let adaptive execution split the join of a hot anchor.
    shared = staged(
        places.groupBy("anchor").agg(F.min("_id").alias("_low"), F.max("_id").alias("_high"))
        .where("_low < _high").select("anchor"))
    places = staged(places.join(shared, "anchor"))
    contexts = staged(places.groupBy("anchor", "context").agg(F.min("_id").alias("low")))
    several = staged(contexts.groupBy("anchor").agg(F.count("*").alias("_n")).where("_n > 1").select("anchor"))
    told = staged(places.join(contexts, ["anchor", "context"]))
    whole = told.where("_id > low").select(
        "_id", "_th", "start", (F.col("start") + F.col("n") + (length - 1)).alias("stop"))
    open_ones = (
        told.where("_id = low").join(several, "anchor").groupBy("_id", "_th")
        .agg(F.collect_list(F.struct("start", "n")).alias("_contexts")))
    windows = staged(
        keyed.join(open_ones, ["_id", "_th"]).select("_id", "_th", "text", "_contexts").mapInArrow(
            lambda batches: _windows(batches, length), "window long, _id long, _th long, start int"))
    twice = staged(
        windows.groupBy("window").agg(F.min("_id").alias("low"), F.max("_id").alias("_high"))
        .where("low < _high").select("window", "low"))
    single = windows.join(twice, "window").where("_id > low").select(
        "_id", "_th", "start", (F.col("start") + length).alias("stop"))
    return whole.unionByName(single)


_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def _cut_out(batches: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last, data, lengths in slabs(batch.column(1)):
            words, rows = Words(data, lengths, lowered=AS_IS), last - first
            held = batch.column(2).slice(first, rows)
            sizes = held.value_lengths().fill_null(0).to_numpy()
            row = np.repeat(np.arange(rows), sizes)
            start, stop = (held.flatten().field(k).to_numpy().astype(np.int64) for k in (0, 1))
            mark = np.zeros(len(words.starts) + 1, np.int64)
            np.add.at(mark, words.bounds[row] + start, 1)
            np.add.at(mark, words.bounds[row] + stop, -1)
            kept = np.cumsum(mark[:-1]) == 0
            counts = np.bincount(words.doc[kept], minlength=rows)
            digests = joined_digests(words, np.flatnonzero(kept), counts)
            texts = [None] * rows
            if with_text:
                for i, text in enumerate(batch.column(1).slice(first, rows).cast(pa.large_binary()).to_pylist()):
                    own = kept[words.bounds[i]:words.bounds[i + 1]]
                    texts[i] = b" ".join(w for w, k in zip(_WORD.findall(text), own, strict=True) if k).decode()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(first, rows), pa.array(words.counts),
                 pa.array(words.counts - counts), pa.array(digests), pa.array(texts, pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])


def remove_repeats(docs: DataFrame, length: int = 50, with_text: bool = True) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept) of every row.

    ``kept`` holds the words that remain, joined by one space, or null without
    ``with_text``; the digest is that of ``kept``.
    """
    spans = repeated_spans(docs, length).groupBy("_id", "_th").agg(
        F.collect_list(F.struct("start", "stop")).alias("_spans"))
    return (
        _keyed(docs).join(spans, ["_id", "_th"], "left")
        .select(F.col("doc_id").cast("long"), "text", "_spans").mapInArrow(
            lambda batches: _cut_out(batches, with_text),
            "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"))


def query(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs, with_text=False).drop("kept")


ORACLE = r"""
WITH d AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (
    SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS win
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
low AS (SELECT win, min(doc_id) AS low FROM p GROUP BY win HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT doc_id, list(DISTINCT q) AS hit FROM (
    SELECT doc_id, unnest(range(i, i + 50)) AS q FROM p JOIN low USING (win) WHERE doc_id > low)
    GROUP BY doc_id),
kept AS (
    SELECT doc_id, string_agg(w[q], ' ' ORDER BY q) AS kept
    FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS q FROM d)
    WHERE NOT EXISTS (SELECT 1 FROM (SELECT doc_id AS x, unnest(hit) AS y FROM hit) WHERE x = doc_id AND y = q)
    GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(len(hit), 0) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
