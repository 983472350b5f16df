"""Quality scores by a generalised additive model with pairwise interactions.

Each feature has a table of scores by bin, and so have a few pairs of features;
a document's score is the sum of what its bins hold. The tables are learnt by
boosting shallow trees, one feature after the other in turn.

Null and empty texts have all features 0 and a score like any other. Rows are
scored one by one, so repeated rows agree. A null doc_id is not held out and
never learnt from. Without usable labels every score is the share of label 1,
or a half. An empty table has no rows. A text is measured whole, a long one alone. A
score that equals the threshold is good. Extra columns are ignored or passed through.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from reviewloom.llm.common import row_keys
from reviewloom.llm.textnum import Words, slabs

#: Labelled documents the model is fitted on, at most.
SAMPLE = 20_000
#: Fixed value: what the contract predicts from.
THRESHOLD = 0.3

_SPACE, _BREAK, _DIGIT, _CAPITAL, _SMALL, _SYMBOL, _STOP, _SHOUT, _OTHER, _CONTROL = range(10)


def _classes() -> np.ndarray:
    out = np.full(256, _CONTROL, np.uint8)
    out[128:] = _OTHER
    for chars, kind in (
            (" \t", _SPACE), ("\n\r\x0b\x0c", _BREAK), ("0123456789", _DIGIT),
            ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", _CAPITAL), ("abcdefghijklmnopqrstuvwxyz", _SMALL),
            ("#*$%&|<>@^~`_={}[]/+\\", _SYMBOL), (".,;:?'\"()-", _STOP), ("!", _SHOUT)):
        out[list(chars.encode())] = kind
    return out


_CLASS = _classes()
FEATURES = [
    "log_bytes", "log_words", "word_bytes", "longest_word", "spread_of_word_bytes",
    "spaces", "breaks", "digits", "capitals", "symbols", "stops", "shouts", "other", "controls",
    "distinct_words", "repeated_words", "one_byte_words", "long_words", "bytes_per_break",
]


def features(data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A row of numbers for each text of a slab."""
    rows = len(lengths)
    doc = np.repeat(np.arange(rows), lengths)
    count = np.bincount(doc * 10 + _CLASS[data], minlength=rows * 10).reshape(rows, 10)
    words = Words(data, lengths)
    sizes, own, n = words.sizes.astype(float), words.doc, words.counts
    each = lambda x: np.bincount(own, weights=x, minlength=rows) / np.maximum(n, 1)
    mean = each(sizes)
    longest = np.zeros(rows)
    np.maximum.at(longest, own, sizes)
    h = words.hashes()
    again = np.zeros(len(h))
    again[1:] = (h[1:] == h[:-1]) & (own[1:] == own[:-1])
    order = np.lexsort((h, own))
    new = np.ones(len(h))
    new[1:] = (h[order][1:] != h[order][:-1]) | (own[order][1:] != own[order][:-1])
    share = count / np.maximum(lengths, 1)[:, None]
    return np.column_stack([
        np.log1p(lengths), np.log1p(n), mean, longest,
        np.sqrt(np.maximum(each(sizes ** 2) - mean ** 2, 0)),
        *[share[:, k] for k in (
            _SPACE, _BREAK, _DIGIT, _CAPITAL, _SYMBOL, _STOP, _SHOUT, _OTHER, _CONTROL)],
        np.bincount(own, weights=new[np.argsort(order)] if len(order) else new, minlength=rows)
        / np.maximum(n, 1),
        each(again), each(sizes == 1), each(sizes > 20),
        np.log1p(lengths / (count[:, _BREAK] + 1)),
    ])


@dataclass
class Model:
    """Score tables: of single features, and of pairs with their feature numbers."""

    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray]
    pairs: list[tuple[int, int]]
    grids: list[np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for j, (edges, values) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += values[np.searchsorted(edges, x[:, j], side="right")]
        for (i, j), grid in zip(self.pairs, self.grids, strict=True):
            total += grid[np.searchsorted(self.coarse[i], x[:, i], side="right"),
                          np.searchsorted(self.coarse[j], x[:, j], side="right")]
        return 1 / (1 + np.exp(-total))


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    inner = np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1], method="higher")
    return np.unique(inner)


def _stumps(g: np.ndarray, h: np.ndarray, leaves: int = 3) -> np.ndarray:
    """Newton steps of a small tree over ordered bins, from their gradients."""
    step = lambda a, b: g[a:b].sum() / (h[a:b].sum() + 1)
    parts = [(0, len(g))]
    for _ in range(leaves - 1):
        best = (1e-9, None, None)
        for k, (a, b) in enumerate(parts):
            if b - a < 2:
                continue
            gl, hl = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1]
            gt, ht = g[a:b].sum(), h[a:b].sum()
            gain = gl ** 2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt ** 2 / (ht + 1)
            if gain.max() > best[0]:
                best = (gain.max(), k, a + int(gain.argmax()) + 1)
        if best[1] is None:
            break
        a, b = parts.pop(best[1])
        parts += [(a, best[2]), (best[2], b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = step(a, b)
    return out


def _quarters(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """(gain, steps) of the best cut of a grid along both axes."""
    gs, hs = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    if min(g.shape) < 2:
        return 0.0, np.zeros(g.shape)
    a, b = gs[:-1, :-1], hs[:-1, :-1]
    corners = [
        (a, b), (gs[:-1, -1:] - a, hs[:-1, -1:] - b), (gs[-1:, :-1] - a, hs[-1:, :-1] - b),
        (gs[-1, -1] - gs[:-1, -1:] - gs[-1:, :-1] + a, hs[-1, -1] - hs[:-1, -1:] - hs[-1:, :-1] + b)]
    gain = sum(x ** 2 / (y + 1) for x, y in corners) - gs[-1, -1] ** 2 / (hs[-1, -1] + 1)
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    out = np.empty(g.shape)
    for (x, y), where in zip(corners, (
            np.s_[:i + 1, :j + 1], np.s_[:i + 1, j + 1:], np.s_[i + 1:, :j + 1], np.s_[i + 1:, j + 1:]),
            strict=True):
        out[where] = x[i, j] / (y[i, j] + 1)
    return float(gain[i, j]), out


def fit(x: np.ndarray, y: np.ndarray, bins: int = 32, coarse_bins: int = 8, rounds: int = 150,
        pair_rounds: int = 50, pairs: int = 5, rate: float = 0.15) -> Model:
    """Fit the tables to labels 0 and 1."""
    prior = (y.sum() + 1) / (len(y) + 2) if len(y) else 0.5
    model = Model(float(np.log(prior / (1 - prior))), [], [], [], [], [])
    if not len(y) or y.min() == y.max():
        return model
    width = x.shape[1]
    model.edges = [_edges(x[:, j], bins) for j in range(width)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    binned = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.edges)]
    total = np.full(len(y), model.base)

    def slopes(cells, size):
        p = 1 / (1 + np.exp(-total))
        return (np.bincount(cells, weights=y - p, minlength=size),
                np.bincount(cells, weights=p * (1 - p), minlength=size))

    for _ in range(rounds):
        for j in range(width):
            step = rate * _stumps(*slopes(binned[j], len(model.tables[j])))
            model.tables[j] += step
            total += step[binned[j]]
    model.coarse = [_edges(x[:, j], coarse_bins) for j in range(width)]
    rough = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.coarse)]
    shape = lambda i, j: (len(model.coarse[i]) + 1, len(model.coarse[j]) + 1)
    cell = lambda i, j: rough[i] * shape(i, j)[1] + rough[j]

    def cut(i, j):
        size = shape(i, j)
        return _quarters(*[s.reshape(size) for s in slopes(cell(i, j), size[0] * size[1])])

    ranked = sorted(((cut(i, j)[0], i, j) for i in range(width) for j in range(i)), reverse=True)
    model.pairs = [(i, j) for gain, i, j in ranked[:pairs] if gain > 0]
    model.grids = [np.zeros(shape(i, j)) for i, j in model.pairs]
    for _ in range(pair_rounds):
        for grid, (i, j) in zip(model.grids, model.pairs, strict=True):
            step = rate * cut(i, j)[1]
            grid += step
            total += step.ravel()[cell(i, j)]
    return model


def held_out(doc_id: Column) -> Column:
    rest = F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5))
    return F.coalesce(rest == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> Model:
    """Fit a model on at most ``rows`` labelled documents that aren't held out.

    Those are the first by a hash of their doc_id, so reruns agree.
    """
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)
                     & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    # At most ``rows`` rows of two numbers are broadcast.
    texts = docs.select("doc_id", *row_keys(), "text").join(
        F.broadcast(chosen.select(F.col("doc_id").alias("_d"), "quality")), F.col("doc_id") == F.col("_d"))
    made = texts.select("_id", "_th", "quality", "text").mapInArrow(
        _measure, "_id long, _th long, quality int, x array<double>")
    found = made.orderBy("_id", "_th").limit(2 * rows).collect()
    x = np.array([r["x"] for r in found], dtype=float).reshape(len(found), len(FEATURES))
    return fit(x, np.array([r["quality"] for r in found], dtype=float))


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last, data, lengths in slabs(batch.column(3)):
            x = features(data, lengths)
            at = np.arange(0, x.size + 1, x.shape[1]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(k).slice(first, last - first) for k in range(2)]
                + [batch.column(2).slice(first, last - first).cast(pa.int32()),
                   pa.ListArray.from_arrays(pa.array(at), pa.array(x.ravel()))],
                names=["_id", "_th", "quality", "x"])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row: the chance of label 1, from the text alone."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, lengths in slabs(batch.column(1)):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first),
                     pa.array(model.score(features(data, lengths)))], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score is at least ``threshold``."""
    model = train(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            for first, last, data, lengths in slabs(texts):
                good = model.score(features(data, lengths)) >= threshold
                yield batch.slice(first, last - first).filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, train(docs, labels)).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
