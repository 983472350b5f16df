"""Runs of words that repeat with a period, by string synchronising sets.

A run is a stretch of words with smallest period q, at least LEAST words and
TIMES * q long, that no neighbouring word extends. Runs are searched by the size
of their period, scale by scale, ``t`` being 4, 8, 16 and so on:

- Periods below SMALL are found by comparing each word with the one q before it.
- A scale covers the periods from 2t up to 4t. Its synchronising set holds the
  places i where the least hash of the t + 1 strings of t words that begin at
  i ... i + t is that of the first or of the last. Whether a place belongs to it
  depends on the 2t words from there on only, its context. Strings of a period of
  at most t / 3 don't take part: those regions are known from smaller scales.
- Any q places in a row of a run of period q hold a place of the set, and q words
  on the same context comes again. So places of equal context at a distance from
  2t up to 4t propose that distance as a period, and comparing words tells how far
  it holds. At most twelve places of equal context are that near to each other.

A stretch found with several periods has the least of them. Words are told apart
by 64-bit hashes. A text is searched as a whole, in memory in proportion to it.

Null, empty and blank texts have no words and no runs. Repeated rows, and rows that
share a doc_id, get a result each. An empty table has no rows. Extra columns are
ignored. A row without a doc_id has no remainder to be altered by, and stays as it is.
"""

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from reviewloom.llm.repeats import sliding
from reviewloom.llm.textnum import AS_IS, STEP, Words, joined_digests, mix, slabs

#: Least words of a run, and how many times its period it is at least.
LEAST, TIMES = 24, 3
#: Periods below this are found directly: those of the first scale begin here.
SMALL = 8
_LAST = np.uint64((1 << 64) - 1)


def _stretches(same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(begin, end) of each stretch of true values."""
    change = np.flatnonzero(np.diff(np.concatenate([[0], same.view(np.int8), [0]])))
    return change[::2], change[1::2]


def _small_periods(w: np.ndarray) -> np.ndarray:
    """(begin, end, period) of regions of a period below SMALL, four words or more."""
    out = [np.zeros((0, 3), np.int64)]
    for q in range(1, min(SMALL, len(w))):
        begin, end = _stretches(w[q:] == w[:-q])
        end = end + q
        long = end - begin >= max(4, TIMES * q)
        out.append(np.stack([begin[long], end[long], np.full(int(long.sum()), q)], axis=1))
    return np.concatenate(out)


def _extended(w: np.ndarray, at: int, q: int) -> tuple[int, int]:
    """The stretch around ``at`` in which words q apart are the same."""
    end, size = at, 64
    while end + q < len(w):
        step = min(size, len(w) - q - end)
        differ = w[end:end + step] != w[end + q:end + q + step]
        if differ.any():
            end += int(differ.argmax())
            break
        end, size = end + step, size * 2
    begin, size = at, 64
    while begin > 0:
        step = min(size, begin)
        differ = (w[begin - step:begin] != w[begin + q - step:begin + q])[::-1]
        if differ.any():
            begin -= int(differ.argmax())
            break
        begin, size = begin - step, size * 2
    return begin, end + q


def _synchronising(ids: np.ndarray, periodic: np.ndarray, t: int) -> np.ndarray:
    """Places of the synchronising set; ``ids`` are the hashes of t words each."""
    ids = np.where(periodic, _LAST, ids)
    least = sliding(ids, t + 1)
    n = len(least)
    return np.flatnonzero((least != _LAST) & ((least == ids[:n]) | (least == ids[t:t + n])))


def _proposed(places: np.ndarray, contexts: np.ndarray, t: int) -> np.ndarray:
    """Distinct (period, place), sorted, of equal contexts 2t to 4t apart."""
    order = np.argsort(contexts, kind="stable")
    places, contexts = places[order], contexts[order]
    out = [np.zeros((0, 2), np.int64)]
    for lag in range(1, 13):
        far = places[lag:] - places[:-lag]
        near = (contexts[lag:] == contexts[:-lag]) & (far < 4 * t)
        if not near.any():
            break
        good = np.flatnonzero(near & (far >= 2 * t))
        out.append(np.stack([far[good], places[good]], axis=1))
    return np.unique(np.concatenate(out), axis=0)


def runs_of(w: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """(begin, end, period) of all runs of some texts, sorted by begin and period.

    ``w`` holds the word hashes of the texts, after each text a value that occurs
    nowhere else; ``sizes`` are the texts' numbers of words.
    """
    regions = [_small_periods(w)]
    t, place, own = SMALL // 2, np.arange(len(w)), np.repeat(sizes, sizes + 1)
    hashes = w
    for width in (1, 2):
        hashes = _doubled(hashes, width)
    while len(w) and 2 * t * TIMES <= sizes.max(initial=0):
        if not (stay := own >= 2 * t * TIMES).all():
            # Texts too short for this scale are left out. The hashes next to them no
            # longer tell what follows, but hold the value that ends their own text.
            w, place, own, hashes = w[stay], place[stay], own[stay], hashes[stay]
        known = np.concatenate(regions)
        known = known[(known[:, 2] * 3 <= t) & (known[:, 1] - known[:, 0] >= t)]
        mark = np.zeros(len(w) + 1, np.int32)
        begin = np.searchsorted(place, known[:, 0])
        inside = begin < len(place)
        inside[inside] = place[begin[inside]] == known[inside, 0]
        begin, long = begin[inside], (known[:, 1] - known[:, 0])[inside]
        np.add.at(mark, begin, 1)
        np.add.at(mark, begin + long - t + 1, -1)
        places = _synchronising(hashes, np.cumsum(mark[:-1]) > 0, t)
        contexts = _doubled(hashes, t)
        found, past = [], (0, 0)
        for q, at in _proposed(places, contexts[places], t).tolist():
            if past[0] == q and at < past[1] - q:
                continue
            begin_at, end_at = _extended(w, at, q)
            past = (q, end_at)
            if end_at - begin_at >= max(LEAST, TIMES * q):
                found.append((int(place[begin_at]), int(place[begin_at]) + end_at - begin_at, q))
        regions.append(np.array(found, np.int64).reshape(-1, 3))
        hashes, t = contexts, 2 * t
    every = np.concatenate(regions)
    every = every[every[:, 1] - every[:, 0] >= np.maximum(LEAST, TIMES * every[:, 2])]
    every = every[np.lexsort((every[:, 2], every[:, 1], every[:, 0]))]
    first = np.append(True, (every[1:, :2] != every[:-1, :2]).any(axis=1))[:len(every)]
    every = every[first]
    return every[np.lexsort((every[:, 2], every[:, 0]))]


def _doubled(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of 2 * width words out of those of ``width``; the last ones are cut short."""
    follows = np.concatenate([hashes[width:], np.zeros(min(width, len(hashes)), np.uint64)])
    return mix(hashes * np.uint64(3) + mix(follows + STEP))


def altered(ids: list, bounds: np.ndarray) -> np.ndarray:
    """The number of the original word at each place, a tenth of the texts being altered.

    Fixed rule, with h the CRC-32 of the decimal doc_id and g = h // 10: where
    h % 10 is 0, word i >= a is word a + (i - a) % p, a being g % n and p being
    1 + (n - a) // (3 + g % 8).
    """
    source = np.arange(bounds[-1])
    for doc_id, low, high in zip(ids, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if doc_id is None or low == high:
            continue
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            n, g = high - low, h // 10
            a = g % n
            source[low + a:high] = low + a + np.arange(n - a) % (1 + (n - a) // (3 + g % 8))
    return source


_SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()),
    ("period", pa.int64()), ("exponent_milli", pa.int64()), ("runs_sha256", pa.string()),
    ("collapsed_sha256", pa.string()),
    ("runs", pa.list_(pa.struct([(k, pa.int64()) for k in ("start", "length", "period")])))])


def _slab_runs(ids: list, data: np.ndarray, lengths: np.ndarray, change: bool, with_runs: bool):
    words = Words(data, lengths, lowered=AS_IS)
    bounds, sizes = words.bounds, words.counts
    source = altered(ids, bounds) if change else np.arange(bounds[-1])
    n, rows = len(source), len(lengths)
    w = np.empty(n + rows, np.uint64)
    at = np.arange(n) + words.doc
    w[at] = words.hashes()[source]
    ends = bounds[1:] + np.arange(rows)
    w[ends] = mix(mix(np.arange(rows, dtype=np.uint64) + STEP) ^ np.uint64(0x5851F42D4C957F2D))
    found = runs_of(w, sizes)
    owner = np.searchsorted(ends, found[:, 0], side="right")
    begin = bounds[:-1] + np.arange(rows)
    dropped = np.zeros(n + rows + 1, np.int64)
    np.add.at(dropped, found[:, 0] + found[:, 2], 1)
    np.add.at(dropped, found[:, 1], -1)
    kept = np.cumsum(dropped)[at] == 0
    collapsed = joined_digests(words, source[kept], np.bincount(words.doc[kept], minlength=rows))
    cuts = np.searchsorted(owner, np.arange(rows + 1)).tolist()
    out = []
    for row, doc_id in enumerate(ids):
        runs = [(a - int(begin[row]), b - a, q) for a, b, q in found[cuts[row]:cuts[row + 1]].tolist()]
        best = None
        for run in runs:
            if best is None or run[1] * best[2] > best[1] * run[2]:
                best = run
        told = "".join(f"{a},{size},{q}\n" for a, size, q in runs)
        out.append({
            "doc_id": doc_id, "n_runs": len(runs),
            "start": best and best[0], "length": best and best[1], "period": best and best[2],
            "exponent_milli": best and 1000 * best[1] // best[2],
            "runs_sha256": hashlib.sha256(told.encode()).hexdigest(),
            "collapsed_sha256": collapsed[row],
            "runs": [dict(zip(("start", "length", "period"), r, strict=True)) for r in runs]
            if with_runs else None})
    return pa.RecordBatch.from_pylist(out, schema=_SCHEMA)


def periodic_runs(docs: DataFrame, change: bool = False, with_runs: bool = True) -> DataFrame:
    """What the module docstring says, for every row of ``docs``.

    (doc_id, n_runs; start, length, period and exponent_milli of the run with the
    greatest exponent, of equal ones that with the least start, then period;
    digests of all runs and of the words left once every run is cut to its first
    period; the runs). ``change`` makes a tenth of the texts periodic beforehand.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for first, last, data, lengths in slabs(batch.column(1)):
                yield _slab_runs(ids[first:last], data, lengths, change, with_runs)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
        "runs_sha256 string, collapsed_sha256 string, "
        "runs array<struct<start:long,length:long,period:long>>")


def query(docs: DataFrame) -> DataFrame:
    return periodic_runs(docs, change=True, with_runs=False).drop("runs")
