"""Long repeated byte strings, by run-length compressed Burrows-Wheeler indexes.

Every string of ``length`` bytes has an anchor, told by its content alone: the
least hash of a piece of GRAM bytes in it. Equal strings have equal anchors, so
the strings of one anchor can be judged without the rest of the corpus. Strings
in a row that have one anchor form a context.

Contexts that occur twice or more as a whole are told by counting their hashes.
Of the string that two others share around an anchor, one side is half of what the
anchor leaves; a context stays only if another one has the same anchor and the same
bytes next to it, as many as that, on the left or on the right. (Contexts within
which a string may occur twice all stay.) Those go to shards by anchor. A shard's index
is the Burrows-Wheeler transform of its contexts, kept as runs with the suffix
positions at the run ends. Two neighbouring suffixes in one run have the match
of their predecessors, one byte shorter; so the matches at the run ends, laid
over the text, give the longest match at every place.

Null and empty texts have no bytes. Repeated rows are places like any others.
Rows that share doc_id and text get the same result. An empty table has no rows. A
text is cut into contexts whole, in memory in proportion to it. Extra columns are ignored.
Anchors and contexts are told apart by 64-bit hashes each.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from reviewloom.llm.textnum import STEP, mix, slabs
from reviewloom.session import staged

GRAM = 32
#: Contexts of one anchor that are indexed together; beyond, they are dealt once more,
#: by a second anchor, and beyond that strings are counted one by one, which spreads
#: over all tasks.
TOGETHER = 2_000
#: Bytes of contexts in one index, but for an anchor's contexts, which stay together.
SHARD = 1 << 20
_SLAB = 2 << 20


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each place on; ``data`` is padded here."""
    padded = np.concatenate([data, np.zeros(GRAM, np.uint8)]).astype(np.uint64)
    v = padded
    for width in (1, 2, 4):
        v = v[:-width] | (v[width:] << np.uint64(8 * width))
    out = np.zeros(len(data), np.uint64)
    for i in range(GRAM // 8):
        out = mix(out + v[8 * i:8 * i + len(data)] + STEP)
    return out


def sliding(keys: np.ndarray, width: int, pick: np.ufunc = np.minimum) -> np.ndarray:
    """The least (or greatest) of ``width`` keys from each place on, while there are as many."""
    n = len(keys) - width + 1
    if n <= 0:
        return keys[:0]
    blocks = -(-len(keys) // width)
    filled = np.full(blocks * width, keys[-1], np.uint64)
    filled[:len(keys)] = keys
    rows = filled.reshape(blocks, width)
    ahead = pick.accumulate(rows, axis=1).ravel()
    behind = pick.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return pick(behind[:n], ahead[width - 1:width - 1 + n])


def contexts_of(data: np.ndarray, lengths: np.ndarray, length: int):
    """(row, start, strings, twice, anchor, context, left, right) of a slab's contexts.

    A context begins at byte ``start`` and holds ``strings`` strings in a row of
    one anchor. ``twice`` tells that a string may occur twice within it, as in a
    text that repeats a few words; such a text is cut into contexts anywhere.
    ``left`` and ``right`` stand for the anchor and the bytes next to it, half of
    what it leaves of a string, or are 0 where the context doesn't reach so far.
    """
    grams = length - GRAM + 1
    if len(data) < length:
        none = np.zeros(0, np.int64)
        return none, none, none, none > 0, none, none, none, none
    hashes = gram_hashes(data)[:len(data) - GRAM + 1]
    least = sliding(hashes, grams)
    # A place holds an anchor if its hash is the least of some string.
    around = np.concatenate([np.zeros(grams - 1, np.uint64), least, np.zeros(grams - 1, np.uint64)])
    chosen = np.flatnonzero(sliding(around, grams, np.maximum) == hashes)
    pair = np.flatnonzero((hashes[chosen][1:] == hashes[chosen][:-1]) & (np.diff(chosen) < grams))
    left, right = chosen[pair], chosen[pair + 1]
    begin = np.cumsum(lengths) - lengths
    counts = np.maximum(lengths - length + 1, 0)
    row = np.repeat(np.arange(len(lengths)), counts)
    start = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts) + begin[row]
    own = least[start]
    change = np.append(True, (own[1:] != own[:-1]) | (row[1:] != row[:-1]))[:len(start)]
    first = np.flatnonzero(change)
    sizes = np.diff(np.append(first, len(start)))
    # What is longer than one anchor's reach is cut.
    pieces = -(-sizes // grams)
    nth = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    strings = np.minimum(np.repeat(sizes, pieces) - nth * grams, grams)
    first = np.repeat(first, pieces) + nth * grams
    row, start, own = row[first], start[first], own[first]
    end = start + strings + length - 1
    at = np.searchsorted(left, start)
    near = np.append(right, len(data))[at] <= end - GRAM
    whole = strings.astype(np.uint64) * STEP
    for i in range(-(-(2 * length) // GRAM)):
        whole = mix(whole + hashes[np.minimum(start + GRAM * i, end - GRAM)] + STEP)
    # The anchor's place: the first of its hash that the context's last string holds.
    kinds, kind = np.unique(hashes[chosen], return_inverse=True)
    size = len(data) + 1
    places = np.sort(kind * size + chosen)
    found = np.searchsorted(places, np.searchsorted(kinds, own) * size + start + strings - 1)
    anchor = places[np.minimum(found, max(len(places) - 1, 0))] % size
    half = (length - GRAM + 1) // 2
    sides = []
    for first, inside, salt in ((anchor - half, anchor - half >= start, 1),
                                (anchor + GRAM, anchor + GRAM + half <= end, 2)):
        value = mix(own + np.uint64(salt))
        for i in range(-(-half // GRAM)):
            value = mix(value + hashes[np.clip(first + min(GRAM * i, half - GRAM), 0, len(hashes) - 1)] + STEP)
        sides.append(np.where(inside & ~near, value, np.uint64(0)).view(np.int64))
    return (row, start - begin[row], strings, near, own.view(np.int64), whole.view(np.int64), *sides)


def _contexts(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = [batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)]
        for first, last, data, lengths in slabs(batch.column(2), _SLAB):
            row, start, strings, twice, anchor, context, left, right = contexts_of(data, lengths, length)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[0][first:last][row]), pa.array(ids[1][first:last][row]),
                 pa.array(start.astype(np.int32)), pa.array(strings.astype(np.int32)), pa.array(twice),
                 pa.array(anchor), pa.array(context), pa.array(left), pa.array(right)],
                names=["_id", "_th", "start", "strings", "twice", "anchor", "context", "left", "right"])


class RunLengthIndex:
    """The run-compressed Burrows-Wheeler transform of some strings.

    ``heads`` and ``tails`` sample the suffix positions on both sides of every
    run border, ``common`` what these two suffixes have in common. Nothing of
    the transform but its runs is kept.
    """

    def __init__(self, strings: list[bytes]):
        sizes = np.array([len(s) for s in strings], dtype=np.int64)
        text = np.zeros(int(sizes.sum()) + len(strings), np.uint16)
        self.begin = np.cumsum(sizes + 1) - sizes - 1
        inside = np.ones(len(text), bool)
        inside[self.begin + sizes] = False
        text[inside] = np.frombuffer(b"".join(strings), np.uint8).astype(np.uint16) + 1
        left = np.repeat(self.begin + sizes, sizes + 1) - np.arange(len(text))
        order, ranks, steps = self._sorted(text, left)
        before = text[order - 1]  # the end sign for the first place of each string
        before[order == 0] = 0
        border = np.append(True, (before[1:] != before[:-1]) | (before[1:] == 0))
        at = np.flatnonzero(border[1:]) + 1
        self.letters = before[np.flatnonzero(border)]
        self.lengths = np.diff(np.append(np.flatnonzero(border), len(text)))
        self.heads, self.tails = order[at], order[at - 1]
        self.common = self._matched(text, left, ranks, steps)

    @staticmethod
    def _sorted(text: np.ndarray, left: np.ndarray):
        """Suffix order by doubling; no suffix reaches beyond its string's end.

        Equal suffixes of different strings go by place, as if each string had
        an end sign of its own.
        """
        n = len(text)
        longest = int(left.max(initial=0)) + 1
        padded = np.concatenate([text, np.zeros(6, np.uint16)]).astype(np.uint64)
        key = np.zeros(n, np.uint64)
        alive = np.ones(n, bool)
        for i in range(7):
            key = (key << np.uint64(9)) | np.where(alive, padded[i:i + n], 0).astype(np.uint64)
            alive &= left > i
        _, rank = np.unique(key, return_inverse=True)
        rank = rank.astype(np.int64) + 1
        ranks, steps, width = [rank.astype(np.int32)], [7], 7
        while width < longest:
            follows = np.zeros(n, np.int64)
            more = left >= width
            follows[more] = rank[np.flatnonzero(more) + width]
            _, rank = np.unique(rank * (n + 2) + follows, return_inverse=True)
            rank = rank.astype(np.int64) + 1
            width *= 2
            ranks.append(rank.astype(np.int32))
            steps.append(width)
        return np.argsort(rank, kind="stable"), ranks, steps

    def _matched(self, text, left, ranks, steps) -> np.ndarray:
        a, b = self.heads.copy(), self.tails.copy()
        most = np.minimum(left[a], left[b])
        out = np.zeros(len(a), np.int64)
        for rank, width in list(zip(ranks, steps, strict=True))[::-1]:
            # Widths double, so a width may fit twice at the top and once below.
            same = (out < most) & (rank[np.minimum(a, len(text) - 1)] == rank[np.minimum(b, len(text) - 1)])
            a, b, out = a + width * same, b + width * same, out + width * same
        out = np.minimum(out, most)
        for _ in range(6):
            a, b = self.heads + out, self.tails + out
            out += (out < most) & (text[np.minimum(a, len(text) - 1)] == text[np.minimum(b, len(text) - 1)])
        return out

    def long_matches(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(start, stop) in the joined strings: all that lies in matches this long."""
        long_ones = self.common >= length
        start = np.concatenate([self.heads[long_ones], self.tails[long_ones]])
        stop = start + np.tile(self.common[long_ones], 2)
        order = np.argsort(start, kind="stable")
        return start[order], stop[order]


def covered(start: np.ndarray, stop: np.ndarray) -> list[tuple[int, int]]:
    """The union of intervals sorted by start."""
    out: list[list[int]] = []
    for a, b in zip(start.tolist(), stop.tolist(), strict=True):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def _groups(sorted_values: np.ndarray) -> tuple[list, list, list]:
    """(value, first, end) of each run of equal values."""
    first = np.flatnonzero(np.append(True, sorted_values[1:] != sorted_values[:-1]))[:len(sorted_values)]
    ends = np.append(first[1:], len(sorted_values))[:len(first)]
    return sorted_values[first].tolist(), first.tolist(), ends.tolist()


_SPANS = "_id long, _th int, start int, stop int"


def _spans(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [(), (), (), ()]
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32())
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
        names=["_id", "_th", "start", "stop"])


def _index(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Repeated spans within contexts that occur once; rows come sorted by anchor."""
    def done(held):
        index = RunLengthIndex([r[4] for r in held])
        start, stop = index.long_matches(length)
        owner = np.searchsorted(index.begin, start, side="right") - 1
        out = []
        for i, first, last in zip(*_groups(owner), strict=True):
            _, _id, _th, at, _, once = held[i]
            if once:
                base = index.begin[i]
                out += [(_id, _th, at + a, at + b)
                        for a, b in covered(start[first:last] - base, stop[first:last] - base)]
        return _spans(out)

    held, size = [], 0
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if size >= SHARD and row[0] != held[-1][0]:
                yield done(held)
                held, size = [], 0
            held.append(row)
            size += len(row[4])
    if held:
        yield done(held)


def _string_hashes(data: np.ndarray, h: np.ndarray, length: int) -> np.ndarray:
    """A hash of each string of some bytes; ``h`` are the hashes of their grams."""
    n = len(data) - length + 1
    whole = np.zeros(n, np.uint64)
    for i in range(-(-length // GRAM)):
        off = min(GRAM * i, length - GRAM)
        whole = mix(whole + h[off:off + n] + STEP)
    return whole


def _second(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Contexts cut where the second least hash of their strings changes.

    With the first anchor that one makes an anchor of its own; ``part`` is a hash of
    the piece, and ``twice`` tells that a string occurs twice in it.
    """
    grams = length - GRAM + 1
    last = np.uint64((1 << 64) - 1)
    for batch in batches:
        out = []
        for anchor, _id, _th, at, context, once in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            data = np.frombuffer(context, np.uint8)
            hashes = gram_hashes(data)
            h = hashes[:len(data) - GRAM + 1]
            own = np.int64(anchor).astype(np.uint64)
            least = sliding(np.where(h == own, last, h), grams)
            whole = _string_hashes(data, hashes, length)
            first = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
            for a, b in zip(first.tolist(), np.append(first[1:], len(least)).tolist(), strict=True):
                strings = whole[a:b]
                part = mix(np.array([strings[0] ^ (strings[-1] >> np.uint64(1))]) + np.uint64(b - a))
                out.append((int(mix(least[a:a + 1] + own).view(np.int64)[0]), int(part.view(np.int64)[0]),
                            _id, _th, at + a, context[a:b + length - 1], once,
                            len(np.unique(strings)) < b - a))
        columns = list(zip(*out, strict=True)) if out else [()] * 8
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.bool_(), pa.bool_())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
            names=["anchor", "part", "_id", "_th", "start", "context", "once", "twice"])


def _strings(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Every string of the contexts of very frequent anchors, by its hash."""
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            anchor, _id, _th, at, context, once = row
            data = np.frombuffer(context, np.uint8)
            whole = _string_hashes(data, gram_hashes(data), length)
            n = len(whole)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, anchor)), pa.array(whole.view(np.int64)),
                 pa.array(np.full(n, _id)), pa.array(np.full(n, _th, np.int32)),
                 pa.array((at + np.arange(n)).astype(np.int32)), pa.array(np.full(n, once))],
                names=["anchor", "string", "_id", "_th", "start", "once"])


def _keyed(docs: DataFrame) -> DataFrame:
    """The texts as bytes with keys of few bytes: doc_id, and half a hash of the text.

    In place of a null doc_id stands another hash of the text.
    """
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        "doc_id", F.coalesce("doc_id", F.xxhash64(F.lit("none"), text)).alias("_id"),
        F.xxhash64(text).bitwiseAND(F.lit((1 << 31) - 1)).cast("int").alias("_th"),
        text.cast("binary").alias("text"))


def _with_a_like_side(contexts: DataFrame) -> DataFrame:
    """The contexts that may share a string with another one, or hold one twice.

    A side's hash stands for its anchor as well. Most contexts have no side in
    common with any; narrow rows tell that.
    """
    sides = contexts.where("NOT twice").select(
        "anchor", "context", F.explode(F.array("left", "right")).alias("side")).where("side <> 0")
    # As a text that repeats itself is cut anywhere, its sides are no sides.
    beside = contexts.where("twice").select("anchor").distinct()
    like = sides.groupBy("side").agg(F.count("*").alias("_n")).where("_n > 1").select("side")
    found = sides.join(like, "side").select("anchor", "context").unionAll(
        contexts.join(beside, "anchor", "left_semi").select("anchor", "context"))
    return contexts.join(found.distinct(), ["anchor", "context"], "left_semi").drop("left", "right")


def _dealt_again(heavy: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """(spans of pieces that occur twice as a whole, the other pieces with their variants).

    Equal strings have equal second anchors as well, so what holds of contexts and
    anchors holds of the pieces between the second ones.
    """
    pieces = staged(heavy.mapInArrow(
        lambda batches: _second(batches, length),
        "anchor long, part long, _id long, _th int, start int, context binary, once boolean, twice boolean"))
    kinds = staged(pieces.groupBy("anchor", "part").agg(
        F.count("*").alias("n"), F.max("twice").alias("twice"),
        F.min(F.struct("_id", "_th", "start", "context", "once")).alias("at")))
    whole = pieces.where("once").join(
        kinds.where("n > 1").select("anchor", "part"), ["anchor", "part"]).select(
            "_id", "_th", "start", (F.col("start") + F.octet_length("context")).alias("stop"))
    variants = (
        kinds.groupBy("anchor").agg(F.count("*").alias("variants"), F.max("twice").alias("_twice"))
        .where("variants > 1 OR _twice").select("anchor", "variants"))
    others = kinds.join(variants, "anchor").select(
        "anchor", "at._id", "at._th", "at.start", "at.context",
        (F.col("at.once") & (F.col("n") == 1)).alias("once"), "variants")
    return whole, staged(others)


def repeated_spans(docs: DataFrame, length: int = 200, together: int = TOGETHER) -> DataFrame:
    """(_id, _th, start, stop): bytes in strings of ``length`` that start elsewhere too.

    Spans may overlap. ``length`` is at least 2 * GRAM.
    """
    keyed = _keyed(docs).drop("doc_id")
    places = keyed.where(F.octet_length("text") >= length).mapInArrow(
        lambda batches: _contexts(batches, length),
        "_id long, _th int, start int, strings int, twice boolean, anchor long, context long, "
        "left long, right long")
    # One number for each anchor and task reaches the shuffle. Written tables on
    # both sides let adaptive execution split the join of a hot anchor.
    shared = staged(
        places.groupBy("anchor").agg(F.count("*").alias("_n"), F.max("twice").alias("_twice"))
        .where("_n > 1 OR _twice").select("anchor"))
    places = staged(places.join(shared, "anchor"))
    contexts = staged(places.groupBy("anchor", "context").agg(
        F.count("*").alias("n"), F.max("twice").alias("twice"),
        F.max("left").alias("left"), F.max("right").alias("right"),
        F.min(F.struct("_id", "_th", "start", "strings")).alias("at")))
    near = staged(_with_a_like_side(contexts))
    variants = staged(near.groupBy("anchor").agg(F.count("*").alias("variants")))
    wanted = near.join(variants, "anchor")
    whole = (
        places.join(contexts.where("n > 1").select("anchor", "context"), ["anchor", "context"])
        .select("_id", "_th", "start", (F.col("start") + F.col("strings") + (length - 1)).alias("stop"))
        .distinct())
    # The text of one context of each kind, cut out of its document.
    single = (
        wanted.select("at._id", "at._th", F.struct(
            "anchor", "variants", F.col("at.start").alias("start"),
            F.col("at.strings").alias("strings"), (F.col("n") == 1).alias("once")).alias("_c"))
        .groupBy("_id", "_th").agg(F.collect_list("_c").alias("_cs")))
    cut = (
        keyed.join(single, ["_id", "_th"]).dropDuplicates(["_id", "_th"])
        .select("_id", "_th", F.explode(F.transform("_cs", lambda c: F.struct(
            c["anchor"].alias("anchor"), c["variants"].alias("variants"), c["start"].alias("start"),
            c["once"].alias("once"),
            F.substring(F.col("text"), (c["start"] + 1).cast("int"),
                        (c["strings"] + (length - 1)).cast("int")).alias("context")))).alias("_c"))
        .select("_c.anchor", "_id", "_th", "_c.start", "_c.context", "_c.once", "_c.variants"))
    cut = staged(cut)
    pieces, dealt = _dealt_again(cut.where(F.col("variants") > together).drop("variants"), length)
    indexed = cut.where(F.col("variants") <= together).unionByName(dealt.where(F.col("variants") <= together))
    few = (
        indexed.drop("variants").repartition("anchor").sortWithinPartitions("anchor")
        .mapInArrow(lambda batches: _index(batches, length), _SPANS))
    strings = dealt.where(F.col("variants") > together).drop("variants").mapInArrow(
        lambda batches: _strings(batches, length),
        "anchor long, string long, _id long, _th int, start int, once boolean")
    twice = strings.groupBy("anchor", "string").agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")
    many = strings.where("once").join(twice, ["anchor", "string"]).select(
        "_id", "_th", "start", (F.col("start") + length).cast("int").alias("stop"))
    return whole.unionByName(few).unionByName(many).unionByName(pieces)


def _cut_out(batches: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for doc_id, text, spans in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            spans = sorted((s["start"], s["stop"]) for s in spans or [])
            union = covered(*np.array(spans, np.int64).reshape(-1, 2).T)
            kept, at = [], 0
            for a, b in union:
                kept.append(text[at:a])
                at = b
            kept.append(text[at:])
            rest = b"".join(kept)
            out.append((doc_id, len(text), len(text) - len(rest), len(union),
                        hashlib.sha256(rest).hexdigest(), rest if with_text else None))
        columns = list(zip(*out, strict=True)) if out else [()] * 6
        kinds = (pa.int64(),) * 4 + (pa.string(), pa.binary())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def remove_repeats(docs: DataFrame, length: int = 200, with_text: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) of every row.

    ``kept`` holds the bytes that remain, or null without ``with_text``; a cut
    may fall within a character.
    """
    spans = repeated_spans(docs, length).groupBy("_id", "_th").agg(
        F.collect_list(F.struct("start", "stop")).alias("_spans"))
    return _keyed(docs).join(spans, ["_id", "_th"], "left").select("doc_id", "text", "_spans").mapInArrow(
        lambda batches: _cut_out(batches, with_text),
        "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def query(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs, with_text=False).drop("kept")
