"""Documents linked by the Jaccard similarity of their shingles, by PartEnum.

Sets are put into bands of size. Within a band the feature domain is dealt by hash
to parts, and each part to three pieces. Linked sets differ in k features at most,
so of k // 2 + 1 parts one holds at most one feature in which they differ, and two of
its pieces are the same: the hash of any two pieces of a part is a signature.

A set signs in a few parts more than that, ``spare`` ones, and leaves out pairs of
pieces that are empty, which all kinds of sets have in common. Where two linked
sets have only such a pair in common in a part, the part is weak, with an empty
pair, in both. If either of them has no more weak parts than spare ones, another
part is left that they share. Sets with more weak parts sign in one more way, by
the least k + 1 hashes of smaller parts that are whole: two sets that miss at most k
of each other's parts have one of these in common.

Signatures are far more often shared than sets are linked. So each set has a sketch
too, a bit for each bucket of features that tells whether their number is odd: two
sketches differ in no more bits than the sets in features, and pairs for which that
is too many are left out before a text is compared.

Null and empty texts have no set and are linked with nothing. Rows that share
a doc_id count as one document. A null doc_id is never a component's id unless
all its documents have none. An empty table has no rows. A text is taken whole, in
memory in proportion to it. Equal sets are one class, named by its least doc_id. Extra
columns are ignored.
"""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from reviewloom.llm.common import BLANKS, marked, text_hash
from reviewloom.llm.components import components
from reviewloom.llm.textnum import SLAB, STEP, Words, mix, shingles, slabs
from reviewloom.session import staged


ALL = (1 << 64) - 1
#: First bits by which signatures are sorted out ahead of a shuffle, as a bitmap: 32 MB.
SIGN_BITS = 28
#: Signatures are counted by their first bits, ``BUCKET_BITS`` that name a bucket and three bytes.
BUCKET_BITS = 12
#: So many signatures of a task are packed together.
PACKED = 1 << 22
#: Signatures of as many sets at most are resolved into pairs, others into stars.
PAIRED = 64
#: Numbers below this stand for classes in which no row has a doc_id.
NO_ID_BELOW = -(1 << 62)


class PartEnum:
    """Signatures for a Jaccard similarity of ``percent`` / 100 or more.

    A band holds the sizes from one edge up to the next, ``growth`` times as
    large. A set that may be linked with one of the band below signs there too.
    """

    def __init__(self, percent: int, growth: float = 1.5):
        self.percent, self.growth = percent, max(growth, 100 / percent + 0.01)
        self._parts: dict[tuple[int, int], tuple[int, int]] = {}

    def edges(self, largest: int) -> list[int]:
        out = [1]
        while out[-1] <= largest:
            out.append(max(out[-1] + 1, int(np.ceil(out[-1] * self.growth))))
        return out

    def differing(self, a, b):
        """Features in which linked sets of sizes ``a`` and ``b`` differ at most."""
        return (a + b) * (100 - self.percent) // (100 + self.percent)

    def parts(self, low: int, high: int) -> tuple[int, int]:
        """(parts, spare ones) of the band of sizes from ``low`` up to ``high``.

        As many are spare as most sets of a middle size have weak ones, a fifth at most.
        """
        if (low, high) not in self._parts:
            needed = self.differing(high - 1, (high - 1) * 100 // self.percent) // 2 + 1
            middle, spare = (low + high) // 2, 0
            while spare < needed // 4:
                parts = needed + spare
                weak = 3 * parts * math.exp(-2 * middle / (3 * parts))
                if weak + math.sqrt(weak) <= spare:
                    break
                spare += 1
            self._parts[low, high] = needed + spare, spare
        return self._parts[low, high]

    def sign(self, rows: np.ndarray, values: np.ndarray, sizes: np.ndarray):
        """(row, signature) for sorted distinct features of rows of these sizes."""
        out_rows, out_signs = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        edges = self.edges(int(sizes.max(initial=0)))
        band = np.searchsorted(edges, sizes, side="right") - 1
        # The largest partner of a set decides how far the two may differ.
        own_reach = self.differing(sizes, sizes * 100 // self.percent)
        for b in range(len(edges) - 1):
            low, high = edges[b], edges[b + 1]
            above = (band == b + 1) & (sizes * self.percent <= (high - 1) * 100)
            reach = np.where(band == b, own_reach, np.where(above, self.differing(sizes, high - 1), 0))
            chosen = (reach > 0)[rows]  # without reach only equal sets are linked
            if not chosen.any():
                continue
            row, value = rows[chosen], values[chosen]
            parts, spare = self.parts(low, high)
            signed = np.where(reach > 0, reach // 2 + 1 + spare, 0)
            part = (value >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
            within = part < signed[row].astype(np.uint64)
            row, value, part = row[within], value[within], part[within]
            if not len(row):
                continue
            first = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (part[1:] != part[:-1])))
            piece = (value & np.uint64(0xFFFFFFFF)) * np.uint64(3) >> np.uint64(32)
            spread = mix(value)
            held = [np.add.reduceat(np.where(piece == np.uint64(j), spread, np.uint64(0)), first)
                    for j in range(3)]
            row, part = row[first], part[first]
            tag = np.uint64((b + 1) * int(STEP) & ALL)
            filled = [h != 0 for h in held]
            for number, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
                some = filled[i] | filled[j]
                place = mix(part[some] * np.uint64(3) + np.uint64(number) + tag)
                out_rows.append(row[some])
                out_signs.append(mix(mix(held[i][some] + place) + held[j][some]))
            strong = np.bincount(row[(filled[0].astype(np.int8) + filled[1] + filled[2]) > 1],
                                 minlength=len(sizes))
            weak = (signed > 0) & (signed - strong > spare)
            if weak.any():
                rows_of_weak = weak[rows]
                self._whole_parts(rows[rows_of_weak], values[rows_of_weak], reach, high,
                                  mix(np.array([tag])), out_rows, out_signs)
        return np.concatenate(out_rows), np.concatenate(out_signs)

    def _whole_parts(self, row, value, reach, high, tag, out_rows, out_signs):
        """Signatures of sets with many weak parts: the least ``reach`` + 1 hashes of whole parts.

        What two sets miss of each other's lies in ``reach`` parts at most.
        """
        largest = high - 1
        parts = max(int(1.3 * self.differing(largest, largest * 100 // self.percent)) + 3, 16)
        part = (value >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
        first = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (part[1:] != part[:-1])))
        held = mix(np.add.reduceat(mix(value), first) + mix(part[first] + tag))
        row = row[first]
        order = np.lexsort((held, row))
        filled = np.bincount(row, minlength=len(reach))
        rank = np.arange(len(row)) - np.repeat(np.cumsum(filled) - filled, filled)
        kept = order[rank <= reach[row]]
        # Sets with so few parts may have none of them in common.
        few = np.flatnonzero((filled > 0) & (filled <= reach))
        out_rows += [row[kept], few]
        out_signs += [held[kept], np.full(len(few), mix(tag)[0])]


def _texts(batches: Iterator[pa.RecordBatch], size: int):
    """(part of a batch, row, shingle, number of shingles by row) over slabs."""
    for batch in batches:
        for first, last, data, lengths in slabs(batch.column(batch.schema.get_field_index("text"))):
            rows, values = shingles(Words(data, lengths), size)
            yield batch.slice(first, last - first), rows, values, np.bincount(rows, minlength=last - first)


def sketch(values: np.ndarray) -> bytes:
    """Two to four bits for each feature; a bit says whether its bucket has an odd number."""
    bits = 1 << max(3, int(2 * len(values) - 1).bit_length())
    bucket = (mix(values) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(bucket, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def may_be_linked(n: int, m: int, left: bytes, right: bytes, percent: int) -> bool:
    """Whether the sketches of sets of sizes ``n`` and ``m`` leave it open that they are linked.

    The larger sketch is folded: bits of buckets that are one in the smaller are added.
    """
    if min(n, m) * 100 < max(n, m) * percent:
        return False
    if len(left) > len(right):
        left, right = right, left
    bits = 8 * len(left)
    own, other, mask = int.from_bytes(left, "little"), int.from_bytes(right, "little"), (1 << bits) - 1
    while other:
        own ^= other & mask
        other >>= bits
    return own.bit_count() * (100 + percent) <= (n + m) * (100 - percent)


def _may_be_linked(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """(a, b) of the rows (a, b, n, m, left, right) that may be linked."""
    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(2, 6)]
        yield batch.select(["a", "b"]).filter(
            pa.array([may_be_linked(*row, percent) for row in zip(*columns, strict=True)], pa.bool_()))


def _sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The keys of each row, the size of its set, two hashes of the whole set and its sketch."""
    for part, _, values, n in _texts(batches, size):
        prints = []
        begin = np.append(0, np.cumsum(n))
        sketches = [sketch(values[a:b]) for a, b in zip(begin[:-1], begin[1:], strict=True)]
        for salt in (1, 2):
            bits = mix(values + np.uint64(salt * int(STEP) & ALL))
            sums = np.append(np.uint64(0), np.cumsum(bits, dtype=np.uint64))
            prints.append(mix(sums[begin[1:]] - sums[begin[:-1]]).view(np.int64))
        yield pa.RecordBatch.from_arrays(
            [part.column(part.schema.get_field_index(c)) for c in ("doc_id", "_id", "_th")]
            + [pa.array(n.astype(np.int64)), pa.array(prints[0]), pa.array(prints[1]),
               pa.array(sketches, pa.binary())],
            names=["doc_id", "_id", "_th", "n", "f1", "f2", "sketch"])


def _signs(
    batches: Iterator[pa.RecordBatch], size: int, percent: int, held: Broadcast,
) -> Iterator[pa.RecordBatch]:
    """(sign, _id) of the signatures whose bit is set in ``held``."""
    enum = PartEnum(percent)
    for part, rows, values, n in _texts(batches, size):
        row, sign = enum.sign(rows, values, n)
        place = (sign >> np.uint64(64 - SIGN_BITS)).astype(np.int64)
        some = (held.value[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
        row, sign = row[some], sign[some]
        ids = part.column(part.schema.get_field_index("_id"))
        yield pa.RecordBatch.from_arrays(
            [pa.array(sign.view(np.int64)), ids.take(pa.array(row))], names=["sign", "_id"])


def _packed_signs(batches: Iterator[pa.RecordBatch], size: int, percent: int) -> Iterator[pa.RecordBatch]:
    """(bucket, prints): three bytes for each signature, one row for each bucket of those at hand.

    Of equal ones two are kept: more don't tell more.
    """
    enum = PartEnum(percent)

    def packed(signs):
        prints = np.sort(np.concatenate(signs) >> np.uint64(64 - BUCKET_BITS - 24))
        kept = np.ones(len(prints), bool)
        kept[2:] = prints[2:] != prints[:-2]
        prints = prints[kept]
        ends = np.searchsorted(prints, np.arange(1 << BUCKET_BITS, dtype=np.uint64) + np.uint64(1) << np.uint64(24))
        starts = np.append(0, ends[:-1])
        low = (prints & np.uint64(0xFFFFFF)).astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3]
        some = np.flatnonzero(ends > starts)
        return pa.RecordBatch.from_arrays(
            [pa.array(some.astype(np.int32)),
             pa.array([low[starts[i]:ends[i]].T.tobytes() for i in some], pa.binary())],
            names=["bucket", "prints"])

    signs, held = [], 0
    for _, rows, values, n in _texts(batches, size):
        signs.append(enum.sign(rows, values, n)[1])
        held += len(signs[-1])
        if held >= PACKED:
            yield packed(signs)
            signs, held = [], 0
    if held:
        yield packed(signs)


def _shared_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, bits): a bit for each beginning of a bucket's prints that are there twice.

    The rows (bucket, prints) come sorted by bucket.
    """
    def done(bucket, rows):
        planes = np.concatenate([np.frombuffer(x, np.uint8).reshape(3, -1) for x in rows], axis=1).astype(np.uint32)
        prints = np.sort(planes[0] | planes[1] << np.uint32(8) | planes[2] << np.uint32(16))
        twice = prints[1:][prints[1:] == prints[:-1]]
        bits = np.zeros(1 << (SIGN_BITS - BUCKET_BITS), np.uint8)
        bits[twice >> np.uint32(24 - SIGN_BITS + BUCKET_BITS)] = 1
        return pa.RecordBatch.from_arrays(
            [pa.array([bucket], pa.int32()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())],
            names=["bucket", "bits"])

    at, rows = None, []
    for batch in batches:
        for bucket, prints in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if rows and bucket != at:
                yield done(at, rows)
                rows = []
            at = bucket
            rows.append(prints)
    if rows:
        yield done(at, rows)


def _held_bits(found: DataFrame) -> Broadcast:
    """The bits (bucket, bits) of all buckets. Always of the same size.

    What they let through besides is told apart by the counts that follow.
    """
    width = 1 << (SIGN_BITS - BUCKET_BITS - 3)
    out = np.zeros(width << BUCKET_BITS, np.uint8)
    for bucket, bits in found.toLocalIterator():
        out[bucket * width:(bucket + 1) * width] = np.frombuffer(bits, np.uint8)
    return found.sparkSession.sparkContext.broadcast(out)


class _Forest:
    def __init__(self, size: int):
        self.up = list(range(size))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def links_within(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Enough links between the sorted sets to connect all that are linked.

    The members that share a feature are counted by its posting list, for one
    set after the other; nothing is kept of a pair but its count.
    """
    sizes = np.array([len(s) for s in sets])
    out, forest = [], _Forest(len(sets))
    if len(sets) == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return [(0, 1)] if 100 * both >= percent * (int(sizes.sum()) - both) and both else []
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(values, kind="stable")
    ranked, owner = values[order], owner[order]
    new = np.append(True, ranked[1:] != ranked[:-1])
    place = np.cumsum(new) - 1
    first = np.append(np.flatnonzero(new), len(ranked))
    feature = np.empty(len(values), np.int64)
    feature[order] = place
    begin = np.append(0, np.cumsum(sizes))
    for i in range(len(sets) - 1):
        own = feature[begin[i]:begin[i + 1]]
        lengths = first[own + 1] - first[own]
        own, lengths = own[lengths > 1], lengths[lengths > 1]
        if not len(own):
            continue
        at = np.arange(int(lengths.sum())) + np.repeat(first[own] - (np.cumsum(lengths) - lengths), lengths)
        both = np.bincount(owner[at], minlength=len(sets))
        linked = 100 * both >= percent * (sizes[i] + sizes - both)
        for j in np.flatnonzero(linked[i + 1:]) + i + 1:
            if forest.join(i, int(j)):
                out.append((i, int(j)))
    return out


def _link(batches: Iterator[pa.RecordBatch], size: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Links within each unit; the rows come sorted by unit."""
    def done(units, nodes, texts):
        out = []
        column = pa.array(texts, pa.large_binary())
        sets = []
        for first, last, data, lengths in slabs(column):
            rows, values = shingles(Words(data, lengths), size)
            ends = np.searchsorted(rows, np.arange(last - first + 1))
            sets += [values[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        units = np.array(units)
        cuts = np.append(np.flatnonzero(np.append(True, units[1:] != units[:-1])), len(units))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b - a > 1:
                out += [(nodes[a + i], nodes[a + j]) for i, j in links_within(sets[a:b], percent)]
        return pa.RecordBatch.from_arrays(
            [pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())],
            names=["a", "b"])

    units, nodes, texts, held = [], [], [], 0
    for batch in batches:
        for unit, node, text in zip(
                batch.column(0).to_pylist(), batch.column(1).to_pylist(),
                batch.column(2).cast(pa.large_binary()).to_pylist(), strict=True):
            if held >= SLAB and unit != units[-1]:
                yield done(units, nodes, texts)
                units, nodes, texts, held = [], [], [], 0
            units.append(unit)
            nodes.append(node)
            texts.append(text)
            held += len(text)
    if units:
        yield done(units, nodes, texts)


def _own_id() -> Column:
    """The doc_id, or a hash of the text in place of null."""
    return F.coalesce("doc_id", F.xxhash64(F.lit("none"), "text"))


def _chunks(block_rows: int, block_shingles: int):
    """Into how many parts a group is cut so that each is of bounded size."""
    return F.greatest(F.ceil(F.count("*") / block_rows), F.ceil(F.sum("n") / block_shingles))


def _blocks(clusters: DataFrame, sizes: DataFrame) -> DataFrame:
    """(unit, node): each two blocks of a cluster (node, root) together in a unit.

    ``sizes`` has the number of ``_blocks`` of each root.
    """
    own = F.pmod(F.xxhash64("node"), F.col("_blocks"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1))
    return (
        clusters.join(sizes, "root").select("node", "root", own.alias("_own"), other.alias("_other"))
        .select(F.xxhash64("root", F.least("_own", "_other"), F.greatest("_own", "_other"))
                .alias("unit"), "node"))


def _stars(candidates: DataFrame, classes: DataFrame, block_rows: int, block_shingles: int) -> DataFrame:
    """(unit, node): the nodes ``a`` of a ``b`` in parts, ``b`` itself in each part."""
    sized = candidates.join(classes.select(F.col("node").alias("a"), "n"), "a")
    parts = staged(sized.groupBy("b").agg(_chunks(block_rows, block_shingles).alias("_parts")))
    dealt = candidates.join(parts, "b").select(
        F.xxhash64(F.lit("star"), "b", F.pmod(F.xxhash64("a"), F.col("_parts"))).alias("unit"), "a", "b")
    return dealt.select("unit", F.col("a").alias("node")).unionAll(
        dealt.select("unit", F.col("b").alias("node")).distinct())


def _allowed(pairs: DataFrame, named: DataFrame, percent: int) -> DataFrame:
    """(a, b): the nodes of these documents (a, b) whose sketches allow a link."""
    def told(side: str, *names: str) -> DataFrame:
        return named.select(F.col("_id").alias(side), *[
            F.col(old).alias(new) for old, new in zip(("node", "n", "sketch"), names, strict=True)])

    return (
        pairs.join(told("a", "_a", "n", "left"), "a").join(told("b", "_b", "m", "right"), "b")
        .where("_a <> _b")
        .select(F.col("_a").alias("a"), F.col("_b").alias("b"), "n", "m", "left", "right")
        .mapInArrow(lambda batches: _may_be_linked(batches, percent), "a long, b long")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())


def _with_least(signed: DataFrame, named: DataFrame, paired: int, percent: int) -> DataFrame:
    """(a, b): the nodes of each signature (sign, _id, b, _rows) with those of its least document.

    Of signatures of up to ``paired`` rows, only where sketches allow a link.
    """
    pairs = signed.where("_id <> b").select(
        F.col("_id").alias("a"), "b", (F.col("_rows") > paired).alias("_star")).distinct()
    nodes = named.select("_id", "node").distinct()
    stars = (
        pairs.where("_star").join(nodes.select(F.col("_id").alias("a"), F.col("node").alias("_a")), "a")
        .join(nodes.select(F.col("_id").alias("b"), F.col("node").alias("_b")), "b")
        .select(F.col("_a").alias("a"), F.col("_b").alias("b")).where("a <> b"))
    return _allowed(pairs.where("not _star").drop("_star"), named, percent).unionAll(stars).distinct()


def _between_parts(
    signed: DataFrame, named: DataFrame, parts: DataFrame, paired: int, percent: int,
) -> DataFrame:
    """(a, b): nodes that are in different ``parts`` (node, root) and may be linked.

    By signatures of up to ``paired`` rows; a node without a part is its own. Near copies
    are in one part by then, so a group of them makes no pairs.
    """
    placed = named.select("_id", "node").distinct().join(parts, "node", "left").select(
        "_id", F.coalesce("root", "node").alias("_part")).distinct()
    # Near copies have hundreds of signatures in common, and the same rows in each.
    groups = (
        signed.where(F.col("_rows") <= paired).select("sign", "_id").join(placed, "_id")
        .groupBy("sign").agg(F.array_sort(F.collect_set(F.struct("_part", "_id"))).alias("_all"))
        .where(F.col("_all")[0]["_part"] < F.element_at("_all", -1)["_part"]).select("_all").distinct())
    first = groups.select("_all", F.posexplode("_all").alias("_at", "_one"))
    others = F.slice("_all", F.col("_at") + 2, F.size("_all"))
    pairs = first.select(
        F.col("_one._id").alias("b"),
        F.explode(F.transform(
            F.filter(others, lambda x: x["_part"] != F.col("_one._part")), lambda x: x["_id"])).alias("a"))
    return _allowed(pairs.where("a <> b").distinct(), named, percent)


def link_documents(
    docs: DataFrame, size: int = 5, percent: int = 80, block_rows: int = 1024,
    block_shingles: int = 1 << 20, blocks_at_once: int = 8, paired: int = PAIRED,
) -> DataFrame:
    """(doc_id, _id, _th, n, node, root) of every row of ``docs``.

    ``n`` counts the distinct shingles of ``size`` words, ``root`` is the least
    document reachable by links (``node`` the least with the very same set).

    Equal sets become one class first. Each class and the least one with a common
    signature are candidates; where up to ``paired`` have it, if their sketches allow a
    link, and there each two that aren't in one cluster by then are candidates in
    the same way. Candidates form clusters, and a cluster is compared in one task. One of more
    than ``block_rows`` classes or ``block_shingles`` shingles is cut into
    blocks, and each two blocks are compared in one task. One of more blocks than
    ``blocks_at_once`` is connected first: every class is compared with its
    candidates, in parts, and with what else its sketch allows among up to ``paired`` classes
    that aren't connected by then. Then only signatures of more than ``paired`` classes that
    aren't all connected can hide another link, and the clusters that
    these form are compared by blocks. So no link is lost, no task is
    unbounded, and a large group of near copies costs its size.
    """
    keyed = docs.select(
        "doc_id", _own_id().alias("_id"), text_hash(F.col("text")).alias("_th"), "text")
    base = staged(keyed.mapInArrow(
        lambda batches: _sets(batches, size),
        "doc_id long, _id long, _th long, n long, f1 long, f2 long, sketch binary"))
    # A class without any doc_id takes its number from its set.
    node = F.coalesce(
        F.min("doc_id"), F.lit(NO_ID_BELOW) - 1 - F.shiftrightunsigned(F.min("f1"), 3))
    full = base.where("n > 0")
    classes = staged(
        full.groupBy("f1", "f2").agg(
            node.alias("node"), F.min(F.struct("_id", "_th", "sketch")).alias("_row"),
            F.max("n").alias("n")))
    named = staged(
        full.select("_id", "f1", "f2").distinct()
        .join(classes.select("f1", "f2", "node", "n", "_row.sketch"), ["f1", "f2"]).drop("f1", "f2"))
    # Equal sets sign alike, so one row of each class signs (and a few others with it).
    signing = marked(keyed, [F.col("_id"), F.col("_th")],
                     classes.select("_row._id", "_row._th"), ["_id", "_th"]).where("_marked")

    # Most signatures are one document's. The first time three bytes of each are
    # shuffled, to find those that aren't; the second time only these are.
    texts = signing.select("_id", "text")
    held = _held_bits(staged(
        texts.mapInArrow(lambda batches: _packed_signs(batches, size, percent), "bucket int, prints binary")
        .repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_shared_bits, "bucket int, bits binary")))
    made = staged(texts.mapInArrow(lambda batches: _signs(batches, size, percent, held), "sign long, _id long"))
    # Written tables on both sides let adaptive execution split a hot key's join.
    shared = staged(
        made.groupBy("sign").agg(F.min("_id").alias("b"), F.count("*").alias("_rows")).where("_rows > 1"))
    signed = staged(made.join(shared, "sign"))
    with_least = staged(_with_least(signed, named, paired, percent))
    parts = staged(components(with_least))
    between = staged(_between_parts(signed, named, parts, paired, percent))

    def compared(units: DataFrame) -> DataFrame:
        """Links (a, b) found among the nodes of each unit; enough to connect them."""
        members = staged(
            units.join(classes.select("node", "_row._id", "_row._th"), "node").groupBy("_id", "_th")
            .agg(F.collect_set(F.struct("unit", "node")).alias("_units")))
        own = [F.col("_id"), F.col("_th")]
        texts = marked(keyed.select("_id", "_th", "text"), own, members, ["_id", "_th"]).where(
            "_marked").drop("_marked").join(members, ["_id", "_th"]).dropDuplicates(["_id", "_th"])
        rows = texts.select(F.explode("_units").alias("_u"), "text").select("_u.unit", "_u.node", "text")
        return rows.repartition("unit").sortWithinPartitions("unit").mapInArrow(
            lambda batches: _link(batches, size, percent), "a long, b long")

    def sized(clusters: DataFrame) -> DataFrame:
        return staged(clusters.join(classes.select("node", "n"), "node").groupBy("root").agg(
            _chunks(block_rows, block_shingles).alias("_blocks")))

    clusters = staged(components(
        parts.select(F.col("node").alias("a"), F.col("root").alias("b")).unionAll(between)))
    sizes = sized(clusters)
    large = staged(
        clusters.join(sizes.where(F.col("_blocks") > blocks_at_once), "root", "left_semi")
        .select("node"))
    if large.isEmpty():
        links = compared(_blocks(clusters, sizes))
    else:
        def near_of(pairs: DataFrame) -> DataFrame:
            within_large = pairs.join(large.withColumnRenamed("node", "a"), "a", "left_semi")
            return staged(compared(_stars(within_large, classes, block_rows, block_shingles)))

        near = near_of(with_least.unionAll(between))
        inside = staged(named.join(large, "node", "left_semi"))
        left = staged(_between_parts(
            signed.join(inside.select("_id").distinct(), "_id", "left_semi"), inside,
            staged(components(near)), paired, percent))
        near = near.unionAll(near_of(left))
        told = staged(
            signed.where(F.col("_rows") > paired).join(named, "_id").select("sign", "node").distinct()
            .join(large, "node", "left_semi").join(components(near), "node", "left")
            .select("sign", "node", F.coalesce("root", "node").alias("_part")))
        open_signs = staged(
            told.groupBy("sign").agg(
                F.min("node").alias("b"), F.min("_part").alias("_low"), F.max("_part").alias("_high"))
            .where("_low <> _high").select("sign", "b"))
        rest = staged(components(
            told.join(open_signs, "sign").select(F.col("node").alias("a"), "b").distinct()))
        units = _blocks(clusters, sizes.where(F.col("_blocks") <= blocks_at_once)).unionAll(
            _blocks(rest, sized(rest)))
        links = compared(units).unionAll(near)
    roots = components(links)
    labels = (
        classes.select("f1", "f2", "node").join(roots, "node", "left")
        .select("f1", "f2", "node", F.coalesce("root", "node").alias("root")))
    return (
        base.join(labels, ["f1", "f2"], "left")
        .select("doc_id", "_id", "_th", "n",
                F.when(F.col("n") > 0, F.col("node")).alias("node"),
                F.when(F.col("n") > 0, F.col("root")).alias("root"))
    )


def query(docs: DataFrame) -> DataFrame:
    """Three words to a shingle, and a similarity of 0.9, as the contract says."""
    found = link_documents(docs, 3, 90)
    return found.select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("doc_id"))
        .when(F.col("root") >= NO_ID_BELOW, F.col("root")).alias("component_id"))


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each group: the least doc_id, one row of it.

    Documents without words are all kept.
    """
    found = link_documents(docs, size, percent)
    chosen = (F.col("doc_id") == F.col("root")) | (
        (F.col("root") < NO_ID_BELOW) & (F.col("node") == F.col("root")))
    told = staged(found.groupBy("_id", "_th").agg(
        F.max(F.coalesce(chosen, F.lit(False))).alias("_kept"), F.count("*").alias("_rows")))
    some = F.coalesce(F.btrim("text", F.lit(BLANKS)), F.lit("")) != ""
    keys = ["_id", "_th"]
    rows = marked(
        docs.where(some).select(
            F.struct("*").alias("row"), _own_id().alias("_id"), text_hash(F.col("text")).alias("_th")),
        [F.col(k) for k in keys], told.where("NOT _kept OR _rows > 1"), keys)
    # Most rows are kept and have no copy, so they need not be shuffled.
    alone = rows.where(~F.col("_marked")).select("row.*")
    others = rows.where("_marked").drop("_marked").join(told.where("_kept").select(*keys), keys) \
        .dropDuplicates(keys).select("row.*")
    return alone.unionByName(others).unionByName(docs.where(~some))
