"""The trie of conversations' common beginnings, from padded matrices of turn ids.

A node stands for a distinct sequence of the first d turns, the root for none. The
conversations are dealt to shards by ranges of their sequences. A shard lays the
turns' ids, numbered within it, into a matrix with a row for each conversation,
zeros behind its last turn, a block of columns at a time, and sorts the rows
(``numpy.lexsort``). A row that differs from the one above it in any of the first d
columns begins a node of depth d: the columns' change masks are accumulated by OR.
What is known of nodes are sums and minima over their rows (``reduceat``), from the
deepest up.

The nodes that hold a shard's first or last row may go on in its neighbours. They
are put out as parts, told by a hash of their sequence, and added up afterwards;
these are two for each shard and depth at most. The conversations that end in
such a node, which may be a third of all, are put out in pieces of ``PIECE``, and
spread over shards like any others, since ranges go by conv_id last.

Turns go by ``turn`` (null first), then role and text; repeated rows are turns like
any others. Null roles and texts are empty. Rows without a conv_id belong to no
conversation. Turns are told apart by 64-bit hashes. One conversation's ids are one
array. An empty table has no nodes, not even a root. Extra columns are ignored.
"""

import hashlib
import zlib
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from reviewloom.llm.common import small
from reviewloom.llm.textnum import STEP, mix
from reviewloom.session import staged

#: Turns of a shard, columns of a block, and conversations in a piece of a list.
TURNS = 1 << 20
BLOCK = 16
PIECE = 4096

_SEQUENCES = "conv_id long, ids array<long>, chars array<int>"


def _conversations(batches: Iterator[pa.RecordBatch]):
    """(base, conv_id, ids, chars) of rows that come sorted by base and conv_id."""
    held, parts = None, []
    for batch in batches:
        base, conv, ids, chars = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        cuts = np.flatnonzero(conv[1:] != conv[:-1]) + 1
        for a, b in zip(np.append(0, cuts).tolist(), np.append(cuts, len(conv)).tolist(), strict=True):
            if a == b:
                continue
            if held != (now := (int(base[a]), int(conv[a]))):
                if parts:
                    yield *held, *map(np.concatenate, zip(*parts, strict=True))
                held, parts = now, []
            parts.append((ids[a:b], chars[a:b]))
    if parts:
        yield *held, *map(np.concatenate, zip(*parts, strict=True))


def _as_batch(rows: list[tuple]) -> pa.RecordBatch:
    ends = np.cumsum([0, *(len(r[1]) for r in rows)]).astype(np.int32)
    ids, chars = (np.concatenate([r[k] for r in rows]) for k in (1, 2))
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int64()),
         pa.ListArray.from_arrays(ends, pa.array(ids.astype(np.int64))),
         pa.ListArray.from_arrays(ends, pa.array(chars.astype(np.int32)))],
        names=["conv_id", "ids", "chars"])


def _rebuilt(batches: Iterator[pa.RecordBatch], swaps: Callable[[int], int]) -> Iterator[pa.RecordBatch]:
    """Sequences in which the first turns are those of the first conversation of a hundred."""
    head, rows, size = (None, None, None), [], 0
    for base, conv, ids, chars in _conversations(batches):
        if conv == base or head[0] != base:
            head = (base, ids, chars) if conv == base else (base, ids[:0], chars[:0])
        if swapped := swaps(conv):
            ids, chars = (np.concatenate([first[:swapped], x[swapped:]])
                          for first, x in zip(head[1:], (ids, chars), strict=True))
        rows.append((conv, ids, chars))
        size += len(ids)
        if len(rows) >= 2000 or size >= TURNS // 4:
            yield _as_batch(rows)
            rows, size = [], 0
    if rows:
        yield _as_batch(rows)


def swapped_turns(conv_id: int) -> int:
    """Fixed rule: how many first turns a conversation takes from another one."""
    return zlib.crc32(str(conv_id).encode()) % 6


def turn_sequences(conversations: DataFrame, swaps: Callable[[int], int] | None = None) -> DataFrame:
    """(conv_id, ids, chars): a hash and the number of code points of each turn in order.

    With ``swaps``, the first swaps(c) turns of conversation c are those of
    conversation c - c % 100, if there is one, in place of its own.
    """
    swaps = swaps or (lambda conv_id: 0)
    text = F.coalesce("text", F.lit(""))
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), text.alias("text"))
    return (
        turns.withColumn("base", F.col("conv_id") - F.col("conv_id") % 100)
        .repartition("base")
        .sortWithinPartitions("base", F.col("conv_id") != F.col("base"), "conv_id", "turn", "role", "text")
        .select("base", "conv_id", F.xxhash64("role", "text").alias("id"), F.length("text").alias("chars"))
        .mapInArrow(lambda batches: _rebuilt(batches, swaps), _SEQUENCES))


class Shard:
    """Sequences sorted as rows of a padded matrix, and where the nodes of each depth begin."""

    def __init__(self, conv: np.ndarray, lengths: np.ndarray, ids: np.ndarray):
        begin = np.cumsum(lengths) - lengths
        numbers = np.unique(ids, return_inverse=True)[1] + 1
        order = np.argsort(conv, kind="stable")
        group = np.zeros(len(conv), np.int64)
        #: For each depth: the rows that are as long, in order, and which begin a node.
        self.levels = [(np.arange(len(conv)), np.arange(len(conv)) == 0)]
        at, first = np.arange(len(conv)), 0
        while (lengths[order[at]] > first).any():
            rows, own = order[at], group[at]
            matrix = np.zeros((len(at), BLOCK), np.int64)
            inside = first + np.arange(BLOCK) < lengths[rows][:, None]
            matrix[inside] = numbers[((begin[rows] + first)[:, None] + np.arange(BLOCK))[inside]]
            sort = np.lexsort((*matrix.T[::-1], own))
            order[at], matrix = rows[sort], matrix[sort]
            change = np.append(True, own[1:] != own[:-1])
            for k in range(BLOCK):
                column = matrix[:, k]
                change[1:] |= column[1:] != column[:-1]
                alive = column != 0
                if alive.any():
                    self.levels.append((at[alive], change[alive]))
            group[at] = np.cumsum(change)
            first += BLOCK
            at = at[lengths[order[at]] >= first]
        self.order, self.conv, self.lengths, self.begin = order, conv[order], lengths[order], begin[order]


def _keys(ids: np.ndarray) -> np.ndarray:
    """The hashes of the sequences of the first 0, 1, 2 ... ids."""
    out = np.zeros(len(ids) + 1, np.uint64)
    spread = mix(ids.view(np.uint64) + STEP) + np.arange(1, len(ids) + 1, dtype=np.uint64)
    for d in range(len(ids)):
        out[d + 1:d + 2] = mix(out[d:d + 1] * np.uint64(3) + spread[d:d + 1])
    return out.view(np.int64)


_NODE, _PART, _ENDS = 0, 1, 2
_OUT = pa.schema([
    ("kind", pa.int32()), ("depth", pa.int64()), ("key", pa.int64()), ("parent_key", pa.int64()),
    ("conv_id", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()),
    ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()),
    ("chars", pa.int64()), ("ends", pa.string())])
_OUT_TYPES = "kind int, depth long, key long, parent_key long, conv_id long, parent_conv_id long, " \
    "n_convs long, n_children long, n_leaves long, saved_tokens long, chars long, ends string"
_NO_ENDS = hashlib.sha256(b"").hexdigest()


def _listed(conv: np.ndarray) -> str:
    return ",".join(map(str, conv.tolist()))


def _shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of the sequences of a partition, and parts of those at its ends."""
    table = list(batches)
    conv = np.concatenate([np.zeros(0, np.int64), *(b.column(0).to_numpy() for b in table)])
    if not len(conv):
        return
    lengths = np.concatenate([b.column(1).value_lengths().to_numpy() for b in table]).astype(np.int64)
    ids, chars = (np.concatenate([b.column(k).flatten().to_numpy() for b in table]) for k in (1, 2))
    shard = Shard(conv, lengths, ids)
    last, rows = len(conv) - 1, shard.levels
    keys = []
    for row in (0, last):
        a = shard.begin[row]
        keys.append(_keys(ids[a:a + shard.lengths[row]]))
    firsts = [np.flatnonzero(begins) for _, begins in rows]
    at = [own[first] for (own, _), first in zip(rows, firsts, strict=True)]
    least = [np.minimum.reduceat(shard.conv[own], first)
             for (own, _), first in zip(rows, firsts, strict=True)]
    saved, leaves = np.zeros(last + 1, np.int64), np.zeros(last + 1, np.int64)
    below, below_edge = np.zeros(0, np.int64), np.zeros(0, bool)
    for depth in range(len(rows) - 1, -1, -1):
        own, first, here = rows[depth][0], firsts[depth], at[depth]
        nodes = len(first)
        n = np.diff(np.append(first, len(own)))
        edge, key = np.zeros(nodes, bool), np.zeros(nodes, np.int64)
        for node, row, known in ((0, 0, keys[0]), (nodes - 1, last, keys[1])):
            if (own[0] if row == 0 else own[-1]) == row:
                edge[node], key[node] = True, known[depth]
        of = np.searchsorted(here, below, side="right") - 1
        kids = np.bincount(of[~below_edge], minlength=nodes)
        size = chars[shard.begin[here] + depth - 1].astype(np.int64) if depth else np.zeros(nodes, np.int64)
        gain, leaf = np.where(edge, 0, (n - 1) * size), ~edge & (kids == 0)
        saved[here] += gain
        leaves[here] += leaf
        sums = [np.add.reduceat(x[own], first) for x in (saved, leaves)]
        ended = np.add.reduceat((shard.lengths[own] == depth).astype(np.int64), first)
        told = [_NO_ENDS] * nodes
        for node in np.flatnonzero((ended > 0) & ~edge).tolist():
            some = shard.conv[here[node]:here[node] + ended[node]]
            told[node] = hashlib.sha256(_listed(some).encode()).hexdigest()
        parent, up_key, up_known = np.zeros(nodes, np.int64), np.zeros(nodes, np.int64), np.ones(nodes, bool)
        if depth:
            up = np.searchsorted(at[depth - 1], here, side="right") - 1
            parent = least[depth - 1][up]
            # The first and the last node above are parts as they hold the outer rows.
            up_own = rows[depth - 1][0]
            for node, row, known in ((0, 0, keys[0]), (len(at[depth - 1]) - 1, last, keys[1])):
                if (up_own[0] if row == 0 else up_own[-1]) == row:
                    up_known[up == node], up_key[up == node] = False, known[depth - 1]
        yield pa.RecordBatch.from_arrays([
            pa.array(np.where(edge, _PART, _NODE), pa.int32()), pa.array(np.full(nodes, depth)),
            pa.array(key, mask=~edge), pa.array(up_key, mask=up_known),
            pa.array(least[depth]), pa.array(parent, mask=~up_known | (depth == 0)),
            pa.array(n), pa.array(kids), pa.array(sums[1]), pa.array(sums[0]), pa.array(size),
            pa.array(told, pa.string(), mask=edge)], schema=_OUT)
        for node in np.flatnonzero(edge & (ended > 0)).tolist():
            some = shard.conv[here[node]:here[node] + ended[node]]
            pieces = [some[i:i + PIECE] for i in range(0, len(some), PIECE)]
            for low in range(0, len(pieces), 256):
                yield pa.RecordBatch.from_pylist([
                    {"kind": _ENDS, "depth": depth, "key": int(key[node]), "conv_id": int(piece[0]),
                     "ends": _listed(piece)} for piece in pieces[low:low + 256]], schema=_OUT)
        below, below_edge = here, edge


def _added_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole nodes out of those parts that are one node each, the deepest first."""
    depth, below, above = None, {}, {}
    for batch in batches:
        rows = batch.to_pylist()
        for r in rows:
            if r["depth"] != depth:
                depth, below, above = r["depth"], above, {}
            # Sums over the rows of a part lack only what parts below it add of their own.
            kids, leaves, saved = below.get(r["key"], (0, 0, 0))
            r["n_children"] += kids
            leaves += r["n_children"] == 0
            saved += (r["n_convs"] - 1) * r["chars"]
            r["n_leaves"] += leaves
            r["saved_tokens"] += saved
            if depth:
                k, v, s = above.get(r["parent_key"], (0, 0, 0))
                above[r["parent_key"]] = (k + 1, v + leaves, s + saved)
        yield pa.RecordBatch.from_pylist(rows, schema=batch.schema)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest for each key over its pieces, which come in order."""
    pieces = (x for b in batches for x in zip(*[c.to_pylist() for c in b.columns], strict=True))
    for key, some in groupby(pieces, key=lambda x: x[0]):
        digest = hashlib.sha256()
        for number, (_, piece) in enumerate(some):
            digest.update(f",{piece}".encode() if number else piece.encode())
        yield pa.RecordBatch.from_arrays(
            [pa.array([key], pa.int64()), pa.array([digest.hexdigest()])], names=["key", "ends"])


def prefix_trie(sequences: DataFrame, turns: int = TURNS) -> DataFrame:
    """The nodes of ``sequences`` (conv_id, ids, chars).

    (conv_id, the least that begins so; depth; parent_conv_id, that of the node above;
    n_convs, the conversations that begin so; n_children; n_leaves, the nodes without
    children among it and all below; saved_tokens, over the same nodes the characters
    of the last turn for each conversation but one; ends_sha256, a digest of the
    conversations that end there.) A shard has about ``turns`` turns.
    """
    spark = sequences.sparkSession
    rows = staged(sequences)
    total = rows.agg(F.coalesce(F.sum(F.size("ids") + 1), F.lit(0))).first()[0]
    shards = max(spark.sparkContext.defaultParallelism, -(-total // turns))
    out = staged(
        rows.repartitionByRange(shards, "ids", "conv_id").mapInArrow(_shard, _OUT_TYPES))
    parts = (
        out.where(F.col("kind") == _PART).groupBy("depth", "key").agg(
            F.max("parent_key").alias("parent_key"), F.min("conv_id").alias("conv_id"),
            F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("n_children"),
            F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"),
            F.max("chars").alias("chars")))
    # Two rows for each shard and depth at most.
    whole = staged(
        parts.repartition(1).sortWithinPartitions(F.desc("depth")).mapInArrow(_added_up, parts.schema))
    ends = (
        out.where(F.col("kind") == _ENDS).select("key", "ends", "conv_id")
        .repartition("key").sortWithinPartitions("key", "conv_id").select("key", "ends")
        .mapInArrow(_digests, "key long, ends string"))
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    above = whole.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("_up"))
    joined = whole.join(ends, "key", "left").join(above, "parent_key", "left").select(
        *[F.col("_up").alias(c) if c == "parent_conv_id" else c for c in names],
        F.coalesce("ends", F.lit(_NO_ENDS)).alias("ends_sha256"))
    nodes = out.where(F.col("kind") == _NODE)
    inner = nodes.where("parent_key IS NULL").select(*names, F.col("ends").alias("ends_sha256"))
    outer = nodes.where("parent_key IS NOT NULL").join(small(above), "parent_key").select(
        *[F.col("_up").alias(c) if c == "parent_conv_id" else c for c in names],
        F.col("ends").alias("ends_sha256"))
    return inner.unionByName(outer).unionByName(joined)


def query(conversations: DataFrame) -> DataFrame:
    return prefix_trie(turn_sequences(conversations, swapped_turns))


#: The polynomial and the start of CRC-32.
ORACLE = """
WITH t AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''),
                              coalesce(text, '')) AS i
    FROM conversations WHERE conv_id IS NOT NULL),
c AS (
    SELECT conv_id, conv_id - conv_id % 100 AS base,
           xor(list_reduce(list_prepend(4294967295, list_transform(
                   string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
               lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)),
                   lambda v, _: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295) % 6 AS h
    FROM (SELECT DISTINCT conv_id FROM t)),
n AS (SELECT conv_id AS base, count(*) AS n FROM t GROUP BY conv_id),
turns AS (
    SELECT c.conv_id, t.i AS i, role, text FROM c JOIN t ON t.conv_id = c.base WHERE t.i <= h
    UNION ALL
    SELECT c.conv_id, least(h, coalesce(n, 0)) + t.i - h, role, text
    FROM c JOIN t ON t.conv_id = c.conv_id LEFT JOIN n ON n.base = c.base WHERE t.i > h),
s AS (
    SELECT conv_id, coalesce(list({'role': role, 'text': text} ORDER BY i) FILTER (i IS NOT NULL), []) AS s
    FROM c LEFT JOIN turns USING (conv_id) GROUP BY conv_id),
p AS (SELECT conv_id, len(s) AS n, d, s[:d] AS k FROM (
    SELECT conv_id, s, unnest(range(len(s) + 1)) AS d FROM s)),
nodes AS (
    SELECT d, k, min(conv_id) AS conv_id, count(*) AS n_convs,
           sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends,
           CASE d WHEN 0 THEN 0 ELSE (count(*) - 1) * length(k[d].text) END AS saved
    FROM p GROUP BY d, k),
kids AS (SELECT d - 1 AS d, k[:d - 1] AS k, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL),
full_nodes AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids USING (d, k)),
below AS (
    SELECT a AS d, k[:a] AS k, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved)::BIGINT AS saved_tokens
    FROM (SELECT *, unnest(range(d + 1)) AS a FROM full_nodes) GROUP BY ALL)
SELECT f.conv_id, f.d AS depth, u.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves,
       saved_tokens, f.ends AS ends_sha256
FROM full_nodes f JOIN below USING (d, k) LEFT JOIN nodes u ON u.d = f.d - 1 AND u.k = f.k[:f.d - 1]
"""
