"""Mixing sources to target weights, by systematic sampling.

A null or empty text has size 0 and a null source is a source like the others.
Repeated rows take part one by one; where rows are emitted, rows that share
doc_id, text and source count as the first of them. No rows give no rows. Extra
columns are passed through.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from reviewloom.llm.common import BLANK, parts, row_keys, small
from reviewloom.operators.skew import numbered, running_sum
from reviewloom.session import staged

#: Steps of the random offset in a copy; a power of two keeps sums exact.
STEPS = 1 << 20


def text_size(text: Column) -> Column:
    return F.size(parts(text, BLANK)).cast("long")


def source_targets(
    sources: DataFrame, weights: Sequence[int] = (5, 2, 1), cap: int = 3,
) -> DataFrame:
    """(source, source_size, target) for one row (source, source_size) each.

    The sources, by code point and null last, weigh ``weights`` in turn and
    share the sum of all sizes. A target stops at ``cap`` times its source; the
    excess is shared by weight among the others until none is above. In the
    order of size by weight the stopped sources are the first ones, and what is
    left over is found by running sums instead of rounds.
    """
    order = F.col("source").asc_nulls_last()
    turn = F.pmod(F.col("row_no") - 1, F.lit(len(weights))).cast("int")
    ranked = numbered(sources, [order], "row_no").select(
        "source", "source_size", "row_no",
        F.get(F.array(*[F.lit(w) for w in weights]), turn).cast("long").alias("weight"))
    ranked = staged(ranked)
    by_need = [F.col("source_size") / F.col("weight"), F.col("row_no")]
    sums = running_sum(ranked, by_need, "source_size", "_sizes")
    sums = staged(running_sum(sums, by_need, "weight", "_weights"))
    total, weight = sums.agg(F.sum("source_size"), F.sum("weight")).first()
    rest = F.lit(total or 0) - cap * (F.col("_sizes") - F.col("source_size"))
    left = F.lit(weight or 0) - (F.col("_weights") - F.col("weight"))
    exact = lambda c: c.cast("decimal(19,0)")  # noqa: E731  their products may pass 64 bits
    open_ones = exact(cap * F.col("source_size")) * exact(left) >= exact(F.col("weight") * rest)
    at = sums.where(open_ones).agg(
        F.min(F.struct("_weights", rest.alias("rest"), left.alias("left"), "weight"))).first()[0]
    share = (at["rest"], at["left"]) if at else (0, 1)
    full = F.lit(cap) * F.col("source_size")
    stopped = exact(full) * exact(F.lit(share[1])) < exact(F.col("weight") * F.lit(share[0]))
    return ranked.select(
        "source", "source_size",
        F.when(stopped, full.cast("double"))
        .otherwise((F.col("weight") * F.lit(share[0])).cast("double") / F.lit(share[1]))
        .alias("target"))


def offset(source: Column, seed: str) -> Column:
    """A number from 0 up to 1 for each source, the same in every run."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(source, F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 5), 16, 10).cast("long") / F.lit(STEPS)


def plan_mix(
    docs: DataFrame, weights: Sequence[int] = (5, 2, 1), cap: int = 3, seed: str = "mix",
) -> DataFrame:
    """(doc_id, _id, _th, source, size, source_size, target, copies) of every row.

    Within a source all documents expect target / source_size copies. Summed up
    in the order of size, and moved by one random offset, the expected copies
    cross a whole number once for every copy that is taken. Neighbours in that
    order have like sizes, so what the source gives in words misses its target
    by about its largest document at most.
    """
    rows = staged(docs.select(
        "doc_id", *row_keys(), "source", text_size(F.col("text")).alias("size")))
    targets = source_targets(
        rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap)
    order = [F.col("source").asc_nulls_last(), F.col("size"), F.col("_id"), F.col("_th")]
    placed = staged(numbered(rows, order, "_no"))
    firsts = placed.groupBy("source").agg(F.min("_no").alias("_first"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    each = small(staged(
        targets.join(firsts.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
        .select("_s", "source_size", "target", "_first", rate.alias("_rate"),
                offset(F.col("source"), seed).alias("_offset"))))
    number = F.col("_no") - F.col("_first")
    crossed = (F.floor((number + 1) * F.col("_rate") + F.col("_offset"))
               - F.floor(number * F.col("_rate") + F.col("_offset")))
    return (
        placed.join(each, F.col("source").eqNullSafe(F.col("_s")))
        .select("doc_id", "_id", "_th", "source", "size", "source_size", "target",
                crossed.alias("copies"))
    )


def mix(
    docs: DataFrame, weights: Sequence[int] = (5, 2, 1), cap: int = 3, seed: str = "mix",
) -> DataFrame:
    """The columns of ``docs`` and ``copy`` (from 1), a row for each copy taken.

    A column of that name in ``docs`` is replaced.
    """
    docs = docs.drop("copy")
    taken = (
        plan_mix(docs, weights, cap, seed).where("copies > 0")
        .groupBy("_id", "_th", F.col("source").alias("_s")).agg(F.sum("copies").alias("_copies")))
    rows = (
        docs.select(F.struct("*").alias("row"), *row_keys(), F.col("source").alias("_of"))
        .join(taken.withColumnsRenamed({"_id": "_i", "_th": "_t"}),
              (F.col("_id") == F.col("_i")) & (F.col("_th") == F.col("_t"))
              & F.col("_of").eqNullSafe(F.col("_s")))
        .dropDuplicates(["_i", "_t", "_s"]))
    return rows.select(
        "row.*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))).alias("copy"))


def query(docs: DataFrame) -> DataFrame:
    return plan_mix(docs.select("doc_id", "text", "source")).select(
        "doc_id", "size", "source_size", "target",
        (F.col("copies") * F.col("size")).alias("taken"))


#: Weights, cap and seed of the query.
ORACLE = r"""
WITH sized AS (
    SELECT doc_id, source,
           len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))
               AS size
    FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n FROM sized GROUP BY source),
weighed AS (
    SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3
                  WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM sources),
ordered AS (
    SELECT *, row_number() OVER w AS k,
           (SELECT sum(source_size) FROM sources) - 3 * (sum(source_size) OVER w - source_size) AS rest,
           (SELECT sum(weight) FROM weighed) - (sum(weight) OVER w - weight) AS open_weight
    FROM weighed WINDOW w AS (ORDER BY source_size::DOUBLE / weight, source NULLS LAST)),
share AS (
    SELECT rest, open_weight FROM ordered
    WHERE 3 * source_size * open_weight >= weight * rest ORDER BY k LIMIT 1),
targets AS (
    SELECT source, source_size,
           CASE WHEN 3 * source_size * share.open_weight < weight * share.rest
                THEN (3 * source_size)::DOUBLE
                ELSE (weight * share.rest)::DOUBLE / share.open_weight::DOUBLE END AS target,
           ('0x' || md5('mix:' || coalesce(source, ''))[1:5])::BIGINT / 1048576.0::DOUBLE AS u
    FROM weighed, share),
placed AS (
    SELECT doc_id, size, source,
           row_number() OVER (PARTITION BY source ORDER BY size, doc_id) AS i FROM sized),
rated AS (
    SELECT doc_id, size, source_size, target, i, u,
           CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate
    FROM placed JOIN targets ON placed.source IS NOT DISTINCT FROM targets.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       ((floor(i * rate + u) - floor((i - 1) * rate + u)) * size)::BIGINT AS taken
FROM rated
"""
