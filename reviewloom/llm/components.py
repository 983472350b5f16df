"""Connected components of an edge table, by alternating stars."""

from pyspark.sql import DataFrame, functions as F

from reviewloom.session import staged


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b); root is the least node.

    Each round hangs neighbours under the least neighbour known to them. A node
    with very many neighbours is a hot join key, which adaptive execution
    splits as both sides are written tables, and a minimum that is reduced ahead
    of its shuffle. The number of rounds
    grows with the logarithm of the longest chain.
    """
    stars = staged(
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = _state(stars)
    while before[0]:
        both = stars.unionAll(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = staged(both.groupBy("a").agg(F.min(F.least("a", "b")).alias("_m")))
        large = staged(
            both.where("b > a").join(least, "a")
            .select(F.col("b").alias("a"), F.col("_m").alias("b")).distinct())
        lowest = staged(large.groupBy("a").agg(F.min("b").alias("_m")))
        stars = staged(
            large.join(lowest, "a").where("b <> _m")
            .select(F.col("b").alias("a"), F.col("_m").alias("b"))
            .unionAll(lowest.select("a", F.col("_m").alias("b"))).distinct())
        now = _state(stars)
        if now == before:
            break
        before = now
    roots = stars.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionAll(stars.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()


def _state(stars: DataFrame) -> tuple:
    return tuple(stars.agg(
        F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first())
