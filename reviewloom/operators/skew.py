"""Numbers and running sums without a single task, a check of a table's size, and a filter ahead of joins."""

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from reviewloom.session import staged

BROADCAST_BYTES = 64 << 20
#: Spark cuts a ranking down ahead of its shuffle up to this rank.
WINDOW_LIMIT = 1000
#: Bits of the bitmap by which :func:`marked` sorts rows out: 8 MB.
MARK_BITS = 26


def within(df: DataFrame, rows: int, size: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` has at most ``rows`` rows and ``size`` bytes.

    Looks at one row more than that, and at no others.
    """
    width = F.octet_length(F.to_json(F.struct("*")))
    found = df.limit(rows + 1).agg(F.count("*"), F.coalesce(F.sum(width), F.lit(0))).first()
    return found[0] <= rows and found[1] <= size


def numbered(df: DataFrame, order: Sequence[str], out: str = "row_no") -> DataFrame:
    """Dense 1-based numbers in the given order, without a single-task sort.

    Rows are range partitioned and sorted, written once, and counted per
    partition; the counts (one row per partition) give each partition its
    start. The written table keeps number and start consistent if tasks rerun.
    """
    mid = F.monotonically_increasing_id()
    placed = staged(
        df.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("_mid", mid)
        .select("*", F.shiftright("_mid", 33).alias("_part"),
                F.col("_mid").bitwiseAND((1 << 33) - 1).alias("_pos"))
        .drop("_mid")
    )
    starts = _starts(placed.groupBy("_part").agg(F.count("*").alias("_total")))
    return (
        placed.join(F.broadcast(starts), "_part")
        .withColumn(out, F.col("_start") + F.col("_pos") + 1)
        .drop("_part", "_pos", "_start")
    )


def running_sum(df: DataFrame, order: Sequence[str], value: str, out: str) -> DataFrame:
    """Sum of ``value`` up to and including each row, in the given order."""
    placed = staged(
        df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    )
    starts = _starts(placed.groupBy("_part").agg(F.sum(value).alias("_total")))
    local = F.sum(value).over(
        Window.partitionBy("_part").orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        placed.withColumn("_local", local)
        .join(F.broadcast(starts), "_part")
        .withColumn(out, F.col("_start") + F.col("_local"))
        .drop("_part", "_local", "_start")
    )


def ranked_within(df: DataFrame, groups: Sequence[str], order: Sequence, out: str = "place") -> DataFrame:
    """The 1-based place of each row in its group, by ``order``, for groups of any size.

    Rows are dealt by ranges of group and order, so a large group is many ranges.
    A row's place is that within its range and group, behind those of the group in
    the ranges ahead, of which there is one count each. A null group is one too.
    """
    placed = staged(
        df.repartitionByRange(*groups, *order).withColumn("_part", F.spark_partition_id()))
    ahead = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    keys = ["_part", *groups]
    starts = placed.groupBy(*keys).agg(F.count("*").alias("_total")).select(
        *[F.col(c).alias(f"_at_{c}") for c in keys],
        F.coalesce(F.sum("_total").over(ahead), F.lit(0)).alias("_start"))
    local = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_at_{c}")) for c in keys])
    return (
        placed.withColumn("_local", local).join(starts, same)
        .withColumn(out, F.col("_start") + F.col("_local"))
        .drop("_part", "_local", "_start", *[f"_at_{c}" for c in keys])
    )


def _starts(totals: DataFrame) -> DataFrame:
    """Sum of the partitions ahead of each partition; one row per partition."""
    ahead = (
        Window.orderBy("_part")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return totals.select(
        "_part", F.coalesce(F.sum("_total").over(ahead), F.lit(0)).alias("_start")
    )


def marked(df: DataFrame, own: list[Column], found: DataFrame, key: list[str], bits: int = MARK_BITS) -> DataFrame:
    """``df`` with ``_marked``: false only where ``own`` equals no row's ``key`` in ``found``.

    A bitmap of the keys' hashes, of a fixed size, is broadcast, so that rows that
    a join with ``found`` would not change need not be shuffled for it.
    """
    def place(columns):
        return F.xxhash64(*columns).bitwiseAND(F.lit((1 << bits) - 1))

    at = place([F.col(k) for k in key])
    bitmaps = found.groupBy(F.shiftright(at, 15).alias("_bucket")).agg(
        F.bitmap_construct_agg(at.bitwiseAND(F.lit(32767))).alias("_bits"))
    bit = F.col("_place").bitwiseAND(F.lit(32767))
    byte = F.conv(F.hex(F.substring("_bits", (F.shiftright(bit, 3) + 1).cast("int"), F.lit(1))), 16, 10)
    is_set = F.bit_get(byte.cast("int"), bit.bitwiseAND(F.lit(7)).cast("int")) == 1
    return (
        df.withColumn("_place", place(own))
        .join(F.broadcast(bitmaps), F.shiftright("_place", 15) == F.col("_bucket"), "left")
        .withColumn("_marked", F.coalesce(is_set, F.lit(False))).drop("_place", "_bucket", "_bits"))
