"""First-wins deduplication in a stream: the first in order, not the first to arrive."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from reviewloom.operators.dedup import dedup_first, with_keys
from reviewloom.schema import KEY_COLUMNS
from reviewloom.sources.folders import files_of


def first_in_order(reviews: DataFrame, order: Sequence[str], arrived: str, delay: str) -> DataFrame:
    """The first review in ``order`` of every key, so far, as a stream of updates.

    The state store holds the least review of each key that came within a window of
    ``delay``, and drops a window once reviews that old are no longer awaited. A
    later one that precedes it replaces it. Reviews that come later than ``delay``
    behind the latest one are left out, as in any aggregation with a watermark.
    """
    keyed = with_keys(reviews)
    rest = [c for c in keyed.columns if c not in KEY_COLUMNS and c not in order]
    first = F.min(F.struct(*order, *rest)).alias("_first")
    return (
        keyed.withWatermark(arrived, delay)
        .groupBy(F.window(arrived, delay), *KEY_COLUMNS).agg(first)
        .select(*[F.col(c) if c in KEY_COLUMNS else F.col(f"_first.{c}").alias(c)
                  for c in keyed.columns])
    )


def write_first(firsts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write down every update, a folder per micro-batch, and stop when all is read.

    A micro-batch that comes again replaces its folder.
    """
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/changes/batch={number}")

    return (
        firsts.writeStream.foreachBatch(write).outputMode("update")
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def _folders(spark: SparkSession, path: str) -> list[tuple[str, int, str]]:
    """(kind, number, path) of all folders that are written as a whole."""
    out = []
    for kind, name in (("changes", "batch"), ("settled", "upto")):
        files, where = files_of(spark, f"{path}/{kind}/{name}=*/_SUCCESS")
        for status in files.globStatus(where) or []:
            folder = status.getPath().getParent()
            out.append((kind, int(folder.getName().partition("=")[2]), folder.toString()))
    return out


def read_first(spark: SparkSession, path: str, order: Sequence[str]) -> DataFrame:
    """The first review of every key in all that was written.

    A minimum of minima: updates may be read in any order, and more than once.
    """
    found = [folder for _, _, folder in _folders(spark, path)]
    return dedup_first(spark.read.parquet(*found), order)


def settle_first(spark: SparkSession, path: str, order: Sequence[str]) -> None:
    """Write the first reviews as one folder and remove the updates they come from.

    Ended in between, both are there, which reads the same. Not to be run while
    the stream writes.
    """
    found = _folders(spark, path)
    if not any(kind == "changes" for kind, _, _ in found):
        return
    target = f"{path}/settled/upto={max(number for _, number, _ in found) + 1}"
    read_first(spark, path, order).write.mode("overwrite").parquet(target)
    for _, _, folder in found:
        files, where = files_of(spark, folder)
        if folder != target and not folder.endswith(target):
            files.delete(where, True)
