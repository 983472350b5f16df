"""Pages or reviews that arrive over time, stored in micro-batches."""

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from reviewloom.operators.dedup import with_keys
from reviewloom.plans.ingest import ORDER, log_added, page_candidates
from reviewloom.plans.partials import write_partials
from reviewloom.schema import KEY_COLUMNS, PAGE_SCHEMA
from reviewloom.sources.folders import FAN
from reviewloom.sources.store import append_reviews, is_written, read_batch, stream_writer


def read_arrivals(
    spark: SparkSession, path: str, schema: StructType = PAGE_SCHEMA, files_per_batch: int = 100
) -> DataFrame:
    """A folder of Parquet files as a stream, oldest files first."""
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_batch).parquet(path)
    )


def store_stream(
    arrivals: DataFrame, candidates_of: Callable[[DataFrame], DataFrame],
    store_path: str, checkpoint: str, order: Sequence[str] = tuple(ORDER),
    language_profiles: Mapping[str, Sequence[str]] | None = None,
    metrics_path: str | None = None, fan: int = FAN, partials_path: str | None = None,
) -> StreamingQuery:
    """Store the new reviews of every micro-batch and stop when all is read.

    Within a batch the first review of a key wins, across batches the earlier
    batch. What was seen before is looked up in the stored table, so the query
    holds no state that grows. The checkpoint and the batch number name the
    folder that is written, so no other writer's rows are replaced. A batch that
    comes again after a failure is stored if it wasn't as a whole. ``fan`` folders
    of the stream are merged into one, as often as there are so many.
    """
    writer = stream_writer(checkpoint)

    def store(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if is_written(spark, store_path, writer, number):
            added = read_batch(spark, store_path, writer, number)
        else:
            added = append_reviews(
                candidates_of(batch), store_path, number, list(order), language_profiles, writer, fan)
        if metrics_path:
            log_added(added, store_path, metrics_path, number, writer)
        if partials_path:
            write_partials(added, partials_path, number, writer)

    return (
        arrivals.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def ingest_stream(
    spark: SparkSession, pages_path: str, listings: DataFrame, store_path: str,
    checkpoint: str, files_per_batch: int = 100,
    language_profiles: Mapping[str, Sequence[str]] | None = None,
    metrics_path: str | None = None,
) -> StreamingQuery:
    """Captured pages, as they arrive, into the store."""
    return store_stream(
        read_arrivals(spark, pages_path, files_per_batch=files_per_batch),
        lambda pages: page_candidates(pages, listings),
        store_path, checkpoint, language_profiles=language_profiles, metrics_path=metrics_path)


def stream_dedup(reviews: DataFrame, arrived: str, delay: str) -> DataFrame:
    """Reviews whose key was not seen within ``delay``, by state in the stream.

    For streams with an arrival time and no stored table to look into. State
    is dropped once the watermark has passed.
    """
    return (
        with_keys(reviews).withWatermark(arrived, delay)
        .dropDuplicatesWithinWatermark(KEY_COLUMNS)
    )
