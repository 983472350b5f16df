"""The stored review table: Parquet, one folder per writer and batch, merged by and by.

A folder is replaced as a whole, so a batch that is run again after a failure
leaves one copy of its rows. Every writer numbers its own batches; the rows of
all other folders count as stored. Writers take turns: a lock file names the
one at work. Before a batch is added, a writer's folders are merged where there
are many (:mod:`reviewloom.sources.folders`). A batch that was merged stays as it
is: given again, it adds nothing.
"""

from collections.abc import Iterator
from contextlib import contextmanager
from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession, functions as F

from reviewloom.operators.dedup import assign_ids, dedup_first, only_new, with_keys
from reviewloom.operators.reviews import build_reviews
from reviewloom.schema import COLUMNS, KEY_COLUMNS
from reviewloom.session import own_scratch, staged
from reviewloom.sources.folders import (
    FAN, Folder, bucketed, compact, files_of, folders, held_by, key_of, observed, rows_of, write_note,
)

#: Writers other than streams, which are named after their checkpoints.
BATCHES, IMPORTS = "batches", "imports"
#: Up to as many keys of a batch are named in the filter of the stored ones.
NAMED_KEYS = 1000


def stream_writer(checkpoint: str) -> str:
    """The writer's name of a stream: the same for each start from a checkpoint."""
    return "stream-" + sha256(checkpoint.rstrip("/").encode()).hexdigest()[:16]


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """The stored reviews, with their keys, writer and batch; empty where none exist.

    The folders are those of now: read the store again once it has been added to.
    """
    return rows_of(spark, path, folders(spark, path))


def read_batch(spark: SparkSession, path: str, writer: str, batch: int) -> DataFrame:
    """The reviews that one batch has added."""
    held = [f for f in folders(spark, path) if f.writer == writer and f.holds(batch)]
    return rows_of(spark, path, held).where(F.col("batch") == batch)


def next_batch(spark: SparkSession, path: str, writer: str = BATCHES) -> int:
    return max((f.batches[-1][1] + 1 for f in folders(spark, path) if f.writer == writer), default=0)


def stored_rows(spark: SparkSession, path: str, but: tuple[str, int] | None = None) -> int:
    """How many reviews are stored, but those of one batch; reads no reviews.

    Every folder's number was noted as it was written.
    """
    return sum(f.rows for f in folders(spark, path)
               if not (but and f.writer == but[0] and f.level == 0 and f.holds(but[1])))


@contextmanager
def locked(spark: SparkSession, path: str, writer: str) -> Iterator[None]:
    """Hold the store for one writer; another one that holds it is an error.

    A writer that was ended at work finds its own lock and goes on.
    """
    files, lock = files_of(spark, f"{path}/_lock/{writer}")
    folder = lock.getParent()
    if files.exists(folder):
        others = [f.getPath().getName() for f in files.listStatus(folder)]
        if set(others) - {writer}:
            raise RuntimeError(f"another writer holds the store: remove {folder} if it is gone")
    files.create(lock, True).close()
    if len(files.listStatus(folder)) > 1:
        files.delete(lock, False)
        raise RuntimeError(f"another writer has just taken the store: {folder}")
    try:
        yield
    finally:
        files.delete(folder, True)


def is_written(spark: SparkSession, path: str, writer: str, batch: int) -> bool:
    """Whether a batch is there as a whole, in its folder or in a merged one."""
    return any(f.writer == writer and f.holds(batch) for f in folders(spark, path))


def _known_keys(first: DataFrame, path: str, held: list[Folder], named: int = NAMED_KEYS) -> DataFrame:
    """The keys of ``first`` (one row each) that are in some of the folders.

    Merged folders are bucketed by the key, so their keys are met where they are:
    the new ones go to the buckets, and no stored one is shuffled. Where the new
    ones are few, buckets that can't hold any of them aren't read.
    """
    spark = first.sparkSession
    single, merged = [f for f in held if not f.level], [f for f in held if f.level]
    known = rows_of(spark, path, single).select(*KEY_COLUMNS).join(
        first.select(*KEY_COLUMNS), KEY_COLUMNS, "left_semi").distinct()
    if not merged:
        return known
    keys = first.select(key_of().alias("k"))
    some = [r["k"] for r in keys.limit(named + 1).collect()]
    stored = bucketed(spark, path, merged).select("k", *KEY_COLUMNS)
    if len(some) <= named:
        stored = stored.where(F.col("k").isin(some))
    return known.unionByName(
        stored.join(keys, "k", "left_semi").select(*KEY_COLUMNS).distinct())


def _write_batch(reviews: DataFrame, path: str, writer: str, batch: int) -> None:
    """Write a folder and note what it holds, as seen by the write itself."""
    folder = f"{path}/writer={writer}/batch={batch}"
    rows, seen = observed(reviews.select(*COLUMNS, *KEY_COLUMNS))
    rows.write.mode("overwrite").parquet(folder)
    write_note(reviews.sparkSession, folder, held_by(seen))


def append_reviews(
    candidates: DataFrame, path: str, batch: int, order: list[str],
    profiles: dict[str, list[str]] | None = None, writer: str = BATCHES, fan: int = FAN,
) -> DataFrame:
    """Add the candidates nobody has stored yet, and return what was added.

    Duplicates and ids are settled on narrow rows of keys and order; the texts
    are written once ahead of that and once at the end. Language, country and
    occasion are worked out for new reviews only. Of reviews with one key and
    one place in the order any may stay. Rows of the same batch of the
    same writer are replaced, unless that batch was merged. Ids go on from the
    highest one in other folders.
    """
    spark = candidates.sparkSession
    with locked(spark, path, writer), own_scratch(spark):
        compact(spark, path, fan)
        held = folders(spark, path)
        if any(f.level and f.writer == writer and f.holds(batch) for f in held):
            return read_batch(spark, path, writer, batch)
        held = [f for f in held if f.writer != writer or not f.holds(batch)]
        rows = staged(with_keys(candidates).withColumn("_row", F.monotonically_increasing_id()))
        first = staged(dedup_first(rows.select(*KEY_COLUMNS, *order, "_row"), [*order, "_row"]))
        fresh = only_new(first, _known_keys(first, path, held))
        last = max((f.last_id for f in held), default=0)
        ids = assign_ids(fresh, order, last).select("_row", "id")
        new = rows.drop("id").join(ids, "_row")
        _write_batch(build_reviews(new, profiles, keep=KEY_COLUMNS), path, writer, batch)
    return read_batch(spark, path, writer, batch)


def import_reviews(reviews: DataFrame, path: str) -> DataFrame:
    """Put saved reviews (the fixed columns) into an empty store as they are.

    Ids and labels are kept and the keys derived, so that later batches go on
    from there. Reviews that are stored already are an error: their ids might
    meet those of the file.
    """
    spark = reviews.sparkSession
    with locked(spark, path, IMPORTS):
        if any(f.rows for f in folders(spark, path)):
            raise ValueError("saved reviews can only be put into an empty store")
        _write_batch(with_keys(reviews.select(*COLUMNS)), path, IMPORTS, 0)
    return read_store(spark, path)
