"""First-wins deduplication, merging into stored reviews, dense ids."""

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from reviewloom.functions.text import review_key
from reviewloom.operators.skew import marked, numbered
from reviewloom.schema import KEY_COLUMNS
from reviewloom.session import staged


def with_keys(df: DataFrame) -> DataFrame:
    """Add the two key columns unless the table already carries them."""
    if set(KEY_COLUMNS) <= set(df.columns):
        return df
    return df.select("*", *review_key(F.col("reviewer_name"), F.col("review_text")))


def distinct_keys(df: DataFrame) -> DataFrame:
    return with_keys(df).select(*KEY_COLUMNS).distinct()


def dedup_first(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Keep the first review of every key in arrival order.

    The first row is a minimum, so every task reduces its copies of a key to
    one row before the shuffle. A window would send all copies to one task.
    """
    keyed = with_keys(df)
    rest = [c for c in keyed.columns if c not in KEY_COLUMNS and c not in order]
    first = F.min(F.struct(*order, *rest)).alias("_first")
    return (
        keyed.groupBy(*KEY_COLUMNS).agg(first)
        .select(*[F.col(c) if c in KEY_COLUMNS else F.col(f"_first.{c}").alias(c)
                  for c in keyed.columns])
    )


def only_new(df: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows of ``df`` (one per key) whose key is not among the stored ones.

    The stored keys are first reduced to those that occur in ``df``. That side
    is the smaller one, so it can be broadcast when the planner sees its size,
    and the stored keys then need no shuffle.
    """
    keyed = with_keys(df)
    known = with_keys(stored).select(*KEY_COLUMNS).join(
        keyed.select(*KEY_COLUMNS), KEY_COLUMNS, "left_semi").distinct()
    return keyed.join(known, KEY_COLUMNS, "left_anti")


def union_sources(sources: Mapping[str, DataFrame] | Sequence[DataFrame]) -> DataFrame:
    """All sources under each other; the first source has the first say."""
    frames = list(sources.values()) if isinstance(sources, Mapping) else list(sources)
    ranked = [df.withColumn("source_priority", F.lit(i)) for i, df in enumerate(frames)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ranked)


def assign_ids(df: DataFrame, order: Sequence[str], stored_count: int = 0) -> DataFrame:
    """Dense ids in arrival order, going on from the number of stored rows."""
    return (
        numbered(df.drop("id"), order, "id")
        .withColumn("id", F.col("id") + F.lit(stored_count).cast("long"))
    )


def merge_new(stored: DataFrame, delta: DataFrame, order: Sequence[str]) -> DataFrame:
    """The stored reviews, unchanged, followed by the new ones of ``delta``.

    Which keys are new is settled on the keys alone. Rows with a stored key are
    left out where they are read, so only new ones are shuffled whole.
    """
    rows = staged(with_keys(delta))
    keys = staged(only_new(distinct_keys(rows), stored).select(*[F.col(c).alias(f"_new_{c}") for c in KEY_COLUMNS]))
    new = marked(rows, [F.col(c) for c in KEY_COLUMNS], keys, keys.columns).where("_marked").drop("_marked")
    is_new = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_new_{c}")) for c in KEY_COLUMNS])
    fresh = assign_ids(dedup_first(new.join(keys, is_new, "left_semi"), order), order, stored.count())
    return stored.unionByName(fresh.select(*stored.columns))
