"""Dropping lines that many documents share, by levelled runs of line hashes.

Null and empty texts are one empty line. A null doc_id counts as one document
of its own that is never the largest. Rows that share doc_id and text count as
one document, and so do rows that share a doc_id with other texts. An empty table has
no rows. Lines of any length are keyed whole. Extra columns are passed through or
ignored.
"""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from reviewloom.llm.common import BLANKS, lower_ascii, same, text_hash
from reviewloom.session import scratch_dir, staged

KEY = ["_h1", "_h2"]


class LineRuns:
    """Sorted runs of (line hash, documents, largest document), in levels.

    The lines of a batch that are in no run are added as a run of level 0, so
    each line is in one run. Those that are in one are counted in runs of their
    own, ``again``. ``fanout`` runs of a level are merged into one run of the
    next, so that a line is rewritten as often as there are levels and a look-up
    meets few runs. A document must come whole within one batch.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, fanout: int = 4):
        self.spark, self.fanout = spark, fanout
        self.path, self.made = path or scratch_dir(spark), 0
        self.levels: list[list[str]] = [[]]
        self.again: list[list[str]] = [[]]

    def _write(self, rows: DataFrame, levels: list[list[str]], level: int) -> None:
        path = f"{self.path}/run={self.made}"
        self.made += 1
        rows.sortWithinPartitions(*KEY).write.mode("overwrite").parquet(path)
        while len(levels) <= level:
            levels.append([])
        levels[level].append(path)

    def _read(self, levels: list[list[str]]) -> DataFrame | None:
        paths = [p for level in levels for p in level]
        return self.spark.read.parquet(*paths) if paths else None

    def rows(self) -> DataFrame | None:
        """All runs under each other: each line once, as its first batch has it."""
        return self._read(self.levels)

    def unseen(self, lines: DataFrame) -> DataFrame:
        """The rows of ``lines`` whose hash is in no run."""
        runs = self.rows()
        return lines if runs is None else lines.join(runs.select(*KEY), KEY, "left_anti")

    def add(self, lines: DataFrame) -> None:
        """Add a batch of (line hash, doc_id), any number of rows for each."""
        batch = summed(
            lines.groupBy(*KEY, "doc_id").agg(F.lit(1).cast("long").alias("n_docs"))
            .withColumn("last_doc", F.col("doc_id")))
        runs = self.rows()
        if runs is None:
            self._write(batch, self.levels, 0)
        else:
            batch = staged(batch)
            new, seen = self.unseen(batch), batch.join(runs.select(*KEY), KEY, "left_semi")
            self._write(new, self.levels, 0)
            self._write(seen, self.again, 0)
        self.compact()

    def compact(self) -> None:
        """Merge every level that is full into one run of the next."""
        for levels in (self.levels, self.again):
            level = 0
            while level < len(levels):
                if len(levels[level]) >= self.fanout:
                    full = self.spark.read.parquet(*levels[level])
                    self._write(full if levels is self.levels else summed(full), levels, level + 1)
                    levels[level] = []
                level += 1

    def totals(self) -> DataFrame:
        """One row for each line hash: its run's, and what was counted again."""
        first, again = self.rows(), self._read(self.again)
        if again is None:
            return first
        more = summed(again).select(
            *KEY, F.col("n_docs").alias("_more"), F.col("last_doc").alias("_later"))
        return first.join(more, KEY, "left").select(
            *KEY, (F.col("n_docs") + F.coalesce("_more", F.lit(0))).alias("n_docs"),
            F.greatest("last_doc", "_later").alias("last_doc"))


def summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEY).agg(
        F.sum("n_docs").alias("n_docs"), F.max("last_doc").alias("last_doc"))


def line_key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(BLANKS)))


def lines_of(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, _th, _pos, line hash) of every line long enough to be dropped."""
    lines = F.transform(
        F.split(F.coalesce("text", F.lit("")), "\n"),
        lambda line, i: F.struct(i.alias("pos"), line_key(line).alias("key")))
    long_ones = F.filter(lines, lambda x: F.length(x["key"]) >= min_chars)
    return (
        docs.select("doc_id", text_hash(F.col("text")).alias("_th"),
                    F.explode(long_ones).alias("_line"))
        .select("doc_id", "_th", F.col("_line.pos").alias("_pos"),
                F.xxhash64("_line.key").alias("_h1"),
                F.xxhash64(F.lit("second"), "_line.key").alias("_h2"))
    )


def dedup_lines(
    docs: DataFrame, min_chars: int = 40, min_docs: int = 5, batches: int = 4, fanout: int = 4,
) -> DataFrame:
    """Rows (row, n_lines, n_dropped, kept): ``row`` is the row of ``docs``.

    A line whose key (stripped, lower-cased) has at least ``min_chars``
    characters and is found in at least ``min_docs`` documents goes from all of
    them but the one of the largest doc_id. The line hashes are added to the
    runs in ``batches`` parts by doc_id. Hashes have 128 bits.
    """
    spark = docs.sparkSession
    lines = staged(
        lines_of(docs, min_chars)
        .withColumn("_batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int")))
    runs = LineRuns(spark, fanout=fanout)
    for number in range(batches):
        runs.add(lines.where(F.col("_batch") == number))
    # Written, so that adaptive execution can split the join of a hot line.
    shared = staged(runs.totals().where(F.col("n_docs") >= min_docs).select(*KEY, "last_doc"))
    drops = (
        lines.join(shared, KEY).where(~F.col("doc_id").eqNullSafe(F.col("last_doc")))
        .groupBy("doc_id", "_th").agg(F.collect_set("_pos").alias("_drops"))
    )
    split = F.split(F.coalesce("row.text", F.lit("")), "\n")
    rows = docs.select(
        F.struct("*").alias("row"), F.col("doc_id"), text_hash(F.col("text")).alias("_th"))
    none = F.lit(None).cast("array<int>")
    numbers = F.sequence(F.lit(0), F.size(split) - 1)
    kept = F.when(F.col("_drops").isNull(), F.coalesce("row.text", F.lit(""))).otherwise(
        F.array_join(F.transform(
            F.array_except(numbers, F.coalesce("_drops", none)),
            lambda i: F.get(F.col("_lines"), i)), "\n"))
    return (
        rows.join(drops, same(rows, drops, ["doc_id", "_th"]), "left")
        .select("row", "_drops", split.alias("_lines"))
        .select("row", F.size("_lines").cast("long").alias("n_lines"),
                F.coalesce(F.size("_drops"), F.lit(0)).cast("long").alias("n_dropped"),
                kept.alias("kept"))
    )


def query(docs: DataFrame) -> DataFrame:
    return dedup_lines(docs).select(
        "row.doc_id", "n_lines",
        F.when(F.col("n_dropped") < 0, 0).otherwise(F.col("n_dropped")).alias("n_dropped"),
        F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


#: The blanks and the limits of the contract.
ORACLE = r"""
WITH lines AS (
    SELECT doc_id, i, line, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t
    FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                 generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
          FROM documents)),
keyed AS (
    SELECT doc_id, i, line,
           translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
    FROM lines),
shared AS (
    SELECT k, max(doc_id) AS last_doc FROM keyed WHERE length(k) >= 40
    GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (
    SELECT keyed.*, shared.k IS NOT NULL AND doc_id <> last_doc AS dropped
    FROM keyed LEFT JOIN shared USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def without_shared_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """``docs`` with the shared lines gone from ``text``; every row stays."""
    found = dedup_lines(docs, min_chars, min_docs)
    null_stays = F.when(F.col("row.text").isNotNull(), F.col("kept"))
    return found.select(*[
        (null_stays if c == "text" else F.col("row")[c]).alias(c) for c in docs.columns])
