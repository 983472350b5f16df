"""The folders of a stored table: which count, what each holds in sum, and merging them.

A writer's batch is a folder of its own. Once a writer has some of them they are
merged into one, and some of those into one of the next level, so that a row is
written again once a level. Merged folders lie below ``_merged`` in Spark's own
bucketed layout, by the review's key.

A folder counts once it is written as a whole and no merged folder that is holds
its batches too. So a merge that was ended at any point shows every row once: until
its last step, the note of what it holds, the old folders count, and from then on
the new one does. Old ones are removed after that, if need be by the next writer.
"""

import json
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce
from hashlib import sha256
from uuid import uuid4

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from reviewloom.schema import KEY_COLUMNS, STORE_SCHEMA

#: Folders of one level that are merged into one of the next.
FAN = 8
#: A file beside a folder's rows: their number, the highest id, the batches.
_NOTE = "_held"


@dataclass(frozen=True)
class Folder:
    """One folder of a writer; ``batches`` are ranges (first, last), level 0 is one batch."""

    path: str
    writer: str
    level: int
    batches: tuple[tuple[int, int], ...]
    rows: int
    last_id: int

    def holds(self, batch: int) -> bool:
        return any(a <= batch <= b for a, b in self.batches)

    @property
    def part(self) -> str:
        return f"{self.level}-{self.batches[0][0]}-{self.batches[-1][1]}"


def files_of(spark: SparkSession, path: str):
    """The file system of a path, and the path as it knows it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), where


def key_of(names: Iterable[str] = KEY_COLUMNS) -> Column:
    """The two key columns as one string; the first one's length keeps them apart."""
    name, text = (F.coalesce(c, F.lit("")) for c in names)
    return F.concat(F.length(name).cast("string"), F.lit(":"), name, text)


def joined_ranges(some: Iterable[tuple[int, int]]) -> list[list[int]]:
    """The same numbers in as few ranges as there can be."""
    out: list[list[int]] = []
    for first, last in sorted(some):
        if out and first <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], last)
        else:
            out.append([first, last])
    return out


def _matches(spark: SparkSession, pattern: str) -> list[str]:
    files, where = files_of(spark, pattern)
    return sorted(s.getPath().getParent().toString() for s in files.globStatus(where) or [])


def _read_note(spark: SparkSession, folder: str) -> dict | None:
    files, where = files_of(spark, f"{folder}/{_NOTE}")
    if not files.exists(where):
        return None
    stream = spark._jvm.java.io.BufferedReader(spark._jvm.java.io.InputStreamReader(files.open(where)))
    try:
        return json.loads(stream.readLine())
    finally:
        stream.close()


def write_note(spark: SparkSession, folder: str, held: dict) -> None:
    """Put down what a folder holds, in one step."""
    files, draft = files_of(spark, f"{folder}/{_NOTE}.{uuid4().hex}")
    out = spark._jvm.java.io.PrintWriter(files.create(draft, True))
    out.println(json.dumps(held))
    out.close()
    _, note = files_of(spark, f"{folder}/{_NOTE}")
    files.delete(note, False)
    files.rename(draft, note)


def _value(folder: str, name: str) -> str | None:
    """The value of ``name=value`` in a path."""
    found = [p.partition("=")[2] for p in folder.split("/") if p.startswith(f"{name}=")]
    return found[-1] if found else None


def _batch_folder(spark: SparkSession, folder: str) -> Folder:
    note = _read_note(spark, folder)
    if note is None:
        # Of an earlier layout, or ended between its rows and its note.
        row = spark.read.schema(STORE_SCHEMA).parquet(folder).agg(
            F.count("*").alias("rows"), F.max("id").alias("last_id")).first()
        note = {"rows": row["rows"], "last_id": row["last_id"] or 0}
        write_note(spark, folder, note)
    batch = int(_value(folder, "batch"))
    return Folder(folder, _value(folder, "writer") or "", 0, ((batch, batch),), note["rows"], note["last_id"])


def all_folders(spark: SparkSession, path: str) -> tuple[list[Folder], list[Folder]]:
    """(those that count, those whose batches a merged one holds) of a store."""
    merged = []
    for folder in _matches(spark, f"{path}/_merged/buckets=*/writer=*/level=*/part=*/{_NOTE}"):
        note = _read_note(spark, folder)
        merged.append(Folder(
            folder, _value(folder, "writer"), int(_value(folder, "level")),
            tuple(map(tuple, note["batches"])), note["rows"], note["last_id"]))
    merged.sort(key=lambda f: -f.level)
    seen: dict[str, list[Folder]] = {}
    counted, covered = [], []
    for f in merged:
        above = seen.setdefault(f.writer, [])
        (covered if any(g.holds(f.batches[0][0]) for g in above) else counted).append(f)
        above.append(f)
    paths = _matches(spark, f"{path}/writer=*/batch=*/_SUCCESS") + _matches(spark, f"{path}/batch=*/_SUCCESS")
    for folder in paths:
        writer, batch = _value(folder, "writer") or "", int(_value(folder, "batch"))
        if any(g.holds(batch) for g in seen.get(writer, [])):
            covered.append(Folder(folder, writer, 0, ((batch, batch),), 0, 0))
        else:
            counted.append(_batch_folder(spark, folder))
    return counted, covered


def folders(spark: SparkSession, path: str) -> list[Folder]:
    return all_folders(spark, path)[0]


def buckets_of(spark: SparkSession, path: str) -> int:
    """Buckets of a store: as many as it has, or as the session's shuffles have partitions."""
    files, where = files_of(spark, f"{path}/_merged/buckets=*")
    found = [int(s.getPath().getName().partition("=")[2]) for s in files.globStatus(where) or []]
    return found[0] if found else int(spark.conf.get("spark.sql.shuffle.partitions"))


def bucketed(spark: SparkSession, path: str, held: list[Folder]) -> DataFrame:
    """The rows of merged folders as a table that Spark knows to be bucketed by ``k``.

    One table for each store, of which the folders are the partitions. A store that
    was made anew with other buckets has another one.
    """
    files, where = files_of(spark, path)
    buckets = buckets_of(spark, path)
    address = f"{files.makeQualified(where).toString()} {buckets}"
    name = "reviewloom_" + sha256(address.encode()).hexdigest()[:24]
    columns = ", ".join(
        f"`{f.name}` {f.dataType.simpleString()}" for f in STORE_SCHEMA.fields if f.name != "writer")
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({columns}, k string, writer string, part string) "
        f"USING parquet PARTITIONED BY (writer, part) CLUSTERED BY (k) SORTED BY (k) "
        f"INTO {buckets} BUCKETS LOCATION '{path}/_merged'")
    wanted = {f"writer={f.writer}/part={f.part}": f for f in held}
    present = {r["partition"] for r in spark.sql(f"SHOW PARTITIONS {name}").collect()}
    for gone in present - set(wanted):
        writer, part = (p.partition("=")[2] for p in gone.split("/"))
        spark.sql(f"ALTER TABLE {name} DROP IF EXISTS PARTITION (writer='{writer}', part='{part}')")
    for new in set(wanted) - present:
        f = wanted[new]
        spark.sql(f"ALTER TABLE {name} ADD IF NOT EXISTS PARTITION (writer='{f.writer}', part='{f.part}') "
                  f"LOCATION '{f.path}'")
    return spark.table(name)


def rows_of(spark: SparkSession, path: str, held: list[Folder]) -> DataFrame:
    """The rows of some folders of a store."""
    tables = []
    for some in ([f.path for f in held if not f.level and f.writer],
                 [f.path for f in held if not f.level and not f.writer]):
        if some:  # those of the earlier layout name no writer, and can't be read with others
            tables.append(spark.read.schema(STORE_SCHEMA).option("basePath", path).parquet(*some))
    if merged := [f for f in held if f.level]:
        tables.append(bucketed(spark, path, merged).select(*STORE_SCHEMA.names))
    return reduce(DataFrame.unionByName, tables) if tables else spark.createDataFrame([], STORE_SCHEMA)


def observed(rows: DataFrame) -> tuple[DataFrame, Observation]:
    """``rows``, and what will be known of them once they are written."""
    seen = Observation()
    return rows.observe(seen, F.count(F.lit(1)).alias("rows"), F.max("id").alias("last_id")), seen


def held_by(seen: Observation) -> dict:
    return {"rows": seen.get["rows"], "last_id": seen.get["last_id"] or 0}


def clear_covered(spark: SparkSession, path: str) -> None:
    """Remove folders whose batches a merged one holds, and merges that weren't finished."""
    for f in all_folders(spark, path)[1]:
        files, where = files_of(spark, f.path)
        files.delete(where, True)
    done = set(_matches(spark, f"{path}/_merged/buckets=*/writer=*/level=*/part=*/{_NOTE}"))
    files, where = files_of(spark, f"{path}/_merged/buckets=*/writer=*/level=*/part=*")
    for status in files.globStatus(where) or []:
        if status.getPath().toString() not in done:
            files.delete(status.getPath(), True)


def merge_folders(spark: SparkSession, path: str, some: list[Folder]) -> None:
    """Write the rows of some folders of a writer and level as one of the next level."""
    level, writer = some[0].level + 1, some[0].writer
    batches = joined_ranges(r for f in some for r in f.batches)
    buckets = buckets_of(spark, path)
    target = f"{path}/_merged/buckets={buckets}/writer={writer}/level={level}/" \
        f"part={batches[0][0]}-{batches[-1][1]}"
    rows = rows_of(spark, path, some).drop("writer").withColumn("k", key_of())
    name = f"reviewloom_{uuid4().hex}"
    # Dealt by the key ahead, a bucket is one file.
    (
        rows.repartition(buckets, "k").write.format("parquet").mode("overwrite")
        .option("path", target).bucketBy(buckets, "k").sortBy("k").saveAsTable(name)
    )
    spark.sql(f"DROP TABLE {name}")  # the files stay
    write_note(spark, target, {
        "rows": sum(f.rows for f in some), "last_id": max(f.last_id for f in some),
        "batches": batches})


def compact(spark: SparkSession, path: str, fan: int = FAN) -> None:
    """Merge the folders of each writer and level that has ``fan`` of them or more."""
    clear_covered(spark, path)
    level = 0
    while True:
        counted = [f for f in folders(spark, path) if f.writer]
        if not any(f.level >= level for f in counted):
            return
        for writer in sorted({f.writer for f in counted}):
            some = [f for f in counted if f.writer == writer and f.level == level]
            if len(some) >= fan:
                merge_folders(spark, path, some)
        clear_covered(spark, path)
        level += 1
