"""Session settings the operators rely on, and shared scratch storage."""

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Of members of one name in a JSON object the last counts.
    "spark.sql.variant.allowDuplicateKeys": "true",
    # An HTML page is large: bound an Arrow batch by rows as well as by bytes.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "500",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings above to a session made by somebody else."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: str = "*", app: str = "reviewloom", **conf: str) -> SparkSession:
    """A single-machine session for tests and measurements."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", "8")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


_current: ContextVar[str | None] = ContextVar("scratch", default=None)


def scratch_dir(spark: SparkSession) -> str:
    """A fresh path under the shared folder named by ``spark.checkpoint.dir``.

    Only a session whose master is this machine may fall back to a temporary
    folder; on a cluster that folder would be lost with its executor.
    """
    base = _current.get() or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="reviewloom-")
    return f"{base.rstrip('/')}/reviewloom-{uuid.uuid4().hex}"


@contextmanager
def own_scratch(spark: SparkSession) -> Iterator[None]:
    """Put everything staged inside into one folder, and remove it at the end.

    For work whose result is written elsewhere before the block ends.
    """
    folder = scratch_dir(spark)
    token = _current.set(folder)
    try:
        yield
    finally:
        _current.reset(token)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


#: Ends an execution by removing its shuffle files (from Spark 4.1 on); else the driver's garbage collector does, some time.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(df: DataFrame) -> DataFrame:
    """Write ``df`` once to shared storage and return the written table.

    Used where two later steps must see the same rows, whatever tasks are run
    again in between. Shuffles of the writing aren't kept.
    """
    spark, path = df.sparkSession, scratch_dir(df.sparkSession)
    before = spark.conf.get(TIDY, None)
    spark.conf.set(TIDY, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(TIDY)
        else:
            spark.conf.set(TIDY, before)
    return spark.read.schema(df.schema).parquet(path)
