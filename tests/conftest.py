import os
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from reviewloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = tmp_path_factory.mktemp("checkpoints")
    session = local_session("8", "tests", **{"spark.checkpoint.dir": str(folder)})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def V(spark):
    return F.col("v")


@pytest.fixture
def apply(spark):
    """Values of an expression over one column named v."""
    def run(expression, values, kind="string"):
        table = spark.createDataFrame(
            [(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
        rows = table.select("i", expression.alias("r")).orderBy("i").collect()
        return [r["r"] for r in rows]
    return run
