import pytest

from checks.compare import connect
from reviewloom.llm.common import table

FOLDER = "/root/testdata/sf0.001"
#: Columns that operators use for themselves, and texts of every odd kind.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " \
    "size int, row string, _th string, _id int, n int, kept string, copies int, items int, copy int"
LONG = "a line of more than forty characters that several documents share"
PROSE = " ".join(f"word{i}" for i in range(40))


@pytest.fixture(scope="session")
def folder():
    return FOLDER


@pytest.fixture(scope="session")
def db():
    return connect(FOLDER)


@pytest.fixture(scope="session")
def documents(spark):
    return table(spark, FOLDER, "documents")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and long texts, repeated rows, shared ids, clashing names."""
    texts = [
        (1, PROSE, "a"), (1, PROSE, "a"), (2, PROSE, None), (None, PROSE, "a"), (None, PROSE, "a"),
        (None, None, None), (3, None, "b"), (4, "", "b"), (5, " \n\t ", "b"), (6, "x", "b"),
        (7, "x y", "b"), (8, PROSE + " extra", "a"), (9, LONG + "\n" + LONG.upper() + " ", "c"),
        (10, LONG + "\nown", "c"), (11, " " + LONG, "c"), (12, LONG, "c"), (13, LONG + "\n", "c"),
        (14, "é😀 " * 30_000, "d"), (14, "other text of the same id", "d"),
        (15, "the same " * 20_000, "d"),
    ]
    return spark.createDataFrame(
        [(i, t, "en", s, None, 1, "r", "t", 2, 3, "k", 4, 5, 6) for i, t, s in texts], SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame(
        [(1, 1, 0), (2, 0, 0), (None, 1, 0), (6, None, None), (8, 1, 0), (8, 1, 0)],
        "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def benchmark(spark):
    return spark.createDataFrame(
        [(1, PROSE), (2, "x"), (None, "x y"), (4, None), (5, ""), (6, "!"), (7, "the same the same"),
         (7, "the same the same")], "item_id long, text string")
