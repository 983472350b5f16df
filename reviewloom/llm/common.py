"""What the operators of this subpackage share."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from reviewloom.operators.skew import marked, within  # noqa: F401

#: Fixed value: the letters that lower-casing changes; no others.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Blanks, and everything between words, as patterns and characters.
BLANK = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """``text`` with A-Z in lower case and every other letter as it is."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def parts(text: Column, gap: str) -> Column:
    """What stands between the matches of ``gap``; null has no parts."""
    pieces = F.split(F.coalesce(text, F.lit("")), gap)
    return F.filter(pieces, lambda p: p != F.lit(""))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once for the row."""
    return F.transform(F.array(value), body)[0]


def text_hash(text: Column) -> Column:
    """With the doc_id, what tells rows apart that share a doc_id."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def same(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    """Equality of the named columns in which null equals null."""
    out = F.lit(True)
    for name in names:
        out = out & left[name].eqNullSafe(right[name])
    return out


def small(df: DataFrame, rows: int = 50_000, size: int = 4 << 20) -> DataFrame:
    """``df`` marked for a broadcast if it is counted to be small, else as it is."""
    return F.broadcast(df) if within(df, rows, size) else df


#: Stands for a null doc_id in join keys; with it goes the hash of the text.
NO_ID = -(1 << 63)


def row_keys(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """Join keys of a row that are never null: rows equal in both are copies."""
    return [F.coalesce(F.col(doc_id), F.lit(NO_ID)).alias("_id"),
            text_hash(F.col(text)).alias("_th")]
