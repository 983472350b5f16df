"""Row filters and projections over reviews and pages."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from reviewloom.functions.text import bind, clean_text, contains_any, has_words, page_title
from reviewloom.lookups import BLOCKED_TITLE_WORDS, MIN_WORDS
from reviewloom.schema import COLUMNS


def min_words(df: DataFrame, text: str = "review_text", at_least: int = MIN_WORDS) -> DataFrame:
    """Clean the text and keep the rows that still have enough words."""
    return df.withColumn(text, clean_text(F.col(text))).where(has_words(F.col(text), at_least))


def drop_block_pages(
    pages: DataFrame, words: Sequence[str] = tuple(BLOCKED_TITLE_WORDS)
) -> DataFrame:
    """Leave out pages whose title says the request was refused."""
    title = F.coalesce(F.lower(page_title(F.col("html"))), F.lit(""))
    return pages.where(~bind(title, lambda t: contains_any(t, words)))


def in_language(df: DataFrame, label: str = "EN") -> DataFrame:
    return df.where(F.col("language") == label)


def with_text(df: DataFrame) -> DataFrame:
    return df.where(F.col("review_text").isNotNull())


def rated(df: DataFrame) -> DataFrame:
    return df.where(F.col("rating").isNotNull() & ~F.isnan("rating"))


def dated(df: DataFrame) -> DataFrame:
    return df.where(F.col("date").isNotNull() & (F.col("date") != ""))


def project_columns(df: DataFrame) -> DataFrame:
    """The fixed review columns in their order."""
    return df.select(*COLUMNS)
