"""Canonical review records."""

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from reviewloom.functions.dates import parse_date
from reviewloom.functions.enrichment import detect_language, detect_occasion, infer_country
from reviewloom.schema import COLUMNS


def build_reviews(
    df: DataFrame, profiles: Mapping[str, Sequence[str]] | None = None, keep: Sequence[str] = ()
) -> DataFrame:
    """The fixed columns from candidates that carry their listing.

    Country, language, occasion and date are expressions in one projection.
    An id is kept where there is one. ``keep`` names further columns to carry.
    """
    location = F.col("reviewer_location")
    built = {
        "id": F.col("id") if "id" in df.columns else F.lit(None).cast("long"),
        "reviewer_country": infer_country(location),
        "language": detect_language(F.col("review_text"), profiles),
        "date": parse_date(F.col("date_raw")),
        "occasion": detect_occasion(F.col("review_text")),
    }
    return df.select(
        *keep, *[built[c].alias(c) if c in built else F.col(c) for c in COLUMNS])
