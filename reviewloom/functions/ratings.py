"""Star ratings from the hints found in a review block."""

from pyspark.sql import Column, functions as F

_NUMBER = r"(\d+(?:\.\d+)?)"
_FLOAT = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def number(c: Column) -> Column:
    """A decimal literal as a double, null for any other string."""
    s = F.trim(c)
    return F.when(s.rlike(_FLOAT), s.try_cast("double"))


def block_rating(hints: Column) -> Column:
    """First hint that gives a number: label, filled stars, data value, "x/5"."""
    return F.coalesce(
        number(F.regexp_extract(hints["label"], _NUMBER, 1)),
        F.nullif(F.least(hints["filled"], F.lit(5)).cast("double"), F.lit(0.0)),
        number(hints["data_rating"]),
        number(hints["data_score"]),
        number(hints["data_stars"]),
        number(hints["fraction"]),
    )
