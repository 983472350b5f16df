"""Review dates, written in many ways, as sortable strings."""

from pyspark.sql import Column, functions as F

from reviewloom.functions.text import SPACE, bind, strip
from reviewloom.lookups import MONTHS

# The date patterns. ``(?U)`` makes digits and word ends those of
# all scripts.
_ISO = r"(?U)(\d{4})-(\d{2})-(\d{2})"
_MONTH_YEAR = rf"(?U)([a-z]+)[{SPACE}]+(\d{{4}})"
_DAY_MONTH_YEAR = r"(?U)(\d{1,2})[/\-.](\d{1,2})[/\-.](\d{4})"
_YEAR = r"(?U)\b(\d{4})\b"


def _month_number(word: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in MONTHS.items() for x in pair])
    return F.try_element_at(table, word)


def parse_date(raw: Column) -> Column:
    """``Y-M-D``, ``Y-M``, ``Y`` or, failing all, the first ten characters.

    Tried in this order: an ISO date anywhere, the first word followed by a
    year if that word is a month, day/month/year (never checked), a lone year.
    """
    return bind(strip(F.coalesce(raw, F.lit(""))), _normalised)


def _normalised(s: Column) -> Column:
    low = F.lower(s)

    def iso(i: int) -> Column:
        return F.regexp_extract(s, _ISO, i)

    def dmy(i: int) -> Column:
        return F.regexp_extract(s, _DAY_MONTH_YEAR, i)

    month = _month_number(F.regexp_extract(low, _MONTH_YEAR, 1))
    year = F.regexp_extract(s, _YEAR, 1)
    return (
        F.when(s.rlike(_ISO), F.concat_ws("-", iso(1), iso(2), iso(3)))
        .when(month.isNotNull(),
              F.concat_ws("-", F.regexp_extract(low, _MONTH_YEAR, 2), month))
        .when(s.rlike(_DAY_MONTH_YEAR),
              F.concat_ws("-", dmy(3), F.lpad(dmy(2), 2, "0"), F.lpad(dmy(1), 2, "0")))
        .when(year != "", year)
        .otherwise(F.substring(s, 1, 10))
    )


def strict_date(date: Column) -> Column:
    """A real date for complete, valid ``Y-M-D`` strings, null for the others."""
    return F.when(date.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(date, "yyyy-MM-dd"))
