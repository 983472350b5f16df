"""Reviews in schema.org JSON-LD scripts, by expressions only."""

from pyspark.sql import Column, functions as F
from pyspark.sql.types import ArrayType

from reviewloom.schema import ENTRIES_TYPE

# One pass over comments, scripts and styles, so that nothing inside a comment
# or another script is taken for a JSON-LD script. Only that one fills group 1.
_SCRIPTS = (
    r"(?is)<!--.*?-->"
    r"""|<script\b(?=[^>]*\stype\s*=\s*["']?application/ld\+json["'\s>])[^>]*>(.*?)</script\s*>"""
    r"|<(script|style)\b[^>]*>.*?</\2\s*>"
)
_FALSY = ["", "0", "0.0", "false", "[]", "{}"]


def _object(v: Column) -> Column:
    """The members of a JSON object, null for any other value."""
    return F.try_variant_get(v, "$", "map<string,variant>")


def _list(v: Column) -> Column:
    """The elements of a JSON array; any other value counts as one element."""
    return F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array(v))


def _value(v: Column, path: str) -> Column:
    """A scalar as text; values that count as false are null."""
    s = F.try_variant_get(v, path, "string")
    return F.when(~s.isin(_FALSY), s)


def _author(r: Column) -> Column:
    author = F.try_variant_get(r, "$.author", "variant")
    inside = _value(r, "$.author.name")
    return (
        F.when(author.isNull() | _object(author).isNotNull(), inside)
        .when(F.is_variant_null(author), F.lit("None"))
        .otherwise(F.try_variant_get(r, "$.author", "string"))
    )


def _rating(r: Column) -> Column:
    """The rating as text. A number 0 means none, the string "0" is a rating."""
    path = "$.reviewRating.ratingValue"
    value = F.try_variant_get(r, path, "variant")
    text = F.try_variant_get(r, path, "string")
    quoted = F.schema_of_variant(value) == "STRING"
    return (
        F.when(text.isNull() | (text == ""), F.lit(None))
        .when(~quoted & text.isin("true", "True"), F.lit("1.0"))
        .when(quoted | ~text.isin(_FALSY), text)
    )


def _entry(r: Column) -> Column:
    text = F.coalesce(_value(r, "$.reviewBody"), _value(r, "$.description"), F.lit(""))
    return F.struct(
        _author(r).alias("name"),
        F.lit("").alias("location"),
        F.coalesce(_value(r, "$.datePublished"), _value(r, "$.dateCreated"), F.lit(""))
        .alias("date_raw"),
        _rating(r).alias("rating_raw"),
        text.alias("text"),
        _object(r).isNull().alias("fatal"),
    )


def _reviews_of(item: Column) -> Column:
    """An item that is a review, or the reviews it has; else no rows.

    An item that is no object at all stays, and ends its script.
    """
    members = _object(item)
    is_review = F.coalesce(
        F.try_variant_get(item, "$['@type']", "string") == "Review", F.lit(False))
    nothing = F.array().cast("array<variant>")
    return (
        F.when(members.isNull() | is_review, F.array(item))
        .when(F.map_contains_key(members, F.lit("review")),
              _list(F.try_variant_get(item, "$.review", "variant")))
        .otherwise(nothing)
    )


def _scripts(html: Column) -> Column:
    return F.filter(F.regexp_extract_all(html, F.lit(_SCRIPTS), 1), lambda s: F.trim(s) != "")


def unreadable_json_ld(html: Column) -> Column:
    """Whether a page has a JSON-LD script that is no JSON."""
    return F.exists(_scripts(html), lambda s: F.try_parse_json(s).isNull())


def json_ld_entries(html: Column) -> Column:
    """Raw reviews per JSON-LD script of a page: an array of entry arrays."""
    parsed = F.filter(F.transform(_scripts(html), F.try_parse_json), lambda v: v.isNotNull())
    reviews = F.transform(
        parsed, lambda v: F.flatten(F.transform(_list(v), _reviews_of)))
    return F.transform(
        reviews, lambda rs: F.transform(rs, _entry)).cast(ArrayType(ENTRIES_TYPE))
