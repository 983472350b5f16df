"""Declared schemas. Files are never read with inferred types."""

from pyspark.sql import types as T

# The columns of the saved files, in their order.
COLUMNS = [
    "id", "platform", "region", "city", "host_name",
    "reviewer_name", "reviewer_location", "reviewer_country",
    "language", "rating", "date", "occasion", "review_text", "url",
]

_TYPES = {"id": T.LongType(), "rating": T.DoubleType()}

REVIEW_SCHEMA = T.StructType(
    [T.StructField(c, _TYPES.get(c, T.StringType())) for c in COLUMNS]
)

KEY_COLUMNS = ["k_name", "k_text"]

# A stored review also carries its two key strings, so that a merge reads two
# short columns of the table and not the review texts.
STORE_SCHEMA = T.StructType(
    REVIEW_SCHEMA.fields
    + [T.StructField(c, T.StringType()) for c in KEY_COLUMNS]
    + [T.StructField("writer", T.StringType()), T.StructField("batch", T.LongType())]
)

PAGE_SCHEMA = T.StructType([
    T.StructField("page_id", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("html", T.StringType()),
])

LISTING_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType())
     for c in ("host_name", "city", "region", "platform", "url")]
)

# Columns that a listing may have besides: how its pages are read, its place in
# the order of arrival, and how many of its pages count.
LISTING_OPTIONS = T.StructType([
    T.StructField("profile", T.StringType()),
    T.StructField("source_priority", T.IntegerType()),
    T.StructField("max_pages", T.IntegerType()),
])

# One raw review inside a page, before cleaning. ``fatal`` marks a value that
# ends its list, ``rating_raw`` is parsed after the text filter has run.
ENTRY_TYPE = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("location", T.StringType()),
    T.StructField("date_raw", T.StringType()),
    T.StructField("rating_raw", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("fatal", T.BooleanType()),
])
ENTRIES_TYPE = T.ArrayType(ENTRY_TYPE)

# What the block locator finds: the fields of a block and the rating hints.
BLOCKS_TYPE = T.ArrayType(T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("location", T.StringType()),
    T.StructField("date_raw", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("label", T.StringType()),
    T.StructField("filled", T.IntegerType()),
    T.StructField("data_rating", T.StringType()),
    T.StructField("data_score", T.StringType()),
    T.StructField("data_stars", T.StringType()),
    T.StructField("fraction", T.StringType()),
]))
