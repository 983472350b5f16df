"""Reviews in the JSON state a page carries for its own scripts.

The first fitting list in the order of the document counts. Spark's JSON types
order members by name, so the search itself runs in Python, over Arrow batches.
"""

import json
import re

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import BooleanType

from reviewloom.schema import ENTRIES_TYPE

# Members that mark a list of reviews, and where the fields are.
REVIEW_MEMBERS = {"text", "comment", "body", "reviewBody", "review", "content", "message"}
TEXT_MEMBERS = ["text", "comment", "body", "reviewBody", "content", "message"]
AUTHOR_MEMBERS = ["author", "user", "reviewer"]
NAME_MEMBERS = ["name", "username", "firstName"]
DATE_MEMBERS = ["date", "created_at", "createdAt", "publishedAt", "datePublished"]
RATING_MEMBERS = ["rating", "score", "stars", "ratingValue"]
MAX_DEPTH = 8

_STATE = re.compile(
    r"<!--.*?-->"
    r"""|<script\b(?=[^>]*\sid\s*=\s*["']?(?-i:__NEXT_DATA__)["'\s>])[^>]*>(.*?)</script\s*>"""
    r"|<(script|style)\b[^>]*>.*?</\2\s*>",
    re.I | re.S,
)


def _first_list(node, depth=0):
    """First list of review objects below ``node``; lists are not entered."""
    if isinstance(node, list):
        head = node[0] if node else None
        return node if isinstance(head, dict) and REVIEW_MEMBERS & head.keys() else None
    if not isinstance(node, dict) or depth >= MAX_DEPTH:
        return None
    below = (_first_list(value, depth + 1) for value in node.values())
    return next((found for found in below if found), None)


def _pick(record, members):
    """First member that is set to something."""
    return next((record[m] for m in members if record.get(m)), None)


def _text(value):
    """The value as text; half a surrogate pair, as of a cut-off emoji, becomes "?"."""
    return "" if value is None else str(value).encode("utf-8", "replace").decode()


def _entry(record):
    if not isinstance(record, dict):
        return {"fatal": True}
    author = _pick(record, AUTHOR_MEMBERS)
    if isinstance(author, dict):
        author = _pick(author, NAME_MEMBERS)
    rating = _pick(record, RATING_MEMBERS)
    return {
        "name": _text(author),
        "location": "",
        "date_raw": _text(_pick(record, DATE_MEMBERS)),
        "rating_raw": None if rating is None else _text(float(rating) if rating is True else rating),
        "text": _text(_pick(record, TEXT_MEMBERS)),
        "fatal": False,
    }


def _script(html):
    return next((m[1] for m in _STATE.finditer(html) if m[1] is not None), None)


def _unreadable(html):
    script = _script(html)
    if script is None:
        return False
    try:
        json.loads(script)
    except (ValueError, RecursionError):
        return True
    return False


@F.pandas_udf(BooleanType())
def unreadable_state(pages: pd.Series) -> pd.Series:
    """Whether a page has an embedded state that is no JSON."""
    return pages.map(lambda html: None if html is None else _unreadable(html))


def _page_entries(html):
    script = _script(html)
    if script is None:
        return None
    try:
        return [_entry(r) for r in _first_list(json.loads(script)) or []]
    except (ValueError, RecursionError):
        return None


@F.pandas_udf(ENTRIES_TYPE)
def _entries(pages: pd.Series) -> pd.Series:
    return pages.map(lambda html: None if html is None else _page_entries(html))


def embedded_state_entries(html: Column) -> Column:
    """Raw reviews in the embedded state of a page, null where there are none."""
    return _entries(html)
