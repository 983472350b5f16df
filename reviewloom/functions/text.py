"""Text expressions: cleaning, counting, matching. Column in, Column out."""

from collections.abc import Callable, Iterable

from pyspark.sql import Column, functions as F

# White space inside a character class, for patterns that start with ``(?U)``:
# Java's Unicode class, and the four separators that it leaves out.
SPACE = r"\s\x1c-\x1f"

_COMMENT = r"<!--.*?-->"
_HIDDEN = r"<(script|style|template)\b[^>]*>.*?</\1\s*>"


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once per row.

    Written out, an expression is copied to every place that uses it, and
    copies inside conditions are not merged again.
    """
    return F.get(F.transform(F.array(value), body), 0)


def strip(c: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(c, f"(?U)^[{SPACE}]+|[{SPACE}]+$", "")


def single_spaced(c: Column) -> Column:
    """White space runs become one blank, ends are trimmed."""
    return F.trim(F.regexp_replace(c, f"(?U)[{SPACE}]+", " "))


def clean_text(c: Column) -> Column:
    """Tags become a blank, white space runs become one blank, ends are trimmed."""
    return single_spaced(F.regexp_replace(c, "<[^>]+>", " "))


def clean_words(c: Column) -> Column:
    """Number of words in cleaned text, from its blanks."""
    blanks = lambda s: F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))
    return bind(
        F.coalesce(c, F.lit("")), lambda s: F.when(s == "", 0).otherwise(blanks(s) + 1))


def word_count(c: Column) -> Column:
    """Number of white-space separated words; null text counts as none."""
    return clean_words(single_spaced(c))


def has_words(clean: Column, at_least: int) -> Column:
    """Whether cleaned text has enough words."""
    return clean_words(clean) >= at_least


def first_filled(*cols: Column) -> Column:
    """First value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols])


def or_unknown(c: Column, empty_too: bool = True) -> Column:
    """``Unknown`` for a missing name and, where asked, for an empty one."""
    return F.coalesce(F.nullif(c, F.lit("")) if empty_too else c, F.lit("Unknown"))


def contains_any(c: Column, needles: Iterable[str]) -> Column:
    """Whether any of the strings occurs in the text.

    A string that holds another of them adds nothing and is left out. The
    others are one constant array, which keeps the plan short.
    """
    needles = list(dict.fromkeys(needles))
    needed = [n for n in needles if not any(m != n and m in n for m in needles)]
    constants = F.split(F.lit("\n".join(needed)), "\n")
    return F.exists(constants, lambda needle: F.contains(c, needle))


def matches_any_word(c: Column, needles: Iterable[str]) -> Column:
    """Like :func:`contains_any`, but only where whole words match."""
    escaped = "|".join(f"\\Q{needle}\\E" for needle in needles)
    return c.rlike(rf"(?<![\p{{L}}\p{{N}}_])(?:{escaped})(?![\p{{L}}\p{{N}}_])")


def review_key(name: Column, text: Column) -> list[Column]:
    """The two strings that identify a review.

    The text is cut first, then lowered, then trimmed.
    """
    return [
        strip(F.lower(F.coalesce(name, F.lit("")))).alias("k_name"),
        strip(F.lower(F.substring(F.coalesce(text, F.lit("")), 1, 50))).alias("k_text"),
    ]


def page_title(html: Column) -> Column:
    return F.regexp_extract(html, "(?is)<title[^>]*>(.*?)</title>", 1)


def visible_text(html: Column, mark: Column | str = "") -> Column:
    """Text between the tags, without comments, scripts and styles.

    Character references stay as written. ``mark`` takes the place of what is left out.
    """
    mark = F.lit(mark) if isinstance(mark, str) else mark
    shown = F.regexp_replace(html, F.lit(f"(?is){_COMMENT}|{_HIDDEN}"), mark)
    return F.regexp_replace(shown, F.lit("(?s)<[!/a-zA-Z?][^>]*>"), mark)


def snippet(text: Column) -> Column:
    """The short excerpt shown for a page on which nothing was found."""
    return F.substring(F.translate(F.substring(text, 1, 500), "\n", " "), 1, 200)
