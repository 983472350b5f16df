"""Pages in, candidate reviews out: the first strategy that finds any wins.

The strategies of a page are tried inside its row, so a page is read once and
choosing between them needs no shuffle.
"""

from collections.abc import Callable, Mapping
from html import unescape

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from reviewloom.functions.ratings import block_rating, number
from reviewloom.functions.text import (
    clean_text, clean_words, has_words, or_unknown, snippet, visible_text,
)
from reviewloom.functions.urls import page_number
from reviewloom.lookups import MIN_WORDS
from reviewloom.operators.blocks import block_entries
from reviewloom.operators.embedded_state import embedded_state_entries, unreadable_state
from reviewloom.operators.json_ld import json_ld_entries, unreadable_json_ld
from reviewloom.operators.profiles import PROFILES, Profile
from reviewloom.session import staged

Profiles = Mapping[str, Profile]


def accepted(lists: Column, min_words: int = MIN_WORDS) -> Column:
    """Clean raw reviews, list by list, and keep those with enough words.

    A value that cannot be read ends its list; reviews ahead of it stay.
    """
    def clean(e: Column) -> Column:
        return F.struct(
            or_unknown(e["name"]).alias("reviewer_name"),
            e["location"].alias("reviewer_location"),
            e["date_raw"].alias("date_raw"),
            number(e["rating_raw"]).alias("rating"),
            clean_text(F.coalesce(e["text"], F.lit(""))).alias("review_text"),
            e["fatal"].alias("fatal"),
            e["rating_raw"].isNotNull().alias("has_rating"),
        )

    def ends(c: Column) -> Column:
        unread = c["has_rating"] & c["rating"].isNull()
        return c["fatal"] | (unread & has_words(c["review_text"], min_words))

    def ahead_of_end(cleaned: Column) -> Column:
        at = F.array_position(F.transform(cleaned, ends), True)
        return F.slice(cleaned, 1, F.when(at > 0, at - 1).otherwise(F.size(cleaned)).cast("int"))

    kept = F.flatten(F.transform(
        F.transform(lists, lambda entries: F.transform(entries, clean)), ahead_of_end))
    return F.transform(
        F.filter(kept, lambda c: has_words(c["review_text"], min_words)), _candidate)


def _candidate(c: Column) -> Column:
    names = ("reviewer_name", "reviewer_location", "date_raw", "rating", "review_text")
    return F.struct(*[c[n].alias(n) for n in names])


def _per_profile(profile: Column, profiles: Profiles, value: Callable[[Profile], Column]) -> Column:
    chosen = F.lit(None)
    for name, p in profiles.items():
        chosen = F.when(profile == name, value(p)).otherwise(chosen)
    return chosen


def accepted_blocks(blocks: Column, profile: Column, profiles: Profiles = PROFILES) -> Column:
    """Clean raw blocks and keep those with enough words for their profile."""
    fixed = _per_profile(profile, profiles, lambda p: F.lit(p.default_rating).cast("double"))
    rated = _per_profile(profile, profiles, lambda p: F.lit(p.rated))
    least = _per_profile(profile, profiles, lambda p: F.lit(p.min_words))

    def clean(b: Column) -> Column:
        return F.struct(
            F.coalesce(clean_text(b["name"]), F.lit("Unknown")).alias("reviewer_name"),
            F.coalesce(clean_text(b["location"]), F.lit("")).alias("reviewer_location"),
            F.coalesce(clean_text(b["date_raw"]), F.lit("")).alias("date_raw"),
            F.when(rated, block_rating(b)).otherwise(fixed).alias("rating"),
            clean_text(F.coalesce(b["text"], F.lit(""))).alias("review_text"),
        )

    return F.filter(
        F.transform(blocks, clean), lambda c: clean_words(c["review_text"]) >= least)


def extract_reviews(pages: DataFrame, profiles: Profiles = PROFILES) -> DataFrame:
    """Add ``strategy`` and the array ``candidates`` to pages with a ``profile``.

    JSON-LD is read by expressions. The two Python steps receive a page only
    if an earlier strategy of its profile came up empty.
    """
    profile, html = F.col("profile"), F.col("html")

    def those(fits: Callable[[Profile], bool]) -> Column:
        return profile.isin([name for name, p in profiles.items() if fits(p)])

    def ranks(p: Profile, first: str, second: str) -> bool:
        order = list(p.strategies)
        return {first, second} <= set(order) and order.index(first) < order.index(second)

    found = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    json_ld_first = those(lambda p: ranks(p, "json_ld", "state"))
    later_page = those(lambda p: p.state_on_first_page_only) & (page_number(F.col("url")) > 0)

    read = pages.withColumn(
        "_json_ld",
        F.when(those(lambda p: "json_ld" in p.strategies) & html.rlike("(?i)application/ld"),
               accepted(json_ld_entries(html))))
    needs_state = (
        those(lambda p: "state" in p.strategies) & ~later_page
        & F.contains(html, F.lit("__NEXT_DATA__"))
        & ~(json_ld_first & found(F.col("_json_ld"))))
    read = read.withColumn("_state_raw", embedded_state_entries(F.when(needs_state, html)))
    read = read.withColumn("_state", accepted(F.array("_state_raw")))
    by_data = found(F.col("_json_ld")) | found(F.col("_state"))
    needs_blocks = those(lambda p: "blocks" in p.strategies) & ~by_data
    read = read.withColumn(
        "_blocks_raw", block_entries(F.when(needs_blocks, html), profile, profiles))
    read = read.withColumn("_blocks", accepted_blocks(F.col("_blocks_raw"), profile, profiles))

    use_json_ld = found(F.col("_json_ld")) & (json_ld_first | ~found(F.col("_state")))
    strategy = (
        F.when(use_json_ld, F.lit("json_ld"))
        .when(found(F.col("_state")), F.lit("state"))
        .when(found(F.col("_blocks")), F.lit("blocks")))
    candidates = (
        F.when(use_json_ld, F.col("_json_ld"))
        .when(found(F.col("_state")), F.col("_state"))
        .otherwise(F.col("_blocks")))
    return read.select(
        *pages.columns, strategy.alias("strategy"), candidates.alias("candidates"))


def candidate_rows(extracted: DataFrame) -> DataFrame:
    """One row per candidate, in page order, with the page's other columns."""
    others = [c for c in extracted.columns if c not in ("html", "candidates")]
    return (
        extracted.select(*others, F.posexplode_outer("candidates").alias("pos", "_c"))
        .where(F.col("pos").isNotNull())
        .select(*others, "pos", "_c.*")
    )


def entry_rows(pages: DataFrame, lists: Column, min_words: int = MIN_WORDS) -> DataFrame:
    """Candidates of a single strategy, given its raw lists per page."""
    return candidate_rows(pages.withColumn("candidates", accepted(lists, min_words)))


def extract_json_ld(pages: DataFrame) -> DataFrame:
    return entry_rows(pages, json_ld_entries(F.col("html")))


def extract_embedded_state(pages: DataFrame) -> DataFrame:
    return entry_rows(pages, F.array(embedded_state_entries(F.col("html"))))


def extract_blocks(pages: DataFrame, profiles: Profiles = PROFILES) -> DataFrame:
    """Candidates from the markup alone; pages carry a ``profile``."""
    located = pages.withColumn(
        "_raw", block_entries(F.col("html"), F.col("profile"), profiles))
    kept = located.withColumn(
        "candidates", accepted_blocks(F.col("_raw"), F.col("profile"), profiles))
    return candidate_rows(kept.drop("_raw"))


def first_strategy(
    candidates: DataFrame, group: str, rank: str
) -> DataFrame:
    """Of several attempts per group, the rows of the first with any result.

    For attempts held in separate rows, such as two captures of one address.
    The lowest rank per group is a map-side minimum; of the join back, adaptive
    execution splits a hot group over many tasks.
    """
    candidates = staged(candidates)
    best = candidates.groupBy(group).agg(F.min(rank).alias(rank))
    return candidates.join(best, [group, rank], "left_semi")


#: Characters of a text that an excerpt is made from.
SNIPPET_FROM = 500


@F.pandas_udf(T.StringType())
def _plain(texts: pd.Series, marks: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else "".join(map(unescape, t.split(m)))
                      for t, m in zip(texts, marks, strict=True)], dtype=object)


def page_snippet(html: Column) -> Column:
    """The short excerpt of a page's text, character references resolved.

    A tag ends a reference: what stands on both sides of one makes none. Python
    sees a text only if there is a reference in the part that is shown.
    """
    # A page can't hold its own digest, which marks where tags were.
    mark = F.concat(F.lit("\0"), F.md5(html), F.lit("\0"))

    def shown(text: Column) -> Column:
        written = F.contains(F.substring(text, 1, SNIPPET_FROM), F.lit("&"))
        marked = F.when(written, visible_text(html, mark))
        return snippet(F.when(written, _plain(marked, mark)).otherwise(text))

    return shown(visible_text(html))


def extraction_failures(pages: DataFrame) -> DataFrame:
    """(page_id, strategy, error): pages with embedded data that can't be read."""
    html = F.col("html")
    has_state = F.contains(html, F.lit("__NEXT_DATA__"))
    failed = F.array_compact(F.array(
        F.when(html.rlike("(?i)application/ld") & unreadable_json_ld(html), F.lit("json_ld")),
        F.when(unreadable_state(F.when(has_state, html)), F.lit("state"))))
    return pages.select("page_id", F.explode(failed).alias("strategy")).withColumn(
        "error", F.lit("not JSON"))


def pages_without_reviews(extracted: DataFrame) -> DataFrame:
    """Pages no strategy found anything on, with a short excerpt of their text."""
    return extracted.where(F.col("strategy").isNull()).select(
        "page_id", "url", page_snippet(F.col("html")).alias("snippet"))
