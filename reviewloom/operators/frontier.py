"""Addresses that are still to be captured."""

from pyspark.sql import DataFrame, Window, functions as F

from reviewloom.functions.urls import has_next_link, next_page_url, page_number
from reviewloom.operators.lookup import missing_from
from reviewloom.operators.skew import WINDOW_LIMIT, ranked_within


def next_pages(pages: DataFrame) -> DataFrame:
    """The following address of every page that has one, once for each address.

    Of several pages that lead to an address, the one of the least page_id stays.
    ``page_num`` is taken from the offset in the address unless it is given.
    """
    if "page_num" not in pages.columns:
        pages = pages.withColumn("page_num", page_number(F.col("url")))
    following = next_page_url(F.col("url"), F.col("page_num"), has_next_link(F.col("html")))
    keep = [c for c in pages.columns if c not in ("url", "html", "page_num")]
    found = pages.select(
        *keep, F.col("url").alias("from_url"), following.alias("url"),
        (F.col("page_num") + 1).alias("page_num"),
    ).where(F.col("url").isNotNull())
    rest = [c for c in found.columns if c != "url"]
    first = F.min(F.struct("page_id", *[c for c in rest if c != "page_id"])).alias("_first")
    return found.groupBy("url").agg(first).select(
        *[F.col(f"_first.{c}") for c in rest], "url")


def crawl_frontier(pages: DataFrame, max_pages: int) -> DataFrame:
    """Next addresses nobody captured yet, up to page number ``max_pages``."""
    open_urls = missing_from(next_pages(pages), pages, ["url"])
    return open_urls.where(F.col("page_num") < max_pages)


def cap_pages(pages: DataFrame, listing: str, max_pages: int) -> DataFrame:
    """The first ``max_pages`` pages of every listing, by offset.

    Where that is more than Spark cuts down ahead of a window, places are counted
    over ranges, so that no listing is sorted by one task.
    """
    if max_pages > WINDOW_LIMIT:
        numbered = pages.withColumn("_offset", page_number(F.col("url")))
        ranked = ranked_within(numbered, [listing], ["_offset", "page_id"], "place")
        return ranked.drop("_offset").where(F.col("place") <= max_pages)
    place = F.row_number().over(
        Window.partitionBy(listing).orderBy(
            page_number(F.col("url")), "page_id"))
    return pages.withColumn("place", place).where(F.col("place") <= max_pages)
