"""Addresses of the following result page."""

from pyspark.sql import Column, functions as F

# How an address writes the row offset, and rows to a page.
_OFFSET = r"-or(\d+)-"
_WRITTEN = r"-or(\d+)(?:-|\.html)"
_PAGE_SIZE = 10


def page_offset(url: Column) -> Column:
    """Row offset inside the address, null where there is none."""
    return F.regexp_extract(url, _OFFSET, 1).try_cast("long")


def page_number(url: Column) -> Column:
    """0 for a first page, counted up by the offset in the address."""
    offset = F.regexp_extract(url, _WRITTEN, 1).try_cast("long")
    return F.coalesce(F.floor(offset / _PAGE_SIZE).cast("int"), F.lit(0))


def first_page_url(url: Column) -> Column:
    """The address of the listing that a result page belongs to."""
    return F.regexp_replace(url, r"-or\d+(?=-|\.html)", "")


def has_next_link(html: Column) -> Column:
    """A link whose class, or any element whose label, says "next"."""
    link = r"""<a\b[^>]*?\sclass\s*=\s*(?:"[^"]*next|'[^']*next|[^\s"'>]*next)"""
    label = r"""<[a-z][^>]*?\saria-label\s*=\s*(?:"[^"]*next|'[^']*next|[^\s"'>]*next)"""
    return html.rlike(f"(?is)(?:{link})|(?:{label})")


def next_page_url(url: Column, page_num: Column, has_next: Column) -> Column:
    """Address after ``url``, or null where there is none.

    An offset in the address moves on by one page. A first page without one
    gets it, if a next link was seen: ahead of the last ``-Reviews-``, or else
    in place of the last ``.html`` and what follows it.
    """
    moved = F.regexp_replace(
        url, F.lit(_OFFSET),
        F.concat(F.lit("-or"), (page_offset(url) + _PAGE_SIZE).cast("string"), F.lit("-")),
    )
    first = (page_num == 0) & has_next
    return (
        F.when(page_offset(url).isNotNull(), moved)
        .when(first & F.contains(url, F.lit("-Reviews-")),
              F.regexp_replace(url, "(?s)^(.*)-Reviews-", f"$1-or{_PAGE_SIZE}-Reviews-"))
        .when(first & F.contains(url, F.lit(".html")),
              F.regexp_replace(url, r"(?s)^(.*)\.html.*$", f"$1-or{_PAGE_SIZE}.html"))
    )
