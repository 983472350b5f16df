"""From captured pages and notes to stored reviews."""

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from reviewloom.functions.urls import first_page_url, page_number
from reviewloom.operators.extract import candidate_rows, extract_reviews
from reviewloom.operators.filters import drop_block_pages
from reviewloom.operators.frequency import ingest_counts, running_total
from reviewloom.operators.notes import parse_notes
from reviewloom.operators.profiles import PROFILES, Profile
from reviewloom.plans.partials import write_partials
from reviewloom.sources.store import BATCHES, append_reviews, next_batch, stored_rows
from reviewloom.sources.writers import write_metrics

# Arrival order: which source, which page of it, which place on the page.
ORDER = ["source_priority", "page_id", "pos"]
_FIELDS = [
    "platform", "region", "city", "host_name", "reviewer_name", "reviewer_location",
    "date_raw", "rating", "review_text", "url",
]


def profile_of(platform: str, profiles: Mapping[str, Profile] = PROFILES):
    """The first profile of a platform, for listings that name none."""
    chosen = F.lit(None).cast("string")
    for name, p in reversed(list(profiles.items())):
        chosen = F.when(F.col(platform) == p.platform, F.lit(name)).otherwise(chosen)
    return chosen


def page_candidates(
    pages: DataFrame, listings: DataFrame, profiles: Mapping[str, Profile] = PROFILES
) -> DataFrame:
    """Candidate reviews of all readable pages that belong to a listing.

    A page belongs to the listing of its address, or else to the one whose
    address is the same without the row offset in either. Listings may name a ``profile``, their ``source_priority`` in the
    order of arrival, and the number of ``max_pages`` that count.
    """
    if "profile" not in listings.columns:
        listings = listings.withColumn("profile", profile_of("platform", profiles))
    if "source_priority" not in listings.columns:
        listings = listings.withColumn("source_priority", F.lit(0))
    listed = _with_listing(drop_block_pages(pages), _listing_of(pages.select("url"), listings))
    if "max_pages" in listings.columns:
        listed = listed.where(page_number(F.col("url")) < F.col("max_pages"))
    rows = candidate_rows(extract_reviews(listed, profiles))
    return rows.select("source_priority", "page_id", "pos", *_FIELDS)


def _listing_of(addresses: DataFrame, listings: DataFrame) -> DataFrame:
    """url, _listing: the listings by their own addresses, and those of all other pages.

    Settled on addresses alone: no page is sent to where its missing key would be.
    """
    rest = F.struct(*[c for c in listings.columns if c != "url"]).alias("_listing")
    exact = listings.select("url", rest)
    # Listings that differ in the offset alone: the first address has the others' pages.
    shared = listings.groupBy(first_page_url(F.col("url")).alias("_first")).agg(
        F.min_by(rest, "url").alias("_listing"))
    others = addresses.distinct().join(exact, "url", "left_anti").select(
        "url", first_page_url(F.col("url")).alias("_first"))
    return exact.unionByName(others.join(shared, "_first").select("url", "_listing"))


def _with_listing(pages: DataFrame, listing_of: DataFrame) -> DataFrame:
    """Pages with the columns of their listing."""
    return pages.join(listing_of, "url").select(*pages.columns, "_listing.*")


def note_candidates(files: DataFrame) -> DataFrame:
    """Candidate reviews of note files, which come ahead of all pages.

    The caller may order the files by a number in ``page_id``.
    """
    if "page_id" not in files.columns:
        files = files.withColumn("page_id", F.xxhash64("path"))
    return parse_notes(files).select(
        F.lit(-1).alias("source_priority"), "page_id", "pos", *_FIELDS)


def ingest(
    pages: DataFrame, listings: DataFrame, store_path: str,
    notes: DataFrame | None = None, metrics_path: str | None = None,
    language_profiles: Mapping[str, Sequence[str]] | None = None,
    batch: int | None = None, partials_path: str | None = None,
) -> DataFrame:
    """Add the new reviews of the given captures to the store; returns them.

    With a ``metrics_path`` it logs what each source has added, and with a
    ``partials_path`` it keeps the batch's part of the report.
    """
    candidates = page_candidates(pages, listings)
    if notes is not None:
        candidates = note_candidates(notes).unionByName(candidates)
    if batch is None:
        batch = next_batch(pages.sparkSession, store_path)
    added = append_reviews(candidates, store_path, batch, ORDER, language_profiles)
    if metrics_path:
        log_added(added, store_path, metrics_path, batch)
    if partials_path:
        write_partials(added, partials_path, batch)
    return added


def log_added(
    added: DataFrame, store_path: str, metrics_path: str, batch: int, writer: str = BATCHES,
) -> None:
    """Reviews added per source, and the size of the table after each source."""
    before = stored_rows(added.sparkSession, store_path, but=(writer, batch))
    counts = running_total(ingest_counts(added), ["platform", "region", "host_name"])
    write_metrics(
        counts.withColumn("total", F.col("total") + F.lit(before)), metrics_path, batch, writer)
