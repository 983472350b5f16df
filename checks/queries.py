"""One query per operator, each over whole tables."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from checks import inputs
from reviewloom.functions.dates import parse_date
from reviewloom.functions.enrichment import (
    detect_language, detect_occasion, infer_country, normalise_language,
)
from reviewloom.functions.text import clean_text, or_unknown, page_title, word_count
from reviewloom.lookups import CITY_COUNTRY
from reviewloom.operators import (
    dedup, extract, filters, frequency, frontier, language, lookup, notes, phrases, reviews,
)
from reviewloom.operators.skew import ranked_within
from reviewloom.plans import ingest, partials, report
from reviewloom.schema import COLUMNS
from reviewloom.session import scratch_dir, staged, tune
from reviewloom.sources import folders, readers, store, writers
from reviewloom.streaming.first import first_in_order, read_first, settle_first, write_first
from reviewloom.streaming.ingest import read_arrivals, store_stream, stream_dedup

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
# A file for each row: tasks move their own files, not the driver all of them.
FILE_EACH = {"maxRecordsPerFile": 1, "mapreduce.fileoutputcommitter.algorithm.version": 2}
ORDER = ["source_priority", "page_id", "pos"]

# Words that occur in the documents, as a caller's own dictionary.
TOPICS = [
    ("english", ["the ", "and "]), ("german", ["nicht", "und "]), ("french", ["les ", "que "]),
]


def query(run: Query) -> Query:
    QUERIES[run.__name__] = lambda spark, sf_dir: run(tune(spark), sf_dir)
    return run


# Frequency tables and statistics

@query
def language_counts(spark, sf_dir):
    return frequency.value_counts(inputs.reviews(spark, sf_dir), "language")


@query
def review_totals(spark, sf_dir):
    return frequency.totals(inputs.reviews(spark, sf_dir))


@query
def dimension_counts(spark, sf_dir):
    return frequency.dimension_counts(inputs.reviews(spark, sf_dir))


@query
def top_cities(spark, sf_dir):
    return frequency.top_values(inputs.reviews(spark, sf_dir), "city")


@query
def top_hosts(spark, sf_dir):
    return frequency.top_values(inputs.reviews(spark, sf_dir), "host_name")


@query
def top_labels_per_dimension(spark, sf_dir):
    counts = frequency.dimension_counts(inputs.reviews(spark, sf_dir))
    return frequency.top_per_dimension(counts).withColumn("place", F.col("place").cast("long"))


@query
def rating_stats(spark, sf_dir):
    return frequency.rating_stats(inputs.reviews(spark, sf_dir))


@query
def date_range(spark, sf_dir):
    return frequency.date_range(inputs.reviews(spark, sf_dir))


@query
def strict_date_range(spark, sf_dir):
    span = frequency.strict_date_range(inputs.reviews(spark, sf_dir))
    return span.select(*[F.col(c).cast("string").alias(c) for c in span.columns])


@query
def report_counts(spark, sf_dir):
    return report.report_counts(inputs.reviews(spark, sf_dir))


@query
def summary_report(spark, sf_dir):
    row = report.summary_report(inputs.reviews(spark, sf_dir))
    return row.select(*[
        F.to_json(c).alias(c) if c in {**report.WHOLE, **report.TOPS} else F.col(c)
        for c in row.columns])


@query
def ingest_counts(spark, sf_dir):
    return frequency.ingest_counts(inputs.reviews(spark, sf_dir))


@query
def ingest_rollup(spark, sf_dir):
    return frequency.ingest_rollup(inputs.reviews(spark, sf_dir))


@query
def running_total(spark, sf_dir):
    counts = frequency.ingest_counts(inputs.reviews(spark, sf_dir))
    return frequency.running_total(counts, ["platform", "region", "host_name"])


# Phrases

@query
def top_phrases(spark, sf_dir):
    english = filters.with_text(filters.in_language(inputs.raw_reviews(spark, sf_dir)))
    return phrases.top_phrases(english)


@query
def phrase_counts(spark, sf_dir):
    english = filters.in_language(inputs.raw_reviews(spark, sf_dir))
    return phrases.phrase_counts(english)


# Text, filters, scalar expressions

@query
def clean_text_pages(spark, sf_dir):
    return inputs.pages(spark, sf_dir).select("page_id", clean_text(F.col("html")).alias("text"))


@query
def clean_text_documents(spark, sf_dir):
    text = clean_text(F.col("text"))
    return inputs.documents(spark, sf_dir).select(
        "doc_id", text.alias("text"), word_count(F.col("text")).cast("long").alias("words"))


@query
def min_words_documents(spark, sf_dir):
    kept = filters.min_words(inputs.documents(spark, sf_dir), "text")
    return kept.select("doc_id", "text")


@query
def drop_block_pages(spark, sf_dir):
    return filters.drop_block_pages(inputs.titled_pages(spark, sf_dir)).select(
        "page_id", page_title(F.col("html")).alias("title"))


@query
def rated_and_dated(spark, sf_dir):
    kept = filters.dated(filters.rated(inputs.reviews(spark, sf_dir)))
    return filters.project_columns(kept)


@query
def parse_dates(spark, sf_dir):
    return inputs.raw_reviews(spark, sf_dir).select(
        "seq", "date_raw", parse_date(F.col("date_raw")).alias("date"))


@query
def page_snippets(spark, sf_dir):
    return inputs.pages(spark, sf_dir).select(
        "page_id", extract.page_snippet(F.col("html")).alias("snippet"))


# Enrichment

@query
def infer_countries(spark, sf_dir):
    place = F.col("reviewer_location")
    return inputs.raw_reviews(spark, sf_dir).select(
        "seq", "reviewer_location", infer_country(place).alias("reviewer_country"))


@query
def detect_occasions(spark, sf_dir):
    docs = inputs.raw_reviews(spark, sf_dir).select(F.col("review_text").alias("text"))
    chat = inputs.conversations(spark, sf_dir).select(F.col("text"))
    return docs.unionByName(chat).select(
        detect_occasion(F.col("text")).alias("occasion"), "text")


@query
def detect_topics(spark, sf_dir):
    return inputs.documents(spark, sf_dir).select(
        "doc_id", detect_occasion(F.col("text"), TOPICS).alias("topic"))


@query
def first_contained_topic(spark, sf_dir):
    """The same topics, from a dictionary held as a table."""
    entries = [(i, word, topic) for i, (topic, words) in enumerate(TOPICS) for word in words]
    dictionary = spark.createDataFrame(entries, "ord int, needle string, label string")
    docs = inputs.documents(spark, sf_dir)
    return lookup.first_contained(docs, "doc_id", "text", dictionary)


@query
def first_contained_country(spark, sf_dir):
    """Cities as the dictionary, each place name looked up once."""
    rows = [(country, city) for country, cities in CITY_COUNTRY for city in cities]
    dictionary = spark.createDataFrame(
        [(i, city, country) for i, (country, city) in enumerate(rows)],
        "ord int, needle string, label string")
    places = inputs.raw_reviews(spark, sf_dir).select("reviewer_location").distinct()
    return lookup.first_contained(
        places, "reviewer_location", "reviewer_location", dictionary)


@query
def normalise_languages(spark, sf_dir):
    return inputs.documents(spark, sf_dir).select(
        "doc_id", normalise_language(F.col("lang")).alias("language"))


@query
def language_profiles(spark, sf_dir):
    trained = language.train_language_profiles(inputs.documents(spark, sf_dir))
    return trained.withColumn("place", F.col("place").cast("long"))


@query
def detect_languages(spark, sf_dir):
    profiles = language.collect_profiles(
        language.train_language_profiles(inputs.documents(spark, sf_dir)))
    return inputs.conversations(spark, sf_dir).select(
        "conv_id", F.col("turn").cast("long").alias("turn"),
        detect_language(F.col("text"), profiles).alias("language"))


@query
def build_reviews(spark, sf_dir):
    return reviews.build_reviews(inputs.raw_reviews(spark, sf_dir)).drop("id")


@query
def build_reviews_languages(spark, sf_dir):
    """Reviews whose language is detected by profiles of the documents."""
    profiles = language.collect_profiles(
        language.train_language_profiles(inputs.documents(spark, sf_dir)))
    return reviews.build_reviews(inputs.raw_reviews(spark, sf_dir), profiles).select(
        "url", "language", "occasion")


@query
def store_languages_stream(spark, sf_dir):
    """Detected languages as they stand in the store, by batch and by stream."""
    target = scratch_dir(spark)
    profiles = language.collect_profiles(
        language.train_language_profiles(inputs.documents(spark, sf_dir)))
    rows = inputs.raw_reviews(spark, sf_dir).drop("language").withColumn("page_id", F.col("seq"))
    store.append_reviews(
        rows.where("seq % 2 = 0"), f"{target}/reviews", 0, ["page_id"], profiles)
    rows.where("seq % 2 = 1").write.parquet(f"{target}/arrivals")
    store_stream(
        read_arrivals(spark, f"{target}/arrivals", rows.schema, 10_000), lambda batch: batch,
        f"{target}/reviews", f"{target}/checkpoint", order=["page_id"],
        language_profiles=profiles).awaitTermination()
    return store.read_store(spark, f"{target}/reviews").groupBy("language").agg(F.count("*").alias("n"))


@query
def detect_languages_by_rank(spark, sf_dir):
    """Languages of the turns by how far their trigrams are out of place."""
    profiles = language.train_language_profiles(inputs.documents(spark, sf_dir))
    turns = inputs.conversations(spark, sf_dir).withColumn("key", F.struct("conv_id", "turn"))
    found = language.detect_by_rank(turns, "key", staged(profiles))
    return found.select(
        "key.conv_id", F.col("key.turn").cast("long").alias("turn"), "language")


@query
def first_indexed_terms(spark, sf_dir):
    """All longer words of the conversations as a dictionary, looked up in whole documents."""
    words = inputs.conversations(spark, sf_dir).select(
        F.explode(F.split(F.lower("text"), "[^\\p{L}]+")).alias("needle"))
    entries = words.where("length(needle) >= 9").distinct().select(
        F.struct(-F.length("needle"), "needle").alias("ord"), "needle", F.upper("needle").alias("label"))
    return lookup.first_indexed(
        inputs.documents(spark, sf_dir), "doc_id", "text", staged(entries))


@query
def unknown_names(spark, sf_dir):
    """Names of which some are empty and some missing, by both rules."""
    name = F.when(F.col("seq") % 3 == 0, "").when(F.col("seq") % 3 == 1, F.col("reviewer_name"))
    return inputs.raw_reviews(spark, sf_dir).select(
        "seq", or_unknown(name).alias("either"), or_unknown(name, empty_too=False).alias("missing"))


@query
def places_in_source(spark, sf_dir):
    """The place of each document in its source by length, for sources of any size."""
    return ranked_within(
        inputs.documents(spark, sf_dir).select("doc_id", "source", "n_chars"), ["source"],
        [F.desc("n_chars"), F.asc("doc_id")]).where("place <= 5000").select(
            "source", "doc_id", F.col("place").cast("long").alias("place"))


# Deduplication, merging, ids

@query
def dedup_first(spark, sf_dir):
    return dedup.dedup_first(inputs.raw_reviews(spark, sf_dir), ["seq"]).select(
        "seq", "reviewer_name", "review_text", "url")


@query
def distinct_keys(spark, sf_dir):
    return dedup.distinct_keys(inputs.raw_reviews(spark, sf_dir))


def _all_sources(spark, sf_dir):
    return dedup.union_sources({
        "documents": inputs.document_reviews(spark, sf_dir),
        "conversations": inputs.chat_reviews(spark, sf_dir),
    })


@query
def union_sources(spark, sf_dir):
    first = dedup.dedup_first(_all_sources(spark, sf_dir), ORDER)
    return first.groupBy("source_priority", "platform").agg(F.count("*").alias("n")) \
        .withColumn("source_priority", F.col("source_priority").cast("long"))


@query
def assign_ids(spark, sf_dir):
    raw = inputs.raw_reviews(spark, sf_dir).select("platform", "seq", F.lit(None).alias("id"))
    return dedup.assign_ids(raw, ["platform", "seq"]).select("id", "platform", "seq")


@query
def merge_new(spark, sf_dir):
    """The stored documents meet all of them again, and the conversations."""
    def keyed(df):
        return dedup.with_keys(df.withColumn("source_priority", F.lit(0)))

    docs = inputs.document_reviews(spark, sf_dir)
    stored = dedup.assign_ids(dedup.dedup_first(keyed(docs), ORDER), ORDER)
    again = docs.withColumn(
        "reviewer_name", F.concat(F.upper("reviewer_name"), F.lit(" ")))
    delta = dedup.union_sources([again, inputs.chat_reviews(spark, sf_dir)])
    columns = ["id", "source_priority", "page_id", "pos", "k_name", "k_text",
               "platform", "reviewer_name", "review_text", "url"]
    merged = dedup.merge_new(stored.select(*columns), dedup.with_keys(delta), ORDER)
    return merged.select("id", "platform", "reviewer_name", "review_text", "url")


# Extraction

@query
def extract_json_ld(spark, sf_dir):
    pages = inputs.raw_reviews(spark, sf_dir).select(
        F.col("seq").alias("page_id"), "url", inputs.json_ld_html().alias("html"))
    listed = lookup.attach_listing(pages, inputs.listings(spark, sf_dir))
    found = extract.extract_json_ld(listed)
    return found.select(
        "page_id", "host_name", "city", "region", "reviewer_name", "date_raw", "rating",
        "review_text")


@query
def extract_embedded_state(spark, sf_dir):
    pages = inputs.raw_reviews(spark, sf_dir).select(
        F.col("seq").alias("page_id"), "url", inputs.state_html().alias("html"))
    return extract.extract_embedded_state(pages).select(
        "page_id", "reviewer_name", "date_raw", "rating", "review_text")


@query
def extract_blocks(spark, sf_dir):
    found = extract.extract_blocks(inputs.block_pages(spark, sf_dir))
    return found.select(
        "page_id", "profile", "reviewer_name", "reviewer_location",
        infer_country(F.col("reviewer_location")).alias("reviewer_country"),
        parse_date(F.col("date_raw")).alias("date"), "rating", "review_text")


@query
def extract_cascade(spark, sf_dir):
    pages = lookup.attach_listing(
        inputs.mixed_pages(spark, sf_dir), inputs.listings(spark, sf_dir))
    found = extract.candidate_rows(extract.extract_reviews(pages))
    return found.select("page_id", "strategy", "reviewer_name", "rating", "review_text")


@query
def first_strategy(spark, sf_dir):
    """Two captures of each address: the first with any result counts."""
    raw = inputs.raw_reviews(spark, sf_dir)
    state = raw.select(F.col("seq").alias("page_id"), "url", inputs.state_html().alias("html"))
    mixed = inputs.mixed_pages(spark, sf_dir).withColumn("profile", F.lit("cesarine"))
    plain = extract.candidate_rows(extract.extract_reviews(mixed)).select(
        "url", "reviewer_name", "review_text", F.lit(0).alias("capture"))
    rendered = extract.extract_embedded_state(state).select(
        "url", "reviewer_name", "review_text", F.lit(1).alias("capture"))
    best = extract.first_strategy(plain.unionByName(rendered), "url", "capture")
    return best.withColumn("capture", F.col("capture").cast("long"))


@query
def pages_without_reviews(spark, sf_dir):
    pages = inputs.pages(spark, sf_dir).withColumn("profile", F.lit("cesarine"))
    return extract.pages_without_reviews(extract.extract_reviews(pages))


@query
def mixed_pages_without_reviews(spark, sf_dir):
    """Those of the derived pages on which nothing is found; most have a review."""
    listed = lookup.attach_listing(inputs.mixed_pages(spark, sf_dir), inputs.listings(spark, sf_dir))
    return extract.pages_without_reviews(extract.extract_reviews(listed)).select("page_id", "url")


@query
def extract_several_blocks(spark, sf_dir):
    """Pages of three reviews each, the second within the first one's element."""
    pages = inputs.nested_pages(spark, sf_dir)
    found = extract.extract_blocks(pages)
    return found.select("page_id", F.col("pos").cast("long").alias("pos"), "reviewer_name", "review_text")


@query
def parse_notes(spark, sf_dir):
    found = notes.parse_notes(inputs.note_files(spark, sf_dir))
    return found.select(
        "url", "reviewer_name", "reviewer_location",
        infer_country(F.col("reviewer_location")).alias("reviewer_country"),
        parse_date(F.col("date_raw")).alias("date"), "review_text")


@query
def next_pages(spark, sf_dir):
    return frontier.next_pages(inputs.result_pages(spark, sf_dir)).select(
        "page_id", "from_url", "url", F.col("page_num").cast("long").alias("page_num"))


@query
def crawl_frontier(spark, sf_dir):
    open_urls = frontier.crawl_frontier(inputs.result_pages(spark, sf_dir), 5)
    return open_urls.select("page_id", "listing", "url")


@query
def cap_pages(spark, sf_dir):
    capped = frontier.cap_pages(inputs.result_pages(spark, sf_dir), "listing", 3)
    return capped.select("listing", "page_id", F.col("place").cast("long").alias("place"))


# From pages to the store, in batch and as a stream

@query
def ingest_pages(spark, sf_dir):
    target = scratch_dir(spark)
    added = ingest.ingest(
        inputs.mixed_pages(spark, sf_dir), inputs.listings(spark, sf_dir), f"{target}/reviews",
        notes=inputs.note_files(spark, sf_dir), metrics_path=f"{target}/metrics")
    return added.drop("writer", "batch")


@query
def ingest_metrics(spark, sf_dir):
    path = scratch_dir(spark)
    chat = inputs.chat_reviews(spark, sf_dir).select(
        "platform", F.lit("Como").alias("region"), F.lit("Unknown").alias("host_name"))
    for _ in range(2):  # the second time replaces the first
        writers.write_metrics(
            frequency.ingest_counts(inputs.reviews(spark, sf_dir)), path, 0)
        writers.write_metrics(frequency.ingest_counts(chat), path, 1)
    return spark.read.parquet(path).groupBy("platform", "region", "host_name").agg(
        F.sum("n").alias("n"))


@query
def store_documents_stream(spark, sf_dir):
    target = scratch_dir(spark)
    source = f"{sf_dir}/documents*.parquet"
    schema = spark.read.parquet(source).schema

    def candidates(batch):
        columns = [c.alias(k) for k, c in inputs.raw_columns().items()]
        return batch.select(*columns).drop("language").withColumn("page_id", F.col("seq"))

    store_stream(
        read_arrivals(spark, source, schema), candidates,
        f"{target}/reviews", f"{target}/checkpoint", order=["page_id"],
    ).awaitTermination()
    return store.read_store(spark, f"{target}/reviews").select(
        "id", "platform", "reviewer_name", "reviewer_country", "rating", "date", "review_text")


def _arrivals(spark, rows, target, slices):
    """``rows`` as files that arrive in several slices, by ``seq``; the last numbers come first."""
    for rest in reversed(range(slices)):
        rows.where(F.col("seq") % slices == rest).write.mode("append").parquet(f"{target}/arrivals")
    return read_arrivals(spark, f"{target}/arrivals", rows.schema, files_per_batch=8)


@query
def stream_distinct_keys(spark, sf_dir):
    """Keys of documents that arrive in several micro-batches, copies among them."""
    target = scratch_dir(spark)
    rows = inputs.raw_reviews(spark, sf_dir).select(
        "seq", "reviewer_name", "review_text", F.timestamp_seconds(F.col("seq") + 86_400).alias("arrived"))
    arrivals = _arrivals(spark, rows, target, 3)
    for _ in range(2):  # the second start finds nothing new
        (
            stream_dedup(arrivals, "arrived", "36500 days").select("k_name", "k_text")
            .writeStream.format("parquet").outputMode("append")
            .option("checkpointLocation", f"{target}/checkpoint").option("path", f"{target}/keys")
            .trigger(availableNow=True).start().awaitTermination()
        )
    return spark.read.parquet(f"{target}/keys")


@query
def stream_first_wins(spark, sf_dir):
    """The first review of each key, most of which arrive behind their copies.

    Half of the files are there when the stream starts, the others when it starts again.
    """
    target = scratch_dir(spark)
    rows = inputs.raw_reviews(spark, sf_dir).withColumn(
        "arrived", F.timestamp_seconds(F.lit(1_700_000_000) - F.col("seq") % 4 * 3600))
    for part in ((3, 2), (1, 0)):
        for rest in part:
            rows.where(F.col("seq") % 4 == rest).write.mode("append").parquet(f"{target}/arrivals")
        arrivals = read_arrivals(spark, f"{target}/arrivals", rows.schema, files_per_batch=8)
        write_first(
            first_in_order(arrivals, ["seq"], "arrived", "30 days"), f"{target}/first",
            f"{target}/checkpoint").awaitTermination()
    settle_first(spark, f"{target}/first", ["seq"])
    return read_first(spark, f"{target}/first", ["seq"]).select(
        "seq", "reviewer_name", "review_text", "url")


@query
def store_compacted(spark, sf_dir):
    """Documents as a stream of many micro-batches, whose folders are merged on the way."""
    target = scratch_dir(spark)
    rows = inputs.raw_reviews(spark, sf_dir).drop("language").withColumn("page_id", F.col("seq"))
    for rest in range(7):
        rows.where(F.col("seq") % 7 == rest).write.mode("append").parquet(f"{target}/arrivals")
        for _ in range(2):  # the second start finds nothing new
            store_stream(
                read_arrivals(spark, f"{target}/arrivals", rows.schema), lambda batch: batch,
                f"{target}/reviews", f"{target}/checkpoint", order=["page_id"], fan=3,
                metrics_path=f"{target}/metrics").awaitTermination()
    held = folders.folders(spark, f"{target}/reviews")
    stored = store.read_store(spark, f"{target}/reviews")
    return stored.select(
        "k_name", "k_text", "id", "batch", F.lit(len(held)).cast("long").alias("folders"),
        F.lit(sum(f.rows for f in held)).cast("long").alias("noted"))


@query
def ingest_totals(spark, sf_dir):
    """What each source added in three batches, and the store's size after it."""
    target = scratch_dir(spark)
    rows = inputs.raw_reviews(spark, sf_dir).drop("language").withColumn("page_id", F.col("seq"))
    for batch in range(3):
        added = store.append_reviews(
            rows.where(F.col("seq") % 3 <= batch), f"{target}/reviews", batch, ["page_id"])
        ingest.log_added(added, f"{target}/reviews", f"{target}/metrics", batch)
    return spark.read.parquet(f"{target}/metrics").select(
        F.col("batch").cast("long").alias("batch"), "platform", "region", "host_name", "n", "total",
        (F.abs(F.col("logged_at").cast("long") - F.unix_timestamp()) < 86_400).alias("logged_now"))


@query
def report_of_batches(spark, sf_dir):
    """The report of ten batches from what each of them left behind."""
    path = scratch_dir(spark)
    rows = inputs.reviews(spark, sf_dir)
    for batch in range(10):
        partials.write_partials(rows.where(F.col("id") % 10 == batch), path, batch)
    row = partials.report_of_batches(spark, path)
    return row.select(*[
        F.to_json(c).alias(c) if c in {**report.WHOLE, **report.TOPS} else F.col(c)
        for c in row.columns])


@query
def merged_figures(spark, sf_dir):
    """Dates and ratings of ten batches; whether the sketched median is near enough."""
    path = scratch_dir(spark)
    rows = inputs.reviews(spark, sf_dir)
    for batch in range(10):
        partials.write_partials(rows.where(F.col("id") % 10 == batch), path, batch)
    figures = partials.merged_figures(spark, path)
    return figures.select("first_date", "last_date", "rating_mean", "rating_count").withColumn(
        "one_median", F.lit(_near_median(rows, figures.first()["rating_median"])))


def _near_median(rows, value):
    below, upto, n = rows.where("rating IS NOT NULL").agg(
        F.count_if(F.col("rating") < value), F.count_if(F.col("rating") <= value), F.count("*")).first()
    return below / n <= 0.5 + frequency.SKETCH_ERROR and upto / n >= 0.5 - frequency.SKETCH_ERROR


@query
def store_in_turns(spark, sf_dir):
    """Even documents as a batch, the others as a stream of several micro-batches."""
    target = scratch_dir(spark)
    docs = inputs.raw_reviews(spark, sf_dir).drop("language").withColumn("page_id", F.col("seq"))
    store.append_reviews(docs.where("seq % 2 = 0"), f"{target}/reviews", 0, ["page_id"])
    for rest in (1, 3):
        docs.where(F.col("seq") % 4 == rest).write.mode("append").parquet(f"{target}/arrivals")
    arrivals = read_arrivals(spark, f"{target}/arrivals", docs.schema, files_per_batch=8)
    for _ in range(2):  # the second start finds nothing new
        store_stream(
            arrivals, lambda batch: batch, f"{target}/reviews", f"{target}/checkpoint",
            order=["page_id"]).awaitTermination()
    rows = store.read_store(spark, f"{target}/reviews")
    whole = rows.agg((F.max("id") == F.count("*")).alias("dense"))
    return rows.crossJoin(F.broadcast(whole)).select(
        "k_name", "k_text", "dense",
        F.when(F.col("writer") == store.BATCHES, 0).otherwise(1).cast("long").alias("turn"))


@query
def import_saved_reviews(spark, sf_dir):
    """The documents as a saved file, put into the store; the conversations follow."""
    target = scratch_dir(spark)
    first = dedup.dedup_first(dedup.with_keys(inputs.document_reviews(spark, sf_dir)), ORDER[1:])
    given = [c for c in COLUMNS if c not in first.columns and c != "id"]
    saved = dedup.assign_ids(first, ORDER[1:]).select(
        "*", *[F.lit(None).cast("double" if c == "rating" else "string").alias(c) for c in given])
    writers.write_reviews_json(saved, f"{target}/saved")
    store.import_reviews(readers.read_reviews_json(spark, f"{target}/saved"), f"{target}/reviews")
    chat = inputs.chat_reviews(spark, sf_dir).select("*", *[
        F.lit(None).cast("double" if c == "rating" else "string").alias(c)
        for c in ("region", "city", "host_name", "reviewer_location", "date_raw", "rating")])
    store.append_reviews(chat, f"{target}/reviews", 0, ORDER[1:])
    return store.read_store(spark, f"{target}/reviews").select(
        "id", "platform", "reviewer_name", "review_text", "url")


@query
def extraction_failures(spark, sf_dir):
    return extract.extraction_failures(inputs.cut_pages(spark, sf_dir))


# Files

@query
def listings_csv(spark, sf_dir):
    """Listings with their options, in a file of another column order."""
    path = scratch_dir(spark)
    listed = inputs.raw_reviews(spark, sf_dir).select(
        F.lit(5).alias("max_pages"), "url", "host_name", (F.col("seq") % 3).alias("source_priority"),
        "city", "region", F.lit("Cesarine").alias("platform"), F.lit("site").alias("profile"))
    listed.write.csv(path, header=True)
    return readers.read_listings(spark, path).select(*[
        F.col(c).cast("long").alias(c) if c in ("max_pages", "source_priority") else c
        for c in listed.columns])


@query
def reviews_csv(spark, sf_dir):
    path = scratch_dir(spark)
    writers.write_reviews_csv(inputs.reviews(spark, sf_dir), path)
    return readers.read_reviews_csv(spark, path)


@query
def reviews_json(spark, sf_dir):
    path = scratch_dir(spark)
    writers.write_reviews_json(inputs.reviews(spark, sf_dir), path)
    return readers.read_reviews_json(spark, path)


@query
def report_json(spark, sf_dir):
    path = scratch_dir(spark)
    report.export_report(inputs.reviews(spark, sf_dir), path)
    maps = [*report.WHOLE, *report.TOPS]
    schema = ", ".join([
        "total_reviews long, reviews_20_words_plus long",
        *[f"{field} map<string,long>" for field in maps],
        "rating_mean double, rating_count long, five_star_pct double"])
    saved = spark.read.schema(schema).json(path)
    return saved.select(*[F.to_json(c).alias(c) if c in maps else F.col(c) for c in saved.columns])


@query
def pages_from_files(spark, sf_dir):
    """The captured pages as a file each, read as bytes and decoded."""
    path = scratch_dir(spark)
    pages = inputs.pages(spark, sf_dir).where("html <> ''")
    pages.select("html").write.options(**FILE_EACH).text(path)
    found = readers.read_page_files(spark, f"{path}/*.txt")
    return found.select(
        F.expr("substring(html, 1, length(html) - 1)").alias("html"), "error")


@query
def ingest_note_files(spark, sf_dir):
    """Notes of several entries, as files of their own, into the store."""
    target = scratch_dir(spark)
    notes_of_five = inputs.note_files(spark, sf_dir).groupBy(
        F.floor(F.col("page_id") / 5).alias("_file")).agg(F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct("page_id", "value"))), lambda x: x["value"]), "\n").alias("value"))
    notes_of_five.select("value").write.options(**FILE_EACH).text(f"{target}/notes")
    none = spark.createDataFrame([], readers.PAGE_SCHEMA)
    added = ingest.ingest(
        none, inputs.listings(spark, sf_dir), f"{target}/reviews",
        notes=readers.read_notes(spark, f"{target}/notes/*.txt"))
    return added.select("platform", "k_name", "k_text")
