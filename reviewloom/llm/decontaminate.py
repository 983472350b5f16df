"""Benchmark passages in documents, by a positional inverted index.

Exact windows decide what is contaminated; ``proximity`` tells what is near.
Null texts have no words. Rows that share doc_id and text are one document and
get the same result. An item without words has no windows. Items whose item_id is
null hit as any other, and count together as one item. Empty tables have no rows, and no
items hit nothing. Documents and items of any length are compared whole. Extra columns are
ignored. Words are compared by 64-bit hashes, thirteen of them at a time.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from reviewloom.llm.common import GAP, lower_ascii, marked, parts, same, small, text_hash
from reviewloom.session import staged


def words(text: Column) -> Column:
    return parts(lower_ascii(text), GAP)


def terms(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    """(item_id, tokens, item): ``item`` tells apart what differs in either, and is never null."""
    return (
        benchmark.select("item_id", terms(F.col("text")).alias("tokens"))
        .where(F.size("tokens") > 0).distinct()
        .withColumn("item", F.xxhash64("item_id", "tokens")))


def document_frequency(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(term, df) of every term of ``vocabulary`` that some document holds."""
    return (
        docs.select(F.explode(F.array_distinct(terms(F.col("text")))).alias("term"))
        .join(small(vocabulary), "term", "left_semi")
        .groupBy("term").agg(F.count("*").alias("df"))
    )


def postings(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, _th, pos, term) of every place of the wanted terms."""
    return (
        docs.select("doc_id", text_hash(F.col("text")).alias("_th"),
                    F.posexplode(terms(F.col("text"))).alias("pos", "term"))
        .join(small(wanted), "term", "left_semi")
    )


def rarest_terms(items: DataFrame, frequency: DataFrame, window: int) -> DataFrame:
    """(item, t1, q1, t2, q2, t3, q3, lo, reach): the three rarest terms of each window.

    ``q`` is the place in the item. Windows with the same three are one row: they
    lie in the ``reach`` words from ``lo`` on, fewer than two windows. A window with a
    term that no document holds cannot occur and is left out.
    """
    size = F.least(F.size("tokens"), F.lit(window))
    starts = F.sequence(F.lit(0), F.size("tokens") - size)
    placed = (
        items.select("item", "tokens", size.alias("_size"), F.explode(starts).alias("_start"))
        .select("item", "_start", "_size", F.explode(F.transform(
            F.slice("tokens", F.col("_start") + 1, F.col("_size")),
            lambda t, j: F.struct(t.alias("term"), (F.col("_start") + j).alias("q")))).alias("_t"))
        .select("item", "_start", "_size", "_t.term", "_t.q")
    )
    found = (
        placed.join(frequency, "term")
        .groupBy("item", "_start", "_size")
        .agg(F.sort_array(F.collect_list(F.struct("df", "term", "q"))).alias("_t"))
        .where(F.size("_t") == F.col("_size"))
    )
    pick = [F.coalesce(F.get("_t", F.lit(i)), F.get("_t", F.lit(0))) for i in range(3)]
    names = [f"{c}{i}" for i in range(1, 4) for c in "tq"]
    return (
        found.select("item", "_start", "_size", *[
            c for i, p in enumerate(pick, 1)
            for c in (p["term"].alias(f"t{i}"), p["q"].alias(f"q{i}"))])
        .groupBy("item", "_size", *names)
        .agg(F.min("_start").alias("lo"), F.max("_start").alias("_hi"))
        .select("item", *names, "lo", (F.col("_hi") - F.col("lo") + F.col("_size")).alias("reach"))
    )


def aligned(index: DataFrame, rarest: DataFrame) -> DataFrame:
    """(doc_id, _th, item, delta, lo, reach): places where the rarest terms of a window meet.

    The postings of the rarest term come first; those of the second and third
    are met at their offset from it.
    """
    found = (
        index.withColumnRenamed("term", "t1").join(rarest, "t1")
        .withColumn("delta", F.col("pos") - F.col("q1"))
        .select("doc_id", "_th", "item", "delta", "t2", "q2", "t3", "q3", "lo", "reach").distinct()
    )
    for i in (2, 3):
        places = index.select(
            F.col("doc_id").alias("_doc"), F.col("_th").alias("_hash"), F.col("pos").alias("_pos"),
            F.col("term").alias("_term"))
        found = found.join(
            places, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_th") == F.col("_hash"))
            & (F.col("_pos") == F.col("delta") + F.col(f"q{i}"))
            & (F.col("_term") == F.col(f"t{i}")), "left_semi")
    return found.select("doc_id", "_th", "item", "delta", "lo", "reach").distinct()


def occurrences(
    docs: DataFrame, benchmark: DataFrame, window: int = 13,
) -> DataFrame:
    """(doc_id, _th, item_id, places): document words inside windows of an item.

    One row for each place where windows were proposed and at least one is whole;
    ``places`` are word numbers from 0. An item shorter than ``window`` is one
    window. Exact. A row holds fewer than two windows of words, however long the item is.
    """
    items = staged(benchmark_items(benchmark))
    frequency = staged(document_frequency(
        docs, items.select(F.explode("tokens").alias("term")).distinct()))
    rarest = staged(rarest_terms(items, frequency, window))
    wanted = rarest.select(F.explode(F.array("t1", "t2", "t3")).alias("term")).distinct()
    index = staged(postings(docs, wanted))
    found = staged(aligned(index, rarest).groupBy("doc_id", "_th").agg(
        F.collect_list(F.struct("item", "delta", "lo", "reach")).alias("_at")))
    texts = marked(
        docs.select("doc_id", text_hash(F.col("text")).alias("_th"), "text"),
        [F.col("doc_id"), F.col("_th")], found, ["doc_id", "_th"]).where("_marked")

    def cut(a):
        begin = a["delta"] + a["lo"]
        skip = F.greatest(-begin, F.lit(0))
        return F.struct(
            a["item"].alias("item"), a["lo"].alias("lo"), a["reach"].alias("reach"), begin.alias("begin"),
            skip.alias("skip"), F.slice(F.col("_doc_tokens"), F.greatest(begin, F.lit(0)) + 1,
                                        F.greatest(a["reach"] - skip, F.lit(0))).alias("part"))

    near = (
        texts.join(found.select(F.col("doc_id").alias("_doc"), F.col("_th").alias("_hash"), "_at"),
                   F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_th") == F.col("_hash")))
        .select("doc_id", "_th", "_at", terms(F.col("text")).alias("_doc_tokens"))
        .dropDuplicates(["doc_id", "_th"])
        .select("doc_id", "_th", F.explode(F.transform("_at", cut)).alias("_a"))
        .select("doc_id", "_th", "_a.*")
    )
    pieces = (
        rarest.select("item", "lo", "reach").distinct().join(items, "item")
        .select("item", "lo", "reach", "item_id", F.least(F.size("tokens"), F.lit(window)).alias("_size"),
                F.slice("tokens", F.col("lo") + 1, F.col("reach")).alias("tokens")))
    equal = F.transform(
        F.col("tokens"),
        lambda t, j: F.coalesce(
            F.when(j >= F.col("skip"), F.get(F.col("part"), j - F.col("skip")) == t), F.lit(False)))
    starts = F.filter(
        F.sequence(F.lit(0), F.size("tokens") - F.col("_size")),
        lambda i: F.forall(F.slice("_equal", i + 1, F.col("_size")), lambda x: x))
    return (
        near.join(pieces, ["item", "lo", "reach"])
        .select("doc_id", "_th", "item_id", "begin", "tokens", "_size", equal.alias("_equal"))
        .select("doc_id", "_th", "item_id", "begin", "_size", starts.alias("_starts"))
        .where(F.size("_starts") > 0)
        .select("doc_id", "_th", "item_id", F.array_distinct(F.flatten(F.transform(
            "_starts", lambda s: F.sequence(
                F.col("begin") + s, F.col("begin") + s + F.col("_size") - 1)))).alias("places"))
    )


def near_terms(items: DataFrame, frequency: DataFrame, window: int) -> DataFrame:
    """(item, item_id, terms): the three rarest different terms of each window, sorted.

    Of those that some document holds; a window of fewer terms has them all. A
    window of which documents hold fewer is left out. Equal sets of an item are one.
    """
    size = F.least(F.size("tokens"), F.lit(window))
    starts = F.sequence(F.lit(0), F.size("tokens") - size)
    placed = (
        items.select("item", "item_id", "tokens", size.alias("_size"), F.explode(starts).alias("_start"))
        .select("item", "item_id", "_start", F.array_distinct(
            F.slice("tokens", F.col("_start") + 1, F.col("_size"))).alias("_w"))
        .select("item", "item_id", "_start", F.least(F.size("_w"), F.lit(3)).alias("_n"),
                F.explode("_w").alias("term"))
    )
    return (
        placed.join(frequency, "term")
        .groupBy("item", "item_id", "_start", "_n")
        .agg(F.sort_array(F.collect_list(F.struct("df", "term"))).alias("_t"))
        .where(F.size("_t") >= F.col("_n"))
        .select("item", "item_id", F.sort_array(
            F.transform(F.slice("_t", F.lit(1), F.col("_n")), lambda t: t["term"])).alias("terms"))
        .distinct()
    )


def proximity(
    docs: DataFrame, benchmark: DataFrame, window: int = 13, distance: int = 26,
) -> DataFrame:
    """(doc_id, _th, item_id, n_sets, n_near, start, stop): items that a document comes near to.

    An item has ``n_sets`` sets of rarest terms, one for each window, equal ones
    once. Of these, ``n_near`` stand in the document, in any order, within
    ``distance`` words; the closest is from word ``start`` to ``stop``, which isn't
    in it. One row for each document and benchmark text with any. An exact
    occurrence is near as well, if ``distance`` is at least ``window``. A document
    that lacks a rarest term of every window isn't near, whatever else it shares.
    """
    items = staged(benchmark_items(benchmark))
    frequency = staged(document_frequency(
        docs, items.select(F.explode("tokens").alias("term")).distinct()))
    sets = staged(near_terms(items, frequency, window))
    wanted = sets.select("terms").distinct().select("terms", F.explode("terms").alias("term"))
    index = postings(docs, wanted.select("term").distinct()).distinct()
    # Where each term of a set stood last, so that a long document is read once.
    so_far = Window.partitionBy("doc_id", "_th", "terms").orderBy("pos").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    last = [
        F.max(F.when(F.col("term") == F.coalesce(F.get("terms", F.lit(i)), F.get("terms", F.lit(0))),
                     F.col("pos"))).over(so_far).alias(f"p{i}")
        for i in range(3)]
    spans = (
        index.join(small(wanted), "term")
        .select("doc_id", "_th", "terms", F.col("pos"), *last)
        .where("p0 IS NOT NULL AND p1 IS NOT NULL AND p2 IS NOT NULL")
        .select("doc_id", "_th", "terms", F.least("p0", "p1", "p2").alias("start"),
                (F.col("pos") + 1).alias("stop"))
        .where(F.col("stop") - F.col("start") <= distance)
        .groupBy("doc_id", "_th", "terms")
        .agg(F.min(F.struct((F.col("stop") - F.col("start")).alias("size"), "start", "stop")).alias("_s"))
    )
    number = sets.groupBy("item").agg(F.count("*").alias("n_sets"))
    return (
        spans.join(small(sets), "terms")
        .groupBy("doc_id", "_th", "item", "item_id")
        .agg(F.count("*").alias("n_near"), F.min("_s").alias("_s"))
        .join(small(number), "item")
        .select("doc_id", "_th", "item_id", "n_sets", "n_near", "_s.start", "_s.stop")
    )


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13) -> DataFrame:
    """(row, n_words, n_hit, items): every row of ``docs`` with what hits it.

    ``items`` are the item_ids with occurring windows as sorted strings; a null
    comes first and stands for all items without an item_id.
    """
    found = staged(occurrences(docs, benchmark, window))
    hits = (
        found.select("doc_id", "_th", F.explode("places").alias("_p")).distinct()
        .groupBy("doc_id", "_th").agg(F.count("*").alias("n_hit")))
    # In structs, since a set of values leaves out null.
    which = found.groupBy("doc_id", "_th").agg(F.sort_array(F.transform(
        F.collect_set(F.struct(F.col("item_id").cast("string").alias("id"))),
        lambda x: x["id"])).alias("items"))
    # One row for each document that is hit.
    result = hits.join(which, same(hits, which, ["doc_id", "_th"])).select(
        hits["doc_id"].alias("_doc"), hits["_th"].alias("_hash"), "n_hit", "items")
    gap = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    rows = docs.select(
        F.struct("*").alias("row"), F.col("doc_id").alias("_id"),
        text_hash(F.col("text")).alias("_th"),
        F.size(parts(F.col("text"), gap)).cast("long").alias("n_words"))
    # Documents that nothing hits, by far the most, need no shuffle.
    rows = marked(rows, [F.col("_id"), F.col("_th")], found, ["doc_id", "_th"])
    clean = rows.where("NOT _marked").select(
        "row", "n_words", F.lit(0).cast("long").alias("n_hit"),
        F.array().cast("array<string>").alias("items"))
    return clean.unionByName(
        rows.where("_marked").join(result, F.col("_id").eqNullSafe(F.col("_doc")) & (F.col("_th") == F.col("_hash")),
                  "left")
        .select("row", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    )


#: Fixed rule: a document is contaminated if a twentieth of its words is hit.
CONTAMINATED = "n_hit > 0 AND 20 * n_hit >= n_words"


def query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    narrow = docs.select("doc_id", "text")
    return contamination(narrow, benchmark).select(
        "row.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        F.expr(CONTAMINATED).alias("contaminated"))


ORACLE = r"""
WITH d AS (
    SELECT doc_id, regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
    SELECT item_id, regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
    SELECT DISTINCT item_id, least(len(w), 13) AS n, w[i:i + least(len(w), 13) - 1] AS win
    FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i
          FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (
    SELECT doc_id, n, i, w[i:i + n - 1] AS win
    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)
    WHERE w[i] IN (SELECT win[1] FROM windows)),
hits AS (SELECT doc_id, item_id, i, places.n FROM places JOIN windows USING (win)),
hit_words AS (
    SELECT doc_id, count(DISTINCT p) AS n_hit
    FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
hit_items AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
    FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM hits) GROUP BY doc_id)
SELECT doc_id, coalesce(len(w), 0) AS n_words, coalesce(n_hit, 0) AS n_hit,
       coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= coalesce(len(w), 0) AS contaminated
FROM d LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = 13) -> DataFrame:
    """The rows of ``docs`` that aren't contaminated."""
    return contamination(docs, benchmark, window).where(f"NOT ({CONTAMINATED})").select("row.*")
