"""Joins of reviews with dictionaries and listings held as tables."""

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F, types as T

from reviewloom.functions.enrichment import windows
from reviewloom.functions.text import strip
from reviewloom.operators.skew import numbered, within
from reviewloom.session import staged

#: Characters of the shortest grams that index a dictionary, but for shorter entries.
GRAM = 5
#: Longer grams, which few texts hold by chance: an entry has those of the largest size that fits.
LONGER = (8, 24)
#: Up to as many entries are looked for in every text, one by one.
PAIRED = 1000
#: Up to as many different grams are broadcast to be filtered by.
LISTED_GRAMS = 500_000
#: Bits of the bitmap by which texts leave out grams when there are more: 32 MB.
GRAM_BITS = 28
#: Of the entries proposed for a text, so many are looked for first, and four times as many in each turn.
TRIED = 16


def first_contained(
    df: DataFrame, key: str, text: str, dictionary: DataFrame,
) -> DataFrame:
    """Label of the first dictionary entry contained in each text: key, label.

    ``dictionary`` has ord, needle, label; the lowest ord wins; ``key`` is
    unique in ``df``; texts without a hit are left out. For dictionaries too
    long for a CASE. Up to ``PAIRED`` entries are broadcast and looked for in each text. With more
    of them "contains" becomes an equality: a text is cut into all substrings of
    the lengths that occur, which are looked up, so no text is compared with every entry.
    """
    entries = dictionary.groupBy(F.lower("needle").alias("needle")).agg(
        F.min(F.struct("ord", "label")).alias("entry"))
    if within(entries, PAIRED):
        held = df.select(F.col(key), strip(F.lower(F.col(text))).alias("_low")).join(
            F.broadcast(entries.where("needle <> ''")), F.expr("contains(_low, needle)"))
        return held.groupBy(key).agg(F.min("entry").alias("entry")).select(
            key, F.col("entry.label").alias("label"))
    lengths = sorted(
        r[0] for r in entries.select(F.length("needle")).where("needle <> ''").distinct().collect())
    if not lengths:
        return df.select(key, F.lit(None).cast("string").alias("label")).limit(0)
    low = strip(F.lower(F.col(text)))
    pieces = F.array_distinct(F.concat(*[windows(low, n) for n in lengths]))
    probes = df.select(F.col(key), F.explode_outer(pieces).alias("needle")).where(
        F.col("needle").isNotNull())
    hits = probes.join(entries, "needle")
    return hits.groupBy(key).agg(F.min("entry").alias("entry")).select(
        key, F.col("entry.label").alias("label"))


def rarest_grams(df: DataFrame, text: str, dictionary: DataFrame, size: int = GRAM) -> DataFrame:
    """Each dictionary entry under one gram: gram, length, needle, entry.

    It is the entry's gram that the fewest texts hold, of equally rare ones the
    least. Entries with grams that no text holds can't occur and are left out. One
    shorter than ``size`` is a gram of its own. Grams are 64-bit numbers.
    """
    entries = dictionary.where(F.col("needle") != "").groupBy(F.lower("needle").alias("needle")).agg(
        F.min(F.struct("ord", "label")).alias("entry")).withColumn("length", _gram_length(F.col("needle"), size))
    grams = staged(entries.select(
        "needle", "entry", "length", F.explode(_numbers("needle", F.array("length"))).alias("gram")))
    wanted = grams.select("gram").distinct()
    few = within(wanted, LISTED_GRAMS)
    found = df.select(F.explode(text_grams(
        F.col(text), _lengths(grams), None if few else _gram_bits(wanted))).alias("gram"))
    # Bits let through grams of no entry besides, which are counted for nothing.
    held = (found.join(F.broadcast(wanted), "gram") if few else found) \
        .groupBy("gram").agg(F.count("*").alias("texts"))
    chosen = F.min(F.struct(F.coalesce("texts", F.lit(0)).alias("texts"), "gram")).alias("_first")
    return (
        grams.join(held, "gram", "left").groupBy("needle", "entry", "length").agg(chosen)
        .where("_first.texts > 0").select("_first.gram", "length", "needle", "entry")
    )


def _gram_length(needle: Column, size: int) -> Column:
    """Characters of an entry's grams: the largest size that fits, or all it has."""
    fits = [F.when(F.length(needle) >= n, n) for n in (*LONGER, size) if n >= size]
    return F.coalesce(F.greatest(*fits) if len(fits) > 1 else fits[0], F.length(needle))


def _lengths(grams: DataFrame) -> list[int]:
    """The lengths of an index's grams: the sizes, and those of entries below the shortest."""
    return sorted(r[0] for r in grams.select("length").distinct().collect())


#: An odd number, the base of the grams' numbers, and its inverse, both modulo 2^64.
BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(BASE, -1, 1 << 64)


def gram_numbers(text: str, sizes: Sequence[int]) -> np.ndarray:
    """The distinct numbers of a text's grams of these sizes: equal for equal grams."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    codes = (codes + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    codes ^= codes >> np.uint64(32)
    sums = np.zeros(len(codes) + 1, np.uint64)
    scale, back = np.full((2, len(codes) + 1), [[BASE], [_INVERSE]], np.uint64)
    scale[0] = back[0] = 1
    scale, back = np.cumprod(scale), np.cumprod(back)
    np.cumsum(codes * scale[:-1], out=sums[1:])
    found = [(sums[n:] - sums[:-n]) * back[:len(codes) - n + 1] + np.uint64(n) for n in sizes if n <= len(codes)]
    return np.unique(np.concatenate(found)).view(np.int64) if found else np.zeros(0, np.int64)


@F.pandas_udf(T.ArrayType(T.LongType()))
def _numbers(texts: pd.Series, sizes: pd.Series) -> pd.Series:
    return pd.Series([gram_numbers(t, s) for t, s in zip(texts, sizes, strict=True)], dtype=object)


def _gram_bits(grams: DataFrame) -> Broadcast:
    """Two bits for each ``gram``, at its first and at its last ``GRAM_BITS`` bits.

    Always of the same size, however many grams there are.
    """
    ends = F.array(F.shiftrightunsigned("gram", 64 - GRAM_BITS),
                   F.col("gram").bitwiseAND(F.lit((1 << GRAM_BITS) - 1)))
    place = F.col("_place")
    found = staged(
        grams.select(F.explode(ends).alias("_place"))
        .groupBy(F.shiftright(place, 15).cast("int").alias("bucket"))
        .agg(F.bitmap_construct_agg(place.bitwiseAND(F.lit(32767))).alias("bits")))
    out = np.zeros(1 << (GRAM_BITS - 3), np.uint8)
    for bucket, bits in found.toLocalIterator():
        out[bucket << 12:(bucket + 1) << 12] = np.frombuffer(bits, np.uint8)
    return grams.sparkSession.sparkContext.broadcast(out)


def _has_bits(numbers: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Whether both bits of each number are set; they are for each gram the bitmap was made of."""
    def is_set(place):
        return (bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1

    bare = numbers.view(np.uint64)
    some = is_set(bare >> np.uint64(64 - GRAM_BITS))
    some[some] = is_set(bare[some] & np.uint64((1 << GRAM_BITS) - 1))
    return some


def _held_numbers(held: Broadcast):
    """:func:`_numbers`, those only whose bits are set in ``held``."""
    @F.pandas_udf(T.ArrayType(T.LongType()))
    def numbers(texts: pd.Series, sizes: pd.Series) -> pd.Series:
        found = (gram_numbers(t, s) for t, s in zip(texts, sizes, strict=True))
        return pd.Series([x[_has_bits(x, held.value)] for x in found], dtype=object)

    return numbers


def text_grams(text: Column, lengths: Sequence[int], held: Broadcast | None = None) -> Column:
    """The distinct grams of these lengths of a lower-cased text, as numbers.

    With ``held``, those whose bits are set there.
    """
    if not lengths:
        return F.array().cast("array<long>")
    low = strip(F.lower(F.coalesce(text, F.lit(""))))
    return (_numbers if held is None else _held_numbers(held))(low, F.array(*[F.lit(n) for n in lengths]))


def first_indexed(
    df: DataFrame, key: str, text: str, dictionary: DataFrame, size: int = GRAM,
) -> DataFrame:
    """What :func:`first_contained` returns, for long dictionaries and whole texts.

    An index holds each entry under its rarest gram only. A text proposes the
    entries under the grams it holds, and those are looked for in it, the lowest
    ``ord`` first, until one is there. Grams are as long as an entry allows, so few
    entries are proposed that the text doesn't hold. They are proposed by their
    numbers in order; an entry itself meets a text only in its turn, ``TRIED`` of
    them first. Of an index too long for a broadcast a bitmap is, so that no
    gram is shuffled but those of the index.
    """
    index = staged(numbered(rarest_grams(df, text, dictionary, size), ["entry", "needle"], "_no"))
    lengths = _lengths(index)
    numbers = index.select("gram", "_no")
    few = within(numbers, LISTED_GRAMS)
    held = None if few else _gram_bits(numbers)
    grams = df.select(F.col(key), F.explode(text_grams(F.col(text), lengths, held)).alias("gram"))
    proposed = staged(
        grams.join(F.broadcast(numbers) if few else numbers, "gram").groupBy(key)
        .agg(F.sort_array(F.collect_set("_no")).alias("_nos")))
    rows, found, tried, many = df.select(key, text), [], 0, TRIED
    while not found or not rows.isEmpty():
        turn = proposed.where(F.size("_nos") > tried).select(
            key, (F.size("_nos") > tried + many).alias("_more"),
            F.explode(F.slice("_nos", tried + 1, many)).alias("_no"))
        if found:
            turn = turn.join(rows.select(key).distinct(), key, "left_semi")
        entries = turn.join(index.select("_no", "needle"), "_no").groupBy(key, "_more").agg(
            F.sort_array(F.collect_list(F.struct("_no", "needle"))).alias("_entries"))
        hit = F.get("_entries", _first_held(strip(F.lower(F.col(text))), F.col("_entries.needle")))["_no"]
        looked = staged(
            rows.join(entries, key).withColumn("_no", hit)
            .select(key, F.expr("IF(_no IS NULL AND _more, 1, 0)").alias("_open"), "_no", text)
            .select(key, F.when(F.col("_open") == 1, F.col(text)).alias(text), "_no")
            .where(F.col("_no").isNotNull() | F.col(text).isNotNull()))
        found.append(looked.where("_no IS NOT NULL").select(key, "_no"))
        rows = looked.where("_no IS NULL").select(key, text)
        tried, many = tried + many, 4 * many
    return reduce(DataFrame.unionAll, found).join(index, "_no").select(key, F.col("entry.label").alias("label"))


@F.pandas_udf(T.IntegerType())
def _first_held(texts: pd.Series, needles: pd.Series) -> pd.Series:
    """The place of the first of a row's needles that is in its text, or null."""
    return pd.Series([
        None if text is None else next((i for i, needle in enumerate(some) if needle in text), None)
        for text, some in zip(texts, needles, strict=True)], dtype="Int32")


def attach_listing(pages: DataFrame, listings: DataFrame, on: str = "url") -> DataFrame:
    """Host, city, region and platform of the page's listing (one per address)."""
    return pages.join(listings, on)


def missing_from(
    df: DataFrame, known: DataFrame, on: Sequence[str],
) -> DataFrame:
    """Rows of ``df`` without a partner in ``known``."""
    return df.join(known.select(*on), list(on), "left_anti")
