"""Character profiles for language detection, trained from labelled texts.

Frequent character n-grams tell languages apart (Cavnar and Trenkle, 1994).
A profile is the most frequent trigrams of a language.
"""

from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

from reviewloom.functions.enrichment import letter_runs, normalise_language, trigram_codes, trigram_of
from reviewloom.lookups import LANGUAGE_LABELS
from reviewloom.operators.skew import within

PROFILE_SIZE = 300


def train_language_profiles(
    df: DataFrame, text: str = "text", lang: str = "lang", size: int = PROFILE_SIZE
) -> DataFrame:
    """The ``size`` most frequent trigrams per language: lang, place, gram, n.

    The texts are counted whole. Each task adds up the trigrams of a batch of texts,
    so a language that holds most of the texts costs it one row per trigram.
    """
    texts = df.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).alias("lang"), letter_runs(F.col(text)).alias("runs"))
    counted = texts.mapInPandas(_counted, "lang string, gram string, n long").groupBy(
        "lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(
        Window.partitionBy("lang").orderBy(F.desc("n"), F.asc("gram")))
    return counted.select("lang", place.alias("place"), "gram", "n").where(
        F.col("place") <= size)


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The trigrams of each language in a batch of texts, counted."""
    for batch in batches:
        for lang, runs in batch.groupby("lang")["runs"]:
            codes, n = np.unique(np.concatenate([trigram_codes(r) for r in runs]), return_counts=True)
            if len(codes):
                yield pd.DataFrame({"lang": lang, "gram": list(map(trigram_of, codes.tolist())), "n": n})


def collect_profiles(profiles: DataFrame) -> dict[str, list[str]]:
    """Trained profiles as constants for the detection expression.

    A few hundred trigrams per language, whatever the number of texts.
    """
    rows = profiles.select("lang", "gram").collect()
    model: dict[str, list[str]] = {}
    for row in rows:
        model.setdefault(row["lang"], []).append(row["gram"])
    return model


def ranked_trigrams(df: DataFrame, key: str, text: str = "text", size: int = PROFILE_SIZE) -> DataFrame:
    """key, gram, place: the ``size`` most frequent trigrams of each text, ties by trigram.

    ``key`` tells the texts apart. Texts are sent to their key's task once, and their
    trigrams are counted there.
    """
    return _ranked(df, key, text, size).drop("_most")


def _ranked(df: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """The ranked trigrams, with the greatest distance that the text can have (``_most``)."""
    texts = df.groupBy(key).agg(F.collect_list(letter_runs(F.col(text))).alias("_runs"))
    ranked = texts.select(key, _most_frequent(F.col("_runs"), F.lit(size)).alias("_grams"))
    return ranked.select(
        key, (F.size("_grams") * size).cast("long").alias("_most"), F.posexplode("_grams").alias("_pos", "gram"),
    ).select(key, "gram", (F.col("_pos") + 1).alias("place"), "_most")


@F.pandas_udf(T.ArrayType(T.StringType()))
def _most_frequent(texts: pd.Series, sizes: pd.Series) -> pd.Series:
    return pd.Series([top_trigrams(t, n) for t, n in zip(texts, sizes, strict=True)], dtype=object)


def top_trigrams(runs: np.ndarray, size: int) -> list[str]:
    """The most frequent trigrams of some texts together, ties by trigram."""
    codes, n = np.unique(
        np.concatenate([np.zeros(0, np.int64), *map(trigram_codes, runs)]), return_counts=True)
    return [trigram_of(c) for c in codes[np.argsort(-n, kind="stable")[:size]].tolist()]


def rank_distances(
    df: DataFrame, key: str, profiles: DataFrame, text: str = "text", size: int = PROFILE_SIZE,
) -> DataFrame:
    """key, lang, distance: how far out of place a text's trigrams are in each language.

    The measure of Cavnar and Trenkle: for each of the text's ``size`` most frequent
    trigrams the difference of its places in text and profile, and ``size`` for one
    that the profile lacks. ``profiles`` (lang, gram, place) are postings by trigram,
    so a trigram meets only the languages that know it: what it spares is
    summed, and taken from the most there can be. Any number of languages will
    do. A text meets no language that shares nothing with it.
    """
    own = _ranked(df, key, text, size)
    known = profiles.where(F.col("place") <= size).select("gram", "lang", F.col("place").alias("_place"))
    postings = F.broadcast(known) if within(known, 1_000_000) else known
    spared = F.sum(F.lit(size) - F.abs(F.col("place") - F.col("_place")))
    return own.join(postings, "gram").groupBy(key, "lang").agg(
        (F.max("_most") - spared).alias("distance")).where(F.col(key).isNotNull())


def detect_by_rank(
    df: DataFrame, key: str, profiles: DataFrame, text: str = "text", size: int = PROFILE_SIZE,
    labels: Mapping[str, str] = LANGUAGE_LABELS,
) -> DataFrame:
    """key, language of every row: the language of the least distance, ties by code.

    ``EN`` for texts that share no trigram with any language.
    """
    best = (
        rank_distances(df, key, profiles, text, size).groupBy(key)
        .agg(F.min(F.struct("distance", "lang")).alias("_best")))
    return df.select(key).join(best, key, "left").select(
        key, F.coalesce(normalise_language(F.col("_best.lang"), labels), F.lit("EN")).alias("language"))
