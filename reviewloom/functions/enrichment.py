"""Country, occasion and language labels as column expressions.

The dictionaries are searched in their own order, not in the order of the
text, so each group of neighbouring entries with one label is a branch of a
CASE. That runs inside the scan: no join and no shuffle.
"""

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from reviewloom.functions.text import SPACE, bind, contains_any, matches_any_word, strip
from reviewloom.lookups import (
    CITY_COUNTRY, LANGUAGE_LABELS, OCCASION_KEYWORDS, STATE_CODES,
)

Groups = Sequence[tuple[str, Sequence[str]]]
_TESTS = {"contains": contains_any, "word": matches_any_word}


def first_group(c: Column, groups: Groups, default: Column, match: str = "contains") -> Column:
    """Label of the first group that has any entry in the text."""
    test = _TESTS[match]
    label = default
    for name, needles in reversed(groups):
        label = F.when(test(c, needles), F.lit(name)).otherwise(label)
    return label


def infer_country(
    location: Column, cities: Groups = CITY_COUNTRY,
    states: Sequence[str] = STATE_CODES, match: str = "contains",
) -> Column:
    """Country of a free-text location.

    A known place name anywhere in it, else a US state code among its words.
    """
    def country(low: Column) -> Column:
        is_state = F.exists(F.split(low, f"(?U)[,{SPACE}]+"), lambda word: word.isin(list(states)))
        by_state = F.when(is_state, F.lit("USA")).otherwise(F.lit("Unknown"))
        return first_group(low, cities, by_state, match)

    return F.when(location.isNull() | (location == ""), F.lit("Unknown")).otherwise(
        bind(strip(F.lower(location)), country))


def detect_occasion(
    text: Column, groups: Groups = OCCASION_KEYWORDS, match: str = "contains"
) -> Column:
    return bind(
        F.lower(F.coalesce(text, F.lit(""))),
        lambda low: first_group(low, groups, F.lit("unknown"), match))


def normalise_language(
    code: Column, labels: Mapping[str, str] = LANGUAGE_LABELS, missing: str = "EN"
) -> Column:
    """Label of a language code; unknown codes are ``Other``."""
    label = F.lit("Other")
    for key, name in labels.items():
        label = F.when(code == key, F.lit(name)).otherwise(label)
    return F.when(code.isNull() | (code == ""), F.lit(missing)).otherwise(label)


def letter_runs(text: Column) -> Column:
    """Lower-case letters, all else as single blanks, with a blank at both ends."""
    letters = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}]+", " "))
    return F.concat(F.lit(" "), letters, F.lit(" "))


def windows(c: Column, length: int) -> Column:
    """All substrings of ``length`` characters, in one pass over the text."""
    return F.regexp_extract_all(c, F.lit(f"(?s)(?=(.{{{length}}}))."), 1)


def trigram_codes(runs: str) -> np.ndarray:
    """All trigrams of a text of :func:`letter_runs`, as numbers in the order of the trigrams."""
    c = np.frombuffer(runs.encode("utf-32-le"), "<u4").astype(np.int64)
    return (c[:-2] << 42) | (c[1:-1] << 21) | c[2:]


def trigram_of(code: int) -> str:
    return chr(code >> 42) + chr(code >> 21 & 0x1FFFFF) + chr(code & 0x1FFFFF)


def language_code(text: Column, profiles: Mapping[str, Sequence[str]]) -> Column:
    """Code of the profile that covers most trigrams of the text, else null.

    Ties go to the code that comes first in the alphabet. The profiles are one
    small table of constants, so a text is scored where it is read.
    """
    codes = sorted(profiles)
    held = {c: np.array([trigram_codes(g)[0] for g in profiles[c] if len(g) == 3], np.int64) for c in codes}
    known = np.unique(np.concatenate([np.zeros(1, np.int64), *held.values()]))
    covers = np.stack([np.isin(known, held[c]) for c in codes], 1)

    def code(runs: str | None) -> str | None:
        if runs is None:
            return None
        found = trigram_codes(runs)
        at = np.minimum(np.searchsorted(known, found), len(known) - 1)
        hits = np.bincount(at[known[at] == found], minlength=len(known)) @ covers
        return codes[hits.argmax()] if hits.max() > 0 else None

    @F.pandas_udf(T.StringType())
    def best(texts: pd.Series) -> pd.Series:
        return texts.map(code)

    return best(letter_runs(text))


def detect_language(
    text: Column, profiles: Mapping[str, Sequence[str]] | None = None,
    labels: Mapping[str, str] = LANGUAGE_LABELS,
) -> Column:
    """Language label of a text; ``EN`` for blank text or without profiles."""
    if not profiles:
        return F.lit("EN")
    return normalise_language(language_code(text, profiles), labels)
