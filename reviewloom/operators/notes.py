"""Reviews kept by hand in Markdown notes."""

from pyspark.sql import Column, DataFrame, functions as F

from reviewloom.functions.text import SPACE, bind, clean_text, has_words, strip
from reviewloom.lookups import MIN_WORDS_FREE_TEXT

# What comes after the repeated lines matches nothing as well, so they never
# have to be given back: the possessive signs change no match, and spare the
# engine a call on its stack for every line.
# Fixed value: **Name** from Place - date, an optional line of stars, a text of
# twenty or more characters in optional quotes.
_NOTE = (
    rf"(?mU)\*\*([^*]+)\*\*[{SPACE}]*(?:from[{SPACE}]+([^\n—–-]+?))?[{SPACE}—–-]+([^\n]+)?\n"
    r"(?:[★\*]{1,5}[^\n]*\n)?"
    rf"[\"“”]?[{SPACE}]*([^\"“”\n]{{20,}}(?:\n(?!\*\*)[^\n]{{0,200}}+)*+)"
    r"[\"“”]?"
)


def _entries(value: Column, min_words: int) -> Column:
    """Name, place, date and text of every entry, from one pass of the pattern.

    Each match is rewritten as its groups between marks, and the file is cut at
    the marks. A digest of the file is a mark that the file cannot contain.
    """
    def cut(file: Column, mark: Column) -> Column:
        groups = [part for i in range(1, 5) for part in (F.lit(f"${i}"), mark)]
        return F.split(F.regexp_replace(file, F.lit(_NOTE), F.concat(mark, *groups)), mark)

    def entries(parts: Column) -> Column:
        # A piece of other text stands ahead of every match and after the last.
        found = ((F.size(parts) - 1) / 5).cast("int")
        places = F.when(found > 0, F.sequence(F.lit(0), found - 1))
        read = F.transform(places, lambda k: F.struct(
            strip(F.get(parts, k * 5 + 1)).alias("reviewer_name"),
            strip(F.get(parts, k * 5 + 2)).alias("reviewer_location"),
            strip(F.get(parts, k * 5 + 3)).alias("date_raw"),
            clean_text(F.get(parts, k * 5 + 4)).alias("review_text")))
        return F.filter(read, lambda e: has_words(e["review_text"], min_words))

    return bind(value, lambda file: bind(
        F.concat(F.lit("#"), F.sha2(file, 256)),
        lambda mark: bind(cut(file, mark), entries)))


def parse_notes(files: DataFrame, min_words: int = MIN_WORDS_FREE_TEXT) -> DataFrame:
    """Candidate reviews of whole note files (path, value), in file order.

    Further columns of the files are carried along.
    """
    others = [c for c in files.columns if c not in ("path", "value")]
    found = files.select(
        F.col("path").alias("url"), *others,
        F.posexplode_outer(_entries(F.col("value"), min_words)).alias("pos", "m"))
    return found.where(F.col("pos").isNotNull()).select(
        "url", *others, "pos",
        F.lit("Блог").alias("platform"), F.lit("Como").alias("region"),
        F.lit("Como").alias("city"), F.lit("Unknown").alias("host_name"),
        F.lit(None).cast("double").alias("rating"), "m.*")
