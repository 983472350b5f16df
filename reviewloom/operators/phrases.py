"""The most frequent two to four word phrases of a corpus."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from reviewloom.lookups import STOP_WORDS, TOP_PHRASES
from reviewloom.session import staged

LENGTHS = (2, 3, 4)
MIN_DOCUMENTS = 2
FREQUENT_PARTS = 20_000

#: Phrases are dealt to tasks by as many bits of a hash of their first words.
NUMBER_BITS = 26

_TOKEN = r"([\p{L}\p{N}_]{2,})"


def tokens(text: Column, stop_words: Sequence[str] = tuple(STOP_WORDS)) -> Column:
    """Lower-case words of two or more characters, without the stop words."""
    words = F.regexp_extract_all(F.lower(text), F.lit(_TOKEN), 1)
    return F.filter(words, lambda w: ~w.isin(list(stop_words)))


def runs(words: Column, length: int, least: int | None = None) -> Column:
    """All phrases of ``length`` neighbouring words, in order.

    With ``least``, also the shorter ones at the end that have as many words.
    """
    last = F.size(words) - (length if least is None else least)
    phrases = F.transform(
        F.sequence(F.lit(0), last),
        lambda i: F.concat_ws(" ", *[F.get(words, i + k) for k in range(length)]))
    return F.when(last >= 0, phrases).otherwise(F.array().cast("array<string>"))


def _counts(phrase_lists: DataFrame) -> DataFrame:
    """Total (``tf``) and document (``df``) counts of ``phrases`` arrays.

    Sorting the phrases of a document marks the first of each equal run, so
    both counts come from one aggregation by phrase, combined on the map side.
    """
    ordered = phrase_lists.select(F.array_sort("phrases").alias("p"))
    # An outer explode: for a plain one the optimizer adds a filter on the array,
    # which would build the phrases a second time below the projections.
    marked = ordered.select(F.explode_outer(F.transform(
        "p", lambda g, i: F.struct(
            g.alias("phrase"),
            F.when((i > 0) & (g == F.get(F.col("p"), i - 1)), 0).otherwise(1).alias("is_new"),
        ))).alias("e")).where(F.col("e").isNotNull()).select("e.phrase", "e.is_new")
    return marked.groupBy("phrase").agg(F.count("*").alias("tf"), F.sum("is_new").alias("df"))


def _totals(phrase_lists: DataFrame, min_documents: int) -> DataFrame:
    """Total count of the phrases found in enough documents.

    "At least two documents" needs no document count: the lowest and highest
    row number then differ. That spares the sort of every document's phrases.
    """
    if min_documents > 2:
        return _counts(phrase_lists).where(F.col("df") >= min_documents).select("phrase", "tf")
    rows = phrase_lists.withColumn("doc", F.monotonically_increasing_id()).select(
        "doc", F.explode_outer("phrases").alias("phrase"))
    counted = rows.where(F.col("phrase").isNotNull()).groupBy("phrase").agg(
        F.count("*").alias("tf"), F.min("doc").alias("lo"), F.max("doc").alias("hi"))
    if min_documents == 2:
        counted = counted.where(F.col("lo") < F.col("hi"))
    return counted.select("phrase", "tf")


def _words(df: DataFrame, text: str, stop_words: Sequence[str]) -> DataFrame:
    return df.where(F.col(text).isNotNull()).select(
        tokens(F.col(text), stop_words).alias("words"))


def _phrases(words: DataFrame, lengths: Sequence[int]) -> DataFrame:
    lists = [runs(F.col("words"), n) for n in lengths]
    return words.select((F.concat(*lists) if len(lists) > 1 else lists[0]).alias("phrases"))


def phrase_counts(
    df: DataFrame, text: str = "review_text",
    lengths: Sequence[int] = LENGTHS, stop_words: Sequence[str] = tuple(STOP_WORDS),
    min_documents: int = MIN_DOCUMENTS, bits: int = NUMBER_BITS,
) -> DataFrame:
    """Every phrase found in at least ``min_documents`` texts, with both counts.

    All phrases that begin at one word are shuffled as one row, the longest of them,
    dealt by its first words. So all counts of a phrase meet in one task and nothing
    is shuffled again: a row for each word of the corpus at most, whatever its size.
    Different phrases of one number are dealt together and told apart there.
    """
    lengths = sorted(set(lengths))
    opening = F.col("opening")
    dealt = _openings(_words(df, text, stop_words), lengths).withColumn(
        "number", _number(_first(opening, lengths[0]), bits)).repartition("number")
    # Sorted once by all columns below; each length counts runs of equal phrases in that order.
    names = [f"phrase{k}" for k in lengths]
    counted = dealt.select("number", "n", "differs", *[
        F.when(_first(opening, k) != _first(opening, k - 1), _first(opening, k)).alias(name)
        for k, name in zip(lengths, names)])
    for at, k in reversed(list(enumerate(lengths))):
        equal = Window.partitionBy("number", *names[:at + 1]).orderBy(*(names[at + 1:] or names[-1:]))
        all_equal = equal.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        counted = counted.withColumn(f"count{k}", F.struct(
            F.col(names[at]).alias("phrase"), F.sum("n").over(all_equal).alias("tf"),
            F.count_if(F.col("differs") <= k).over(all_equal).alias("df"),
            (F.row_number().over(equal) == 1).alias("is_first")))
    each = counted.select(F.explode(F.array(*[f"count{k}" for k in lengths])).alias("c")).select("c.*")
    kept = F.col("is_first") & F.col("phrase").isNotNull() & (F.col("df") >= min_documents)
    return each.where(kept).select("phrase", "tf", "df")


def _openings(words: DataFrame, lengths: Sequence[int]) -> DataFrame:
    """(opening, n, differs): a text's different runs of the longest length, and how often.

    Sorted, openings that begin with the same phrase are neighbours, since a space
    comes before every character of a word. ``differs`` is the least length from
    which an opening's phrases are new in its text.
    """
    p, starts = F.col("p"), F.col("starts")

    def differs(i):
        now, before = F.get(p, i), F.get(p, i - 1)
        least = F.lit(lengths[-1])
        for k in reversed(lengths[:-1]):
            least = F.when(_first(now, k).eqNullSafe(_first(before, k)), least).otherwise(k)
        return least

    ordered = words.select(F.sort_array(runs(F.col("words"), lengths[-1], lengths[0])).alias("p"))
    # Of an empty array the one place is null, and no start.
    marked = ordered.select("p", F.filter(
        F.sequence(F.lit(0), F.greatest(F.size("p") - 1, F.lit(0))),
        lambda i: F.get(p, i).isNotNull() & ~F.get(p, i).eqNullSafe(F.get(p, i - 1))).alias("starts"))
    return marked.select(F.explode_outer(F.transform("starts", lambda i, at: F.struct(
        F.get(p, i).alias("opening"),
        (F.coalesce(F.get(starts, at + 1), F.size("p")) - i).alias("n"),
        differs(i).alias("differs")))).alias("e")).where(F.col("e").isNotNull()).select("e.*")


def _first(phrase: Column, length: int) -> Column:
    return F.substring_index(phrase, " ", length)


def _number(phrase: Column, bits: int) -> Column:
    """The number, from 1 on, that a phrase is dealt by."""
    return F.xxhash64(phrase).bitwiseAND(F.lit((1 << bits) - 1)) + 1


def top_phrases(
    df: DataFrame, k: int = TOP_PHRASES, text: str = "review_text",
    lengths: Sequence[int] = LENGTHS, stop_words: Sequence[str] = tuple(STOP_WORDS),
    min_documents: int = MIN_DOCUMENTS, max_parts: int = FREQUENT_PARTS,
) -> DataFrame:
    """The ``k`` phrases with the highest total count, ties by phrase.

    Only the shortest phrases are counted in full. The ``k``-th of them sets a
    count that every result must reach, and a longer phrase occurs at most as
    often as any shorter one inside it. So longer phrases are formed only where
    all their parts are frequent enough, which leaves next to nothing to
    shuffle. Where too many parts tie at the limit, all lengths are counted.
    """
    shortest, longer = min(lengths), [n for n in lengths if n > min(lengths)]
    ranked = [F.desc("tf"), F.asc("phrase")]
    words = _words(df, text, stop_words)
    base = _totals(_phrases(words, [shortest]), min_documents)
    if not longer:
        return base.orderBy(*ranked).limit(k)

    base = staged(base)
    best = base.orderBy(*ranked).limit(k).agg(
        F.min("tf").alias("tf"), F.count("*").alias("n")).first()
    floor = best["tf"] if best["n"] == k else 0
    frequent = base.where(F.col("tf") >= floor)
    parts = [r["phrase"] for r in frequent.select("phrase").limit(max_parts + 1).collect()]
    if len(parts) > max_parts:
        return _totals(_phrases(words, lengths), min_documents).orderBy(*ranked).limit(k)
    if not parts:
        return frequent.limit(0)

    marked = words.select(
        "words",
        F.transform(runs(F.col("words"), shortest), lambda p: p.isin(parts)).alias("ok"))
    grown = marked.select(
        F.concat(*[_runs_of_frequent(n, shortest) for n in longer]).alias("phrases"))
    extended = _totals(grown, min_documents).where(F.col("tf") >= floor)
    return frequent.unionByName(extended).orderBy(*ranked).limit(k)


def _runs_of_frequent(length: int, part: int) -> Column:
    """Phrases of ``length`` words all of whose parts are marked in ``ok``."""
    words, ok = F.col("words"), F.col("ok")
    last = F.size(words) - length
    starts = F.filter(
        F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>")),
        lambda i: _all([F.get(ok, i + j) for j in range(length - part + 1)]))
    return F.transform(
        starts, lambda i: F.concat_ws(" ", *[F.get(words, i + k) for k in range(length)]))


def _all(flags: Sequence[Column]) -> Column:
    both = flags[0]
    for flag in flags[1:]:
        both = both & flag
    return both
