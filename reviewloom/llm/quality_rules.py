"""Quality rules: text statistics, and a decision list learnt from labels.

Null and empty texts have no words and fail. Rows are judged one by one, so
repeated rows agree. Without usable labels the list is empty. An empty table has no
rows. Texts are counted whole. Of conditions of equal gain the first by measure and
threshold is taken. Extra columns are ignored.
"""

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from reviewloom.llm.common import BLANK, BLANKS, let, parts, row_keys
from reviewloom.session import staged

#: Labelled documents the list is learnt from, at most.
SAMPLE = 20_000
WINDOW = 5
#: Fixed value: characters that count as symbols.
SYMBOLS = "[#*$%&|<>]"


def _repeated_words(hashes: Column, window: int) -> Column:
    """Words inside windows that occur twice or more, from the words' hashes."""
    grams = F.transform(
        F.sequence(F.lit(0), F.size(hashes) - window),
        lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(window)]))

    def covered(found):
        ordered = F.sort_array(F.transform(found, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))

        def starts(rows):
            twice = F.filter(rows, lambda x, j: (
                F.coalesce(F.get(rows, j - 1)["g"] == x["g"], F.lit(False))
                | F.coalesce(F.get(rows, j + 1)["g"] == x["g"], F.lit(False))))
            return F.sort_array(F.transform(twice, lambda x: x["i"]))

        def width(at):
            own = F.transform(at, lambda p, j: F.least(
                F.coalesce(F.get(at, j + 1) - p, F.lit(window)), F.lit(window)))
            return F.aggregate(own, F.lit(0).cast("long"), lambda a, x: a + x)

        return let(let(ordered, starts), width)

    some = let(grams, lambda found: F.when(
        F.size(F.array_distinct(found)) < F.size(found), covered(found)).otherwise(F.lit(0).cast("long")))
    return F.when(F.size(hashes) >= window, some).otherwise(F.lit(0).cast("long"))


def _removed(text: Column, pattern: str) -> Column:
    """Characters of ``text`` that the pattern matches."""
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")


def statistics(docs: DataFrame) -> DataFrame:
    """One row of counts for each row of ``docs``."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    again = let(lines, lambda x: F.struct(
        F.size(x).cast("long").alias("n"),
        (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")))
    told = let(parts(text, BLANK), lambda w: F.struct(
        F.size(w).cast("long").alias("n"),
        F.length(F.array_join(w, "")).cast("long").alias("chars"),
        F.size(F.array_distinct(w)).cast("long").alias("distinct"),
        let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: _repeated_words(h, WINDOW))
        .alias("repeat")))
    return docs.select(
        "doc_id", *row_keys(), told.alias("_w"), again.alias("_l"),
        _removed(text, SYMBOLS).alias("n_symbols"), _removed(text, "[A-Z]").alias("n_capitals"),
        _removed(text, "[0-9]").alias("n_digits"), _removed(text, "!").alias("n_shouts"),
    ).select(
        "doc_id", "_id", "_th", F.col("_w.n").alias("n_words"), F.col("_w.chars").alias("word_chars"),
        "n_symbols", F.col("_l.dup").alias("n_dup_lines"), F.col("_w.repeat").alias("n_repeat_words"),
        F.col("_l.n").alias("n_lines"), F.col("_w.distinct").alias("n_distinct"),
        "n_capitals", "n_digits", "n_shouts")


def _share(part: str, whole: str) -> str:
    return f"CASE WHEN {whole} > 0 THEN {part} / {whole} ELSE 0D END"


#: What a rule may set a threshold on, from the counts.
MEASURES = {
    "words": "CAST(n_words AS DOUBLE)",
    "chars_per_word": _share("word_chars", "n_words"),
    "symbols_per_char": _share("n_symbols", "word_chars"),
    "capitals_per_char": _share("n_capitals", "word_chars"),
    "digits_per_char": _share("n_digits", "word_chars"),
    "shouts_per_word": _share("n_shouts", "n_words"),
    "repeated_lines": _share("n_dup_lines", "n_lines"),
    "repeated_words": _share("n_repeat_words", "n_words"),
    "distinct_words": _share("n_distinct", "n_words"),
}


@dataclass(frozen=True)
class Condition:
    measure: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = F.expr(MEASURES[self.measure])
        return value >= F.lit(self.threshold) if self.above else value < F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.measure} {'>=' if self.above else '<'} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def holds(rule: Rule) -> Column:
    out = F.lit(True)
    for condition in rule:
        out = out & condition.column()
    return out


def verdict(rules: list[Rule]) -> Column:
    """The list as one conditional expression: the first rule that holds refuses."""
    out = None
    for rule in rules:
        out = F.when(holds(rule), False) if out is None else out.when(holds(rule), False)
    return F.lit(True) if out is None else out.otherwise(True)


def _grown(rows: DataFrame, marks: list[tuple[str, float]], most: int) -> Rule:
    """Conditions added one by one, each the one of the highest information gain."""
    rule: Rule = ()
    grid = F.array(*[F.struct(F.lit(m).alias("m"), F.lit(t).alias("t")) for m, t in marks])
    value = F.element_at(
        F.create_map(*[x for m, c in MEASURES.items() for x in (F.lit(m), F.expr(c))]), F.col("_g.m"))
    while len(rule) < most:
        cells = (
            rows.where(holds(rule)).select("*", F.explode(grid).alias("_g"))
            .select("bad", F.col("_g.m").alias("m"), F.col("_g.t").alias("t"),
                    (value >= F.col("_g.t")).alias("above"))
            .groupBy("m", "t", "above").agg(F.sum("bad").alias("bad"), F.count("*").alias("n"))
            .collect())
        totals = {}
        for c in cells:
            b, n = totals.get((c["m"], c["t"]), (0, 0))
            totals[c["m"], c["t"]] = (b + c["bad"], n + c["n"])
        best = None
        for c in sorted(cells, key=lambda c: (c["m"], c["t"], c["above"])):
            b, n = totals[c["m"], c["t"]]
            if not c["bad"] or not b:
                continue
            gain = c["bad"] * (math.log2(c["bad"] / c["n"]) - math.log2(b / n))
            if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                best = (gain, Condition(c["m"], c["above"], c["t"]), c["bad"] == c["n"])
        if best is None or best[1] in rule:
            break
        rule += (best[1],)
        if best[2]:
            break
    return rule


def _pruned(rows: DataFrame, rule: Rule, precision: float, least: int) -> Rule:
    """The shortest beginning of ``rule`` that does best on other rows, if good enough."""
    counts = rows.agg(*[
        x for i in range(1, len(rule) + 1) for x in (
            F.coalesce(F.sum(F.when(holds(rule[:i]), F.col("bad"))), F.lit(0)),
            F.count(F.when(holds(rule[:i]), 1)))]).first()
    best, out = -math.inf, ()
    for i in range(len(rule)):
        bad, n = counts[2 * i], counts[2 * i + 1]
        worth = (2 * bad - n) / n if n else -math.inf
        if n and worth > best + 1e-9:
            best, out = worth, (rule[:i + 1] if bad >= precision * n and bad >= least else ())
    return out


def learn(
    stats: DataFrame, labels: DataFrame, sample: int = SAMPLE, rules: int = 8, conditions: int = 3,
    precision: float = 0.95, least: int = 2,
) -> list[Rule]:
    """Rules that refuse documents, by sequential covering.

    A rule is grown on two thirds of the labelled rows and pruned on the others;
    what it covers is set aside, and the next is learnt from the rest. At most
    ``sample`` labelled documents take part, the first by a hash of their
    doc_id. Counts come to the driver, a few for each threshold, never rows.
    """
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
        .groupBy("doc_id").agg((1 - F.min("quality")).cast("long").alias("bad"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    # The broadcast side has ``sample`` rows of two numbers at most.
    rows = staged(
        stats.drop("bad").join(F.broadcast(chosen), "doc_id").dropDuplicates(["_id", "_th"])
        .withColumn("_prune", F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")),
                                     F.lit(3)) == 0))
    ranks = [i / 20 for i in range(1, 20)]
    cuts = rows.agg(*[F.percentile(F.expr(c), F.array(*[F.lit(r) for r in ranks])).alias(m)
                      for m, c in MEASURES.items()]).first().asDict()
    # Half of 1 and the like: shares are often 0 up to a high rank.
    marks = sorted({(m, float(t)) for m, found in cuts.items() for t in found or []}
                   | {(m, t) for m in MEASURES if "_per_" in m or "repeated" in m or "distinct" in m
                      for t in (0.02, 0.05, 0.1, 0.2, 0.3, 0.5)})
    out: list[Rule] = []
    while len(out) < rules:
        left = rows.where(verdict(out))
        grown = _grown(left.where(~F.col("_prune")), marks, conditions)
        rule = _pruned(left.where("_prune"), grown, precision, least) if grown else ()
        if not rule:
            break
        out.append(rule)
    return out


#: Fixed rule of the contract.
BASE_FAILED = "n_words < 10 OR 100 * n_repeat_words > 20 * n_words"


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The statistics of every row, base_failed, and kept by the learnt list."""
    stats = staged(statistics(docs.select("doc_id", "text")))
    rules = learn(stats, labels)
    failed = F.expr(BASE_FAILED)
    return stats.select(
        "*", failed.alias("base_failed"),
        F.when(failed, False).otherwise(verdict(rules)).alias("kept"))


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return judge(docs, labels).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept")
