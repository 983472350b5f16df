"""Secrets in documents, by an inverted index of trigrams.

Every rule's pattern gives a Boolean trigram query. Its postings are
intersected, and the pattern is run only on the documents that are left; a
pattern without a mandatory trigram is run on all.

Null and empty texts have no spans. Rows that share doc_id and text share their
postings and get the same result. An empty table has no rows. Texts are matched whole.
Spans of one start go in the order of the rules. Extra columns are ignored.
"""

from dataclasses import dataclass

try:  # the standard library's own parser of patterns, under its names of now and before
    from re import _constants as kinds, _parser as regex_parser
except ImportError:
    import sre_constants as kinds
    import sre_parse as regex_parser

from pyspark.sql import Column, DataFrame, functions as F

from reviewloom.llm.common import let, lower_ascii, row_keys


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` whose ``group`` has at least ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


_NAMES = "|".join(either_case(w) for w in ("password", "passwd", "secret", "token")) + "|" + \
    either_case("api") + "_?" + either_case("key")
#: The first three are the contract's, the rest are well-known
#: forms. Runs of a class that are too short are left out by the pattern itself
#: where that finds the same matches.
RULES = (
    Rule("assign", rf"({_NAMES})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
)

Query = frozenset[frozenset[str]]
#: The query that every document answers: one alternative that asks for nothing.
ALWAYS: Query = frozenset([frozenset()])


def _both(a: Query, b: Query, most: int = 64) -> Query:
    """Both queries; the first alone, which asks for less, if there are too many ways."""
    product = frozenset(x | y for x in a for y in b)
    return product if len(product) <= most else a


def _of_strings(strings: frozenset[str]) -> Query:
    grams = [frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in strings]
    return ALWAYS if frozenset() in grams else frozenset(grams)


def _analysed(items, most: int = 64) -> tuple[frozenset[str] | None, Query]:
    """(all strings that match, or None if they are too many; what each must hold)."""
    query, run, exact = ALWAYS, frozenset([""]), True
    for kind, value in items:
        strings, own = _one(kind, value)
        if strings is not None and len(run) * len(strings) <= most:
            run = frozenset(a + b for a in run for b in strings)
        else:
            query, run, exact = _both(_both(query, _of_strings(run)), own), frozenset([""]), False
            if strings is not None:
                run = strings
    return (run, _of_strings(run)) if exact else (None, _both(query, _of_strings(run)))


def _lowered(code: int) -> str:
    """A character as texts are indexed: A-Z in lower case, all others as they are."""
    return chr(code + 32) if 65 <= code <= 90 else chr(code)


def _one(kind, value) -> tuple[frozenset[str] | None, Query]:
    if kind is kinds.LITERAL:
        return frozenset([_lowered(value)]), ALWAYS
    if kind is kinds.AT:
        return frozenset([""]), ALWAYS
    if kind is kinds.SUBPATTERN:
        return _analysed(value[-1])
    if kind is kinds.IN and all(k is kinds.LITERAL for k, _ in value):
        return frozenset(_lowered(c) for _, c in value), ALWAYS
    if kind is kinds.BRANCH:
        found = [_analysed(branch) for branch in value[1]]
        if all(strings is not None for strings, _ in found):
            return frozenset().union(*[s for s, _ in found]), ALWAYS
        return None, frozenset().union(*[q for _, q in found])
    if kind is kinds.MAX_REPEAT:
        low, high, sub = value
        strings, own = _analysed(sub)
        if (low, high) == (0, 1) and strings is not None:
            return strings | {""}, ALWAYS
        return None, own if low else ALWAYS
    return None, ALWAYS


def trigram_query(pattern: str) -> Query:
    """Ways to match ``pattern``, each the lower-case trigrams it can't do without."""
    return _analysed(regex_parser.parse(pattern))[1]


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """(trigram, _id, _th) of the wanted trigrams in the lower-cased texts."""
    wanted = F.array(*[F.lit(t) for t in trigrams])
    held = let(lower_ascii(F.coalesce("text", F.lit(""))),
               lambda text: F.filter(wanted, lambda t: F.contains(text, t)))
    return docs.select(*row_keys(), F.explode(held).alias("trigram"))


def candidates(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(_id, _th, rules): for each document the rules whose trigram query it answers.

    The postings of the few trigrams that the queries name meet by document.
    """
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    asked = {kind: q for kind, q in queries.items() if frozenset() not in q}
    index = postings(docs, sorted({t for q in asked.values() for way in q for t in way}))
    held = F.col("_held")
    answers = [
        F.when(F.exists(
            F.array(*[F.array(*[F.lit(t) for t in sorted(way)]) for way in sorted(q, key=sorted)]),
            lambda way: F.size(F.array_except(way, held)) == 0), F.lit(kind))
        for kind, q in asked.items()]
    return (
        index.groupBy("_id", "_th").agg(F.collect_set("trigram").alias("_held"))
        .select("_id", "_th", F.array_compact(F.array(*answers)).alias("rules"))
        .where(F.size("rules") > 0))


def running_totals(values: Column, chunk: int = 256) -> Column:
    """Sum of the values up to and including each; ``values`` may be long.

    Chunks are summed on their own and then moved by what stands ahead, since
    appending to one long array would copy it for every value.
    """
    zero = F.lit(0).cast("long")
    none = F.array().cast("array<bigint>")

    def inner(part):
        start = F.struct(zero.alias("sum"), none.alias("out"))
        return F.aggregate(part, start, lambda acc, x: F.struct(
            (acc["sum"] + x).alias("sum"), F.concat(acc["out"], F.array(acc["sum"] + x)).alias("out")))

    pieces = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(values), F.lit(1)), F.lit(chunk)),
        lambda i: inner(F.slice(values, i, F.lit(chunk))))
    start = F.struct(zero.alias("sum"), F.array().cast("array<array<bigint>>").alias("out"))
    whole = F.aggregate(pieces, start, lambda acc, p: F.struct(
        (acc["sum"] + p["sum"]).alias("sum"),
        F.concat(acc["out"], F.array(F.transform(p["out"], lambda x: x + acc["sum"]))).alias("out")))
    return F.flatten(whole["out"])


SPAN = "array<struct<start:bigint,rank:int,kind:string,stop:bigint>>"


def spans_of(text: Column, rule: Rule, rank: int) -> Column:
    """The rule's spans in code points, left to right.

    Spark tells what matches but not where; the lengths of the matches and of
    what stands between them add up to their places.
    """
    pattern = F.lit(rule.pattern)
    between = F.split(text, rule.pattern, -1)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    tested = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else found

    def placed(found, tested, between):
        steps = F.zip_with(F.slice(between, 1, F.size(found)), found, lambda gap, m: (
            F.length(gap) + F.length(m)).cast("long"))
        spans = F.zip_with(
            F.arrays_zip(found.alias("m"), tested.alias("g")), running_totals(steps),
            lambda x, stop: F.struct(
                (stop - F.length(x["m"])).alias("start"), F.lit(rank).alias("rank"),
                F.lit(rule.kind).alias("kind"), stop.alias("stop"),
                F.length(x["g"]).alias("size")))
        return F.transform(
            F.filter(spans, lambda s: s["size"] >= rule.least),
            lambda s: F.struct(s["start"], s["rank"], s["kind"], s["stop"]))

    spans = let(F.struct(found.alias("m"), tested.alias("g"), between.alias("b")),
                lambda x: placed(x["m"], x["g"], x["b"]))
    return F.when(F.size(found) > 0, spans).otherwise(F.array()).cast(SPAN)


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, spans) of every row, by start and then by the order of the rules."""
    always = [r.kind for r in rules if frozenset() in trigram_query(r.pattern)]
    rows = docs.select("doc_id", *row_keys(), F.coalesce("text", F.lit("")).alias("text"))
    checked = rows.join(candidates(docs, rules), ["_id", "_th"], "left")
    each = []
    for rank, rule in enumerate(rules):
        spans = spans_of(F.col("text"), rule, rank)
        if rule.kind in always:
            each.append(F.when(F.col("text").rlike(rule.pattern), spans))
        else:
            each.append(F.when(F.array_contains("rules", rule.kind), spans))
    none = F.array().cast(SPAN)
    return checked.select(
        "doc_id", F.sort_array(F.concat(*[F.coalesce(e, none) for e in each])).alias("spans"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def _of_rank(rank: int):
    return lambda span: span["rank"] == rank


BASE = ("assign", "access", "hex")


def query(docs: DataFrame) -> DataFrame:
    found = find_secrets(docs.select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))
    return found.select(
        "doc_id",
        *[F.size(F.filter("spans", _of_rank(i))).cast("long").alias(f"n_{kind}")
          for i, kind in enumerate(BASE)],
        F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"))


def _rule_sql(rank: int, rule: Rule) -> str:
    pattern = rule.pattern.replace("'", "''")
    return f"""
    SELECT doc_id, {rank} AS rank, '{rule.kind}' AS kind, stop - length(m) AS start, stop
    FROM (SELECT doc_id, m[i] AS m, g[i] AS g,
                 sum(length(b[i]) + length(m[i])) OVER (PARTITION BY doc_id ORDER BY i) AS stop
          FROM (SELECT doc_id, m, g, b, unnest(range(1, len(m) + 1)) AS i
                FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS m,
                             regexp_extract_all(t, '{pattern}', {rule.group}) AS g,
                             regexp_split_to_array(t, '{pattern}') AS b FROM d)))
    WHERE length(g) >= {rule.least}"""


ORACLE = "WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), found AS (" + \
    " UNION ALL ".join(_rule_sql(i, r) for i, r in enumerate(RULES)) + """),
told AS (
    SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign,
           count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
           string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank)
               FILTER (rank < 3) AS base,
           string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans
    FROM found GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access,
       coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
       coalesce(spans, '') AS spans
FROM d LEFT JOIN told USING (doc_id)
"""
