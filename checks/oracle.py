"""The same results as plain SQL over the given tables, for DuckDB."""

from checks.inputs import DATES, LOCATIONS, OCCASIONS, PLATFORMS, PROFILE_NAMES, REGIONS
from checks.queries import TOPICS
from reviewloom.lookups import (
    CITY_COUNTRY, LANGUAGE_LABELS, MONTHS, OCCASION_KEYWORDS, STATE_CODES, STOP_WORDS,
)
from reviewloom.operators.profiles import PROFILES

WS = (r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}"
      r"\x{205f}\x{3000}")


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def clean(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace({x}, '<[^>]+>', ' ', 'g'), '[{WS}]+', ' ', 'g'))"


def words(x: str) -> str:
    return f"CAST(len(regexp_extract_all({x}, '[^{WS}]+')) AS BIGINT)"


def keys(name: str = "reviewer_name", text: str = "review_text") -> str:
    return (f"{strip(f'lower({name})')} AS k_name, "
            f"{strip(f'lower(substring({text}, 1, 50))')} AS k_text")


def cycle(values: list[str], n: str = "doc_id") -> str:
    cases = " ".join(f"WHEN {i} THEN {q(v)}" for i, v in enumerate(values))
    return f"CASE {n} % {len(values)} {cases} END"


def contains_case(x: str, groups, default: str) -> str:
    cases = " ".join(
        "WHEN " + " OR ".join(f"contains({x}, {q(n)})" for n in needles) + f" THEN {q(name)}"
        for name, needles in groups)
    return f"CASE {cases} ELSE {default} END"


def country(x: str) -> str:
    low = strip(f"lower({x})")
    states = ", ".join(q(s) for s in STATE_CODES)
    by_state = (f"CASE WHEN list_has_any(regexp_split_to_array({low}, '[,{WS}]+'), [{states}]) "
                "THEN 'USA' ELSE 'Unknown' END")
    return f"CASE WHEN {x} = '' THEN 'Unknown' ELSE {contains_case(low, CITY_COUNTRY, by_state)} END"


def occasion(x: str) -> str:
    return contains_case(f"lower({x})", OCCASION_KEYWORDS, "'unknown'")


def date(x: str) -> str:
    s = strip(x)
    months = "MAP {" + ", ".join(f"{q(k)}: {q(v)}" for k, v in MONTHS.items()) + "}"
    month = f"{months}[regexp_extract(lower({s}), '([a-z]+)[{WS}]+(\\d{{4}})', 1)]"
    dmy = r"(\d{1,2})[/\-.](\d{1,2})[/\-.](\d{4})"
    return (
        f"CASE WHEN regexp_matches({s}, '\\d{{4}}-\\d{{2}}-\\d{{2}}') "
        f"THEN regexp_extract({s}, '\\d{{4}}-\\d{{2}}-\\d{{2}}') "
        f"WHEN {month} IS NOT NULL "
        f"THEN regexp_extract(lower({s}), '([a-z]+)[{WS}]+(\\d{{4}})', 2) || '-' || {month} "
        f"WHEN regexp_matches({s}, '{dmy}') THEN regexp_extract({s}, '{dmy}', 3) || '-' || "
        f"lpad(regexp_extract({s}, '{dmy}', 2), 2, '0') || '-' || "
        f"lpad(regexp_extract({s}, '{dmy}', 1), 2, '0') "
        f"WHEN regexp_matches({s}, '\\b\\d{{4}}\\b') THEN regexp_extract({s}, '\\b(\\d{{4}})\\b', 1) "
        f"ELSE substring({s}, 1, 10) END")


_LANG = "CASE lang " + " ".join(
    f"WHEN {q(k)} THEN {q(v)}" for k, v in LANGUAGE_LABELS.items()) + " ELSE 'Other' END"

RAW = f"""raw AS (
 SELECT doc_id AS seq, {cycle(PLATFORMS)} AS platform, {cycle(REGIONS)} AS region,
  'city' || (doc_id % 23) AS city, 'host' || (doc_id % 37) AS host_name,
  source AS reviewer_name, {cycle(LOCATIONS)} AS reviewer_location, {_LANG} AS language,
  CASE WHEN doc_id % 7 <> 0 THEN CAST(5.0 - (doc_id % 4) * 0.5 AS DOUBLE) END AS rating,
  {cycle(DATES)} AS date_raw, text || ' ' || {cycle(OCCASIONS)} AS review_text,
  'https://example.com/r/' || doc_id AS url
 FROM documents)"""

REVIEWS = f"""{RAW}, reviews AS (
 SELECT seq AS id, platform, region, city, host_name, reviewer_name, reviewer_location,
  {country('reviewer_location')} AS reviewer_country, language, rating,
  {date('date_raw')} AS date, {occasion('review_text')} AS occasion, review_text, url
 FROM raw)"""

DIMENSIONS = ["region", "city", "host_name", "reviewer_country", "language", "occasion", "platform"]
COUNTS = "counts AS (" + " UNION ALL ".join(
    f"SELECT {q(d)} AS dimension, {d} AS label, count(*) AS n FROM reviews "
    f"WHERE {d} IS NOT NULL GROUP BY {d}" for d in DIMENSIONS) + ")"
PLACED = ("placed AS (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY n DESC, label)"
          " AS place FROM counts)")

REPORT_FIELDS = {
    "by_region": "region", "by_platform": "platform", "by_country": "reviewer_country",
    "by_language": "language", "by_occasion": "occasion", "top_hosts": "host_name",
    "top_cities": "city",
}
_TOP = "(dimension NOT IN ('host_name', 'city') OR place <= 20)"


def _json_map(dimension: str) -> str:
    return (f"(SELECT '{{' || string_agg('\"' || label || '\":' || n, ',' ORDER BY n DESC, label)"
            f" || '}}' FROM placed WHERE dimension = {q(dimension)} AND {_TOP})")


FIGURES = f"""figures AS (
 SELECT count(*) AS total_reviews,
  count(*) FILTER ({words('review_text')} >= 20) AS reviews_20_words_plus,
  round(avg(rating), 2) AS rating_mean, count(rating) AS rating_count,
  round(100 * avg(CASE WHEN rating = 5.0 THEN 1.0 WHEN rating IS NOT NULL THEN 0.0 END), 1)
   AS five_star_pct FROM reviews)"""


def with_reviews(select: str, *more: str) -> str:
    return f"WITH {', '.join([REVIEWS, *more])} {select}"


def with_raw(select: str, *more: str) -> str:
    return f"WITH {', '.join([RAW, *more])} {select}"


# Phrases
_STOP = ", ".join(q(w) for w in STOP_WORDS)
_GRAMS = " UNION ALL ".join(
    f"SELECT seq, unnest(list_transform(range(1, len(w) - {k - 2}), "
    f"lambda i: array_to_string(w[i:i + {k - 1}], ' '))) AS phrase FROM kept WHERE len(w) >= {k}"
    for k in (2, 3, 4))
PHRASES = f"""kept AS (
 SELECT seq, list_filter(regexp_extract_all(lower(review_text), '[\\p{{L}}\\p{{N}}_]{{2,}}'),
  lambda t: t NOT IN ({_STOP})) AS w FROM raw WHERE language = 'EN'),
grams AS ({_GRAMS}),
phrases AS (SELECT phrase, sum(n)::BIGINT AS tf, count(*) AS df
 FROM (SELECT seq, phrase, count(*) AS n FROM grams GROUP BY ALL) GROUP BY phrase
 HAVING count(*) >= 2)"""


# Languages
def _trigrams(alias: str, columns: str, table: str) -> str:
    return f"""{alias} AS (
 SELECT {columns}, unnest(list_transform(range(1, len(c) - 1), lambda i: c[i] || c[i + 1] || c[i + 2]))
  AS gram FROM (SELECT {columns}, string_split(' ' ||
   trim(regexp_replace(lower(text), '[^\\p{{L}}]+', ' ', 'g')) || ' ', '') AS c FROM {table}))"""


PROFILE_ROWS = _trigrams("g", "lang", "documents") + """,
profile AS (SELECT lang, place, gram, n FROM (
 SELECT lang, gram, count(*) AS n,
  row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, gram) AS place
 FROM g GROUP BY lang, gram) WHERE place <= 300)"""
DETECTED = PROFILE_ROWS + ", " + _trigrams("t", "conv_id, turn", "conversations") + """,
scores AS (SELECT conv_id, turn, lang, count(*) AS hits
 FROM t JOIN profile USING (gram) GROUP BY ALL),
best AS (SELECT conv_id, turn, lang FROM (SELECT *, row_number() OVER (
 PARTITION BY conv_id, turn ORDER BY hits DESC, lang) AS r FROM scores) WHERE r = 1)"""


RANKED = PROFILE_ROWS + ", " + _trigrams("t", "conv_id, turn", "conversations") + """,
ranked AS (SELECT conv_id, turn, gram, row_number() OVER (
 PARTITION BY conv_id, turn ORDER BY count(*) DESC, gram) AS place FROM t GROUP BY conv_id, turn, gram),
own AS (SELECT * FROM ranked WHERE place <= 300),
far AS (SELECT o.conv_id, o.turn, p.lang, sum(coalesce(abs(o.place - q.place), 300)) AS distance,
  count(q.gram) AS shared
 FROM own o CROSS JOIN (SELECT DISTINCT lang FROM profile) p
 LEFT JOIN profile q ON q.lang = p.lang AND q.gram = o.gram GROUP BY ALL),
best AS (SELECT conv_id, turn, lang FROM (SELECT *, row_number() OVER (
 PARTITION BY conv_id, turn ORDER BY distance, lang) AS r FROM far WHERE shared > 0) WHERE r = 1)"""
RAW_LANGUAGES = f"{RAW}, " + PROFILE_ROWS + ", " + _trigrams(
    "t", "seq", "(SELECT seq, review_text AS text FROM raw)") + f""",
scores AS (SELECT seq, lang, count(*) AS hits FROM t JOIN profile USING (gram) GROUP BY ALL),
best AS (SELECT seq, lang FROM (SELECT *, row_number() OVER (
 PARTITION BY seq ORDER BY hits DESC, lang) AS r FROM scores) WHERE r = 1),
told AS (SELECT raw.* EXCLUDE (language), CASE WHEN lang IS NULL THEN 'EN' ELSE {_LANG} END AS language
 FROM raw LEFT JOIN best USING (seq))"""


# Sources and keys
SOURCES = f"""{RAW}, sources AS (
 SELECT 0 AS source_priority, seq AS page_id, 0 AS pos, platform, reviewer_name, review_text, url
 FROM raw UNION ALL
 SELECT 1, conv_id, turn, 'Chat', role, text, 'chat/' || conv_id || '/' || turn FROM conversations),
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k_name, k_text
 ORDER BY source_priority, page_id, pos) AS r FROM (SELECT *, {keys()} FROM sources)) WHERE r = 1)"""

RAW_FIRSTS = f"""raw_firsts AS (SELECT * FROM (SELECT *, row_number() OVER (
 PARTITION BY k_name, k_text ORDER BY seq) AS r FROM (SELECT *, {keys()} FROM raw)) WHERE r = 1)"""


# Extraction: the projection a page was made from
TEXT = f"(SELECT *, {clean('review_text')} AS body FROM raw)"
ENOUGH = f"{words('body')} >= 5"
_FRACTION = r"(\d(?:\.\d)?)[\s]*/[\s]*5|(\d(?:\.\d)?)[\s]*out[\s]*of[\s]*5"


def fraction(x: str) -> str:
    return (f"CAST(coalesce(nullif(regexp_extract({x}, '(?i){_FRACTION}', 1), ''), "
            f"nullif(regexp_extract({x}, '(?i){_FRACTION}', 2), '')) AS DOUBLE)")


PROFILE_OF = cycle(PROFILE_NAMES, "seq")
SITE_BODY = clean("reviewer_name || ' ' || review_text")
BLOCKS = f"""shown AS (SELECT seq, {PROFILE_OF} AS profile, reviewer_name, reviewer_location,
  date_raw, rating, {clean('review_text')} AS body, {SITE_BODY} AS site_body,
  {fraction("reviewer_name || date_raw || review_text")} AS fraction,
  {fraction("reviewer_name || reviewer_location || review_text")} AS fraction_located FROM raw),
blocks AS (SELECT seq AS page_id, profile, reviewer_name,
  CASE WHEN profile IN ('tripadvisor', 'airbnb') THEN {clean('reviewer_location')} ELSE '' END
   AS reviewer_location,
  CASE WHEN profile = 'site' THEN '' ELSE {date(clean('date_raw'))} END AS date,
  CASE WHEN profile = 'site' THEN NULL WHEN profile = 'airbnb' THEN 5.0
   WHEN profile = 'tripadvisor' THEN coalesce(floor(rating), fraction_located)
   ELSE coalesce(rating, fraction) END AS rating,
  CASE WHEN profile = 'site' THEN site_body ELSE body END AS review_text FROM shown)"""
BLOCK_WORDS = ("CASE profile " + " ".join(
    f"WHEN {q(n)} THEN {p.min_words}" for n, p in PROFILES.items()) + " END")

CASCADE = f"""shown AS (SELECT *, {clean('review_text')} AS body,
  {fraction("reviewer_name || date_raw || review_text")} AS fraction FROM raw),
found AS (SELECT seq AS page_id, url,
  CASE seq % 4 WHEN 0 THEN 'json_ld' WHEN 1 THEN 'state' ELSE 'blocks' END AS strategy,
  reviewer_name, date_raw,
  CASE WHEN seq % 4 = 2 THEN coalesce(rating, fraction) ELSE rating END AS rating,
  body AS review_text, seq, city, region, host_name FROM shown
 WHERE seq % 4 <> 3 AND {ENOUGH})"""

# Fixed value: the note pattern, without the look-ahead that RE2 lacks. A note
# of this input holds one entry, so nothing follows that it could look at.
_NOTE = (rf"(?m)\*\*([^*]+)\*\*[{WS}]*(?:from[{WS}]+([^\n—–-]+?))?[{WS}—–-]+([^\n]+)?\n"
         r"(?:[★\*]{1,5}[^\n]*\n)?"
         rf"[\"“”]?[{WS}]*([^\"“”\n]{{20,}}(?:\n[^\n]{{0,200}})*)[\"“”]?")
NOTES = f"""note AS (SELECT seq, 'note-' || seq || '.md' AS url, '**Guest ' || reviewer_name || '** from '
  || reviewer_location || ' — ' || date_raw || chr(10) || '★★★★★' || chr(10) || '"' ||
  regexp_replace(review_text, '["“”\\n]', ' ', 'g') || '"' || chr(10) AS v FROM raw),
noted AS (SELECT seq, url, {strip(f"regexp_extract(v, '{_NOTE}', 1)")} AS reviewer_name,
  {strip(f"regexp_extract(v, '{_NOTE}', 2)")} AS reviewer_location,
  {strip(f"regexp_extract(v, '{_NOTE}', 3)")} AS date_raw,
  {clean(f"regexp_extract(v, '{_NOTE}', 4)")} AS review_text FROM note),
notes AS (SELECT * FROM noted WHERE {words('review_text')} >= 10)"""

INGESTED = f"""cand AS (
 SELECT -1 AS prio, seq AS page_id, 'Блог' AS platform, 'Como' AS region, 'Como' AS city,
  'Unknown' AS host_name, reviewer_name, reviewer_location, date_raw, NULL AS rating, review_text,
  url FROM notes UNION ALL
 SELECT 0, page_id, 'Cesarine', region, city, host_name, reviewer_name, '', date_raw, rating,
  review_text, url FROM found),
first_cand AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k_name, k_text
 ORDER BY prio, page_id) AS r FROM (SELECT *, {keys()} FROM cand)) WHERE r = 1)"""


def enriched(columns: str) -> str:
    return f"""row_number() OVER (ORDER BY {columns}) AS id, platform, region, city, host_name,
 reviewer_name, reviewer_location, {country('reviewer_location')} AS reviewer_country,
 'EN' AS language, rating, {date('date_raw')} AS date, {occasion('review_text')} AS occasion,
 review_text, url"""


# Pages
def shown_text(x: str) -> str:
    bare = (f"regexp_replace(regexp_replace({x}, '(?is)<!--.*?-->|<script\\b[^>]*>.*?</script\\s*>"
            f"|<style\\b[^>]*>.*?</style\\s*>|<template\\b[^>]*>.*?</template\\s*>', '', 'g'), "
            f"'(?s)<[!/a-zA-Z?][^>]*>', '', 'g')")
    for entity, char in (("&copy;", "©"), ("&middot;", "·"), ("&nbsp;", " "), ("&lt;", "<"),
                         ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&mdash;", "—"),
                         ("&amp;", "&")):
        bare = f"replace({bare}, {q(entity)}, {q(char)})"
    return bare


SNIPPET = f"substring(translate(substring({shown_text('html')}, 1, 500), chr(10), ' '), 1, 200)"
RESULT_PAGES = """result_pages AS (SELECT page_id, page_id % 11 AS listing,
 'http://t.example/g' || (page_id % 11) || CASE page_id % 5 WHEN 0 THEN '-Reviews-x.html'
  WHEN 1 THEN '-or' || ((page_id % 7) * 10) || '-Reviews-x.html' WHEN 2 THEN '-x.html?a=1'
  WHEN 3 THEN '-Reviews-y.html' ELSE '/plain' END AS url,
 page_id % 5 <> 3 AS has_next, page_id % 5 AS shape, page_id % 7 AS step FROM pages),
following AS (SELECT page_id, listing, url AS from_url, CASE shape
  WHEN 0 THEN replace(url, '-Reviews-', '-or10-Reviews-')
  WHEN 1 THEN 'http://t.example/g' || listing || '-or' || (step * 10 + 10) || '-Reviews-x.html'
  WHEN 2 THEN replace(url, '.html?a=1', '-or10.html') END AS url,
 CASE WHEN shape = 1 THEN step + 1 ELSE 1 END AS page_num FROM result_pages)"""

ORACLE = {
    "language_counts": with_reviews(
        "SELECT language AS label, count(*) AS n FROM reviews GROUP BY language "
        "ORDER BY n DESC, label"),
    "review_totals": with_reviews(
        "SELECT total_reviews, reviews_20_words_plus FROM figures", FIGURES),
    "dimension_counts": with_reviews("SELECT * FROM counts", COUNTS),
    "top_cities": with_reviews(
        "SELECT label, n FROM placed WHERE dimension = 'city' AND place <= 20", COUNTS, PLACED),
    "top_hosts": with_reviews(
        "SELECT label, n FROM placed WHERE dimension = 'host_name' AND place <= 20",
        COUNTS, PLACED),
    "top_labels_per_dimension": with_reviews(
        "SELECT dimension, label, n, place FROM placed WHERE place <= 20", COUNTS, PLACED),
    "rating_stats": with_reviews(
        "SELECT count(*) AS rating_count, round(avg(rating), 2) AS rating_mean, "
        "median(rating) AS rating_median, count(*) FILTER (rating = 5.0) AS five_star, "
        "round(100.0 * count(*) FILTER (rating = 5.0) / count(*), 1) AS five_star_pct, "
        "count(*) FILTER (rating = 4.0) AS four_star, "
        "round(100.0 * count(*) FILTER (rating = 4.0) / count(*), 1) AS four_star_pct "
        "FROM reviews WHERE rating IS NOT NULL"),
    "date_range": with_reviews(
        "SELECT min(date) AS first_date, max(date) AS last_date FROM reviews WHERE date <> ''"),
    "strict_date_range": with_reviews(
        "SELECT CAST(min(d) AS VARCHAR) AS first_day, CAST(max(d) AS VARCHAR) AS last_day FROM "
        "(SELECT TRY_CAST(date AS DATE) AS d FROM reviews "
        "WHERE regexp_full_match(date, '\\d{4}-\\d{2}-\\d{2}'))"),
    "report_counts": with_reviews(
        "SELECT CASE dimension " + " ".join(
            f"WHEN {q(d)} THEN {q(f)}" for f, d in REPORT_FIELDS.items())
        + f" END AS field, label, n FROM placed WHERE {_TOP}", COUNTS, PLACED),
    "summary_report": with_reviews(
        "SELECT figures.*, " + ", ".join(
            f"{_json_map(d)} AS {f}" for f, d in REPORT_FIELDS.items()) + " FROM figures",
        COUNTS, PLACED, FIGURES),
    "report_json": with_reviews(
        f"SELECT figures.*, {_json_map('language')} AS by_language, "
        f"{_json_map('occasion')} AS by_occasion FROM figures", COUNTS, PLACED, FIGURES),
    "ingest_counts": with_reviews(
        "SELECT platform, region, host_name, count(*) AS n FROM reviews GROUP BY ALL"),
    "ingest_rollup": with_reviews(
        "SELECT platform, region, count(*) AS n, "
        "CAST(grouping(platform, region) AS BIGINT) AS level "
        "FROM reviews GROUP BY ROLLUP (platform, region)"),
    "running_total": with_reviews(
        "SELECT platform, region, host_name, n, CAST(sum(n) OVER (ORDER BY platform, region, "
        "host_name) AS BIGINT) AS total FROM (SELECT platform, region, host_name, count(*) AS n "
        "FROM reviews GROUP BY ALL)"),
    "top_phrases": with_raw(
        "SELECT phrase, tf FROM phrases ORDER BY tf DESC, phrase LIMIT 50", PHRASES),
    "phrase_counts": with_raw("SELECT phrase, tf, df FROM phrases", PHRASES),
    "clean_text_pages": f"SELECT page_id, {clean('html')} AS text FROM pages",
    "clean_text_documents":
        f"SELECT doc_id, {clean('text')} AS text, {words('text')} AS words FROM documents",
    "min_words_documents":
        f"SELECT doc_id, body AS text FROM (SELECT doc_id, {clean('text')} AS body "
        f"FROM documents) WHERE {ENOUGH}",
    "drop_block_pages":
        "SELECT page_id, title FROM (SELECT page_id, "
        "regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title FROM ("
        "SELECT page_id, CASE page_id % 5 WHEN 0 THEN "
        "regexp_replace(html, '(?i)<title>', '<title>Access Denied ', 'g') ELSE html END AS html "
        "FROM pages)) "
        "WHERE NOT regexp_matches(lower(title), 'access denied|captcha|robot|blocked')",
    "rated_and_dated": with_reviews(
        "SELECT * FROM reviews WHERE rating IS NOT NULL AND date <> ''"),
    "parse_dates": with_raw(f"SELECT seq, date_raw, {date('date_raw')} AS date FROM raw"),
    "page_snippets": f"SELECT page_id, {SNIPPET} AS snippet FROM pages",
    "infer_countries": with_raw(
        f"SELECT seq, reviewer_location, {country('reviewer_location')} AS reviewer_country "
        "FROM raw"),
    "detect_occasions": with_raw(
        f"SELECT {occasion('text')} AS occasion, text FROM "
        "(SELECT review_text AS text FROM raw UNION ALL SELECT text FROM conversations)"),
    "detect_topics":
        "SELECT doc_id, " + contains_case("lower(text)", TOPICS, "'unknown'")
        + " AS topic FROM documents",
    "first_contained_topic":
        "SELECT * FROM (SELECT doc_id, " + contains_case("lower(text)", TOPICS, "NULL")
        + " AS label FROM documents) WHERE label IS NOT NULL",
    "first_contained_country": with_raw(
        "SELECT * FROM (SELECT DISTINCT reviewer_location, "
        + contains_case("lower(reviewer_location)", CITY_COUNTRY, "NULL")
        + " AS label FROM raw) WHERE label IS NOT NULL"),
    "normalise_languages": f"SELECT doc_id, {_LANG} AS language FROM documents",
    "language_profiles": f"WITH {PROFILE_ROWS} SELECT lang, place, gram, n FROM profile",
    "detect_languages":
        f"WITH {DETECTED} SELECT conv_id, CAST(turn AS BIGINT) AS turn, "
        f"CASE WHEN lang IS NULL THEN 'EN' ELSE {_LANG} END AS language "
        "FROM conversations LEFT JOIN best USING (conv_id, turn)",
    "build_reviews": with_raw(
        f"SELECT platform, region, city, host_name, reviewer_name, reviewer_location, "
        f"{country('reviewer_location')} AS reviewer_country, 'EN' AS language, rating, "
        f"{date('date_raw')} AS date, {occasion('review_text')} AS occasion, review_text, url "
        "FROM raw"),
    "dedup_first": with_raw(
        "SELECT seq, reviewer_name, review_text, url FROM raw_firsts", RAW_FIRSTS),
    "distinct_keys": with_raw(f"SELECT DISTINCT {keys()} FROM raw"),
    "union_sources":
        f"WITH {SOURCES} SELECT CAST(source_priority AS BIGINT) AS source_priority, platform, "
        "count(*) AS n FROM firsts GROUP BY source_priority, platform",
    "assign_ids": with_raw(
        "SELECT row_number() OVER (ORDER BY platform, seq) AS id, platform, seq FROM raw"),
    "merge_new":
        f"WITH {SOURCES} SELECT row_number() OVER (ORDER BY source_priority, page_id, pos) AS id, "
        "platform, reviewer_name, review_text, url FROM firsts",
    "extract_json_ld": with_raw(
        "SELECT seq AS page_id, host_name, city, region, reviewer_name, date_raw, rating, "
        f"body AS review_text FROM {TEXT} WHERE {ENOUGH}"),
    "extract_embedded_state": with_raw(
        "SELECT seq AS page_id, reviewer_name, date_raw, rating, body AS review_text "
        f"FROM {TEXT} WHERE {ENOUGH}"),
    "extract_blocks": with_raw(
        f"SELECT *, {country('reviewer_location')} AS reviewer_country FROM blocks "
        f"WHERE {words('review_text')} >= {BLOCK_WORDS}", BLOCKS),
    "extract_cascade": with_raw(
        "SELECT page_id, strategy, reviewer_name, rating, review_text FROM found", CASCADE),
    "first_strategy": with_raw(
        "SELECT url, reviewer_name, body AS review_text, "
        "CAST(CASE WHEN seq % 4 = 3 THEN 1 ELSE 0 END AS BIGINT) AS capture "
        f"FROM {TEXT} WHERE {ENOUGH}"),
    "pages_without_reviews": f"SELECT page_id, url, {SNIPPET} AS snippet FROM pages",
    "parse_notes": with_raw(
        f"SELECT url, reviewer_name, reviewer_location, {country('reviewer_location')} "
        f"AS reviewer_country, {date('date_raw')} AS date, review_text FROM notes", NOTES),
    "next_pages":
        f"WITH {RESULT_PAGES} SELECT page_id, from_url, url, CAST(page_num AS BIGINT) AS page_num "
        "FROM following WHERE url IS NOT NULL "
        "QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id) = 1",
    "crawl_frontier":
        f"WITH {RESULT_PAGES} SELECT page_id, listing, url FROM (SELECT * FROM following "
        "WHERE url IS NOT NULL QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id) = 1) "
        "WHERE page_num < 5 AND url NOT IN (SELECT url FROM result_pages)",
    "cap_pages":
        f"WITH {RESULT_PAGES} SELECT listing, page_id, place FROM (SELECT *, row_number() OVER ("
        "PARTITION BY listing ORDER BY CASE WHEN shape = 1 THEN step * 10 ELSE 0 END, page_id) "
        "AS place FROM result_pages) WHERE place <= 3",
    "ingest_pages": with_raw(
        f"SELECT {enriched('prio, page_id')}, k_name, k_text FROM first_cand",
        NOTES, CASCADE, INGESTED),
    "ingest_metrics": with_reviews(
        "SELECT platform, region, host_name, count(*) AS n FROM reviews GROUP BY ALL UNION ALL "
        "SELECT 'Chat', 'Como', 'Unknown', count(*) FROM conversations"),
    "store_documents_stream": with_raw(
        "SELECT row_number() OVER (ORDER BY seq) AS id, platform, reviewer_name, "
        f"{country('reviewer_location')} AS reviewer_country, rating, {date('date_raw')} AS date, "
        "review_text FROM raw_firsts", RAW_FIRSTS),
    "stream_distinct_keys": with_raw(f"SELECT DISTINCT {keys()} FROM raw"),
    "reviews_csv": with_reviews(
        "SELECT * REPLACE (nullif(reviewer_location, '') AS reviewer_location, "
        "nullif(date, '') AS date) FROM reviews"),
    "reviews_json": with_reviews("SELECT * FROM reviews"),
    "store_in_turns": with_raw(
        f"SELECT k_name, k_text, true AS dense, min(seq % 2) AS turn "
        f"FROM (SELECT seq, {keys()} FROM raw) GROUP BY k_name, k_text"),
    "extraction_failures": with_raw(
        "SELECT seq AS page_id, CASE seq % 2 WHEN 0 THEN 'json_ld' ELSE 'state' END AS strategy, "
        "'not JSON' AS error FROM raw WHERE seq % 3 = 0"),
    "listings_csv": with_raw(
        "SELECT 5::BIGINT AS max_pages, url, host_name, seq % 3 AS source_priority, city, region, "
        "'Cesarine' AS platform, 'site' AS profile FROM raw"),
}
ORACLE |= {
    "stream_first_wins": ORACLE["dedup_first"],
    "report_of_batches": ORACLE["summary_report"],
    "report_json": ORACLE["summary_report"],
    # Seven batches, of which the first six are merged by threes.
    "store_compacted": with_raw(
        "SELECT k_name, k_text, row_number() OVER (ORDER BY batch, seq) AS id, batch, 3 AS folders, "
        "count(*) OVER () AS noted FROM (SELECT k_name, k_text, min(seq % 7) AS batch, "
        f"arg_min(seq, (seq % 7, seq)) AS seq FROM (SELECT seq, {keys()} FROM raw) GROUP BY ALL)"),
    "ingest_totals": with_raw(
        "SELECT *, CAST(sum(n) OVER (ORDER BY batch, platform, region, host_name) AS BIGINT) AS total, "
        "true AS logged_now FROM (SELECT seq % 3 AS batch, platform, region, host_name, count(*) AS n "
        f"FROM (SELECT *, {keys()} FROM raw QUALIFY row_number() OVER (PARTITION BY k_name, k_text "
        "ORDER BY seq % 3, seq) = 1) GROUP BY ALL)"),
    "merged_figures": with_reviews(
        "SELECT min(date) FILTER (date <> '') AS first_date, max(date) FILTER (date <> '') AS last_date, "
        "round(avg(rating), 2) AS rating_mean, count(rating) AS rating_count, true AS one_median "
        "FROM reviews"),
    "pages_from_files": "SELECT html, NULL::VARCHAR AS error FROM pages WHERE html <> ''",
    "ingest_note_files": with_raw(f"SELECT DISTINCT 'Блог' AS platform, {keys()} FROM notes", NOTES),
    "build_reviews_languages":
        f"WITH {RAW_LANGUAGES} SELECT url, language, {occasion('review_text')} AS occasion FROM told",
    "store_languages_stream":
        f"WITH {RAW_LANGUAGES} SELECT language, count(*) AS n FROM (SELECT *, {keys()} FROM told "
        "QUALIFY row_number() OVER (PARTITION BY k_name, k_text ORDER BY seq % 2, seq) = 1) "
        "GROUP BY language",
    "detect_languages_by_rank":
        f"WITH {RANKED} SELECT conv_id, CAST(turn AS BIGINT) AS turn, "
        f"CASE WHEN lang IS NULL THEN 'EN' ELSE {_LANG} END AS language "
        "FROM conversations LEFT JOIN best USING (conv_id, turn)",
    "first_indexed_terms":
        "WITH entries AS (SELECT DISTINCT needle FROM (SELECT unnest(regexp_extract_all(lower(text), "
        "'\\p{L}+')) AS needle FROM conversations) WHERE length(needle) >= 9) "
        "SELECT doc_id, upper(arg_min(needle, (-length(needle), needle))) AS label "
        f"FROM (SELECT doc_id, {strip('lower(text)')} AS low FROM documents) JOIN entries "
        "ON contains(low, needle) GROUP BY doc_id",
    "unknown_names": with_raw(
        "SELECT seq, CASE WHEN seq % 3 = 1 THEN coalesce(nullif(reviewer_name, ''), 'Unknown') "
        "ELSE 'Unknown' END AS either, CASE seq % 3 WHEN 0 THEN '' WHEN 1 THEN "
        "coalesce(reviewer_name, 'Unknown') ELSE 'Unknown' END AS missing FROM raw"),
    "places_in_source":
        "SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) "
        "AS place FROM documents QUALIFY place <= 5000",
    "mixed_pages_without_reviews": with_raw(
        "SELECT seq AS page_id, url FROM shown WHERE seq NOT IN (SELECT seq FROM found)", CASCADE),
    "extract_several_blocks": with_raw(
        "SELECT seq // 3 AS page_id, row_number() OVER (PARTITION BY seq // 3 ORDER BY seq) - 1 AS pos, "
        f"reviewer_name, body AS review_text FROM {TEXT} WHERE {ENOUGH}"),
}
ORACLE["import_saved_reviews"] = ORACLE["merge_new"]
