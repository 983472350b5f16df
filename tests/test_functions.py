"""Edge cases of the expressions, as literal pairs of input and result."""

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from reviewloom.functions import dates, enrichment, ratings, text, urls


def test_clean_text(apply, V):
    assert apply(text.clean_text(V), ["a<br>b c", " \t x  y\x1c ", "<p></p>", None]) \
        == ["a b c", "x y", "", None]


def test_word_count(apply, V):
    assert apply(text.word_count(V), ["", None, "  ", "one", " a\n b c "]) == [0, 0, 0, 1, 3]
    assert apply(text.has_words(V, 2), ["", "a", "a b"]) == [False, False, True]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="ab \t\n \x1c\x1f 　.", max_size=30),
                min_size=1, max_size=20))
def test_white_space_is_what_python_takes_it_for(spark, V, values):
    table = spark.createDataFrame([(v,) for v in values], "v string")
    rows = table.select("v", text.word_count(V).alias("n"), text.strip(V).alias("s")).collect()
    assert all(r["n"] == len(r["v"].split()) and r["s"] == r["v"].strip() for r in rows)


def test_review_key_cuts_then_lowers_then_trims(spark):
    row = spark.range(1).select(
        *text.review_key(F.lit(" Ann "), F.lit("X" * 49 + " tail"))).first()
    assert (row["k_name"], row["k_text"]) == ("ann", "x" * 49)


def test_unknown_names(apply, V):
    assert apply(text.or_unknown(V), ["", None, "Ann"]) == ["Unknown", "Unknown", "Ann"]
    assert apply(text.or_unknown(V, empty_too=False), ["", None]) == ["", "Unknown"]
    assert apply(text.first_filled(V, F.lit("b")), ["", None, "a"]) == ["b", "b", "a"]


def test_snippet(apply, V):
    long = "a\n" * 400
    assert apply(text.snippet(V), [long]) == ["a " * 100]
    assert apply(text.visible_text(V), ["<!-- x --><p>a</p><script>b</script>c < d"]) == ["ac < d"]


def test_parse_date(apply, V):
    pairs = {
        "15 January 2024": "2024-01", "January 15, 2024": "2024", "05/13/2024": "2024-13-05",
        "Reviewed 2021": "2021", "yesterday evening": "yesterday ", "": "", "Jan 2022": "2022-01",
        "2024-03-05T10:00:00Z": "2024-03-05", "1.2.2023": "2023-02-01", "  ": "",
        "in 2020 or May 2021": "2020", "room 12345": "room 12345", "Smarch 2020": "2020",
    }
    assert apply(dates.parse_date(V), list(pairs)) == list(pairs.values())
    assert apply(dates.parse_date(V), [None]) == [""]


def test_strict_date(apply, V):
    found = apply(dates.strict_date(V).cast("string"), ["2024-02-29", "2024-13-05", "2024-01", "x"])
    assert found == ["2024-02-29", None, None, None]


def test_infer_country(apply, V):
    pairs = {
        "Venice, Italy": "France", "San Bernardino, CA": "Other", "Bucharest, Romania": "Italy",
        "Birmingham, AL": "UK", "Rio de Janeiro": "USA", "Germany": "Unknown",
        "Italy": "Unknown", "USA": "Unknown", "Boise ID": "USA", "MÜNCHEN": "Germany",
        "": "Unknown", "Zagreb": "Unknown", " tx ": "USA",
    }
    assert apply(enrichment.infer_country(V), list(pairs)) == list(pairs.values())
    assert apply(enrichment.infer_country(V), [None]) == ["Unknown"]


def test_infer_country_by_whole_words(apply, V):
    found = apply(enrichment.infer_country(V, match="word"), ["Venice, Italy", "Nice", "Bucharest"])
    assert found == ["Italy", "France", "Unknown"]


def test_lookup_sizes():
    assert sum(len(c) for _, c in enrichment.CITY_COUNTRY) == 154
    assert sum(len(k) for _, k in enrichment.OCCASION_KEYWORDS) == 60
    assert len(set(enrichment.STATE_CODES)) == 50


def test_detect_occasion(apply, V):
    pairs = {
        "kitchen door": "hen_party", "just met": "solo", "HONEYMOON with kids": "honeymoon",
        "our anniversary birthday": "anniversary", "with colleagues": "business", "": "unknown",
    }
    assert apply(enrichment.detect_occasion(V), list(pairs)) == list(pairs.values())
    assert apply(enrichment.detect_occasion(V), [None]) == ["unknown"]
    assert apply(enrichment.detect_occasion(V, match="word"), ["just met"]) == ["unknown"]


def test_normalise_language(apply, V):
    assert apply(enrichment.normalise_language(V), ["en", "nl", "xx", None, ""]) \
        == ["EN", "NL", "Other", "EN", "EN"]


def test_detect_language(apply, V):
    model = {"en": [" th", "the", "he "], "de": [" un", "und", "nd "], "xx": ["qqq"]}
    found = apply(
        enrichment.detect_language(V, model), ["the the", "und Und", "", "zz", "qqq", "the und"])
    assert found == ["EN", "DE", "EN", "EN", "Other", "DE"]
    assert apply(enrichment.detect_language(V), ["und"]) == ["EN"]


def test_ratings(spark):
    hints = ["label", "filled", "data_rating", "data_score", "data_stars", "fraction"]
    rows = [
        (("Rated 4.5 out of 5 stars", 3, "1", None, None, None), 4.5),
        ((None, 1, None, None, None, None), 1.0),
        ((None, 9, None, None, None, None), 5.0),
        ((None, 0, "bad", "3.5", None, "2"), 3.5),
        ((None, 0, None, None, None, "3"), 3.0),
        ((None, 0, None, None, None, None), None),
    ]
    table = spark.createDataFrame(
        [(i, h) for i, (h, _) in enumerate(rows)],
        "i int, h struct<" + ",".join(
            f"{h}:{'int' if h == 'filled' else 'string'}" for h in hints) + ">")
    got = table.select("i", ratings.block_rating(F.col("h")).alias("r")).orderBy("i").collect()
    assert [r["r"] for r in got] == [want for _, want in rows]


def test_number(apply, V):
    assert apply(ratings.number(V), ["4.5", " 4 ", "4,5", "4f", "", "1e1", None]) \
        == [4.5, 4.0, None, None, None, 10.0, None]


def test_next_page_url(spark):
    rows = [
        ("http://t/a-or10-Reviews-b.html", 1, False, "http://t/a-or20-Reviews-b.html"),
        ("http://t/a-Reviews-b.html", 0, True, "http://t/a-or10-Reviews-b.html"),
        ("http://t/a-Reviews-b.html", 0, False, None),
        ("http://t/a.html?q=1", 0, True, "http://t/a-or10.html"),
        ("http://t/a", 0, True, None),
        ("http://t/a.html", 3, True, None),
    ]
    table = spark.createDataFrame(rows, "url string, n int, has boolean, want string")
    got = table.select(
        urls.next_page_url(F.col("url"), F.col("n"), F.col("has")).alias("got"), "want").collect()
    assert all(r["got"] == r["want"] for r in got)


def test_next_link(apply, V):
    pages = ['<a href="#" class="ui Next">', "<b aria-label='Next page'>", "<p class=next>", "next"]
    assert apply(urls.has_next_link(V), pages) == [True, True, False, False]


def test_listing_address_and_page_number(apply, V):
    pages = ["http://t/a-or10-Reviews-b.html", "http://t/a-or20.html", "http://t/a-oregon-1.html"]
    assert apply(urls.first_page_url(V), pages) \
        == ["http://t/a-Reviews-b.html", "http://t/a.html", "http://t/a-oregon-1.html"]
    assert apply(urls.page_number(V), pages) == [1, 2, 0]
