"""Reviews out of pages and notes."""

import json

import pytest
from pyspark.sql import functions as F

from reviewloom.operators import extract, frontier, notes
from reviewloom.operators.profiles import PROFILES

LONG = "one two three four five six seven eight nine ten"


def pages(spark, *htmls, profile="cesarine"):
    return spark.createDataFrame(
        [(i, f"http://p/{i}", html, profile) for i, html in enumerate(htmls)],
        "page_id long, url string, html string, profile string")


def ld(data, head='<script type="application/ld+json">'):
    return f"<html>{head}{data if isinstance(data, str) else json.dumps(data)}</script></html>"


def state(data):
    return f'<script id="__NEXT_DATA__" type="application/json">{json.dumps(data)}</script>'


def review(text=LONG, **members):
    return {"@type": "Review", "reviewBody": text, **members}


def found(df):
    rows = df.orderBy("page_id", "pos").collect()
    return [(r["reviewer_name"], r["rating"], r["review_text"]) for r in rows]


def test_json_ld_shapes(spark):
    html = ld(review(author="Ann", reviewRating={"ratingValue": "4.5"})) \
        + ld([review(author={"name": "Bob"}), {"@type": "Other"}]) \
        + ld({"@type": "Product", "review": review(author=None)}) \
        + ld({"review": [review("", description=LONG), review("too short")]})
    names = [(n, r) for n, r, _ in found(extract.extract_json_ld(pages(spark, html)))]
    assert names == [("Ann", 4.5), ("Bob", None), ("None", None), ("Unknown", None)]


def test_json_ld_zero_rating_is_none_but_quoted_zero_counts(spark):
    html = ld([review(reviewRating={"ratingValue": v}) for v in (0, "0", 3, None, "")])
    got = [r for _, r, _ in found(extract.extract_json_ld(pages(spark, html)))]
    assert got == [None, 0.0, 3.0, None, None]


def test_json_ld_bad_value_ends_its_script_only(spark):
    html = ld([review(author="a"), review("short", reviewRating={"ratingValue": "bad"}),
               review(author="b"), review(reviewRating={"ratingValue": "bad"}),
               review(author="c")]) + ld([review(author="d"), "text", review(author="e")])
    got = [n for n, _, _ in found(extract.extract_json_ld(pages(spark, html)))]
    assert got == ["a", "b", "d"]


def test_json_ld_ignores_comments_and_other_scripts(spark):
    html = f"<!-- {ld(review())} -->" + ld(review(), "<script>var x = '<!--';") \
        + ld("not json") + ld(review(author="x"), "<SCRIPT TYPE='application/ld+json' id=q>")
    assert [n for n, _, _ in found(extract.extract_json_ld(pages(spark, html)))] == ["x"]


def test_state_search(spark):
    reviews = [{"comment": LONG, "user": {"username": "U"}, "stars": 4, "createdAt": "Jan 2022"}]
    deep = reviews
    for _ in range(9):
        deep = {"x": deep}
    table = pages(
        spark,
        state({"z": [{"id": 1}], "b": {"list": reviews}, "a": [{"text": "never"}]}),
        state({"x": [reviews]}), state(deep), state(deep["x"]), "<p></p>",
        '<script id="__NEXT_DATA__">{bad</script>')
    rows = extract.extract_embedded_state(table).orderBy("page_id").collect()
    assert [(r["page_id"], r["reviewer_name"], r["rating"], r["date_raw"]) for r in rows] \
        == [(0, "U", 4.0, "Jan 2022"), (3, "U", 4.0, "Jan 2022")]


def test_state_fields_and_end_of_list(spark):
    html = state({"r": [
        {"text": "", "body": LONG, "author": {"firstName": "F"}, "score": "4.5"},
        {"content": LONG, "author": "Plain"}, {"message": "short", "rating": "bad"},
        {"text": LONG, "rating": "bad"}, {"text": LONG, "author": "late"}]})
    got = [(n, r) for n, r, _ in found(extract.extract_embedded_state(pages(spark, html)))]
    assert got == [("F", 4.5), ("Plain", None)]


def block(spark, html, profile):
    return found(extract.extract_blocks(pages(spark, html, profile=profile)))


def test_blocks_with_unclosed_tags_and_references(spark):
    html = (f'<div class="x ReviewCard"><strong>Zoe &amp; Co</strong><p>{LONG}<br>end'
            '<script>no</script></div><div class="ReviewCard"><p>short</p></div>')
    assert block(spark, html, "cesarine") == [("Zoe & Co", None, LONG + "end")]


def test_block_rules_are_tried_in_order(spark):
    html = (f'<div class="review">{LONG}<p>{LONG}</p></div>'
            f'<article data-testid="review"><p>{LONG} last</p></article>')
    assert block(spark, html, "cesarine") == [("Unknown", None, LONG)]
    assert block(spark, html, "airbnb") == [("Unknown", 5.0, LONG + " last")]


@pytest.mark.parametrize("hint, rating", [
    ('<i aria-label="Rated 4.5 out of 5 stars"></i>', 4.5),
    ('<i class="ui_bubble_rating"></i>', 1.0),
    ('<svg class="inactive"></svg>' * 7, 5.0),
    ('<i data-rating="bad"></i><i data-score="3.5"></i>', 3.5),
    ("<b>3/5/2024</b>", 3.0), ("<b>4.5 out of 5</b>", 4.5), ("", None),
])
def test_block_ratings(spark, hint, rating):
    html = f'<div class="ReviewCard">{hint}<p>{LONG}</p></div>'
    assert block(spark, html, "cesarine") == [("Unknown", rating, LONG)]


def test_tripadvisor_block(spark):
    html = ('<div data-reviewid="7"><a class="username">Ann</a><i class="userLocation">London</i>'
            f'<time datetime="2024-03-05">x</time><q>{LONG}</q></div>')
    row = extract.extract_blocks(pages(spark, html, profile="tripadvisor")).first()
    assert (row["reviewer_name"], row["reviewer_location"], row["date_raw"]) \
        == ("Ann", "London", "2024-03-05")


def test_site_takes_the_whole_block(spark):
    html = f'<div class="testimonial"><cite>Ann</cite> {LONG}</div><p class="review">few words</p>'
    assert block(spark, html, "site") == [("Ann", None, f"Ann {LONG}")]


def test_cascade_order_per_profile(spark):
    both = ld(review(author="ld")) + state({"r": [{"text": LONG, "author": "state"}]})
    blocks = f'<div class="ReviewCard"><strong>block</strong><p>{LONG}</p></div>'
    for profile, html, strategy in [
        ("cesarine", both + blocks, "json_ld"), ("cesarine_rendered", both + blocks, "state"),
        ("cesarine", state({"r": [{"text": "short"}]}) + blocks, "blocks"),
        ("airbnb", both, "state"), ("viator", both, None),
    ]:
        row = extract.extract_reviews(pages(spark, html, profile=profile)).first()
        assert row["strategy"] == strategy, profile


def test_state_counts_on_first_result_page_only(spark):
    html = state({"r": [{"text": LONG}]})
    table = pages(spark, html, html, profile="tripadvisor").withColumn(
        "url", F.concat("url", F.when(F.col("page_id") == 1, "-or10-").otherwise("")))
    got = {r["page_id"]: r["strategy"] for r in extract.extract_reviews(table).collect()}
    assert got == {0: "state", 1: None}


def test_pages_without_reviews(spark):
    table = pages(spark, "<title>T</title><p>a &amp;\nb &eacute;</p>", ld(review()))
    rows = extract.pages_without_reviews(extract.extract_reviews(table)).collect()
    assert [(r["page_id"], r["snippet"]) for r in rows] == [(0, "Ta & b é")]


def test_all_profiles_have_known_strategies():
    assert {s for p in PROFILES.values() for s in p.strategies} == {"json_ld", "state", "blocks"}


def note_rows(spark, text):
    files = spark.createDataFrame([("f.md", text)], "path string, value string")
    rows = notes.parse_notes(files).orderBy("pos").collect()
    return [(r["reviewer_name"], r["reviewer_location"], r["date_raw"], r["review_text"])
            for r in rows]


def test_notes(spark):
    text = (f'intro\n**Ann** from London — January 2024\n★★★★★\n"{LONG}\nmore"\n\n'
            f"**Bob** - 2023\n{LONG}\n\n**Cy** - 2022\nless than ten words in this text\n")
    # A closing quote on a later line is part of the text.
    assert note_rows(spark, text) == [
        ("Ann", "London", "January 2024", f'{LONG} more"'), ("Bob", "", "2023", LONG)]
    assert note_rows(spark, "nothing here") == [] == note_rows(spark, "")


def test_frontier_leaves_out_captured_pages_and_late_pages(spark):
    urls = ["http://t/a-or10-R.html", "http://t/a-or20-R.html", "http://t/b-or10-R.html"]
    table = pages(spark, *[""] * 3).drop("profile").withColumn(
        "url", F.get(F.array(*map(F.lit, urls)), F.col("page_id").cast("int")))
    got = sorted(r["url"] for r in frontier.crawl_frontier(table, 10).collect())
    assert got == ["http://t/a-or30-R.html", "http://t/b-or20-R.html"]
    assert frontier.crawl_frontier(table, 3).count() == 1


def test_a_long_note_is_read(spark):
    import re

    lines = "\n".join(f"line {i} of a long note" for i in range(100_000))
    short = "**Bob** from Paris - 2023\n\"" + LONG + "\nmore\n" + "x" * 250 + "\n**Cy** from Rome - 2022\n" + LONG
    files = spark.createDataFrame(
        [("long.md", f"**Ann** from Rome — 2024\n{LONG}\n{lines}"), ("short.md", short)],
        "path string, value string")
    found = {(r["url"], r["reviewer_name"]): r["review_text"] for r in notes.parse_notes(files).collect()}
    assert set(found) == {("long.md", "Ann"), ("short.md", "Bob"), ("short.md", "Cy")}
    assert found["long.md", "Ann"].endswith("line 99999 of a long note")
    # The signs that keep Java's stack flat change no match.
    loose = notes._NOTE.replace("(?mU)", "(?m)").replace("++", "+").replace("}+)*+", "})*")
    assert [m[1] for m in re.finditer(loose, short)] == ["Bob", "Cy"]
    whole = [" ".join(m[4].split()) for m in re.finditer(loose, short)]
    assert [found["short.md", n] for n in ("Bob", "Cy")] == whole


def test_half_a_surrogate_pair_does_not_end_the_job(spark):
    data = '{"props":{"items":[{"text":"cut \\ud83d ' + LONG + '","user":{"name":"A\\ud83d"}}]}}'
    html = f'<script id="__NEXT_DATA__" type="application/json">{data}</script>'
    pages = spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string")
    row = extract.extract_embedded_state(pages).first()
    assert row["reviewer_name"] == "A?" and row["review_text"].startswith("cut ? ")


def test_script_ids_are_exact(spark):
    data = '{"props":{"items":[{"text":"' + LONG + '"}]}}'
    pages = spark.createDataFrame(
        [(1, "u", f'<SCRIPT ID="__next_data__">{data}</SCRIPT>'),
         (2, "u", f'<SCRIPT ID="__NEXT_DATA__">{data}</SCRIPT>')],
        "page_id long, url string, html string")
    assert [r["page_id"] for r in extract.extract_embedded_state(pages).collect()] == [2]


def test_the_last_of_repeated_members_counts(spark):
    data = '{"@type":"Review","author":"x","author":"y","reviewBody":"' + LONG + '"}'
    html = f'<script type="application/ld+json">{data}</script>'
    pages = spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string")
    assert extract.extract_json_ld(pages).first()["reviewer_name"] == "y"


def test_unreadable_data_is_told(spark):
    bad = '<script type="application/ld+json">{"a":</script><script id="__NEXT_DATA__">{</script>'
    pages = spark.createDataFrame(
        [(1, "u", bad), (2, "u", "<p>x</p>"), (3, "u", None)], "page_id long, url string, html string")
    found = extract.extraction_failures(pages).collect()
    assert sorted((r["page_id"], r["strategy"]) for r in found) == [(1, "json_ld"), (1, "state")]


def test_references_do_not_reach_across_tags(spark):
    """A reference ends at a tag, with or without its semicolon; what follows adds nothing to it."""
    pages = spark.createDataFrame([
        (1, "<title>Rock &am</title><p>p; Roll</p>"), (2, "<b>A &amp</b>B &lt;i&gt;"),
        (3, "&<!-- x -->amp;&<script>1</script>gt;"), (4, "no reference"), (5, None)], "id long, html string")
    got = {r[0]: r[1] for r in pages.select("id", extract.page_snippet(F.col("html"))).collect()}
    assert got == {1: "Rock &amp; Roll", 2: "A &B <i>", 3: "&amp;&gt;", 4: "no reference", 5: None}
