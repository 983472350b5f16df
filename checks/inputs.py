"""Review-shaped inputs that Spark derives from the given tables.

The tables hold texts but no ratings, places or page markup. Every row of a
table becomes a row of the input; ``oracle.py`` states the same derivation in
SQL. Values vary with the row number so that every branch of an operator is met.
"""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from reviewloom.functions.dates import parse_date
from reviewloom.functions.enrichment import (
    detect_occasion, infer_country, normalise_language,
)
from reviewloom.operators.profiles import PROFILES
from reviewloom.schema import COLUMNS
from reviewloom.sources.readers import read_pages, read_texts

PLATFORMS = ["Cesarine", "TripAdvisor", "Airbnb", "Viator", "Own site", "Blog"]
REGIONS = ["Como", "Garda", "Maggiore", "Iseo", "Tuscany"]
LOCATIONS = [
    "Venice, Italy", "San Bernardino, CA", "London", "Rio de Janeiro", "Germany", "Berlin",
    "Austin, TX", "Como, Italy", "Bucharest, Romania", "Birmingham, AL", "", "Zagreb",
]
DATES = [
    "January 2024", "2024-03-05T10:00:00Z", "13/05/2023", "Jan 2022", "January 15, 2024", "",
    "Reviewed 2021", "yesterday evening",
]

# What a text says last: a keyword of each occasion, and none.
OCCASIONS = [
    "on our honeymoon", "after ten years together", "a birthday treat", "with the kids", "",
    "for a hen night", "traveling alone", "a group of friends", "for team building", "no reason",
]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_texts(spark, f"{sf_dir}/documents.parquet")


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_texts(spark, f"{sf_dir}/conversations.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_pages(spark, f"{sf_dir}/pages.parquet")


def cycle(values: list[str], number: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), (number % len(values)).cast("int"))


def raw_columns() -> dict[str, Column]:
    n = F.col("doc_id")
    return {
        "seq": n,
        "platform": cycle(PLATFORMS, n),
        "region": cycle(REGIONS, n),
        "city": F.concat(F.lit("city"), (n % 23).cast("string")),
        "host_name": F.concat(F.lit("host"), (n % 37).cast("string")),
        "reviewer_name": F.col("source"),
        "reviewer_location": cycle(LOCATIONS, n),
        "language": normalise_language(F.col("lang")),
        "rating": F.when(n % 7 != 0, F.lit(5.0) - (n % 4) * 0.5),
        "date_raw": cycle(DATES, n),
        "review_text": F.concat("text", F.lit(" "), cycle(OCCASIONS, n)),
        "url": F.concat(F.lit("https://example.com/r/"), n.cast("string")),
    }


def raw_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One uncleaned review per document."""
    return documents(spark, sf_dir).select(*[c.alias(k) for k, c in raw_columns().items()])


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in the stored columns, enriched, with ``seq`` as id."""
    built = {
        "id": F.col("seq"),
        "reviewer_country": infer_country(F.col("reviewer_location")),
        "date": parse_date(F.col("date_raw")),
        "occasion": detect_occasion(F.col("review_text")),
    }
    return raw_reviews(spark, sf_dir).select(
        *[built.get(c, F.col(c)).alias(c) for c in COLUMNS])


def chat_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One review per turn of the conversations."""
    return conversations(spark, sf_dir).select(
        F.col("conv_id").alias("page_id"), F.col("turn").cast("int").alias("pos"),
        F.lit("Chat").alias("platform"), F.col("role").alias("reviewer_name"),
        F.col("text").alias("review_text"),
        F.concat(F.lit("chat/"), F.col("conv_id").cast("string"), F.lit("/"),
                 F.col("turn").cast("string")).alias("url"))


def document_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents in the columns of :func:`chat_reviews`."""
    return raw_reviews(spark, sf_dir).select(
        F.col("seq").alias("page_id"), F.lit(0).alias("pos"),
        "platform", "reviewer_name", "review_text", "url")


def titled_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The captured pages, every fifth of which says that it was refused."""
    refused = F.regexp_replace("html", "(?i)<title>", "<title>Access Denied ")
    return pages(spark, sf_dir).withColumn(
        "html", F.when(F.col("page_id") % 5 == 0, refused).otherwise(F.col("html")))


def _escaped(c: Column) -> Column:
    for raw, written in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(raw), F.lit(written))
    return c


def _tag(opening: str, content: Column) -> Column:
    name = opening.split()[0]
    return F.concat(F.lit(f"<{opening}>"), content, F.lit(f"</{name}>"))


def _html(*parts: Column) -> Column:
    return F.concat(F.lit("<html><head><title>Reviews</title></head><body>"), *parts,
                    F.lit("</body></html>"))


def _script(opening: str, data: Column) -> Column:
    return F.concat(F.lit(f"<script {opening}>"), F.replace(data, F.lit("<"), F.lit("\\u003c")),
                    F.lit("</script>"))


def json_ld_html() -> Column:
    """A review as JSON-LD: alone, in a list, or inside a product."""
    review = F.to_json(F.struct(
        F.lit("Review").alias("@type"), F.col("review_text").alias("reviewBody"),
        F.struct(F.col("reviewer_name").alias("name")).alias("author"),
        F.col("date_raw").alias("datePublished"),
        F.struct(F.col("rating").alias("ratingValue")).alias("reviewRating")))
    shape = F.col("seq") % 3
    data = (
        F.when(shape == 0, review)
        .when(shape == 1, F.concat(F.lit("["), review, F.lit("]")))
        .otherwise(F.concat(F.lit('{"@type":"Product","review":['), review, F.lit("]}"))))
    return _html(_script('type="application/ld+json"', data))


def state_html() -> Column:
    """A review in the state object of the page, three levels down."""
    data = F.to_json(F.struct(F.struct(F.struct(F.array(F.struct(
        F.col("review_text").alias("comment"),
        F.struct(F.col("reviewer_name").alias("username")).alias("user"),
        F.col("date_raw").alias("createdAt"),
        F.col("rating").alias("stars"),
    )).alias("items")).alias("pageProps")).alias("props")))
    return _html(_script('id="__NEXT_DATA__" type="application/json"', data))


def cut_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of embedded data; in every third its last bracket is missing."""
    whole = F.when(F.col("seq") % 2 == 0, json_ld_html()).otherwise(state_html())
    cut = F.regexp_replace(whole, "[}\\]]</script>", "</script>")
    return raw_reviews(spark, sf_dir).select(
        F.col("seq").alias("page_id"), "url",
        F.when(F.col("seq") % 3 == 0, cut).otherwise(whole).alias("html"))


PROFILE_NAMES = ["cesarine", "tripadvisor", "airbnb", "viator", "site", "cesarine_rendered"]


def block_html(profile: Column) -> Column:
    """A review as page markup, in the shape its profile looks for."""
    name, text = _escaped(F.col("reviewer_name")), _escaped(F.col("review_text"))
    place, day = _escaped(F.col("reviewer_location")), _escaped(F.col("date_raw"))
    stars = F.floor("rating").cast("int")
    label = F.coalesce(
        F.concat(F.lit('<span aria-label="Rated '), F.col("rating").cast("string"),
                 F.lit(' out of 5 stars"></span>')), F.lit(""))
    data = F.coalesce(
        F.concat(F.lit('<i data-score="'), F.col("rating").cast("string"), F.lit('"></i>')),
        F.lit(""))

    def repeated(mark: str) -> Column:
        return F.coalesce(F.repeat(F.lit(mark), stars), F.lit(""))

    shapes = {
        "cesarine": _tag('div class="x ReviewCard"', F.concat(
            _tag('h3 class="name"', name), _tag("time", day), label,
            _tag('p class="body"', text))),
        "cesarine_rendered": _tag('div class="the-Review"', F.concat(
            _tag('span class="authorName"', name), _tag('em class="date"', day), label,
            _tag("p", text))),
        "tripadvisor": _tag('div data-reviewid="1"', F.concat(
            _tag('a class="username"', name), _tag('span class="userLocation"', place),
            F.concat(F.lit('<span class="ratingDate" title="'), day, F.lit('"></span>')),
            repeated('<span class="ui_bubble_rating"></span>'), _tag("q", text))),
        "airbnb": _tag('div data-testid="pdp-review-card"', F.concat(
            _tag("h3", name), _tag('span class="hometown"', place),
            _tag('span class="date"', day), _tag('div class="comment"', text))),
        "viator": _tag('section class="ReviewItem"', F.concat(
            _tag('b class="reviewerName"', name), _tag("time", day), data, _tag("p", text))),
        "site": _tag('blockquote class="testimonial"', F.concat(
            _tag("cite", name), F.lit(" "), _tag("p", text))),
    }
    chosen = F.lit(None).cast("string")
    for key, shape in shapes.items():
        chosen = F.when(profile == key, shape).otherwise(chosen)
    return _html(chosen)


def block_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page of markup per document, all profiles in turn."""
    raw = raw_reviews(spark, sf_dir).withColumn("profile", cycle(PROFILE_NAMES, F.col("seq")))
    return raw.select(
        F.col("seq").alias("page_id"), "url", "profile",
        block_html(F.col("profile")).alias("html"))


def nested_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three reviews to a page, the second one's element within the first one's."""
    inside = F.concat(
        _tag('h3 class="name"', _escaped(F.col("reviewer_name"))),
        _tag('p class="body"', _escaped(F.col("review_text"))))
    three = raw_reviews(spark, sf_dir).select(
        F.floor(F.col("seq") / 3).alias("page_id"), F.struct("seq", inside.alias("inside")).alias("r"),
    ).groupBy("page_id").agg(F.array_sort(F.collect_list("r")).alias("r"))
    opening, closing = '<div class="x ReviewCard">', F.lit("</div>")

    def block(i: int, *within: Column) -> Column:
        given = F.get("r", F.lit(i))["inside"]
        return F.coalesce(F.concat(F.lit(opening), given, *within, closing), F.lit(""))

    return three.select(
        "page_id", F.lit("cesarine").alias("profile"),
        _html(block(0, block(1)), block(2)).alias("html"))


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listing of every derived page; all are read with one profile."""
    return raw_reviews(spark, sf_dir).select(
        "host_name", "city", "region", F.lit("Cesarine").alias("platform"), "url",
        F.when(F.col("seq") % 8 < 4, "cesarine").otherwise("cesarine_rendered")
        .alias("profile"))


def mixed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON-LD, state, markup and no review at all, in turn."""
    kind = F.col("seq") % 4
    return raw_reviews(spark, sf_dir).select(
        F.col("seq").alias("page_id"), "url",
        F.when(kind == 0, json_ld_html()).when(kind == 1, state_html())
        .when(kind == 2, block_html(F.lit("cesarine")))
        .otherwise(_html(_tag("h1", F.lit("Nothing &amp; more")),
                         _tag("p", _escaped(F.col("review_text"))))).alias("html"))


def result_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of result pages of all shapes, made from the captured pages."""
    n, shape = F.col("page_id"), F.col("page_id") % 5
    offset = F.concat(F.lit("-or"), ((n % 7) * 10).cast("string"), F.lit("-Reviews-x.html"))
    tail = (
        F.when(shape == 0, F.lit("-Reviews-x.html")).when(shape == 1, offset)
        .when(shape == 2, F.lit("-x.html?a=1")).when(shape == 3, F.lit("-Reviews-y.html"))
        .otherwise(F.lit("/plain")))
    button = F.when(shape == 3, F.lit("")).otherwise(F.lit('<a class="nav Next" href="#">more</a>'))
    return pages(spark, sf_dir).select(
        "page_id", (n % 11).alias("listing"),
        F.concat(F.lit("http://t.example/g"), (n % 11).cast("string"), tail).alias("url"),
        F.concat("html", button).alias("html"))


def note_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One Markdown note per document; quotes and line breaks become blanks.

    The guests have names of their own, so a note is no copy of a page's review.
    """
    flat = F.regexp_replace("review_text", "[\"“”\\n]", " ")
    return raw_reviews(spark, sf_dir).select(
        F.col("seq").alias("page_id"),
        F.concat(F.lit("note-"), F.col("seq").cast("string"), F.lit(".md")).alias("path"),
        F.concat(
            F.lit("**Guest "), "reviewer_name", F.lit("** from "), "reviewer_location", F.lit(" — "),
            "date_raw", F.lit("\n★★★★★\n\""), flat, F.lit("\"\n")).alias("value"))


assert set(PROFILE_NAMES) == set(PROFILES)
