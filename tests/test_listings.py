"""Pages and the listings they belong to."""

from pyspark.sql import functions as F

from reviewloom.plans.ingest import page_candidates

LISTING = "host_name string, city string, region string, platform string, url string"


def _page(i, url):
    data = ('<script type="application/ld+json">{"@type":"Review","reviewBody":'
            f'"one two three four five six {i}"}}</script>')
    return (i, url, data)


def test_pages_of_own_listings_are_spread(spark):
    """Joins of large listings, which nothing broadcasts: no task has most of the pages."""
    pages = spark.createDataFrame(
        [_page(i, f"http://h/{i}.html") for i in range(200)], "page_id long, url string, html string")
    listings = spark.createDataFrame(
        [(f"h{i}", "c", "r", "Cesarine", f"http://h/{i}.html") for i in range(200)], LISTING)
    given = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = page_candidates(pages, listings).select("host_name", "page_id", F.spark_partition_id().alias("p"))
        rows = found.collect()
    finally:
        for k, v in given.items():
            spark.conf.set(k, v)
    assert sorted((r["page_id"], r["host_name"]) for r in rows) == [(i, f"h{i}") for i in range(200)]
    assert max(sum(r["p"] == p for r in rows) for p in {r["p"] for r in rows}) < 100


def test_pages_of_an_offset_have_the_first_listing(spark):
    urls = ["http://h/g-Reviews-x.html", "http://h/g-or10-Reviews-x.html", "http://h/other.html", None]
    pages = spark.createDataFrame(
        [_page(i, u) for i, u in enumerate(urls)], "page_id long, url string, html string")
    listings = spark.createDataFrame(
        [("a", "c", "r", "Cesarine", urls[0]), ("b", "c", "r", "Cesarine", urls[0]),
         ("n", "c", "r", "Cesarine", None)], LISTING)
    got = page_candidates(pages, listings).collect()
    assert sorted((r["page_id"], r["host_name"]) for r in got if r["page_id"] != 1) == [(0, "a"), (0, "b")]
    assert sum(r["page_id"] == 1 for r in got) == 1
