"""Listings with what their pages say: what is taken, what stays, and which page counts."""

import datetime as dt

from pyspark.sql import functions as F

from tessera.sources import deep

LISTING = "id int, url string, source_portal string, area double, rooms int, street string"
PAGE = "url string, portal string, html string, status int, fetched_at timestamp"
LONG = "słowo " * 30
AD = '<script id="__NEXT_DATA__" type="application/json">{"props": {"pageProps": {"ad": %s}}}</script>'


def at(day):
    return dt.datetime(2024, 1, day)


def enriched(spark, listings, pages):
    out = deep.enrich(spark.createDataFrame(listings, LISTING), deep.read_details(spark.createDataFrame(pages, PAGE)))
    return out, {r.id: r for r in out.collect()}


def test_values_of_the_listing_stand_and_gaps_are_filled(spark):
    ad = AD % '{"description": "KW nr WA1M/12345678/9, opis", "areaInSquareMeters": 50, "roomsNumber": "THREE", "location": {"address": {"street": {"name": "Nowa"}, "district": {"name": ""}}}, "images": []}'
    out, rows = enriched(spark, [(1, "a", "otodom", None, None, "Stara"), (2, "a", "otodom", 40.0, 2, None)], [("a", "Otodom", ad, 200, at(1))])
    assert out.columns[:6] == ["id", "url", "source_portal", "area", "rooms", "street"] and out.schema["rooms"].dataType.simpleString() == "int"
    assert (rows[1].area, rows[1].rooms, rows[1].street) == (50.0, 3, "Stara") and (rows[2].area, rows[2].rooms, rows[2].street) == (40.0, 2, "Nowa")
    assert rows[1].kw_number == "WA1M/********/*" and rows[1].district is None and rows[1].photos_count is None and rows[1].deep_fetched


def test_failures_leave_the_listing_as_it_is(spark):
    listings = [(k, u, "olx", 30.0, None, None) for k, u in enumerate([None, "", " ", "none", "refused", "empty", "null", "broken", "silent"])]
    pages = [("refused", "olx", f"<p>{LONG}</p>", 403, at(1)), ("empty", "olx", "  ", 200, at(1)), ("null", "olx", None, 200, at(1)), ("broken", "otodom", AD % "{", 200, at(1)), ("silent", "gratka", "<p>krótko</p>", 200, at(1)), (None, "gratka", f"<p>{LONG}</p>", 200, at(1)), ("", "gratka", f"<p>{LONG}</p>", 200, at(1))]
    out, rows = enriched(spark, listings, pages)
    assert [rows[k].deep_fetched for k in range(9)] == [False] * 7 + [True] * 2
    assert all(r.full_description is None and r.area == 30.0 and r.url == u for (_, u, *_), r in zip(listings, (rows[k] for k in range(9)), strict=True))
    assert len(out.collect()) == 9


def test_the_latest_readable_page_counts(spark):
    page = lambda word: f"<div class='offer-description'>{word} {LONG}</div>"
    pages = [("a", "gratka", page("pierwsza"), 200, at(1)), ("a", "gratka", page("druga"), 200, at(2)), ("a", "gratka", page("trzecia"), 403, at(3)), ("a", "gratka", page("bez czasu"), 200, None), ("b", "gratka", page("x"), 200, at(1)), ("b", "gratka", page("y"), 200, at(1))]
    _, rows = enriched(spark, [(1, "a", "gratka", None, None, None), (2, "b", "gratka", None, None, None)], pages)
    assert rows[1].full_description.startswith("druga ") and rows[2].full_description.startswith("y ")


def test_lines_of_one_portal_fill_area_and_floor(spark):
    lines = "<ul class='param-list'><li>Powierzchnia 50 m²</li><li>Powierzchnia działki 300 m²</li><li>Piętro 3</li><li>Piętro parter</li></ul>"
    _, rows = enriched(spark, [(1, "a", "morizon", None, None, None), (2, "b", "gratka", None, None, None)], [("a", "morizon", lines, 200, at(1)), ("b", "gratka", lines, 200, at(1))])
    assert (rows[1].area, rows[1].floor) == (300.0, "3") and (rows[2].area, rows[2].floor) == (None, None)


def test_no_listings_and_no_pages(spark):
    out, rows = enriched(spark, [], [])
    assert rows == {} and out.columns[-1] == "deep_fetched"
    _, rows = enriched(spark, [(1, "a", "olx", None, 2, None)], [])
    assert not rows[1].deep_fetched and rows[1].rooms == 2


def test_listings_without_a_url_are_many_groups(spark):
    listings = spark.range(4000).select(F.col("id").cast("int").alias("id"), F.lit("").alias("url"), F.lit("olx").alias("source_portal"), F.lit(1.0).alias("area"), F.lit(1).alias("rooms"), F.lit("x").alias("street"))
    none = spark.createDataFrame([], "url string, full_description string, kw_number string, " + ", ".join(f"{c} {t}" for c, t in deep.TAKEN.items()))
    # the tables are tiny, so the join is made to shuffle
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = deep.enrich(listings, none).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(sizes) == 4 and max(r["count"] for r in sizes) < 2000


def test_coverage(spark):
    out, _ = enriched(spark, [(1, "a", "olx", None, None, None), (2, "b", "olx", None, None, None)], [("a", "gratka", f"<p>{LONG}</p>", 200, at(1))])
    assert deep.coverage(out).first() == ("olx", 2, 1, 1, 0)
