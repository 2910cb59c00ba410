"""Queries over stored listings: parsing, predicates, joins, statistics, changes (the F, P, J, A, W, U and M rows)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import geo, parse, rules, text
from tessera.operators import filters, score, store, tables
from tessera.plans import views
from tessera.registry import sqltext as q
from tessera.registry.base import query
from tessera.sources import files, requests

NOW = "timestamp'1996-01-10 00:00:00'"


def L(spark: SparkSession, d: str) -> DataFrame:  # noqa: N802
    return views.listings(spark, d)


def S(spark: SparkSession, d: str) -> DataFrame:  # noqa: N802
    return score.scored(views.listings(spark, d))


# --- F: scalar functions ---
@query("f1_listing_id", q.listings("SELECT seq, left(sha1(url), 12) AS id FROM listings"))
def f1(spark, d):
    return L(spark, d).select("seq", text.listing_id(F.col("url")).alias("id"))


@query("f2_canonical", q.listings("SELECT CASE WHEN seq % 3 = 0 THEN id ELSE left(sha1(CASE WHEN url <> '' THEN url ELSE title END), 12) END AS id, title, price, city, '' AS voivodeship, url, source AS source_portal, title AS raw_description, area, '' AS fraction FROM listings"))
def f2(spark, d):
    raw = L(spark, d).select(F.when(F.col("seq") % 3 == 0, F.col("id")).alias("id"), "title", "price", F.col("city").alias("location"), F.col("url").alias("source_url"), F.col("source").alias("portal"), F.col("area").alias("area_m2"), "is_active")
    return tables.canonical(raw).drop("extra")


_prices = "CASE seq % 6 WHEN 0 THEN '150 000 zł' WHEN 1 THEN '150.000 PLN' WHEN 2 THEN '1.250.000,00' WHEN 3 THEN '99 zł' WHEN 4 THEN seq || ',50 zł do negocjacji' ELSE 'brak' END"


def price_text() -> F.Column:
    k = F.col("seq")
    return F.when(k % 6 == 0, "150 000 zł").when(k % 6 == 1, "150.000 PLN").when(k % 6 == 2, "1.250.000,00").when(k % 6 == 3, "99 zł").when(k % 6 == 4, F.concat(k.cast("string"), F.lit(",50 zł do negocjacji"))).otherwise("brak")


_clean = "replace(regexp_replace(regexp_replace(p, 'do negocjacji|PLN|zł', '', 'g'), '[^0-9,.]', '', 'g'), ',', '.')"
_dots = "length(c) - length(replace(c, '.', ''))"


@query("f4_olx_price", q.listings(f"SELECT seq, CASE WHEN v >= 100 OR v = 0 THEN v END AS price FROM (SELECT seq, try_cast(CASE WHEN {_dots} > 1 OR {_dots} = 1 AND length(split_part(c, '.', 2)) = 3 THEN replace(c, '.', '') ELSE c END AS DOUBLE) AS v FROM (SELECT seq, {_clean} AS c FROM (SELECT seq, {_prices} AS p FROM listings)))"))
def f4(spark, d):
    return L(spark, d).select("seq", parse.olx_price(price_text()).alias("price"))


@query("f5_digits_price", q.listings(f"SELECT seq, try_cast(regexp_replace({_prices}, '[^0-9]', '', 'g') AS DOUBLE) AS price FROM listings"))
def f5(spark, d):
    return L(spark, d).select("seq", parse.digits_price(price_text()).alias("price"))


@query("f6_plain_price", q.listings(f"SELECT seq, try_cast(replace(regexp_replace({_prices}, '[^0-9,.]', '', 'g'), ',', '.') AS DOUBLE) AS price FROM listings"))
def f6(spark, d):
    return L(spark, d).select("seq", parse.plain_price(price_text()).alias("price"))


@query("f7_area", q.listings("SELECT seq, area::INT::DOUBLE + 0.5 AS m2 FROM listings"))
def f7(spark, d):
    return L(spark, d).select("seq", parse.area(F.concat(F.lit("ok. "), F.col("area").cast("int").cast("string"), F.lit(",5 m²"))).alias("m2"))


@query("f8_first_int", q.listings("SELECT seq, CASE WHEN seq % 4 = 0 THEN NULL ELSE (seq % 9)::INT END AS rooms FROM listings"))
def f8(spark, d):
    return L(spark, d).select("seq", parse.first_int(F.when(F.col("seq") % 4 == 0, "kawalerka").otherwise(F.concat((F.col("seq") % 9).cast("string"), F.lit(" pokoje, 4 piętro")))).alias("rooms"))


@query("f9_rooms", q.listings("SELECT seq, (CASE seq % 4 WHEN 0 THEN 2 WHEN 1 THEN seq % 7 WHEN 2 THEN 12 END)::INT AS rooms FROM listings"))
def f9(spark, d):
    k = F.col("seq")
    return L(spark, d).select("seq", parse.rooms(F.when(k % 4 == 0, "two").when(k % 4 == 1, (k % 7).cast("string")).when(k % 4 == 2, "TWELVE").otherwise("MORE")).alias("rooms"))


_place = "CASE seq % 3 WHEN 0 THEN 'Stroma, Tarninów, Legnica, dolnośląskie' WHEN 1 THEN 'mieszkanie Gdynia, Chwarzno' ELSE 'Kraków' END"


@query("f10_location", q.listings(f"SELECT seq, p[1] AS olx_city, CASE WHEN len(p) > 1 THEN p[-1] ELSE '' END AS olx_region, CASE WHEN len(p) >= 4 THEN p[-2] ELSE p[1] END AS morizon_city, regexp_replace(p[1], '^(mieszkanie|dom|lokal|działka)\\s+', '') AS domiporta_city FROM (SELECT seq, list_transform(string_split({_place}, ','), lambda x: trim(x)) AS p FROM listings)"))
def f10(spark, d):
    k = F.col("seq")
    x = F.when(k % 3 == 0, "Stroma, Tarninów, Legnica, dolnośląskie").when(k % 3 == 1, "mieszkanie Gdynia, Chwarzno").otherwise("Kraków")
    olx, morizon, domiporta = (parse.location(x, n) for n in ("olx", "morizon", "domiporta"))
    return L(spark, d).select("seq", olx[0].alias("olx_city"), olx[1].alias("olx_region"), morizon[0].alias("morizon_city"), domiporta[0].alias("domiporta_city"))


@query("f11_before_date", q.listings("SELECT seq, city AS place FROM listings"))
def f11(spark, d):
    return L(spark, d).select("seq", parse.before_date(F.concat("city", F.lit(" - Dzisiaj 14:30"))).alias("place"))


@query("f12_share_mark", q.listings("SELECT seq, list_bool_or(list_transform(['udział', 'udzial', '1/2', '1/3', '1/4', '1/6', '1/8', 'współwłasność', 'wspolwlasnosc'], lambda w: contains(lower(title), w))) AS is_share, nullif(regexp_extract(title, '[0-9]+/[0-9]+'), '') AS fraction FROM listings"))
def f12(spark, d):
    return L(spark, d).select("seq", parse.marked_share(F.col("title")).alias("is_share"), parse.first_fraction(F.col("title")).alias("fraction"))


@query("f14_land_register", q.listings("SELECT seq, CASE WHEN contains(raw_description, 'KW nr') THEN 'WA1M/12345678/9' END AS kw, CASE WHEN contains(raw_description, 'KW nr') THEN 'WA1M/********/*' END AS masked FROM listings"))
def f14(spark, d):
    return L(spark, d).select("seq", parse.land_register(F.col("raw_description"), masked=False).alias("kw"), parse.land_register(F.col("raw_description")).alias("masked"))


@query("f15_parameters", q.listings("SELECT seq, '45 m' AS area, seq::VARCHAR AS last FROM listings"))
def f15(spark, d):
    p = parse.parameters(F.array(F.lit("Powierzchnia: 45 m"), F.lit("bez znaku"), F.lit("Numer: 0"), F.concat(F.lit("numer : "), F.col("seq").cast("string"))))
    return L(spark, d).select("seq", p["powierzchnia"].alias("area"), p["numer"].alias("last"))


@query("f16_cut", "SELECT doc_id, left(text, 120) AS short, length(left(text, 1500)) AS n FROM documents")
def f16(spark, d):
    return views.table(spark, d, "documents").select("doc_id", F.substring("text", 1, 120).alias("short"), F.length(F.substring("text", 1, 1500)).cast("long").alias("n"))


@query("f17_without_marks", q.listings("SELECT seq, translate(lower(title), 'ąćęłńóśźż', 'acelnoszz') AS t FROM listings"))
def f17(spark, d):
    return L(spark, d).select("seq", text.without_marks(F.col("title")).alias("t"))


@query("f18_haversine", q.listings(f"SELECT seq, round({q.haversine('52.2297', '21.0122', 'latitude', 'longitude')}, 6) AS km FROM listings"))
def f18(spark, d):
    return L(spark, d).select("seq", F.round(geo.haversine(F.lit(52.2297), F.lit(21.0122), F.col("latitude"), F.col("longitude")), 6).alias("km"))


@query("f19_typed_number", q.listings("SELECT seq, (CASE WHEN seq % 2 = 0 THEN seq % 900 * 1000 ELSE seq END)::INT AS n FROM listings"))
def f19(spark, d):
    k = F.col("seq")
    return L(spark, d).select("seq", parse.typed_number(F.when(k % 2 == 0, F.concat((k % 900).cast("string"), F.lit("k"))).otherwise(F.format_number(k, 0))).alias("n"))


@query("f23_action_filters", q.listings("SELECT seq, CASE WHEN seq % 2 = 0 THEN city END AS city, CASE WHEN seq % 2 = 0 THEN seq::VARCHAR END AS most FROM listings"))
def f23(spark, d):
    k = F.col("seq")
    m = parse.action_filters(F.when(k % 2 == 0, F.concat(F.lit("Dobrze. [ACTION:filters city="), "city", F.lit(" price_max="), k.cast("string"), F.lit("]"))).otherwise("Nic."))
    return L(spark, d).select("seq", m["filter_city"].alias("city"), m["filter_price_max"].alias("most"))


@query("f26_validated", q.listings("SELECT seq, source, greatest(0, least(100, seq % 300 - 50))::BIGINT AS score, nullif(concat_ws(', ', CASE WHEN source = 'nieruchomosci_online' THEN 'source' END, CASE WHEN seq % 5 = 4 THEN 'status' END, CASE WHEN seq % 4 > 2 THEN 'priority' END), '') AS rejected FROM listings"))
def f26(spark, d):
    k = F.col("seq")
    raw = L(spark, d).select("seq", F.upper("source").alias("source"), (k % 300 - 50).alias("score"), F.when(k % 5 == 4, "gone").otherwise("NEW").alias("status"), (k % 4).alias("priority"))
    return store.validated(raw).select("seq", "source", "score", "rejected")


@query("f27_price_per_m2", q.listings("SELECT seq, round(price / nullif(area, 0), 6) AS per_m2 FROM listings"))
def f27(spark, d):
    return L(spark, d).select("seq", F.round(F.try_divide("price", "area"), 6).alias("per_m2"))


# --- P: predicates ---
@query("p1_by_score", q.scored("SELECT seq FROM scored WHERE coalesce(score, 0) >= 50"))
def p1(spark, d):
    return filters.by_score(S(spark, d)).select("seq")


@query("p2_by_price", q.listings("SELECT seq, price FROM listings WHERE price BETWEEN 50000 AND 100000"))
def p2(spark, d):
    return filters.by_price(L(spark, d), 50_000, 100_000).select("seq", "price")


@query("p3_by_location", q.listings(f"SELECT seq FROM listings WHERE voivodeship = 'pomorskie' AND (coalesce({q.haversine('latitude', 'longitude', '54.352', '18.6466')} <= 25, FALSE) OR latitude IS NULL AND city = 'Gdańsk')"))
def p3(spark, d):
    return filters.by_location(L(spark, d), views.cities(spark), voivodeship=" POMORSKIE", city="Gdańsk", km=25).select("seq")


@query("p4_by_radius", q.listings(f"SELECT seq, round({q.haversine('52.2297', '21.0122', 'latitude', 'longitude')}, 2) AS distance_km FROM listings WHERE {q.haversine('52.2297', '21.0122', 'latitude', 'longitude')} <= 20"))
def p4(spark, d):
    return filters.by_radius(L(spark, d), 52.2297, 21.0122, 20).select("seq", "distance_km")


@query("p5_by_class", q.classified("SELECT seq FROM classified WHERE tier_n <= 2 AND property_type = 'dom' AND contains(lower(city), 'kra')"))
def p5(spark, d):
    from tessera.operators.classify import classified

    return filters.by_class(classified(S(spark, d)), property_type="dom", city="KRA", least_tier="prawdopodobny").select("seq")


@query("p6_stored", q.scored("SELECT id, score, price FROM scored WHERE source = 'olx' AND is_active AND score >= 25 AND price >= 10000 ORDER BY price, id LIMIT 50 OFFSET 20"))
def p6(spark, d):
    return filters.stored(S(spark, d), source="olx", city="", min_score=25, min_price=10_000, order="price ASC", offset=20).select("id", "score", "price")


@query("p7_by_keywords", q.scored("SELECT seq FROM scored WHERE is_share OR contains(lower(title), 'garaż') OR contains(lower(title), 'dom')"))
def p7(spark, d):
    return filters.by_keywords(S(spark, d), ["Garaż", "dom"]).select("seq")


@query("p8_candidates", q.scored("SELECT seq, score FROM scored WHERE score > 0"))
def p8(spark, d):
    return filters.candidates(S(spark, d)).select("seq", "score")


@query("p9_suggest_cities", q.with_(q.CITIES_SQL, select="SELECT name, population FROM cities WHERE contains(translate(lower(name), 'ąćęłńóśźż', 'acelnoszz'), 'gd') ORDER BY population DESC LIMIT 10"))
def p9(spark, d):
    return filters.suggest_cities(views.cities(spark), " GD").select("name", "population")


@query("p10_find_city", q.with_(q.CITIES_SQL, select="SELECT name, lat, lon FROM cities WHERE name = 'Łódź'"))
def p10(spark, d):
    return filters.find_city(views.cities(spark), "lodz").select("name", "lat", "lon")


@query("p11_cities_in", q.with_(q.CITIES_SQL, select="SELECT name FROM cities WHERE voivodeship = 'pomorskie'"))
def p11(spark, d):
    return filters.cities_in(views.cities(spark), "Pomorskie ").select("name")


@query("p11_voivodeships", "SELECT * FROM (VALUES " + ", ".join(f"('{v}')" for v in rules.VOIVODESHIPS) + ") t(voivodeship)")
def p11_all(spark, d):
    return spark.createDataFrame([(v,) for v in rules.VOIVODESHIPS], "voivodeship string")


@query("o7_top_cities", "SELECT c_name AS name, c_custkey * 7919 % 100003 AS population FROM customer ORDER BY population DESC, name LIMIT 20")
def o7(spark, d):
    places = views.table(spark, d, "customer").select(F.col("c_name").alias("name"), (F.col("c_custkey") * 7919 % 100003).alias("population"))
    return filters.largest_cities(places)


@query("p13_allowed", "SELECT c_custkey, c_nationkey = 7 AS by_owner, TRUE AS by_anyone FROM customer")
def p13(spark, d):
    c, nobody = views.table(spark, d, "customer"), F.when(F.col("c_custkey") > 0, F.col("c_nationkey"))
    return c.select("c_custkey", filters.allowed(nobody, 7).alias("by_owner"), filters.allowed(nobody, 0).alias("by_anyone"))


@query("j8_with_keywords", q.with_(q.LISTINGS_SQL, "k AS (SELECT DISTINCT CASE WHEN s_suppkey % 3 = 0 THEN 'UDZIAŁ' || CASE WHEN s_suppkey % 2 = 0 THEN ' W' ELSE '' END ELSE s_suppkey::VARCHAR END AS keyword FROM supplier)", select="SELECT seq, keyword FROM listings JOIN k ON contains(lower(title), lower(keyword))"))
def j8(spark, d):
    k = F.col("s_suppkey")
    words = views.table(spark, d, "supplier").select(F.when(k % 3 == 0, F.concat(F.lit("UDZIAŁ"), F.when(k % 2 == 0, " W").otherwise(""))).otherwise(k.cast("string")).alias("keyword"))
    return filters.with_keywords(L(spark, d), words).select("seq", "keyword")


_low, _high = "CASE WHEN seq % 2 = 0 THEN (seq % 9 * 10000)::VARCHAR END", "CASE WHEN seq % 3 = 0 THEN (seq % 9 * 10000 + 50000)::VARCHAR END"
_esc = lambda x: f"replace(url_encode({x}), '%20', '+')"


@query("s9_search_urls", q.listings(f"SELECT seq, 'https://www.nieruchomosci-online.pl/szukaj.html?' || concat_ws('&', 'text=' || {_esc('title')}, '3_price_from=' || {_low}, '3_price_to=' || {_high}, '1_location=' || {_esc('city')}, '3_area_from=' || CASE WHEN seq % 5 = 0 THEN '20' END) AS a, 'https://www.szybko.pl/szukaj?' || concat_ws('&', 'q=' || {_esc('title')}, 'type=nieruchomosci', 'price_from=' || {_low}, 'price_to=' || {_high}, 'city=' || {_esc('city')}, 'area_from=' || CASE WHEN seq % 5 = 0 THEN '20' END) AS b, 'https://api.allegro.pl?' || concat_ws('&', 'phrase=' || {_esc('title')}, 'category.id=100249', 'sort=-relevance', 'limit=50', 'price.from=' || {_low}, 'price.to=' || {_high}, 'location.city=' || {_esc('city')}) AS c FROM listings"))
def s9(spark, d):
    k = F.col("seq")
    asked = F.create_map(F.lit("price_min"), F.when(k % 2 == 0, (k % 9 * 10000).cast("string")), F.lit("price_max"), F.when(k % 3 == 0, (k % 9 * 10000 + 50000).cast("string")), F.lit("city"), F.col("city"), F.lit("area_min"), F.when(k % 5 == 0, "20"), F.lit("rooms"), F.lit("3"))
    return L(spark, d).select("seq", *(requests.search_url(p, F.col("title"), asked).alias(name) for name, p in (("a", "nieruchomosci_online"), ("b", "szybko"), ("c", "allegro"))))


@query("p12_active_filters", "SELECT c_name AS name FROM customer WHERE c_custkey % 4 <> 0")
def p12(spark, d):
    c = views.table(spark, d, "customer").select(F.col("c_name").alias("name"), (F.col("c_custkey") % 4 != 0).alias("is_active"))
    return filters.active_filters(c).select("name")


@query("p14_given", q.listings("SELECT seq, CASE WHEN seq % 3 <> 0 THEN city END AS city, CASE WHEN seq % 5 <> 0 THEN (seq % 5)::VARCHAR END AS most FROM listings"))
def p14(spark, d):
    k = F.col("seq")
    m = filters.given(F.create_map(F.lit("city"), F.when(k % 3 != 0, F.col("city")).otherwise(""), F.lit("most"), (k % 5).cast("string")))
    return L(spark, d).select("seq", m["city"].alias("city"), m["most"].alias("most"))


# --- J: joins ---
@query("j1_saved_listings", q.with_(q.LISTINGS_SQL, views.SAVED_SQL, select="SELECT s.id, listing_id, status, priority, title, price FROM saved s JOIN listings l ON l.id = listing_id WHERE status = 'new'"))
def j1(spark, d):
    return tables.saved_with_listings(views.saved(spark, d), L(spark, d), status="new").select("id", "listing_id", "status", "priority", "title", "price")


@query("j2_saved_titles", q.with_(q.LISTINGS_SQL, views.SAVED_SQL, select="SELECT s.id, coalesce(title, notes, '(bez tytułu)') AS title FROM saved s LEFT JOIN listings l ON l.id = listing_id"))
def j2(spark, d):
    return tables.saved_with_titles(views.saved(spark, d), L(spark, d)).select("id", "title")


@query("j3_existing", q.with_(q.LISTINGS_SQL, views.SAVED_SQL, select="SELECT s.id FROM saved s WHERE EXISTS (SELECT 1 FROM listings l WHERE l.id = listing_id)"))
def j3(spark, d):
    return tables.existing(views.saved(spark, d), L(spark, d)).select("id")


@query("j4_missing", q.with_(q.LISTINGS_SQL, views.SAVED_SQL, select="SELECT s.id FROM saved s WHERE NOT EXISTS (SELECT 1 FROM listings l WHERE l.id = listing_id)"))
def j4(spark, d):
    return tables.missing(views.saved(spark, d), L(spark, d)).select("id")


@query("j5_near_centres", q.with_(q.LISTINGS_SQL, q.CITIES_SQL, select=f"SELECT seq, name AS centre, round({q.haversine('latitude', 'longitude', 'lat', 'lon')}, 2) AS distance_km FROM listings, cities WHERE {q.haversine('latitude', 'longitude', 'lat', 'lon')} <= 40"))
def j5(spark, d):
    return filters.near_centres(L(spark, d), views.cities(spark).select(F.col("name").alias("centre"), "lat", "lon"), 40).select("seq", "centre", "distance_km")


@query("j6_coordinates", q.with_(q.LISTINGS_SQL, q.CITIES_SQL, select="SELECT seq, lat, lon FROM listings JOIN cities ON name = city"))
def j6(spark, d):
    odd = L(spark, d).withColumn("city", F.when(F.col("seq") % 2 == 0, text.without_marks(F.col("city"))).otherwise(F.col("city")))
    return tables.with_coordinates(odd, views.cities(spark)).select("seq", "lat", "lon")


@query("j9_with_detail", q.listings("SELECT seq, coalesce(area, 50.0) AS area, CASE WHEN seq % 2 = 0 THEN 'opis' END AS full_description FROM listings"))
def j9(spark, d):
    base = L(spark, d)
    detail = base.where("seq % 2 = 0 OR area IS NULL").select("id", F.lit(50.0).alias("area"), F.when(F.col("seq") % 2 == 0, "opis").alias("full_description"))
    return tables.with_detail(base, detail).select("seq", "area", "full_description")


# --- A, W, U ---
@query("a1_totals", q.scored("SELECT count(*) AS total, count(*) FILTER (is_active) AS active, count(*) FILTER (is_share) AS shares FROM scored"))
def a1(spark, d):
    return tables.totals(S(spark, d))


@query("a2_by_source", q.listings("SELECT source, count(*) AS n FROM listings GROUP BY source"))
def a2(spark, d):
    return tables.by_source(L(spark, d))


@query("a4_portal_status", q.listings("SELECT p AS portal, CASE WHEN p = 'olx' THEN 'timeout' ELSE 'done' END AS status, count(seq) AS count FROM unnest(['otodom', 'morizon', 'domiporta', 'olx', 'nieruchomosci_online']) t(p) LEFT JOIN listings ON source = p AND source <> 'olx' GROUP BY p"))
def a4(spark, d):
    return tables.portal_status(L(spark, d).where("source <> 'olx'"), {"olx": "timeout"})


@query("a9_duplicates_removed", q.listings("SELECT count(*) - count(DISTINCT url) AS removed FROM listings WHERE url <> ''"))
def a9(spark, d):
    return tables.duplicates_removed(L(spark, d))


_rank = "CASE source WHEN 'otodom' THEN 1 WHEN 'morizon' THEN 2 WHEN 'domiporta' THEN 3 WHEN 'olx' THEN 4 WHEN 'nieruchomosci_online' THEN 5 ELSE 6 END"


@query("w1_first_by_url", q.listings(f"SELECT url, seq, source, title FROM listings WHERE url <> '' QUALIFY row_number() OVER (PARTITION BY url ORDER BY {_rank}, seq) = 1"))
def w1(spark, d):
    return tables.first_by_url(L(spark, d)).select("url", "seq", "source", "title")


@query("w5_across_portals", q.with_(q.LISTINGS_SQL, "t AS (SELECT *, regexp_replace(title, ' nr .*', '') AS short FROM listings)", "one AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY lower(short), seq % 500 ORDER BY seq) = 1)", select="SELECT seq FROM one WHERE area IS NULL UNION ALL SELECT seq FROM (SELECT seq FROM one WHERE area IS NOT NULL QUALIFY row_number() OVER (PARTITION BY price, area, city ORDER BY seq) = 1)"))
def w5(spark, d):
    short = L(spark, d).withColumn("title", F.concat(F.regexp_replace("title", " nr .*", ""), (F.col("seq") % 500).cast("string")))
    return tables.across_portals(short).select("seq")


@query("u1_union", q.listings(f"SELECT seq, source, {_rank} AS portal_rank FROM listings WHERE source IN ('olx', 'otodom')"))
def u1(spark, d):
    df = L(spark, d).select("seq", "source", "area")
    return tables.union_sources([df.where("source = 'olx'").drop("area"), df.where("source = 'otodom'")]).select("seq", "source", "portal_rank")


@query("u2_portals", "SELECT unnest(['otodom', 'olx']) AS portal, unnest([0, 1]) AS place")
def u2(spark, d):
    chosen = tables.chosen_portals(["olx", "szybko", "otodom"])
    return spark.createDataFrame(list(enumerate(chosen)), "place int, portal string")


@query("u3_difference", q.with_(views.SAVED_SQL, select="SELECT id FROM saved WHERE id % 27 <> 0"))
def u3(spark, d):
    s = views.saved(spark, d)
    return store.without(s, s.where("id % 27 = 0"), "id").select("id")


@query("u4_overlap", q.with_(q.LISTINGS_SQL, "a AS (SELECT DISTINCT url FROM listings WHERE seq % 3 <> 0)", "b AS (SELECT DISTINCT url FROM listings WHERE seq % 4 <> 0)", select="SELECT (SELECT count(*) FROM a) AS first, (SELECT count(*) FROM b) AS second, count(*) AS n_both, round(count(*) / (SELECT count(*) FROM a), 6) AS ratio FROM a JOIN b USING (url)"))
def u4(spark, d):
    df = L(spark, d)
    return tables.overlap(df.where("seq % 3 <> 0"), df.where("seq % 4 <> 0")).select(F.col("first").cast("long"), F.col("second").cast("long"), F.col("n_both").cast("long"), "ratio")


@query("o5_paging", q.listings("SELECT seq FROM listings ORDER BY price DESC, seq LIMIT 5 OFFSET 10"))
def o5(spark, d):
    return L(spark, d).orderBy(F.desc("price"), "seq").offset(10).limit(5).select("seq")


@query("o6_history", "SELECT event_id, ts FROM events ORDER BY ts DESC, event_id LIMIT 20")
def o6(spark, d):
    return views.table(spark, d, "events").orderBy(F.desc("ts"), "event_id").limit(20).select("event_id", "ts")


# --- S: scans over landed tables ---
@query("s11_first_pages", "WITH p AS (SELECT user_id % 5 AS portal, user_id % 20 AS keyword, (event_id % 4 + 1)::INT AS page, count(*) FILTER (event_type = 'purchase') AS n FROM events GROUP BY ALL) SELECT portal, keyword, page, n FROM p WHERE page <= 3 QUALIFY coalesce(max((n = 0)::INT) OVER (PARTITION BY portal, keyword ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0")
def s11(spark, d):
    e = views.table(spark, d, "events")
    p = e.groupBy((F.col("user_id") % 5).alias("portal"), (F.col("user_id") % 20).alias("keyword"), (F.col("event_id") % 4 + 1).cast("int").alias("page")).agg(F.count_if(F.col("event_type") == "purchase").alias("n"))
    return files.first_pages(p)


@query("s12_scan_plan", "SELECT n_name AS keyword, page::INT AS page FROM nation, range(1, 4) t(page)")
def s12(spark, d):
    return files.scan_plan(views.table(spark, d, "nation").select(F.col("n_name").alias("keyword")), 3)


@query("s13_sources", "SELECT source, count(*) AS n FROM (SELECT 'customers' AS source FROM customer UNION ALL SELECT 'suppliers' FROM supplier) GROUP BY source")
def s13(spark, d):
    frames, status = files.load_sources({"customers": lambda: views.table(spark, d, "customer").select("c_name"), "nothing": lambda: views.table(spark, d, "no_such_table"), "suppliers": lambda: views.table(spark, d, "supplier").select("s_name")})
    return tables.union_sources(frames).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("s18_rows", "SELECT s_suppkey, s_name FROM supplier WHERE s_acctbal > 0")
def s18(spark, d):
    return views.table(spark, d, "supplier").where("s_acctbal > 0").select("s_suppkey", "s_name")


@query("s10_empty", "SELECT ''::VARCHAR AS id, ''::VARCHAR AS source, ''::VARCHAR AS url, ''::VARCHAR AS title, ''::VARCHAR AS description, 0::DOUBLE AS price, 0::DOUBLE AS area, ''::VARCHAR AS city, ''::VARCHAR AS voivodeship, 0::DOUBLE AS latitude, 0::DOUBLE AS longitude, 0::INT AS score, TRUE AS is_share, TRUE AS is_active, TIMESTAMP '2000-01-01' AS first_seen_at, TIMESTAMP '2000-01-01' AS last_seen_at, TIMESTAMP '2000-01-01' AS created_at, TIMESTAMP '2000-01-01' AS updated_at WHERE FALSE")
def s10(spark, d):
    return files.empty_source(spark)


# --- M: changes ---
def batch(df: DataFrame) -> DataFrame:
    """Every fifth listing again, dearer, and some that are new."""
    some = df.where("seq % 5 = 0")
    return some.withColumn("price", F.col("price") + 1).unionByName(some.where("seq % 10 = 0").withColumns({"id": F.concat(F.lit("N"), F.col("seq").cast("string")), "url": F.concat(F.lit("https://example.com/nowa/"), F.col("seq").cast("string"))}))


@query("m1_upsert", q.with_(q.LISTINGS_SQL, "b AS (SELECT id, price + 1 AS price FROM listings WHERE seq % 5 = 0 UNION ALL SELECT 'N' || seq, price FROM listings WHERE seq % 10 = 0)", select="SELECT coalesce(l.id, b.id) AS id, CASE WHEN b.id IS NULL THEN l.price ELSE b.price END AS price, CASE WHEN l.id IS NULL THEN TIMESTAMP '1996-01-10' ELSE first_seen_at END AS first_seen_at, CASE WHEN b.id IS NULL THEN last_seen_at ELSE TIMESTAMP '1996-01-10' END AS last_seen_at, CASE WHEN b.id IS NULL THEN is_active ELSE TRUE END AS is_active, CASE WHEN b.id IS NULL THEN 'keep' WHEN l.id IS NULL THEN 'insert' ELSE 'update' END AS op FROM listings l FULL JOIN b ON l.id = b.id"))
def m1(spark, d):
    df = L(spark, d)
    return store.upsert(df.drop("seq"), batch(df), F.expr(NOW)).select("id", "price", "first_seen_at", "last_seen_at", "is_active", "op")


@query("m2_insert_or_ignore", q.listings("SELECT 'N' || seq AS id FROM listings WHERE seq % 10 = 0"))
def m2(spark, d):
    df = L(spark, d)
    return store.insert_or_ignore(df, batch(df)).select("id")


_save = q.with_(q.LISTINGS_SQL, views.SAVED_SQL, "r AS (SELECT 'L' || seq AS listing_id, 'n' || seq AS notes, 2 AS priority, seq FROM listings WHERE seq % 6 = 1 OR seq % 45 = 0)", "top AS (SELECT max(id) AS top FROM saved)",
    select="SELECT s.id, s.listing_id, CASE WHEN r.seq IS NULL THEN s.notes ELSE r.notes END AS notes, coalesce(r.priority, s.priority)::INT AS priority, status FROM saved s LEFT JOIN r USING (listing_id) UNION ALL SELECT top + row_number() OVER (ORDER BY seq), listing_id, notes, priority::INT, 'new' FROM r, top WHERE listing_id NOT IN (SELECT listing_id FROM saved)")


@query("m3_save", _save)
def m3(spark, d):
    df = L(spark, d)
    wanted = df.where("seq % 6 = 1 OR seq % 45 = 0").select(F.concat(F.lit("L"), F.col("seq").cast("string")).alias("listing_id"), F.concat(F.lit("n"), F.col("seq").cast("string")).alias("notes"), F.lit(2).alias("priority"), "seq")
    ghost = wanted.where("seq % 36 = 1").withColumn("listing_id", F.concat(F.lit("gone"), "listing_id"))
    out, _ = store.save(views.saved(spark, d), wanted.unionByName(ghost), df, F.expr(NOW))
    return out.select("id", "listing_id", "notes", "priority", "status")


@query("m4_unsave", q.with_(views.SAVED_SQL, select="SELECT id FROM saved WHERE status <> 'visited'"))
def m4(spark, d):
    s = views.saved(spark, d)
    return store.without(s, s.where("status = 'visited'"), "listing_id").select("id")


@query("m5_expire", q.listings("SELECT id, is_active AND NOT last_seen_at < TIMESTAMP '1996-01-10' - INTERVAL 72 HOUR AS is_active FROM listings"))
def m5(spark, d):
    return store.expired(L(spark, d), F.expr(NOW)).select("id", "is_active")


@query("m6_append", q.with_(views.SAVED_SQL, select="SELECT id, notes FROM saved UNION ALL SELECT -1, 'nowy'"))
def m6(spark, d):
    row = spark.createDataFrame([(-1, "nowy")], "id long, notes string")
    return store.append(views.saved(spark, d), row).select("id", "notes")


@query("m7_cascade", q.with_(q.LISTINGS_SQL, views.SAVED_SQL, select="SELECT id FROM saved WHERE listing_id IN (SELECT id FROM listings WHERE is_active)"))
def m7(spark, d):
    return store.cascade(views.saved(spark, d), L(spark, d).where("is_active")).select("id")
