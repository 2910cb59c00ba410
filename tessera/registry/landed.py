"""Queries over landed pages, model replies, conversations and events (the S, K, L and T rows)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import analysis, conversation, tables
from tessera.plans import views
from tessera.registry import sqltext as q
from tessera.registry.base import query
from tessera.sources import deep, html, json
from tessera.streaming import throttle

# --- search pages: the listings view written out in each portal's markup, then read again ---
CARDS = {
    "morizon": '<div><a class="property-card" href="/oferta/{k}"><span class="property-card__title">{t}</span><span class="property-card__price--main">{p} zł</span><span class="property-card__location">Stroma, Tarninów, {c}, {v}</span></a></div>',
    "gratka": '<a class="property-card" href="/oferta/{k}"><span class="property-card__title">{t}</span><span class="property-card__price--main">{p} zł</span><span class="property-card__location">{c}, powiat, {v}</span></a>',
    "domiporta": '<article class="sneakpeak"><h2 class="sneakpeak__title--bold"><a href="/oferta/{k}">{t}</a></h2><span class="sneakpeak__price_value">{p} zł</span><div class="sneakpeak__title--inblock">mieszkanie {c}, Centrum</div></article>',
    "nieruchomosci_online": '<div class="tile"><h2 class="name"><a href="/oferta/{k}">{t}</a></h2><div class="primary-display"><span>{p}</span><span>x</span></div><p class="province">{c}, {v}</p><span class="area">{a} m²</span></div>',
    "szybko": '<div class="offer-card"><a class="offer-card__link" href="/oferta/{k}"><b class="offer-card__title">{t}</b></a><i class="offer-card__price">{p}</i><i class="offer-card__location">{c}, {v}</i><i class="offer-card__area">{a} m2</i></div>',
    "olx": '<div data-testid="l-card"><div><p data-testid="ad-price">{p} zł</p><h6 data-testid="ad-card-title"><a href="/d/oferta/{k}">{t}</a></h6><p data-testid="location-date">{c}, {v} - Dzisiaj 14:30</p></div></div>',
}


def pages_of(spark: SparkSession, d: str, portal: str, card: str | None = None, size: int = 10) -> DataFrame:
    """Ten listings a page, or size, in the portal's markup. A page of one is its listing's own row; others are dealt in equal shares, as to read a page takes far more than its bytes tell."""
    df = views.listings(spark, d).select("seq", text.escaped(F.col("title")).alias("t"), F.floor("price").cast("string").alias("p"), F.col("city").alias("c"), F.col("voivodeship").alias("v"), (F.col("seq") % 90).cast("string").alias("a"))
    card, pieces = card or CARDS[portal], []
    for n, part in enumerate(card.replace("{k}", "\0seq\0").replace("{t}", "\0t\0").replace("{p}", "\0p\0").replace("{c}", "\0c\0").replace("{v}", "\0v\0").replace("{a}", "\0a\0").split("\0")):
        pieces.append(F.col(part).cast("string") if n % 2 else F.lit(part))
    made = df.select(F.floor(F.col("seq") / size).alias("page_id"), "seq", F.concat(*pieces).alias("card"))
    if size == 1:
        return made.select("page_id", F.col("card").alias("html"), F.lit(portal).alias("portal"))
    made = made.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "page_id")
    return made.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "card"))), lambda x: x["card"]), "\n").alias("html")).withColumn("portal", F.lit(portal))


BASES = {"morizon": "https://www.morizon.pl", "gratka": "https://gratka.pl", "domiporta": "https://www.domiporta.pl", "nieruchomosci_online": "https://www.nieruchomosci-online.pl", "szybko": "https://szybko.pl", "olx": "https://www.olx.pl/d"}

for _key, _portal in (("s1_olx", "olx"), ("s3_morizon", "morizon"), ("s4_domiporta", "domiporta"), ("s5_gratka", "gratka"), ("s6_nieruchomosci_online", "nieruchomosci_online"), ("s7_szybko", "szybko")):
    _v = "''" if _portal == "domiporta" else "voivodeship"
    _sql = f"SELECT seq // 10 AS page_id, title, '{BASES[_portal]}/oferta/' || seq AS url, floor(price)::DOUBLE AS price, city, {_v} AS voivodeship FROM listings"

    def _one(spark, d, p=_portal):
        return html.search_results(pages_of(spark, d, p)).select("page_id", "title", "url", "price", "city", "voivodeship")

    query(_key, q.listings(_sql))(_one)


#: Other markup of one portal: links in headings without a card around them, cards known by their classes alone, bare links (each twice).
OLX = {
    "s1_olx_headings": '<section><h6><a href="/d/oferta/{k}">{t}</a></h6><p>{p} zł</p></section>',
    "s1_olx_classes": '<div data-testid="other"><div class="x css-rc5s2u"><a href="/oferta/{k}"><b>{t}</b></a></div><span>{p} zł</span><script>var x = "1 zł";</script></div>',
    "s1_olx_links": '<p><a href="/d/oferta/{k}">{t}</a> <a href="/d/oferta/{k}">{t}</a> <a href="/d/oferta/x{k}">abc</a></p>',
}
for _key, _markup in OLX.items():
    _price = "floor(price)::DOUBLE" if _key == "s1_olx_classes" else "NULL::DOUBLE"

    def _other(spark, d, markup=_markup):
        return html.search_results(pages_of(spark, d, "olx", markup)).select("page_id", "title", "url", "price")

    query(_key, q.listings(f"SELECT seq // 10 AS page_id, title, 'https://www.olx.pl{'' if _key == 's1_olx_classes' else '/d'}/oferta/' || seq AS url, {_price} AS price FROM listings"))(_other)

_long = "{t}, " * 12
#: Pages of single listings, by portal.
DETAILS = {
    "olx": '<div data-testid="ad-price-container"><h3>{p} zł</h3></div><div data-cy="ad_description"><h4>Opis</h4><div><p>{t}</p><br>blisko {c}</div></div><ul data-testid="ad-params"><li><p>Piętro: 3</p></li><li>Powierzchnia: {a} m²</li><li>bez dwukropka</li></ul>',
    "morizon": '<div class="box property-description"><p>{t},</p> <p>{c}</p></div><table class="property-params"><tr><td>Powierzchnia</td><td>{a} m²</td></tr><tr><td>Piętro</td><td>3</td></tr></table>',
    "gratka": '<p>krótko</p><div class="offer-description">' + _long + '</div><p>' + _long + _long + '</p>',
    "domiporta": '<div class="description">za krótki</div><p>krótko</p><p><b>' + _long + '</b> koniec</p>',
}
_shown = {
    "s14_olx": ("olx", "title || ' blisko ' || city", "floor(price)::DOUBLE", "(seq % 90)::DOUBLE"),
    "s14_morizon": ("morizon", "title || ', ' || city", "NULL::DOUBLE", "(seq % 90)::DOUBLE"),
    "s14_described": ("gratka", "trim(repeat(title || ', ', 12))", "NULL::DOUBLE", "NULL::DOUBLE"),
    "s14_paragraph": ("domiporta", "trim(repeat(title || ', ', 12)) || ' koniec'", "NULL::DOUBLE", "NULL::DOUBLE"),
}
for _key, (_portal, _text, _price, _area) in _shown.items():

    def _detail(spark, d, p=_portal):
        return html.details(pages_of(spark, d, p, DETAILS[p], 1)).select("page_id", "full_description", "price", "area")

    query(_key, q.listings(f"SELECT seq AS page_id, {_text} AS full_description, {_price} AS price, {_area} AS area FROM listings"))(_detail)


@query("s14_otodom", q.listings("SELECT seq AS page_id, raw_description AS full_description, CASE WHEN seq % 2 = 0 AND seq % 90 <> 0 THEN (seq % 90)::DOUBLE ELSE (seq % 80)::DOUBLE END AS area, city, CASE WHEN seq % 4 = 0 THEN 'u' || seq END AS street, (seq % 3)::INT AS photos FROM listings WHERE seq % 7 <> 0 UNION ALL SELECT seq, NULL, NULL, NULL, NULL, NULL FROM listings WHERE seq % 7 = 0"))
def s14_otodom(spark, d):
    k = F.col("seq")
    address = F.struct(F.struct(F.col("city").alias("name")).alias("city"), F.when(k % 4 == 0, F.struct(F.concat(F.lit("u"), k.cast("string")).alias("name"))).alias("street"))
    area = [F.when(k % 2 == 0, k % 90).alias("areaInSquareMeters"), (k % 80).alias("areaInM2")]
    ad = F.struct(F.col("raw_description").alias("description"), *area, F.struct(address.alias("address")).alias("location"), F.slice(F.array(F.lit("a"), F.lit("b")), F.lit(1), (k % 3).cast("int")).alias("images"))
    body = F.to_json(F.struct(F.struct(F.struct(ad.alias("ad")).alias("pageProps")).alias("props")))
    page = F.concat(F.lit('<script id="__NEXT_DATA__" type="application/json">'), F.when(k % 7 == 0, "{broken").otherwise(body), F.lit("</script>"))
    return json.embedded_detail(views.listings(spark, d).select(k.alias("page_id"), page.alias("html"))).select("page_id", "full_description", "area", "city", "street", "photos")


#: A page lies there for most listings with a url: some were refused, some are empty, some were read twice, and the later one counts.
def landed_details(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("seq")
    rows = views.listings(spark, d).where("url <> '' AND seq % 10 <> 9 AND seq % 6 <> 0").withColumn("_title", text.escaped(F.col("title")))
    title = F.col("_title")
    full = F.concat(F.repeat(F.concat(title, F.lit(", ")), F.lit(11)), title)
    lines = F.concat(F.lit('<table class="property-params"><tr><td>Powierzchnia</td><td>'), (k % 90).cast("string"), F.lit(" m²</td></tr><tr><td>Piętro</td><td>"), (k % 4).cast("string"), F.lit("</td></tr></table>"))
    address = F.struct(F.struct(F.col("city").alias("name")).alias("city"), F.struct(F.concat(F.lit("d"), (k % 9).cast("string")).alias("name")).alias("district"))
    ad = F.struct(F.col("raw_description").alias("description"), (k % 80).alias("areaInSquareMeters"), F.lit("THREE").alias("roomsNumber"), (k % 5).cast("string").alias("floor"), F.lit("7").alias("buildingFloorsNum"), F.lit("private").alias("advertiserType"), F.slice(F.array(F.lit("a"), F.lit("b")), F.lit(1), (k % 3).cast("int")).alias("images"), F.struct(address.alias("address")).alias("location"))
    inside = F.concat(F.lit('<script id="__NEXT_DATA__" type="application/json">'), F.to_json(F.struct(F.struct(F.struct(ad.alias("ad")).alias("pageProps")).alias("props"))), F.lit("</script>"))
    body = F.when(F.col("source") == "otodom", inside).when(F.col("source") == "olx", F.concat(F.lit('<div data-cy="ad_description"><div>'), full, F.lit("</div></div>"))).when(F.col("source") == "morizon", F.concat(F.lit('<div class="property-description">'), full, F.lit("</div>"), lines)).otherwise(F.concat(F.lit('<div class="offer-description">'), full, F.lit("</div>")))
    page = rows.select("url", F.upper("source").alias("portal"), F.when(k % 11 == 0, "").otherwise(body).alias("html"), F.when(k % 7 == 0, 403).otherwise(200).alias("status"), F.col("first_seen_at").cast("timestamp").alias("fetched_at"))
    older = rows.where("seq % 13 = 0").select("url", F.lit("gratka").alias("portal"), F.concat(F.lit("<p>dawniej: "), full, F.lit("</p>")).alias("html"), F.lit(200).alias("status"), F.timestamp_add("DAY", F.lit(-1), F.col("first_seen_at")).cast("timestamp").alias("fetched_at"))
    # behind a generator of one row, so that a page is made once and not in every expression over it
    made = page.unionByName(older)
    return made.select(F.inline(F.array(F.struct(*made.columns))))


_words = "rtrim(repeat(title || ', ', 12), ', ')"
_landed = f"""src AS (SELECT * FROM listings WHERE url <> '' AND seq % 10 <> 9 AND seq % 6 <> 0),
pages_ AS (
  SELECT url, 2 AS fetched, CASE WHEN source = 'otodom' THEN nullif(raw_description, '') ELSE {_words} END AS full_description,
    CASE WHEN source = 'otodom' AND contains(raw_description, 'WA1M/12345678/9') THEN 'WA1M/********/*' END AS kw_number,
    CASE source WHEN 'otodom' THEN nullif(seq % 80, 0) WHEN 'morizon' THEN nullif(seq % 90, 0) END::DOUBLE AS area_,
    CASE source WHEN 'otodom' THEN (seq % 5)::VARCHAR WHEN 'morizon' THEN (seq % 4)::VARCHAR END AS floor,
    CASE WHEN source = 'otodom' THEN '7' END AS building_floors, CASE WHEN source = 'otodom' THEN 'THREE' END AS rooms, CASE WHEN source = 'otodom' THEN 'd' || seq % 9 END AS district,
    CASE WHEN source = 'otodom' THEN 'private' END AS seller_type, CASE WHEN source = 'otodom' THEN nullif(seq % 3, 0) END::INT AS photos_count
  FROM src WHERE seq % 7 <> 0 AND seq % 11 <> 0
  UNION ALL SELECT url, 1, 'dawniej: ' || {_words}, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM src WHERE seq % 13 = 0),
latest AS (SELECT * FROM pages_ QUALIFY row_number() OVER (PARTITION BY url ORDER BY fetched DESC) = 1)"""
_enriched = "SELECT seq, l.url, coalesce(area, area_) AS area, full_description, kw_number, floor, building_floors, rooms, district, NULL::VARCHAR AS street, seller_type, photos_count, p.url IS NOT NULL AS deep_fetched FROM listings l LEFT JOIN latest p ON l.url = p.url"


def enriched(spark: SparkSession, d: str, *more: str) -> DataFrame:
    return deep.enrich(views.listings(spark, d).select("seq", "url", "area", *more), deep.read_details(landed_details(spark, d)))


@query("s14_deep_batch", q.with_(q.LISTINGS_SQL, _landed, select=_enriched))
def s14_deep_batch(spark, d):
    return enriched(spark, d)


@query("s14_deep_coverage", q.with_(q.LISTINGS_SQL, _landed, select=f"SELECT source AS portal, count(*) AS n, count(*) FILTER (deep_fetched) AS n_fetched, count(full_description) AS n_described, count(kw_number) AS n_registered FROM ({_enriched}) JOIN (SELECT seq, source FROM listings) USING (seq) GROUP BY source"))
def s14_deep_coverage(spark, d):
    return deep.coverage(enriched(spark, d, "source"), "source")


@query("s2_embedded_json", q.listings("SELECT seq // 10 AS page_id, title, 'https://www.otodom.pl/pl/oferta/s' || seq AS url, floor(price)::DOUBLE AS price, city, voivodeship, (seq % 90)::DOUBLE AS area, 3::INT AS rooms, 7::INT AS total_pages FROM listings"))
def s2(spark, d):
    item = F.struct("title", F.concat(F.lit("s"), F.col("seq").cast("string")).alias("slug"), F.struct(F.floor("price").alias("value")).alias("totalPrice"), F.struct(F.struct(F.struct(F.col("city").alias("name")).alias("city"), F.struct(F.col("voivodeship").alias("name")).alias("province")).alias("address")).alias("location"), (F.col("seq") % 90).alias("areaInSquareMeters"), F.lit("THREE").alias("roomsNumber"))
    pages = views.listings(spark, d).groupBy(F.floor(F.col("seq") / 10).alias("page_id")).agg(F.collect_list(item).alias("items"))
    body = F.to_json(F.struct(F.struct(F.struct(F.struct(F.struct(F.col("items"), F.struct(F.lit(7).alias("totalPages")).alias("pagination")).alias("searchAds")).alias("data")).alias("pageProps")).alias("props")))
    page = F.concat(F.lit('<html><script id="__NEXT_DATA__" type="application/json">'), body, F.lit("</script></html>"))
    return json.search_ads(pages.select("page_id", page.alias("html"))).select("page_id", "title", "url", "price", "city", "voivodeship", "area", "rooms", "total_pages")


@query("s8_search_answers", q.listings("SELECT seq // 10 AS page_id, title, 'https://allegro.pl/oferta/' || seq AS url, floor(price)::DOUBLE AS price, city AS location, 'Stan: nowy, inny' AS description FROM listings"))
def s8(spark, d):
    param = F.array(F.struct(F.lit("Stan").alias("name"), F.array(F.lit("nowy"), F.lit("inny")).alias("values")), F.struct(F.lit("Pusty").alias("name"), F.array().cast("array<string>").alias("values")))
    item = F.struct(F.col("seq").cast("string").alias("id"), F.col("title").alias("name"), F.struct(F.struct(F.floor("price").cast("string").alias("amount"), F.lit("PLN").alias("currency")).alias("price")).alias("sellingMode"), F.struct("city").alias("seller"), param.alias("parameters"))
    pages = views.listings(spark, d).groupBy(F.floor(F.col("seq") / 10).alias("page_id")).agg(F.collect_list(F.when(F.col("seq") % 3 == 0, item)).alias("promoted"), F.collect_list(F.when(F.col("seq") % 3 != 0, item)).alias("regular"))
    return json.search_answers(pages.select("page_id", F.to_json(F.struct(F.struct("promoted", "regular").alias("items"))).alias("body"))).select("page_id", "title", "url", "price", "location", "description")


@query("f13_described", q.listings("SELECT seq, 'Stan: nowy, inny; Nr: ' || seq AS text FROM listings"))
def f13(spark, d):
    part = lambda name, *v: F.struct(F.lit(name).alias("name"), F.array(*v).alias("values"))
    return views.listings(spark, d).select("seq", json.described(F.array(part("Stan", F.lit("nowy"), F.lit("inny")), part("Nr", F.col("seq").cast("string")))).alias("text"))


@query("s14_longest_paragraph", "SELECT page_id, CASE WHEN length(p) > 100 THEN p END AS full_description FROM (SELECT page_id, list_reduce(list_transform(regexp_extract_all(html, '(?is)<p\\b[^>]*>(.*?)</p>', 1), lambda x: trim(regexp_replace(regexp_replace(x, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))), lambda a, b: CASE WHEN length(b) >= length(a) THEN b ELSE a END, '') AS p FROM pages)")
def s14(spark, d):
    return views.table(spark, d, "pages").select("page_id", html.longest_paragraph(F.col("html")).alias("full_description"))


@query("s15_blocked", "SELECT page_id, status, status IN (403, 429, 503, 520, 521, 522, 523, 524) OR html = '' OR contains(lower(html), 'rate limit') AND length(html) < 15000 AS blocked FROM (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 403 ELSE 200 END AS status, CASE page_id % 7 WHEN 0 THEN '' WHEN 1 THEN '<p>Rate limit</p>' WHEN 2 THEN repeat('<p>Rate limit</p>', 2000) ELSE '<p>' || page_id || '</p>' END AS html FROM pages)")
def s15(spark, d):
    k = F.col("page_id")
    body = F.when(k % 7 == 0, "").when(k % 7 == 1, "<p>Rate limit</p>").when(k % 7 == 2, F.repeat(F.lit("<p>Rate limit</p>"), 2000)).otherwise(F.concat(F.lit("<p>"), k.cast("string"), F.lit("</p>")))
    status = F.when(k % 5 == 0, 403).otherwise(200)
    return views.table(spark, d, "pages").select("page_id", status.alias("status"), html.blocked(body, status).alias("blocked"))


@query("s16_city_index", q.with_(q.CITIES_SQL, select="SELECT lower(name) AS key, name FROM cities UNION SELECT translate(lower(name), 'ąćęłńóśźż', 'acelnoszz'), name FROM cities"))
def s16(spark, d):
    return json.city_index(views.cities(spark)).select("key", "name")


# --- model replies ---
_shape = "doc_id % 6"


def replies(spark: SparkSession, d: str) -> DataFrame:
    """Replies in six shapes: plain, fenced, Python's words, trailing commas, inside prose, none."""
    k = F.col("doc_id")
    num = k.cast("string")
    body = F.concat(F.lit('{"is_real_share": true, "confidence": 1.5, "stars": "9", "summary": "s'), num, F.lit('", "fraction": "1/'), (k % 9 + 2).cast("string"), F.lit('", "property_type": "zamek", "seller_motivation": "spadek", "estimated_value_total": 1000.7, "price_assessment": "tania", "risks": "jedno"}'))
    s = k % 6
    return views.table(spark, d, "documents").select("doc_id", F.when(s == 0, body).when(s == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(s == 2, F.replace(body, F.lit("true"), F.lit("True"))).when(s == 3, F.replace(body, F.lit('"jedno"}'), F.lit('"jedno",}'))).when(s == 4, F.concat(F.lit("Oto: "), body, F.lit(" Koniec."))).otherwise("nic").alias("raw"))


@query("l1_repaired", f"SELECT doc_id, CASE WHEN {_shape} < 5 THEN 's' || doc_id END AS summary FROM documents")
def l1(spark, d):
    return replies(spark, d).select("doc_id", analysis.get(analysis.repaired(F.col("raw")), "$.summary", "string").alias("summary"))


@query("l2_checked", f"SELECT doc_id, {_shape} < 5 AS valid, CASE WHEN {_shape} < 5 THEN 1.0::DOUBLE END AS confidence, CASE WHEN {_shape} < 5 THEN 5 END::INT AS stars, CASE WHEN {_shape} < 5 THEN '1/' || (doc_id % 9 + 2) END AS fraction, CASE WHEN {_shape} < 5 THEN 'inne' END AS property_type, CASE WHEN {_shape} < 5 THEN 'spadek' END AS seller_motivation, CASE WHEN {_shape} < 5 THEN 1000 END::BIGINT AS estimated_value_total, NULL::VARCHAR AS price_assessment, CASE WHEN {_shape} < 5 THEN 'jedno' END AS risks FROM documents")
def l2(spark, d):
    out = analysis.checked(replies(spark, d).select("doc_id", analysis.repaired(F.col("raw")).alias("reply")))
    return out.select("doc_id", "valid", "confidence", "stars", "fraction", "property_type", "seller_motivation", "estimated_value_total", "price_assessment", F.array_join("risks", "|").alias("risks"))


def envelopes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    usage = F.struct((k % 100).cast("int").alias("prompt_tokens"), (k % 10).cast("int").alias("completion_tokens"))
    choices = F.to_json(F.struct(F.lit("m-small").alias("model"), F.array(F.struct(F.struct(F.concat(F.lit("t"), k.cast("string")).alias("content")).alias("message"), F.lit("stop").alias("finish_reason"))).alias("choices"), usage.alias("usage")))
    blocks = F.to_json(F.struct(F.lit("m-large").alias("model"), F.array(F.struct(F.lit("text").alias("type"), F.lit("a").alias("text")), F.struct(F.lit("tool").alias("type"), F.lit("x").alias("text")), F.struct(F.lit("text").alias("type"), k.cast("string").alias("text"))).alias("content"), F.struct(k.cast("int").alias("input_tokens"), F.lit(5).alias("output_tokens")).alias("usage")))
    return views.table(spark, d, "events").select("event_id", choices.alias("choices"), blocks.alias("blocks"))


@query("l3_completions", "SELECT event_id, 't' || event_id AS c1, 'm-small' AS m1, (event_id % 100)::INT AS i1, (event_id % 10)::INT AS o1, 'stop' AS f1, 'a' || event_id AS c2, 'm-large' AS m2, event_id::INT AS i2, 5::INT AS o2 FROM events")
def l3(spark, d):
    a, b = analysis.completion(F.col("choices"), "choices"), analysis.completion(F.col("blocks"), "blocks")
    return envelopes(spark, d).select("event_id", a["content"].alias("c1"), a["model"].alias("m1"), a["input_tokens"].alias("i1"), a["output_tokens"].alias("o1"), a["finish"].alias("f1"), b["content"].alias("c2"), b["model"].alias("m2"), b["input_tokens"].alias("i2"), b["output_tokens"].alias("o2"))


def responses(spark: SparkSession, d: str) -> DataFrame:
    """Landed answers of three providers about each listing, two attempts each."""
    k, e = F.col("l_orderkey"), views.table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    p = e.withColumn("priority", F.explode(F.sequence(F.lit(1), F.lit(3)))).withColumn("attempt", F.explode(F.sequence(F.lit(1), F.lit(2))))
    code = (k * 7 + F.col("priority") * 3 + F.col("attempt")) % 5
    status = F.when(code == 0, 200).when(code == 1, 429).when(code == 2, 500).when(code == 3, 401).otherwise(200)
    return p.select(k.cast("string").alias("listing_id"), F.concat(F.lit("p"), F.col("priority").cast("string")).alias("provider"), "priority", (F.col("priority") != 2).alias("enabled"), "attempt", status.cast("int").alias("http_status"), (code == 0).alias("valid"), F.lit("m-small").alias("model"), F.lit(1000).alias("input_tokens"), F.lit(200).alias("output_tokens"))


_resp = "r AS (SELECT o_orderkey::VARCHAR AS listing_id, p AS priority, a AS attempt, (o_orderkey * 7 + p * 3 + a) % 5 AS code FROM orders, range(1, 4) t(p), range(1, 3) u(a))"


@query("l4_first_valid", f"WITH {_resp}, off AS (SELECT listing_id, priority, min(attempt) AS off FROM r WHERE code = 3 GROUP BY ALL) SELECT listing_id, 'p' || priority AS provider, attempt::INT AS attempt FROM r LEFT JOIN off USING (listing_id, priority) WHERE priority <> 2 AND code = 0 AND (off IS NULL OR attempt < off) QUALIFY row_number() OVER (PARTITION BY listing_id ORDER BY priority, attempt) = 1")
def l4(spark, d):
    return analysis.first_valid(responses(spark, d)).select("listing_id", "provider", "attempt")


_cost = "CASE WHEN code IN (0, 4) THEN (1000 * 0.15::DOUBLE + 200 * 0.6::DOUBLE) / 1000000 ELSE 0 END"


@query("a8_usage", f"WITH {_resp} SELECT count(*) AS calls, count(*) FILTER (code NOT IN (0, 4)) AS errors, sum(CASE WHEN code IN (0, 4) THEN 1000 ELSE 0 END)::BIGINT AS input_tokens, sum(CASE WHEN code IN (0, 4) THEN 200 ELSE 0 END)::BIGINT AS output_tokens, round(sum({_cost}), 6) AS cost FROM r")
def a8(spark, d):
    prices = spark.createDataFrame([("m-small", 0.15, 0.6)], "model string, price_in double, price_out double")
    return tables.usage(tables.with_prices(responses(spark, d), prices, (1.0, 3.0)))


@query("j7_prices", "SELECT event_id, round((event_id * CASE WHEN event_id % 2 = 0 THEN 0.15::DOUBLE ELSE 1.0 END + 10 * CASE WHEN event_id % 2 = 0 THEN 0.6::DOUBLE ELSE 3.0 END) / 1000000, 9) AS cost FROM events")
def j7(spark, d):
    calls = views.table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, "m-small").otherwise("m-new").alias("model"), F.col("event_id").alias("input_tokens"), F.lit(10).alias("output_tokens"))
    prices = spark.createDataFrame([("m-small", 0.15, 0.6)], "model string, price_in double, price_out double")
    return tables.with_prices(calls, prices, (1.0, 3.0)).select("event_id", F.round("cost", 9).alias("cost"))


@query("l6_gate", q.scored("SELECT seq FROM scored WHERE score >= 25"))
def l6(spark, d):
    from tessera.registry.scoring import scored

    return scored(spark, d).where("score >= 25").select("seq")


@query("l7_tool_calls", "SELECT event_id, 'search' AS name, '{\"n\":' || event_id || '}' AS arguments FROM events WHERE event_id % 2 = 0")
def l7(spark, d):
    call = F.struct(F.struct(F.lit("search").alias("name"), F.concat(F.lit('{"n":'), F.col("event_id").cast("string"), F.lit("}")).alias("arguments")).alias("function"))
    body = F.to_json(F.struct(F.array(F.struct(F.struct(F.when(F.col("event_id") % 2 == 0, F.array(call)).alias("tool_calls")).alias("message"))).alias("choices")))
    return views.table(spark, d, "events").select("event_id", F.inline(analysis.tool_calls(body)))


@query("f22_flat_analysis", f"SELECT doc_id, coalesce(CASE WHEN {_shape} < 5 THEN 5 END, 0)::INT AS stars, coalesce(CASE WHEN {_shape} < 5 THEN 's' || doc_id END, '') AS summary FROM documents")
def f22(spark, d):
    out = analysis.checked(replies(spark, d).select("doc_id", analysis.repaired(F.col("raw")).alias("reply")))
    return out.select("doc_id", F.coalesce("stars", F.lit(0)).alias("stars"), F.coalesce("summary", F.lit("")).alias("summary"))


@query("f24_models", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'm-small' WHEN 1 THEN 'm-large' ELSE 'own' END AS model FROM events")
def f24(spark, d):
    names = spark.createDataFrame([("small", "m-small"), ("", "m-large")], "alias string, full string")
    k = F.col("event_id")
    asked = views.table(spark, d, "events").select("event_id", F.when(k % 3 == 0, "small").when(k % 3 == 1, "").otherwise("own").alias("alias"))
    return asked.join(names, "alias", "left").select("event_id", F.coalesce("full", "alias").alias("model"))


@query("f25_prompt", q.listings("SELECT seq, 'Tytuł: ' || title || chr(10) || 'Opis: ' || CASE WHEN trim(raw_description) = '' THEN 'brak danych' ELSE left(raw_description, 1500) END || chr(10) || 'Cena: brak danych' || chr(10) || 'Lokalizacja: ' || city || chr(10) || 'Powierzchnia: ' || coalesce(area::INT::VARCHAR, 'brak danych') AS prompt FROM listings"))
def f25(spark, d):
    return views.listings(spark, d).select("seq", analysis.prompt(F.col("title"), F.col("raw_description"), F.lit(None).cast("string"), F.col("city"), F.col("area").cast("int").cast("string")).alias("prompt"))


@query("t5_backoff", "SELECT event_id, least(30.0::DOUBLE, 1.0 * pow(2.0, event_id % 8)) AS seconds FROM events")
def t5(spark, d):
    return views.table(spark, d, "events").select("event_id", analysis.backoff(F.col("event_id") % 8 + 1).alias("seconds"))


# --- conversations and events ---
@query("w2_last_messages", "SELECT conv_id, turn, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3")
def w2(spark, d):
    return conversation.last_messages(views.table(spark, d, "conversations"), 3).select("conv_id", "turn", "text")


@query("w2_latest_users", "SELECT conv_id, turn FROM conversations WHERE conv_id IN (SELECT conv_id FROM conversations GROUP BY conv_id ORDER BY conv_id DESC LIMIT 100)")
def w2_users(spark, d):
    df = views.table(spark, d, "conversations")
    return conversation.latest_users(df.withColumn("first_turn", F.col("conv_id")), 100).select("conv_id", "turn")


@query("w3_within_budget", "SELECT conv_id, turn FROM (SELECT conv_id, turn, sum(length(text)) OVER w AS s, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) WHERE s <= 400 OR n <= 2")
def w3(spark, d):
    return conversation.within_budget(views.table(spark, d, "conversations"), 400).select("conv_id", "turn")


_throttle = """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
f(user_id, event_id, n, last, allowed) AS (
  SELECT user_id, event_id, n, t, TRUE FROM e WHERE n = 1
  UNION ALL
  SELECT e.user_id, e.event_id, e.n, CASE WHEN e.t - f.last >= 3600000000 THEN e.t ELSE f.last END, e.t - f.last >= 3600000000 FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1)
SELECT event_id, allowed FROM f"""


@query("t1_throttled", _throttle)
def t1(spark, d):
    return throttle.throttled(views.table(spark, d, "events"), 3600.0).select("event_id", "allowed")


@query("t2_forgotten", "SELECT user_id, max(ts) AS last_seen FROM events GROUP BY user_id HAVING date_diff('second', max(ts), (SELECT max(ts) FROM events)) <= 3600 * 24")
def t2(spark, d):
    e = views.table(spark, d, "events")
    return throttle.forgotten(e.select("user_id", "ts"), F.lit(e.agg(F.max("ts")).first()[0]), 3600 * 24)


@query("ext_windowed_counts", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def windowed(spark, d):
    return throttle.windowed_counts(views.table(spark, d, "events")).withColumn("total", F.round("total", 4))


# --- files and settings ---
def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for what a query writes: under spark.checkpoint.dir, or in a local session without one a folder of its own."""
    import tempfile
    import uuid

    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        top = tempfile.mkdtemp(prefix="tessera-")
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("k1_results", q.scored("SELECT id, title, score::BIGINT AS score, url FROM scored WHERE score >= 50"))
def k1(spark, d):
    from tessera.registry.scoring import scored
    from tessera.sources import files

    path = scratch(spark, "results")
    files.write_results(scored(spark, d).where("score >= 50").select("id", "title", "score", "url"), path)
    return spark.read.schema("id string, title string, score long, url string").json(path)


@query("k3_presets", "SELECT 'Łódź' AS city, '50000' AS price_max, NULL::VARCHAR AS area_min")
def k3(spark, d):
    from tessera.sources import files

    path = scratch(spark, "preset")
    files.save_preset(spark, {"city": "Łódź", "price_max": "50000"}, path)
    f = F.col("filters")
    return files.load_preset(spark, path).select(f["city"].alias("city"), f["price_max"].alias("price_max"), f["area_min"].alias("area_min"))


@query("k4_schema", "SELECT 0::BIGINT AS rows_at_first, count(*) AS rows_then, 2::INT AS version FROM supplier")
def k4(spark, d):
    """A store that is set up twice, as every start does, and written once in between."""
    from tessera.operators.commits import Snapshots

    path, schema = scratch(spark, "store"), "s_suppkey long, s_name string"
    first = Snapshots(spark, path, schema)
    empty = first.read().count()
    first.write(views.table(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("s_suppkey"), "s_name"))
    again = Snapshots(spark, path, schema)
    return again.read().agg(F.lit(empty).cast("long").alias("rows_at_first"), F.count(F.lit(1)).alias("rows_then"), F.lit(again.version()).alias("version"))


_ports = ["https://api.openai.com/v1", "https://api.deepseek.com", "https://generativelanguage.googleapis.com/v1", "https://api.anthropic.com", "http://localhost:11434", "http://localhost:1234/v1"]
_named = ["openai", "deepseek", "gemini", "anthropic", "ollama", "lmstudio"]


_which = "CASE event_id % 6 " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(_named)) + " END"


@query("l5_provider_settings", f"""SELECT event_id, CASE WHEN event_id % 5 = 0 OR event_id % 7 = 0 THEN NULL WHEN event_id % 2 = 0 THEN 'first:own:1:true,openai:gpt-4o-mini:3:false'
  ELSE {_which} || ':gpt-4o-mini:1:true' END AS providers,
  CASE WHEN event_id % 5 = 0 OR event_id % 7 = 0 THEN NULL ELSE CASE WHEN event_id % 3 = 0 THEN 12.5 ELSE 30 END END::DOUBLE AS timeout FROM events""")
def l5(spark, d):
    """Several providers, one by its address, none with a key, and configurations that are off."""
    k = F.col("event_id")
    key = F.when(k % 7 == 0, "").otherwise("key")
    one = lambda name, api_key, model, enabled, priority: F.struct(*(F.lit(v).cast(kind).alias(n) for n, v, kind in (("name", name, "string"), ("api_key", api_key, "string"), ("model", model, "string"), ("enabled", enabled, "boolean"), ("priority", priority, "int"))))
    several = F.array(one("first", key, "own", None, None), one("none", "", "x", True, 9), one(None, key, None, False, None))
    address = views.pick(_ports, k % 6)
    config = F.to_json(F.struct((k % 5 != 0).alias("enabled"), F.when(k % 3 == 0, 12.5).alias("timeout"), F.when(k % 2 == 0, several).alias("providers"), F.when(k % 2 == 1, key).alias("api_key"), F.when(k % 2 == 1, address).alias("base_url")))
    found = views.table(spark, d, "events").select("event_id", analysis.provider_settings(config).alias("s"))
    line = F.array_join(F.transform("s.providers", lambda p: F.concat_ws(":", p["name"], p["model"], p["priority"].cast("string"), p["enabled"].cast("string"))), ",")
    return found.select("event_id", line.alias("providers"), F.col("s.timeout").alias("timeout"))
