"""Landed JSON: embedded page data, search answers, dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import parse
from tessera.functions.text import without_marks
from tessera.operators.analysis import get

SCRIPT = r'(?s)<script\s+id="__NEXT_DATA__"\s+type="application/json"[^>]*>(.*?)</script>'
DATA = "$.props.pageProps.data"


def embedded(html: Column) -> Column:
    """The data that a page carries for its own script, as VARIANT."""
    return F.try_parse_json(F.regexp_extract(html, SCRIPT, 1))


def _items(v: Column) -> Column:
    many = lambda path: get(v, path, "array<variant>")
    return F.coalesce(many(f"{DATA}.searchAds.items"), many(f"{DATA}.searchAds.ads"), many(f"{DATA}.searchAds"), F.array().cast("array<variant>"))


def search_ads(pages: DataFrame, base: str = "https://www.otodom.pl/pl/oferta/") -> DataFrame:
    """Listings of pages(page_id, html) with their place on the page and the pages' number. Needs a title and a slug."""
    read = pages.select("page_id", embedded(F.col("html")).alias("v"))
    pages_ = F.coalesce(get(F.col("v"), f"{DATA}.searchAds.pagination.totalPages", "int"), get(F.col("v"), f"{DATA}.pagination.totalPages", "int"), F.lit(1)).alias("total_pages")
    rows = read.select("page_id", pages_, F.posexplode(_items(F.col("v"))).alias("seq", "i"))
    i = F.col("i")
    text = lambda *paths: F.coalesce(*(get(i, p, "string") for p in paths), F.lit(""))
    num = lambda *paths: F.coalesce(*(get(i, p, "double") for p in paths))
    place = lambda k: F.coalesce(get(i, f"$.location.address.{k}.name", "string"), F.when(~get(i, f"$.location.address.{k}", "string").startswith("{"), get(i, f"$.location.address.{k}", "string")), F.lit(""))
    title, slug = text("$.title"), text("$.slug")
    return rows.where((title != "") & (slug != "")).select(
        "page_id", "seq", "total_pages", title.alias("title"), F.concat(F.lit(base), slug).alias("url"), num("$.totalPrice.value", "$.totalPrice").alias("price"), place("city").alias("city"), place("province").alias("voivodeship"),
        num("$.areaInSquareMeters", "$.areaInM2", "$.area").alias("area"), parse.rooms(F.coalesce(get(i, "$.roomsNumber", "string"), get(i, "$.rooms", "string"))).alias("rooms"),
        F.coalesce(F.nullif(text("$.description"), F.lit("")), title).alias("raw_description"), F.lit("otodom").alias("source_portal"),
    )


ITEM = "struct<id:string,name:string,sellingMode:struct<price:struct<amount:string,currency:string>,fixedPrice:struct<amount:string,currency:string>>,seller:struct<city:string>,parameters:array<struct<name:string,values:array<string>>>>"


def search_answers(answers: DataFrame, base: str = "https://allegro.pl/oferta/") -> DataFrame:
    """Items of answers(page_id, body): promoted, then regular; without any, the offers. Needs a name and an id."""
    v = F.from_json("body", f"items struct<promoted:array<{ITEM}>,regular:array<{ITEM}>>, offers array<{ITEM}>")
    empty = F.array().cast(f"array<{ITEM}>")
    read = answers.select("page_id", v.alias("v"))
    grouped = F.concat(F.coalesce("v.items.promoted", empty), F.coalesce("v.items.regular", empty))
    fine = lambda x: F.filter(x, lambda i: (F.coalesce(i["name"], F.lit("")) != "") & (F.coalesce(i["id"], F.lit("")) != ""))
    items = F.when(F.size(fine(grouped)) > 0, fine(grouped)).otherwise(fine(F.coalesce("v.offers", empty)))
    rows = read.select("page_id", F.posexplode(items).alias("seq", "i"))
    price = F.coalesce(F.col("i.sellingMode.price.amount"), F.col("i.sellingMode.fixedPrice.amount")).try_cast("double")
    text = described(F.col("i.parameters"))
    both = F.concat_ws(" ", "i.name", text)
    return rows.select("page_id", "seq", F.col("i.name").alias("title"), F.concat(F.lit(base), "i.id").alias("url"), price.alias("price"), F.col("i.seller.city").alias("location"), text.alias("description"), parse.marked_share(both).alias("is_share"), parse.first_fraction(both).alias("share_fraction"), F.lit("allegro").alias("portal"))


def described(parameters: Column) -> Column:
    """'name: v1, v2; name: v' of the parameters that have values; null without any."""
    parts = F.transform(F.filter(parameters, lambda p: F.size(F.coalesce(p["values"], F.array().cast("array<string>"))) > 0), lambda p: F.concat(F.coalesce(p["name"], F.lit("")), F.lit(": "), F.array_join(p["values"], ", ")))
    return F.nullif(F.array_join(parts, "; "), F.lit(""))


CITY = "name string, lat double, lon double, voivodeship string, population long"


def read_cities(spark: SparkSession, path: str) -> DataFrame:
    """The city dimension from a JSON array."""
    return spark.read.schema(CITY).json(path, multiLine=True)


def city_index(cities: DataFrame) -> DataFrame:
    """key, name, lat, lon: each city under its name and its name without marks; of rows with one key the later wins."""
    keyed = cities.withColumn("_n", F.monotonically_increasing_id()).select(F.explode(F.array_distinct(F.array(F.lower("name"), without_marks(F.col("name"))))).alias("key"), "name", "lat", "lon", "_n")
    return keyed.groupBy("key").agg(F.max_by(F.struct("name", "lat", "lon"), "_n").alias("x")).select("key", "x.*")


AD = "description string, areaInSquareMeters string, areaInM2 string, roomsNumber string, floor string, buildingFloorsNum string, advertiserType string, images array<string>, location struct<address struct<city struct<name string>, district struct<name string>, street struct<name string>>>"


def embedded_detail(pages: DataFrame) -> DataFrame:
    """One row for each of pages(page_id, html): the listing that the page's own JSON holds; nulls where there is none."""
    body = F.regexp_extract("html", r'(?s)<script\s+id="__NEXT_DATA__"\s+type="application/json"[^>]*>(.*?)</script>', 1)
    ad = F.from_json(F.get_json_object(body, "$.props.pageProps.ad"), AD)
    at, area = ad["location"]["address"], lambda x: F.when(x.try_cast("double") != 0, x.try_cast("double"))
    return pages.select(
        "page_id", ad["description"].alias("full_description"), F.coalesce(area(ad["areaInSquareMeters"]), ad["areaInM2"].try_cast("double")).alias("area"), ad["roomsNumber"].alias("rooms"), ad["floor"].alias("floor"), ad["buildingFloorsNum"].alias("building_floors"),
        at["city"]["name"].alias("city"), at["district"]["name"].alias("district"), at["street"]["name"].alias("street"), ad["advertiserType"].alias("seller_type"), F.when(ad.isNotNull(), F.greatest(F.size(ad["images"]), F.lit(0))).alias("photos"),
    )
