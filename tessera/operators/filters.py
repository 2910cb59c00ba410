"""Predicates over listings. Each takes a frame and gives a frame; unset bounds change nothing."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.geo import haversine, in_range, near_box
from tessera.functions.text import without_marks
from tessera.operators.classify import TIER_ORDER, tier_number

ORDERS = {
    "score DESC": [F.desc, "score"], "score ASC": [F.asc, "score"], "price ASC": [F.asc, "price"], "price DESC": [F.desc, "price"],
    "first_seen_at DESC": [F.desc, "first_seen_at"], "last_seen_at DESC": [F.desc, "last_seen_at"],
}


def same(a: Column, b: str) -> Column:
    return F.lower(F.trim(a)) == b.strip().lower()


def by_score(df: DataFrame, least: int = 50) -> DataFrame:
    return df.where(F.coalesce("score", F.lit(0)) >= least)


def by_price(df: DataFrame, least: float | None = None, most: float | None = None) -> DataFrame:
    """Inclusive bounds; with any bound, rows without a readable price go."""
    price = F.col("price").try_cast("double")
    if least is not None:
        df = df.where(price >= least)
    if most is not None:
        df = df.where(price <= most)
    return df


def by_location(df: DataFrame, cities: DataFrame, *, voivodeship: str | None = None, city: str | None = None, km: float | None = None) -> DataFrame:
    """Equal voivodeship; city only together with km: inside the circle, or of that name where coordinates are missing.

    A centre that cities doesn't know leaves the rows as they are.
    """
    if voivodeship:
        df = df.where(same(F.col("voivodeship"), voivodeship))
    if not city or km is None:
        return df
    centre = find_city(cities, city).select(F.col("lat").alias("_lat"), F.col("lon").alias("_lon")).limit(1)
    # one row or none: a left join that is always true, with a side of at most one row
    joined = df.join(F.broadcast(centre), F.lit(True), "left")
    near = haversine(F.col("latitude"), F.col("longitude"), F.col("_lat"), F.col("_lon")) <= km
    named = (F.col("latitude").isNull() | F.col("longitude").isNull()) & same(F.col("city"), city)
    return joined.where(F.col("_lat").isNull() | F.coalesce(near, F.lit(False)) | named).drop("_lat", "_lon")


def by_radius(df: DataFrame, lat: float, lon: float, km: float, seq: str = "seq") -> DataFrame:
    """Inside the circle, with distance_km, nearest first. No radius, no rows."""
    if km <= 0:
        return df.where(F.lit(False)).withColumn("distance_km", F.lit(None).cast("double"))
    d = haversine(F.lit(lat), F.lit(lon), F.col("latitude"), F.col("longitude"))
    out = df.where(near_box(F.col("latitude"), F.col("longitude"), lat, lon, km)).withColumn("_d", d).where(F.col("_d") <= km)
    return out.withColumn("distance_km", F.round("_d", 2)).orderBy("_d", seq).drop("_d")


def near_centres(df: DataFrame, centres: DataFrame, km: float) -> DataFrame:
    """All pairs of a row and a centre(centre, lat, lon) within km, by an equal join on cells of a grid.

    Bands of latitude are km high; each is cut into whole cells around the earth that are at least as wide as two points km apart
    can differ in longitude there, near a pole into one. A centre is dealt to the cells around it in its band and the ones above and
    below, over the antimeridian too, so the join is an ordinary shuffled or broadcast one, whichever the sizes call for.
    """
    high = km / 110.0
    band = lambda lat: F.floor(lat / high)
    # the furthest from the equator that a point or a centre of the band and the ones beside it can be
    cosine = lambda y: F.cos(F.radians(F.least(F.lit(90.0), F.greatest(F.abs((y - 1) * high), F.abs((y + 2) * high)))))
    wide = lambda y: F.degrees(2 * F.asin(F.least(F.lit(1.0), F.try_divide(F.lit(math.sin(min(math.pi, math.radians(high)) / 2)), cosine(y)))))
    cells = lambda y: F.greatest(F.lit(1), F.floor(F.try_divide(F.lit(360.0), F.coalesce(wide(y), F.lit(180.0))))).cast("long")
    cell = lambda lon, n: F.pmod(F.floor((lon + 180) / 360 * n), n)
    dealt = centres.withColumn("_y", F.explode(F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda d: band(F.col("lat")) + d))).withColumn("_n", F.when(cells(F.col("_y")) < 4, 1).otherwise(cells(F.col("_y"))))
    dealt = dealt.withColumn("_x", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda d: F.pmod(cell(F.col("lon"), F.col("_n")) + d, F.col("_n"))))))
    rows = df.where(in_range(F.col("latitude"), F.col("longitude"))).withColumn("_y", band(F.col("latitude")))
    rows = rows.withColumn("_x", cell(F.col("longitude"), F.when(cells(F.col("_y")) < 4, 1).otherwise(cells(F.col("_y")))))
    d = haversine(F.col("latitude"), F.col("longitude"), F.col("lat"), F.col("lon"))
    return rows.join(dealt.drop("_n"), ["_y", "_x"]).withColumn("_d", d).where(F.col("_d") <= km).withColumn("distance_km", F.round("_d", 2)).drop("_y", "_x", "_d")


def by_class(df: DataFrame, *, share_source: str | None = None, property_type: str | None = None, fraction_size: str | None = None, price_bracket: str | None = None, city: str | None = None, voivodeship: str | None = None, least_tier: str | None = None) -> DataFrame:
    if least_tier:
        df = df.where(tier_number(F.col("tier")) <= TIER_ORDER.index(least_tier) + 1)
    for name, v in (("share_source", share_source), ("property_type", property_type), ("fraction_size", fraction_size), ("price_bracket", price_bracket)):
        if v:
            df = df.where(F.col(name) == v)
    for name, v in (("city", city), ("voivodeship", voivodeship)):
        if v:
            df = df.where(F.lower(F.coalesce(name, F.lit(""))).contains(v.lower()))
    return df


def stored(df: DataFrame, *, source: str | None = None, city: str | None = None, voivodeship: str | None = None, min_score: int | None = None, is_share: bool | None = None, is_active: bool | None = True, min_price: float | None = None, max_price: float | None = None, order: str = "score DESC", limit: int = 50, offset: int = 0) -> DataFrame:
    """Stored listings by optional conditions; an order that isn't in ORDERS is the default one. Ties by id."""
    if source:
        df = df.where(F.col("source") == source)
    if city:
        df = df.where(F.lower("city").contains(city.lower()))
    if voivodeship:
        df = df.where(F.lower("voivodeship") == voivodeship.lower())
    for name, v in (("is_share", is_share), ("is_active", is_active)):
        if v is not None:
            df = df.where(F.col(name) == v)
    if min_score is not None:
        df = df.where(F.col("score") >= min_score)
    if min_price is not None:
        df = df.where(F.col("price") >= min_price)
    if max_price is not None:
        df = df.where(F.col("price") <= max_price)
    way, name = ORDERS.get(order, ORDERS["score DESC"])
    return df.orderBy(way(name), F.asc("id")).offset(offset).limit(limit)


def has_keyword(title: Column, keywords: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, keywords)), lambda k: F.lower(title).contains(F.lower(k))) if keywords else F.lit(False)


def by_keywords(df: DataFrame, keywords: list[str]) -> DataFrame:
    """Marked as a share, or a keyword in the title."""
    return df.where(F.coalesce("is_share", F.lit(False)) | has_keyword(F.col("title"), keywords))


#: Letters of a keyword that it is filed under, and letters of all keywords up to which they are sent to every task.
FILED, BROADCAST_CHARS = 8, 20_000_000


def with_keywords(df: DataFrame, keywords: DataFrame) -> DataFrame:
    """All pairs of a row and a keyword(keyword) that its title contains, in any case.

    A keyword is filed under its first eight letters (or fewer, if it has no more), and a title fetches by its own runs of the
    lengths that keywords with the run's first letter have. So this is an equal join, and what a title fetches doesn't grow with the
    keywords that begin alike. Empty and null keywords are in no title.
    """
    low, kw = F.col("_low"), F.lower("keyword")
    filed = keywords.where("keyword <> ''").select("keyword", F.substring(kw, 1, FILED).alias("_run"), F.when(F.length(kw) > FILED, kw).alias("_whole")).distinct()
    lengths = filed.groupBy(F.substring("_run", 1, 1).alias("first")).agg(F.array_sort(F.collect_set(F.length("_run"))).alias("lengths"))
    lengths = lengths.agg(F.map_from_entries(F.collect_list(F.struct("first", "lengths"))).alias("_lengths"))  # one row; at most FILED numbers a letter
    at = F.filter(F.sequence(F.lit(1), F.length(low)), lambda i: F.map_contains_key("_lengths", F.substring(low, i, F.lit(1))))
    runs = F.flatten(F.transform(at, lambda i: F.transform(F.try_element_at("_lengths", F.substring(low, i, F.lit(1))), lambda n: F.substring(low, i, n))))
    # behind a generator of one row, so that a title is lower-cased once and not at each of its letters
    titles = df.where("title <> ''").select("*", F.inline(F.array(F.struct(F.lower("title").alias("_low")))))
    titles = titles.crossJoin(F.broadcast(lengths)).withColumn("_run", F.explode(F.array_distinct(runs))).drop("_lengths")
    if (filed.agg(F.sum(F.length("keyword") + F.length("_run"))).first()[0] or 0) <= BROADCAST_CHARS:
        filed = F.broadcast(filed)
    return titles.join(filed, "_run").where(F.col("_whole").isNull() | low.contains(F.col("_whole"))).drop("_run", "_whole", "_low")


def candidates(df: DataFrame) -> DataFrame:
    return df.where(F.col("score") > 0)


def suggest_cities(cities: DataFrame, query: str, top: int = 10) -> DataFrame:
    """Names that contain what was typed, with or without marks; the largest first; nothing under two letters."""
    q = query.strip().lower()
    if len(q) < 2:
        return cities.where(F.lit(False))
    hit = F.lower("name").contains(q) | without_marks(F.col("name")).contains(without_marks(F.lit(q)))
    return cities.where(hit).orderBy(F.desc("population"), "name").limit(top)


def find_city(cities: DataFrame, name: str) -> DataFrame:
    """The city of that name, else the one of that name without marks."""
    q = F.lower(F.trim(F.lit(name)))
    exact = F.lower("name") == q
    return cities.where(exact | (without_marks(F.col("name")) == without_marks(q))).orderBy(exact.desc(), "name").limit(1)


def cities_in(cities: DataFrame, voivodeship: str) -> DataFrame:
    return cities.where(same(F.col("voivodeship"), voivodeship)).orderBy(F.desc("population"), "name")


def largest_cities(cities: DataFrame, top: int = 20) -> DataFrame:
    return cities.orderBy(F.desc("population"), "name").limit(top)


def active_filters(filters: DataFrame) -> DataFrame:
    return filters.where("is_active").orderBy("name")


def given(filters: Column) -> Column:
    """A map without what isn't set: null, empty, 0 and false."""
    return F.map_filter(filters, lambda _, v: v.isNotNull() & ~v.isin("", "0", "0.0", "false"))


def allowed(user: Column, owner: int) -> Column:
    """Owner 0: everyone."""
    return F.lit(True) if owner == 0 else F.coalesce(user == owner, F.lit(False))


