"""Deduplication, joins, sets and statistics over listing tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import rules
from tessera.functions.text import filled, listing_id, normalized


def portal_rank(source: Column) -> Column:
    at = F.array_position(F.array(*map(F.lit, rules.PORTALS)), source)
    return F.when(at > 0, at).otherwise(len(rules.PORTALS) + 1).cast("int")


def canonical(df: DataFrame) -> DataFrame:
    """Any source's rows in the one shape; missing and null are the same, columns of other names go to extra."""
    have = set(df.columns)
    first = lambda *names: F.coalesce(*(filled(F.col(n).cast("string")) for n in names if n in have), F.lit(""))
    num = lambda *names: F.coalesce(*(F.col(n).try_cast("double") for n in names if n in have), F.lit(None).cast("double"))
    url, title = first("url", "source_url"), first("title")
    used = {"id", "title", "price", "city", "location", "voivodeship", "url", "source_url", "source_portal", "portal", "source", "raw_description", "description", "area", "area_m2", "fraction", "share_fraction"}
    extra = [c for c in df.columns if c not in used]
    more = F.map_from_arrays(F.array(*map(F.lit, extra)), F.array(*(F.col(c).cast("string") for c in extra))) if extra else F.create_map().cast("map<string,string>")
    made = df.select(first("id").alias("_id"), title.alias("title"), num("price").alias("price"), first("city", "location").alias("city"), first("voivodeship").alias("voivodeship"), url.alias("url"), first("source_portal", "portal", "source").alias("source_portal"), first("raw_description", "description", "title").alias("raw_description"), num("area", "area_m2").alias("area"), first("fraction", "share_fraction").alias("fraction"), F.map_filter(more, lambda _, v: v.isNotNull()).alias("extra"))
    key = F.when(F.col("url") != "", F.col("url")).otherwise(F.col("title"))
    return made.select(F.when(F.col("_id") != "", F.col("_id")).otherwise(listing_id(key)).alias("id"), *made.columns[1:])


def first_by_url(df: DataFrame, source: str = "source", seq: str = "seq") -> DataFrame:
    """One row for each url, the first by registry order of its source, then arrival; rows without a url go.

    The first row's place is found by a partial minimum, so a url with very many rows sends one a task.
    """
    rows = df.where(F.col("url").isNotNull() & (F.col("url") != ""))
    order = F.struct(portal_rank(F.col(source)).alias("r"), F.col(seq).alias("s"))
    return rows.groupBy("url").agg(F.min_by(F.struct(*(F.col(c) for c in df.columns if c != "url")), order).alias("x")).select(*(F.col("url") if c == "url" else F.col(f"x.{c}").alias(c) for c in df.columns))


def duplicates_removed(df: DataFrame) -> DataFrame:
    return df.where("url <> ''").agg((F.count(F.lit(1)) - F.count_distinct("url")).alias("removed"))


def across_portals(df: DataFrame, seq: str = "seq") -> DataFrame:
    """The proposed second dedup: by normal title, then by price, area and city; the first of each stays."""
    keep = lambda d, *keys: d.groupBy(*keys).agg(F.min_by(F.struct(*(F.col(c) for c in d.columns if c not in keys)), seq).alias("_x")).select(*(F.col(c) if c in keys else F.col(f"_x.{c}").alias(c) for c in d.columns))
    one = keep(df.withColumn("_title", normalized(F.col("title"), compose=True)), "_title").drop("_title")
    known = F.col("price").isNotNull() & F.col("area").isNotNull() & (F.coalesce("city", F.lit("")) != "")
    return keep(one.where(known), "price", "area", "city").unionByName(one.where(~known))


def union_sources(frames: list[DataFrame]) -> DataFrame:
    """All sources' rows, in registry order by the column portal_rank."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.withColumn("portal_rank", portal_rank(F.col("source")))


def saved_with_listings(saved: DataFrame, listings: DataFrame, *, status: str | None = None, priority: int | None = None) -> DataFrame:
    if status:
        saved = saved.where(F.col("status") == status)
    if priority is not None:
        saved = saved.where(F.col("priority") == priority)
    about = listings.select(F.col("id").alias("listing_id"), "title", "price", "city", "url")
    return saved.join(about, "listing_id").orderBy(F.desc("priority"), F.desc("saved_at"), "id")


def saved_with_titles(saved: DataFrame, listings: DataFrame, default: str = "(bez tytułu)") -> DataFrame:
    about = listings.select(F.col("id").alias("listing_id"), F.col("title").alias("_t"), "price", "url")
    return saved.join(about, "listing_id", "left").withColumn("title", F.coalesce(filled(F.col("_t")), filled(F.col("notes")), F.lit(default))).drop("_t")


def existing(requests: DataFrame, listings: DataFrame) -> DataFrame:
    return requests.join(listings.select(F.col("id").alias("listing_id")), "listing_id", "left_semi")


def missing(requests: DataFrame, listings: DataFrame) -> DataFrame:
    return requests.join(listings.select(F.col("id").alias("listing_id")), "listing_id", "left_anti")


def with_detail(listings: DataFrame, detail: DataFrame, key: str = "id") -> DataFrame:
    """Listings with the detail's fields where they have none of their own."""
    common = [c for c in detail.columns if c != key and c in listings.columns]
    joined = listings.join(detail.select(key, *(F.col(c).alias(f"_{c}" if c in common else c) for c in detail.columns if c != key)), key, "left")
    return joined.withColumns({c: F.coalesce(c, f"_{c}") for c in common}).drop(*(f"_{c}" for c in common))


def with_coordinates(df: DataFrame, cities: DataFrame) -> DataFrame:
    """lat and lon by the city's name, else by its name without marks. The dimension is small, so Spark broadcasts it."""
    from tessera.functions.text import without_marks

    exact = cities.select(F.lower("name").alias("_name"), F.col("lat").alias("_lat"), F.col("lon").alias("_lon"))
    plain = cities.groupBy(without_marks(F.col("name")).alias("_plain")).agg(F.min_by("lat", "name").alias("_plat"), F.min_by("lon", "name").alias("_plon"))
    out = df.withColumns({"_name": F.lower(F.trim("city")), "_plain": without_marks(F.trim("city"))}).join(exact, "_name", "left").join(plain, "_plain", "left")
    return out.withColumns({"lat": F.coalesce("_lat", "_plat"), "lon": F.coalesce("_lon", "_plon")}).drop("_name", "_plain", "_lat", "_lon", "_plat", "_plon")


def with_prices(calls: DataFrame, prices: DataFrame, default: tuple[float, float]) -> DataFrame:
    """Cost of each call, by its model's price for a million tokens in and out; unknown models have the default one."""
    joined = calls.join(prices, "model", "left")
    return joined.withColumn("cost", (F.col("input_tokens") * F.coalesce("price_in", F.lit(default[0])) + F.col("output_tokens") * F.coalesce("price_out", F.lit(default[1]))) / 1_000_000).drop("price_in", "price_out")


def totals(listings: DataFrame) -> DataFrame:
    """All, active and share listings, in one scan."""
    return listings.agg(F.count(F.lit(1)).alias("total"), F.count_if("is_active").alias("active"), F.count_if("is_share").alias("shares"))


def by_source(listings: DataFrame) -> DataFrame:
    return listings.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def by_source_map(listings: DataFrame) -> DataFrame:
    return by_source(listings).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "n")))).alias("by_source"))


def funnel(scored: DataFrame) -> DataFrame:
    return scored.agg(F.count(F.lit(1)).alias("raw"), F.count_if(F.col("score") > 0).alias("candidates"), F.count_if(F.col("score") <= 0).alias("noise"), F.count_if("is_share").alias("found"))


def portal_status(listings: DataFrame, failed: dict[str, str] | None = None) -> DataFrame:
    """Each portal of the registry with its rows and status, those without rows too."""
    spark = listings.sparkSession
    dim = spark.createDataFrame([(p, (failed or {}).get(p, "done")) for p in rules.PORTALS], "portal string, status string")
    return dim.join(by_source(listings).withColumnRenamed("source", "portal"), "portal", "left").select("portal", "status", F.coalesce("n", F.lit(0)).cast("long").alias("count"))


def tiers(classified: DataFrame) -> DataFrame:
    return classified.groupBy("tier").agg(F.count(F.lit(1)).alias("n"))


def price_range(classified: DataFrame) -> DataFrame:
    return classified.where("price > 1000").agg(F.min("price").alias("lowest"), F.max("price").alias("highest"))


def top_sources(classified: DataFrame, top: int = 3, seq: str = "seq") -> DataFrame:
    return classified.groupBy("share_source").agg(F.count(F.lit(1)).alias("n"), F.min(seq).alias("first")).orderBy(F.desc("n"), "first").limit(top)


def usage(calls: DataFrame) -> DataFrame:
    """Calls, errors, tokens and cost; only calls that succeeded cost."""
    ok = F.col("http_status") == 200
    return calls.agg(F.count(F.lit(1)).alias("calls"), F.count_if(~ok).alias("errors"), F.sum(F.when(ok, F.col("input_tokens")).otherwise(0)).alias("input_tokens"), F.sum(F.when(ok, F.col("output_tokens")).otherwise(0)).alias("output_tokens"), F.round(F.sum(F.when(ok, F.col("cost")).otherwise(0.0)), 6).alias("cost"))


def threshold_sweep(labelled: DataFrame, thresholds: list[int]) -> DataFrame:
    """Precision, recall and F1 of score >= threshold against truth, for a stated list of thresholds, in one scan."""
    hit = lambda t: F.col("score") >= t
    counts = labelled.agg(*(F.struct(F.lit(t).alias("threshold"), F.count_if(hit(t) & F.col("truth")).alias("tp"), F.count_if(hit(t) & ~F.col("truth")).alias("fp"), F.count_if(~hit(t) & F.col("truth")).alias("fn")).alias(f"t{t}") for t in thresholds))
    rows = counts.select(F.inline(F.array(*(F.col(f"t{t}") for t in thresholds))))
    p, r = F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))
    return rows.select("threshold", "tp", "fp", "fn", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.try_divide(2 * p * r, p + r), 6).alias("f1"))


def score_histogram(scored: DataFrame) -> DataFrame:
    return scored.groupBy((F.floor(F.col("score") / 10) * 10).cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def overlap(a: DataFrame, b: DataFrame, key: str = "url") -> DataFrame:
    """Keys of either scan, and the share of the first's that the second has."""
    keys = a.select(key, F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(b.select(key, F.lit(0).alias("a"), F.lit(1).alias("b"))).groupBy(key).agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return keys.agg(F.sum("a").alias("first"), F.sum("b").alias("second"), F.sum(F.col("a") * F.col("b")).alias("n_both")).withColumn("ratio", F.round(F.try_divide(F.col("n_both"), F.col("first")), 6))


def chosen_portals(enabled: list[str] | None) -> list[str]:
    """The enabled ones that are supported, in registry order; none of them: all."""
    return [p for p in rules.PORTALS if p in (enabled or [])] or list(rules.PORTALS)
