"""Listings with what their own landed pages say.

A page is parsed where it lies: only the parsed row, narrow, is shuffled to its listing. A listing never goes away
and never loses a value: one without a page that can be read stays as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import parse
from tessera.functions.text import filled
from tessera.sources import html, json

#: Fixed names: what a listing takes from its page where it has nothing itself.
TAKEN = {"area": "double", "floor": "string", "building_floors": "string", "rooms": "string", "district": "string", "street": "string", "seller_type": "string", "photos_count": "int"}
#: Portals whose pages hold the listing as JSON, and those whose pages give area and floor as lines.
EMBEDDED, LINED = "otodom", "morizon"
READ = ["full_description", "kw_number", *TAKEN]


def read_details(pages: DataFrame) -> DataFrame:
    """url and READ: one row for each url of pages(url, portal, html, status, fetched_at) that has a readable page, from the latest.

    Refused pages (see blocked) and empty ones don't count, so an older page stands in for them. A page that can be read but
    says nothing gives a row of nulls, and so does broken JSON. Of pages of one time the greatest row in the order of READ is taken; rows without a url have no
    listing and go; a null time is before all others; other columns are ignored.
    """
    fine = pages.where(filled(F.col("url")).isNotNull() & ~html.blocked(F.col("html"), F.col("status")))
    # the key goes through the reader with the page: plain values only
    key = F.struct("url", F.unix_micros(F.col("fetched_at").cast("timestamp")).alias("at"), F.lower("portal").alias("portal"))
    fine = fine.select(key.alias("page_id"), F.lower("portal").alias("portal"), "html")
    embedded = F.col("portal").eqNullSafe(EMBEDDED)
    ads = json.embedded_detail(fine.where(embedded)).withColumnRenamed("photos", "photos_count")
    ads = ads.select("page_id", F.substring("full_description", 1, 3000).alias("full_description"), parse.land_register(F.coalesce("full_description", F.lit(""))).alias("kw_number"), *(F.col(c).cast(kind).alias(c) for c, kind in TAKEN.items()))
    told = html.details(fine.where(~embedded))
    lined = F.col("page_id.portal") == LINED  # other portals' lines are parameters, which a listing doesn't take
    told = told.select("page_id", "full_description", F.col("kw").alias("kw_number"), F.when(lined, F.col("area")).alias("area"), F.when(lined, F.col("floor").cast("string")).alias("floor"))
    both = ads.unionByName(told, allowMissingColumns=True)
    some = [F.nullif(F.col(c), F.lit("")).alias(c) if TAKEN.get(c, "string") == "string" else F.when(F.col(c) != 0, F.col(c)).alias(c) for c in READ]
    latest = F.max(F.struct(F.col("page_id.at").alias("at"), *some)).alias("x")
    return both.groupBy(F.col("page_id.url").alias("url")).agg(latest).select("url", *(F.col(f"x.{c}").alias(c) for c in READ))


def _taken(own: T.DataType, name: str) -> Column:
    """The page's value in the type of the listing's own column."""
    if name == "rooms" and isinstance(own, T.NumericType):
        return parse.rooms(F.col(f"_d.{name}")).cast(own)
    return F.col(f"_d.{name}").try_cast(own)


def enrich(listings: DataFrame, details: DataFrame) -> DataFrame:
    """Every listing once, in its own columns, then those of READ that it lacks, and deep_fetched: was there a page?

    full_description and kw_number are the page's where it has them. Of TAKEN, a listing's own value stands; the page's fills a
    null (a number 0 and an empty text of a page fill nothing). Listings without a url, or whose page is missing or was
    refused, stay as they are. details has one row for a url (see read_details). Repeated listings each get their page; those
    without a url are dealt by their content, so that they don't meet in one task; a url with very many
    listings is split by adaptive joins, as the side of details holds it once.
    """
    plain = [f"`{f.name}`" for f in listings.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    url = F.when(filled(F.col("url")).isNotNull(), F.col("url"))
    keyed = listings.withColumn("_url", F.coalesce(url, F.concat(F.lit("\0"), F.xxhash64(*plain).cast("string"))))
    got = details.select(F.col("url").alias("_url"), F.struct(*READ).alias("_d"))
    joined = keyed.join(got, "_url", "left")
    own = {f.name: f.dataType for f in listings.schema.fields}
    made = []
    for c in listings.columns:
        if c in TAKEN:
            made.append(F.coalesce(F.col(c), _taken(own[c], c)).alias(c))
        elif c in READ:
            made.append(F.coalesce(F.col(f"_d.{c}"), F.col(c)).alias(c))
        elif c != "deep_fetched":
            made.append(F.col(f"`{c}`"))
    made += [F.col(f"_d.{c}").alias(c) for c in READ if c not in own]
    return joined.select(*made, F.col("_d").isNotNull().alias("deep_fetched"))


def coverage(enriched: DataFrame, portal: str = "source_portal") -> DataFrame:
    """For each portal: listings, those with a page, with a description, with a land-register number."""
    count = lambda c, name: F.count(F.when(c, True)).alias(name)
    return enriched.groupBy(F.col(portal).alias("portal")).agg(F.count(F.lit(1)).alias("n"), count(F.col("deep_fetched"), "n_fetched"), count(F.col("full_description").isNotNull(), "n_described"), count(F.col("kw_number").isNotNull(), "n_registered"))
