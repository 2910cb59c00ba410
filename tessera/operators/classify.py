"""Tiers, kinds and ranking of scored listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import rules
from tessera.operators.score import literal

TIER_ORDER = ["pewny", "prawdopodobny", "mozliwy"]


def tier(score: Column) -> Column:
    return F.when(score >= 75, "pewny").when(score >= 50, "prawdopodobny").otherwise("mozliwy")


def first_kind(x: str, kinds: list[tuple[str, str]], otherwise: str = "inne") -> Column:
    """The first kind of which an alternative matches the column x, which is lower-case: each runs where its literal part stands."""
    hit = lambda pattern: " OR ".join(f"(contains({x}, '{literal(p)}') AND {x} RLIKE r'(?U){p}')" for p in pattern.split("|"))
    return F.expr("CASE " + " ".join(f"WHEN {hit(pattern)} THEN '{name}'" for name, pattern in kinds) + f" ELSE '{otherwise}' END")


def fallback_fraction(x: Column) -> Column:
    """The first fraction if it is a proper one, else the first of five glyphs."""
    m = F.when(x.contains("/"), F.regexp_extract(x, r"(?U)\b(\d+)\s*/\s*(\d+)\b", 0))
    n, d = (F.trim(F.get(F.split(m, "/"), F.lit(i))).try_cast("long") for i in (0, 1))
    proper = F.when((d >= 2) & (n < d) & (n > 0), F.concat_ws("/", n, d))
    return F.coalesce(proper, *(F.when(x.contains(g), F.lit(f)) for g, f in (("½", "1/2"), ("⅓", "1/3"), ("¼", "1/4"), ("¾", "3/4"), ("⅔", "2/3"))))


def ratio(fraction: Column) -> Column:
    n, d = (F.regexp_extract(fraction, r"^(\d+)/(\d+)", i).try_cast("double") for i in (1, 2))
    return F.try_divide(n, d)


def fraction_size(fraction: Column) -> Column:
    r = ratio(fraction)
    return F.when(r >= 0.5, "duży").when(r >= 0.25, "średni").when(r.isNotNull(), "mały")


def price_bracket(price: Column) -> Column:
    return F.when(price < 1000, None).when(price < 30_000, "do_30k").when(price < 100_000, "30_100k").when(price < 300_000, "100_300k").when(price.isNotNull(), "powyżej_300k")


def attractiveness(price: Column, score: Column, fraction: Column, text: Column) -> Column:
    cheap = F.when(price > 1000, F.greatest(F.lit(0.0), 1 - price / 500_000) * 0.35).otherwise(0.0)
    share = F.when(fraction.isNotNull(), 0.15 + F.coalesce(ratio(fraction), F.lit(0.0)) * 0.10).otherwise(0.0)
    trustee = F.when(F.lower(text).contains("syndyk"), 0.10).otherwise(0.0)
    return F.least(F.lit(1.0), cheap + score / 100 * 0.30 + share + trustee)


def classified(df: DataFrame, min_score: int = rules.SHARE_FROM) -> DataFrame:
    """Scored listings from min_score on, with tier, kinds, fraction, bracket and attractiveness."""
    text = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("raw_description", F.lit(""))))
    out = df.where(F.col("score") >= min_score).withColumns({"_text": text, "_title": F.lower(F.coalesce("title", F.lit("")))})
    out = out.withColumns({
        "tier": tier(F.col("score")),
        "share_source": first_kind("_text", rules.SALE_SOURCES),
        "property_type": first_kind("_title", rules.PROPERTY_TYPES),
        "fraction": F.coalesce("fraction_detected", fallback_fraction(F.col("_text"))),
        "price_bracket": price_bracket(F.col("price")),
    })
    return out.withColumns({"fraction_size": fraction_size(F.col("fraction")), "attractiveness": attractiveness(F.col("price"), F.col("score"), F.col("fraction"), F.col("_text"))}).drop("_text", "_title")


def tier_number(x: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, TIER_ORDER)), x).cast("int")


def rank_order(seq: str = "seq") -> list[Column]:
    """Best tier first, then the most attractive, then as they came."""
    return [tier_number(F.col("tier")), F.col("attractiveness").desc(), F.col(seq)]


def ranked(df: DataFrame, seq: str = "seq") -> DataFrame:
    """All rows in order. They are dealt by seq first, so that the sort's sampling reads them and doesn't score them again."""
    return df.repartition(seq).orderBy(*rank_order(seq))


def numbered(df: DataFrame, order: list[Column], top: int, name: str = "rank") -> DataFrame:
    """The first top rows in order with their places, from 1: partial top-k sorts, then one small task numbers them."""
    return df.orderBy(*order).limit(top).withColumn(name, F.row_number().over(Window.orderBy(*order)))


def by_stars(df: DataFrame, seq: str = "seq") -> DataFrame:
    """Most stars first; the ones without analysis last, in their order."""
    return df.orderBy(F.col("stars").desc_nulls_last(), F.col(seq))
