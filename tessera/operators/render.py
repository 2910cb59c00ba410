"""Listings as text: flat rows, cards, pages, summary, report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import escaped, filled, listing_id
from tessera.operators.classify import numbered, rank_order

ICONS = {"pewny": "🔥", "prawdopodobny": "⭐", "mozliwy": "❓"}
PAGE_CHARS, PAGE_CUT = 4000, 3950


def flat(classified: DataFrame) -> DataFrame:
    """The fields that are shown and stored."""
    text = F.coalesce(filled(F.col("full_description")), F.col("raw_description"), F.lit("")) if "full_description" in classified.columns else F.coalesce("raw_description", F.lit(""))
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return classified.select(F.coalesce(filled(F.col("id")), listing_id(F.col("url"))).alias("id"), F.substring("title", 1, 120).alias("title"), "price", blank("city"), blank("voivodeship"), blank("url"), "source", "score", "tier", "share_source", "property_type", blank("fraction"), F.round("attractiveness", 3).alias("attractiveness"), "area", F.substring(text, 1, 1500).alias("description"), "seq")


def icon(tier: Column) -> Column:
    out = F.lit("")
    for name, i in ICONS.items():
        out = F.when(tier == name, i).otherwise(out)
    return out


def money(price: Column) -> Column:
    return F.concat(F.format_number(price, 0), F.lit(" PLN"))


def card(place: Column) -> Column:
    """A listing's card with its number."""
    meta = F.concat_ws(" • ", filled(F.col("city")), F.when(F.col("share_source") != "inne", F.col("share_source")), F.when(F.col("property_type") != "inne", F.col("property_type")))
    return F.concat_ws(
        "\n",
        F.concat(icon(F.col("tier")), F.lit(" <b>"), place.cast("string"), F.lit(". "), escaped(F.substring("title", 1, 60)), F.lit("</b>")),
        F.when(F.col("price") != 0, F.concat(F.lit("💰 "), money(F.col("price")))),
        F.when(filled(F.col("fraction")).isNotNull(), F.concat(F.lit("📐 Udział: "), F.col("fraction"))),
        F.when(meta != "", F.concat(F.lit("📍 "), meta)),
        F.concat(F.lit('🔗 <a href="'), F.col("url"), F.lit('">Otwórz ogłoszenie</a> (live)')),
    )


def page(classified: DataFrame, number: int = 0, size: int = 5) -> DataFrame:
    """One row: the page's text and the number of pages."""
    pages = classified.agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / size)).cast("int").alias("pages"))
    rows = numbered(classified, rank_order(), (number + 1) * size).where(F.col("rank") > number * size)
    cards = rows.select("rank", card(F.col("rank")).alias("card")).agg(F.array_sort(F.collect_list(F.struct("rank", "card"))).alias("c"))
    joined = F.array_join(F.transform("c", lambda x: F.concat(x["card"], F.lit("\n"))), "\n")
    text = F.concat(F.lit(f"📋 <b>Wyniki ({number + 1}/"), F.col("pages").cast("string"), F.lit(")</b>\n\n"), joined)
    short = F.when(F.length(text) > PAGE_CHARS, F.concat(F.substring(text, 1, PAGE_CUT), F.lit("\n\n… (skrócono, użyj ▶ aby zobaczyć więcej)"))).otherwise(text)
    return cards.join(pages, F.lit(True)).select(F.when(F.size("c") == 0, F.lit("📭 Brak wyników na tej stronie.")).otherwise(short).alias("text"), "pages")


def summary(classified: DataFrame) -> DataFrame:
    """One row: how many of each tier, the range of prices, the most frequent ways of sale."""
    n = {t: F.count_if(F.col("tier") == t) for t in ICONS}
    real = F.when(F.col("price") > 1000, F.col("price"))
    head = classified.agg(F.count(F.lit(1)).alias("n"), *(c.alias(t) for t, c in n.items()), F.min(real).alias("lo"), F.max(real).alias("hi"))
    ways = classified.groupBy("share_source").agg(F.count(F.lit(1)).alias("k"), F.min("seq").alias("first")).orderBy(F.desc("k"), "first").limit(3)
    ways = ways.agg(F.array_sort(F.collect_list(F.struct(-F.col("k"), "first", F.concat(F.col("k").cast("string"), F.lit("× "), F.col("share_source"))))).alias("w"))
    lines = F.concat_ws(
        "\n",
        F.concat(F.lit("📊 <b>Znaleziono "), F.col("n").cast("string"), F.lit(" udziałów:</b>\n")),
        *(F.when(F.col(t) > 0, F.concat(F.lit(f"{i} {label}: <b>"), F.col(t).cast("string"), F.lit("</b>"))) for (t, i), label in zip(ICONS.items(), ("Pewne", "Prawdopodobne", "Możliwe"), strict=True)),
        F.when(F.col("lo").isNotNull(), F.concat(F.lit("\n💰 Ceny: "), F.format_number("lo", 0), F.lit(" – "), F.format_number("hi", 0), F.lit(" PLN"))),
        F.concat(F.lit("📋 Źródła: "), F.array_join(F.transform("w", lambda x: x["col3"]), ", ")),
    )
    return head.join(ways, F.lit(True)).select(F.when(F.col("n") == 0, F.lit("📭 Nie znaleziono udziałów spełniających kryteria.")).otherwise(lines).alias("text"))


def report_lines(classified: DataFrame, top: int = 20) -> DataFrame:
    """The report's lines about listings: rank and line, three for each."""
    rows = numbered(classified, rank_order(), top)
    first = F.concat(F.lpad(F.col("rank").cast("string"), 2, " "), F.lit(". "), icon(F.col("tier")), F.lit(" ["), F.col("score").cast("string"), F.lit("] "), F.substring("title", 1, 70))
    price = F.when(F.col("price") != 0, money(F.col("price"))).otherwise("—")
    second = F.concat(F.lit("     "), price, F.lit(" | "), F.coalesce(filled(F.col("city")), F.lit("—")), F.lit(" | "), F.col("source"), F.when(filled(F.col("fraction")).isNotNull(), F.concat(F.lit(" | udział "), F.col("fraction"))).otherwise(""))
    return rows.select("rank", F.concat_ws("\n", first, second, F.concat(F.lit("     "), F.col("url"))).alias("line"))
