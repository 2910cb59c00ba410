"""Listings and their neighbours, derived from the star-schema tables that the driver provides.

The tables hold no listings, so titles, places and sources are made from keys by fixed rules: every tier of
the text rules, penalties, glyphs, implausible fractions, upper case, missing urls and repeated ones occur.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TITLES = [
    "Sprzedaż udziału 1/2 w mieszkaniu", "UDZIAŁ W DOMU 3 / 8", "Współwłasność działki budowlanej", "Udzial w nieruchomosci 1/16", "Spadek po dziadku, dom", "Mieszkanie trzypokojowe",
    "Syndyk sprzeda udział w kamienicy", "Udziały w spółce z o.o.", "Część działki ½ grunt", "Garaż 190/2 obok", "Udział 7/12 w lokalu, licytacja", "Dom <b>nowy</b> & tani",
    "Sprzedam  udzial w terenie 3/1/2", "Współwłasność sprzedam, Łódź", "Ułamkowa część gruntu ⅔", "Dział spadkowy, udział spadkowy 5/12", "Zniesienie wspolwlasnosci domu", "Sprzedaż części nieruchomości 2 /3",
    "Współwłaściciel odda 1/1000 lasu", "Udziałów w nieruchomości 11/2", "Hala garażowa, udziału w niej 1/ 40", "Udział w prawie własności, upadłość", "Lokal\u00a0mieszkalny po podziale majątku", "Komornik: działka rolna",
]
TEXTS = [
    "Przedmiotem jest udział w nieruchomości, księga wieczysta, akt notarialny.", "Ładne   miejsce, wkład własny wymagany.", "Podział majątku po rozwodzie, sąd rejonowy, notariusz.", "Postępowanie spadkowe, testament, zachowek, spadkobiercy.",
    "", "Udział w drodze oraz części wspólne.", "Sprzedam udział 2/3 tanio.", "KW nr WA1M/12345678/9, udział w gruncie pod budynkiem.",
    "Część nieruchomości, współwłaściciel nieznany.", "kw wa1 brak; udział w spółce, udziałów w spółce.", "Syndyk masy upadłości\nsprzeda dwa udziały.", "Spadkobierców dwóch, dział spadku, rozwód.",
]
#: Some with loose accents, as some portals send them.
TITLES = [unicodedata.normalize("NFD", x) if k in (2, 13, 18) else x for k, x in enumerate(TITLES)]
TEXTS = [unicodedata.normalize("NFD", x) if k in (3, 8) else x for k, x in enumerate(TEXTS)]
#: Five cities and their coordinates.
CITIES = [("Warszawa", 52.2297, 21.0122, "mazowieckie", 1_790_000), ("Kraków", 50.0647, 19.945, "małopolskie", 780_000), ("Gdańsk", 54.352, 18.6466, "pomorskie", 470_000), ("Gdynia", 54.5189, 18.5305, "pomorskie", 245_000), ("Łódź", 51.7592, 19.456, "łódzkie", 670_000)]
PORTALS = ["olx", "otodom", "morizon", "domiporta", "nieruchomosci_online"]


def pick(values: list, i: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (i + 1).cast("int"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table in no more pieces than two a core is dealt over all cores: what is made of a row costs more than to move it.

    A large table has more pieces than that and stays as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() <= 2 * cores else df


def cities(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CITIES, "name string, lat double, lon double, voivodeship string, population long")


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One listing for each order. The customer's nation gives the city; all sides join on their keys."""
    o = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    k = F.col("o_orderkey")
    at = F.col("c_nationkey") % 5
    df = o.join(c, "o_custkey")
    first = F.when(k % 10 == 9, k - 1).otherwise(k)
    shift = (k % 100 - 50) / 200.0
    return df.select(
        k.alias("seq"),
        F.concat(F.lit("L"), k.cast("string")).alias("id"),
        pick(PORTALS, k % 5).alias("source"),
        F.when(k % 53 == 0, "").otherwise(F.concat(F.lit("https://example.com/oferta/"), first.cast("string"))).alias("url"),
        F.concat(pick(TITLES, k % len(TITLES)), F.lit(" nr "), k.cast("string")).alias("title"),
        pick(TEXTS, F.floor(k / len(TITLES)) % len(TEXTS)).alias("raw_description"),
        F.col("o_totalprice").alias("price"),
        F.when(k % 31 != 0, (20 + k % 120).cast("double")).alias("area"),
        pick([x[0] for x in CITIES], at).alias("city"),
        pick([x[3] for x in CITIES], at).alias("voivodeship"),
        F.when(k % 17 != 0, pick([x[1] for x in CITIES], at) + shift).alias("latitude"),
        F.when(k % 17 != 0, pick([x[2] for x in CITIES], at) + shift).alias("longitude"),
        F.col("o_orderdate").alias("first_seen_at"),
        F.timestamp_add("HOUR", (k % 200).cast("int"), F.col("o_orderdate")).alias("last_seen_at"),
        (k % 7 != 0).alias("is_active"),
    )


def saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every ninth listing is saved; some of a listing that is gone."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").where(k % 9 == 0).select(
        k.alias("id"),
        F.when(k % 4 == 0, F.concat(F.lit("X"), k.cast("string"))).otherwise(F.concat(F.lit("L"), k.cast("string"))).alias("listing_id"),
        F.when(k % 6 == 0, F.concat(F.lit("uwaga "), k.cast("string"))).alias("notes"),
        (k % 3).cast("int").alias("priority"),
        pick(["new", "contacted", "visited"], F.floor(k / 9) % 3).alias("status"),
        F.col("o_orderdate").alias("saved_at"),
    )


#: The same views in SQL, written on their own.
def _case(values: list[str], at: str) -> str:
    return f"CASE {at} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


def _quoted(values: list[str]) -> list[str]:
    return ["'" + v.replace("'", "''") + "'" for v in values]


_at = "c_nationkey % 5"
LISTINGS_SQL = f"""listings AS (
  SELECT o_orderkey AS seq, 'L' || o_orderkey AS id, {_case(_quoted(PORTALS), 'o_orderkey % 5')} AS source,
    CASE WHEN o_orderkey % 53 = 0 THEN '' ELSE 'https://example.com/oferta/' || (o_orderkey - CASE WHEN o_orderkey % 10 = 9 THEN 1 ELSE 0 END) END AS url,
    {_case(_quoted(TITLES), f'o_orderkey % {len(TITLES)}')} || ' nr ' || o_orderkey AS title, {_case(_quoted(TEXTS), f'(o_orderkey // {len(TITLES)}) % {len(TEXTS)}')} AS raw_description,
    o_totalprice AS price, CASE WHEN o_orderkey % 31 <> 0 THEN (20 + o_orderkey % 120)::DOUBLE END AS area,
    {_case(_quoted([x[0] for x in CITIES]), _at)} AS city, {_case(_quoted([x[3] for x in CITIES]), _at)} AS voivodeship,
    CASE WHEN o_orderkey % 17 <> 0 THEN ({_case([f'{x[1]}::DOUBLE' for x in CITIES], _at)}) + (o_orderkey % 100 - 50) / 200.0::DOUBLE END AS latitude,
    CASE WHEN o_orderkey % 17 <> 0 THEN ({_case([f'{x[2]}::DOUBLE' for x in CITIES], _at)}) + (o_orderkey % 100 - 50) / 200.0::DOUBLE END AS longitude,
    o_orderdate AS first_seen_at, o_orderdate + to_hours(o_orderkey % 200) AS last_seen_at, o_orderkey % 7 <> 0 AS is_active
  FROM orders JOIN customer ON o_custkey = c_custkey)"""
SAVED_SQL = f"""saved AS (
  SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN 'X' ELSE 'L' END || o_orderkey AS listing_id, CASE WHEN o_orderkey % 6 = 0 THEN 'uwaga ' || o_orderkey END AS notes,
    (o_orderkey % 3)::INTEGER AS priority, {_case(_quoted(['new', 'contacted', 'visited']), '(o_orderkey // 9) % 3')} AS status, o_orderdate AS saved_at
  FROM orders WHERE o_orderkey % 9 = 0)"""
CITIES_SQL = "cities(name, lat, lon, voivodeship, population) AS (VALUES " + ", ".join(f"('{n}', {a}::DOUBLE, {o}::DOUBLE, '{v}', {p})" for n, a, o, v, p in CITIES) + ")"
