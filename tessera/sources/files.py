"""Files: tables in, results and settings out; scans that stop and scans that may fail."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LISTING = "id string, source string, url string, title string, description string, price double, area double, city string, voivodeship string, latitude double, longitude double, score int, is_share boolean, is_active boolean, first_seen_at timestamp, last_seen_at timestamp, created_at timestamp, updated_at timestamp"
DEFAULTS = {"portals": {}, "llm": {"enabled": False}, "search": {"min_score": 25}}


def write_results(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_report(lines: DataFrame, path: str) -> None:
    """Lines (rank, line) as text, in order."""
    lines.orderBy("rank").select("line").write.mode("overwrite").text(path)


def save_preset(spark: SparkSession, preset: dict[str, str], path: str) -> None:
    spark.createDataFrame([(preset,)], "filters map<string,string>").write.mode("overwrite").json(path)


def load_preset(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("filters map<string,string>").json(path)


def empty_source(spark: SparkSession, schema: str = LISTING) -> DataFrame:
    """A source that is registered and has nothing."""
    return spark.createDataFrame([], schema)


def read_settings(spark: SparkSession, path: str) -> dict:
    """Settings from YAML, a leading mark removed; what can't be read as a mapping gives the defaults."""
    import yaml

    text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()).lstrip("﻿")
    try:
        got = yaml.safe_load(text)
    except yaml.YAMLError:
        got = None
    return DEFAULTS | got if isinstance(got, dict) else dict(DEFAULTS)


def first_pages(scanned: DataFrame, most: int = 3) -> DataFrame:
    """Of pages(portal, keyword, page, n): those a scan would read, up to the first empty one or most. Page counts from 1."""
    w = Window.partitionBy("portal", "keyword").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    return scanned.where(F.col("page") <= most).withColumn("_empty", F.coalesce(F.max(F.col("n") == 0).over(w), F.lit(False))).where("NOT _empty").drop("_empty")


def scan_plan(keywords: DataFrame, pages: int) -> DataFrame:
    """Every page of every keyword that is to be scanned."""
    return keywords.select("*", F.explode(F.sequence(F.lit(1), F.lit(pages))).alias("page"))


def load_sources(loaders: dict[str, Callable[[], DataFrame]]) -> tuple[list[DataFrame], dict[str, str]]:
    """Frames of the sources that could be opened, with their name as source, and each source's status.

    One that fails leaves the others as they are; its error is its status.
    """
    frames, status = [], {}
    for name, load in loaders.items():
        try:
            frames.append(load().withColumn("source", F.lit(name)))
            status[name] = "done"
        except Exception as error:  # noqa: BLE001  whatever a source raises stays with it
            status[name] = f"error: {type(error).__name__}"
    return frames, status
