"""The corpus pipeline: five stages over documents, each written as Parquet and read again.

A stage decides row by row: a doc_id may be null or stand in several rows. Where verdicts are joined to documents, the key
is a number of the row (ROW) in a copy of the stage's input that is written once, so that every reader sees the same numbers.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, mixing, neardup, repetition, sharding
from tessera.llm.common import Workspace, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
ROW = "_number"


def numbered(spark: SparkSession, docs: DataFrame, stage: str) -> DataFrame:
    """docs with the number of each row, written."""
    return Workspace(spark, stage).keep(docs.select(*COLUMNS, F.monotonically_increasing_id().alias(ROW)), "numbered")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules keep. The columns travel with the verdict, so nothing is joined or shuffled.

    Null and empty texts have too few words and go; texts of any length are read whole; repeated rows are judged alike; null ids
    stay; no documents give none; columns beyond COLUMNS go, whatever their names.
    """
    judged = repetition.quality_rules(docs, keep=COLUMNS)
    return judged.where("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, 0.8): the one with the least doc_id, null ids last.

    Null and empty texts are linked with nothing and stay; repeated rows are a group, as any equal texts are; of equal ids, and of
    null ones, the first row as written stays; different texts under one id are apart; no documents give none; columns beyond
    COLUMNS go, whatever their names.
    """
    docs = numbered(spark, docs, "near")
    groups = neardup.near_duplicates(docs.select(F.col(ROW).alias("doc_id"), "text", ROW), shingle=5, percent=80, row=ROW)
    named = groups.select(F.col("doc_id").alias(ROW), "component_id").join(docs.select(ROW, "doc_id"), ROW)
    one = named.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", ROW)).alias("least"))
    return docs.join(one.select(F.col(f"least.{ROW}").alias(ROW)), ROW, "left_semi").select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark.

    Null and empty texts hold none and stay; each row is judged by its own text, whatever its id; an empty benchmark, and items
    without text, take nothing away; windows of items without an id count; no documents give none; columns beyond COLUMNS go,
    whatever their names.
    """
    docs = numbered(spark, docs, "clean")
    leaks = decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark"), keep=[ROW])
    return docs.join(leaks.where(F.size("places") > 0).select(ROW), ROW, "left_anti").select(*COLUMNS)


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as its rate says, which here is at most 1: clean ones stay, those of domains over their target mostly go.

    Null and empty texts have the prior as posterior and are mixed like others; rows without an id are never labelled and are drawn
    by their number; rows of one id are drawn alike; without labels all posteriors are equal; no documents give none; columns
    beyond COLUMNS go, whatever their names. A target that rates of at most 1 can't meet is logged with what is missing.
    """
    docs = numbered(spark, docs, "mix")
    rates = mixing.mix(docs, mixing.domains_of(table(spark, sf_dir, "labels")), most=1.0, row=ROW)
    if (one := rates.select("residual").first()) and one.residual > mixing.EXACT:
        logging.getLogger(__name__).warning("the mixture misses its targets by %.4f of all tokens", one.residual)
    copies = rates.where("copies > 0").select(F.col("_row").alias(ROW), "copies")
    return docs.join(copies, ROW).select(*COLUMNS, F.explode(F.sequence(F.lit(1), "copies")).alias("_copy")).select(*COLUMNS)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard.

    Rows without an id are placed by their other columns; equal ids share a shard; texts play no part; no documents give none;
    a column named slot or shard is replaced, other columns stay.
    """
    return sharding.assign_shards(docs, otherwise=["lang", "source", "n_chars"]).drop("slot")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mix_domains", mix_domains),
    ("sharding", shards),
]

#: The mixing stage fits a classifier and rates by iteration, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    mine = list(Workspace.opened)  # other runs' tables, which stay
    ws, docs = Workspace(spark, "pipeline"), table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES:
        docs = ws.keep(stage(spark, docs, sf_dir), name)
        Workspace.close_all(*mine, ws)
        if before is not None:
            ws.drop(before)
        before = docs
    return docs
