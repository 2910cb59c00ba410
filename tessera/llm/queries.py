"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontaminate, discriminant, licenses, lines, mixing, neardup, ppm, prefixes, repetition, secrets, sharding, urls, variants
from tessera.llm.common import Workspace, table


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"), otherwise=["lang", "source", "n_chars"]).select("doc_id", "slot", "shard")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discriminant.classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two deliveries to one ledger: English texts, then all, of which only blobs that the first didn't have are scanned."""
    docs, ledger = table(spark, sf_dir, "documents"), f"{Workspace(spark, 'secrets').top}/ledger"
    secrets.scan_versions(docs.where("lang = 'en'"), ledger=ledger)
    return secrets.digest(secrets.scan_versions(docs, ledger=ledger))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), mixing.domains_of(table(spark, sf_dir, "labels"))).drop("_row")


def op5_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), shingle=4)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score_documents(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.quality_rules(table(spark, sf_dir, "documents"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.digest(lines.dedup_lines(table(spark, sf_dir, "documents")))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the words as given, of which one in 31 runs of a document is misspelt."""
    return variants.group_variants(variants.count_words(table(spark, sf_dir, "documents"), misspell=31))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of conversations that begin as the first one of their hundred does."""
    return prefixes.digest(*prefixes.prefix_trie(prefixes.rebuilt(prefixes.paths(table(spark, sf_dir, "conversations")))))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_sharding, op2_quality_classifier, op3_secret_scans, op4_mixing, op5_license_scans, op6_near_duplicates, op7_decontamination, op8_url_filters, op9_lm_scoring, op10_quality_rules, op11_line_dedup, op12_spelling_variants, op13_prefix_trie)}


def oracle_sql() -> dict[str, str]:
    return {"op1_sharding": sharding.SQL, "op3_secret_scans": secrets.SQL, "op6_near_duplicates": neardup.SQL, "op7_decontamination": decontaminate.SQL, "op8_url_filters": urls.SQL, "op11_line_dedup": lines.SQL, "op12_spelling_variants": variants.SQL, "op13_prefix_trie": prefixes.SQL}
