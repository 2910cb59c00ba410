"""Changes to stored tables, as new frames.

Parquet has no update, so a change is a function from the old rows and a batch to the new ones; commits.py
stores them. The time of a change is a parameter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import rules
from tessera.functions.text import filled
from tessera.operators.tables import existing, missing

#: Columns that an update leaves as they are.
KEPT = ["source", "url", "first_seen_at", "created_at"]


def _last(batch: DataFrame, key: str, seq: str) -> DataFrame:
    return batch.groupBy(key).agg(F.max_by(F.struct(*(c for c in batch.columns if c != key)), seq).alias("x")).select(key, "x.*")


def upsert(old: DataFrame, batch: DataFrame, now: Column, seq: str = "seq") -> DataFrame:
    """old with batch by id, and op: insert, update or keep. The last row of an id in a batch counts."""
    new = _last(batch, "id", seq)
    new = new.select("id", *(F.col(c).alias(f"_{c}") for c in new.columns if c not in ("id", seq)), F.lit(True).alias("_new"))
    joined = old.withColumn("_old", F.lit(True)).join(new, "id", "full")
    is_new, is_old = F.col("_new").isNotNull(), F.col("_old").isNotNull()
    out = []
    for c in old.columns:
        if c == "id":
            out.append(F.col("id"))
        elif c in ("last_seen_at", "updated_at"):
            out.append(F.when(is_new, now).otherwise(F.col(c)).alias(c))
        elif c in ("first_seen_at", "created_at"):
            out.append(F.when(is_old, F.col(c)).otherwise(now).alias(c))
        elif c == "is_active":
            out.append(F.when(is_new, F.lit(True)).otherwise(F.col(c)).alias(c))
        elif c in KEPT:
            out.append(F.when(is_old, F.col(c)).otherwise(F.col(f"_{c}")).alias(c))
        elif f"_{c}" in joined.columns:
            out.append(F.when(is_new, F.col(f"_{c}")).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    op = F.when(is_new & is_old, "update").when(is_new, "insert").otherwise("keep")
    return joined.select(*out, op.alias("op"))


def insert_or_ignore(old: DataFrame, batch: DataFrame, seq: str = "seq") -> DataFrame:
    """Batch rows whose id and url are both new, the first of each."""
    one = lambda d, key: d.groupBy(key).agg(F.min_by(F.struct(*(c for c in d.columns if c != key)), seq).alias("x")).select(key, "x.*")
    fresh = one(one(batch, "id"), "url")
    return fresh.join(old.select("id"), "id", "left_anti").join(old.select("url"), "url", "left_anti").select(*batch.columns)


def consecutive(df: DataFrame, order: str, name: str, after: int = 0, pieces: int = 64) -> DataFrame:
    """df numbered by the column order, from after + 1 on. Rows are numbered in pieces between quantiles, each after the counts of those before."""
    bounds = df.select(F.percentile_approx(order, [k / pieces for k in range(1, pieces)])).first()[0] or []
    piece = sum(((F.col(order) > b).cast("int") for b in sorted(set(bounds))), F.lit(0))
    dealt = df.withColumn("_piece", piece)
    counts = dealt.groupBy("_piece").agg(F.count(F.lit(1)).alias("_count"))
    # at most so many rows as there are pieces, in one small task
    before = counts.withColumn("_before", F.coalesce(F.sum("_count").over(Window.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_count")
    return dealt.join(F.broadcast(before), "_piece").withColumn(name, F.lit(after) + F.col("_before") + F.row_number().over(Window.partitionBy("_piece").orderBy(order))).drop("_piece", "_before")


def save(saved: DataFrame, requests: DataFrame, listings: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Saved rows after requests(listing_id, notes, priority, seq), and the requests for listings that aren't there.

    A listing that is saved already gets the new notes and priority and keeps its status.
    """
    wanted = _last(existing(requests, listings), "listing_id", "seq").select("listing_id", F.col("notes").alias("_notes"), F.col("priority").alias("_priority"), F.col("seq").alias("_seq"))
    joined = saved.withColumn("_old", F.lit(True)).join(wanted, "listing_id", "full")
    # new ids go on from the largest one
    fresh = joined.where("_old IS NULL").select("listing_id", F.col("_notes").alias("notes"), F.col("_priority").alias("priority"), F.lit("new").alias("status"), now.alias("saved_at"), "_seq")
    top = saved.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    fresh = consecutive(fresh, "_seq", "id", top).select("id", "listing_id", "notes", "priority", "status", "saved_at")
    kept = joined.where("_old").select("id", "listing_id", F.when(F.col("_seq").isNotNull(), F.col("_notes")).otherwise(F.col("notes")).alias("notes"), F.coalesce("_priority", "priority").alias("priority"), "status", "saved_at")
    return kept.unionByName(fresh), missing(requests, listings)


def without(table: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return table.join(gone.select(key), key, "left_anti")


def expired(listings: DataFrame, now: Column, hours: int = 72) -> DataFrame:
    """Active listings not seen for hours become inactive. Times are compared as times."""
    stale = F.col("last_seen_at") < F.timestamp_add("HOUR", F.lit(-hours), now)
    return listings.withColumn("is_active", F.col("is_active") & ~F.coalesce(stale, F.lit(False)))


def append(table: DataFrame, row: DataFrame) -> DataFrame:
    return table.unionByName(row, allowMissingColumns=True)


def cascade(saved: DataFrame, listings: DataFrame) -> DataFrame:
    """Saved rows whose listing is still there."""
    return existing(saved, listings)


def validated(df: DataFrame) -> DataFrame:
    """source and status in lower case, score in 0..100, and why a row isn't valid (null: it is)."""
    source, status = F.lower(F.coalesce("source", F.lit(""))), F.lower(F.coalesce("status", F.lit("new")))
    why = F.concat_ws(", ", F.when(~source.isin(rules.LISTING_SOURCES), "source"), F.when(~status.isin(rules.SAVED_STATUS), "status"), F.when(~F.coalesce("priority", F.lit(0)).between(0, 2), "priority"))
    return df.withColumns({"source": source, "status": status, "score": F.greatest(F.lit(0), F.least(F.lit(100), "score")), "rejected": filled(why)})
