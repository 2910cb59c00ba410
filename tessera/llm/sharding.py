"""Placement on shards by a permutation-filled lookup table.

Every shard has a preference order over the slots of a prime-sized table: a start and a step made from
a hash of its name. Shards take turns; each claims the first slot of its order that is still free, until
the table is full. So all shards hold equal numbers of slots, give or take one, and when a shard leaves
or joins, few slots change hands. A document's key hashes to a slot; the table, whose size is a
parameter and not a property of the data, is broadcast and gives the shard in constant time.

Defined results: a row whose key is null is placed by the columns in otherwise (or as the text 'null'
without them), so that many such rows don't share one shard; equal keys, and so repeated rows, share a shard; keys that
hash to one slot do, too, as a tie has no order; texts play no part, empty or of any length; an empty table
gives none; existing columns named slot or shard are replaced, other columns stay.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHARDS, SLOTS = 64, 6551


def preference(name: str, slots: int) -> tuple[int, int]:
    digest = hashlib.md5(name.encode()).hexdigest()
    return int(digest[:8], 16) % slots, int(digest[8:16], 16) % (slots - 1) + 1


def fill(names: list[str], slots: int) -> list[int]:
    """The shard's number for each slot. Depends on the parameters alone."""
    if slots < max(2, len(names)) or any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots must be a prime, no smaller than the number of shards")
    order = [preference(n, slots) for n in names]
    owner, turn = [-1] * slots, [0] * len(names)
    left = slots
    while left:
        for k, (start, step) in enumerate(order):
            while owner[at := (start + turn[k] * step) % slots] >= 0:
                turn[k] += 1
            owner[at] = k
            left -= 1
            if not left:
                break
    return owner


def lookup(spark: SparkSession, shards: int, slots: int) -> DataFrame:
    """slot, shard: the table as rows, from one literal."""
    owners = ",".join(map(str, fill([f"shard-{k}" for k in range(shards)], slots)))
    return spark.range(1).select(F.posexplode(F.split(F.lit(owners), ",")).alias("slot", "_shard")).select("slot", F.col("_shard").cast("int").alias("shard"))


def slot_of(key: str, otherwise: list[str], slots: int) -> Column:
    parts = F.concat_ws("|", F.lit("null"), *(F.col(c).cast("string") for c in otherwise))
    text = F.coalesce(F.col(key).cast("string"), parts)
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long") % slots).cast("int")


def assign_shards(docs: DataFrame, *, key: str = "doc_id", otherwise: list[str] | None = None, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """docs with slot and shard. No shuffle: one broadcast join with slots rows."""
    rest = docs.drop("slot", "shard")
    placed = rest.withColumn("slot", slot_of(key, otherwise or [], slots))
    return placed.join(F.broadcast(lookup(docs.sparkSession, shards, slots)), "slot").select(*rest.columns, "slot", "shard")


#: Fills the table again, turn by turn, on a list.
SQL = f"""
WITH RECURSIVE pref AS (
  SELECT k, ('0x' || substr(md5('shard-' || k), 1, 8))::BIGINT % {SLOTS} AS start,
         ('0x' || substr(md5('shard-' || k), 9, 8))::BIGINT % ({SLOTS} - 1) + 1 AS step
  FROM range({SHARDS}) t(k)
), orders AS (
  SELECT list(list_transform(range({SLOTS}), lambda j: (start + j * step) % {SLOTS}) ORDER BY k) AS o FROM pref
), turns(i, owner) AS (
  SELECT 0, list_transform(range({SLOTS}), lambda j: -1) FROM orders
  UNION ALL
  SELECT i + 1, list_transform(owner, lambda w, nth: CASE WHEN nth - 1 = pick THEN i % {SHARDS} ELSE w END)
  FROM (SELECT i, owner, list_filter(o[i % {SHARDS} + 1], lambda s: owner[s + 1] < 0)[1] AS pick FROM turns, orders WHERE i < {SLOTS})
), filled AS (SELECT unnest(owner) AS shard, unnest(range({SLOTS})) AS slot FROM turns WHERE i = {SLOTS}),
placed AS (
  SELECT doc_id, (('0x' || substr(md5(coalesce(doc_id::VARCHAR, concat_ws('|', 'null', lang, source, n_chars::VARCHAR))), 1, 15))::BIGINT % {SLOTS})::INTEGER AS slot
  FROM documents
)
SELECT doc_id, slot, shard::INTEGER AS shard FROM placed JOIN filled USING (slot)
"""
