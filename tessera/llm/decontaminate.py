"""Benchmark decontamination by a prefix-filtered set join.

An item is cut into windows of consecutive words, and each window is a set of word shingles with their
offsets. A document holds a window only if it holds every shingle of it, so under full containment the
necessary prefix of a window is one shingle: its rarest. Shingles of the benchmark are counted over all
documents to order them; the documents' shingles are then joined with the windows' rarest ones only, the
offset gives the one place where the window could stand, the lengths must allow it, and the words there
are compared with the window's.

The words of a document travel beside its exploded shingles but are only read where the join matched, as
both run in one stage. The windows' bytes are counted: up to BROADCAST_BYTES they are broadcast; beyond
that the joins shuffle, on rows without words, and the words are fetched for candidates alone. Which items a window is of
is a table of its own, however many share it: it is joined once for each set of windows that some documents hold, not for
each hit; the sets are then sent to the documents that hold them, or, if their bytes are too many, joined with salt.

Defined results: null and empty texts have no words, hit nothing, and as items have no windows; items with
fewer words than a window are one window; equal windows of several items count for each of them; the windows of an item
whose item_id is null hit, but it can't be named in items; repeated rows of documents are judged one by one; texts of any
length are read whole; shingles equally rare go by their place in the window; an empty table of documents gives none, one of
items no hits; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import LOWER_AZ, UPPER_AZ, Workspace

WINDOW, SHINGLE = 10, 3
#: Bytes of windows, as estimated, that are sent to every task.
BROADCAST_BYTES = 64 << 20
#: Tasks that share the documents of one set of windows, where the sets are too many to be sent.
SALTS = 32
NOT_A_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: str) -> Column:
    return F.array_remove(F.split(F.coalesce(F.col(text).cast("string"), F.lit("")), NOT_A_WORD), "")


def lower_az(x: Column) -> Column:
    return F.translate(x, UPPER_AZ, LOWER_AZ)


def word_hashes(words: str) -> Column:
    """By lower(), which joins no fewer words than lower-casing A-Z; the comparison at the end is exact."""
    return F.transform(words, lambda w: F.xxhash64(F.lower(w)))


def shingle_at(h: str, i: Column, k: int) -> Column:
    """Hash of the k words from place i on; beyond the end, of fewer, which no comparison confirms."""
    return F.xxhash64(F.lit(k), *(F.get(h, i + j) for j in range(k)))


def windows_of(bench: DataFrame, window: int, shingle: int) -> DataFrame:
    """A row for each item and window of it: item, id (of the window), w (lower-cased words), size, k (words in a shingle)."""
    items = bench.select(F.col("item_id").cast("string").alias("item"), F.transform(words_of("text"), lower_az).alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - window, F.lit(0)))
    each = items.select("item", F.explode(F.transform(starts, lambda s: F.slice("words", s + 1, window))).alias("w"))
    named = each.select("item", F.sha2(F.array_join("w", " ").cast("binary"), 256).alias("id"), "w", F.size("w").alias("size"))
    return named.withColumn("k", F.least(F.col("size"), F.lit(shingle)))


def exploded(docs: DataFrame, keep: list[str], ks: list[int], mark: int | None = None) -> DataFrame:
    """keep, words, n, and a row for each shingle: at, hash; with mark, also a row of that hash for each document."""
    blocks = [_block(k) for k in ks] + ([F.array(F.lit(mark).cast("long"))] if mark is not None else [])
    df = docs.select(*keep, words_of("text").alias("words")).select(*keep, "words", F.size("words").alias("n"), word_hashes("words").alias("_h"))
    return df.select(*keep, "words", "n", F.posexplode(F.concat(*blocks)).alias("at", "hash"))


def _block(k: int) -> Column:
    return F.transform("_h", lambda x, i: shingle_at("_h", i, k))


def place(ks: list[int]) -> Column:
    """Where a window would start whose shingle of k words, off words from its start, is the one at."""
    block = sum((F.when(F.col("k") == k, F.lit(b)).otherwise(F.lit(0)) for b, k in enumerate(ks)), F.lit(0))
    return F.col("at") - block * F.col("n") - F.col("off")


def verified(df: DataFrame) -> Column:
    inside = (F.col("start") >= 0) & (F.col("start") + F.col("size") <= F.col("n"))
    return inside & (F.transform(F.slice("words", F.when(inside, F.col("start")).otherwise(F.lit(0)) + 1, F.col("size")), lower_az) == F.col("w"))


def find_leaks(docs: DataFrame, bench: DataFrame, *, keep: list[str] | None = None, window: int = WINDOW, shingle: int = SHINGLE, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """keep, n_words, places (start, size) and items (sorted) for each row of docs(text)."""
    ws = Workspace(docs.sparkSession, "leaks")
    keep = keep or ["doc_id"]
    cut = ws.keep(windows_of(bench, window, shingle), "items")
    windows = ws.keep(cut.drop("item").dropDuplicates(["id"]), "windows")
    size = F.sum(F.octet_length(F.array_join("w", " ")) + F.lit(200) + 16 * F.col("size"))
    found = windows.agg(F.coalesce(size, F.lit(0)).alias("bytes"), F.sort_array(F.collect_set("k"), asc=False).alias("ks")).first()
    ks, small = found.ks, found.bytes <= broadcast_bytes
    if not ks:
        none = docs.select(*keep, F.size(words_of("text")).cast("long").alias("n_words"))
        return none.withColumn("places", F.array().cast("array<struct<start:int,size:int>>")).withColumn("items", F.array().cast("array<string>"))
    few = F.broadcast if small else lambda df: df
    docs = docs.withColumn("_row", F.monotonically_increasing_id()) if small else ws.keep(docs.select(*dict.fromkeys([*keep, "text"])).withColumn("_row", F.monotonically_increasing_id()), "documents")
    keep = ["_row", *keep]
    mark = 0
    shingles = windows.withColumn("_h", word_hashes("w")).select("*", F.explode(F.sequence(F.lit(0), F.col("size") - F.col("k"))).alias("off"))
    hashed = sum((F.when(F.col("k") == k, shingle_at("_h", F.col("off"), k)).otherwise(F.lit(0).cast("long")) for k in ks), F.lit(0).cast("long"))
    shingles = ws.keep(shingles.select("id", "size", "k", "off", hashed.alias("hash")), "shingles")
    # order: how often each shingle of the benchmark occurs in all documents
    counts = ws.keep(exploded(docs, [], ks).join(few(shingles.select("hash").distinct()), "hash").groupBy("hash").agg(F.count(F.lit(1)).alias("seen")), "counts")
    # the rarest shingle of each window; windows with one that no document has are out
    ranked = shingles.join(few(counts), "hash", "left").groupBy("id", "size", "k").agg(F.min(F.struct(F.coalesce("seen", F.lit(0)), "off", "hash")).alias("least"))
    prefix = ranked.where(F.col("least.col1") > 0).select("id", "size", "k", F.col("least.off").alias("off"), F.col("least.hash").alias("hash"))
    prefix = ws.keep(prefix.join(windows.select("id", "w"), "id"), "prefix")
    ws.drop(windows, shingles, counts)
    if small:
        # mark's row brings every document through the join once, so that no second pass counts its words
        one = docs.sparkSession.sql(f"SELECT '' AS id, 0 AS size, 0 AS k, 0 AS off, CAST({mark} AS BIGINT) AS hash, CAST(array() AS array<string>) AS w")
        pairs = exploded(docs, keep, ks, mark).join(F.broadcast(prefix.unionByName(one)), "hash").withColumn("start", place(ks))
        pairs = pairs.where((F.col("size") == 0) | verified(pairs)).select(*keep, "n", "start", "size", "id")
    else:
        lean = exploded(docs, keep, ks).drop("words").join(prefix, "hash").withColumn("start", place(ks)).where("start >= 0 AND start + size <= n").select("_row", "start", "size", "w", "id")
        read = docs.select(*keep, words_of("text").alias("words")).withColumn("n", F.size("words"))
        hits = lean.join(read, "_row")
        hits = hits.where(verified(hits)).select(*keep, "n", "start", "size", "id")
        rest = read.select(*keep, "n", F.lit(0).alias("start"), F.lit(0).alias("size"), F.lit("").alias("id"))
        pairs = hits.unionByName(rest)
    hit = F.col("size") > 0
    by = pairs.groupBy(*keep).agg(F.max("n").cast("long").alias("n_words"), F.collect_set(F.when(hit, F.struct("start", "size"))).alias("places"), F.array_sort(F.collect_set(F.when(hit, F.col("id")))).alias("_ids"))
    by = ws.keep(by, "hits")
    # items of each set of windows, made once however many documents hold that set; documents without hits join nothing
    hits, none = by.where(F.size("_ids") > 0), F.array().cast("array<string>")
    items = hits.select("_ids").distinct().select("_ids", F.explode("_ids").alias("id")).join(cut.select("id", "item"), "id").groupBy("_ids").agg(F.array_sort(F.collect_set("item")).alias("items"))
    items = ws.keep(items, "sets")
    size = F.sum(sum((F.octet_length(F.array_join(c, " ")) + 16 * F.size(c) for c in ("_ids", "items")), F.lit(200)))
    if (items.agg(size).first()[0] or 0) <= broadcast_bytes:
        named = hits.join(F.broadcast(items), "_ids", "left")
    else:  # a set that many documents hold is dealt over SALTS tasks
        salted = hits.withColumn("_salt", F.pmod(F.xxhash64("_row"), F.lit(SALTS)))
        named = salted.join(items.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), ["_ids", "_salt"], "left")
    out = [*keep[1:], "n_words", "places"]
    return named.select(*out, F.coalesce("items", none).alias("items")).unionByName(by.where(F.size("_ids") == 0).select(*out, none.alias("items")))


def digest(leaks: DataFrame, keep: list[str] | None = None) -> DataFrame:
    n_hit = F.size(F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p["start"], p["start"] + p["size"] - 1))))).cast("long")
    return leaks.select(*(keep or ["doc_id"]), "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("places") > 0).alias("contaminated"))


_CLASS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER_AZ}', '{LOWER_AZ}'), '{_CLASS}') AS ws FROM documents),
b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), '{UPPER_AZ}', '{LOWER_AZ}'), '{_CLASS}') AS ws FROM benchmark),
win AS (SELECT DISTINCT item, size, array_to_string(ws[s + 1 : s + size], ' ') AS w FROM (
  SELECT item, ws, least(len(ws), {WINDOW}) AS size, unnest(range(greatest(len(ws) - {WINDOW}, 0) + 1)) AS s FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT size FROM win),
grams AS (SELECT r, size, s, array_to_string(ws[s + 1 : s + size], ' ') AS w FROM (
  SELECT r, ws, size, unnest(range(len(ws) - size + 1)) AS s FROM d, sizes WHERE len(ws) >= size)),
hits AS (SELECT r, item, s, size FROM grams JOIN win USING (size, w)),
words AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(s, s + size)) AS p FROM (SELECT DISTINCT r, s, size FROM hits)) GROUP BY r),
items AS (SELECT r, count(*) AS n, sha256(string_agg(item, ',' ORDER BY item)) AS h FROM (SELECT DISTINCT r, item FROM hits WHERE item IS NOT NULL) GROUP BY r)
SELECT doc_id, len(ws) AS n_words, coalesce(words.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items, coalesce(h, sha256('')) AS items_sha256, words.n IS NOT NULL AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""
