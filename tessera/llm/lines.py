"""Line dedup: lines that several documents hold stay in one of them.

Lines are exploded and normalised to keys, and keys hashed to 128 bits; what is shuffled is the hash, never a text. Per
hash the least and the greatest doc_id are found by a partial aggregate, so a line of very many documents sends one row a
task; where these differ, at least two documents hold the line, and for a higher threshold the distinct documents of those
hashes alone are counted. The hashes over the threshold meet the lines again: as a broadcast while their bytes are few, else those
of very many lines as a broadcast, which are few by arithmetic, and the others by a shuffle (join_by_key). What comes back
is the places that a row loses, and its text is reassembled from the places left.

Defined results: null and empty texts are one empty line; a document is a doc_id, so its repeated rows count once and keep or lose
the same lines; rows without a doc_id count as no document, and lose what another one holds often enough; a line that
stands twice in its smallest document stays twice; keys shorter than min_chars are never dropped; texts of any length are read whole; a
text that loses all lines is empty; an empty table gives none; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import LOWER_AZ, UPPER_AZ, Workspace, join_by_key

#: White space that is stripped from a line's ends.
BLANKS = " \t\n\x0b\x0c\r"
#: Bytes of hashes over the threshold that are sent to every task, at KEY_BYTES each.
BROADCAST_BYTES, KEY_BYTES = 16 << 20, 48
HASH = ["h1", "h2"]


def keyed(rows: DataFrame, min_chars: int) -> DataFrame:
    """_row, doc_id, place (from 0) and hash of each line whose key has min_chars code points or more."""
    each = rows.select("_row", "doc_id", F.posexplode(F.split(F.translate("text", UPPER_AZ, LOWER_AZ), "\n")).alias("place", "line"))
    key = each.select("_row", "doc_id", "place", F.btrim("line", F.lit(BLANKS)).alias("key")).where(F.char_length("key") >= min_chars)
    return key.select("_row", "doc_id", "place", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def without(text: Column, places: Column) -> Column:
    """text without its lines at places (from 0)."""
    left = lambda lines: F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), places)
    # over an array of one, so that the text is split once
    return F.transform(F.array(F.split(text, "\n")), lambda lines: F.array_join(F.transform(left(lines), lambda i: F.get(lines, i)), "\n"))[0]


def dedup_lines(docs: DataFrame, *, min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """doc_id, text (what is left), n_lines (before) and n_dropped for each row of docs(doc_id, text)."""
    ws = Workspace(docs.sparkSession, "lines")
    rows = ws.keep(docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")), "rows")
    lines = keyed(rows, min_chars)
    shared = lines.groupBy(*HASH).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    if min_docs >= 2:
        shared = shared.where("first <> last")
    shared = ws.keep(shared.drop("last"), "shared")
    if min_docs > 2:
        several = join_by_key(lines, shared, HASH, "n", rows.count()).groupBy(*HASH, "doc_id").agg(F.min("first").alias("first"), F.count(F.lit(1)).alias("n"))
        counted = several.groupBy(*HASH).agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.count("doc_id").alias("docs"))
        shared = ws.keep(counted.where(F.col("docs") >= min_docs).drop("docs"), "shared")
    keys, held = shared.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    joined = lines.join(F.broadcast(shared.drop("n")), HASH) if keys * KEY_BYTES <= BROADCAST_BYTES else join_by_key(lines, shared, HASH, "n", held)
    lost = joined.where(~F.col("doc_id").eqNullSafe(F.col("first"))).groupBy("_row").agg(F.collect_list("place").alias("places"))
    out = rows.join(lost, "_row", "left")
    left = F.when(F.col("places").isNull(), F.col("text")).otherwise(without(F.col("text"), F.col("places")))
    n_lines = F.char_length("text") - F.char_length(F.translate("text", "\n", "")) + 1
    return out.select("doc_id", left.alias("text"), n_lines.cast("long").alias("n_lines"), F.coalesce(F.size("places"), F.lit(0)).cast("long").alias("n_dropped"))


def digest(deduped: DataFrame) -> DataFrame:
    return deduped.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM d),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
s AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
j AS (SELECT k.*, s.key IS NOT NULL AND k.doc_id IS DISTINCT FROM s.first AS gone FROM k LEFT JOIN s ON k.key = s.key)
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY r
"""
