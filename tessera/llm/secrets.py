"""Secret scans with a ledger of blobs.

Every text, of whatever version of whatever document, is addressed by its SHA-256. The ledger has a
row for each pair of blob and rule version that was ever scanned, with the findings. A scan reads the
ledger, takes the distinct blobs whose pair is missing, runs the rules on one text of each, adds the
rows, and joins the findings back to all paths whose text is that blob. A second scan over unchanged
documents scans nothing; new rules get a new version and scan everything once.

Texts hardly move. Which blobs are unseen is found on addresses alone; a bitmap of their hashes, of fixed size, tells the tasks which texts may
be unseen, and these are first asked, where they lie, whether any rule matches at all. Copies within one delivery are each asked that, and
so are the few seen texts whose hash falls on a set bit (all, once there are many more unseen blobs than bits); only texts with
a match are shuffled, and of those the unseen ones are scanned, once each.

Spans are in code points, end exclusive. Where a rule's expression matches, the text between matches
comes from a split by the same expression, so positions are running sums of lengths, over rows and not inside one.

Defined results: a null text is the empty blob and has no spans; repeated rows, and rows that share a
path, each get the findings of their own text; a null path stays null; texts of any length are scanned whole; spans that
start together go by the rules' order; an empty table leaves the ledger as it is; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import Workspace

#: Kind, expression, group whose length counts, its least length. The first three are fixed by contract
#: (for access and hex, the least length is in the expression, which finds the same runs).
RULES = [
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
    ("private_key", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----", 0, 1),
    ("code_host", r"(?:ghp|gho|ghu|ghs|ghr|glpat)[_-][A-Za-z0-9_-]{20,}", 0, 1),
    ("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1),
    ("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1),
    ("url_login", r"[a-z][a-z0-9+.-]{1,20}://[^\s/:@]{1,64}:[^\s/:@]{1,64}@", 0, 1),
    ("payment_key", r"[sr]k_(?:live|test)_[A-Za-z0-9]{16,}", 0, 1),
    ("hex_upper", r"[0-9A-F]{32,}", 0, 32),
]
BASE = 3
#: Buckets of the bitmap of unseen addresses, of BITS bits each: what is sent to the tasks is 16 MB at most, whatever the ledger and the delivery hold.
BUCKETS, BITS = 4096, 32768
SPAN = "array<struct<at:int,k:int,end:int>>"


def version(rules: list[tuple[str, str, int, int]]) -> str:
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


def lengths(text: Column, k: int, rule: tuple[str, str, int, int]) -> Column:
    """Of each place where rule number k matches, in turn: the lengths of the text before it (since the last one), of the match, and of what is judged."""
    _, pattern, group, _ = rule
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    each = F.transform(found, lambda m, i: F.struct(F.lit(k).alias("k"), i.alias("i"), F.lit(0).alias("gap"), F.length(m).alias("size"), F.length(F.regexp_extract(m, pattern, group) if group else m).alias("judged")))
    zipped = F.zip_with(each, F.slice(gaps, F.lit(1), F.size(each)), lambda x, g: F.struct(x["k"].alias("k"), x["i"].alias("i"), F.length(g).alias("gap"), x["size"].alias("size"), x["judged"].alias("judged")))
    return F.when(text.rlike(pattern), zipped)


def matched(text: Column, rules: list[tuple[str, str, int, int]]) -> Column:
    some = F.lit(False)
    for r in rules:
        some = some | text.rlike(r[1])
    return some


def among(rows: DataFrame, blobs: DataFrame) -> DataFrame:
    """The rows whose blob is one of blobs, and some others: as many as the bitmap of their hashes has bits set. No shuffle of rows."""
    at = F.pmod(F.xxhash64("blob"), F.lit(BUCKETS * BITS)) + 1
    place = {"_bucket": F.bitmap_bucket_number(at), "_bit": F.bitmap_bit_position(at)}
    # hashes are dealt by bucket before they are set, so that no task makes all buckets
    bits = blobs.select(*(c.alias(n) for n, c in place.items())).repartition("_bucket").groupBy("_bucket").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    byte = F.conv(F.hex(F.substring("_bits", (F.col("_bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = F.getbit(byte, (F.col("_bit") % 8).cast("int")) == 1
    return rows.withColumns(place).join(F.broadcast(bits), "_bucket").where(is_set).select(*rows.columns)


def to_scan(rows: DataFrame, rules: list[tuple[str, str, int, int]]) -> DataFrame:
    """blob, text: one row of each blob, its text null if no rule matches.

    Copies meet on the map side first, so a blob with many of them sends one row a task. The match is a value and no filter, as
    Spark would put a filter before the join that says which texts may be unseen.
    """
    text = F.when(matched(F.col("text"), rules), F.col("text")).alias("text")
    return rows.select("blob", text).groupBy("blob").agg(F.first("text").alias("text"))


def findings(blobs: DataFrame, rules: list[tuple[str, str, int, int]]) -> DataFrame:
    """blob, spans: of every rule, by start and then rule.

    Only lengths are shuffled, of blobs that have matches; places are their running sums.
    """
    none = F.array().cast("array<struct<k:int,i:int,gap:int,size:int,judged:int>>")
    every = F.concat(*(F.coalesce(lengths(F.col("text"), k, r).cast("array<struct<k:int,i:int,gap:int,size:int,judged:int>>"), none) for k, r in enumerate(rules)))
    each = blobs.select("blob", F.inline_outer(every))
    least = F.element_at(F.array(*(F.lit(r[3]) for r in rules)), F.col("k") + 1)
    before = Window.partitionBy("blob", "k").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    at = F.col("gap") + F.coalesce(F.sum(F.col("gap") + F.col("size")).over(before), F.lit(0))
    placed = each.select("blob", "k", "judged", "size", at.cast("int").alias("at"))
    span = F.when(F.col("judged") >= least, F.struct("at", "k", (F.col("at") + F.col("size")).alias("end")))
    return placed.groupBy("blob").agg(F.array_sort(F.collect_list(span)).cast(SPAN).alias("spans"))


def joined(which: Column, rules: list[tuple[str, str, int, int]]) -> Column:
    kinds = F.array(*(F.lit(r[0]) for r in rules))
    return F.array_join(F.transform(which, lambda s: F.concat_ws(":", F.element_at(kinds, s["k"] + 1), s["at"].cast("string"), s["end"].cast("string"))), ",")


def scan_versions(versions: DataFrame, *, path: str = "doc_id", ledger: str | None = None, rules: list[tuple[str, str, int, int]] = RULES) -> DataFrame:
    """path, blob and spans for each row of versions(path, text).

    ledger is the folder of the ledger, in a place that all executors share; without it, the run has
    one of its own and every blob is unseen.
    """
    spark, this = versions.sparkSession, version(rules)
    ws = Workspace(spark, "secrets")
    ledger = ledger or f"{ws.top}/ledger"
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = versions.select(F.col(path), text.alias("text")).withColumn("blob", F.sha2(F.col("text").cast("binary"), 256))
    schema = f"blob string, rules string, spans {SPAN}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(ledger)
    there = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    if there:
        known = spark.read.schema(schema).parquet(ledger).where(F.col("rules") == this).select("blob")
        unseen = ws.keep(rows.select("blob").distinct().join(known, "blob", "left_anti"), "unseen")
        one = unseen.join(to_scan(among(rows, unseen), rules), "blob", "left")
    else:
        one = to_scan(rows, rules)
    findings(one, rules).select("blob", F.lit(this).alias("rules"), "spans").write.mode("append").parquet(ledger)
    known = spark.read.schema(schema).parquet(ledger).where((F.col("rules") == this) & (F.size("spans") > 0)).groupBy("blob").agg(F.first("spans").alias("spans")) if there else spark.read.schema(schema).parquet(ledger).where((F.col("rules") == this) & (F.size("spans") > 0)).select("blob", "spans")
    return rows.select(path, "blob").join(known, "blob", "left").select(path, "blob", F.coalesce("spans", F.array().cast(SPAN)).alias("spans"))


def digest(found: DataFrame, path: str = "doc_id", rules: list[tuple[str, str, int, int]] = RULES) -> DataFrame:
    base = F.filter("spans", lambda s: s["k"] < BASE)
    counts = [F.size(F.filter(F.col("spans")["k"], F.lit(k).eqNullSafe)).cast("long").alias(f"n_{rules[k][0]}") for k in range(BASE)]
    return found.select(path, *counts, F.sha2(joined(base, rules).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans"), rules).alias("spans"))


def _oracle() -> str:
    def one(k: int, rule: tuple[str, str, int, int]) -> str:
        kind, pattern, group, least = rule
        p = pattern.replace("'", "''").replace("(?i:(password|passwd|secret|token|api_?key))", "((?i:password|passwd|secret|token|api_?key))").replace(r"\s", r" \t\n\r\x0B\f")
        return f"""
SELECT r, {k} AS k, '{kind}' AS kind, a AS pos, a + length(m) AS e FROM (
  SELECT r, m, j, length(g) + coalesce(sum(length(g) + length(m)) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM (
    SELECT r, generate_subscripts(ms, 1) AS i, unnest(ms) AS m, unnest(js) AS j, unnest(gs[1:len(ms)]) AS g FROM (
      SELECT r, regexp_extract_all(t, '{p}') AS ms, regexp_extract_all(t, '{p}', {group}) AS js, string_split_regex(t, '{p}') AS gs FROM d WHERE regexp_matches(t, '{p}')))) WHERE length(j) >= {least}"""

    every = " UNION ALL ".join(one(k, r) for k, r in enumerate(RULES))
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents), s AS ({every}),
totals AS (SELECT r, {', '.join(f"count(*) FILTER (k = {k}) AS n_{RULES[k][0]}" for k in range(BASE))},
  string_agg(kind || ':' || pos || ':' || e, ',' ORDER BY pos, k) FILTER (k < {BASE}) AS base, string_agg(kind || ':' || pos || ':' || e, ',' ORDER BY pos, k) AS spans FROM s GROUP BY r)
SELECT doc_id, {', '.join(f"coalesce(n_{RULES[k][0]}, 0) AS n_{RULES[k][0]}" for k in range(BASE))}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN totals USING (r)
"""


SQL = _oracle()
