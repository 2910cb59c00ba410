"""MinHash near-duplicates with sequential Bayesian verification.

A text's set is the hashes of its distinct word shingles. Texts with equal sets are one class, and one row of it goes on
under its number, however often its doc_id or its text is repeated. Signatures of BANDS bands of ROWS minima each put documents in buckets; a pair at the
threshold shares none with probability (1 - t^ROWS)^BANDS, under 1e-5. Candidate pairs are screened on
their signatures, BATCH minima at a time: with m of n equal, the similarity's posterior under a uniform
prior is Beta(m + 1, n - m + 1), and a pair is out once it exceeds the threshold with a probability under
MISS. What survives is compared on the full sets.

No bucket is ever turned into all its pairs. First, the member that shares most buckets is paired with the
others, and pairs that the sets confirm join components. Where a bucket then still holds several components,
the texts outside its largest one are the queries of that component's region, and are compared with all its
texts on full sets, in blocks of both. Before that, the shingles of these texts are counted: what a text shares
with no other bounds its similarity to each exactly, so those that can't reach the threshold are out. So every
pair of a bucket is compared, excluded by its bound, or connected.

Defined results: null and empty texts have no shingles and are linked with nothing; a text of fewer words
than a shingle is one shingle; rows with a null doc_id have their n_shingles, but link nothing and have a null component and
kept, as a component is named by a doc_id; repeated rows are returned as they came, each with the component of its own text,
and texts that share a doc_id are one node of the links; texts of any length are read whole; an empty table gives none;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import LOWER, Workspace, per_document
from tessera.llm.components import roots

BANDS, ROWS, BATCH, MISS = 50, 7, 70, 1e-5
#: Minima that the screening compares. Of each, 8 bits are kept: chance agreement only makes it milder.
SCREENED = BANDS * ROWS
#: Shingles in a block of the last comparison; a longer text is a block's.
BLOCK = 1 << 15
#: Regions whose numbers of blocks, three numbers each, are sent to every task; beyond it the join shuffles.
BROADCAST_REGIONS = 500_000
A, B, C, D = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xFF51AFD7ED558CCD))
RANDOM = np.random.RandomState(20240229)
#: Odd multipliers of the minima and of the rows of a band.
MULTIPLY = RANDOM.randint(0, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
ROW = RANDOM.randint(0, 1 << 63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BAND = np.arange(1, BANDS + 1, dtype=np.uint64) * C


def mix64(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * D
    return x ^ (x >> np.uint64(29))


def shingles(raw: bytes, k: int) -> np.ndarray:
    """Sorted distinct hashes of a text's k-word shingles."""
    words = raw.translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.frombuffer(b"".join(map(xxhash.xxh64_digest, words)), ">u8").astype(np.uint64)
    k, out = min(k, len(h)), np.zeros(max(1, len(h) - k + 1), np.uint64)
    for j in range(k):
        out = out * A + h[j : len(h) - k + 1 + j]
    out = np.sort(mix64(out * A + np.full(1, k, np.uint64) * B))
    return out[np.append(True, out[1:] != out[:-1])]


def minima(s: np.ndarray) -> np.ndarray:
    """One minimum for each hash function, an odd multiple of a hash's upper half."""
    x, out = (s >> np.uint64(32)).astype(np.uint32), np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 128):
        np.minimum(out, (x[at : at + 128, None] * MULTIPLY).min(0), out=out)
    return out


def sketch(raw: bytes, k: int) -> tuple:
    """Size and key of a text's set, its bands and the minima for screening; all but the size null without shingles."""
    s = shingles(raw, k)
    if not len(s):
        return 0, None, None, None
    m = minima(s)
    h = mix64((mix64(m.astype(np.uint64)).reshape(BANDS, ROWS) * ROW).sum(1, dtype=np.uint64) + BAND)
    return len(s), xxhash.xxh128_digest(s.tobytes()), h.view(np.int64).tolist(), m[:SCREENED].astype(np.uint8).tobytes()


def least_equal(threshold: float, miss: float) -> list[int]:
    """For n compared minima, n a multiple of BATCH: the least number of equal ones that isn't out.

    P(similarity >= t) under Beta(m + 1, n - m + 1) is the probability of at most m successes of n + 1.
    """
    out = []
    for n in range(BATCH, SCREENED + 1, BATCH):
        m, below = 0, 0.0
        for m in range(n + 1):
            below += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if below >= miss:
                break
        out.append(m)
    return out


def screen(batches: Iterator[pd.DataFrame], least: list[int]) -> Iterator[pd.DataFrame]:
    for df in batches:
        left, right = (np.frombuffer(b"".join(df[c]), np.uint8).reshape(-1, SCREENED) for c in ("sa", "sb"))
        alive, equal = np.arange(len(df)), np.zeros(len(df), np.int64)
        for i, m in enumerate(least):
            part = slice(i * BATCH, (i + 1) * BATCH)
            equal[alive] += (left[alive, part] == right[alive, part]).sum(1)
            alive = alive[equal[alive] >= m]
        yield df.iloc[alive][["a", "b"]]


def confirmed(ws: Workspace, pairs: DataFrame, sigs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs(a, b) whose full sets are similar enough."""
    both = pairs.join(sigs.select(F.col("doc_id").alias("a"), F.col("sig").alias("sa")), "a").join(sigs.select(F.col("doc_id").alias("b"), F.col("sig").alias("sb")), "b")
    alive = ws.keep(both.select("a", "b", "sa", "sb").mapInPandas(partial(screen, least=least_equal(percent / 100, MISS)), pairs.select("a", "b").schema), "survivors")
    wanted = alive.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    full = ws.keep(per_document(texts.join(wanted, "doc_id", "left_semi"), ["doc_id"], [T.StructField("s", T.ArrayType(T.LongType()))], lambda raw: (shingles(raw, k).view(np.int64).tolist(),)), "sets")
    both = alive.join(full.select(F.col("doc_id").alias("b"), F.col("s").alias("sb")), "b").join(full.select(F.col("doc_id").alias("a"), F.col("s").alias("sa")), "a")
    same = F.size(F.array_intersect("sa", "sb"))
    out = ws.keep(both.where(100 * same >= percent * (F.size("sa") + F.size("sb") - same)).select("a", "b"), "links")
    ws.drop(alive, full)
    return out


def connected(ws: Workspace, sigs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """node, comp of classes that are linked with another one. sigs: doc_id, bands, sig; texts: doc_id, text."""
    rows = sigs.select(F.col("doc_id").alias("member"), F.explode("bands").alias("bucket"))
    sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    active = ws.keep(rows.join(sizes, "bucket"), "shared")
    # who shares buckets with many is likely the text that the others were made from, so it makes the best hub
    weight = ws.keep(active.groupBy("member").agg(F.sum("n").alias("weight")), "weights")
    best = active.join(weight, "member").groupBy("bucket").agg(F.max(F.struct("weight", -F.col("member"))).alias("h")).select("bucket", (-F.col("h.col2")).alias("hub"))
    stars = active.join(best, "bucket").where("member <> hub").select(F.least("hub", "member").alias("a"), F.greatest("hub", "member").alias("b")).distinct()
    links = confirmed(ws, stars, sigs, texts, k, percent)
    comp = roots(ws, links)
    # buckets that still hold several components; a largest one gives the bucket's region its name
    named = ws.keep(active.select("bucket", "member").join(comp.select(F.col("node").alias("member"), "comp"), "member", "left").select("bucket", "member", F.coalesce("comp", "member").alias("comp")), "members")
    parts = named.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("n"))
    open_ = parts.groupBy("bucket").agg(F.max(F.struct("n", "comp")).alias("major"), F.sum("n").alias("n")).where("n > major.n").select("bucket", F.col("major.comp").alias("region"))
    first = ws.keep(named.join(open_, "bucket").select("region", "member", "comp").distinct(), "live")
    sets = shared_shingles(ws, first, texts, k, percent)
    live = ws.keep(first.join(sets.select(F.col("doc_id").alias("member")), "member", "left_semi").select("region", "member", "comp", (F.col("comp") != F.col("region")).alias("asks")), "live")
    ws.drop(first)
    more = ws.keep(across(ws, live, sets, percent), "links")
    grown = more.join(comp.select(F.col("node").alias("a"), F.col("comp").alias("_a")), "a", "left").join(comp.select(F.col("node").alias("b"), F.col("comp").alias("_b")), "b", "left")
    merged = roots(ws, grown.select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b")))
    up = merged.select(F.col("node").alias("comp"), F.col("comp").alias("_up"))
    ws.drop(active, weight, named, live, sets, more)
    return ws.keep(comp.join(up, "comp", "left").select("node", F.coalesce("_up", "comp").alias("comp")).unionByName(merged.join(comp.select("node"), "node", "left_anti")), "components")


def across(ws: Workspace, live: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between components, of each region's asking texts with all its texts, on full sets, in blocks.

    Both sides are dealt by a hash into blocks of about BLOCK shingles; a task gets one block of each side, so a
    region of any size, of short or long texts, is shared out in groups that a worker can hold. Of a text's links to one
    component, one a block is returned.
    """
    sized = live.join(sets.select(F.col("doc_id").alias("member"), F.size("s").alias("_size")), "member")
    total = sized.groupBy("region").agg(F.ceil(F.sum("_size") / BLOCK).cast("int").alias("blocks"), F.ceil(F.sum(F.when(F.col("asks"), F.col("_size"))) / BLOCK).cast("int").alias("asking")).where("asking > 0")
    total = ws.keep(total, "regions")
    # a region with many texts isn't brought together: its row goes to them, while the regions are few enough to be sent
    few = F.broadcast if total.count() <= BROADCAST_REGIONS else lambda df: df
    rows = live.join(few(total), "region").join(sets.select(F.col("doc_id").alias("member"), "s"), "member")
    spread = lambda n: F.pmod(F.xxhash64("member"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    told = rows.select("region", spread("blocks").alias("block"), every("asking").alias("ask"), F.lit(False).alias("asks"), "member", "comp", "s")
    asked = rows.where("asks").select("region", every("blocks").alias("block"), spread("asking").alias("ask"), F.lit(True).alias("asks"), "member", "comp", "s")
    kind = live.schema["member"].dataType.simpleString()
    return told.unionByName(asked).groupBy("region", "block", "ask").applyInPandas(lambda df: compare(df, percent), f"a {kind}, b {kind}")


def compare(df: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Of a group's asking rows and its others: pairs of different components whose sets are similar enough."""
    asks = df["asks"].to_numpy(bool)
    out: list[tuple] = []
    if asks.any() and not asks.all():
        (qi, qc, qs), (mi, mc, ms) = ((g["member"].to_numpy(), g["comp"].to_numpy(), list(g["s"])) for g in (df[asks], df[~asks]))
        size = lambda sets: np.array([len(x) for x in sets])
        row = lambda sets: np.repeat(np.arange(len(sets)), size(sets))
        qh, mh = np.concatenate(qs), np.concatenate(ms)
        shared = np.intersect1d(qh, mh)
        same = np.zeros((len(qs), len(ms)), np.int64)
        where = [(np.searchsorted(shared, h), r) for h, r in ((qh, row(qs)), (mh, row(ms)))]
        hit = [shared[np.minimum(at, len(shared) - 1)] == h if len(shared) else np.zeros(len(h), bool) for (at, _), h in zip(where, (qh, mh), strict=True)]
        for lo in range(0, len(shared), 4096):  # so many shingles at a time: products of two 0/1 matrices, whose sums are exact in a float
            m = []
            for (at, r), ok, n in zip(where, hit, (len(qs), len(ms)), strict=True):
                x, use = np.zeros((n, min(4096, len(shared) - lo)), np.float32), ok & (at >= lo) & (at < lo + 4096)
                x[r[use], at[use] - lo] = 1
                m.append(x)
            same += (m[0] @ m[1].T).astype(np.int64)
        linked = (100 * same >= percent * (size(qs)[:, None] + size(ms)[None] - same)) & (qc[:, None] != mc[None])
        seen = set()
        for i, j in zip(*np.nonzero(linked), strict=True):
            if (i, mc[j]) not in seen:
                seen.add((i, mc[j]))
                out.append((qi[i], mi[j]))
    return pd.DataFrame(out, columns=["a", "b"])


def shared_shingles(ws: Workspace, live: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id and set of the live texts that can be similar enough to another live text.

    A text shares no more with another than the shingles that any other live text has, which bounds its
    similarity exactly. A shingle of one text only is counted for that text, so the hashes are grouped and never joined.
    """
    wanted = live.select(F.col("member").alias("doc_id")).distinct()
    sets = ws.keep(per_document(texts.join(wanted, "doc_id", "left_semi"), ["doc_id"], [T.StructField("s", T.ArrayType(T.LongType()))], lambda raw: (shingles(raw, k).view(np.int64).tolist(),)), "sets")
    once = sets.select("doc_id", F.explode("s").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("doc_id")).where("n = 1").groupBy("doc_id").agg(F.count(F.lit(1)).alias("own"))
    out = ws.keep(sets.join(once, "doc_id", "left").where(100 * (F.size("s") - F.coalesce("own", F.lit(0))) >= percent * F.size("s")).select("doc_id", "s"), "sets")
    ws.drop(sets)
    return out


def near_duplicates(docs: DataFrame, *, shingle: int = 5, percent: int = 80, row: str | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of docs(doc_id, text).

    row: a column of docs, which is a written table then, that tells its rows apart; without one, docs is copied and numbered.
    """
    ws = Workspace(docs.sparkSession, "neardup")
    # whatever is repeated in docs, a class is one numbered row of it from here on
    rows = docs.select(F.col(row).alias("_row"), "doc_id", "text") if row else ws.keep(docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", "text"), "rows")
    fields = [T.StructField("n_shingles", T.LongType()), T.StructField("key", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("sig", T.BinaryType())]
    sets = ws.keep(per_document(rows, ["_row", "doc_id"], fields, partial(sketch, k=shingle)), "sets")
    # a class: equal sets. Copies meet on the map side, so a class of many sends one row a task
    least = sets.where("key IS NOT NULL AND doc_id IS NOT NULL").groupBy("key").agg(F.min(F.struct("doc_id", "_row")).alias("m"))
    classes = ws.keep(least.select("key", F.col("m.doc_id").alias("least"), F.col("m._row").alias("node")), "classes")
    sigs = ws.keep(sets.join(classes.select(F.col("node").alias("_row")), "_row", "left_semi").select(F.col("_row").alias("doc_id"), "bands", "sig"), "signatures")
    comp = connected(ws, sigs, rows.select(F.col("_row").alias("doc_id"), "text"), shingle, percent)
    named = ws.keep(classes.join(comp, "node", "left").select("key", "least", F.coalesce("comp", "node").alias("comp")), "named")
    ws.drop(sigs, classes)
    # different texts under one doc_id are one document: their components are one
    shared = named.groupBy("least").agg(F.min("comp").alias("a"), F.max("comp").alias("last")).where("a <> last")
    same = roots(ws, named.select("least", F.col("comp").alias("b")).join(shared.select("least", "a"), "least").where("a <> b").select("a", "b"))
    merged = named.join(same.select(F.col("node").alias("comp"), F.col("comp").alias("_up")), "comp", "left").select("key", "least", F.coalesce("_up", "comp").alias("comp"))
    component = merged.groupBy("comp").agg(F.min("least").alias("component_id"))
    by_key = ws.keep(merged.join(component, "comp").select("key", "component_id"), "components")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    out = sets.join(by_key, "key", "left").select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def _oracle(k: int, percent: int) -> str:
    return f"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i + 1 : i + {k}], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(greatest(len(ws) - {k} + 1, 1))) AS i FROM d WHERE len(ws) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= {percent} * (x.n + y.n - c)),
reach(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d LEFT JOIN n ON d.doc_id IS NOT DISTINCT FROM n.doc_id LEFT JOIN c ON d.doc_id = c.doc_id
"""


SQL = _oracle(4, 80)
