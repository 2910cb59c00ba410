"""Spelling variants by a symmetric-delete join.

Every word emits a 64-bit key of itself and of each distinct word that a single deletion makes of it. Keys are rolling hashes, so a
word of L letters costs L steps and not L * L, and rows of the join are a key and a word's number, never the word. Two words at
distance one always share a key: the shorter one, or what is left of both without the letter that differs. Words that share a
key are joined by it, and each such pair is verified on the words themselves. A key's words are itself and those with one letter more,
so their number is bounded by the alphabet and the word's length, however large the corpus is. The near words are
aggregated to counts and to the most frequent one, which is the word's form if it is FACTOR times as frequent; forms are followed to
their ends by joins that double their reach, so no more than a few rounds are needed, as each form is FACTOR times as frequent.

Defined results: null and empty texts have no words; runs of a row without a doc_id are misspelt by the hash of an empty id; repeated rows
count each; of near words as frequent the least in code-point order is the form; letters of any length are one run, and texts are read
whole; a word without near words has n_near 0, no form, and itself as root; an empty table gives none; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import LOWER_AZ, UPPER_AZ, Workspace
from tessera.llm.ppm import ODD, Powers, mixed

#: Letters that a run is made of.
LETTERS = "A-Za-zÀ-ÿ"
FACTOR, MIN_CHARS, MIN_COUNT = 10, 7, 2
BACK = np.uint64(pow(ODD, -1, 1 << 64))


def count_words(docs: DataFrame, *, misspell: int = 0, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT) -> DataFrame:
    """word, n: maximal runs of letters in docs(doc_id, text), A-Z lower-cased, of min_chars code points and min_count occurrences or more.

    misspell: where it divides the crc32 of doc_id:run, the run loses the code point whose number is that crc32 modulo its length.
    """
    # a run that is shorter stays so; as the leftmost match begins where a run does, the pattern finds whole runs
    found = F.regexp_extract_all(F.translate(F.col("text").cast("string"), UPPER_AZ, LOWER_AZ), F.lit(f"[{LETTERS}]{{{min_chars},}}"), F.lit(0))
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(found).alias("run"))
    if misspell:
        runs = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
        at = (F.col("h") % F.char_length("run")).cast("int")
        runs = runs.select(F.when(F.col("h") % misspell == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))).otherwise(F.col("run")).alias("run"))
    return runs.groupBy(F.col("run").alias("word")).agg(F.count(F.lit(1)).alias("n")).where((F.char_length("word") >= min_chars) & (F.col("n") >= min_count))


def keys_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the words and of their distinct single deletions, and the number of the word that each is of."""
    size = np.array([len(w) for w in words], np.int64)
    end = np.cumsum(size)
    start = end - size
    c = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    of = np.repeat(np.arange(len(words)), size)
    up, down = Powers().of(len(c) + 1)
    so_far = np.zeros(len(c) + 1, np.uint64)
    np.cumsum(mixed(c + np.uint64(1)) * up[: len(c)], out=so_far[1:])
    whole = (so_far[end] - so_far[start]) * down[start]
    # without the letter at g: what is before it, and what is after it, one place nearer
    g = np.flatnonzero(np.append(True, c[1:] != c[:-1])[: len(c)] | (np.arange(len(c)) == start[of])) if len(c) else np.zeros(0, np.int64)
    w = of[g]
    less = (so_far[g] - so_far[start[w]] + (so_far[end[w]] - so_far[g + 1]) * BACK) * down[start[w]]
    return mixed(np.concatenate([whole, less])).view(np.int64), np.concatenate([np.arange(len(words)), w])


def emitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            keys, of = keys_of(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(keys), b.column(0).take(pa.array(of))], names=["key", "id"])


def near_words(ws: Workspace, words: DataFrame) -> DataFrame:
    """a, b and their counts and texts (n_a, word_a, ...): the pairs of words(id, word, n) at distance exactly one, each once, a < b by id."""
    keys = ws.keep(words.select("id", "word").mapInArrow(emitted, "key long, id long"), "keys")
    pairs = ws.keep(keys.select("key", F.col("id").alias("a")).join(keys.select("key", F.col("id").alias("b")), "key").where("a < b").select("a", "b").distinct(), "pairs")
    named = lambda x: words.select(F.col("id").alias(x), F.col("word").alias(f"word_{x}"), F.col("n").alias(f"n_{x}"))
    return pairs.join(named("a"), "a").join(named("b"), "b").where(F.levenshtein("word_a", "word_b", 1) == 1)


def roots(ws: Workspace, forms: DataFrame) -> DataFrame:
    """word, root: the end of each word's forms(word, form)."""
    found = ws.keep(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    while not found.where("moved").isEmpty():
        up = found.select(F.col("word").alias("root"), F.col("root").alias("_up"))
        further = ws.keep(found.join(up, "root", "left").select("word", F.coalesce("_up", "root").alias("root"), F.col("_up").isNotNull().alias("moved")), "roots")
        ws.drop(found)
        found = further
    return found.drop("moved")


def group_variants(words: DataFrame, *, factor: int = FACTOR) -> DataFrame:
    """word, form, root, n, n_near and form_n for each row of words(word, n), whose words are distinct."""
    ws = Workspace(words.sparkSession, "variants")
    words = ws.keep(words.select(F.monotonically_increasing_id().alias("id"), "word", "n"), "words")
    near = ws.keep(near_words(ws, words), "near")
    both = near.select(F.col("a").alias("id"), F.col("word_b").alias("form"), F.col("n_b").alias("form_n")).unionByName(near.select(F.col("b").alias("id"), F.col("word_a").alias("form"), F.col("n_a").alias("form_n")))
    best = both.groupBy("id").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("less"), "form")).alias("best"))
    enough = -F.col("best.less") >= factor * F.col("n")
    told = words.join(best, "id", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("best.form")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n"))
    told = ws.keep(told, "forms")
    ws.drop(words, near)
    ends = roots(ws, told.where("form IS NOT NULL"))
    return told.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: crc32 of a list of bytes in DuckDB, which has none; tab: the usual table of 256 numbers, made in CRC_TABLE.
CRC_TABLE = "SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_concat([i::BIGINT], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))"


def crc_sql(byte_list: str) -> str:
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {byte_list}), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)"


SQL = rf"""
WITH RECURSIVE crc AS ({CRC_TABLE}),
r AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(translate(text, '{UPPER_AZ}', '{LOWER_AZ}'), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents),
o AS (SELECT id, run, count(*) AS k FROM r WHERE length(run) >= 7 GROUP BY id, run),
h AS (SELECT run, k, {crc_sql("flatten(list_transform(string_split(id || ':' || run, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [195::BIGINT, unicode(x)::BIGINT - 64] END))")} AS h FROM o, crc),
m AS (SELECT CASE WHEN h % 31 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, k FROM h),
w AS (SELECT word, sum(k)::BIGINT AS n FROM m WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
i AS (SELECT word, n, unnest(range(length(word))) AS i FROM w),
c AS (SELECT word, n, left(word, i::INT) || substr(word, i::INT + 2) AS less, left(word, i::INT) || '_' || substr(word, i::INT + 2) AS open FROM i),
near AS (SELECT a.word, b.word AS form, b.n FROM c a JOIN c b ON a.open = b.open AND a.word <> b.word
  UNION SELECT c.word, w.word, w.n FROM c JOIN w ON c.less = w.word UNION SELECT w.word, c.word, c.n FROM c JOIN w ON c.less = w.word),
best AS (SELECT word, count(*) AS n_near, first(form ORDER BY n DESC, encode(form)) AS form, max(n) AS form_n FROM near GROUP BY word),
f AS (SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN form_n >= 10 * w.n THEN form END AS form, CASE WHEN form_n >= 10 * w.n THEN form_n END AS form_n FROM w LEFT JOIN best USING (word)),
up(word, top) AS (SELECT word, word FROM f UNION ALL SELECT up.word, f.form FROM up JOIN f ON up.top = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, up.top AS root, f.n, f.n_near, f.form_n FROM f JOIN up ON up.word = f.word JOIN f e ON e.word = up.top WHERE e.form IS NULL
"""
