"""Quality classifier: regularised quadratic discriminant analysis of document statistics.

Each document becomes a short vector of transformed statistics. One aggregation over the labelled
rows gives each class's count, sums and products, from which the driver makes means and covariances
(a fixed few hundred numbers, whatever the input). A class's covariance is shrunk towards the pooled
one and that towards its diagonal. The score is the logistic of the difference of the two classes'
log densities, from Mahalanobis distances by Cholesky factors that are made once and sent with the
scoring tasks.

Defined results: null and empty texts have the vector of an empty text and are scored like others;
rows without a doc_id can't be labelled, are scored, and count as not held out; a label that is null
or neither 0 nor 1 is ignored, as are repeated labels of a document that contradict each other; with
a class that has no labelled row, every score is the share of label 1 (0.5 without any label); texts of any length are read whole;
repeated rows get equal scores; a score at the threshold is predicted as 1; an empty table gives none; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import CONTINUATION, SPACES, Workspace, per_document, remainder
from tessera.llm.repetition import SYMBOLS, UPPER

NAMES = ["words", "word_length", "distinct", "top_word", "symbols", "capitals", "marks", "digits", "dup_lines", "line_words", "packed", "end_marks"]
D = len(NAMES)
ENDS, MARKS = b".!?", bytes(c for c in range(33, 127) if not chr(c).isalnum())
ALL = bytes(range(256))


def share(part: float, whole: float) -> float:
    """A share, on a scale that spreads both ends: the arc sine of its root."""
    return math.asin(math.sqrt(min(1.0, max(0.0, part / whole)))) if whole > 0 else 0.0


def vector(raw: bytes) -> tuple:
    words = raw.split()
    n = len(words)
    solid = raw.translate(None, SPACES)
    size = len(solid)
    chars = len(solid.translate(None, CONTINUATION))
    distinct: dict[bytes, int] = {}
    for w in words:
        distinct[w] = distinct.get(w, 0) + 1
    lines = [x for x in raw.split(b"\n") if x.strip(SPACES)]
    without = lambda which: size - len(solid.translate(None, which))
    packed = len(zlib.compress(raw, 1)) / (len(raw) + 40) if raw else 0.0
    return ([
        math.log1p(n), math.log1p(chars / n if n else 0.0), len(distinct) / n ** 0.9 if n else 0.0, share(max(distinct.values(), default=0), n),
        share(without(SYMBOLS), size), share(without(UPPER), size), share(without(MARKS), size), share(without(b"0123456789"), size),
        share(len(lines) - len(set(lines)), len(lines)), math.log1p(n / len(lines) if lines else 0.0), packed, share(without(ENDS), n),
    ],)


def moments(labelled: DataFrame) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """By class: rows, sums and products of x. One aggregation; its result has a fixed size."""
    x = [F.col("x")[i] for i in range(D)]
    pairs = [(i, j) for i in range(D) for j in range(i, D)]
    rows = labelled.groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.array(*(F.sum(v) for v in x)).alias("s"), F.array(*(F.sum(x[i] * x[j]) for i, j in pairs)).alias("p")).collect()
    out = {}
    for r in rows:
        p = np.zeros((D, D))
        for (i, j), v in zip(pairs, r.p, strict=True):
            p[i, j] = p[j, i] = v
        out[r.y] = (r.n, np.array(r.s), p)
    return out


def fit(by: dict[int, tuple[int, np.ndarray, np.ndarray]], to_pooled: float, to_diagonal: float) -> dict:
    """Mean, inverse Cholesky factor and log-determinant of each class, and log prior odds."""
    n = sum(v[0] for v in by.values())
    if len(by) < 2:
        return {"constant": (by[1][0] / n if 1 in by else 0.0) if n else 0.5}
    mean = {y: s / m for y, (m, s, _) in by.items()}
    cov = {y: p / m - np.outer(mean[y], mean[y]) for y, (m, _, p) in by.items()}
    pooled = sum(by[y][0] * cov[y] for y in by) / n
    floor = np.diag(1e-4 + 1e-3 * np.diag(pooled))
    model = {"odds": math.log(by[1][0] / by[0][0])}
    for y in by:
        c = (1 - to_pooled) * cov[y] + to_pooled * pooled
        c = (1 - to_diagonal) * c + to_diagonal * np.diag(np.diag(c)) + floor
        low = np.linalg.cholesky(c)
        model[y] = (mean[y], np.linalg.inv(low), 2 * float(np.log(np.diag(low)).sum()))
    return model


def scores(x: np.ndarray, model: dict) -> np.ndarray:
    if "constant" in model:
        return np.full(len(x), model["constant"])
    log = {}
    for y in (0, 1):
        mean, inverse, logdet = model[y]
        z = (x - mean) @ inverse.T
        log[y] = -0.5 * ((z * z).sum(1) + logdet)
    return 1 / (1 + np.exp(-np.clip(log[1] - log[0] + model["odds"], -500, 500)))


def classify_quality(docs: DataFrame, labels: DataFrame, *, label: str = "quality", folds: int = 4, fold: int = 2, threshold: float = 0.7, to_pooled: float = 0.05, to_diagonal: float = 0.05) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of docs(doc_id, text); labels(doc_id, label).

    Rows whose crc32(doc_id) mod folds is fold are held out: their labels are never read.
    """
    ws = Workspace(docs.sparkSession, "quality")
    x = ws.keep(per_document(docs, ["doc_id"], [T.StructField("x", T.ArrayType(T.DoubleType()))], vector).withColumn("held_out", remainder("doc_id", folds) == fold), "vectors")
    y = labels.select("doc_id", F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("other")).where("y = other")
    known = x.where(~F.col("held_out")).join(y.select("doc_id", "y"), "doc_id")
    model = fit(moments(known), to_pooled, to_diagonal)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = scores(b.column("x").flatten().to_numpy().reshape(-1, D), model)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return x.select("doc_id", "held_out", "x").mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
