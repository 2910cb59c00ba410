"""Mixing domains to target weights by soft membership.

A classifier learnt from a sample of at most SAMPLE labelled documents gives every document a posterior over domains:
naive Bayes over the presence of hashed tokens (words, runs of marks, and how repetitive the text is),
on all tokens whose documents are dealt over the domains otherwise than documents of their lengths are (SIGNIFICANT). Then each document gets a rate, how often it should occur
in the mixture. Rates start at 1, aren't negative nor above a limit if one is given, and are fitted by projected gradient steps on the least squares of the
domains' expected token totals against their targets. In the metric in which a
document weighs its tokens and residuals are whitened, a step subtracts p . y from a rate, where p is the
posterior and y the whitened residual of the last totals; so a pass over the data is one aggregation to a few
numbers for each pair of domains, and a rate follows from p and the list of steps. How far the totals stay from their
targets is returned as residual; it is over EXACT only where further steps hardly come nearer.

Defined results: null and empty texts have no tokens and get the prior as posterior; rows without a doc_id
are never labelled; a labelled document with two different domains is not used, nor are domains without a
target; without labelled rows posteriors are equal; repeated rows get equal rates, and copies that their hash decides; texts
of any length are read whole; of equally likely domains none is chosen, as posteriors stay soft; an empty table gives
none; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Workspace

#: Domains and the share of tokens each should have.
TARGETS = {"good": 0.96, "junk": 0.01, "toxic": 0.03}
ANCHOR = "good"
#: Hashed tokens, the power of their evidence, the weight of a token's share in all
#: domains in its share of one, and the residual (a share of all tokens) that ends it.
BUCKETS, TEMPER, SMOOTH, EXACT = 1 << 18, 0.5, 20.0, 1e-5
#: A token is used if its chi-square statistic has a smaller probability by chance: 1% that any of all buckets passes
#: so (Bonferroni). The statistic isn't defined well for fewer documents than LEAST, which are not tested.
SIGNIFICANT, LEAST = 0.01 / BUCKETS, 5
#: Labelled documents that the classifier is fitted on, at most (give or take the chance of a hash): their ids are broadcast.
SAMPLE = 20_000
#: Words, or runs of marks; a long run counts by its first three.
TOKEN = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+|[^0-9A-Za-z\s\x{80}-\x{10FFFF}]{1,3}"


def features(docs: DataFrame, row: str | None = None) -> DataFrame:
    """_row (the column row, or else a number), doc_id, n (words) and the distinct buckets of each document."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    df = docs.select("doc_id", (F.col(row) if row else F.monotonically_increasing_id()).alias("_row"), F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)).alias("_t"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).alias("n"))
    df = df.withColumn("_d", F.array_distinct(F.transform("_t", lambda t: F.pmod(F.xxhash64(F.lower(t)), F.lit(BUCKETS)).cast("int"))))
    # three buckets beyond the tokens' tell how repetitive the text is, for its length
    repeats = F.when(F.col("n") > 20, F.floor(F.size("_d") / F.pow(F.size("_t"), F.lit(0.8)) * 4).cast("int"))
    return df.select("_row", "doc_id", F.col("n").cast("long").alias("n"), F.when(repeats.isNotNull(), F.concat("_d", F.array(F.least(repeats, F.lit(20)) + BUCKETS))).otherwise(F.col("_d")).alias("buckets"))


def critical(freedom: int, p: float = SIGNIFICANT) -> float:
    """The value that a chi-square variable exceeds with probability p (by Wilson and Hilferty's approximation)."""
    v = 2 / (9 * max(freedom, 1))
    return max(freedom, 1) * (1 - v + NormalDist().inv_cdf(1 - p) * v**0.5) ** 3


def weights(labelled: DataFrame, domains: list[str]) -> tuple[list[float], DataFrame]:
    """Log priors, and for each significant token the log of its lift in each domain if absent, and what presence adds.

    What a token is expected to have in a domain is summed over its documents, by the domains of labelled documents
    about as long (powers of 2): a token that only tells the length has a lift of 1, however common it is.
    """
    labelled = labelled.withColumn("length", F.floor(F.log2(F.col("n") + 1)).cast("int"))
    known: dict[int, dict[str, int]] = {}
    for r in labelled.groupBy("length", "domain").agg(F.count(F.lit(1)).alias("n")).collect():
        known.setdefault(r.length, {})[r.domain] = r.n
    size = [sum(x.get(d, 0) for x in known.values()) for d in domains]
    total = sum(size)
    prior = [float(np.log((s + 1) / (total + len(domains)))) for s in size]
    share = [{length: x.get(d, 0) / sum(x.values()) for length, x in known.items()} for d in domains]
    due = [F.create_map(*(F.lit(v) for kv in sorted(x.items()) for v in kv))[F.col("length")] if x else F.lit(0.0) for x in share]
    each = labelled.select("domain", *(e.alias(f"e{k}") for k, e in enumerate(due)), F.explode("buckets").alias("bucket"))
    seen = each.groupBy("bucket").agg(F.count(F.lit(1)).alias("all"), *(F.count_if(F.col("domain") == d).alias(f"c{k}") for k, d in enumerate(domains)), *(F.sum(f"e{k}").alias(f"e{k}") for k in range(len(domains))))
    spread = sum(((F.col(f"c{k}") - F.col(f"e{k}")) * (F.col(f"c{k}") - F.col(f"e{k}")) / (F.col(f"e{k}") + 1e-9) for k in range(len(domains))), F.lit(0.0))
    best = seen.where((F.col("all") >= LEAST) & (spread > critical(sum(s > 0 for s in size) - 1)))
    in_all = F.col("all") / (total + 1)
    # the share of a domain's documents: as in all, times the lift, and no more than if all that have the token were its own
    lift = [(F.col(f"c{k}") + SMOOTH * in_all) / (F.col(f"e{k}") + SMOOTH * in_all) for k in range(len(domains))]
    inside = [F.least(in_all * x, (s + SMOOTH * in_all) / (s + SMOOTH)) for s, x in zip(size, lift, strict=True)]
    absent = [F.log((1 - x) / (1 - in_all)) for x in inside]
    return prior, best.select("bucket", *(a.alias(f"a{k}") for k, a in enumerate(absent)), *((F.log(x / in_all) - a).alias(f"w{k}") for k, (x, a) in enumerate(zip(inside, absent, strict=True))))


def posteriors(feats: DataFrame, prior: list[float], chosen: DataFrame) -> DataFrame:
    """_row, doc_id, n and p, an array over the domains."""
    ks = range(len(prior))
    # each document brings one bucket, -1, that stands for all tokens as absent, so that none is lost
    none = chosen.agg(*(F.coalesce(F.sum(f"a{k}"), F.lit(0.0)).alias(f"w{k}") for k in ks)).select(F.lit(-1).alias("bucket"), *(f"w{k}" for k in ks))
    chosen = chosen.select("bucket", *(f"w{k}" for k in ks))
    found = feats.select("_row", "doc_id", "n", F.explode(F.concat("buckets", F.array(F.lit(-1)))).alias("bucket")).join(F.broadcast(chosen.unionByName(none)), "bucket")
    logs = found.groupBy("_row", "doc_id", "n").agg(*(F.sum(f"w{k}").alias(f"s{k}") for k in ks)).select("_row", "doc_id", "n", F.array(*(F.lit(prior[k]) + TEMPER * F.col(f"s{k}") for k in ks)).alias("l"))
    e = logs.withColumn("e", F.transform("l", lambda x: F.exp(x - F.array_max("l"))))
    return e.select("_row", "doc_id", "n", F.transform("e", lambda x: x / F.aggregate("e", F.lit(0.0), lambda a, y: a + y)).alias("p"))


def rate(steps: list[np.ndarray], most: float) -> Column:
    """1, less p . y for each step in turn, kept between 0 and most (which may be infinite)."""
    r = F.lit(1.0)
    if steps:
        ys = F.array(*(F.array(*(F.lit(float(v)) for v in y)) for y in steps))
        dot = lambda y: sum((F.col("p")[k] * y[k] for k in range(len(steps[0]))), F.lit(0.0))
        r = F.aggregate(ys, F.lit(1.0), lambda r, y: F.least(F.lit(float(most)), F.greatest(F.lit(0.0), r - dot(y))))
    return r


def sums(members: DataFrame, columns: list[Column]) -> np.ndarray:
    return np.array([x or 0.0 for x in members.agg(*(F.sum(x).alias(f"x{i}") for i, x in enumerate(columns))).first()])


def fit(members: DataFrame, targets: list[float], anchor: int | None, most: float, exact: float = EXACT) -> tuple[list[np.ndarray], float]:
    """The steps of the projected gradient, each one aggregation over members(n, p); and the residual: the largest difference of a domain's total from its target, as a share of all targets.

    Gradients are scaled by the products of posteriors over the documents whose rate isn't 0 (the others don't answer to
    most steps), so that steps near the end are as good as exact. Such a step may go too far; if the squares grow, the step is
    replaced by one scaled over all documents, for which they fall. Ends when the targets are met, when a step takes
    less than 1% off the squares, as where no rates come much nearer. With a limit to the rates, steps go to what is in reach
    of the targets; the residual is to the targets themselves.
    """
    k, p, n, r = len(targets), F.col("p"), F.col("n"), F.col("r")
    pairs = [(i, j) for i in range(k) for j in range(i, k)]

    def passed(done: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        live = F.when(r > 0, n).otherwise(0)
        got = sums(members.withColumn("r", rate(done, most)), [n * p[i] * r for i in range(k)] + [live * p[i] * p[j] for i, j in pairs])
        g = np.zeros((k, k))
        for (i, j), v in zip(pairs, got[k:], strict=True):
            g[i, j] = g[j, i] = v
        return got[:k], np.linalg.pinv(g, rcond=1e-9)

    done: list[np.ndarray] = []
    now, every = passed(done)
    share = np.array(targets) / sum(targets)
    want = share * (now[anchor] / share[anchor] if anchor is not None else now.sum())
    asked = want
    if np.isfinite(most):
        want = np.minimum(want, most * now)  # no rates give a domain more
    scale = max(asked.sum(), 1.0)
    squares = lambda x: float((x - want) @ every @ (x - want))
    residual = lambda to: float(np.abs(now - to).max() / scale)
    white = every
    while residual(want) > exact:
        after, then = passed([*done, white @ (now - want)])
        step = white @ (now - want)
        if squares(after) > squares(now):
            step = every @ (now - want)
            after, then = passed([*done, step])
        if squares(after) > (1 - 1e-2) * squares(now):
            break
        done.append(step)
        now, white = after, then
    return done, residual(asked)


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] = TARGETS, anchor: str | None = ANCHOR, most: float = np.inf, seed: int = 7, row: str | None = None) -> DataFrame:
    """doc_id, n_tokens, p_<domain>, rate, copies and residual for each row of docs(doc_id, text); labelled(doc_id, domain).

    most: the largest rate, at least 1; with one, a domain whose target is more than so many times its total misses it.
    Without, every domain that has tokens can meet its target.
    anchor: the domain whose total stays as it is; None: the total of all. copies: the rate, rounded up or
    down by a hash of doc_id (of _row where it is null), so that its expectation is the rate.
    row: a column of docs that tells its rows apart, which is _row then.
    """
    ws, domains = Workspace(docs.sparkSession, "mixing"), list(targets)
    feats = ws.keep(features(docs, row), "features")
    clear = labelled.where(F.col("doc_id").isNotNull() & F.col("domain").isin(domains)).groupBy("doc_id").agg(F.min("domain").alias("domain"), F.max("domain").alias("other")).where("domain = other")
    # a bounded sample by a hash of the id, so that no document's tokens are shuffled to meet their label
    clear = ws.keep(clear.select("doc_id", "domain"), "labels")
    share = SAMPLE / max(clear.count(), SAMPLE)
    sample = clear.where(F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.lit(1_000_000)) < int(share * 1_000_000))
    prior, chosen = weights(feats.select("doc_id", "n", "buckets").join(F.broadcast(sample), "doc_id"), domains)
    members = ws.keep(posteriors(feats, prior, ws.keep(chosen, "tokens")), "members")
    steps, residual = fit(members, list(targets.values()), domains.index(anchor) if anchor else None, most)
    ws.drop(feats)
    own = F.when(F.col("doc_id").isNull(), F.xxhash64("_row", F.lit(seed))).otherwise(F.xxhash64("doc_id", F.lit(seed)))
    chance = F.pmod(own, F.lit(1 << 40)) / float(1 << 40)
    out = members.withColumn("rate", rate(steps, most))
    return out.select("doc_id", "_row", F.col("n").alias("n_tokens"), *(F.col("p")[k].alias(f"p_{d}") for k, d in enumerate(domains)), "rate", F.floor(F.col("rate") + chance).cast("int").alias("copies"), F.lit(residual).alias("residual"))


def domains_of(labels: DataFrame) -> DataFrame:
    """doc_id and domain, from the table of labels."""
    domain = F.when(F.col("quality") == 0, "junk").when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good")
    return labels.select("doc_id", domain.alias("domain"))
