"""Language-model scores by prediction by partial matching.

The model is a trie of contexts with the counts of what followed them in all training texts, pretrained by
aggregations over the corpus. Its deepest order predicts phrases: a text is cut where a word says so (CUT), and the
phrase before is the context of the next one, tens of bytes long. Of a phrase after a context, the training texts that hold it
are counted: n. A context followed t times, by q distinct phrases, gives a phrase (n - 1) / t and the escape q / t, which sum to
one; contexts never seen cost nothing. So what a single text holds predicts nothing, least of all that text itself, and a score is
one function of the text, whether the row trained or not. Below it, bytes are predicted in
contexts of ORDER bytes and fewer: a byte's probability in its longest known context is count / (total + distinct); the
rest of the mass, distinct / (total + distinct), escapes to the context one byte shorter, where bytes that the
longer one has seen are excluded from the counts; below the empty context stands the uniform distribution over
bytes never seen. (Bytes that would spell a seen phrase aren't excluded after its escape.)

What grows with the corpus is never broadcast: phrases of two texts or more, the contexts that have such, words and sequences of ORDER + 1 bytes are counted in a
table. The most frequent of each, at most HEAD, are sent to the tasks; whatever a text asks for beside them is joined by a
64-bit key. A term of the score is one thing if its key is found and another if not, so a text's score is a sum over keys.
Statistics of contexts of ORDER bytes or fewer are sent too; there are at most 256^ORDER of them.

Beside it stands a unigram model over words with add-one smoothing, whose counts are joined the same way.

Defined results: null and empty texts have the end token alone and model score 0; rows without a doc_id
count as training rows; repeated rows are scored one by one and each counts in training; an empty table gives
none; without training rows every byte is uniform and N = V = 0; texts of any length are read whole, each in one block;
among keys as frequent as the last that fits into the head, none is in it; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import pickle
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import LOWER, SPACES, Workspace

ORDER, HEAD = 3, 200_000
#: A phrase ends after a word whose hash is divisible by this, so after so many words on average.
CUT = 16
#: Bytes of text of which a task hands on the counts together, and that are looked up at once.
GATHER, AT_ONCE = 16 << 20, 1 << 20
#: The key of a text's end as a word.
END = 0
#: What is counted: words, phrases after a context, contexts of phrases; sequences of k + 1 bytes have k, and
#: those of the highest order are called GRAM where they are joined.
WORD, PHRASE, CONTEXT, GRAM = -1, -2, -3, -4
IS_SPACE = np.isin(np.arange(256), list(SPACES))
ODD, MIX = 0x9E3779B97F4A7C15, np.uint64(0xFF51AFD7ED558CCD)


def grams(raw: bytes, order: int) -> np.ndarray:
    """The text's sequences of order + 1 bytes as numbers, the last byte lowest."""
    b = np.frombuffer(raw, np.uint8).astype(np.uint64)
    n = len(b) - order
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(order + 1):
        out = (out << np.uint64(8)) | b[j : j + n]
    return out


def trains(doc_id: object, folds: int, fold: int) -> bool:
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % folds != fold


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * MIX
    return x ^ (x >> np.uint64(29))


class Powers:
    """ODD to the power of 0, 1, ... and of 0, -1, ..., modulo 2^64, as long as the longest text so far."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            for name, base in (("up", ODD), ("down", pow(ODD, -1, 1 << 64))):
                steps = np.full(2 * n, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up, self.down


@dataclass
class Block:
    """Texts one after the other, a blank between them, and where their words and phrases stand. All by array operations over the block."""

    raws: list[bytes]
    powers: Powers

    def __post_init__(self):
        self.raw = b" ".join(self.raws)
        size = np.array([len(r) for r in self.raws], np.int64)
        self.end = np.cumsum(size + 1) - 1
        self.start = self.end - size
        b = np.frombuffer(self.raw, np.uint8)
        up, self.down = self.powers.of(len(b) + 1)
        self.so_far = np.zeros(len(b) + 1, np.uint64)
        np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)], out=self.so_far[1:])
        solid = np.concatenate([[False], ~IS_SPACE[b], [False]])
        starts, ends = np.flatnonzero(solid[1:-1] & ~solid[:-2]), np.flatnonzero(solid[1:-1] & ~solid[2:]) + 1
        #: Words: text and hash.
        self.word_text, self.words = self.text_of(starts), self.hashed(starts, ends)
        same = self.word_text[1:] == self.word_text[:-1]
        cut = starts[1:][same & (self.words[:-1] % np.uint64(CUT) == 0)]
        #: Phrases: start, text, and keys of the context, which is the phrase before (at first: none), and of the phrase after it.
        self.at = np.sort(np.concatenate([self.start[size > 0], cut])).astype(np.int64)
        self.text = self.text_of(self.at)
        last = np.append(self.text[1:] != self.text[:-1], True)[: len(self.at)]
        h = self.hashed(self.at, np.where(last, self.end[self.text], np.append(self.at[1:], 0)[: len(self.at)]))
        before = np.where(self.at == self.start[self.text], np.uint64(0), np.append(np.zeros(1, np.uint64), h)[: len(h)])
        self.context, self.phrase = mixed(before + np.uint64(1)).view(np.int64), mixed(before * np.uint64(ODD) ^ h).view(np.int64)

    def text_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.start, at, "right") - 1

    def hashed(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.so_far[end] - self.so_far[start]) * self.down[start])

    def grams(self, order: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of the bytes that have order bytes of their text before them, and the sequences of order + 1 bytes."""
        g = grams(self.raw, order)
        at = np.arange(order, order + len(g))
        from_start = at - np.repeat(self.start, self.end - self.start + 1)[order : order + len(g)] if len(g) else at
        inside = (from_start >= order) & (at < np.repeat(self.end, self.end - self.start + 1)[order : order + len(g)]) if len(g) else np.zeros(0, bool)
        return at[inside], g[inside]

    def each(self, text: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Group of each key of a text, and how many each group has."""
        codes, _ = pd.factorize(mixed(keys.view(np.uint64) + text.astype(np.uint64) * np.uint64(ODD)))
        return codes, np.bincount(codes)


def blocks(raws: list[bytes], powers: Powers) -> Iterator[tuple[int, Block]]:
    """The texts in blocks of AT_ONCE bytes, or of one text that is longer; with the number of each block's first."""
    lo = 0
    while lo < len(raws):
        hi, size = lo, 0
        while hi < len(raws) and (hi == lo or size + len(raws[hi]) <= AT_ONCE):
            size += len(raws[hi]) + 1
            hi += 1
        yield lo, Block(raws[lo:hi], powers)
        lo = hi


def gather(batches: Iterator[pa.RecordBatch], folds: int, fold: int, order: int) -> Iterator[pa.RecordBatch]:
    """kind, key, n, context of training rows: words, phrases (n: texts; context: the key of theirs, else 0), sequences of order + 1 bytes, and texts' first bytes.

    Partial counts of GATHER bytes of text at a time.
    """

    def handed(kind: int, keys: np.ndarray, counts: np.ndarray, context: np.ndarray | None = None) -> pa.RecordBatch:
        context = np.zeros(len(keys), np.int64) if context is None else context
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), *(pa.array(x.astype(np.int64)) for x in (keys, counts, context))], names=["kind", "key", "n", "context"])

    begun, powers, size, texts = Counter(), Powers(), 0, 0
    parts: dict[int, list[tuple[np.ndarray, ...]]] = {WORD: [], PHRASE: [], order: []}

    def given() -> Iterator[pa.RecordBatch]:
        yield handed(WORD, np.array([END]), np.array([texts]))
        for k in range(order):
            own = {t: n for t, n in begun.items() if len(t) == k + 1}
            yield handed(k, np.fromiter((int.from_bytes(t, "big") for t in own), np.int64, len(own)), np.fromiter(own.values(), np.int64, len(own)))
        for kind, some in parts.items():
            if some:
                keys, counts, context = (np.concatenate(x) for x in zip(*some, strict=True))
                codes, own = pd.factorize(keys)
                yield handed(kind, own, np.bincount(codes, counts, len(own)), context[np.unique(codes, return_index=True)[1]])
            some.clear()
        begun.clear()

    for b in batches:
        train = [(t or b"").translate(LOWER) for d, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True) if trains(d, folds, fold)]
        for _, block in blocks(train, powers):
            _, one = np.unique(block.each(block.text, block.phrase)[0], return_index=True)  # a text counts once for a phrase
            for kind, keys in ((WORD, block.words.view(np.int64)), (PHRASE, block.phrase[one]), (order, block.grams(order)[1].astype(np.int64))):
                codes, own = pd.factorize(keys)
                context = block.context[one][np.unique(codes, return_index=True)[1]] if kind == PHRASE else np.zeros(len(own), np.int64)
                parts[kind].append((own, np.bincount(codes, minlength=len(own)), context))
            for r in block.raws:
                begun.update(r[: k + 1] for k in range(min(order, len(r))))
            texts, size = texts + len(block.raws), size + len(block.raw)
            if size > GATHER:
                yield from given()
                size = texts = 0
    yield from given()


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    own, where = np.unique(keys, return_inverse=True)
    return own, np.bincount(where, counts, len(own)).astype(np.int64)


def marginal(level: tuple[np.ndarray, np.ndarray], begun: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The counts of order k: those of order k + 1 without their first byte, and each text's first k + 1 bytes."""
    short = level[0] & np.uint64((1 << (8 * (k + 1))) - 1)
    return summed(np.concatenate([short, begun[0]]), np.concatenate([level[1], begun[1]]))


def found(keys: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each of x stands in the sorted keys, and whether it does."""
    if not len(keys):
        return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    return at, keys[at] == x


@dataclass
class Contexts:
    """Contexts of one order: key, total, distinct; and what each leaves of the context a byte shorter: total and distinct there."""

    keys: np.ndarray
    total: np.ndarray
    distinct: np.ndarray
    left_total: np.ndarray
    left_distinct: np.ndarray

    def __post_init__(self):
        with np.errstate(divide="ignore"):
            self.first = np.log10(self.total + self.distinct)
            self.escape = np.log10(self.distinct) - self.first
            some = self.left_distinct > 0
            self.below = np.where(some, np.log10(np.maximum(self.left_total + self.left_distinct, 1)), 0.0)
            self.escape_below = np.where(some, np.log10(np.maximum(self.left_distinct, 1)) - self.below, 0.0)


class Trie:
    """Log probabilities (base 10) of bytes: counts of the orders under the highest, and contexts of all orders."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray]], top: Contexts):
        """levels: for each order but the highest, the sorted keys (context and byte) and their counts; top: the highest order's contexts."""
        self.order = len(levels)
        self.keys, self.logs = [k for k, _ in levels], [np.log10(c) for _, c in levels]
        self.contexts: list[Contexts] = []
        for k, (keys, counts) in enumerate(levels):
            own, start = np.unique(keys >> np.uint64(8), return_index=True)
            total, distinct = (np.add.reduceat(x, start) if len(own) else np.zeros(0) for x in (counts, np.ones(len(keys), np.int64)))
            left_total, left_distinct = np.zeros(len(own)), np.zeros(len(own))
            if k:  # every sequence's end is a sequence of the order below
                up = self.contexts[k - 1]
                at, _ = found(self.keys[k - 1], keys & np.uint64((1 << (8 * k)) - 1))
                there, _ = found(up.keys, own & np.uint64((1 << (8 * (k - 1))) - 1))
                left_total = up.total[there] - (np.add.reduceat(levels[k - 1][1][at], start) if len(own) else 0)
                left_distinct = up.distinct[there] - distinct
            self.contexts.append(Contexts(own, total, distinct, left_total, left_distinct))
        self.contexts.append(top)
        unseen = 256 - (len(levels[0][0]) if levels else 0)
        self.uniform = -math.log10(unseen) if 0 < unseen < 256 else -math.log10(256)

    def unseen(self, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of sequences of order + 1 bytes: the last byte's log probability if the sequence was never seen, and what it is less than the log of its count if it was."""
        at, known = found(self.contexts[self.order].keys, g >> np.uint64(8))
        top = self.contexts[self.order]
        first = np.where(known, top.first[at], 0.0) if len(top.keys) else np.zeros(len(g))
        out = np.where(known, top.escape[at], 0.0) if len(top.keys) else np.zeros(len(g))
        return out + self.levels(g & np.uint64((1 << (8 * self.order)) - 1), self.order - 1, np.where(known, at, -1)), first

    def levels(self, g: np.ndarray, k: int, longer: np.ndarray | None = None) -> np.ndarray:
        """Of sequences of k + 1 bytes, the log probability of the last byte; longer: the context of order k + 1 escaped from, or -1."""
        out, todo, g = np.zeros(len(g)), np.arange(len(g)), g.copy()
        longer = np.full(len(g), -1) if longer is None else longer.copy()
        while k >= 0 and len(todo):
            own = self.contexts[k]
            at, hit = found(self.keys[k], g[todo])
            c, known = found(own.keys, g[todo] >> np.uint64(8))
            escaped = longer[todo] >= 0
            mass, leave = (np.where(known, x[c], 0.0) if len(own.keys) else np.zeros(len(todo)) for x in (own.first, own.escape))
            if escaped.any():
                up = self.contexts[k + 1]
                mass = np.where(escaped, up.below[np.maximum(longer[todo], 0)], mass)
                leave = np.where(escaped, up.escape_below[np.maximum(longer[todo], 0)], leave)
            out[todo] += np.where(hit, (self.logs[k][at] if len(self.keys[k]) else 0.0) - mass, np.where(known, leave, 0.0))
            longer[todo] = np.where(known, c, -1)
            todo = todo[~hit]
            g[todo] &= np.uint64((1 << (8 * k)) - 1)
            k -= 1
        out[todo] += self.uniform
        return out


@dataclass
class Head:
    """Sorted keys of one kind, and the logs of their counts (of words: plus 1; of phrases: less 1); of contexts, also of the distinct phrases."""

    keys: np.ndarray
    logs: np.ndarray
    distinct: np.ndarray

    def log(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which of keys are here, and the two logs of each (0 where it isn't)."""
        at, hit = found(self.keys, keys)
        return hit, *(np.where(hit, x[at], 0.0) if len(self.keys) else np.zeros(len(keys)) for x in (self.logs, self.distinct))


def spelt(block: Block, trie: Trie, head: Head, first: dict[bytes, float]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The log probability of each byte (0 where it hangs on a sequence outside the head); and of those sequences: places, keys, logs if they were never seen, and what they are less than the logs of their counts if they were.

    Equal sequences are looked up once. first: log probabilities of texts' first bytes, which have shorter contexts.
    """
    order, out = trie.order, np.zeros(len(block.raw))
    for at, r in zip(block.start.tolist(), block.raws, strict=True):
        for k in range(min(order, len(r))):
            if (begin := r[: k + 1]) not in first:
                first[begin] = float(trie.levels(grams(begin, k), k)[0])
            out[at + k] = first[begin]
    places, g = block.grams(order)
    codes, own = pd.factorize(g)
    own = np.asarray(own, np.uint64)
    at, hit = found(head.keys, own.view(np.int64))
    alt, less = trie.unseen(own)
    out[places] = np.where(hit, (head.logs[at] if len(head.keys) else 0.0) - less, 0.0)[codes]
    rest = np.flatnonzero(~hit[codes])
    return out, places[rest], own[codes[rest]].view(np.int64), alt[codes[rest]], less[codes[rest]]


def terms(block: Block, trie: Trie, heads: dict[int, Head], first: dict[bytes, float]) -> tuple[list[np.ndarray], np.ndarray, dict[str, np.ndarray]]:
    """Of each text: tokens, known ones, sum of their logs, what is known of the score; then what is to be joined (see ASKED), and whose it is."""
    n, total = len(block.raws), lambda text, x: np.bincount(text, x, len(block.raws))
    text, keys = np.append(block.word_text, np.arange(n)), np.append(block.words.view(np.int64), np.full(n, END))
    group, times = block.each(text, keys)
    _, one = np.unique(group, return_index=True)
    text, keys, times = text[one], keys[one], times
    in_w, log_w, _ = heads[WORD].log(keys)
    (in_c, log_t, log_q), (in_p, log_p, _) = heads[CONTEXT].log(block.context), heads[PHRASE].log(block.phrase)
    known = total(block.text, log_p) - total(block.text, log_t)
    each, places, rest, alt, less = spelt(block, trie, heads[GRAM], first)
    spelling = log_q + np.add.reduceat(each, block.at) if len(block.at) else np.zeros(0)
    of = np.searchsorted(block.at, places, "right") - 1  # the phrase that a sequence outside the head ends in
    used = ~in_p[of] if len(of) else np.zeros(0, bool)
    of, rest, alt, less = of[used], rest[used], alt[used], less[used]
    open_, shut_c = np.flatnonzero(~in_p), np.flatnonzero(~in_c)
    shut_w = np.flatnonzero(~in_w)
    sizes = [len(shut_c), len(open_), len(of), len(shut_w)]
    none = [np.zeros(k) for k in sizes]
    whose = np.concatenate([block.text[shut_c], block.text[open_], block.text[of], text[shut_w]])
    partners = np.concatenate([of, shut_c])
    asked = {
        "kind": np.repeat(np.array([CONTEXT, PHRASE, GRAM, WORD]), sizes),
        "key": np.concatenate([block.context[shut_c], block.phrase[open_], rest, keys[shut_w]]),
        "times": np.concatenate([*none[:3], times[shut_w]]),
        "at": np.concatenate([np.where(in_p[shut_c], -1, shut_c), np.where(np.isin(open_, partners), open_, -1), of, none[3] - 1]),
        "alt": np.concatenate([none[0], spelling[open_], alt, none[3]]),
        "less": np.concatenate([none[0], none[1], less, none[3]]),
    }
    order = np.argsort(whose, kind="stable")
    return [total(text, times), total(text, np.where(in_w, times, 0)), total(text, times * log_w), known], whose[order], {k: x[order] for k, x in asked.items()}


#: What a text asks for: kind and key; times a word occurs; alt, its term if the key isn't found; less, what a sequence's term is
#: less than the log of its count if it is. A phrase shares at, its number in the block, with the sequences outside the head in it and with its
#: context, if that is outside: the sequences and the context's escape count only if the phrase isn't found. Otherwise at is -1.
ASKED = {"kind": pa.int32(), "key": pa.int64(), "times": pa.int64(), "at": pa.int32(), "alt": pa.float64(), "less": pa.float64()}


def score(batches: Iterator[pa.RecordBatch], trie: Trie, heads: dict[int, Head], folds: int, fold: int) -> Iterator[pa.RecordBatch]:
    powers, first = Powers(), {}
    names = ["_row", "doc_id", "held_out", "n_tokens", "known", "logs", "score", "asked"]
    for b in batches:
        held_out = np.array([not trains(d, folds, fold) for d in b.column(1).to_pylist()], bool)
        raws = [(t or b"").translate(LOWER) for t in b.column(2).cast(pa.binary()).to_pylist()]
        for lo, block in blocks(raws, powers):
            hi = lo + len(block.raws)
            sums, whose, asked = terms(block, trie, heads, first)
            flat = pa.StructArray.from_arrays([pa.array(asked[k].astype(kind.to_pandas_dtype()), kind) for k, kind in ASKED.items()], list(ASKED))
            ends = pa.array(np.append(0, np.cumsum(np.bincount(whose, minlength=hi - lo))).astype(np.int32))
            made = [pa.array(held_out[lo:hi]), *(pa.array(x.astype(np.int64)) for x in sums[:2]), *(pa.array(x.astype(np.float64)) for x in sums[2:])]
            yield pa.RecordBatch.from_arrays([*(b.column(k).slice(lo, hi - lo) for k in (0, 1)), *made, pa.ListArray.from_arrays(ends, flat)], names=names)
            if len(first) > GATHER:
                first.clear()


def columns(df: DataFrame, *names: str) -> list[np.ndarray]:
    got = df.select(*names).toArrow().sort_by(names[0])
    return [got.column(n).to_numpy() for n in names]


def trie_of(ws: Workspace, counts: DataFrame, order: int) -> Trie:
    """From counts(kind, key, n): what the tasks need, at most 256^order contexts and sequences of each order under the highest."""
    last = F.col("key").bitwiseAND(F.lit((1 << (8 * order)) - 1))
    longest = counts.where(F.col("kind") == order).select("key", "n")
    shorter = longest.select(last.alias("key"), "n").unionByName(counts.where(F.col("kind") == order - 1).select("key", "n"))
    shorter = ws.keep(shorter.groupBy("key").agg(F.sum("n").alias("n")), "shorter")
    ends = longest.withColumn("end", last).join(shorter.select(F.col("key").alias("end"), F.col("n").alias("m")), "end")
    top = ends.groupBy(F.shiftrightunsigned("key", 8).alias("context")).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("distinct"), F.sum("m").alias("seen"))
    begun = [(k.astype(np.uint64), c) for k, c in (columns(counts.where(F.col("kind") == k), "key", "n") for k in range(order - 1))]
    keys, n = columns(shorter, "key", "n")
    levels = [(keys.astype(np.uint64), n)]
    for k in reversed(range(order - 1)):
        levels.insert(0, marginal(levels[0], begun[k], k))
    own, total, distinct, seen = columns(top, "context", "total", "distinct", "seen")
    own = own.astype(np.uint64)
    keys, up = levels[-1][0], levels[-1][1]
    short, start = np.unique(keys >> np.uint64(8), return_index=True)
    there, _ = found(short, own & np.uint64((1 << (8 * (order - 1))) - 1))
    all_total, all_distinct = (np.add.reduceat(x, start)[there] if len(own) else np.zeros(0) for x in (up, np.ones(len(keys), np.int64)))
    return Trie(levels, Contexts(own, total, distinct, all_total - seen, all_distinct - distinct))


def heads_of(counts: DataFrame, kinds: dict[int, int], head: int) -> tuple[dict[int, Head], dict[int, DataFrame]]:
    """By name in kinds (name: kind in counts): the keys from a count on, the lowest step of counts that leaves no more than head keys; and the others."""
    step = F.floor(F.log2("n") * 64)
    histogram: dict[int, list] = {}
    for r in counts.where(F.col("kind").isin(list(kinds.values()))).groupBy("kind", step.alias("step")).agg(F.count(F.lit(1)).alias("v")).orderBy(F.desc("step")).collect():
        histogram.setdefault(r.kind, []).append(r)
    heads, tails = {}, {}
    for name, kind in kinds.items():
        room, least = head, None
        for r in histogram.get(kind, []):
            room -= r.v
            if room < 0:
                break
            least = r.step
        own, inside = counts.where(F.col("kind") == kind), step >= least if least is not None else F.lit(False)
        keys, n, q = columns(own.where(inside), "key", "n", "q")
        heads[name] = Head(keys, np.log10(n + {WORD: 1.0, PHRASE: -1.0}.get(name, 0.0)), np.log10(np.maximum(q, 1)))
        tails[name] = own.where(~inside).select(F.lit(name).alias("kind"), "key", F.col("n").alias("c"), "q")
    return heads, tails


def score_documents(docs: DataFrame, *, folds: int = 7, fold: int = 2, order: int = ORDER, head: int = HEAD) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for each row of docs(doc_id, text)."""
    ws = Workspace(docs.sparkSession, "ppm")
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    gathered = rows.mapInArrow(lambda it: gather(it, folds, fold, order), "kind int, key long, n long, context long")
    counts = ws.keep(gathered.groupBy("kind", "key").agg(F.sum("n").alias("n"), F.max("context").alias("context")), "counts")
    # of contexts, only those that give a phrase anything: for the others, the escape is sure
    contexts = counts.where(F.col("kind") == PHRASE).groupBy("context").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("q")).where("n > q")
    contexts = ws.keep(contexts.select(F.lit(CONTEXT).alias("kind"), F.col("context").alias("key"), "n", "q"), "contexts")
    counts = counts.where((F.col("kind") != PHRASE) | (F.col("n") > 1)).select("kind", "key", "n", F.lit(0).cast("long").alias("q"))
    v, n = counts.where(F.col("kind") == WORD).agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    heads, tails = heads_of(counts.unionByName(contexts), {WORD: WORD, PHRASE: PHRASE, CONTEXT: CONTEXT, GRAM: order}, head)
    sent = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps((trie_of(ws, counts, order), heads)))
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = f"_row long, doc_id {kind}, held_out boolean, n_tokens long, known long, logs double, score double, asked array<struct<kind:int,key:long,times:long,at:int,alt:double,less:double>>"
    scored = rows.select(F.monotonically_increasing_id().alias("_row"), "doc_id", "text").mapInArrow(lambda it: score(it, *pickle.loads(sent.value), folds, fold), out)
    scored = ws.keep(scored, "scored")
    # what isn't in a head, by a join on kind and key; first a sum for each phrase that has sequences outside the head, then for each row
    tail = tails[WORD].unionByName(tails[PHRASE]).unionByName(tails[CONTEXT]).unionByName(tails[GRAM])
    asked = scored.select("_row", F.inline("asked")).join(tail, ["kind", "key"], "left")
    is_, hit = lambda k: F.col("kind") == k, F.col("c").isNotNull()
    word = F.when(is_(WORD) & hit, F.col("times"))
    term = F.when(is_(CONTEXT), F.when(hit, -F.log10("c"))).when(is_(PHRASE), F.when(hit, F.log10(F.col("c") - 1.0)).otherwise(F.col("alt")))
    spelt_out = F.when(is_(GRAM), F.when(hit, F.log10("c") - F.col("less")).otherwise(F.col("alt"))).when(is_(CONTEXT) & (F.col("at") >= 0) & hit, F.log10("q"))
    by_phrase = asked.groupBy("_row", "at").agg(
        F.sum(word).alias("m"), F.sum(word * F.log10(F.col("c") + 1.0)).alias("l"), F.sum(term).alias("s"), F.sum(spelt_out).alias("g"),
        F.bool_or((F.col("at") >= 0) & is_(PHRASE) & hit).alias("whole"),
    )
    more = by_phrase.groupBy("_row").agg(F.sum("m").alias("m"), F.sum("l").alias("l"), F.sum(F.coalesce("s", F.lit(0.0)) + F.when(F.col("whole"), 0.0).otherwise(F.coalesce("g", F.lit(0.0)))).alias("s"))
    none = F.lit(0.0)
    base = F.coalesce("logs", none) + F.coalesce("l", none) - F.col("n_tokens") * F.lit(math.log10(n + v + 1))
    return scored.drop("asked").join(more, "_row", "left").select("doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("m", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("score") + F.coalesce("s", none)).alias("score"))
