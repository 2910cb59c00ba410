"""Quality rules by repetition coverage.

Rolling 64-bit hashes of several n-gram lengths, in numpy, find the n-grams that occur twice or
more in a text; what counts is the share of the text's characters that lies inside them. The same
share is measured for lines, and two ratios of characters complete the rules.

Defined results: a null or empty text has no words, fails the base rule and isn't kept; rows are
judged one by one and whole, however long, so repeated rows get equal verdicts; a share at its limit is kept; an empty table gives none;
columns of the input other than those asked for are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessera.llm.common import CONTINUATION, SPACES, per_document

SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
BASE = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Rules:
    """Largest shares, of the characters in words, that a kept document has."""

    #: n-gram length: share inside n-grams that occur twice or more.
    ngrams: dict[int, float] = field(default_factory=lambda: {3: 0.60, 5: 0.40, 8: 0.30, 12: 0.30})
    #: Share in lines that repeat an earlier one.
    lines: float = 0.30
    #: Share of the most frequent word alone; counted from so many words on.
    top_word: float = 0.25
    top_word_from: int = 30
    #: Symbols and capitals A-Z, against all characters in words.
    symbols: float = 0.10
    capitals: float = 0.50
    #: The base rule.
    least_words: int = 20
    window: int = 8
    window_percent: int = 30


def mixed(ids: np.ndarray) -> np.ndarray:
    """A 64-bit value of each word's number that looks random."""
    x = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def covered(h: np.ndarray, n: int, n_words: int) -> np.ndarray | None:
    """Which words lie in an n-gram whose hash occurs twice or more; None: no word."""
    s = np.sort(h)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return None
    edges = np.zeros(n_words + 1, np.int64)
    at = np.flatnonzero(np.isin(h, twice))
    edges[at] += 1
    np.add.at(edges, at + n, -1)
    return np.cumsum(edges[:-1]) > 0


def measure(raw: bytes, rules: Rules) -> tuple:
    words = raw.split()
    n = len(words)
    in_words = raw.translate(None, SPACES)
    chars = len(in_words.translate(None, CONTINUATION))
    symbols = len(in_words) - len(in_words.translate(None, SYMBOLS))
    capitals = len(in_words) - len(in_words.translate(None, UPPER))
    lines = [x for x in raw.split(b"\n") if x.translate(None, SPACES)]
    dup_lines, dup_line_chars = len(lines) - len(set(lines)), 0
    if dup_lines:
        seen: set[bytes] = set()
        for x in lines:
            if x in seen:
                dup_line_chars += len(x.translate(None, SPACES + CONTINUATION))
            seen.add(x)
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    w, width = mixed(ids), None
    shares, repeat_words, h = {}, 0, np.zeros(n, np.uint64)
    for k in range(1, max([rules.window, *rules.ngrams]) + 1):
        if k > n:
            break
        h = h[: n - k + 1] * BASE + w[k - 1 :]
        if k != rules.window and k not in rules.ngrams:
            continue
        if (inside := covered(h, k, n)) is None:
            continue
        if k == rules.window:
            repeat_words = int(inside.sum())
        if width is None:
            width = np.fromiter((len(x.translate(None, CONTINUATION)) for x in words), np.int64, n)
        shares[k] = float(width[inside].sum()) / chars
    top = 0.0
    if n >= rules.top_word_from:
        counts = np.bincount(ids)
        top = float(counts.max()) / n
    failed = n < rules.least_words or 100 * repeat_words > rules.window_percent * n
    dup_share = dup_line_chars / chars if chars else 0.0
    why = [f"{k}-grams" for k, most in rules.ngrams.items() if shares.get(k, 0.0) > most]
    why += ["lines"] * (dup_share > rules.lines) + ["top word"] * (top > rules.top_word)
    why += ["symbols"] * (symbols > rules.symbols * chars) + ["capitals"] * (capitals > rules.capitals * chars)
    why = (["few words"] if n < rules.least_words else []) + (["windows"] if 100 * repeat_words > rules.window_percent * n else []) + why
    coverage = max([dup_share, *shares.values()])
    return n, chars, symbols, dup_lines, repeat_words, failed, not why, coverage, ", ".join(why)


FIELDS = [
    T.StructField("n_words", T.LongType()), T.StructField("word_chars", T.LongType()), T.StructField("n_symbols", T.LongType()), T.StructField("n_dup_lines", T.LongType()),
    T.StructField("n_repeat_words", T.LongType()), T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType()), T.StructField("coverage", T.DoubleType()), T.StructField("reasons", T.StringType()),
]


def quality_rules(docs: DataFrame, keep: list[str] | None = None, rules: Rules | None = None) -> DataFrame:
    """Measures and verdict for each row of docs(text, ...), beside the columns named in keep. No shuffle."""
    rules = rules or Rules()
    return per_document(docs, keep or ["doc_id"], FIELDS, lambda raw: measure(raw, rules))
