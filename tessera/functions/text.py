"""Text as Columns: normal form, ids, and patterns that treat all letters alike."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

PLAIN, MARKED = "acelnoszz", "ąćęłńóśźż"


def words(pattern: str) -> str:
    """A pattern for Spark that ignores case and knows the letters and spaces of every script."""
    return f"(?iU){pattern}"


def filled(x: Column) -> Column:
    """x without space around it; null where nothing is left."""
    t = F.trim(F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    return F.when(t != "", t)


def composed(x: Column) -> Column:
    """The composed form of accents, which Spark has no function for."""

    def nfc(t: pd.Series) -> pd.Series:
        return t.map(lambda v: None if v is None else unicodedata.normalize("NFC", v))

    return F.pandas_udf(nfc, "string")(x)


def normalized(x: Column, *, compose: bool = False) -> Column:
    """Lower case, single spaces, none around. compose: also the composed form of accents, for text with loose marks."""
    t = F.lower(F.coalesce(x, F.lit("")))
    if compose:  # only texts with loose marks are sent to Python, the others' rows as nulls
        t = F.coalesce(composed(F.when(t.rlike(r"\p{M}"), t)), t)
    return F.trim(F.regexp_replace(t, r"(?U)\s+", " "))


def without_marks(x: Column) -> Column:
    """Lower case, the nine Polish letters without their marks."""
    return F.translate(F.lower(x), MARKED, PLAIN)


def listing_id(url: Column) -> Column:
    return F.substring(F.sha1(F.coalesce(url, F.lit("")).cast("binary")), 1, 12)


def contains_any(x: Column, needles: list[str]) -> Column:
    out = F.lit(False)
    for n in needles:
        out = out | x.contains(n)
    return out


def escaped(x: Column) -> Column:
    """HTML-escaped."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x
