"""The share score: is a listing the sale of a share of a property?

Built from the rule lists as Columns. A text is normalised once, in a projection of its own; a pattern only runs where its
longest literal part stands in the text, which a byte search tells; the score is made behind a generator of one row,
which filters on the score are not pushed through, so that no expression is repeated in them.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import rules
from tessera.functions.text import normalized

TIERS = [rules.HIGH, rules.MEDIUM, rules.LOW]


def plain(pattern: str) -> str:
    """A rule's pattern for normalised text, which is lower-case and has no space but single blanks."""
    return pattern.replace(r"\s+", " ").replace(r"\s*", " ?").replace(r"\d", r"\p{Nd}")


def literal(pattern: str) -> str:
    """The longest run of plain letters of a pattern without alternatives: every match contains it."""
    return max(re.findall("[a-z]+", re.sub(r"\[[^\]]*\]|\\.", " ", pattern)), key=len)


def has(x: str, pattern: str) -> str:
    """SQL text, as all these functions give: the rules are many, and a text is parsed at once where Columns are built one by one."""
    return f"(contains({x}, '{literal(pattern)}') AND {x} RLIKE r'{plain(pattern)}')"


def any_of(x: str, patterns: list[str]) -> str:
    return "(" + " OR ".join(has(x, p) for p in patterns) + ")"


def matches(x: str, patterns: list[str]) -> str:
    """The first match of each pattern that has one, in the patterns' order."""
    each = ", ".join(f"if(contains({x}, '{literal(p)}'), regexp_extract({x}, r'{plain(p)}', 0), '')" for p in patterns)
    return f"filter(array({each}), m -> m <> '')"


def tier(x: str) -> str:
    """The strongest tier with a match, from 1; 0: none."""
    return "CASE " + " ".join(f"WHEN {any_of(x, patterns)} THEN {k}" for k, patterns in enumerate(TIERS, 1)) + " ELSE 0 END"


def tier_points(found: str, points: tuple[int, int, int]) -> str:
    return f"element_at(array({', '.join(map(str, (0, *points)))}), {found} + 1)"


def tier_matches(x: str, found: str) -> str:
    """Matches of the tier that was found."""
    return f"CASE {found} " + " ".join(f"WHEN {k} THEN {matches(x, patterns)}" for k, patterns in enumerate(TIERS, 1)) + " ELSE CAST(array() AS array<string>) END"


def plausible(fraction: Column) -> Column:
    """A share is over 0, under 1, and no court writes a denominator over 1000."""
    n, d = (F.get(F.split(fraction, "/"), F.lit(i)).try_cast("int") for i in (0, 1))
    return (n > 0) & (n < d) & (d <= 1000)


def tight(x: Column) -> Column:
    """Normalised text without the blanks around slashes."""
    return F.replace(F.replace(x, F.lit(" /"), F.lit("/")), F.lit("/ "), F.lit("/"))


def fraction(x: str) -> Column:
    """Of tight text: the common fractions by priority, then the first plausible one, then glyphs."""
    common = F.expr("CASE " + " ".join(rf"WHEN contains({x}, '{f}') AND {x} RLIKE r'(?U)\b{f}\b' THEN '{f}'" for f in rules.FRACTIONS) + " END")
    glyphs = F.expr("CASE " + " ".join(f"WHEN contains({x}, '{g}') THEN '{f}'" for g, f in rules.GLYPHS) + " END")
    first = F.get(F.filter(F.regexp_extract_all(F.col(x), F.lit(r"(?U)\b\d{1,3}/\d{1,4}\b"), F.lit(0)), plausible), F.lit(0))
    return F.coalesce(F.when(F.col(x).contains("/"), F.coalesce(common, first)), glyphs)


def inheritance_points(x: str) -> str:
    return f"least(10, 3 * ({' + '.join(f'int({has(x, p)})' for p in rules.INHERITANCE)}))"


def trustee_points(x: str) -> str:
    return f"IF(contains({x}, 'syndyk') AND {has(x, 'udzia[łl]')}, {rules.TRUSTEE_POINTS}, 0)"


def price_points(price: str | None, area: str | None) -> str:
    return f"IF({area} > 0 AND try_divide({price}, {area}) < {rules.CHEAP_PER_M2}, {rules.PRICE_POINTS}, 0)" if price and area else "0"


def penalty_points(x: str) -> str:
    return " + ".join(f"IF({has(x, p)}, {n}, 0)" for p, n in rules.PENALTIES)


def folded(x: Column) -> Column:
    """Normalised text for the patterns, which ignore case: the long s and the dotless i count as s and i, as upper case says."""
    return F.when(x.rlike("[ſı]"), F.translate(x, "ſı", "si")).otherwise(x)


def scored(df: DataFrame, *, title: str = "title", text: str = "raw_description", price: str | None = None, area: str | None = None, keywords: bool = False, parts: bool = False) -> DataFrame:
    """df with score, is_share and fraction_detected; also matched_keywords, or the points by kind, where asked for.

    price and area are only looked at where named, as the documented pipeline leaves them out.
    """
    out = df.withColumns({"_score_t": normalized(F.col(title), compose=True), "_score_d": normalized(F.col(text), compose=True)})
    out = out.withColumns({"_score_t": folded(F.col("_score_t")), "_score_d": folded(F.col("_score_d"))}).withColumn("_score_c", F.concat_ws(" ", "_score_t", "_score_d")).withColumn("_score_f", tight(F.col("_score_c")))
    t, d, c, in_t, in_d = "_score_t", "_score_d", "_score_c", "_score_tier_t", "_score_tier_d"
    out = out.withColumns({in_t: F.expr(tier(t)), in_d: F.expr(tier(d)), "_score_fraction": fraction("_score_f")})
    points = {
        "title_points": tier_points(in_t, rules.TITLE_POINTS),
        "text_points": tier_points(in_d, rules.TEXT_POINTS),
        "inheritance_points": inheritance_points(c),
        "trustee_points": trustee_points(c),
        "price_points": price_points(price, area),
        "penalty_points": penalty_points(c),
    }
    total = lambda each, one: f"greatest(0, least(100, IF({one} IS NULL, 0, {rules.FRACTION_POINTS}) + {' + '.join(each)}))"
    made = {"fraction_detected": "_score_fraction"}
    if keywords:
        made["matched_keywords"] = f"concat({tier_matches(t, in_t)}, {tier_matches(d, in_d)}, filter(array(_score_fraction), m -> m IS NOT NULL), {matches(c, rules.INHERITANCE)})"
    made |= points if parts else {"score": total(points.values(), "_score_fraction")}
    row = "inline(array(struct(" + ", ".join(f"{x} AS {name}" for name, x in made.items()) + ")))"
    out = out.select(*(F.col(f"`{name}`") for name in df.columns), F.expr(row))
    if parts:
        out = out.withColumn("score", F.expr(total(points, "fraction_detected")))
    return out.select(*(F.col(f"`{name}`") for name in df.columns), *made, *(["score"] if parts else []), (F.col("score") >= rules.SHARE_FROM).alias("is_share"))


def rescored(df: DataFrame, *, full: str = "full_description", least: int = 5) -> DataFrame:
    """Scores again on the full description, and takes the new score where it differs by least points or more.

    df is a scored one; full may be null, then the row stays as it is. Adds score_delta.
    """
    again = scored(df.select("*", F.col("score").alias("_s"), F.col("is_share").alias("_i"), F.col("fraction_detected").alias("_f")).drop("score", "is_share", "fraction_detected"), text=full)
    delta = F.col("score") - F.col("_s")
    take = F.col(full).isNotNull() & (F.abs(delta) >= least)
    return again.select(
        *(c for c in df.columns if c not in ("score", "is_share", "fraction_detected")),
        F.when(take, F.col("score")).otherwise(F.col("_s")).alias("score"),
        F.when(take, F.col("is_share")).otherwise(F.col("_i")).alias("is_share"),
        F.when(take, F.coalesce("fraction_detected", "_f")).otherwise(F.col("_f")).alias("fraction_detected"),
        F.when(take, delta).alias("score_delta"),
    )
