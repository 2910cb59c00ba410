"""SQL texts that several oracles share, written apart from the Column code."""

from __future__ import annotations

from tessera.functions import rules
from tessera.plans.views import CITIES_SQL, LISTINGS_SQL


def any_of(x: str, patterns: list[str]) -> str:
    return "(" + " OR ".join(f"regexp_matches({x}, '(?i){p}')" for p in patterns) + ")"


def found(x: str, patterns: list[str]) -> str:
    return "list_filter([" + ", ".join(f"regexp_extract({x}, '(?i){p}')" for p in patterns) + "], lambda m: m <> '')"


def norm(x: str) -> str:
    return f"trim(regexp_replace(nfc_normalize(lower(coalesce({x}, ''))), '[\\s\\x0B\\x{{85}}\\p{{Z}}]+', ' ', 'g'))"


def tier(x: str, points: tuple[int, int, int]) -> str:
    return f"CASE WHEN {any_of(x, rules.HIGH)} THEN {points[0]} WHEN {any_of(x, rules.MEDIUM)} THEN {points[1]} WHEN {any_of(x, rules.LOW)} THEN {points[2]} ELSE 0 END"


def fraction(x: str) -> str:
    whens = " ".join(f"WHEN regexp_matches({x}, '\\b{f.split('/')[0]}\\s*/\\s*{f.split('/')[1]}\\b') THEN '{f}'" for f in rules.FRACTIONS)
    every = f"list_transform(regexp_extract_all({x}, '\\b\\d{{1,3}}\\s*/\\s*\\d{{1,4}}\\b'), lambda m: regexp_replace(m, '\\s*/\\s*', '/'))"
    fine = f"list_filter({every}, lambda m: split_part(m, '/', 1)::INT > 0 AND split_part(m, '/', 1)::INT < split_part(m, '/', 2)::INT AND split_part(m, '/', 2)::INT <= 1000)[1]"
    glyphs = " ".join(f"WHEN contains({x}, '{g}') THEN '{f}'" for g, f in rules.GLYPHS)
    return f"coalesce(CASE {whens} END, {fine}, CASE {glyphs} END)"


INHERITED = "least(10, 3 * (" + " + ".join(f"regexp_matches(c, '(?i){p}')::INT" for p in rules.INHERITANCE) + "))"
PENALTY = "(" + " + ".join(f"CASE WHEN regexp_matches(c, '(?i){p}') THEN {n} ELSE 0 END" for p, n in rules.PENALTIES) + ")"
#: seq and the parts of the score.
PARTS_SQL = f"""parts AS (
  SELECT *, {tier('t', rules.TITLE_POINTS)} AS title_points, {tier('d', rules.TEXT_POINTS)} AS text_points, {fraction('c')} AS fraction_detected, {INHERITED} AS inheritance_points,
    CASE WHEN regexp_matches(c, '(?i)syndyk') AND regexp_matches(c, '(?i)udzia[łl]') THEN 20 ELSE 0 END AS trustee_points, {PENALTY} AS penalty_points,
    CASE WHEN area > 0 AND price / area < 3000 THEN 8 ELSE 0 END AS price_points
  FROM (SELECT *, t || ' ' || d AS c FROM (SELECT *, {norm('title')} AS t, {norm('raw_description')} AS d FROM listings)))"""
SCORED_SQL = f"""{PARTS_SQL}, scored AS (
  SELECT *, score >= 25 AS is_share FROM (
    SELECT *, greatest(0, least(100, title_points + text_points + CASE WHEN fraction_detected IS NULL THEN 0 ELSE 15 END + inheritance_points + trustee_points + penalty_points)) AS score FROM parts))"""


def kind(x: str, kinds: list[tuple[str, str]]) -> str:
    spaced = [(n, p.replace(r"\s", r"[\s\x{85}\p{Z}]")) for n, p in kinds]
    return "CASE " + " ".join(f"WHEN regexp_matches({x}, '(?i){p}') THEN '{n}'" for n, p in spaced) + " ELSE 'inne' END"


_ratio = "(CASE WHEN fraction IS NULL THEN NULL ELSE split_part(fraction, '/', 1)::DOUBLE / split_part(fraction, '/', 2)::DOUBLE END)"
CLASSIFIED_SQL = f"""{SCORED_SQL}, base AS (
  SELECT *, CASE WHEN score >= 75 THEN 'pewny' WHEN score >= 50 THEN 'prawdopodobny' ELSE 'mozliwy' END AS tier, lower(title || ' ' || raw_description) AS text FROM scored WHERE score >= 25
), fr AS (
  SELECT *, regexp_extract(text, '\\b(\\d+)\\s*/\\s*(\\d+)\\b', ['n', 'd']) AS m FROM base
), kinds AS (
  SELECT * EXCLUDE (m), {kind('text', rules.SALE_SOURCES)} AS share_source, {kind('title', rules.PROPERTY_TYPES)} AS property_type,
    coalesce(fraction_detected, CASE WHEN try_cast(m.d AS INT) >= 2 AND try_cast(m.n AS INT) < try_cast(m.d AS INT) AND try_cast(m.n AS INT) > 0 THEN try_cast(m.n AS INT) || '/' || try_cast(m.d AS INT) END,
      CASE WHEN contains(text, '½') THEN '1/2' WHEN contains(text, '⅓') THEN '1/3' WHEN contains(text, '¼') THEN '1/4' WHEN contains(text, '¾') THEN '3/4' WHEN contains(text, '⅔') THEN '2/3' END) AS fraction,
    CASE WHEN price < 1000 THEN NULL WHEN price < 30000 THEN 'do_30k' WHEN price < 100000 THEN '30_100k' WHEN price < 300000 THEN '100_300k' ELSE 'powyżej_300k' END AS price_bracket
  FROM fr
), classified AS (
  SELECT *, CASE WHEN {_ratio} >= 0.5 THEN 'duży' WHEN {_ratio} >= 0.25 THEN 'średni' WHEN {_ratio} IS NOT NULL THEN 'mały' END AS fraction_size,
    least(1.0::DOUBLE, CASE WHEN price > 1000 THEN greatest(0.0::DOUBLE, 1 - price / 500000) * 0.35::DOUBLE ELSE 0 END + score / 100 * 0.30::DOUBLE
      + CASE WHEN fraction IS NULL THEN 0 ELSE 0.15::DOUBLE + coalesce({_ratio}, 0) * 0.10::DOUBLE END + CASE WHEN contains(text, 'syndyk') THEN 0.10::DOUBLE ELSE 0 END) AS attractiveness,
    CASE tier WHEN 'pewny' THEN 1 WHEN 'prawdopodobny' THEN 2 ELSE 3 END AS tier_n
  FROM kinds)"""


def with_(*parts: str, select: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' * recursive}" + ",\n".join(parts) + "\n" + select


def listings(select: str) -> str:
    return with_(LISTINGS_SQL, select=select)


def scored(select: str) -> str:
    return with_(LISTINGS_SQL, SCORED_SQL, select=select)


def classified(select: str) -> str:
    return with_(LISTINGS_SQL, CLASSIFIED_SQL, select=select)


def haversine(a: str, b: str, c: str, d: str) -> str:
    h = f"(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2))"
    return f"(2 * 6371.0 * atan2(sqrt({h}), sqrt(1 - {h})))"


__all__ = ["CITIES_SQL", "CLASSIFIED_SQL", "LISTINGS_SQL", "SCORED_SQL"]
