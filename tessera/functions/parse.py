"""Numbers, places and marks in listing text, as Columns. What can't be read is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import rules
from tessera.functions.text import contains_any

#: What a land-register number follows and looks like, and number words in order.
KW = r"(?iU)(?:KW|księg[aię]\s*wieczysta|ksi[eę]g[aię]\s*wiecz)\s*(?:nr|numer|:)?\s*([A-Z]{2}\d[A-Z]?/\d{8}/\d)"
#: What every number ends in: few texts have it, so the rest is looked for in few.
KW_END = r"(?U)/\d{8}/\d"
NUMBER_WORDS = ["ONE", "TWO", "THREE", "FOUR", "FIVE", "SIX", "SEVEN", "EIGHT", "NINE", "TEN", "ELEVEN", "TWELVE"]


def once(x: Column, f) -> Column:
    """f of a value that is made once, however often f asks for it: Spark makes it anew in each branch of a condition."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def number(x: Column) -> Column:
    return x.try_cast("double")


def _digits(x: Column) -> Column:
    return F.replace(F.regexp_replace(x, r"[^\d,.]", ""), F.lit(","), F.lit("."))


def olx_price(x: Column) -> Column:
    """'150 000 zł', '150.000', '1.250.000,00': separators of thousands go; under 100 (but not 0) isn't a price."""

    def value(t: Column) -> Column:
        dots = F.length(t) - F.length(F.replace(t, F.lit("."), F.lit("")))
        thousands = (dots > 1) | (dots == 1) & (F.length(F.substring_index(t, ".", -1)) == 3)
        return number(F.when(thousands, F.replace(t, F.lit("."), F.lit(""))).otherwise(t))

    return once(once(_digits(F.regexp_replace(x, "do negocjacji|PLN|zł", "")), value), lambda v: F.when((v >= 100) | (v == 0), v))


def digits_price(x: Column) -> Column:
    return number(F.regexp_replace(x, r"[^\d]", ""))


def plain_price(x: Column) -> Column:
    """Comma for dot, no rule for thousands: 1.099.000 is null."""
    return number(_digits(x))


def area(x: Column) -> Column:
    return number(F.replace(F.regexp_extract(x, r"([\d,.]+)\s*m", 1), F.lit(","), F.lit(".")))


def first_int(x: Column) -> Column:
    return F.regexp_extract(x, r"(\d+)", 1).try_cast("int")


def rooms(x: Column) -> Column:
    """A number, or an English one to twelve."""
    word = F.array_position(F.array(*map(F.lit, NUMBER_WORDS)), F.upper(x))
    return F.coalesce(F.when(x.rlike(r"^\d+(\.\d+)?$"), number(x).cast("int")), F.when(word > 0, word.cast("int")))


def _parts(x: Column) -> Column:
    return F.transform(F.split(F.coalesce(x, F.lit("")), ","), lambda p: F.trim(p))


def location(x: Column, dialect: str) -> tuple[Column, Column]:
    """City and voivodeship. olx, gratka: first and last; morizon: of four or more the last two; domiporta: city after the kind of property."""
    if dialect == "domiporta":
        return F.get(_parts(F.regexp_replace(x, r"(?iU)^(mieszkanie|dom|lokal|działka)\s+", "")), F.lit(0)), F.lit("")
    p = _parts(x)
    n, last = F.size(p), F.element_at(p, -1)
    city = F.when(n >= 4, F.get(p, n - 2)).otherwise(F.get(p, F.lit(0))) if dialect == "morizon" else F.get(p, F.lit(0))
    return city, F.when(n > 1, last).otherwise(F.lit(""))


def before_date(x: Column) -> Column:
    return F.substring_index(x, " - ", 1)


def marked_share(title: Column) -> Column:
    return contains_any(F.lower(title), rules.SHARE_WORDS)


def first_fraction(x: Column) -> Column:
    f = F.regexp_extract(x, r"(\d+/\d+)", 1)
    return F.when(f != "", f)


def land_register(x: Column, *, masked: bool = True) -> Column:
    """The land-register number; masked but for the court's code unless asked otherwise, as it points to persons."""
    kw = F.regexp_extract(x, KW, 1)
    return F.when(x.rlike(KW_END) & (kw != ""), F.concat(F.substring_index(kw, "/", 1), F.lit("/********/*")) if masked else kw)


def parameters(lines: Column) -> Column:
    """'Key: value' lines as a map with lower-case keys; the last one of a key wins."""
    pairs = F.filter(F.transform(lines, lambda s: F.split(s, ":", 2)), lambda p: F.size(p) == 2)
    entries = F.transform(pairs, lambda p: F.struct(F.lower(F.trim(p[0])).alias("k"), F.trim(p[1]).alias("v")))
    keys = F.array_distinct(F.transform(entries, lambda e: e["k"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(entries, lambda e: e["k"] == k), -1)["v"]))


def typed_number(x: Column) -> Column:
    """What a user types: '200 000', '200k'."""
    t = F.lower(F.regexp_replace(x, r"(?U)[\s,]+", ""))
    return F.when(t.rlike(r"^\d+k$"), F.regexp_replace(t, "k", "000")).otherwise(t).try_cast("int")


def action_filters(x: Column) -> Column:
    """'[ACTION:filters k=v k=v]' in a reply: its pairs as a map, under the engine's names."""
    body = F.regexp_extract(x, r"\[ACTION:filters\s+([^\]]*)\]", 1)
    named = body
    for old, new in (("price_max=", "filter_price_max="), ("price_min=", "filter_price_min="), ("city=", "filter_city="), ("radius=", "filter_radius=")):
        named = F.regexp_replace(named, rf"(?<![\w]){old}", new)
    return F.when(body != "", F.str_to_map(F.trim(named), F.lit(r"\s+"), F.lit("=")))
