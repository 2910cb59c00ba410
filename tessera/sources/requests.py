"""What a source is asked for: filters as its own parameters, so that it sends no rows that are filtered out later."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Request:
    """Address, fixed parameters around the keyword's, and the source's name for each filter, in order."""

    url: str
    keyword: str
    fixed: tuple[tuple[str, str], ...]
    filters: tuple[tuple[str, str], ...]


#: The sources' addresses and parameters.
REQUESTS = {
    "nieruchomosci_online": Request("https://www.nieruchomosci-online.pl/szukaj.html", "text", (), (("price_min", "3_price_from"), ("price_max", "3_price_to"), ("city", "1_location"), ("area_min", "3_area_from"), ("area_max", "3_area_to"))),
    "szybko": Request("https://www.szybko.pl/szukaj", "q", (("type", "nieruchomosci"),), (("price_min", "price_from"), ("price_max", "price_to"), ("city", "city"), ("area_min", "area_from"), ("area_max", "area_to"))),
    "allegro": Request("https://api.allegro.pl", "phrase", (("category.id", "100249"), ("sort", "-relevance"), ("limit", "50")), (("price_min", "price.from"), ("price_max", "price.to"), ("city", "location.city"))),
}


def encoded(x: Column) -> Column:
    """As in a form: blanks as plus, and only letters, digits and _ . - ~ as they are."""
    return F.replace(F.replace(F.url_encode(x), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def parameters(source: str, keyword: Column, filters: Column) -> Column:
    """The source's parameters as a map; filters: a map from names to texts, of which the source takes those it knows."""
    r = REQUESTS[source]
    pairs = [F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in [(r.keyword, keyword), *((k, F.lit(v)) for k, v in r.fixed), *((k, F.try_element_at(filters, F.lit(name))) for name, k in r.filters)]]
    return F.map_from_entries(F.filter(F.array(*pairs), lambda p: p["value"].isNotNull()))


def search_url(source: str, keyword: Column, filters: Column) -> Column:
    """Address and parameters, in the source's order."""
    asked = F.transform(F.map_entries(parameters(source, keyword, filters)), lambda p: F.concat(p["key"], F.lit("="), encoded(p["value"])))
    return F.concat(F.lit(REQUESTS[source].url + "?"), F.array_join(asked, "&"))
