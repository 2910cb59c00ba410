"""Model replies about listings: reading, repairing, checking, choosing. No model is called."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a reply must name, and the values it may give.
REQUIRED = ["is_real_share", "confidence", "stars", "summary", "fraction", "property_type", "seller_motivation", "estimated_value_total", "price_assessment", "risks"]
PROPERTY_TYPES = ["mieszkanie", "działka", "kamienica", "dom", "lokal", "grunt", "inne"]
MOTIVATIONS = ["spadek", "syndyk", "rozwód", "zadłużenie", "egzekucja", "inne"]
PRICES = ["okazja", "uczciwa", "droga"]
OBJECT = r"(?s)\{[^{}]*(?:\{[^{}]*\}[^{}]*)*\}"


def repaired(raw: Column) -> Column:
    """A reply as VARIANT: as it is without its fence; else with JSON's words for Python's; else without trailing
    commas; else the first object in it; else null."""
    text = F.trim(raw)
    text = F.when(text.startswith("```"), F.trim(F.regexp_replace(F.regexp_replace(text, r"^[^\n]*(\n|$)", ""), r"\n?[^\S\n]*```[^\n]*$", ""))).otherwise(text)
    named = text
    for a, b in (("True", "true"), ("False", "false"), ("None", "null")):
        named = F.regexp_replace(named, rf"\b{a}\b", b)
    bare = F.regexp_replace(named, r",\s*([}\]])", "$1")
    return F.coalesce(*(F.try_parse_json(x) for x in (text, named, bare)), F.try_parse_json(F.regexp_extract(bare, OBJECT, 0)))


def get(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def checked(df: DataFrame, reply: str = "reply") -> DataFrame:
    """df with the fields of a valid reply (a VARIANT object with all REQUIRED keys), and valid."""
    v = F.col(reply)
    text = v.cast("string")
    keys = F.json_object_keys(F.to_json(v))
    complete = F.coalesce(F.size(F.array_intersect(keys, F.array(*map(F.lit, REQUIRED)))) == len(REQUIRED), F.lit(False))
    num = lambda k: F.coalesce(get(v, f"$.{k}", "double"), get(v, f"$.{k}", "string").try_cast("double"))
    flag = F.coalesce(get(v, "$.is_real_share", "boolean"), get(v, "$.is_real_share", "double") != 0, get(v, "$.is_real_share", "string") != "", F.lit(False))
    fraction = get(v, "$.fraction", "string")
    one_of = lambda k, values, otherwise: F.when(get(v, f"$.{k}", "string").isin(values), get(v, f"$.{k}", "string")).when(get(v, f"$.{k}", "string").isNotNull(), otherwise)
    risks = F.coalesce(get(v, "$.risks", "array<string>"), F.when(get(v, "$.risks", "string").isNotNull() & ~F.coalesce(get(v, "$.risks", "string").startswith("{"), F.lit(False)), F.array(get(v, "$.risks", "string"))), F.array().cast("array<string>"))
    value = num("estimated_value_total")
    fine = complete & num("confidence").isNotNull() & num("stars").isNotNull() & (get(v, "$.estimated_value_total", "string").isNull() | value.isNotNull())
    made = {
        "is_real_share": flag, "confidence": F.greatest(F.lit(0.0), F.least(F.lit(1.0), num("confidence"))), "stars": F.greatest(F.lit(1), F.least(F.lit(5), num("stars").cast("int"))),
        "summary": F.coalesce(get(v, "$.summary", "string"), F.lit("")), "fraction": F.when(fraction.rlike(r"^\d+/\d+$"), fraction), "property_type": one_of("property_type", PROPERTY_TYPES, "inne"),
        "seller_motivation": one_of("seller_motivation", MOTIVATIONS, "inne"), "estimated_value_total": value.cast("long"), "price_assessment": one_of("price_assessment", PRICES, None), "risks": F.slice(risks, 1, 5),
    }
    return df.withColumn("valid", F.coalesce(fine, F.lit(False)) & text.isNotNull()).withColumns({k: F.when(F.col("valid"), c) for k, c in made.items()})


def completion(envelope: Column, shape: str) -> dict[str, Column]:
    """content, model, tokens and finish of a provider's answer. shape: choices, or blocks (text blocks joined)."""
    v = F.try_parse_json(envelope)
    if shape == "choices":
        found = {"content": "$.choices[0].message.content", "finish": "$.choices[0].finish_reason", "input_tokens": "$.usage.prompt_tokens", "output_tokens": "$.usage.completion_tokens"}
        content = F.coalesce(get(v, found["content"], "string"), F.lit(""))
    else:
        found = {"finish": "$.stop_reason", "input_tokens": "$.usage.input_tokens", "output_tokens": "$.usage.output_tokens"}
        blocks = F.from_json(F.get_json_object(envelope, "$.content"), "array<struct<type:string,text:string>>")
        content = F.coalesce(F.array_join(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: b["text"]), ""), F.lit(""))
    tokens = {k: F.coalesce(get(v, found[k], "int"), F.lit(0)) for k in ("input_tokens", "output_tokens")}
    return {"content": content, "model": get(v, "$.model", "string"), **tokens, "finish": get(v, found["finish"], "string")}


def request(model: Column, system: Column, prompt: Column, shape: str, max_tokens: int = 1024) -> Column:
    """The body of a request, as JSON text: the system message among the others, or beside them."""
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    if shape == "choices":
        return F.to_json(F.struct(model.alias("model"), F.array(message("system", system), message("user", prompt)).alias("messages"), F.lit(max_tokens).alias("max_tokens")))
    return F.to_json(F.struct(model.alias("model"), system.alias("system"), F.array(message("user", prompt)).alias("messages"), F.lit(max_tokens).alias("max_tokens")))


def first_valid(responses: DataFrame) -> DataFrame:
    """Of landed responses(listing_id, provider, priority, enabled, attempt, http_status, valid): the answer that a chain
    of fallbacks would have taken. Providers go by priority; a provider is tried three times where it said 429,
    twice where it failed (5xx, or 0 for a timeout), once otherwise; one that said 401 is off for the listing."""
    tries = F.when(F.col("http_status") == 429, 3).when((F.col("http_status") >= 500) | (F.col("http_status") == 0), 2).otherwise(1)
    allowed = responses.where(F.col("enabled") & (F.col("attempt") <= tries) | F.col("enabled") & (F.col("http_status") == 200) & (F.col("attempt") <= 3))
    good = allowed.where((F.col("http_status") == 200) & F.col("valid"))
    off = responses.where("http_status = 401").groupBy("listing_id", "provider").agg(F.min("attempt").alias("_off"))
    good = good.join(off, ["listing_id", "provider"], "left").where("_off IS NULL OR attempt < _off").drop("_off")
    order = F.struct("priority", "provider", "attempt")
    return good.groupBy("listing_id").agg(F.min_by(F.struct("provider", "priority", "attempt"), order).alias("x")).select("listing_id", "x.*")


def backoff(attempt: Column, base: float = 1.0, factor: float = 2.0, most: float = 30.0) -> Column:
    """Seconds to wait before a retry, without jitter."""
    return F.least(F.lit(most), F.lit(base) * F.pow(F.lit(factor), attempt - 1))


def prompt(title: Column, text: Column, price: Column, place: Column, area: Column) -> Column:
    """What is asked about a listing; text up to 1500 characters, a default for what isn't known."""
    known = lambda x: F.coalesce(F.when(F.trim(x) != "", x), F.lit("brak danych"))
    return F.concat_ws("\n", F.concat(F.lit("Tytuł: "), known(title)), F.concat(F.lit("Opis: "), known(F.substring(text, 1, 1500))), F.concat(F.lit("Cena: "), known(price)), F.concat(F.lit("Lokalizacja: "), known(place)), F.concat(F.lit("Powierzchnia: "), known(area)))


def tool_calls(envelope: Column) -> Column:
    """Name and arguments (JSON text) of the calls that a chat answer asks for."""
    calls = F.from_json(F.get_json_object(envelope, "$.choices[0].message.tool_calls"), "array<struct<function:struct<name:string,arguments:string>>>")
    return F.coalesce(F.transform(calls, lambda c: F.struct(c["function"]["name"].alias("name"), c["function"]["arguments"].alias("arguments"))), F.array().cast("array<struct<name:string,arguments:string>>"))


CONFIG = "enabled boolean, max_concurrent int, timeout double, temperature double, max_tokens int, api_key string, base_url string, model string, providers array<struct<name string, api_key string, model string, enabled boolean, priority int>>"
#: What an address says of its provider, first match wins; and the defaults.
PROVIDERS = [("deepseek", "deepseek"), ("generativelanguage.googleapis", "gemini"), ("anthropic", "anthropic"), ("localhost:11434", "ollama"), ("localhost:1234", "lmstudio")]
PROVIDER, MODEL = "openai", "gpt-4o-mini"


def provider_settings(config: Column) -> Column:
    """Of a configuration in JSON: providers (name, model, enabled, priority) and limits; null where it is off or has no key. Keys are left out."""
    c = F.from_json(config, CONFIG)
    named = F.lit(PROVIDER)
    for part, name in reversed(PROVIDERS):
        named = F.when(c["base_url"].contains(part), name).otherwise(named)
    one = lambda name, model, enabled, priority: F.struct(name.alias("name"), model.alias("model"), enabled.alias("enabled"), priority.cast("int").alias("priority"))
    known = F.transform(c["providers"], lambda p, i: F.when(p["api_key"] != "", one(F.coalesce(p["name"], F.lit(PROVIDER)), F.coalesce(p["model"], F.lit(MODEL)), F.coalesce(p["enabled"], F.lit(True)), F.coalesce(p["priority"], i + 1))))
    single = F.when(c["api_key"] != "", F.array(one(named, F.coalesce(c["model"], F.lit(MODEL)), F.lit(True), F.lit(1))))
    found = F.when(c["providers"].isNotNull(), F.filter(known, lambda p: p.isNotNull())).otherwise(single)
    limits = [F.coalesce(c[name], F.lit(default)).alias(name) for name, default in (("max_concurrent", 5), ("timeout", 30.0), ("temperature", 0.3), ("max_tokens", 600))]
    return F.when(c["enabled"] & (F.size(found) > 0), F.struct(found.alias("providers"), *limits))
