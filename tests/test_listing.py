"""Golden values and edge cases of the listing engine."""

import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.functions import geo, parse, text
from tessera.operators import analysis, classify, commits, filters, render, score, store, tables
from tessera.sources import files, html, json
from tessera.streaming import throttle


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'string' if v is None or isinstance(v, str) else 'double'}" for k, v in values.items()) or "x int"
    return spark.createDataFrame([tuple(values.values()) or (1,)], schema).select(column.alias("v")).first().v


def scored(spark, title, body="", **kw):
    df = spark.createDataFrame([(title, body, 100000.0, 50.0)], "title string, raw_description string, price double, area double")
    return score.scored(df, keywords=True, **kw).first()


@pytest.mark.parametrize(
    ("t", "want"),
    [("udział 1/2", "1/2"), ("udział 3/8 w domu", "3/8"), ("udział 5/12", "5/12"), ("lokal 190/2", None), ("z dnia 1/2024", None), ("działka 759/21, udział 7/12", "7/12"), ("udział ½", "1/2"), ("udział ⅛", "1/8"), ("UDZIAŁ 1 / 3", "1/3"), ("1/6 i 1/2", "1/2"), ("", None)],
)
def test_fractions(spark, t, want):
    assert scored(spark, t).fraction_detected == want


def test_score_tiers_and_bounds(spark):
    assert scored(spark, "Sprzedaż udziału 1/2 w mieszkaniu").score == 50
    assert scored(spark, "Mieszkanie trzypokojowe").score == 0
    assert not scored(spark, "Udziały w spółce").is_share
    full = scored(spark, "Syndyk sprzeda udział 1/2", "Sprzedam udział, księga wieczysta, spadek, testament, notariusz, sąd rejonowy")
    assert full.score == 100 and full.is_share
    assert scored(spark, None, None).score == 0
    assert scored(spark, "Dom", price="price", area="area").score == 8
    assert scored(spark, "UDZIAL W MIESZKANIU").matched_keywords == ["udzial w mieszkaniu"]


def test_fraction_adds_fifteen(spark):
    assert scored(spark, "udział w domu 1/4").score - scored(spark, "udział w domu").score == 15


def test_loose_accents_count(spark):
    import unicodedata

    one = scored(spark, unicodedata.normalize("NFD", "Współwłasność sprzedam"))
    assert one.score == 35 and one.is_share and one.matched_keywords == ["współwłasność sprzeda"]


def test_each_pattern_stands_once_in_the_plan(spark):
    """A filter on the score isn't pushed below what makes it, which would test every pattern again."""
    from tessera.functions import rules

    df = spark.createDataFrame([("a", "b")], "title string, raw_description string")
    plan = score.scored(df).where("is_share").groupBy("score").count()._jdf.queryExecution().optimizedPlan().toString()
    patterns = 2 * sum(map(len, score.TIERS)) + len(rules.INHERITANCE) + len(rules.PENALTIES) + len(rules.FRACTIONS) + 1
    assert plan.count("RLIKE") <= patterns + 4 and plan.count("regexp_replace") == 2


def test_every_literal_is_in_what_its_pattern_matches():
    for p in [*rules_patterns()]:
        assert score.literal(p) and "|" not in p and "(" not in p


def rules_patterns():
    from tessera.functions import rules

    return [*rules.HIGH, *rules.MEDIUM, *rules.LOW, *rules.INHERITANCE, *(p for p, _ in rules.PENALTIES), *(a for _, p in [*rules.SALE_SOURCES, *rules.PROPERTY_TYPES] for a in p.split("|"))]


def test_rescore_needs_five_points(spark):
    df = score.scored(spark.createDataFrame([(1, "Dom", "", "x"), (2, "Dom", "", "sprzedam udział 1/2"), (3, "Dom", "", None)], "seq int, title string, raw_description string, full_description string"))
    out = {r.seq: r for r in score.rescored(df).collect()}
    assert (out[1].score, out[2].score, out[3].score) == (0, 40, 0) and out[2].score_delta == 40 and out[3].score_delta is None


def test_classes(spark):
    f = lambda c, **v: one(spark, c, **v)
    assert f(classify.fraction_size(F.col("x")), x="1/3") == "średni" and f(classify.fraction_size(F.col("x")), x="1/0") is None
    assert f(classify.price_bracket(F.col("x")), x=999.0) is None and f(classify.price_bracket(F.col("x")), x=300000.0) == "powyżej_300k"
    assert f(classify.fallback_fraction(F.col("x")), x="lokal 5/3 ¼") == "1/4"
    assert f(classify.first_kind("x", [("dom", r"\bdom\b")]), x="domł") == "inne"


@pytest.mark.parametrize(("t", "want"), [("150 000 zł", 150000.0), ("150.000", 150000.0), ("1.250.000,00", 125000000.0), ("99 zł", None), ("0", 0.0), ("", None), ("12,5 zł", None), ("1500,50", 1500.5)])
def test_olx_price(spark, t, want):
    assert one(spark, parse.olx_price(F.col("x")), x=t) == want


def test_parsers(spark):
    assert one(spark, parse.plain_price(F.col("x")), x="1.099.000") is None
    assert one(spark, parse.area(F.col("x")), x="ok. 45,5 m²") == 45.5
    assert one(spark, parse.rooms(F.col("x")), x="two") == 2
    assert one(spark, parse.land_register(F.col("x")), x="KW nr WA1M/12345678/9") == "WA1M/********/*"
    assert one(spark, text.normalized(F.col("x"), compose=True), x=" Łódz  X ") == "łódz x"


@pytest.mark.parametrize(("a", "b", "lo", "hi"), [((52.2297, 21.0122), (50.0647, 19.945), 250, 255), ((54.352, 18.6466), (54.5189, 18.5305), 19, 21), ((0, 0), (0, 0), 0, 0)])
def test_distances(spark, a, b, lo, hi):
    d = lambda p, q: one(spark, geo.haversine(*(F.lit(float(x)) for x in (*p, *q))))
    assert lo <= d(a, b) <= hi and d(a, b) == pytest.approx(d(b, a))
    assert d((91, 0), b) is None


def test_radius(spark):
    df = spark.createDataFrame([(1, 52.23, 21.01), (2, None, None), (3, 50.06, 19.94), (4, 95.0, 0.0)], "seq int, latitude double, longitude double")
    assert [r.seq for r in filters.by_radius(df, 52.2297, 21.0122, 10).collect()] == [1]
    assert filters.by_radius(df, 52.2297, 21.0122, 0).isEmpty()


@pytest.mark.parametrize("km", [5.0, 40.0, 700.0, 9000.0, 15000.0])
def test_near_centres_anywhere(spark, km):
    """All pairs that the distance says, near the poles and over the antimeridian too."""
    import math
    import random

    r = random.Random(3)
    near = [(85.0, 0.0), (85.0, 3.5), (89.99, 10.0), (89.99, -170.0), (0.0, 179.99), (0.1, -179.95), (-60.0, 180.0), (-60.1, -180.0), (90.0, 5.0), (52.2, 21.0), (52.3, 21.2)]
    points = near + [(r.uniform(-90, 90), r.uniform(-180, 180)) for _ in range(60)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(points)] + [(-1, None, 1.0), (-2, 91.0, 1.0)], "seq int, latitude double, longitude double")
    centres = spark.createDataFrame([(i, *p) for i, p in enumerate(points[:25])], "centre int, lat double, lon double")

    def d(p, q):
        a, b = math.radians(p[0]), math.radians(q[0])
        h = math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin(math.radians(q[1] - p[1]) / 2) ** 2
        return 2 * 6371.0 * math.atan2(math.sqrt(h), math.sqrt(max(0.0, 1 - h)))

    want = sorted((i, j) for i, p in enumerate(points) for j, q in enumerate(points[:25]) if d(p, q) <= km)
    assert sorted((x.seq, x.centre) for x in filters.near_centres(df, centres, km).collect()) == want


def test_numbers_go_on_in_order(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("seq"))
    out = store.consecutive(df, "seq", "n", 10).orderBy("seq").collect()
    assert [r.n for r in out] == list(range(11, 5011)) and store.consecutive(df.where("false"), "seq", "n").count() == 0


def test_keyword_table(spark):
    df = spark.createDataFrame([(1, "Dom z ogrodem"), (2, "ab"), (3, None), (4, "")], "seq int, title string")
    words = spark.createDataFrame([("DOM",), ("o",), ("ab",), ("abc",), ("z ogrod",), ("",), (None,), ("o",)], "keyword string")
    assert sorted((r.seq, r.keyword) for r in filters.with_keywords(df, words).collect()) == [(1, "DOM"), (1, "o"), (1, "z ogrod"), (2, "ab")]


def test_keywords_that_begin_alike(spark):
    """Pairs are fetched by whole keywords, so 40,000 under one beginning cost about what 40 do; also by a join that isn't broadcast."""
    df = spark.range(20_000).select("id", F.concat(F.lit("Dom ABC"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("title"))
    words = lambda n: spark.range(n).select(F.concat(F.lit("abc"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("keyword"))
    assert filters.with_keywords(df, words(40)).count() == 40
    at = time.monotonic()
    assert filters.with_keywords(df, words(40)).count() == 40
    few = time.monotonic() - at
    at = time.monotonic()
    assert filters.with_keywords(df, words(40_000)).count() == 20_000
    assert time.monotonic() - at < 5 * few + 3


def test_long_keywords_and_many(spark, monkeypatch):
    monkeypatch.setattr(filters, "BROADCAST_CHARS", 0)
    df = spark.createDataFrame([(1, "Mieszkanie nr 11 mieszkań, İ"), (2, "nr 111"), (3, None)], "seq int, title string")
    words = spark.createDataFrame([("mieszkanie NR 11",), ("Mieszkan",), ("mieszkaniec",), ("1",), ("11",), ("111",), ("1 m",), ("NR",), ("nr",), ("İ",)], "keyword string")
    assert sorted((r.seq, r.keyword) for r in filters.with_keywords(df, words).collect()) == [(1, "1"), (1, "1 m"), (1, "11"), (1, "Mieszkan"), (1, "NR"), (1, "mieszkanie NR 11"), (1, "nr"), (1, "İ"), (2, "1"), (2, "11"), (2, "111"), (2, "NR"), (2, "nr")]
    assert filters.with_keywords(df, words.where("keyword = ''")).count() == 0


def test_long_page_is_read_whole(spark):
    page = "<p>" + "x" * 5_100_000 + '</p><a href="/d/oferta/1">Dłuższy tytuł</a>'
    df = spark.createDataFrame([(1, "olx", page)], "page_id int, portal string, html string")
    assert html.search_results(df).count() == 1


def test_unknown_city_filters_nothing(spark):
    df = spark.createDataFrame([(1, 52.2, 21.0, "Warszawa", "mazowieckie")], "seq int, latitude double, longitude double, city string, voivodeship string")
    cities = spark.createDataFrame([("Łódź", 51.7, 19.4, "łódzkie", 1)], json.CITY)
    assert filters.by_location(df, cities, city="Nigdzie", km=5).count() == 1
    assert filters.by_location(df, cities, city="lodz", km=5).count() == 0


def test_dedup_is_idempotent(spark):
    df = spark.createDataFrame([(1, "olx", "u"), (2, "otodom", "u"), (3, "olx", ""), (4, "olx", None), (5, "olx", "v")], "seq int, source string, url string")
    once = tables.first_by_url(df)
    assert sorted(r.seq for r in once.collect()) == [2, 5]
    assert sorted(once.collect()) == sorted(tables.first_by_url(once).collect())


def test_json_repair(spark):
    f = lambda t: one(spark, F.to_json(analysis.repaired(F.col("x"))), x=t)
    assert f('```json\n{"a": 1}\n```') == '{"a":1}' and f('{"a": True, "b": [1,],}') == '{"a":true,"b":[1]}'
    assert f('tekst {"a": {"b": null}} koniec') == '{"a":{"b":null}}' and f("brak") is None


def test_reply_check(spark):
    body = '{"is_real_share": true, "confidence": "0.9", "stars": 7, "summary": "s", "fraction": "pół", "property_type": null, "seller_motivation": "x", "estimated_value_total": null, "price_assessment": "okazja", "risks": [1,2,3,4,5,6]}'
    df = spark.createDataFrame([(body,), (body.replace('"stars": 7, ', ""),), (body.replace('"0.9"', '"wiele"'),)], "raw string").select(F.try_parse_json("raw").alias("reply"))
    rows = analysis.checked(df).collect()
    assert [r.valid for r in rows] == [True, False, False]
    r = rows[0]
    assert (r.stars, r.fraction, r.property_type, r.seller_motivation, r.price_assessment, len(r.risks)) == (5, None, None, "inne", "okazja", 5)


def test_cards(spark):
    page = '<div data-testid="l-card"><h6 data-testid="ad-card-title"><a href="/d/oferta/x">Udział 1/2 &amp; dom</a></h6><p>120 000 zł</p><p data-testid="location-date">Łódź, Bałuty - Dzisiaj</p></div>'
    bare = '<a href="/d/oferta/1">Dłuższy tytuł</a><a href="/d/oferta/1">Dłuższy tytuł</a><a href="/d/oferta/2">abc</a>'
    df = spark.createDataFrame([(1, "olx", page), (2, "olx", bare), (3, "olx", None), (4, "nikt", page), (5, "morizon", "")], "page_id int, portal string, html string")
    rows = html.search_results(df).orderBy("page_id", "seq").collect()
    assert [(r.page_id, r.title, r.price, r.city) for r in rows] == [(1, "Udział 1/2 & dom", 120000.0, "Łódź"), (2, "Dłuższy tytuł", None, "")]
    assert rows[0].is_share and rows[0].fraction == "1/2"


def test_detail(spark):
    long = "słowo " * 30
    df = spark.createDataFrame([(1, "other", f"<p>a</p><p>{long}</p>"), (2, "other", "<p>krótko</p>"), (3, "olx", "<div data-cy='ad_description'><div>Opis</div></div><ul data-testid='ad-params'><li>Piętro: 3</li></ul>")], "page_id int, portal string, html string")
    rows = {r.page_id: r for r in html.details(df).collect()}
    assert rows[1].full_description == long.strip() and rows[2].full_description is None
    assert rows[3].full_description == "Opis" and rows[3].params == {"piętro": "3"}


def test_blocked(spark):
    f = lambda t, s: one(spark, html.blocked(F.col("x"), F.lit(s)), x=t)
    assert f("ok", 403) and f("", 200) and f("<title>Just a moment</title>" + "x" * 60000, 200) and not f("captcha" + "x" * 20000, 200) and f("captcha", 200)


def test_snapshots(spark, tmp_path):
    s = commits.Snapshots(spark, str(tmp_path / "t"), "id string, n int")
    assert s.read().count() == 0
    s.write(spark.createDataFrame([("a", 1)], "id string, n int"))
    s.write(s.read().unionByName(spark.createDataFrame([("b", 2)], "id string, n int")))
    assert s.version() == 3 and s.read().count() == 2


def test_files(spark, tmp_path):
    files.save_preset(spark, {"city": "Łódź"}, str(tmp_path / "p"))
    assert files.load_preset(spark, str(tmp_path / "p")).first().filters == {"city": "Łódź"}
    (tmp_path / "s.yaml").write_text("﻿llm:\n  enabled: true\n", encoding="utf-8")
    (tmp_path / "bad.yaml").write_text("a: [", encoding="utf-8")
    pytest.importorskip("yaml")
    assert files.read_settings(spark, str(tmp_path / "s.yaml"))["llm"] == {"enabled": True}
    assert files.read_settings(spark, str(tmp_path / "bad.yaml")) == files.DEFAULTS


def test_page_past_the_end(spark):
    df = spark.createDataFrame([], "seq int, tier string, attractiveness double, title string, price double, fraction string, city string, share_source string, property_type string, url string")
    assert render.page(df).first().text.startswith("📭") and render.page(df).first().pages == 1


def events(spark):
    t = pd.to_datetime(["2024-01-01 00:00:00", "2024-01-01 00:00:00.6", "2024-01-01 00:00:01.2", "2024-01-01 00:00:01.9", "2024-01-01 00:00:02.3"], format="ISO8601")
    return spark.createDataFrame(pd.DataFrame({"event_id": range(5), "user_id": [1] * 5, "ts": t}))


def test_throttle_counts_from_the_last_allowed(spark):
    assert [r.allowed for r in throttle.throttled(events(spark), 1.0).orderBy("event_id").collect()] == [True, False, True, False, True]


def test_throttle_stream(spark, tmp_path):
    events(spark).coalesce(1).write.parquet(str(tmp_path / "in"))
    # a timeout by processing time would ask for batches without data for ever
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    stream = spark.readStream.schema(events(spark).schema).parquet(str(tmp_path / "in"))
    q = throttle.throttled_stream(stream, 1.0).writeStream.format("memory").queryName("thr").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    assert [r.allowed for r in spark.table("thr").orderBy("event_id").collect()] == [True, False, True, False, True]


def test_throttle_gathers_no_history(spark):
    """One dense run of a busy user, over many batches, folded with one time as the state."""
    df = spark.range(30_000).select(F.col("id").alias("event_id"), F.lit(1).alias("user_id"), F.timestamp_millis(F.col("id") * 300).alias("ts"))
    out = throttle.throttled(df, 1.0)
    assert "collect_list" not in out._jdf.queryExecution().toString()
    assert out.where("allowed <> (event_id % 4 = 0)").count() == 0 and out.count() == 30_000
