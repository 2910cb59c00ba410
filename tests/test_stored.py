"""Stored tables under stops and other writers, sources that fail, hang or take filters, and the box around a circle."""

import json as pyjson
import math
import os
import threading
import time
from datetime import datetime

import numpy as np
import pytest
from py4j.protocol import Py4JJavaError
from pyspark.sql import functions as F

from tessera.functions import geo
from tessera.operators import commits, conversation, ordered
from tessera.sources import landed, scan
from tessera.streaming import throttle

SCHEMAS = {"listings": "id string, n long", "saved": "id string, listing_id string"}


@pytest.fixture
def fresh(spark, tmp_path):
    s = commits.Store(spark, str(tmp_path / "store"), SCHEMAS)
    b = s.begin()
    b.replace("listings", spark.createDataFrame([(str(k), k) for k in range(100)], SCHEMAS["listings"]))
    b.replace("saved", spark.createDataFrame([("s1", "1"), ("s2", "2")], SCHEMAS["saved"]))
    assert b.commit() == 2
    return s


def of(s, name="listings", **kw):
    return dict(tuple(r) for r in s.read(name, **kw).collect())


def test_changes_of_several_tables_are_committed_together(spark, fresh):
    b = fresh.begin()
    b.change("listings", spark.createDataFrame([("1", 10), ("new", 11)], SCHEMAS["listings"]))
    b.remove("listings", spark.createDataFrame([("2",), ("not there",)], "id string"))
    b.remove("saved", b.read("saved").join(b.read("listings").select(F.col("id").alias("listing_id")), "listing_id", "left_anti"))
    assert fresh.version() == 2 and len(of(fresh)) == 100 and len(of(fresh, "saved")) == 2
    assert b.commit() == 3
    now = of(fresh)
    assert now["1"] == 10 and now["new"] == 11 and "2" not in now and len(now) == 100 and of(fresh, "saved") == {"s1": "1"}
    assert of(fresh, version=2)["1"] == 1 and of(commits.Store(spark, fresh.folder, SCHEMAS)) == now


@pytest.mark.parametrize("step", ["data", "log", "named"])
def test_a_stop_at_any_step_leaves_a_whole_version(spark, fresh, monkeypatch, step):
    """While data is written, before the log's file has its name, and after it has."""
    b, before = fresh.begin(), of(fresh)

    def stop(*a, **k):
        raise KeyboardInterrupt

    put = commits.Store.put
    if step == "data":
        monkeypatch.setattr(commits.Batch, "_write", stop)
    elif step == "log":
        monkeypatch.setattr(commits.json, "dumps", stop)
    else:
        monkeypatch.setattr(commits.Store, "put", lambda self, *a: put(self, *a) and stop())
    with pytest.raises(KeyboardInterrupt):
        b.replace("listings", spark.createDataFrame([("x", 1)], SCHEMAS["listings"]))
        b.commit()
    monkeypatch.undo()
    again = commits.Store(spark, fresh.folder, SCHEMAS)
    assert of(again) == ({"x": 1} if step == "named" else before) and again.version() == (3 if step == "named" else 2)
    b = again.begin()
    b.change("listings", spark.createDataFrame([("y", 2)], SCHEMAS["listings"]))
    b.commit()
    assert of(again)["y"] == 2


def test_two_writers(spark, fresh):
    a, b, c = fresh.begin(), fresh.begin(), fresh.begin()
    one = lambda n: spark.createDataFrame([("1", n)], SCHEMAS["listings"])
    a.change("listings", one(5))
    b.change("listings", one(6))
    c.change("saved", spark.createDataFrame([("s3", "3")], SCHEMAS["saved"]))
    assert a.commit() == 3
    with pytest.raises(commits.Conflict):
        b.commit()
    assert c.commit() == 4  # of another table: goes on behind the first
    assert of(fresh)["1"] == 5 and len(of(fresh, "saved")) == 3


def test_many_writers_lose_nothing(spark, fresh):
    def write(k):
        for _ in range(50):
            b = fresh.begin()
            b.change("listings", spark.createDataFrame([(f"w{k}", k)], SCHEMAS["listings"]))
            try:
                b.commit()
                return
            except commits.Conflict:
                continue

    threads = [threading.Thread(target=write, args=(k,)) for k in range(5)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert {f"w{k}" for k in range(5)} <= set(of(fresh)) and fresh.version() == 7 and len(of(fresh)) == 105


def test_changes_are_folded(spark, fresh):
    want = of(fresh)
    for k in range(commits.FOLDED + 3):
        b = fresh.begin()
        b.change("listings", spark.createDataFrame([(str(k % 3), 1000 + k)], SCHEMAS["listings"]))
        b.commit()
        want[str(k % 3)] = 1000 + k
    table = fresh.state(fresh.version())["tables"]["listings"]
    assert of(fresh) == want and len(table["changes"]) < commits.FOLDED
    b = fresh.begin()
    b.remove("listings", spark.createDataFrame([(str(k),) for k in range(30)], "id string"))
    b.commit()
    table = fresh.state(fresh.version())["tables"]["listings"]
    assert table["changes"] == [] and table["rows"] == 70 and sorted(of(fresh)) == sorted(set(want) - {str(k) for k in range(30)})


def test_a_row_without_a_key_is_refused(spark, fresh):
    b = fresh.begin()
    with pytest.raises(Exception, match="has no id"):
        b.change("listings", spark.createDataFrame([(None, 1)], SCHEMAS["listings"]))


def test_a_small_upsert_writes_little(spark, tmp_path):
    """0.1% of the rows, dealt over all keys, write under 5% of the bytes."""
    schema = "id string, source string, title string, price double, first_seen_at timestamp, last_seen_at timestamp, is_active boolean"
    rows = spark.range(100_000).select(F.concat(F.lit("L"), F.col("id").cast("string")).alias("id"), F.lit("olx").alias("source"), F.sha2(F.col("id").cast("string"), 256).alias("title"), (F.col("id") * 1.5).alias("price"), F.timestamp_seconds(F.col("id")).alias("first_seen_at"), F.timestamp_seconds(F.col("id")).alias("last_seen_at"), F.lit(True).alias("is_active"))
    s = commits.Store(spark, str(tmp_path / "s"), {"listings": schema})
    size = lambda: sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(tmp_path) for f in names if f.endswith(".parquet"))
    b = s.begin()
    b.replace("listings", rows)
    b.commit()
    before = size()
    b = s.begin()
    some = rows.where("pmod(hash(id), 1000) = 7").withColumn("price", F.lit(-1.0)).withColumn("seq", F.lit(1))
    n = some.count()
    b.upsert("listings", some, F.expr("timestamp'2030-01-01'"))
    b.commit()
    assert 50 < n < 200 and size() - before < 0.05 * before
    assert s.read("listings").where("price = -1 AND last_seen_at = timestamp'2030-01-01' AND first_seen_at < timestamp'2000-01-01'").count() == n and s.read("listings").count() == 100_000
    b = s.begin()
    b.expire("listings", F.expr("timestamp'2030-01-01 00:00:00'"))
    b.commit()
    assert s.read("listings").where("is_active").count() == n


def test_sources_by_themselves(spark, tmp_path):
    """One raises while it is read, one can't be opened, one hangs in its rows and one before them; the others' rows stay."""
    def hang(batches):
        for b in batches:
            time.sleep(60)
            yield b

    ids = lambda n: spark.range(n).select("id")
    sources = {
        "fine": scan.Source(lambda: ids(5)), "more": scan.Source(lambda: ids(3).withColumn("x", F.lit("x"))), "none": scan.Source(lambda: ids(0)),
        "raises": scan.Source(lambda: ids(1000).select(F.when(F.col("id") == 999, F.raise_error(F.lit("broken row"))).otherwise(F.col("id")).alias("id"))),
        "missing": scan.Source(lambda: spark.read.parquet(str(tmp_path / "nothing"))), "hangs": scan.Source(lambda: ids(10).mapInArrow(hang, "id long"), 6.0), "stuck": scan.Source(lambda: time.sleep(90), 6.0),
    }
    began = time.monotonic()
    rows, status = scan.scan_sources(spark, sources, str(tmp_path / "scan"))
    told = {r.source: (r.status, r.n) for r in status.collect()}
    assert told == {"fine": ("done", 5), "more": ("done", 3), "none": ("done", 0), "raises": ("error", 0), "missing": ("error", 0), "hangs": ("timeout", 0), "stuck": ("timeout", 0)}
    assert {(r.source, r["count"]) for r in rows.groupBy("source").count().collect()} == {("fine", 5), ("more", 3)}
    assert rows.where("x IS NOT NULL").count() == 3 and time.monotonic() - began < 50
    assert {r.source: r.error for r in status.collect()}["missing"] == "PATH_NOT_FOUND"


@pytest.fixture(scope="module")
def listings(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("landed") / "in")
    df = spark.range(20_000).select(F.concat(F.lit("L"), F.col("id").cast("string")).alias("id"), F.lit("t").alias("title"), F.lit("u").alias("url"), F.when(F.col("id") % 100 != 0, F.col("id").cast("double")).alias("price"), (F.col("id") % 90).cast("double").alias("area"), F.when(F.col("id") % 2 == 0, "Łódź").otherwise("Kraków Stary").alias("city"))
    df.repartitionByRange(4, "price").write.option("parquet.block.size", 1 << 14).parquet(path)
    return path


def scanned(df):
    """Rows that a frame's scan made, after it has run."""
    df.collect()
    plan, out = df._jdf.queryExecution().executedPlan(), 0
    plan = plan.finalPhysicalPlan() if "Adaptive" in plan.nodeName() else plan
    leaves = plan.collectLeaves()
    for k in range(leaves.size()):
        m = leaves.apply(k).metrics().get("numOutputRows")
        out += m.get().value() if m.isDefined() else 0
    return out


@pytest.mark.parametrize(("portal", "pushed", "left"), [("szybko", {"price_min", "price_max", "area_min", "city"}, []), ("allegro", {"price_min", "price_max", "city"}, ["area"])])
def test_filters_that_a_portal_has_reach_its_scan(spark, listings, portal, pushed, left):
    got = landed.search(spark, listings, portal, "price >= 1000 AND price <= 2000 AND area >= 40 AND city = 'Łódź' AND title = 't' AND id <> 'L1234'")
    want = {f"L{k}" for k in range(1000, 2001) if k % 100 and k % 90 >= 40 and k % 2 == 0 and k != 1234}
    assert {r.id for r in got.collect()} == want and got.where("price < 1500").count() == len([x for x in want if int(x[1:]) < 1500]) and got.count() == len(want)
    assert scanned(got) == sum(bool(k % 100 and k % 2 == 0 and (k % 90 >= 40 or "area_min" not in pushed)) for k in range(1000, 2001))
    assert scanned(landed.search(spark, listings, portal, "title <> 'x'")) == 20_000
    plan = got._jdf.queryExecution().executedPlan().toString()
    kept = "\n".join(x for x in plan.splitlines() if "Filter" in x and "BatchScan" not in x)
    assert "landed_listings" in plan and all((f"({c}#" in kept) == (c in [*left, "title"]) for c in ("price", "area", "city", "title")), plan


def test_strict_bounds_and_nulls(spark, listings):
    n = lambda where, portal="szybko": landed.search(spark, listings, portal, where).count()
    assert n("price > 100 AND price < 103") == 2 and n("price > 10 AND price >= 19995 AND price >= 19990") == 5
    assert n("price IS NULL") == 200 and n("price IS NOT NULL AND city = 'nowhere'") == 0
    assert n("price >= 10 OR city = 'Łódź'") == 20_000 - 9 - 200 + 4 + 200
    reader = landed.ListingReader(f"file://{listings}", "allegro")
    from pyspark.sql.datasource import EqualTo, GreaterThan, GreaterThanOrEqual

    left = list(reader.pushFilters([GreaterThanOrEqual(("price",), 10.0), EqualTo(("city",), "Kraków Stary"), EqualTo(("title",), "t"), GreaterThan(("area",), 1.0)]))
    assert [f.attribute for f in left] == [("title",), ("area",)]
    assert reader.request("udział") == "https://api.allegro.pl?phrase=udzia%C5%82&category.id=100249&sort=-relevance&limit=50&price.from=10&location.city=Krak%C3%B3w+Stary"


@pytest.mark.parametrize(("lat", "lon", "km"), [(89.95, 20.0, 10.0), (-89.99, -170.0, 5.0), (52.0, 179.9, 50.0), (-30.0, -179.95, 20.0), (70.0, 0.0, 500.0), (0.0, 0.0, 100.0), (52.23, 21.01, 1.0), (10.0, 10.0, 15_000.0), (89.0, 0.0, 111.2)])
def test_box_holds_the_circle(spark, lat, lon, km):
    """Every point of a net that is within the circle is in the box."""
    net = [(lat + km / 111 * a / 8, (lon + b * w + 540) % 360 - 180) for a in range(-9, 10) for b in range(-12, 13) for w in (km / 1000, 15 / max(0.05, math.cos(math.radians(lat))) / 12 * min(1, km / 100), 15)]
    df = spark.createDataFrame([p for p in net if -90 <= p[0] <= 90], "lat double, lon double")
    d = geo.haversine(F.col("lat"), F.col("lon"), F.lit(lat), F.lit(lon))
    near = df.where(d <= km)
    assert near.count() > 0 and near.where(~geo.near_box(F.col("lat"), F.col("lon"), lat, lon, km)).count() == 0


def test_points_beyond_the_pole(spark):
    points = [(89.99, 20.0), (89.99, -160.0), (89.95, 100.0)]
    df = spark.createDataFrame(points, "lat double, lon double")
    assert df.where(geo.near_box(F.col("lat"), F.col("lon"), 89.95, 20.0, 10.0) & (geo.haversine(F.col("lat"), F.col("lon"), F.lit(89.95), F.lit(20.0)) <= 10)).count() == 3


def test_log_files_are_whole(fresh):
    log = os.path.join(fresh.folder, "_log")
    assert [pyjson.load(open(os.path.join(log, n)))["changed"] for n in sorted(os.listdir(log)) if n.isdigit()] == [[], ["listings", "saved"]]
    assert not issubclass(commits.Conflict, Py4JJavaError)


def test_rows_in_order_and_their_pages(spark, tmp_path):
    """Nulls, ties in the first column and both directions, against a sort of the list; no page reads more ranges than it shows."""
    rows = [(k, None if k % 7 == 0 else float(k * 37 % 50)) for k in range(500)]
    df = spark.createDataFrame(rows, "seq long, price double").repartition(5)
    for name, up in (("up", True), ("down", False)):
        o = ordered.Ordered(df, [("price", up), ("seq", True)], str(tmp_path / name), 9)
        key = (lambda r: (r[1] is not None, r[1] or 0, r[0])) if up else (lambda r: (r[1] is None, -(r[1] or 0), r[0]))
        want = sorted(rows, key=key)
        got = o.rows()
        assert "Window" not in got._jdf.queryExecution().executedPlan().toString()
        assert [tuple(r)[:2] for r in sorted(got.collect(), key=lambda r: r.n)] == want and o.count == 500
        for number in (1, 2, 40, 71, 72, 100):
            page = o.page(number, 7)
            assert [(r.seq, r.price, r.n) for r in page.collect()] == [(*r, (number - 1) * 7 + i + 1) for i, r in enumerate(want[(number - 1) * 7 : number * 7])]
        for at in (0, 100, 333, 498, 499):
            next_ = o.after((want[at][1], want[at][0]), 7)
            assert [(r.seq, r.n) for r in next_.collect()] == [(r[0], at + 2 + i) for i, r in enumerate(want[at + 1 : at + 8])]
        assert max(scanned(o.page(72, 7)), scanned(o.page(36, 7)), scanned(o.after((want[250][1], want[250][0]), 5))) <= 2 * max(r[2] for r in o.ranges) < 250
    none = ordered.Ordered(df.where("false"), [("seq", True)], str(tmp_path / "none"))
    assert none.rows().count() == none.page(1, 5).count() == none.after((1,), 5).count() == none.count == 0


def test_funnel_of_one_action(spark):
    df = spark.createDataFrame([(0, False), (10, False), (30, True), (80, True)], "score int, is_share boolean")
    seen_df, seen = ordered.watched(df)
    assert seen_df.where("score > 20").count() == 2 and seen.get == {"raw": 4, "candidates": 3, "noise": 1, "found": 2}


def stream_of(spark, tmp_path, rows, schema):
    """A stream that gets one list of rows a batch."""
    folder = tmp_path / "in"
    for k, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(folder / f"{k:02d}"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))


def at(text):
    return datetime.fromisoformat(f"2024-01-01 {text}")


def test_sessions_of_a_stream(spark, tmp_path):
    """An event that comes twice counts once, one that is late but within the watermark joins its session, one behind it is dropped."""
    schema = "event_id long, user_id long, ts timestamp, value double"
    batches = [
        [(1, 1, at("00:00:00"), 1.0), (2, 1, at("00:20:00"), 2.0), (1, 1, at("00:00:00"), 1.0), (3, 2, at("00:10:00"), 5.0)],
        [(2, 1, at("00:20:00"), 2.0), (4, 1, at("00:12:00"), 4.0), (5, 1, at("01:00:00"), 8.0)],
        [(6, 1, at("05:00:00"), 1.0)],
        [(7, 1, at("00:30:00"), 100.0), (8, 1, at("09:00:00"), 1.0)],
        [(9, 3, at("10:00:00"), 1.0)],
    ]
    out = throttle.sessions(stream_of(spark, tmp_path, batches, schema))
    run = out.writeStream.format("memory").queryName("sessions").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert run.awaitTermination(120)
    got = {(r.user_id, str(r.start)[11:16], str(r.end)[11:16], r.n, r.total) for r in spark.table("sessions").collect()}
    assert {(1, "00:00", "00:50", 3, 7.0), (2, "00:10", "00:40", 1, 5.0), (1, "01:00", "01:30", 1, 8.0), (1, "05:00", "05:30", 1, 1.0)} <= got and not any(total >= 100 for *_, total in got)


def test_throttle_forgets(spark, tmp_path):
    """After its time, a user's state is gone, and an event within the limit of one that was passed before passes."""
    schema = "event_id long, user_id long, ts timestamp"
    events = lambda first: [(first + k, u, at(f"00:00:{10 + (first + k) % 10}")) for u in (1, 2) for k in (u * 2 - 2, u * 2 - 1)]
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    try:
        for kept, want in ((3600, [True, False, True, False]), (1, [True, False, True, False, True, False, True, False])):
            for n, first in enumerate((0, 4)):
                top = tmp_path / str(kept)
                spark.createDataFrame(events(first), schema).coalesce(1).write.mode("append").parquet(str(top / "in"))
                stream = spark.readStream.schema(schema).parquet(str(top / "in"))
                run = throttle.throttled_stream(stream, 3600.0, kept=kept).writeStream.format("parquet").option("checkpointLocation", str(top / "c")).trigger(availableNow=True).start(str(top / "out"))
                assert run.awaitTermination(120)
                time.sleep(3 * (1 - n))
            got = [r.allowed for r in spark.read.parquet(str(top / "out")).orderBy("event_id").collect()]
            assert got == want + [False] * (8 - len(want))
    finally:
        spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")


@pytest.mark.parametrize("limit", [0.0, 0.003, 1.0, 7.5])
def test_throttle_of_one_busy_user(spark, limit):
    """One user with most events, no user, no time, ties: the same as a plain fold; and the user's events are many groups."""
    rng = np.random.RandomState(3)
    rows = [(i, 1 if i % 3 else None if i % 9 == 0 else int(rng.randint(2, 40)), None if i % 50 == 7 else int(rng.randint(0, 60_000)) * 1000) for i in range(4000)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, us long").select("event_id", "user_id", F.timestamp_micros("us").alias("ts"))
    last, want = {}, {}
    for i, u, t in sorted(rows, key=lambda r: (r[2] is None, r[2] or 0, r[0])):
        want[i] = t is None or u not in last or t - last[u] >= int(limit * 1_000_000)
        if want[i] and t is not None:
            last[u] = t
    got = throttle.throttled(df, limit).collect()
    assert len(got) == len(rows)
    assert {r.event_id: r.allowed for r in got} == want


def test_throttle_of_nothing(spark):
    df = spark.createDataFrame([], "event_id long, user_id long, ts timestamp")
    assert throttle.throttled(df).count() == 0


def test_budget_of_one_busy_user(spark, monkeypatch):
    """Many more messages than the budget has room for, empty and null ones among them: the same as a plain fold."""
    rng = np.random.RandomState(4)
    monkeypatch.setattr(conversation, "SALTS", 3)
    rows = [(1 if i % 3 else i % 4, i, None if i % 7 == 0 else "x" * int(rng.choice([0, 0, 0, 1, 9]))) for i in range(900)] + [(9, i, "") for i in range(300)] + [(8, 1, "y" * 99), (8, 2, "z" * 99), (8, 3, "y" * 99)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, text string")
    want = set()
    for user in {r[0] for r in rows}:
        total = 0
        for n, (_, turn, text) in enumerate(sorted((r for r in rows if r[0] == user), key=lambda r: -r[1]), 1):
            total += len(text or "")
            if total <= 40 or n <= 2:
                want.add((user, turn))
    got = conversation.within_budget(df, 40).collect()
    assert len(got) == len(want)
    assert {(r.conv_id, r.turn) for r in got} == want
