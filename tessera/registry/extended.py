"""Queries over stored tables, several sources, streams and all rows in order (rows S1, S9, S13, K5, M, A3, O5, T, W4 again, at any size)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import commits, ordered, store
from tessera.plans import views
from tessera.registry import sqltext as q
from tessera.registry.base import query
from tessera.registry.landed import CARDS, _throttle, pages_of, scratch
from tessera.registry.listing import NOW, batch
from tessera.registry.scoring import classified, scored
from tessera.sources import html, landed, scan
from tessera.streaming import throttle

STORED = "id string, source string, url string, title string, price double, first_seen_at timestamp, last_seen_at timestamp, is_active boolean"
SAVED = "id long, listing_id string, notes string, priority int, status string, saved_at timestamp"


def stored(spark: SparkSession, d: str) -> commits.Store:
    """A new store of listings and what is saved of them."""
    s = commits.Store(spark, scratch(spark, "stored"), {"listings": STORED, "saved": SAVED})
    b = s.begin()
    b.replace("listings", views.listings(spark, d))
    b.replace("saved", views.saved(spark, d))
    b.commit()
    return s


_batch = "b AS (SELECT id, price + 1 AS price FROM listings WHERE seq % 5 = 0 UNION ALL SELECT 'N' || seq, price FROM listings WHERE seq % 10 = 0)"
_new = "SELECT coalesce(l.id, b.id) AS id, CASE WHEN b.id IS NULL THEN l.price ELSE b.price END AS price, CASE WHEN l.id IS NULL THEN TIMESTAMP '1996-01-10' ELSE first_seen_at END AS first_seen_at, CASE WHEN b.id IS NULL THEN last_seen_at ELSE TIMESTAMP '1996-01-10' END AS last_seen_at, CASE WHEN b.id IS NULL THEN is_active ELSE TRUE END AS is_active FROM listings l FULL JOIN b ON l.id = b.id"


@query("m1_stored", q.with_(q.LISTINGS_SQL, _batch, f"n AS ({_new})", select="SELECT id, price, first_seen_at, last_seen_at, is_active AND NOT last_seen_at < TIMESTAMP '1996-01-10' - INTERVAL 72 HOUR AS is_active FROM n"))
def m1_stored(spark, d):
    """An upsert and an expiry, committed one after the other, each with its own rows written."""
    s, df = stored(spark, d), views.listings(spark, d)
    b = s.begin()
    b.upsert("listings", batch(df), F.expr(NOW))
    b.commit()
    b = s.begin()
    b.expire("listings", F.expr(NOW))
    b.commit()
    return s.read("listings").select("id", "price", "first_seen_at", "last_seen_at", "is_active")


_left = "kept AS (SELECT * FROM saved WHERE status <> 'visited' AND listing_id IN (SELECT id FROM listings WHERE seq % 4 <> 1))"


@query("k5_commit", q.with_(q.LISTINGS_SQL, views.SAVED_SQL, _left, select="SELECT 'listings' AS name, id, 3 AS version FROM listings WHERE seq % 4 <> 1 UNION ALL SELECT 'saved', id::VARCHAR, 3 FROM kept UNION ALL SELECT 'refused', 'listings', 3"))
def k5(spark, d):
    """Listings go, and with them what was saved of them, in one commit; a second writer of the same rows is refused."""
    s, df = stored(spark, d), views.listings(spark, d)
    one, two = s.begin(), s.begin()
    one.remove("listings", df.where("seq % 4 = 1"))
    saved = one.read("saved")
    kept = store.cascade(saved.where("status <> 'visited'"), one.read("listings"))
    one.remove("saved", saved.join(kept.select("id"), "id", "left_anti"))
    version = one.commit()
    two.change("listings", df.limit(1).withColumn("price", F.lit(0.0)))
    try:
        two.commit()
        refused = "nothing"
    except commits.Conflict:
        refused = "listings"
    names = [s.read(n).select(F.lit(n).alias("name"), F.col("id").cast("string").alias("id")) for n in ("listings", "saved")]
    return names[0].unionByName(names[1]).unionByName(spark.createDataFrame([("refused", refused)], "name string, id string")).withColumn("version", F.lit(version))


@query("s9_pushdown", q.listings("SELECT p.portal, id, price, area, city FROM listings, (VALUES ('szybko'), ('allegro')) p(portal) WHERE price BETWEEN 50000 AND 150000 AND area > 40 AND city = 'Łódź' AND title NOT LIKE '%nr 1%'"))
def s9_pushdown(spark, d):
    """Landed listings, asked by two portals' searches, of which one has no parameter for the area."""
    path = scratch(spark, "landed")
    views.listings(spark, d).select("id", "title", "url", "price", "area", "city").repartitionByRange("price").write.parquet(path)
    asked = "price >= 50000 AND price <= 150000 AND area > 40 AND city = 'Łódź' AND NOT contains(title, 'nr 1')"
    one, two = (landed.search(spark, path, p, asked).select(F.lit(p).alias("portal"), "id", "price", "area", "city") for p in ("szybko", "allegro"))
    return one.unionByName(two)


@query("s13_isolated", "SELECT 'customers' AS source, 'done' AS status, count(*) AS n, sum(c_custkey)::BIGINT AS keys FROM customer UNION ALL SELECT 'suppliers', 'done', count(*), sum(s_suppkey)::BIGINT FROM supplier UNION ALL SELECT 'nothing', 'error', 0, NULL UNION ALL SELECT 'broken', 'error', 0, NULL UNION ALL SELECT 'slow', 'timeout', 0, NULL")
def s13_isolated(spark, d):
    """Two sources that are read, one that isn't there, one that fails at one of its rows, and one that hangs."""

    def hang(batches):
        import time

        for b in batches:
            time.sleep(600)
            yield b

    key = lambda name, column: views.table(spark, d, name).select(F.col(column).cast("long").alias("key"))
    last = lambda: F.when(F.col("key") == key("part", "p_partkey").agg(F.max("key")).first()[0], F.raise_error(F.lit("broken row"))).otherwise(F.col("key"))
    sources = {
        "customers": scan.Source(lambda: key("customer", "c_custkey")), "suppliers": scan.Source(lambda: key("supplier", "s_suppkey")), "nothing": scan.Source(lambda: key("no_such_table", "x")),
        "broken": scan.Source(lambda: key("part", "p_partkey").select(last().alias("key"))), "slow": scan.Source(lambda: key("orders", "o_orderkey").mapInArrow(hang, "key long"), 8.0),
    }
    rows, status = scan.scan_sources(spark, sources, scratch(spark, "scan"))
    return status.join(rows.groupBy("source").agg(F.sum("key").alias("keys")), "source", "left").select("source", "status", "n", "keys")


@query("t1_stream", _throttle)
def t1_stream(spark, d):
    """t1_throttled as a stream over all events that are there, with a state that expires."""
    top = scratch(spark, "throttle")
    views.table(spark, d, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts")).write.parquet(f"{top}/in")
    stream = spark.readStream.schema("event_id long, user_id long, ts timestamp").parquet(f"{top}/in")
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # a state that expires by the clock would ask for batches without data for ever
    run = throttle.throttled_stream(stream, 3600.0).writeStream.format("parquet").option("checkpointLocation", f"{top}/state").trigger(availableNow=True).start(f"{top}/out")
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")  # a stream has the settings of its start
    run.awaitTermination()
    return spark.read.parquet(f"{top}/out").select("event_id", "allowed")


@query("ext_sessions", """WITH g AS (SELECT *, coalesce(ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 HOUR, TRUE)::INT AS first FROM events),
i AS (SELECT *, sum(first) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 HOUR AS "end", count(*) AS n, round(sum(value), 4) AS total FROM i GROUP BY user_id, island""")
def ext_sessions(spark, d):
    """Sessions over all events, of which every tenth is delivered twice."""
    events = views.table(spark, d, "events")
    return throttle.sessions(events.unionByName(events.where("event_id % 10 = 0")), gap="30 hours").withColumn("total", F.round("total", 4))


@query("w4_all_pages", q.classified("SELECT seq, row_number() OVER (ORDER BY tier_n, attractiveness DESC, seq) AS n, ceil(row_number() OVER (ORDER BY tier_n, attractiveness DESC, seq) / 5.0)::BIGINT AS page FROM classified"))
def w4_all(spark, d):
    df = classified(spark, d).select("seq", F.when(F.col("tier") == "pewny", 1).when(F.col("tier") == "prawdopodobny", 2).otherwise(3).alias("tier_n"), "attractiveness")
    found = ordered.Ordered(df, [("tier_n", True), ("attractiveness", False), ("seq", True)], scratch(spark, "ordered")).rows()
    return found.select("seq", "n", F.ceil(F.col("n") / 5).alias("page"))


_deep = "SELECT * FROM (SELECT seq, row_number() OVER (ORDER BY price DESC, seq) AS n, 'page' AS by FROM listings UNION ALL SELECT seq, row_number() OVER (ORDER BY price DESC, seq), 'after' FROM listings) WHERE n BETWEEN (SELECT count(*) // 10 * 5 + 1 FROM listings) AND (SELECT count(*) // 10 * 5 + 5 FROM listings)"


@query("o5_deep_page", q.listings(_deep))
def o5_deep(spark, d):
    """The page in the middle, by its number and by the last row of the page before."""
    found = ordered.Ordered(views.listings(spark, d).select("seq", "price"), [("price", False), ("seq", True)], scratch(spark, "ordered"))
    number = found.count // 10
    last = found.page(number, 5).collect()[-1]
    here = found.page(number + 1, 5).withColumn("by", F.lit("page"))
    return here.unionByName(found.after((last.price, last.seq), 5).withColumn("by", F.lit("after"))).select("seq", "n", "by")


@query("a3_watched", q.scored("SELECT count(*) AS raw, count(*) FILTER (score > 0) AS candidates, count(*) FILTER (score <= 0) AS noise, count(*) FILTER (is_share) AS found, count(*) FILTER (score >= 50) AS written FROM scored"))
def a3_watched(spark, d):
    """The funnel as it is seen while results are written, which is the only action over the listings."""
    path = scratch(spark, "results")
    df, seen = ordered.watched(scored(spark, d))
    df.where("score >= 50").select("id", "score").write.parquet(path)
    got = seen.get
    return spark.read.parquet(path).agg(*(F.lit(got[n]).cast("long").alias(n) for n in ("raw", "candidates", "noise", "found")), F.count(F.lit(1)).alias("written"))


@query("s1_table_function", q.listings("SELECT portal, seq // 10 AS page_id, title, floor(price)::DOUBLE AS price, city FROM listings, (VALUES ('morizon'), ('szybko')) p(portal)"))
def s1_table_function(spark, d):
    """Cards by a table function in SQL."""
    pages: DataFrame = pages_of(spark, d, "morizon", CARDS["morizon"]).unionByName(pages_of(spark, d, "szybko"))
    html.register_cards(spark)
    pages.createOrReplaceTempView("landed_pages")
    raw = spark.sql("SELECT * FROM search_cards(TABLE(landed_pages))")
    return html.listed(raw).select(F.col("source_portal").alias("portal"), "page_id", "title", "price", "city")
