"""Queries over the score, the classes and the ranking (the D and O rows of the survey)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import rules
from tessera.operators import classify, render, score, tables
from tessera.plans import views
from tessera.registry import sqltext as q
from tessera.registry.base import query


def scored(spark: SparkSession, d: str, **kw) -> DataFrame:
    return score.scored(views.listings(spark, d), **kw)


def classified(spark: SparkSession, d: str) -> DataFrame:
    return classify.classified(scored(spark, d))


@query("f3_normalize", q.listings(f"SELECT seq, {q.norm('title')} AS title, {q.norm('raw_description')} AS text FROM listings"))
def f3(spark, d):
    from tessera.functions.text import normalized

    return views.listings(spark, d).select("seq", normalized(F.col("title"), compose=True).alias("title"), normalized(F.col("raw_description"), compose=True).alias("text"))


@query("d2_title_tier", q.scored("SELECT seq, title_points FROM scored"))
def d2(spark, d):
    return scored(spark, d, parts=True).select("seq", "title_points")


@query("d3_text_tier", q.scored("SELECT seq, text_points FROM scored"))
def d3(spark, d):
    return scored(spark, d, parts=True).select("seq", "text_points")


@query("d4_fraction", q.scored("SELECT seq, fraction_detected FROM scored"))
def d4(spark, d):
    return scored(spark, d).select("seq", "fraction_detected")


@query("d5_plausible", q.listings("SELECT seq, n || '/' || m AS fraction, n > 0 AND n < m AND m <= 1000 AS plausible FROM (SELECT seq, seq % 40 AS n, seq % 1100 AS m FROM listings)"))
def d5(spark, d):
    f = F.concat_ws("/", (F.col("seq") % 40).cast("string"), (F.col("seq") % 1100).cast("string"))
    return views.listings(spark, d).select("seq", f.alias("fraction"), score.plausible(f).alias("plausible"))


@query("d6_inheritance", q.scored("SELECT seq, inheritance_points FROM scored"))
def d6(spark, d):
    return scored(spark, d, parts=True).select("seq", "inheritance_points")


@query("d7_trustee", q.scored("SELECT seq, trustee_points FROM scored"))
def d7(spark, d):
    return scored(spark, d, parts=True).select("seq", "trustee_points")


@query("d8_price_anomaly", q.scored("SELECT seq, price_points FROM scored"))
def d8(spark, d):
    return scored(spark, d, price="price", area="area", parts=True).select("seq", "price_points")


@query("d9_penalties", q.scored("SELECT seq, penalty_points FROM scored"))
def d9(spark, d):
    return scored(spark, d, parts=True).select("seq", "penalty_points")


_words = lambda x: f"CASE WHEN {q.any_of(x, rules.HIGH)} THEN {q.found(x, rules.HIGH)} WHEN {q.any_of(x, rules.MEDIUM)} THEN {q.found(x, rules.MEDIUM)} ELSE {q.found(x, rules.LOW)} END"


@query("d10_score", q.scored(f"SELECT seq, score, is_share, array_to_string(list_concat({_words('t')}, {_words('d')}, CASE WHEN fraction_detected IS NULL THEN [] ELSE [fraction_detected] END, {q.found('c', rules.INHERITANCE)}), '; ') AS matched FROM scored"))
def d10(spark, d):
    return scored(spark, d, keywords=True).select("seq", "score", "is_share", F.array_join("matched_keywords", "; ").alias("matched"))


_again = q.with_(q.LISTINGS_SQL, q.SCORED_SQL, "full_ AS (SELECT seq, title, price, area, CASE WHEN seq % 3 = 0 THEN NULL ELSE raw_description || ' Sprzedam udział 1/4, syndyk.' END AS raw_description FROM listings)",
    q.SCORED_SQL.replace("parts AS", "parts2 AS").replace("FROM parts)", "FROM parts2)").replace("scored AS", "scored2 AS").replace("FROM listings", "FROM full_"),
    select="""SELECT seq, CASE WHEN use THEN s2 ELSE s END AS score, CASE WHEN use THEN s2 - s END AS score_delta, CASE WHEN use THEN coalesce(f2, f) ELSE f END AS fraction_detected FROM (
      SELECT a.seq, a.score AS s, b.score AS s2, a.fraction_detected AS f, b.fraction_detected AS f2, b.raw_description IS NOT NULL AND abs(b.score - a.score) >= 5 AS use FROM scored a JOIN scored2 b USING (seq))""")  # fmt: skip


@query("d11_rescore", _again)
def d11(spark, d):
    full = F.when(F.col("seq") % 3 != 0, F.concat("raw_description", F.lit(" Sprzedam udział 1/4, syndyk.")))
    return score.rescored(scored(spark, d).withColumn("full_description", full)).select("seq", "score", "score_delta", "fraction_detected")


for _name, _cols in (("d12_tier", "tier"), ("d13_sale_source", "share_source"), ("d14_property_type", "property_type"), ("d15_fallback_fraction", "fraction"), ("d16_fraction_size", "fraction_size"), ("d17_price_bracket", "price_bracket")):

    def _one(spark, d, c=_cols):
        return classified(spark, d).select("seq", c)

    query(_name, q.classified(f"SELECT seq, {_cols} FROM classified"))(_one)


@query("d18_attractiveness", q.classified("SELECT seq, round(attractiveness, 3) AS attractiveness FROM classified"))
def d18(spark, d):
    return classified(spark, d).select("seq", F.round("attractiveness", 3).alias("attractiveness"))


@query("d19_classify_and_rank", q.classified("SELECT seq, tier, share_source, property_type, fraction, fraction_size, price_bracket, round(attractiveness, 6) AS attractiveness FROM classified"))
def d19(spark, d):
    return classify.ranked(classified(spark, d)).select("seq", "tier", "share_source", "property_type", "fraction", "fraction_size", "price_bracket", F.round("attractiveness", 6).alias("attractiveness"))


@query("o1_by_score", q.scored("SELECT seq, score FROM scored"))
def o1(spark, d):
    return scored(spark, d).orderBy(F.desc("score"), "seq").select("seq", "score")


@query("o2_rank", q.classified("SELECT seq, row_number() OVER (ORDER BY tier_n, attractiveness DESC, seq)::INT AS rank FROM classified QUALIFY rank <= 100"))
def o2(spark, d):
    return classify.numbered(classified(spark, d), classify.rank_order(), 100).select("seq", "rank")


@query("o3_by_stars", q.classified("SELECT seq, CASE WHEN seq % 3 <> 0 THEN 1 + seq % 5 END AS stars, row_number() OVER (ORDER BY CASE WHEN seq % 3 <> 0 THEN 1 + seq % 5 END DESC NULLS LAST, seq)::INT AS rank FROM classified QUALIFY rank <= 100"))
def o3(spark, d):
    df = classified(spark, d).withColumn("stars", F.when(F.col("seq") % 3 != 0, 1 + F.col("seq") % 5))
    return classify.numbered(df, [F.col("stars").desc_nulls_last(), F.col("seq")], 100).select("seq", "stars", "rank")


@query("o4_head", q.classified("SELECT seq, row_number() OVER (ORDER BY tier_n, attractiveness DESC, seq) <= 15 AS analysed FROM classified QUALIFY row_number() OVER (ORDER BY tier_n, attractiveness DESC, seq) <= 40"))
def o4(spark, d):
    return classify.numbered(classified(spark, d), classify.rank_order(), 40).select("seq", (F.col("rank") <= 15).alias("analysed"))


@query("a5_tiers", q.classified("SELECT tier, count(*) AS n FROM classified GROUP BY tier"))
def a5(spark, d):
    return tables.tiers(classified(spark, d))


@query("a6_price_range", q.classified("SELECT min(price) AS lowest, max(price) AS highest FROM classified WHERE price > 1000"))
def a6(spark, d):
    return tables.price_range(classified(spark, d))


@query("a7_top_sources", q.classified("SELECT share_source, count(*) AS n, min(seq) AS first FROM classified GROUP BY share_source ORDER BY n DESC, first LIMIT 3"))
def a7(spark, d):
    return tables.top_sources(classified(spark, d))


@query("a3_funnel", q.scored("SELECT count(*) AS raw, count(*) FILTER (score > 0) AS candidates, count(*) FILTER (score <= 0) AS noise, count(*) FILTER (is_share) AS found FROM scored"))
def a3(spark, d):
    return tables.funnel(scored(spark, d))


@query("a11_histogram", q.scored("SELECT (score // 10 * 10)::INT AS bucket, count(*) AS n FROM scored GROUP BY ALL"))
def a11(spark, d):
    return tables.score_histogram(scored(spark, d))


_sweep = " UNION ALL ".join(f"SELECT {t} AS threshold, count(*) FILTER (score >= {t} AND truth) AS tp, count(*) FILTER (score >= {t} AND NOT truth) AS fp, count(*) FILTER (score < {t} AND truth) AS fn FROM s" for t in (25, 30, 35, 50, 75))


@query("a10_threshold_sweep", q.with_(q.LISTINGS_SQL, q.SCORED_SQL, "s AS (SELECT score, seq % 12 IN (0, 1, 2, 3, 6, 8, 10) AS truth FROM scored)", f"c AS ({_sweep})", "r AS (SELECT *, tp / nullif(tp + fp, 0) AS p, tp / nullif(tp + fn, 0) AS r FROM c)", select="SELECT threshold, tp, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / nullif(p + r, 0), 6) AS f1 FROM r"))
def a10(spark, d):
    return tables.threshold_sweep(scored(spark, d).withColumn("truth", (F.col("seq") % 12).isin(0, 1, 2, 3, 6, 8, 10)), [25, 30, 35, 50, 75])


@query("f21_flat", q.classified("SELECT id, title, price, city, voivodeship, url, source, score, tier, share_source, property_type, coalesce(fraction, '') AS fraction, round(attractiveness, 3) AS attractiveness, area, left(raw_description, 1500) AS description FROM classified"))
def f21(spark, d):
    return render.flat(classified(spark, d)).drop("seq")


_icon = "CASE tier WHEN 'pewny' THEN '🔥' WHEN 'prawdopodobny' THEN '⭐' ELSE '❓' END"
_esc = "replace(replace(replace(replace(replace(left(title, 60), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"
_money = "regexp_replace(round_even(price, 0)::BIGINT::VARCHAR, '(\\d)(\\d{3})$', '\\1,\\2') || ' PLN'"
_meta = "concat_ws(' • ', nullif(city, ''), CASE WHEN share_source <> 'inne' THEN share_source END, CASE WHEN property_type <> 'inne' THEN property_type END)"


@query("f20_cards", q.classified(f"SELECT seq, concat_ws(chr(10), {_icon} || ' <b>' || seq || '. ' || {_esc} || '</b>', CASE WHEN price <> 0 THEN '💰 ' || {_money} END, '📐 Udział: ' || fraction, '📍 ' || nullif({_meta}, ''), '🔗 <a href=\"' || url || '\">Otwórz ogłoszenie</a> (live)') AS card FROM classified"))
def f20(spark, d):
    return classified(spark, d).select("seq", render.card(F.col("seq")).alias("card"))


@query("k2_report", q.classified(f"SELECT row_number() OVER (ORDER BY tier_n, attractiveness DESC, seq)::INT AS rank, lpad(row_number() OVER (ORDER BY tier_n, attractiveness DESC, seq)::VARCHAR, 2, ' ') || '. ' || {_icon} || ' [' || score || '] ' || left(title, 70) || chr(10) || '     ' || {_money} || ' | ' || city || ' | ' || source || CASE WHEN fraction IS NULL THEN '' ELSE ' | udział ' || fraction END || chr(10) || '     ' || url AS line FROM classified QUALIFY rank <= 20"))
def k2(spark, d):
    return render.report_lines(classified(spark, d))


@query("w4_page_numbers", q.classified("SELECT seq, row_number() OVER (ORDER BY tier_n, attractiveness DESC, seq)::INT AS rank, ceil(row_number() OVER (ORDER BY tier_n, attractiveness DESC, seq) / 5.0)::INT AS page FROM classified QUALIFY rank <= 50"))
def w4(spark, d):
    return classify.numbered(classified(spark, d), classify.rank_order(), 50).select("seq", "rank", F.ceil(F.col("rank") / 5).cast("int").alias("page"))


_card = f"concat_ws(chr(10), {_icon} || ' <b>' || rank || '. ' || {_esc} || '</b>', CASE WHEN price <> 0 THEN '💰 ' || {_money} END, '📐 Udział: ' || fraction, '📍 ' || nullif({_meta}, ''), '🔗 <a href=\"' || url || '\">Otwórz ogłoszenie</a> (live)')"
_paged = f"""SELECT CASE WHEN max(text) IS NULL THEN '📭 Brak wyników na tej stronie.' ELSE max(text) END AS text, pages FROM (SELECT greatest(1, ceil(count(*) / 5.0))::INT AS pages FROM classified) LEFT JOIN (
  SELECT '📋 <b>Wyniki (2/' || any_value(pages_) || ')</b>' || chr(10) || chr(10) || string_agg({_card} || chr(10), chr(10) ORDER BY rank) AS text FROM (
    SELECT *, row_number() OVER (ORDER BY tier_n, attractiveness DESC, seq)::INT AS rank, greatest(1, ceil(count(*) OVER () / 5.0))::INT AS pages_ FROM classified) WHERE rank BETWEEN 6 AND 10) ON TRUE GROUP BY pages"""


@query("f20_page", q.classified(_paged))
def f20_page(spark, d):
    return render.page(classified(spark, d), 1)


_grouped = lambda x: f"regexp_replace(round_even({x}, 0)::BIGINT::VARCHAR, '(\\d)(\\d{{3}})$', '\\1,\\2')"
_summed = f"""SELECT concat_ws(chr(10), '📊 <b>Znaleziono ' || count(*) || ' udziałów:</b>' || chr(10),
    CASE WHEN count(*) FILTER (tier = 'pewny') > 0 THEN '🔥 Pewne: <b>' || count(*) FILTER (tier = 'pewny') || '</b>' END, CASE WHEN count(*) FILTER (tier = 'prawdopodobny') > 0 THEN '⭐ Prawdopodobne: <b>' || count(*) FILTER (tier = 'prawdopodobny') || '</b>' END,
    CASE WHEN count(*) FILTER (tier = 'mozliwy') > 0 THEN '❓ Możliwe: <b>' || count(*) FILTER (tier = 'mozliwy') || '</b>' END,
    chr(10) || '💰 Ceny: ' || {_grouped("min(price) FILTER (price > 1000)")} || ' – ' || {_grouped("max(price) FILTER (price > 1000)")} || ' PLN',
    '📋 Źródła: ' || (SELECT string_agg(k || '× ' || share_source, ', ' ORDER BY k DESC, first) FROM (SELECT share_source, count(*) AS k, min(seq) AS first FROM classified GROUP BY share_source ORDER BY k DESC, first LIMIT 3))) AS text FROM classified"""


@query("f20_summary", q.classified(_summed))
def f20_summary(spark, d):
    return render.summary(classified(spark, d))
