"""URL filters: pattern rules under their rarest literal token.

A rule is a regular expression, an action and the literal tokens that every URL it matches contains.
The rules are a table; their tokens are counted over all URLs, and each rule is filed under its rarest. Each URL's
tokens then fetch rules by an equal join with that index, which is broadcast if its bytes, counted, are few, and only fetched rules run
their regular expression, a rule's URLs together, so that it is compiled once a task. Rules without a literal token can't be
filed and run on every URL, as constants of the plan: up to EVERYWHERE of them beside the rest, and if there are more, so many in a pass.

Rules over host and path come first and are compared by length (the longest wins); a URL that none of
them fits gets the verdict of the pattern rules: block if one that blocks matches, else allow.

Defined results: a null URL, or one without ://, has empty host and path, fits no host rule and is
allowed unless a pattern rule matches its text; URLs of any length are judged whole; repeated rows are judged one by one; of
host rules as long the greater text wins, then block; rules that stand twice count once; without rules all is allowed; an empty table gives
none. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import LOWER_AZ, UPPER_AZ, Workspace

#: Fixed by contract: action and rule.
HOST_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
#: Words in host names, between dots and hyphens, that block.
HOST_WORDS = """casino poker roulette blackjack slots jackpot betting sportsbet lottery bingo viagra cialis tramadol xanax replica warez keygen
crack torrent pirate camgirls escorts hookup porn hentai sexcam milf payday bitdoubler clickbank seotool backlinks linkfarm adserver adclick popunder
tracker doubleclick malware phishing botnet""".split()
#: Words in paths, between slashes, hyphens and dots, that block.
PATH_WORDS = ["casino", "poker", "viagra", "cialis", "porn", "xxx", "warez", "torrent", "redirect", "unsubscribe", "trackback", "pingback"]
#: Action, regular expression over host and path joined, literal tokens in it.
PATTERN_RULES = [
    ("block", r"(^|[.-])spam-farm[.]", "spam farm"),
    ("block", r"(^|[.-])cheap-pills[.]", "cheap pills"),
    ("block", r"(^|[.-])free-(movies|downloads|money)[.]", "free"),
    ("block", r"/wp-login[.]php$", "wp login php"),
    ("block", r"/wp-admin/", "wp admin"),
    ("block", r"/xmlrpc[.]php$", "xmlrpc php"),
    ("block", r"/cgi-bin/", "cgi bin"),
    ("block", r"[.](exe|msi|apk)/download$", "download"),
    ("block", r"/(login|signin|signup|checkout|cart)(/|$)", ""),
    ("block", r"[.](zip|rar|7z|exe|dmg|iso)$", ""),
    # hosts that are no names: addresses, other scripts in disguise, credentials
    ("block", r"^([^/]*@)?[0-9]{1,3}([.][0-9]{1,3}){3}(:[0-9]+)?(/|$)", ""),
    ("block", r"(^|[.])xn--[0-9a-z-]+([.:/]|$)", "xn"),
    ("block", r"^[^/]*@", ""),
    # ports of proxies and panels
    *(("block", rf"^[^/]+:{port}(/|$)", port) for port in ("3128", "8081", "8443", "8888", "9090")),
    # prefixes of hosts that count clicks
    *(("block", rf"^{w}[.]", w) for w in ("click", "clk", "trk", "track", "pixel", "beacon", "telemetry")),
    # paths: sessions, feeds of calendars, ever deeper folders, very long numbers
    ("block", r";jsessionid=", "jsessionid"),
    ("block", r"/calendar/[0-9]{4}/[0-9]{1,2}(/|$)", "calendar"),
    ("block", r"/page/[0-9]{3,}(/|$)", "page"),
    ("block", r"^[^/]*(/[^/]+){12}", ""),
    ("block", r"[0-9]{16}", ""),
    *(("block", rf"(^|[.-]){w}([.-]|/|$)", w) for w in HOST_WORDS),
    *(("block", rf"/([^/]*[-.])?{w}([-./]|$)", w) for w in PATH_WORDS),
]
#: Bytes of the index of rules that are sent to every task, and how many rules without a token run on every URL in one pass.
BROADCAST_BYTES, EVERYWHERE = 64 << 20, 200
TOKEN = r"[^0-9A-Za-z\x{80}-\x{10FFFF}]+"


@dataclass(frozen=True)
class UrlRule:
    action: str
    pattern: str
    tokens: tuple[str, ...]
    #: Host rules have their text here, which is what a verdict shows; null: a pattern rule.
    shown: str | None


def literal(words: str) -> tuple[str, ...]:
    return tuple(dict.fromkeys(w.lower() for w in re.split(r"[^0-9A-Za-z]+", words) if w))


def all_rules(host_rules: list[tuple[str, str]], patterns: list[tuple[str, str, str]]) -> list[UrlRule]:
    out = []
    for action, text in host_rules:
        host, _, path = text.partition("/")
        # the path's last part may go on in the URL, so only what stands between slashes is a whole token
        whole = path.rpartition("/")[0]
        out.append(UrlRule(action, rf"(?s)^([^/]*[.])?{re.escape(host)}/{re.escape(path)}", literal(f"{host} {whole}"), text))
    return out + [UrlRule(a, p, literal(t), None) for a, p, t in patterns]


RULE = "action string, pattern string, tokens array<string>, shown string"


def rule_table(spark: SparkSession, host_rules: list[tuple[str, str]] = HOST_RULES, patterns: list[tuple[str, str, str]] = PATTERN_RULES) -> DataFrame:
    """A row for each rule: action, pattern, tokens (lower-case), and the text of a host rule, which is what a verdict shows."""
    rows = [(r.action, r.pattern, list(r.tokens), r.shown) for r in all_rules(host_rules, patterns)]
    values = ", ".join("(" + ", ".join([sql_text(a), sql_text(p), "CAST(array(" + ", ".join(map(sql_text, t)) + ") AS array<string>)", sql_text(s)]) + ")" for a, p, t, s in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(action, pattern, tokens, shown)") if rows else spark.createDataFrame([], RULE)


def sql_text(x: str | None) -> str:
    return "CAST(NULL AS STRING)" if x is None else "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def parsed(pages: DataFrame, keep: list[str]) -> DataFrame:
    """keep, host, path, their join and its tokens."""
    u = F.coalesce(F.col("url").cast("string"), F.lit(""))
    rest = F.when(F.col("_u").contains("://"), F.expr("substring(_u, locate('://', _u) + 3)")).otherwise(F.lit(""))
    df = pages.select(*keep, u.alias("_u")).withColumn("_rest", rest)
    df = df.withColumn("host", F.translate(F.regexp_extract("_rest", r"(?s)^[^/?#]*", 0), UPPER_AZ, LOWER_AZ))
    df = df.withColumn("path", F.regexp_extract("_rest", r"(?s)^[^/?#]*([^?#]*)", 1))
    df = df.withColumn("_text", F.when(F.col("_rest") == "", F.col("_u")).otherwise(F.concat("host", "path")))
    return df.withColumn("_tokens", F.array_remove(F.array_distinct(F.split(F.lower("_text"), TOKEN)), "")).drop("_u", "_rest")


def filter_urls(pages: DataFrame, keep: list[str] | None = None, rules: DataFrame | None = None, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """keep, host, path, rule and verdict for each row of pages(url); rules: a table as rule_table makes one."""
    spark, keep = pages.sparkSession, keep or ["page_id"]
    ws = Workspace(spark, "urls")
    rules = ws.keep((rule_table(spark) if rules is None else rules.select("action", "pattern", "tokens", "shown")).distinct().withColumn("rule_id", F.xxhash64("action", "pattern", "shown")), "rules")
    length = F.coalesce(F.octet_length("pattern"), F.lit(0)) + F.coalesce(F.octet_length("shown"), F.lit(0)) + F.octet_length(F.array_join("tokens", " ")) + 300
    small = F.broadcast if (rules.agg(F.sum(length)).first()[0] or 0) <= broadcast_bytes else lambda df: df
    loose = rules.where(F.size("tokens") == 0)
    if not loose.where("shown IS NOT NULL").isEmpty():
        raise ValueError("a host rule needs a literal token")
    urls = ws.keep(parsed(pages, keep).withColumn("_row", F.monotonically_increasing_id()), "urls")
    # how many URLs have each token of a rule: partial counts
    filed = rules.where(F.size("tokens") > 0)
    tokens = filed.select(F.explode("tokens").alias("token")).distinct()
    seen = urls.select(F.explode("_tokens").alias("token")).join(small(tokens), "token").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    named = filed.withColumn("token", F.explode("tokens")).join(small(seen), "token", "left")
    # a rule with a token that no URL has matches none
    least = named.groupBy("rule_id", "action", "pattern", "shown").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("x")).where("x.n > 0")
    index = ws.keep(least.select("rule_id", "action", "pattern", "shown", F.col("x.token").alias("token")), "index")
    fetched = urls.select("_row", "host", "_text", F.explode("_tokens").alias("token")).join(small(index), "token")
    # the match is made above the sort and is no filter, which would be moved below it; regexp_instr keeps the last pattern that it compiled
    tried = fetched.sortWithinPartitions("rule_id").select("_row", "action", "shown", ((F.regexp_instr("_text", F.col("pattern")) > 0) & (F.col("shown").isNull() | (F.col("host") != ""))).alias("hit"))
    best = F.max(F.when(F.col("hit") & F.col("shown").isNotNull(), F.struct(F.length("shown").alias("n"), "shown", "action")))
    by = tried.groupBy("_row").agg(best.alias("_best"), F.bool_or(F.col("hit") & F.col("shown").isNull() & (F.col("action") == "block")).alias("_blocked")).where("_best IS NOT NULL OR _blocked")
    urls, everywhere = anywhere(ws, urls, loose.where("action = 'block'"))
    out = urls.join(by, "_row", "left")
    verdict = F.coalesce(F.col("_best.action"), F.when(F.coalesce("_blocked", F.lit(False)) | everywhere, F.lit("block")).otherwise(F.lit("allow")))
    return out.select(*keep, "host", "path", F.col("_best.shown").alias("rule"), verdict.alias("verdict"))


def anywhere(ws: Workspace, urls: DataFrame, loose: DataFrame) -> tuple[DataFrame, Column]:
    """urls(_text) and a condition on them: whether one of the rules loose(pattern) matches.

    The rules are fetched in order, EVERYWHERE at a time; while there are more, a pass writes urls with what it has found.
    """
    found, some = F.lit(False), []
    for r in loose.select("pattern").distinct().toLocalIterator():
        if len(some) == EVERYWHERE:
            urls = ws.keep(urls.withColumn("_anywhere", reduce(or_, map(F.col("_text").rlike, some), found)), "urls")
            found, some = F.col("_anywhere"), []
        some.append(r.pattern)
    return urls, reduce(or_, map(F.col("_text").rlike, some), found)


def _oracle() -> str:
    hosts = " UNION ALL ".join(f"SELECT '{a}' AS action, '{t}' AS shown, '{t.partition('/')[0]}' AS h, '/{t.partition('/')[2]}' AS p" for a, t in HOST_RULES)
    blocks = " OR ".join(f"regexp_matches(t, '{p}')" for a, p, _ in PATTERN_RULES if a == "block")
    return f"""
WITH u AS (SELECT row_number() OVER () AS r, page_id, coalesce(url, '') AS u FROM pages),
rest AS (SELECT r, page_id, u, CASE WHEN contains(u, '://') THEN substr(u, instr(u, '://') + 3) ELSE '' END AS x FROM u),
hp AS (SELECT r, page_id, u, x, translate(regexp_extract(x, '^[^/?#]*'), '{UPPER_AZ}', '{LOWER_AZ}') AS host, regexp_extract(x, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
rules AS ({hosts}),
fit AS (SELECT r, max({{'n': length(shown), 'shown': shown, 'action': action}}) AS best FROM hp, rules
        WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY r),
m AS (SELECT r, page_id, host, path, CASE WHEN x = '' THEN u ELSE host || path END AS t FROM hp)
SELECT page_id, host, path, best.shown AS rule, CASE WHEN best IS NOT NULL THEN best.action WHEN {blocks} THEN 'block' ELSE 'allow' END AS verdict
FROM m LEFT JOIN fit USING (r)
"""


SQL = _oracle()
