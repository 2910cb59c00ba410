"""The page reader: plain markup gives the page that the parser gives, in elements of no cycle, a piece of a batch at a time."""

import random
import time

import pyarrow as pa
from pyspark.sql import functions as F

from tessera.functions import parse
from tessera.registry.landed import CARDS, DETAILS, OLX, pages_of
from tessera.sources import html

MARKUP = [c.format(k=12, t="Udział 1/2 &amp; dom", p="120 000", c="Łódź", v="łódzkie", a=55) for c in [*CARDS.values(), *OLX.values(), *DETAILS.values()]]
ODD = """<p> </p> <div> </div> <br> <br/> <!--c--> <!--a>b--> <!DOCTYPE|html> <script> </script> <style>a<b</style> <title>a&amp;b </title> <a|href="/d/oferta/1?a=1&amp;b"> <a|href=/d/oferta/2> </a> tekst &amp; &lt < > <x:y|z>
<P|CLASS="property-card__title|description"> </P|> PLN|5|zł <h6> </h6> <a|disabled|href="/d/oferta/q">długi|tytuł</a> <iframe> </iframe> <![CDATA[x]]> </> <li> <span|class='area'> <p|a="1"b="2"> <p|a|=|"1"> <div|title="a|>|b"> <div|class="tile"> <div|class="primary-display"> <p/> <tag""".split()


def whole(page):
    return [(k.tag, k.attrs, p, e, page.strings(n)) for n, (k, p, e) in enumerate(zip(page.kinds, page.parents, page.ends, strict=True))]


def test_plain_markup_is_read_as_the_parser_does():
    r, plain = random.Random(5), 0
    for _ in range(4000):
        text = "".join(r.choice(MARKUP) if r.random() < 0.2 else r.choice(ODD).replace("|", " ") for _ in range(r.randint(0, 6)))
        if (got := html.plain(text)) is not None:
            plain += 1
            assert whole(got) == whole(html.parsed(text)), text
    assert plain > 1000 and all(html.plain(m) is not None for m in MARKUP)


def test_selectors():
    page = html.tree('<div class="a b"><p>1</p><p class="b">2</p></div><p class="b">3</p><i href="/x/1"></i><i href="/y/1"></i>')
    said = lambda s, top=0: [page.said(n) for n in page.select(s, top)]
    assert said("p") == ["1", "2", "3"] and said(".a p") == ["1", "2"] and said(".a p.b, p:first-child") == ["1", "2"] and said("p", 1) == ["1", "2"] and said(".a .b", 1) == ["2"]
    assert list(page.select("[href*='/x/']")) == [5] and list(page.select("[href='/y/1']")) == [6] and list(page.select("i[href]")) == [5, 6] and page.first(".none") is None


def test_a_large_batch_is_read_in_pieces():
    """10,000 pages of ten cards: rows of 256 pages are held at once, and fewer pages where they are large."""
    pages = lambda n, text: pa.RecordBatch.from_pydict({"page_id": list(range(n)), "portal": ["olx"] * n, "html": [text] * n})
    assert [len(x) for x in html.pieces(pages(600, "x"))] == [256, 256, 88] and max(map(len, html.pieces(pages(20, "x" * 1_000_000)))) == 5
    many = pages(2000, MARKUP[5] * 10)
    made = list(html._cards_of(many, {p.name: p for p in html.PORTALS}))
    assert max(len(x[0]) for x in made) == 2560 and sum(len(x[0]) for x in made) == 20_000


def test_a_card_costs_little():
    """No more than half again what the parser alone takes, though five fields are looked for by some twenty selectors."""

    def seconds(f):
        return min((lambda t: (f(), time.process_time() - t)[1])(time.process_time()) for _ in range(5))

    text, portal = MARKUP[4] * 200, next(p for p in html.PORTALS if p.name == "szybko")
    assert len(list(html.cards(text, portal))) == 200
    assert seconds(lambda: list(html.cards(text, portal))) < 1.5 * seconds(lambda: html.parsed(text))


def test_a_page_is_lower_cased_once(spark):
    df = spark.createDataFrame([(None, 200), ("", 200), ("  \n", 200), ("<p>Rate LIMIT</p>", 200), ("x", 200), ("x", 403), ("x", None), ("<title>Just a Moment</title>" + "x" * 60_000, 200)], "html string, status int")
    out = df.select(html.blocked(df.html, df.status).alias("b"))
    assert [r.b for r in out.collect()] == [True, True, True, True, False, True, False, True]
    assert spark.range(9).select(html.blocked(F.concat(F.lit("A"), F.col("id")), F.lit(200)).alias("b"))._jdf.queryExecution().optimizedPlan().toString().count("lower(") == 1


def test_land_register_numbers(spark):
    df = spark.createDataFrame([("KW nr WA1M/12345678/9, dom",), ("/12345678/9",), ("KW WA1M/1234567/9",), (None,), ("księga wieczysta: GD1G/00000001/2 i KW",)], "x string")
    assert [r[0] for r in df.select(parse.land_register(F.col("x"))).collect()] == ["WA1M/********/*", None, None, None, "GD1G/********/*"]


def test_addresses_are_not_new_kinds(monkeypatch):
    """Marks that differ by their address alone share what is known of them, also where a selector asks for the address."""
    asked, fits = [], html.Step.fits
    monkeypatch.setattr(html.Step, "fits", lambda self, kind: asked.append(1) or fits(self, kind))
    page = html.tree("".join(f'<h6><a class="b" href="/{"d/oferta" if k % 2 else "x"}/{k}">t</a></h6>' for k in range(200)))
    assert len(list(page.select("h6 a[href*='/d/oferta/']"))) == 100 and list(page.select("a[href='/x/4']")) == [10] and len(list(page.select("a[href]"))) == 200
    assert len(asked) < 20
    odd = ["<a title=' href=\"/1\"' href=\"/2\">", '<a href="/1" HREF="/2">', '<a href="/1" href="">', '<a x=\' href="/1"\'>', '<A href="/href">']
    assert all(whole(html.plain(m)) == whole(html.parsed(m)) for m in odd)


def test_a_price_is_made_once(spark):
    df = spark.createDataFrame([("150 000 zł",), ("150.000",), ("1.250.000,00",), ("99",), ("0",), ("do negocjacji",), (None,), ("12.5 PLN",), ("1.234,5",)], "x string")
    assert [r[0] for r in df.select(parse.olx_price(F.col("x"))).collect()] == [150000.0, 150000.0, 125000000.0, None, 0.0, None, None, None, 12345.0]
    assert spark.range(9).select(parse.olx_price(F.col("id").cast("string")).alias("v"))._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(") == 2


def test_pages_of_one_listing_are_not_shuffled_and_others_are_dealt_evenly(spark, sf):
    one, ten = pages_of(spark, sf, "olx", DETAILS["olx"], 1), pages_of(spark, sf, "olx")
    assert "Aggregate" not in one._jdf.queryExecution().optimizedPlan().toString() and one.count() == spark.read.parquet(f"{sf}/orders.parquet").count()
    assert one.columns == ten.columns and ten.count() == one.select(F.floor(F.col("page_id") / 10)).distinct().count()
    assert ten.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_all_selectors_of_a_page_take_one_pass(monkeypatch):
    passes, read = [], html.tree

    class Kinds(list):
        def __iter__(self):
            passes.append(1)
            return super().__iter__()

    def watched(text):
        page = read(text)
        page.kinds = Kinds(page.kinds)
        return page

    monkeypatch.setattr(html, "tree", watched)
    by = {p.name: p for p in html.PORTALS}
    assert [html.detail(m, p)[0] is not None for p, m in zip(DETAILS, MARKUP[-4:], strict=True)] == [True] * 4 and len(passes) == 4
    assert all(list(html.cards(m, by[p])) for p, m in zip(CARDS, MARKUP, strict=False)) and len(passes) == 4 + len(CARDS)


def test_a_known_mark_is_not_matched_again(monkeypatch):
    asked, pattern = [], html.PLAIN

    class Plain:
        fullmatch = staticmethod(lambda mark: asked.append(mark) or pattern.fullmatch(mark))

    monkeypatch.setattr(html, "PLAIN", Plain)
    monkeypatch.setattr(html, "MARKS", {})
    text = "".join(f'<li class="a" id="b">{n} &gt; 1 > 0</li><!-- c --><br/>' for n in range(500))
    assert whole(html.plain(text)) == whole(html.parsed(text)) and sorted(asked) == ["!-- c --", "/li", "br/", 'li class="a" id="b"']
    assert all(html.plain(x) is None for x in ("<>", "a < b", "<p", "<p><", "<p a=<b>>", '<p a="1>2">', "<!-- > -->"))
