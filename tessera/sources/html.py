"""Landed pages of search results, and of single listings, as rows.

What to take from a page is data: for each portal the selectors of a card and of its fields. A small reader on
the standard library's parser takes the texts out, a batch of pages at a time; all that follows, prices,
places, areas, is parsed by Columns.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property
from html import unescape
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udtf

from tessera.functions import parse, rules

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Plain markup between angle brackets, which it has none of inside: an end tag, a start tag with quoted attributes or bare ones, a comment, the document's type.
#: All else is left to the parser.
PLAIN = re.compile(r"""(?:/([a-zA-Z][a-zA-Z0-9-]*)[ \t\n\r\f]*|([a-zA-Z][a-zA-Z0-9-]*)((?:[ \t\n\r\f]+[a-zA-Z_:][\w:.-]*(?:="[^"<>]*"|='[^'<>]*')?)*)[ \t\n\r\f]*(/?)|!--[a-zA-Z0-9 .,:;_\n]*--|![dD][oO][cC][tT][yY][pP][eE][^<>\[\]]*)""", re.A)
ADDRESS = re.compile(r' href="([^"<>]+)"')
ATTRIBUTE = re.compile(r"""([^\s=]+)(?:="([^"]*)"|='([^']*)')?""", re.A)
#: Elements whose content is text alone: as it stands, with references, and rare ones, which are left to the parser.
RAW, TEXT_ONLY, RARE = {"script", "style"}, {"script", "style", "title", "textarea"}, {"iframe", "noembed", "noframes", "noscript", "plaintext", "xmp"}


def has(attrs: dict[str, str], asked: list[tuple]) -> bool:
    for name, op, value in asked:
        have = attrs.get(name)
        if have is None or op == "=" and have != value or op == "*=" and value not in have:
            return False
    return True


class Step:
    """One step of a selector: tag, .class, [attr], [attr=value], [attr*=value], :first-child."""

    def __init__(self, step: str):
        self.tag, self.classes, self.attrs, self.address, self.first, self.never = None, [], [], [], False, False
        for part in re.findall(r"\[[^\]]*\]|:first-child|[.]?[\w-]+", step):
            if part == ":first-child":
                self.first = True
            elif part[0] == "[":
                asked = re.match(r"\[([\w-]+)(?:([*]?=)['\"]?([^'\"\]]*)['\"]?)?\]", part).groups()
                (self.address if asked[0] == "href" else self.attrs).append(asked)
            elif part[0] == ".":
                self.classes.append(part[1:])
            else:
                self.never = self.tag not in (None, part)
                self.tag = part

    def fits(self, kind: Kind) -> bool:
        """All but the address, which kinds don't share, and :first-child, which is a matter of the place."""
        return not self.never and self.tag in (None, kind.tag) and has(kind.attrs, self.attrs) and all(c in kind.classes for c in self.classes)


class Kind:
    """A tag with its attributes, shared by all elements that are written alike.

    known: which steps and selectors it fits but for the address, shared with kinds that differ by their address alone.
    """

    def __init__(self, tag: str, attrs: dict[str, str], alike: Kind | None = None):
        self.tag, self.attrs = tag, attrs
        self.known = {} if alike is None else alike.known
        self.classes = alike.classes if alike is not None else attrs["class"].split() if "class" in attrs else ()

    def fits(self, step: Step) -> bool:
        if (got := self.known.get(step)) is None:
            got = self.known[step] = step.fits(self)
        return got and (not step.address or has(self.attrs, step.address))

    def ways(self, selector: str) -> list[list[Step]] | bool:
        """The selector's ways whose last step fits; True if one of them asks for nothing else, False if there is none."""
        if (got := self.known.get(selector)) is None:
            got = [w for w in ways(selector) if w[-1].fits(self)]
            got = self.known[selector] = any(len(w) == 1 and not w[0].first and not w[0].address for w in got) or got or False
        if got is True or not got or "[href" not in selector:
            return got
        got = [w for w in got if has(self.attrs, w[-1].address)]
        return any(len(w) == 1 and not w[0].first for w in got) or got or False

    def fitting(self, group: frozenset[str]) -> list[tuple[str, list[list[Step]] | bool | None]]:
        """Those of a group of selectors that may fit, mostly none, with their ways; None for ways where the address is to be asked."""
        if (got := self.known.get(group)) is None:
            some = [(s, None if "[href" in s else w) for s in group if (w := self.ways(s)) or self.known[s] is not False]
            got = self.known[group] = some
        return got


#: What a task has met so far, up to a fixed number. Of marks: the kind of a start tag, the name of an end tag, whether an element stays open, and whose end must follow.
WAYS: dict[str, list[list[Step]]] = {}
MARKS: dict[str, tuple[Kind | None, str, bool, str] | None] = {}
MOST_MARKS, LONGEST_MARK = 4000, 300


def ways(selector: str) -> list[list[Step]]:
    if (got := WAYS.get(selector)) is None:
        got = WAYS[selector] = [[Step(x) for x in w.split()] for w in selector.split(",")]
    return got


def marked(mark: str) -> tuple[Kind | None, str, bool, str] | None:
    """What stands between angle brackets as MARKS has it; None if it is left to the parser, as a reference in an attribute is."""
    if mark in MARKS:
        return MARKS[mark]
    if (m := ADDRESS.search(mark)) and mark.lower().count("href") == 1 and "&" not in mark:  # marks of one page mostly differ by it
        alike = marked(mark[: m.start(1)] + mark[m.end(1) :])
        if alike and alike[0] and alike[0].attrs.get("href") == "":
            return Kind(alike[0].tag, alike[0].attrs | {"href": m[1]}, alike[0]), *alike[1:]
    if not (m := PLAIN.fullmatch(mark)):
        return None
    end, tag, written, closed = m.groups()
    got = None, (end or "").lower(), False, ""
    if tag:
        tag = tag.lower()
        k = Kind(tag, {a[0].lower(): a[1] or a[2] for a in ATTRIBUTE.findall(written)})
        got = None if "&" in written or tag in RARE else (k, "", not closed and tag not in VOID, tag if tag in TEXT_ONLY and not closed else "")
    if len(mark) <= LONGEST_MARK and not (got and got[0] and got[0].attrs.get("href")):
        if len(MARKS) >= MOST_MARKS:
            MARKS.clear()
        MARKS[mark] = got
    return got


class Page:
    """The elements of a page as lists, numbered as they begin; 0 is the page itself.

    What is below an element has the numbers up to its end, and so have the texts. No element refers to another one, so
    a page is freed as soon as it has been read.
    """

    def __init__(self):
        self.kinds, self.parents, self.ends, self.since, self.until = [Kind("", {})], [-1], [0], [0], [0]
        self.texts: list[str] = []
        self.raw: dict[int, list[str]] = {}
        self.found: dict[str, tuple[list[int], list]] = {}
        self.now = 0

    def start(self, k: Kind) -> None:
        n = len(self.kinds)
        self.kinds.append(k)
        self.parents.append(self.now)
        self.ends.append(n + 1)
        self.since.append(len(self.texts))
        self.until.append(len(self.texts))
        if k.tag not in VOID:
            self.now = n

    def end(self, tag: str) -> None:
        kinds, parents = self.kinds, self.parents
        n = self.now
        if n and kinds[n].tag == tag:  # mostly the last one
            self.ends[n], self.until[n], self.now = len(kinds), len(self.texts), parents[n]
            return
        while n > 0 and kinds[n].tag != tag:
            n = parents[n]
        if n > 0:
            self._leave(parents[n])

    def text(self, x: str) -> None:
        if self.kinds[self.now].tag in RAW:
            self.raw.setdefault(self.now, []).append(x)
        else:
            self.texts.append(x)

    def _leave(self, to: int) -> None:
        n, elements, texts = self.now, len(self.kinds), len(self.texts)
        while n != to:
            self.ends[n], self.until[n] = elements, texts
            n = self.parents[n]
        self.now = to

    def close(self) -> Page:
        self._leave(-1)
        return self

    def strings(self, n: int) -> list[str]:
        """Texts below an element, but for scripts and styles below it."""
        return self.raw.get(n, []) if self.kinds[n].tag in RAW else self.texts[self.since[n] : self.until[n]]

    def said(self, n: int, between: str = "") -> str:
        return between.join([s for x in self.strings(n) if (s := x.strip())])

    def look(self, group: frozenset[str]) -> Page:
        """Finds the elements of all selectors of a group in one pass over the page."""
        found = self.found
        for s in group:
            found[s] = [], []
        for n, k in enumerate(self.kinds):
            if (fit := k.known.get(group)) is None:
                fit = k.fitting(group)
            for s, w in fit:
                if w is not None or (w := k.ways(s)):
                    numbers, how = found[s]
                    numbers.append(n)
                    how.append(w)
        return self

    def _found(self, selector: str) -> tuple[list[int], list]:
        """Elements of the page that may fit, and the ways that are to be tried."""
        if (got := self.found.get(selector)) is None:
            self.look(frozenset((selector,)))
            got = self.found[selector]
        return got

    def select(self, selector: str, top: int = 0) -> Iterator[int]:
        """Elements below this one, in order, that fit one of the selectors between commas."""
        found, how = self._found(selector)
        if found:
            for at in range(bisect_right(found, top), bisect_left(found, self.ends[top])):
                if how[at] is True or self._fits_one(found[at], how[at], top):
                    yield found[at]

    def first(self, selector: str, top: int = 0) -> int | None:
        found, how = self._found(selector)
        if found:
            for at in range(bisect_right(found, top), bisect_left(found, self.ends[top])):
                if how[at] is True or self._fits_one(found[at], how[at], top):
                    return found[at]
        return None

    def _fits_one(self, n: int, some: list[list[Step]], top: int) -> bool:
        for way in some:
            if self._fits(n, way, top):
                return True
        return False

    def _fits(self, n: int, way: list[Step], top: int) -> bool:
        if way[-1].first and self.parents[n] != n - 1:
            return False
        left, n = len(way) - 1, self.parents[n]
        while left and n >= 0:
            step = way[left - 1]
            if self.kinds[n].fits(step) and not (step.first and (n == 0 or self.parents[n] != n - 1)):
                left -= 1
            n = -1 if n == top else self.parents[n]
        return not left


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.page = Page()

    def handle_starttag(self, tag, attrs):
        self.page.start(Kind(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        self.page.end(tag)

    def handle_data(self, data):
        self.page.text(data)


def parsed(html: str) -> Page:
    b = _Builder()
    b.feed(html)
    b.close()
    return b.page.close()


def plain(html: str) -> Page | None:
    """The same page as parsed gives, in a fraction of the time; None if some of its markup isn't PLAIN."""
    parts = html.split("<")
    page, now, only, known = Page(), 0, "", MARKS.get
    kinds, parents, ends, since, until, texts = page.kinds, page.parents, page.ends, page.since, page.until, page.texts
    if parts[0]:
        page.text(unescape(parts[0]))
    for part in parts[1:]:
        mark, bracket, text = part.partition(">")
        if not bracket or (what := known(mark) or marked(mark)) is None:
            return None
        k, end, opens, raw = what
        if only and end != only:
            return None
        only = raw
        if k:
            n, before = len(kinds), len(texts)
            kinds.append(k)
            parents.append(now)
            ends.append(n + 1)
            since.append(before)
            until.append(before)
            if opens:
                now = n
        elif end:
            if now and kinds[now].tag == end:  # mostly the last one
                ends[now], until[now], now = len(kinds), len(texts), parents[now]
            else:
                page.now = now
                page.end(end)
                now = page.now
        if text:
            if only in RAW:
                page.raw.setdefault(now, []).append(text)
            else:
                texts.append(unescape(text) if "&" in text else text)
    page.now = now
    return None if only else page.close()


def tree(html: str) -> Page:
    return plain(html) or parsed(html)


#: Selectors of links without a card.
BARE, LAST_LINK = "a[href*='/d/oferta/']", "a.css-u2ayx9"


@dataclass(frozen=True)
class Portal:
    """Selectors by use. cards: tried in turn, the first with any element counts."""

    name: str
    base: str
    cards: list[str]
    title: str
    fields: dict[str, str] = field(default_factory=dict)
    #: Where the link is: a selector, or empty for the card itself.
    link: str = ""
    price: str = "digits"
    dialect: str = "olx"

    @cached_property
    def asked(self) -> frozenset[str]:
        """All that is asked of a page."""
        own = [BARE, LAST_LINK] if self.name == "olx" else [self.title, *self.link.split("|")]
        return frozenset(s for s in [*self.cards, *self.fields.values(), *own] if s)


CARD = {"price_text": ".property-card__price--main", "location_text": ".property-card__location", "text": ".property-card__property-description, .property-card__property-details"}
#: The portals' markup.
PORTALS = [
    Portal("morizon", "https://www.morizon.pl", ["a.property-card", "[data-cy=propertyUrl]"], ".property-card__title", CARD, dialect="morizon"),
    Portal("gratka", "https://gratka.pl", ["a.property-card", "[data-cy=card]"], ".property-card__title", CARD, dialect="gratka"),
    Portal("domiporta", "https://www.domiporta.pl", ["article.sneakpeak"], "h2.sneakpeak__title--bold", {"price_text": "span.sneakpeak__price_value", "location_text": ".sneakpeak__title--inblock", "text": ".sneakpeak__description"}, link="h2.sneakpeak__title--bold a | a.sneakpeak__picture_container", dialect="domiporta"),
    Portal("nieruchomosci_online", "https://www.nieruchomosci-online.pl", ["div.tile"], "h2.name a", {"price_text": ".primary-display span:first-child", "location_text": "p.province", "area_text": "span.area", "rooms_text": "span.rooms, [data-param=rooms]"}, link="h2.name a", price="plain"),
    Portal("szybko", "https://szybko.pl", [".offer-card, .search-result-item, [data-offer-id], .listing-card, article.offer"], ".offer-card__title, .listing-card__title, h2.offer-title, a.offer-link", {"price_text": ".offer-card__price, .listing-card__price, .offer-price, .price-value", "location_text": ".offer-card__location, .listing-card__location, .offer-location", "area_text": ".offer-card__area, .listing-card__params .area, .offer-area", "rooms_text": ".offer-card__rooms, .listing-card__params .rooms, .offer-rooms"}, link="a.offer-card__link, a.listing-card__link, a[href*='/oferta/'], a[href*='/ogloszenie/']", price="plain"),
    Portal("olx", "https://www.olx.pl", ["[data-testid=ad-card-title] a", "h6 a[href*='/d/oferta/']", ".css-rc5s2u a, .css-1bbgabe a"], "", {"price_text": "[data-testid=ad-price]", "location_text": "[data-testid=location-date]"}, price="olx"),
]
FIELDS = ["title", "url", "price_text", "location_text", "text", "area_text", "rooms_text"]


#: An address on the portal itself, which needs no rules to be joined.
OWN = re.compile(r"(?:/[\w-]+)+", re.A)
PRICE = re.compile(r"\d.*zł|PLN", re.I)


def _url(p: Portal, href: str) -> str:
    return p.base + href if OWN.fullmatch(href) else urljoin(p.base, href)


def _found(page: Page, card: int, p: Portal, title: str, href: str) -> dict[str, str | None]:
    out: dict[str, str | None] = dict.fromkeys(FIELDS)
    for name, selector in p.fields.items():
        if (n := page.first(selector, card)) is not None:
            out[name] = page.said(n)
    out["title"], out["url"] = title, _url(p, href)
    return out


def olx_cards(page: Page, p: Portal) -> Iterator[dict]:
    """Title links with the card around them; else bare offer links, each address once; else a last kind of link."""
    for selector in p.cards:
        if links := list(page.select(selector)):
            break
    else:
        links = []
    bare = [] if links else page.select(BARE)
    seen: set[str] = set()
    got = False
    for a in bare:
        href, title = page.kinds[a].attrs.get("href", ""), page.said(a)
        if href not in seen and len(title) >= 5:
            got = True
            yield dict.fromkeys(FIELDS) | {"title": title, "url": _url(p, href), "text": title}
        seen.add(href)
    for a in links or ([] if got else page.select(LAST_LINK)):
        href, title = page.kinds[a].attrs.get("href", ""), page.said(a)
        if not href or not title:
            continue
        card = page.parents[a]
        while card >= 0 and not (page.kinds[card].tag == "div" and "data-testid" in page.kinds[card].attrs):
            card = page.parents[card]
        if card < 0:
            yield dict.fromkeys(FIELDS) | {"title": title, "url": _url(p, href), "text": title}
            continue
        out = _found(page, card, p, title, href)
        if out["price_text"] is None:
            out["price_text"] = next((s.strip() for s in page.strings(card) if PRICE.search(s)), None)
        out["text"] = page.said(card, " ")[:300]
        yield out


def cards(html: str, p: Portal) -> Iterator[dict]:
    page = tree(html).look(p.asked)
    if p.name == "olx":
        yield from olx_cards(page, p)
        return
    found: list[int] = []
    for selector in p.cards:
        if found := list(page.select(selector)):
            break
    for card in found:
        title = page.said(t) if (t := page.first(p.title, card)) is not None else ""
        link = card if not p.link else next((n for s in p.link.split("|") if (n := page.first(s, card)) is not None), None)
        href = page.kinds[link].attrs.get("href", "") if link is not None else ""
        if title and href:
            yield _found(page, card, p, title, href)


def _by_name(column: Column, made: dict[str, Column]) -> Column:
    out = F.lit(None)
    for name, c in made.items():
        out = F.when(column == name, c).otherwise(out)
    return out


def _raw(kind: str) -> str:
    return f"page_id {kind}, source_portal string, seq int, " + ", ".join(f"{f} string" for f in FIELDS)


#: Pages that are read before their rows are handed on, and characters of pages.
PIECE, PIECE_CHARS = 256, 4_000_000


def pieces(batch: pa.RecordBatch) -> Iterator[list[tuple]]:
    """Rows (row of the batch, portal, html) of a batch (key, portal, html), a piece at a time: what a task holds doesn't grow with the batch."""
    portals, texts = batch.column(1), batch.column(2)
    for at in range(0, batch.num_rows, PIECE):
        part, chars = [], 0
        for n in range(at, min(at + PIECE, batch.num_rows)):
            html = texts[n].as_py()
            part.append((n, portals[n].as_py(), html))
            chars += len(html or "")
            if chars > PIECE_CHARS:
                yield part
                part, chars = [], 0
        if part:
            yield part


def _cards_of(batch: pa.RecordBatch, by: dict[str, Portal]) -> Iterator[list[pa.Array]]:
    """The cards of a batch of pages as columns, a piece at a time: page_id, source_portal, seq and FIELDS."""
    for part in pieces(batch):
        at, seq, portal, rows = [], [], [], []
        for i, p, html in part:
            if p in by and html is not None:
                for n, x in enumerate(cards(html, by[p])):
                    at.append(i)
                    portal.append(p)
                    seq.append(n)
                    rows.append(x)
        if rows:
            yield [batch.column(0).take(pa.array(at, pa.int64())), pa.array(portal, pa.string()), pa.array(seq, pa.int32()), *(pa.array([x[f] for x in rows], pa.string()) for f in FIELDS)]


def search_results(pages: DataFrame) -> DataFrame:
    """Listings of landed pages(page_id, portal, html), in their order on the page (seq). Unknown portals have none."""
    by, schema = {p.name: p for p in PORTALS}, _raw(pages.schema["page_id"].dataType.simpleString())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for columns in _cards_of(b, by):
                yield pa.RecordBatch.from_arrays(columns, names=["page_id", "source_portal", "seq", *FIELDS])

    return listed(pages.select("page_id", "portal", "html").mapInArrow(run, schema))


def register_cards(spark: SparkSession, name: str = "search_cards") -> None:
    """A table function for SQL: name(TABLE(pages)), of pages(page_id long, portal, html), has a row for each card: page_id, source_portal, seq and the texts of FIELDS.

    It gets pages in Arrow batches, so it can't stand to the right of LATERAL, where Spark takes functions of single rows only.
    """
    by = {p.name: p for p in PORTALS}

    @arrow_udtf(returnType=_raw("long"))
    class Cards:
        def eval(self, pages: pa.RecordBatch) -> Iterator[pa.Table]:
            given = pa.RecordBatch.from_arrays([pages.column("page_id").cast(pa.int64()), pages.column("portal"), pages.column("html")], names=["page_id", "portal", "html"])
            for columns in _cards_of(given, by):
                yield pa.Table.from_arrays(columns, names=["page_id", "source_portal", "seq", *FIELDS])

    spark.udtf.register(name, Cards)


def listed(raw: DataFrame) -> DataFrame:
    """Listings of cards as they were read: page_id, source_portal, seq and the texts of FIELDS."""
    source = F.col("source_portal")
    price = {"olx": parse.olx_price, "digits": parse.digits_price, "plain": parse.plain_price}
    place = F.when(source == "olx", parse.before_date(F.col("location_text"))).otherwise(F.col("location_text"))
    where = {p.name: parse.location(place, p.dialect) for p in PORTALS}
    return raw.select(
        "page_id", "seq", "source_portal", "title", "url",
        _by_name(source, {p.name: price[p.price](F.col("price_text")) for p in PORTALS}).cast("double").alias("price"),
        F.coalesce(_by_name(source, {k: v[0] for k, v in where.items()}).cast("string"), F.lit("")).alias("city"),
        F.coalesce(_by_name(source, {k: v[1] for k, v in where.items()}).cast("string"), F.lit("")).alias("voivodeship"),
        F.coalesce("text", "title").alias("raw_description"), parse.area(F.col("area_text")).alias("area"), parse.first_int(F.col("rooms_text")).alias("rooms"),
        parse.marked_share(F.col("title")).alias("is_share"), parse.first_fraction(F.col("title")).alias("fraction"),
    )


#: Where single listings' pages hold the description; others: the longest paragraph over 100 characters.
DETAIL = {"olx": "[data-cy=ad_description] div, .css-1t507yq", "morizon": ".description__text, .property-description, [itemprop=description]"}
ANY_DETAIL = [".description", ".offer-description", "[itemprop=description]", ".text-description", ".ad-description", ".css-1bi2g79"]
OLX_PRICE = "[data-testid=ad-price-container] h3, .css-90xrc0"
LINES = {"olx": "li.css-ox1rxj, [data-testid=ad-params] li", "morizon": ".property-params tr, .param-list li, .params__item"}
#: All that is asked of a listing's page; of other portals ANY_DETAIL and, if need be, paragraphs.
DETAIL_ASKED = {p: frozenset((DETAIL[p], LINES[p], *([OLX_PRICE] if p == "olx" else []))) for p in DETAIL}
OTHER_ASKED = frozenset((*ANY_DETAIL, "p"))


def detail(html: str, portal: str) -> tuple[str | None, str | None, list[str]]:
    """Description, price text and parameter lines of one listing's page."""
    page = tree(html).look(DETAIL_ASKED.get(portal, OTHER_ASKED))
    lines = [page.said(n, " ") for n in page.select(LINES[portal])] if portal in LINES else []
    if portal in DETAIL:
        n = page.first(DETAIL[portal])
        price = page.first(OLX_PRICE) if portal == "olx" else None
        return page.said(n, " ") if n is not None else None, page.said(price) if price is not None else None, lines
    length = lambda n: sum(map(len, page.strings(n)))
    for selector in ANY_DETAIL:
        if (n := page.first(selector)) is not None and length(n) > 100:
            return page.said(n, " "), None, lines
    longest = max(page.select("p"), key=length, default=None)
    return (page.said(longest, " ") if longest is not None and length(longest) > 100 else None), None, lines


def details(pages: DataFrame) -> DataFrame:
    """One row for each of pages(page_id, portal, html): full_description (3000 characters), price, area, floor, params, kw (masked)."""
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in pieces(b):
                full, price, lines = zip(*(detail(html or "", p) for _, p, html in part), strict=True)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(part[0][0], len(part)), pa.array(full, pa.string()), pa.array(price, pa.string()), pa.array(lines, pa.list_(pa.string()))], names=["page_id", "full", "price_text", "lines"])

    raw = pages.select("page_id", "portal", "html").mapInArrow(run, f"page_id {kind}, full string, price_text string, lines array<string>")
    sized = F.transform(F.filter("lines", lambda s: s.contains("Powierzchnia")), parse.area)
    storey = F.transform(F.filter("lines", lambda s: s.contains("Piętro") & ~s.contains("Powierzchnia")), parse.first_int)
    last = lambda x: F.try_element_at(F.filter(x, lambda v: v.isNotNull()), F.lit(-1))
    return raw.select("page_id", F.substring("full", 1, 3000).alias("full_description"), parse.olx_price(F.col("price_text")).alias("price"), last(sized).alias("area"), last(storey).alias("floor"), parse.parameters(F.col("lines")).alias("params"), parse.land_register(F.coalesce("full", F.lit(""))).alias("kw"))


def longest_paragraph(html: Column, least: int = 100) -> Column:
    """The longest <p> over least characters, by Columns alone: markup inside it removed."""
    ps = F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<p\b[^>]*>(.*?)</p>"), F.lit(1)), lambda p: F.trim(F.regexp_replace(F.regexp_replace(p, r"<[^>]*>", " "), r"\s+", " ")))
    best = F.element_at(F.array_sort(ps, lambda a, b: F.length(a) - F.length(b)), -1)
    return F.when((F.size(ps) > 0) & (F.length(F.try_element_at(F.array_sort(ps, lambda a, b: F.length(a) - F.length(b)), F.lit(-1))) > least), best)


def blocked(html: Column, status: Column) -> Column:
    """Did the portal refuse? By status, an empty page, a challenge's title, or its words on a short page."""
    n = F.length(html)

    def told(low: Column) -> Column:
        some = F.lit(False)
        for w in rules.BLOCKED_WORDS:
            some = some | low.contains(w)
        return low.contains("<title>just a moment</title>") | low.contains("verify you are human") & (n < 50_000) | some & (n < 15_000)

    # an array of one, so that a page is lower-cased once and not for each of the words; a page is empty if it has nothing but space
    return F.coalesce(status.isin(rules.BLOCKED_STATUS), F.lit(False)) | ~F.coalesce(html.rlike(r"(?U)\S"), F.lit(False)) | F.exists(F.array(F.lower(html)), told)
