"""The text rules, as data.

The lists below are fixed values: the expressions, their order and their weights must equal the
documented ones for scores to be right. Letters with Polish diacritics stand beside the plain ones, as
sellers often leave the marks out.
"""

from __future__ import annotations

#: Strong signs that a share of a property is for sale.
HIGH = [
    r"sprzeda[żz] udzia[łl]u",
    r"sprzeda[żz] udzia[łl]",
    r"udzia[łl]\s+\d+\s*/\s*\d+",
    r"wsp[óo][łl]w[łl]asno[śs][ćc]\s+sprzeda",
    r"sprzedam\s+udzia[łl]",
    r"sprzeda\s+udzia[łl]",
    r"udzia[łl]\s+w\s+mieszkaniu",
    r"udzia[łl]\s+w\s+domu",
    r"udzia[łl]\s+w\s+lokalu",
    r"udzia[łl]\s+w\s+kamienicy",
    r"udzia[łl]\s+w\s+dzia[łl]ce",
    r"udzia[łl]\s+w\s+budynku",
    r"udzia[łl]\s+w\s+terenie",
    r"sprzeda[żz]\s+cz[ęe][śs]ci\s+nieruchomo[śs]ci",
    r"udzia[łl]\s+w\s+prawie\s+w[łl]asno[śs]ci",
    r"syndyk\s+sprzeda.*udzia[łl]",
    r"udzia[łl][óo]w\s+w\s+nieruchomo[śs]ci",
]
#: Likely signs.
MEDIUM = [
    r"udzia[łl]\s+w\s+nieruchomo[śs]ci",
    r"cz[ęe][śs][ćc]\s+nieruchomo[śs]ci",
    r"u[łl]amek",
    r"u[łl]amkow[aey]\s+cz[ęe][śs][ćc]",
    r"wsp[óo][łl]w[łl]a[śs]ciciel",
    r"wsp[óo][łl]w[łl]asno[śs][ćc]",
    r"zniesienie\s+wsp[óo][łl]w[łl]asno[śs]ci",
    r"dzia[łl]\s+spadkow[yae]",
    r"udzia[łl]\s+spadkow[yae]",
    r"udzia[łl]y\s+w\s+nieruchomo[śs]ci",
    r"udzia[łl][óo]w",
    r"udzia[łl]em",
    r"udzia[łl]u\s+w",
]
#: Weak signs. The last one stands twice in the documented list and is counted once.
LOW = [
    r"udzia[łl]",
    r"wsp[óo][łl]w[łl]asno[śs][ćc]",
    r"spadek",
    r"spadkobierc[aóo]w",
    r"cz[ęe][śs][ćc]\s+dzia[łl]ki",
    r"podzia[łl]\s+maj[ąa]tku",
]
#: The legal setting; 3 points each, 10 at most.
INHERITANCE = [
    r"spadek",
    r"spadkobierc[aóo]w",
    r"spadkow[yae]",
    r"dzia[łl]\s+spadku",
    r"post[ęe]powanie\s+spadkowe",
    r"testament",
    r"zachowek",
    r"ksi[ęe]ga\s+wieczysta",
    r"kw\s+[a-z]{2}\d+",
    r"s[ąa]d\s+rejonowy",
    r"akt\s+notarialny",
    r"notariusz",
    r"podzia[łl]\s+maj[ąa]tku",
    r"rozw[óo]d",
    r"syndyk",
]
#: What takes points off, all that apply.
PENALTIES = [
    (r"udzia[łl]\s+w\s+gruncie\s+pod\s+budynkiem", -35),
    (r"udzia[łl]y\s+w\s+sp[óo][łl]ce", -30),
    (r"udzia[łl][óo]w\s+w\s+sp[óo][łl]ce", -30),
    (r"udzia[łl]\s+w\s+sp[óo][łl]ce", -30),
    (r"wk[łl]ad\s+w[łl]asny", -20),
    (r"udzia[łl]\s+w\s+drodze", -15),
    (r"cz[ęe][śs]ci\s+wsp[óo]lne", -15),
]
#: Common fractions, by priority; then any plausible one; then glyphs.
FRACTIONS = ["1/2", "1/3", "1/4", "1/5", "1/6", "1/8", "1/10", "1/12", "1/16", "2/3", "3/4", "3/8", "5/8", "7/8"]
GLYPHS = [("½", "1/2"), ("¼", "1/4"), ("¾", "3/4"), ("⅓", "1/3"), ("⅔", "2/3"), ("⅕", "1/5"), ("⅛", "1/8")]
#: Points by tier of the title and of the description, and single bonuses.
TITLE_POINTS, TEXT_POINTS = (35, 25, 10), (25, 18, 8)
FRACTION_POINTS, TRUSTEE_POINTS, PRICE_POINTS = 15, 20, 8
SHARE_FROM, CHEAP_PER_M2 = 25, 3000
#: How a property comes to be sold, first match wins.
SALE_SOURCES = [
    ("syndyk", r"syndyk|upad[łl]o[śs]|masa upad"),
    ("spadek", r"spadek|spadku|dziedzicz|odziedzicz"),
    ("licytacja", r"licytac|komorni|egzekuc"),
    ("rozwód", r"rozw[oó]d|podzia[łl]\s*maj[aą]tk"),
]
#: Kinds of property by title, first match wins.
PROPERTY_TYPES = [
    ("mieszkanie", r"mieszkan|lokal\s*mieszk"),
    ("dom", r"\bdom\b|\bdomu\b|zabudow"),
    ("działka", r"dzia[łl]k|grunt"),
    ("garaż", r"gara[żz]|hal[aie]\s*gara"),
]
#: Words that mark a share in a title.
SHARE_WORDS = ["udział", "udzial", "1/2", "1/3", "1/4", "1/6", "1/8", "współwłasność", "wspolwlasnosc"]
#: What pages say that refuse to answer, and the statuses that do.
BLOCKED_WORDS = ["just a moment", "access denied", "captcha", "verify you are human", "challenge-platform", "cf-browser-verification", "ray id", "attention required", "enable javascript", "please turn javascript on", "checking your browser", "bot detection", "blocked", "too many requests", "rate limit"]
BLOCKED_STATUS = [403, 429, 503, 520, 521, 522, 523, 524]
#: The sources in registry order, those that a listing may name, and the voivodeships.
PORTALS = ["otodom", "morizon", "domiporta", "olx", "nieruchomosci_online"]
LISTING_SOURCES = ["olx", "otodom", "gratka", "morizon", "domiporta", "manual"]
SAVED_STATUS = ["new", "contacted", "visited", "rejected", "purchased"]
VOIVODESHIPS = ["dolnośląskie", "kujawsko-pomorskie", "lubelskie", "lubuskie", "łódzkie", "małopolskie", "mazowieckie", "opolskie", "podkarpackie", "podlaskie", "pomorskie", "śląskie", "świętokrzyskie", "warmińsko-mazurskie", "wielkopolskie", "zachodniopomorskie"]
