"""License scans by ordered signature rules.

A rule is a regular expression over the text's words (A-Z lower-cased, everything but ASCII letters,
digits and other scripts' letters turned into single spaces), a label, a priority and a keyword that
every match contains. Only rules whose keyword occurs in a text run on it. Where detections overlap,
they are taken by priority, then length, then start; one whose words lie inside those of a taken
detection is dropped.

The rules are written by family: each has its names, the versions it comes in, and whether a bare
name is evidence enough. Around them stand the phrases in which licenses are granted, and beside them sentences of the
licenses' own texts and headers.

Defined results: a null or empty text has no words and no labels and score 0; rows are scanned one
by one and whole, however long; repeated rows give equal results; of detections alike in priority, length and start the rule listed
first is taken; an empty table gives none; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessera.llm.common import ALNUM, per_document

#: Fixed by contract: phrases whose every place counts.
BASE = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]

#: Label, keyword, name as a regular expression, versions, does the bare name count.
FAMILIES = [
    ("apache", "apache", r"apache(?: software)?", ["1 0", "1 1", "2 0"], False),
    ("mit", "mit", r"mit", [], False),
    ("mit", "x11", r"x11", [], False),
    ("mit", "expat", r"expat", [], False),
    ("bsd", "bsd", r"(?:(?:new|modified|simplified|free|original) )?bsd", ["0 clause", "1 clause", "2 clause", "3 clause", "4 clause"], False),
    ("gpl", "general public", r"(?:gnu )?general public", ["1", "2", "3"], True),
    ("lgpl", "general public", r"(?:gnu )?(?:lesser|library) general public", ["2", "2 1", "3"], True),
    ("agpl", "affero", r"(?:gnu )?affero general public", ["1", "3"], True),
    ("fdl", "free documentation", r"(?:gnu )?free documentation", ["1 1", "1 2", "1 3"], True),
    ("mpl", "mozilla", r"mozilla public", ["1 0", "1 1", "2 0"], True),
    ("epl", "eclipse", r"eclipse public", ["1 0", "2 0"], True),
    ("edl", "eclipse", r"eclipse distribution", ["1 0"], True),
    ("eupl", "european union", r"european union public", ["1 0", "1 1", "1 2"], True),
    ("cddl", "development and distribution", r"common development and distribution", ["1 0", "1 1"], True),
    ("cpl", "common public", r"common public", ["1 0"], True),
    ("artistic", "artistic", r"artistic", ["1 0", "2 0"], False),
    ("zlib", "zlib", r"zlib(?: libpng)?", [], False),
    ("isc", "isc", r"isc", [], False),
    ("boost", "boost", r"boost software", ["1 0"], True),
    ("openssl", "openssl", r"openssl", [], False),
    ("php", "php", r"php", ["3 0", "3 01"], False),
    ("python", "python", r"python(?: software foundation)?", ["2 0"], False),
    ("ofl", "open font", r"(?:sil )?open font", ["1 0", "1 1"], True),
    ("odbl", "open database", r"open database", ["1 0"], True),
    ("odc-by", "open data commons", r"open data commons attribution", ["1 0"], True),
    ("pddl", "public domain dedication", r"public domain dedication(?: and)?", ["1 0"], True),
    ("unlicense", "unlicense", r"unlicense", [], True),
    ("wtfpl", "wtfpl", r"wtfpl", ["1", "2"], True),
    ("osl", "open software", r"open software", ["1 0", "2 0", "2 1", "3 0"], True),
    ("afl", "academic free", r"academic free", ["2 0", "2 1", "3 0"], True),
    ("ms-pl", "microsoft", r"microsoft public", [], True),
    ("ms-rl", "microsoft", r"microsoft reciprocal", [], True),
    ("sspl", "server side", r"server side public", ["1"], True),
    ("busl", "business source", r"business source", ["1 0", "1 1"], True),
    ("elastic", "elastic", r"elastic", ["1", "2"], False),
    ("polyform", "polyform", r"polyform (?:noncommercial|small business|internal use|strict|shield|perimeter)", ["1 0 0"], True),
    ("openrail", "rail", r"(?:creativeml )?open rail(?: m)?", ["1"], True),
    ("llama", "llama", r"llama [234] community", [], True),
    ("ecl", "educational community", r"educational community", ["1 0", "2 0"], True),
    ("ncsa", "ncsa", r"(?:university of illinois )?ncsa(?: open source)?", [], False),
    ("postgresql", "postgresql", r"postgresql", [], False),
    ("vim", "vim", r"vim", [], False),
    ("ruby", "ruby", r"ruby", [], False),
    ("mulan", "mulan", r"mulan (?:permissive|public)(?: software)?", ["1", "2"], True),
    ("cecill", "cecill", r"cecill(?: [abc])?", ["1 0", "1 1", "2 0", "2 1"], True),
    ("json", "json", r"json", [], False),
    ("beerware", "beerware", r"beerware", [], True),
    ("curl", "curl", r"curl", [], False),
    ("libpng", "libpng", r"libpng", ["2 0"], False),
    ("intel", "intel", r"intel (?:simplified software|open source)", [], True),
    ("nvidia", "nvidia", r"nvidia (?:source code|open model|software)", [], True),
    ("oracle", "oracle", r"oracle (?:binary code|technology network|universal permissive)", ["1 0"], True),
]
#: Creative Commons: terms in short and in words.
COMMONS = [("by", "attribution"), ("by nc", "attribution non ?commercial"), ("by nd", "attribution no ?deriv(?:ative)?s?(?: works)?"), ("by sa", "attribution share ?alike"), ("by nc nd", "attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?"), ("by nc sa", "attribution non ?commercial share ?alike")]
#: Label, keyword, phrase, of legal lines that name no family.
NOTICES = [
    ("reserved", "rights", r"(?:all|some) rights reserved"),
    ("copyright", "copyright", r"copyright (?:c )?(?:19|20)[0-9][0-9]"),
    ("copyright", "copyright", r"copyright (?:c |by |the )+[^ ]+"),
    ("proprietary", "proprietary", r"proprietary (?:and confidential|software|information)"),
    ("proprietary", "confidential", r"confidential and proprietary"),
    ("proprietary", "consent", r"without (?:the )?(?:prior|express) written consent"),
    ("proprietary", "permission", r"without (?:the )?(?:prior|express) written permission"),
    ("public-domain", "public domain", r"(?:released|placed|dedicated) (?:in|into|to) the public domain"),
    ("public-domain", "cc0", r"cc0(?: 1 0)?"),
    ("mit", "permission is hereby", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("isc", "permission to use", r"permission to use copy modify and or distribute this software for any purpose"),
    ("bsd", "redistribution and use", r"redistribution and use in source and binary forms"),
    ("gpl", "free software foundation", r"under the terms of the gnu general public license as published by the free software foundation"),
    ("zlib", "altered source", r"altered source versions must be plainly marked as such"),
    ("disclaimer", "as is", r"(?:provided|distributed) (?:on an )?as is(?: basis)?(?: without warrant(?:y|ies))?"),
    ("disclaimer", "warranties or conditions", r"without warranties or conditions of any kind"),
]
#: Label, keyword, phrase, of sentences in the licenses' own texts and headers.
BODIES = [
    ("mit", "above copyright notice and this permission", r"the above copyright notice and this permission notice (?:including the next paragraph )?shall be included in all copies or substantial portions of the software"),
    ("mit", "to deal in the software", r"to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies"),
    ("mit", "the software is provided as is", r"the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability"),
    ("isc", "provided that the above copyright notice", r"fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("isc", "the author disclaims all warranties", r"the software is provided as is and the author disclaims all warranties with regard to this software"),
    ("bsd", "redistributions of source code must retain", r"redistributions of source code must retain the (?:above )?copyright notice"),
    ("bsd", "redistributions in binary form must reproduce", r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3.clause", "endorse or promote products", r"(?:may be used|be used) to endorse or promote products derived from this software"),
    ("bsd-4.clause", "advertising materials mentioning", r"all advertising materials mentioning features or use of this software must display"),
    ("bsd", "by the copyright holders and contributors as is", r"this software is provided by the copyright holders and contributors as is"),
    ("apache-2.0", "licensed under the apache license", r"licensed under the apache license version 2 0(?: the license)?"),
    ("apache-2.0", "you may not use this file except", r"you may not use this file except in compliance with the license"),
    ("apache-2.0", "apache org licenses", r"apache org licenses license 2 0"),
    ("apache-2.0", "perpetual worldwide non exclusive no charge", r"perpetual worldwide non exclusive no charge royalty free irrevocable (?:copyright|patent) license"),
    ("apache", "licensed to the apache software foundation", r"licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("apache-1.1", "this product includes software developed by the apache", r"this product includes software developed by the apache (?:software foundation|group)"),
    ("gpl", "is free software you can redistribute it", r"(?:this program|this file|it|[^ ]+) is free software you can redistribute it and or modify it"),
    ("gpl-2", "either version 2 of the license", r"either version 2 of the license or at your option any later version"),
    ("gpl-3", "either version 3 of the license", r"either version 3 of the license or at your option any later version"),
    ("gpl", "copy of the gnu general public license", r"you should have received a copy of the gnu general public license along with"),
    ("lgpl", "copy of the gnu lesser general public license", r"you should have received a copy of the gnu lesser general public license along with"),
    ("agpl", "copy of the gnu affero general public license", r"you should have received a copy of the gnu affero general public license along with"),
    ("gpl", "everyone is permitted to copy and distribute", r"everyone is permitted to copy and distribute verbatim copies of this license document"),
    ("gpl-3", "free copyleft license for software", r"the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("lgpl-2.1", "either version 2 1 of the license", r"either version 2 1 of the license or at your option any later version"),
    ("agpl-3", "remotely through a computer network", r"users interacting with it remotely through a computer network"),
    ("mpl-2.0", "source code form is subject to the terms", r"this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2.0", "mozilla org mpl 2 0", r"you can obtain one at (?:https? )?mozilla org mpl 2 0"),
    ("mpl-1.1", "mozilla public license version 1 1", r"the contents of this file are subject to the mozilla public license version 1 1"),
    ("epl-1.0", "eclipse public license v1 0", r"made available under the terms of the eclipse public license v1 0"),
    ("epl-2.0", "eclipse public license 2 0", r"made available under the terms of the eclipse public license 2 0"),
    ("cddl", "common development and distribution license", r"the contents of this file are subject to the terms of the common development and distribution license"),
    ("eupl", "licensed under the eupl", r"licensed under the eupl(?: (?:version |v ?)?1 [012])?"),
    ("unlicense", "free and unencumbered software", r"this is free and unencumbered software released into the public domain"),
    ("unlicense", "anyone is free to copy modify publish", r"anyone is free to copy modify publish use compile sell or distribute this software"),
    ("wtfpl", "do what the fuck you want to", r"you just do what the fuck you want to"),
    ("zlib", "must not be misrepresented", r"the origin of this software must not be misrepresented"),
    ("zlib", "may not be removed or altered", r"this notice may not be removed or altered from any source distribution"),
    ("boost-1.0", "obtaining a copy of the software and accompanying", r"obtaining a copy of the software and accompanying documentation covered by this license"),
    ("boost-1.0", "boost software license", r"distributed under the boost software license version 1 0"),
    ("artistic-2.0", "copyright holder intends", r"the copyright holder intends that a given package remain available as open source"),
    ("ofl-1.1", "this font software is licensed under", r"this font software is licensed under the sil open font license version 1 1"),
    ("ofl", "reserved font name", r"with reserved font name"),
    ("python", "psf hereby grants licensee", r"psf hereby grants licensee a nonexclusive royalty free world wide license"),
    ("python", "licensee agrees", r"licensee agrees to include in any such work a brief summary"),
    ("openssl", "openssl project for use", r"developed by the openssl project for use in the openssl toolkit"),
    ("public-domain", "with this deed has dedicated", r"the person who associated a work with this deed has dedicated the work"),
    ("public-domain", "waives all of", r"waives all of (?:his or her|their) rights to the work worldwide"),
    ("cc-by", "you must give appropriate credit", r"you must give appropriate credit provide a link to the license and indicate if changes were made"),
    ("cc-by-sa", "distribute your contributions under the same license", r"you must distribute your contributions under the same license as the original"),
    ("cc-by-nc", "you may not use the material for commercial", r"you may not use the material for commercial purposes"),
    ("cc-by-nd", "you may not distribute the modified material", r"you may not distribute the modified material"),
    ("cc-by-sa-3.0", "text is available under the creative commons", r"text is available under the creative commons attribution share ?alike license"),
    ("cc-by", "except where otherwise noted", r"except where otherwise noted content on this (?:site|page|wiki) is licensed under a creative commons"),
    ("busl", "the licensor hereby grants you the right to copy", r"the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use"),
    ("elastic-2", "hosted or managed service", r"you may not provide the software to third parties as a hosted or managed service"),
    ("sspl-1", "make the functionality of the program", r"if you make the functionality of the program or a modified version available to third parties as a service"),
    ("proprietary", "unauthorized copying", r"unauthorized copying of this (?:file|software|document)(?: via any medium)? is strictly prohibited"),
    ("proprietary", "no part of this", r"no part of this (?:publication|book|document|work) may be reproduced"),
    ("proprietary", "end user license agreement", r"end user license agreement"),
    ("proprietary", "trade secret", r"contains? (?:confidential and )?trade secrets?(?: information)? of"),
    ("reserved", "terms of use", r"(?:use of|by using) this (?:site|website) (?:is subject to|you agree to) (?:our |the |these )?terms of use"),
    ("copyright", "copyright holder", r"(?:property of|with permission of) the(?:ir)? (?:respective )?copyright holders?"),
]
#: Bytes in a block of the index of taken detections.
BLOCK = 256
GRANT = r"(?:(?:dual )?licen[cs]ed|released|distributed|available|published|provided|covered|governed|redistributed) (?:and [^ ]+ )?(?:under|by|subject to) (?:the )?(?:terms (?:and conditions )?of )?(?:the )?"
CALLED = r" (?:public )?licen[cs]e(?: agreement)?"


@dataclass(frozen=True)
class Rule:
    label: str
    keyword: str
    pattern: str
    #: Smaller goes first.
    priority: int
    family: str


def rules() -> list[Rule]:
    """All rules, in order of priority. A family whose names share no keyword has a row for each, and its other rules once."""
    out = []
    for label, key, name, versions, bare in FAMILIES:
        out.append(Rule(label, key, rf"{GRANT}{name}(?:{CALLED})?", 20, label))
        for v in versions:
            out.append(Rule(f"{label}-{v.replace(' ', '.')}", key, rf"(?:{GRANT})?{name}(?:{CALLED})? (?:version |v ?)?{v}(?: or (?:any )?later(?: version)?)?", 10, label))
            short = f"{label.replace('-', ' ')} {v}"
            out.append(Rule(f"{label}-{v.replace(' ', '.')}", "spdx", rf"spdx license identifier {short}(?: or later| only)?", 5, label))
        out.append(Rule(label, "spdx", rf"spdx license identifier {label.replace('-', ' ')}", 6, label))
        out.append(Rule(label, key, rf"{name}{CALLED}", 30, label))
        if bare:
            out.append(Rule(label, key, name, 40, label))
    for terms, words in COMMONS:
        label = f"cc-{terms.replace(' ', '-')}"
        for v in ("1 0", "2 0", "2 5", "3 0", "4 0"):
            out.append(Rule(f"{label}-{v.replace(' ', '.')}", "cc", rf"(?:{GRANT})?cc {terms} {v}(?: international| unported)?", 10, "cc"))
            out.append(Rule(f"{label}-{v.replace(' ', '.')}", "creative", rf"(?:{GRANT})?creative commons {words} {v}(?: international| unported)?(?:{CALLED})?", 10, "cc"))
        out.append(Rule(label, "cc", rf"cc {terms}", 30, "cc"))
        out.append(Rule(label, "creative", rf"creative commons {words}", 30, "cc"))
        out.append(Rule(label, "creative", rf"creativecommons org licenses {terms}", 8, "cc"))
    out += [Rule(label, key, pattern, 25, label) for label, key, pattern in NOTICES]
    out += [Rule(label, key, pattern, 7, label) for label, key, pattern in BODIES]
    return sorted(dict.fromkeys(out), key=lambda r: r.priority)


class Scanner:
    """The rules by keyword, compiled when first run."""

    def __init__(self, ordered: list[Rule]):
        self.by: dict[bytes, list[tuple[int, Rule]]] = {}
        for k, r in enumerate(ordered):
            self.by.setdefault(r.keyword.encode(), []).append((k, r))
        self.compiled: dict[int, re.Pattern] = {}

    def detect(self, text: bytes) -> list[tuple[int, int, Rule]]:
        """Detections in a text of words with a space before, between and after: start, end in bytes, rule."""
        found = []
        for key, group in self.by.items():
            if key not in text:
                continue
            for k, r in group:
                p = self.compiled.get(k) or self.compiled.setdefault(k, re.compile(rf"(?<= )(?:{r.pattern})(?= )".encode()))
                found += [(m.start(), m.end(), k, r) for m in p.finditer(text)]
        found.sort(key=lambda x: (x[3].priority, x[0] - x[1], x[0], x[2]))
        taken: list[tuple[int, int, Rule]] = []
        near: dict[int, list[tuple[int, int]]] = {}  # the taken ones by block of starts, so that long texts stay cheap
        longest = max((b - a for a, b, _, _ in found), default=0)
        for a, b, _, r in found:
            if not any(s <= a and b <= e for k in range((a - longest) // BLOCK, a // BLOCK + 1) for s, e in near.get(k, ())):
                taken.append((a, b, r))
                near.setdefault(a // BLOCK, []).append((a, b))
        return sorted(taken, key=lambda x: x[:2])


def scan(raw: bytes, scanner: Scanner) -> tuple:
    words = raw.translate(ALNUM).split()
    text = b" " + b" ".join(words) + b" "
    places, base = [], set()
    for phrase, label in BASE:
        needle = f" {phrase} ".encode()
        at, last, before = text.find(needle), 0, 0
        while at >= 0:
            before, last = before + text.count(b" ", last, at), at
            places.append(before)
            base.add(label)
            at = text.find(needle, at + 1)
    detections = scanner.detect(text) if words else []
    labels = base | {r.label for _, _, r in detections}
    strength = 1.0
    for _, _, r in detections:
        strength *= 1 - (0.95 if r.priority <= 10 else 0.8 if r.priority <= 20 else 0.5)
    score = 1 - strength * 0.5 ** len(places)
    spans, last, before = [], 0, -1
    for a, b, r in detections:
        before, last = before + text.count(b" ", last, a), a
        spans.append(f"{r.label}:{before}:{before + 1 + text.count(b' ', a, b)}")
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score, ",".join(spans)


FIELDS = [
    T.StructField("n_words", T.LongType()), T.StructField("n_base", T.LongType()), T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType()),
    T.StructField("base_labels", T.StringType()), T.StructField("labels", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("detections", T.StringType()),
]


def license_scan(docs: DataFrame, keep: list[str] | None = None, ordered: list[Rule] | None = None) -> DataFrame:
    """Base places, labels, score and detections (label:first word:word after the last) of each row of docs(text). No shuffle."""
    scanner = Scanner(ordered or rules())
    return per_document(docs, keep or ["doc_id"], FIELDS, lambda raw: scan(raw, scanner))
