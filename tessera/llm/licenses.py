"""License scans by ordered signature rules.

A text is read as words (digits, letters, anything not ASCII; A-Z lower-cased) joined by one space, so that
punctuation and line ends don't matter to a rule. A rule is a label, a priority, a confidence, keywords and a
regular expression over whole words. The rules are written by hand, one expression for a phrase of a notice and
several for each license: its names and versions stand in the forms in which a text names a license (a grant, an
identifier, an address, a title, a field, a bare mention). That makes some hundreds of expressions.

Only rules all of whose keywords are words of the text are run. Detections are settled in the order of priority: one
that lies within the stretch of a detection already kept is suppressed ("general public license" within "gnu lesser
general public license version 3"); of equal priority the longer, then the earlier rule stays. Phrases of the base
are rules like the others, but their own counts and labels are given whatever lies over them.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessera.llm.common import ASCII_LOWER, named_back, set_aside, slices

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Phrases whose places are counted by themselves.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: label: (keywords: all of them, one of those joined by |; names, mostly without the word license; whether a name alone says enough)
FAMILIES = {
    "apache-1.0": ("apache", r"apache(?: software)?(?: license)?(?: version)? 1(?: 0)?", True),
    "apache-1.1": ("apache", r"apache(?: software)?(?: license)?(?: version)? 1 1", True),
    "apache-2.0": ("apache", r"apache(?: software)?(?: license)?(?: version| v)? (?:v2|2)(?: 0)?", True),
    "apache": ("apache", r"apache(?: software)?", False),
    "mit": ("mit|expat", r"(?:the )?(?:mit|expat)", False),
    "mit-0": ("mit", r"mit (?:0|no attribution)", True),
    "x11": ("x11", r"(?:mit )?x11", False),
    "isc": ("isc", r"isc", False),
    "0bsd": ("bsd", r"(?:bsd zero clause|zero clause bsd|0 clause bsd)", True),
    "bsd-1-clause": ("bsd", r"(?:bsd 1 clause|1 clause bsd|one clause bsd)", True),
    "bsd-2-clause": ("bsd", r"(?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd|freebsd bsd)", True),
    "bsd-3-clause": ("bsd", r"(?:bsd 3 clause|3 clause bsd|three clause bsd|new bsd|modified bsd|revised bsd)", True),
    "bsd-4-clause": ("bsd", r"(?:bsd 4 clause|4 clause bsd|four clause bsd|original bsd)", True),
    "bsd": ("bsd", r"bsd(?: style)?", False),
    "gpl-1.0": ("gpl|general 1|v1", r"(?:gnu )?(?:gpl|general public license)(?: gpl)?(?: version| v)? (?:v1|1)(?: 0)?", True),
    "gpl-2.0": ("gpl|general|gplv2 2|gplv2", r"(?:gnu )?(?:gplv2|(?:gpl|general public license)(?: gpl)?(?: version| v)? 2)(?: 0)?", True),
    "gpl-3.0": ("gpl|general|gplv3 3|gplv3", r"(?:gnu )?(?:gplv3|(?:gpl|general public license)(?: gpl)?(?: version| v)? 3)(?: 0)?", True),
    "gpl": ("gpl", r"(?:gnu )?gpl", True),
    "lgpl-2.0": ("lgpl|lesser|library 2", r"(?:gnu )?(?:lgpl|(?:lesser|library) general public license)(?: lgpl)?(?: version| v)? 2(?: 0)?", True),
    "lgpl-2.1": ("lgpl|lesser|library 1", r"(?:gnu )?(?:lgpl|(?:lesser|library) general public license)(?: lgpl)?(?: version| v)? 2 1", True),
    "lgpl-3.0": ("lgpl|lesser 3", r"(?:gnu )?(?:lgpl|lesser general public license)(?: lgpl)?(?: version| v)? 3(?: 0)?", True),
    "lgpl": ("lgpl", r"(?:gnu )?lgpl", True),
    "agpl-1.0": ("affero", r"affero general public license(?: version| v)? 1(?: 0)?", True),
    "agpl-3.0": ("agpl|affero 3", r"(?:gnu )?(?:agpl|affero general public license)(?: agpl)?(?: version| v)? 3(?: 0)?", True),
    "agpl": ("agpl", r"(?:gnu )?agpl", True),
    "gfdl-1.1": ("documentation 1", r"gnu free documentation license(?: version)? 1 1", True),
    "gfdl-1.2": ("documentation 2", r"gnu free documentation license(?: version)? 1 2", True),
    "gfdl-1.3": ("documentation 3", r"gnu free documentation license(?: version)? 1 3", True),
    "gfdl": ("documentation", r"(?:gnu )?free documentation license", True),
    "mpl-1.0": ("mozilla", r"mozilla public license(?: version| v)? 1(?: 0)?", True),
    "mpl-1.1": ("mozilla|mpl 1", r"(?:mozilla public license|mpl)(?: mpl)?(?: version| v)? 1 1", True),
    "mpl-2.0": ("mozilla|mpl 2", r"(?:mozilla public license|mpl)(?: mpl)?(?: version| v)? 2(?: 0)?", True),
    "mpl": ("mozilla", r"mozilla public", False),
    "epl-1.0": ("eclipse|epl 1", r"(?:eclipse public license|epl)(?: epl)?(?: version| v)? 1(?: 0)?", True),
    "epl-2.0": ("eclipse|epl 2", r"(?:eclipse public license|epl)(?: epl)?(?: version| v)? 2(?: 0)?", True),
    "epl": ("eclipse", r"eclipse public", False),
    "edl-1.0": ("eclipse", r"eclipse distribution license(?: version| v)?(?: 1 0)?", True),
    "cddl-1.0": ("distribution|cddl 1", r"(?:common development and distribution license|cddl)(?: cddl)?(?: version| v)? 1(?: 0)?", True),
    "cddl-1.1": ("distribution|cddl 1", r"(?:common development and distribution license|cddl)(?: cddl)?(?: version| v)? 1 1", True),
    "cddl": ("cddl", r"cddl", True),
    "cpl-1.0": ("common", r"common public license(?: version| v)?(?: 1 0)?", True),
    "eupl-1.1": ("european|eupl 1", r"(?:european union public licen[cs]e|eupl)(?: eupl)?(?: version| v)? 1 1", True),
    "eupl-1.2": ("european|eupl 2", r"(?:european union public licen[cs]e|eupl)(?: eupl)?(?: version| v)? 1 2", True),
    "eupl": ("eupl", r"eupl", True),
    "cecill-2.1": ("cecill", r"cecill(?: version| v)? 2 1", True),
    "cecill": ("cecill", r"cecill", True),
    "artistic-1.0": ("artistic", r"artistic license(?: version| v)? 1(?: 0)?", True),
    "artistic-2.0": ("artistic", r"artistic license(?: version| v)? 2(?: 0)?", True),
    "artistic": ("artistic", r"artistic", False),
    "bsl-1.0": ("boost", r"boost software(?: license)?(?: version| v)?(?: 1 0)?", False),
    "busl-1.1": ("business", r"business source license(?: version| v)?(?: 1 1)?", True),
    "elastic-2.0": ("elastic", r"elastic license(?: version| v)? 2(?: 0)?", True),
    "sspl-1.0": ("side", r"server side public license(?: version| v)?(?: 1)?", True),
    "python-2.0": ("python", r"python software foundation(?: license)?(?: version| v)?(?: 2)?", False),
    "psf": ("psf", r"psf", False),
    "php-3.01": ("php", r"php license(?: version| v)? 3 01", True),
    "ruby": ("ruby", r"ruby", False),
    "zlib": ("zlib", r"zlib(?: libpng)?", False),
    "libpng": ("libpng", r"libpng", False),
    "openssl": ("openssl", r"openssl", False),
    "unlicense": ("unlicense", r"(?:the )?unlicense", True),
    "wtfpl": ("wtfpl", r"wtfpl", True),
    "zpl-2.1": ("zope", r"zope public license(?: version| v)?(?: 2 1)?", True),
    "ofl-1.1": ("sil", r"sil open font license(?: version| v)?(?: 1 1)?", True),
    "ofl": ("font", r"open font license", True),
    "odbl-1.0": ("database", r"open (?:data commons open )?database license(?: version| v)?(?: 1 0)?", True),
    "odc-by-1.0": ("commons", r"open data commons attribution(?: license)?(?: version| v)?(?: 1 0)?", False),
    "pddl-1.0": ("dedication", r"open data commons public domain dedication(?: and license)?", True),
    "cdla-permissive-2.0": ("community", r"community data license agreement permissive(?: version| v)? 2 0", True),
    "cdla-sharing-1.0": ("community", r"community data license agreement sharing(?: version| v)? 1 0", True),
    "ms-pl": ("microsoft", r"microsoft public", False),
    "ms-rl": ("reciprocal", r"microsoft reciprocal", False),
    "ncsa": ("illinois", r"university of illinois(?: ncsa)? open source", False),
    "upl-1.0": ("universal", r"universal permissive license(?: version| v)?(?: 1 0)?", True),
    "postgresql": ("postgresql", r"postgresql", False),
    "afl-3.0": ("academic", r"academic free license(?: version| v)? 3 0", True),
    "osl-3.0": ("open 3", r"open software license(?: version| v)? 3 0", True),
    "blueoak-1.0.0": ("blue", r"blue oak model license(?: version| v)?(?: 1 0 0)?", True),
    "openrail": ("openrail", r"(?:creativeml )?openrail(?: m)?", True),
    "llama": ("llama", r"llama [0-9](?: [0-9])? community", False),
    "commons-clause": ("commons clause", r"commons clause(?: license condition)?", True),
    "polyform": ("polyform", r"polyform (?:noncommercial|strict|shield|perimeter|small business|free trial)", True),
    "cc0-1.0": ("cc0", r"(?:creative commons )?cc0(?: 1 0)?(?: universal)?", True),
}
CC_PARTS = {"by": "attribution", "by-sa": "attribution share ?alike", "by-nd": "attribution no ?deriv(?:ative)?s?(?: works)?", "by-nc": "attribution non ?commercial", "by-nc-sa": "attribution non ?commercial share ?alike", "by-nc-nd": "attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?"}
CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")

#: Forms in which a family's name stands: (form, keywords, priority, confidence). A name alone counts only where it says enough.
GRANTS = "licensed|released|distributed|available|published|provided|shared|covered|redistributed|governed"
TERMS = "license|licence|licenses|licences|licensed|licenced"
UNDER = rf"(?:{GRANTS}) (?:under|by)(?: the)?(?: terms(?: and conditions)? of(?: the)?)?"
FORMS = (
    (r"spdx license identifier {name}", "spdx", 60, 1.0),
    (UNDER + r" {name}(?: licen[cs]e)?", GRANTS, 50, 0.95),
    (r"licen[cs]e[sd]? (?:type |name |id |is |as )?(?:the )?{name}", TERMS, 40, 0.85),
    (r"{name} licen[cs]es?", TERMS, 30, 0.8),
    (r"{name}", "", 10, 0.5),
)
#: Phrases of notices: label, keywords, priority, confidence, expression.
NOTICES = (
    ("mit", "hereby obtaining", 70, 0.95, r"permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "noninfringement sublicense", 70, 0.9, r"to use copy modify merge publish distribute sublicense and or sell copies"),
    ("isc", "hereby fee", 70, 0.95, r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "redistribution binary", 65, 0.9, r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", "endorse specific", 70, 0.9, r"may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-4-clause", "advertising acknowledgement|acknowledgment", 70, 0.9, r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("apache-2.0", "compliance file", 65, 0.8, r"you may not use this file except in compliance with the license"),
    ("apache-2.0", "apache 2", 70, 1.0, r"(?:https? )?(?:www )?apache org licenses license 2 0"),
    ("gpl-1.0-or-later", "later 1", 70, 1.0, r"general public license(?: as published by the free software foundation)?(?: either)? version 1(?: of the license)? or at your option any later version"),
    ("gpl-2.0-or-later", "later 2", 70, 1.0, r"general public license(?: as published by the free software foundation)?(?: either)? version 2(?: of the license)? or at your option any later version"),
    ("gpl-3.0-or-later", "later 3", 70, 1.0, r"general public license(?: as published by the free software foundation)?(?: either)? version 3(?: of the license)? or at your option any later version"),
    ("lgpl-2.1-or-later", "later lesser 2", 75, 1.0, r"lesser general public license(?: as published by the free software foundation)?(?: either)? version 2 1(?: of the license)? or at your option any later version"),
    ("lgpl-3.0-or-later", "later lesser 3", 75, 1.0, r"lesser general public license(?: as published by the free software foundation)?(?: either)? version 3(?: of the license)? or at your option any later version"),
    ("agpl-3.0-or-later", "later affero 3", 75, 1.0, r"affero general public license(?: as published by the free software foundation)?(?: either)? version 3(?: of the license)? or at your option any later version"),
    ("gpl", "program foundation", 55, 0.9, r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "library lesser", 55, 0.9, r"this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("lgpl", "lesser|library", 8, 0.6, r"gnu (?:lesser|library) general public license"),
    ("agpl", "affero", 8, 0.6, r"(?:gnu )?affero general public license"),
    ("gpl-classpath", "classpath exception", 70, 0.9, r"classpath exception"),
    ("mpl-2.0", "mozilla obtain", 70, 1.0, r"this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2.0", "incompatible secondary", 60, 0.7, r"incompatible with secondary licenses"),
    ("epl-2.0", "accompanying eclipse", 70, 1.0, r"this program and the accompanying materials are made available under the terms of the eclipse public license 2 0"),
    ("epl-1.0", "accompanying eclipse", 70, 1.0, r"this program and the accompanying materials are made available under the terms of the eclipse public license v1 0"),
    ("unlicense", "unencumbered domain", 70, 1.0, r"this is free and unencumbered software released into the public domain"),
    ("zlib", "origin misrepresented", 70, 0.9, r"the origin of this software must not be misrepresented"),
    ("zlib", "express implied held", 60, 0.7, r"provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("bsl-1.0", "obtaining machine", 70, 0.9, r"to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("wtfpl", "want public", 70, 1.0, r"do what the fuck you want to public license"),
    ("beerware", "beer|beerware", 70, 0.9, r"beer ?ware license|you can buy me a beer in return"),
    ("artistic-2.0", "artistic package", 60, 0.7, r"this package is distributed under the artistic license 2 0"),
    ("perl", "perl itself", 70, 0.9, r"under the same terms as perl(?: 5)?(?: itself)?"),
    ("python-2.0", "psf agreement", 70, 0.9, r"psf license agreement for python"),
    ("openssl", "openssl toolkit", 70, 0.9, r"this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("ofl-1.1", "font sil", 70, 1.0, r"this font software is licensed under the sil open font license version 1 1"),
    ("odbl-1.0", "opendatacommons odbl", 70, 1.0, r"opendatacommons org licenses odbl"),
    ("pddl-1.0", "opendatacommons pddl", 70, 1.0, r"opendatacommons org licenses pddl"),
    ("odc-by-1.0", "opendatacommons by", 70, 1.0, r"opendatacommons org licenses by"),
    ("cc0-1.0", "creativecommons zero", 70, 1.0, r"creativecommons org publicdomain zero 1 0"),
    ("public-domain", "creativecommons mark", 70, 1.0, r"creativecommons org publicdomain mark 1 0"),
    ("cc0-1.0", "waived neighboring", 60, 0.8, r"waived all copyright and related or neighboring rights"),
    ("public-domain", "public domain", 30, 0.6, r"(?:released |placed |dedicated )?(?:in|into|to) the public domain"),
    ("public-domain", "public domain", 20, 0.5, r"public domain (?:work|dedication|mark)|is public domain"),
    ("copyleft", "copyleft", 20, 0.4, r"copyleft"),
    ("no-derivatives", "derivative", 25, 0.5, r"no derivative works(?: allowed| permitted)?"),
    ("non-commercial", "commercial", 25, 0.5, r"(?:for )?(?:personal and )?non ?commercial (?:use|purposes)(?: only)?"),
    ("non-commercial", "commercial", 30, 0.6, r"not (?:be )?(?:used )?for commercial (?:use|purposes)|commercial use (?:is )?(?:prohibited|forbidden|not (?:allowed|permitted))"),
    ("proprietary", "proprietary confidential", 60, 0.9, r"proprietary and confidential|confidential and proprietary"),
    ("proprietary", "unauthorized copying", 60, 0.9, r"unauthorized copying(?: of this file)?(?: via any medium)?(?: is)? strictly prohibited"),
    ("proprietary", "reproduced permission", 50, 0.7, r"(?:no part of this (?:publication|work|book|document)|(?:may|must) not be reproduced) (?:[^ ]+ ){0,12}?(?:prior )?(?:written )?permission"),
    ("proprietary", "subscription agreement", 40, 0.6, r"end user license agreement|subscription agreement governs"),
    ("reserved", "rights reserved", 20, 0.6, r"(?:all|some|no) rights reserved"),
    ("reserved", "droits", 20, 0.6, r"tous droits réservés"),
    ("reserved", "alle vorbehalten", 20, 0.6, r"alle rechte vorbehalten"),
    ("reserved", "todos derechos", 20, 0.6, r"todos los derechos reservados"),
    ("copyright", "copyright", 15, 0.4, r"copyright(?: c| ©)? (?:19|20)[0-9]{2}(?: (?:19|20)[0-9]{2}){0,4}(?: by)?"),
    ("warranty-disclaimer", "warranties|warranty", 15, 0.3, r"without warrant(?:y|ies)(?: or conditions)? of any kind"),
    ("warranty-disclaimer", "merchantability", 15, 0.3, r"implied warrant(?:y|ies) of merchantability"),
    ("attribution", "reprinted permission", 15, 0.4, r"(?:reprinted|reproduced|used) (?:with|by) (?:kind )?permission"),
)


@dataclass(frozen=True)
class Rule:
    label: str
    needs: tuple[frozenset[bytes], ...]
    priority: int
    confidence: float
    pattern: re.Pattern
    base: bool = False

    def ready(self, own: set[bytes]) -> bool:
        return not any(n.isdisjoint(own) for n in self.needs)


def rule(label: str, needs: str, priority: int, confidence: float, pattern: str, base: bool = False) -> Rule:
    """A rule over words that stand between single spaces; the space before them is part of the match.

    needs are its keywords: a match has all of them, where some are joined by | one of those.
    """
    sets = tuple(frozenset(w.encode() for w in n.split("|")) for n in needs.split())
    return Rule(label, sets, priority, confidence, re.compile(f" (?:{pattern})(?= )".encode()), base)


@lru_cache
def rules() -> tuple[Rule, ...]:
    """All rules, in their order: the base, notices, then families and Creative Commons licenses in each form."""
    out = [rule(label, phrase, 0, 0.5, phrase, True) for phrase, label in BASE.items()]
    out += [rule(label, needs, priority, sure, pattern) for label, needs, priority, sure, pattern in NOTICES]
    for label, (key, name, alone) in FAMILIES.items():
        versioned = any(c.isdigit() for c in label)
        forms = FORMS if alone else FORMS[:-1]
        out += [rule(label, f"{key} {needs}", priority + 5 * versioned, sure, form.format(name=f"(?:{name})")) for form, needs, priority, sure in forms]
        if versioned and label.startswith(("gpl", "lgpl", "agpl", "gfdl")):
            out.append(rule(f"{label}-or-later", f"{key} later", 68, 0.95, rf"(?:spdx license identifier |{UNDER} )?(?:{name})(?: licen[cs]e)? or (?:at your option )?(?:any )?later(?: version)?"))
    for part, title in CC_PARTS.items():
        for version in ("", *CC_VERSIONS):
            digits = version.replace(".", " ")
            tail = f" {digits}" if version else ""
            label, bonus = f"cc-{part}" + (f"-{version}" if version else ""), 5 * bool(version) + 2 * part.count("-")
            name = f"cc {part.replace('-', ' ')}{tail}"
            out += [rule(label, f"cc {needs} {digits}", priority + bonus, sure, form.format(name=name)) for form, needs, priority, sure in FORMS]
            out.append(rule(label, f"commons {digits}", 35 + bonus, 0.9, rf"creative commons {title}(?: (?:international|unported|generic|public))?(?: licen[cs]e)?(?: version| v)?{tail}"))
            out.append(rule(label, f"creativecommons {digits}", 60 + bonus, 1.0, rf"creativecommons org licenses {part.replace('-', ' ')}{tail}"))
    return tuple(out)


@lru_cache
def by_keyword() -> dict[bytes, list[int]]:
    """For each word, the rules that are looked up by it: under one of their sets of keywords, digits last."""
    out: dict[bytes, list[int]] = {}
    for i, r in enumerate(rules()):
        for w in min(r.needs, key=lambda n: (any(w.isdigit() for w in n), len(n), sorted(n))):
            out.setdefault(w, []).append(i)
    return out


def settle(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The detections (start, end, rule) that lie within none that comes before them, by start."""
    order = rules()
    kept: list[tuple[int, int, int]] = []
    for level in sorted({order[r].priority for _, _, r in found}, reverse=True):
        kept.sort()
        starts, ends = [s for s, _, _ in kept], list(accumulate((e for _, e, _ in kept), max))
        reach = -1
        for s, e, r in sorted((f for f in found if order[f[2]].priority == level), key=lambda f: (f[0], -f[1], f[2])):
            at = bisect_right(starts, s)
            if e <= reach or at and ends[at - 1] >= e:
                continue
            reach = e
            kept.append((s, e, r))
    return sorted(kept)


def detections(words: list[bytes]) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Places (first word, end, rule) of the base phrases, and what all rules find after suppression; both by place."""
    index, order = by_keyword(), rules()
    if index.keys().isdisjoint(words):
        return [], []
    own = set(words)
    ready = sorted({i for k in index.keys() & own for i in index[k] if order[i].ready(own)})
    if not ready:
        return [], []
    text, found = b" %b " % b" ".join(words), []
    for i in ready:
        found += [(m.start(), m.end(), i) for m in order[i].pattern.finditer(text)]
    if not found:
        return [], []
    places = list(accumulate(len(w) + 1 for w in words))  # the space after word k is at places[k]
    spans = [(bisect_right(places, s - 1) + 1 if s else 0, bisect_right(places, e), i) for s, e, i in found]
    return sorted(s for s in spans if order[s[2]].base), settle(spans)


FOUND = T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("confidence", T.DoubleType())]))
ADDED = [T.StructField("n_words", T.LongType()), T.StructField("base", FOUND), T.StructField("licenses", FOUND), T.StructField("score", T.DoubleType())]


def words_of(text: str | None) -> list[bytes]:
    return WORD.findall(text.encode().translate(ASCII_LOWER)) if text else []


def scan_licenses(docs: DataFrame) -> DataFrame:
    """docs' columns, then n_words, `base` and `licenses` (label, start, end, confidence; in words from 0, end exclusive)
    and score: one minus the product of what the best detection of each label leaves in doubt.

    `base` has every place of a base phrase; `licenses` what the rules find after suppression. A null or wordless text has
    nothing and score 0. Each row is worked on by itself, without a shuffle; rows stay one for one, repeated ones included.
    Columns of docs that have the name of an added one come back with _in after it.
    """
    given, docs = docs, set_aside(docs, ("text",))
    at = docs.columns.index("text")
    wide = T.StructType([*docs.schema.fields, *ADDED])
    kind = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("confidence", pa.float64())]))

    def told(spans) -> list[dict]:
        return [{"label": rules()[i].label, "start": s, "end": e, "confidence": rules()[i].confidence} for s, e, i in spans]

    def run(batches):
        for b in slices(batches):
            counts, base, kept, scores = [], [], [], []
            for text in b.column(at).to_pylist():
                words = words_of(text)
                own, found = detections(words)
                best: dict[str, float] = {}
                for _, _, i in found:
                    best[rules()[i].label] = max(best.get(rules()[i].label, 0.0), rules()[i].confidence)
                doubt = 1.0
                for label in sorted(best):
                    doubt *= 1 - best[label]
                counts.append(len(words))
                base.append(told(own))
                kept.append(told(found))
                scores.append(round(1 - doubt, 9))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(counts, pa.int64()), pa.array(base, kind), pa.array(kept, kind), pa.array(scores, pa.float64())], names=wide.names)

    return named_back(docs.mapInArrow(run, wide), given)
