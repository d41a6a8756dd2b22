"""License scan: ordered signature rules with a keyword prefilter.

Signatures are regular expressions written by hand per license (its name, its
address) and per kind of notice (SPDX tag, "licensed under ...", "... license",
address, well-known sentences); the rule table is their product. Families add
abbreviations and names without a version ("GPLv3", "under the GPL"). Each rule has a
priority, a confidence and a gate: literals that must all stand in the text. One
Aho-Corasick pass over the lower-cased text finds the literals, and only rules
with open gates run. A detection contained in one of higher priority, or in a
longer one of the same priority, is suppressed. What a denied notice speaks of ("not
licensed under the GPL") is no detection; of a list only its first license.

Base phrases are counted apart, on the words of the whole text: a place is a run
of consecutive words equal to the phrase.

Scale: one streaming pass of Arrow batches, no shuffle; work is linear in the
text and memory in the longest text.

Defined results: null and empty texts have no words, no places, empty label
strings and score 0; repeated rows give equal rows; extra columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

# Phrases counted on words, and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Licenses as (label, SPDX id, name, address). Names and addresses
# are regular expressions; a blank in a name stands for white space, hyphens or
# commas. Gates are taken from the longest literal words of an expression.
V = r"(?: version| v)? ?"
CC = r"(?: (?:international |version )?v?[1-4]\.0)?"
LICENSES = [
    ("mit", "MIT", r"mit", r"opensource\.org/licenses?/mit\b"),
    ("mit-0", "MIT-0", r"mit no attribution", None),
    ("apache-1.1", "Apache-1.1", rf"apache(?: software)? license{V}1\.1", r"apache\.org/licenses/license-1\.1"),
    ("apache-2.0", "Apache-2.0", rf"apache(?: software)?(?: license)?{V}2(?:\.0)?", r"apache\.org/licenses/license-2\.0"),
    ("gpl-1.0", r"GPL-1\.0(?:-only|-or-later|\+)?", rf"gnu general public license{V}1(?:\.0)?", None),
    ("gpl-2.0", r"GPL-2\.0(?:-only|-or-later|\+)?", rf"gnu general public license{V}2(?:\.0)?", r"gnu\.org/licenses/(?:old-licenses/)?gpl-2"),
    ("gpl-3.0", r"GPL-3\.0(?:-only|-or-later|\+)?", rf"gnu general public license{V}3(?:\.0)?", r"gnu\.org/licenses/gpl-3"),
    ("lgpl-2.1", r"LGPL-2\.1(?:-only|-or-later|\+)?", rf"gnu lesser general public license{V}2\.1", r"gnu\.org/licenses/(?:old-licenses/)?lgpl-2"),
    ("lgpl-3.0", r"LGPL-3\.0(?:-only|-or-later|\+)?", rf"gnu lesser general public license{V}3(?:\.0)?", r"gnu\.org/licenses/lgpl-3"),
    ("agpl-3.0", r"AGPL-3\.0(?:-only|-or-later|\+)?", rf"gnu affero general public license{V}3(?:\.0)?", r"gnu\.org/licenses/agpl"),
    ("gfdl", r"GFDL-1\.[1-3](?:-only|-or-later)?", r"gnu free documentation license", r"gnu\.org/licenses/fdl"),
    ("bsd-2-clause", "BSD-2-Clause", r"(?:bsd 2 clause|2 clause bsd|simplified bsd)", r"opensource\.org/licenses?/bsd-2-clause"),
    ("bsd-3-clause", "BSD-3-Clause", r"(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd)", r"opensource\.org/licenses?/bsd-3-clause"),
    ("bsd-4-clause", "BSD-4-Clause", r"(?:bsd 4 clause|4 clause bsd|original bsd)", None),
    ("0bsd", "0BSD", r"zero clause bsd", r"opensource\.org/licenses?/0bsd"),
    ("isc", "ISC", r"isc", r"opensource\.org/licenses?/isc"),
    ("mpl-1.1", r"MPL-1\.1", rf"mozilla public license{V}1\.1", r"mozilla\.org/mpl/1\.1"),
    ("mpl-2.0", r"MPL-2\.0", rf"mozilla public license{V}2(?:\.0)?", r"mozilla\.org/(?:en-us/)?mpl/2\.0"),
    ("epl-1.0", r"EPL-1\.0", rf"eclipse public license{V}1(?:\.0)?", r"eclipse\.org/legal/epl-v10"),
    ("epl-2.0", r"EPL-2\.0", rf"eclipse public license{V}2(?:\.0)?", r"eclipse\.org/legal/epl-(?:v20|2\.0)"),
    ("cddl-1.0", r"CDDL-1\.[01]", r"common development and distribution license", r"opensource\.org/licenses?/cddl"),
    ("eupl-1.2", r"EUPL-1\.[12]", r"european union public licen[cs]e", r"eupl\.eu"),
    ("artistic-1.0", r"Artistic-1\.0", rf"artistic license{V}1(?:\.0)?", None),
    ("artistic-2.0", r"Artistic-2\.0", rf"artistic license{V}2(?:\.0)?", r"opensource\.org/licenses?/artistic-license-2"),
    ("zlib", "Zlib", r"zlib", r"opensource\.org/licenses?/zlib"),
    ("libpng", "libpng-2\\.0", r"libpng", None),
    ("bsl-1.0", r"BSL-1\.0", r"boost software license", r"boost\.org/license_1_0"),
    ("unlicense", "Unlicense", r"the unlicense", r"unlicense\.org"),
    ("wtfpl", "WTFPL", r"do what the fuck you want to public license", r"wtfpl\.net"),
    ("cc0-1.0", r"CC0-1\.0", r"(?:creative commons zero|cc0)", r"creativecommons\.org/publicdomain/zero"),
    ("cc-by-4.0", r"CC-BY-[1-4]\.0", rf"(?:creative commons attribution|cc by)(?! (?:sa|nc|nd)\b| share| non){CC}", r"creativecommons\.org/licenses/by/"),
    ("cc-by-sa", r"CC-BY-SA-[1-4]\.0", rf"(?:creative commons attribution share ?alike|cc by sa){CC}", r"creativecommons\.org/licenses/by-sa/"),
    ("cc-by-nc", r"CC-BY-NC-[1-4]\.0", rf"(?:creative commons attribution non ?commercial|cc by nc)(?! (?:sa|nd)\b| share| no ?deriv){CC}", r"creativecommons\.org/licenses/by-nc/"),
    ("cc-by-nd", r"CC-BY-ND-[1-4]\.0", rf"(?:creative commons attribution no ?deriv[a-z]*|cc by nd){CC}", r"creativecommons\.org/licenses/by-nd/"),
    ("cc-by-nc-sa", r"CC-BY-NC-SA-[1-4]\.0", rf"(?:creative commons attribution non ?commercial share ?alike|cc by nc sa){CC}", r"creativecommons\.org/licenses/by-nc-sa/"),
    ("cc-by-nc-nd", r"CC-BY-NC-ND-[1-4]\.0", rf"(?:creative commons attribution non ?commercial no ?deriv[a-z]*|cc by nc nd){CC}", r"creativecommons\.org/licenses/by-nc-nd/"),
    ("odbl-1.0", r"ODbL-1\.0", r"open (?:data commons open )?database license", r"opendatacommons\.org/licenses/odbl"),
    ("odc-by", r"ODC-By-1\.0", r"open data commons attribution", r"opendatacommons\.org/licenses/by"),
    ("pddl", r"PDDL-1\.0", r"public domain dedication and license", r"opendatacommons\.org/licenses/pddl"),
    ("ofl-1.1", r"OFL-1\.1", r"(?:sil )?open font license", r"scripts\.sil\.org/ofl"),
    ("postgresql", "PostgreSQL", r"postgresql", r"postgresql\.org/about/licen[cs]e"),
    ("psf-2.0", r"(?:PSF|Python)-2\.0", r"python software foundation", r"docs\.python\.org/[a-z0-9./]*license"),
    ("php-3.01", r"PHP-3\.0?1?", r"php", r"php\.net/license"),
    ("ruby", "Ruby", r"ruby", r"ruby-lang\.org/[a-z/]*license"),
    ("openssl", "OpenSSL", r"openssl", r"openssl\.org/source/license"),
    ("vim", "Vim", r"vim", None),
    ("w3c", "W3C", r"w3c software", r"w3\.org/consortium/legal"),
    ("x11", "X11", r"x11", None),
    ("ncsa", "NCSA", r"(?:university of illinois ncsa|ncsa) open source", r"opensource\.org/licenses?/ncsa"),
    ("ms-pl", "MS-PL", r"microsoft public", r"opensource\.org/licenses?/ms-pl"),
    ("ms-rl", "MS-RL", r"microsoft reciprocal", r"opensource\.org/licenses?/ms-rl"),
    ("osl-3.0", r"OSL-[1-3]\.[01]", r"open software license", r"opensource\.org/licenses?/osl"),
    ("afl-3.0", r"AFL-[1-3]\.[0-2]", r"academic free license", r"opensource\.org/licenses?/afl"),
    ("apsl-2.0", r"APSL-[12]\.[0-2]", r"apple public source", r"opensource\.apple\.com/apsl"),
    ("cecill", r"CECILL-[12]\.[01]", r"cecill", r"cecill\.info"),
    ("ipl-1.0", r"IPL-1\.0", r"ibm public license", None),
    ("lppl", r"LPPL-1\.[0-3][ac]?", r"latex project public license", r"latex-project\.org/lppl"),
    ("nasa-1.3", r"NASA-1\.3", r"nasa open source agreement", None),
    ("qpl-1.0", r"QPL-1\.0", r"q public license", None),
    ("sleepycat", "Sleepycat", r"sleepycat", None),
    ("upl-1.0", r"UPL-1\.0", r"universal permissive license", r"oss\.oracle\.com/licenses/upl"),
    ("zpl-2.1", r"ZPL-[12]\.[01]", r"zope public license", None),
    ("sspl-1.0", r"SSPL-1\.0", r"server side public license", r"mongodb\.com/licensing/server-side"),
    ("busl-1.1", r"BUSL-1\.1", r"business source license", r"mariadb\.com/bsl11"),
    ("elastic-2.0", r"Elastic-2\.0", r"elastic license", r"elastic\.co/licensing"),
    ("polyform", r"PolyForm-[A-Za-z]+-1\.0\.0", r"polyform [a-z]+", r"polyformproject\.org/licenses"),
    ("openrail", r"OpenRAIL(?:-M)?", r"open ?rail(?: m)?", None),
    ("hippocratic", r"Hippocratic-2\.1", r"hippocratic", r"firstdonoharm\.dev"),
    ("json", "JSON", r"json", r"json\.org/license"),
    ("beerware", "Beerware", r"beer ?ware", None),
    ("curl", "curl", r"curl", None),
    ("icu", "ICU", r"icu", None),
    ("unicode", r"Unicode-(?:3\.0|DFS-201[56])", r"unicode", r"unicode\.org/copyright"),
    ("tcl", "TCL", r"tcl tk", None),
    ("ecl-2.0", r"ECL-[12]\.0", r"educational community license", r"opensource\.org/licenses?/ecl"),
]

# Families as (label without a version, [(name, its gate)], [(label,
# version)]): abbreviations, and names that need no version.
ONE, TWO, THREE = r"1(?:\.0)?", r"2(?:\.0)?", r"3(?:\.0)?"
FAMILIES = [
    ("gpl", [(r"(?:gnu )?gpl", "gpl"), (r"gnu general public license", "public")], [("gpl-1.0", ONE), ("gpl-2.0", TWO), ("gpl-3.0", THREE)]),
    ("lgpl", [(r"(?:gnu )?lgpl", "lgpl"), (r"gnu (?:lesser|library) gpl", "gpl"), (r"gnu (?:lesser|library) general public license", "public")],
     [("lgpl-2.0", TWO), ("lgpl-2.1", r"2\.1"), ("lgpl-3.0", THREE)]),
    ("agpl", [(r"(?:gnu )?agpl", "agpl"), (r"(?:gnu )?affero gpl", "gpl"), (r"(?:gnu )?affero general public license", "affero")], [("agpl-3.0", THREE)]),
    ("mpl", [(r"mpl", "mpl"), (r"mozilla public license", "mozilla")], [("mpl-1.0", ONE), ("mpl-1.1", r"1\.1"), ("mpl-2.0", TWO)]),
    ("epl", [(r"epl", "epl"), (r"eclipse public license", "eclipse")], [("epl-1.0", ONE), ("epl-2.0", TWO)]),
    ("eupl", [(r"eupl", "eupl")], [("eupl-1.1", r"1\.1"), ("eupl-1.2", r"1\.2")]),
    ("apache", [(r"apache(?: software)? license", "apache")], [("apache-1.1", r"1\.1"), ("apache-2.0", TWO)]),
    ("artistic", [(r"artistic license", "artistic")], [("artistic-1.0", ONE), ("artistic-2.0", TWO)]),
    ("bsd", [(r"bsd(?: style)?", "bsd")], []),
    ("cddl-1.0", [(r"cddl", "cddl")], [("cddl-1.0", r"1\.[01]")]),
    ("gfdl", [(r"(?:gnu )?g?fdl", "fdl")], [("gfdl", r"1\.[1-3]")]),
    ("ofl-1.1", [(r"(?:sil )?ofl", "ofl")], [("ofl-1.1", r"1\.1")]),
    ("odbl-1.0", [(r"odbl", "odbl")], [("odbl-1.0", ONE)]),
    ("sspl-1.0", [(r"sspl", "sspl")], [("sspl-1.0", ONE)]),
    ("busl-1.1", [(r"busl", "busl")], [("busl-1.1", r"1\.1")]),
    ("bsl-1.0", [(r"boost license", "boost")], [("bsl-1.0", ONE)]),
]

# Sentences that identify a license or a claim by themselves.
SENTENCES = [
    ("mit", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("bsd", r"redistribution and use in source and binary forms"),
    ("isc", r"permission to use copy modify and or distribute this software for any purpose"),
    ("gpl", r"under the terms of the gnu general public license"),
    ("lgpl", r"under the terms of the gnu lesser general public license"),
    ("agpl", r"under the terms of the gnu affero general public license"),
    ("gpl-2.0", r"gnu general public license as published by the free software foundation either version 2"),
    ("gpl-3.0", r"gnu general public license as published by the free software foundation either version 3"),
    ("lgpl-2.1", r"gnu lesser general public license as published by the free software foundation either version 2\.1"),
    ("lgpl-3.0", r"gnu lesser general public license as published by the free software foundation either version 3"),
    ("agpl-3.0", r"gnu affero general public license as published by the free software foundation either version 3"),
    ("apache-2.0", r"you may not use this file except in compliance with the license\. you may obtain a copy of the license at https?: www\.apache\.org licenses license 2\.0"),
    ("mpl-2.0", r"this source code form is subject to the terms of the mozilla public license v\. 2\.0"),
    ("epl-2.0", r"this program and the accompanying materials are made available under the terms of the eclipse public license v?\.? ?2\.0"),
    ("wtfpl", r"you just do what the fuck you want to"),
    ("unlicense", r"this is free and unencumbered software released into the public domain"),
    ("public-domain", r"(?:dedicated|released) (?:in)?to the public domain"),
    ("proprietary", r"all rights reserved"),
    ("proprietary", r"proprietary and confidential"),
    ("zlib", r"altered source versions must be plainly marked as such"),
    ("bsl-1.0", r"boost software license version 1\.0"),
]


# Every gate has a literal with one of these in it, so a text
# without any of them is done after a few substring searches.
ROOTS = (b"licen", b"spdx", b"under", b"public", b"rights", b"confidential", b"permission", b"redistribution", b"altered",
         b"gpl", b"cc by", b"cc-by", b"want", b".org", b".com", b".net", b".info", b".eu", b".dev", b".co")


class Rule(NamedTuple):
    label: str
    kind: str
    priority: int
    confidence: float
    gate: frozenset[str]
    pattern: re.Pattern


def _spaced(expr: str) -> str:
    """Blanks of an expression stand for white space, hyphens, slashes or commas."""
    return re.sub(r" (\??)", lambda m: r"[\s,/-]*" if m[1] else r"[\s,/-]+", expr)


def _literals(expr: str) -> frozenset[str]:
    """Longer literal words outside groups and options of an expression: they
    must all stand in any text that it matches. Short ones stand everywhere and
    would only slow the prefilter down."""
    flat, depth = [], 0
    for piece in re.findall(r"\\.|.", expr):
        depth += piece == "("
        flat.append(" " if depth or len(piece) > 1 or piece in "?*+|[]" else piece)
        depth -= piece == ")"
    words = re.findall(r"[a-z0-9]+", re.sub(r"\[[^]]*\]", " ", "".join(flat)).lower())
    return frozenset(w for w in words if len(w) >= 5) or frozenset(w for w in words if len(w) == 4)


# A notice's opening; what follows is matched in place by each open notice rule.
LEAD = re.compile(r"(?:licen[sc]ed|released|distributed|available|published|provided)[\s,-]+under[\s,-]+(?:the[\s,-]+|an?[\s,-]+)?"
                  r"(?:terms[\s,-]+of[\s,-]+)?(?:the[\s,-]+)?")
END = r"(?![a-z0-9])"
UNDER = r"under[\s,-]+(?:the[\s,-]+|an?[\s,-]+)?(?:terms[\s,-]+of[\s,-]+)?(?:the[\s,-]+)?"
# A metadata field's opening; the value is matched in place like a notice's.
FIELD = re.compile(r"licen[sc]es?[\"']?[ \t]*[:=][ \t]*[\[(]?[ \t]*[\"']?(?:the[ \t]+)?")
# A denial right before a notice.
DENIED = re.compile(r"(?:\b(?:not|never|no longer|neither|cannot)|n['\u2019]t)(?:[\s,-]+(?:been|being|be|yet|currently|generally))*[\s,-]+$")
# Short names of the Creative Commons licenses, and whether they need
# a version to say anything.
SHORT = [("cc-by-4.0", "cc by", True), ("cc-by-sa", "cc by sa", False), ("cc-by-nc", "cc by nc", False), ("cc-by-nd", "cc by nd", False),
         ("cc-by-nc-sa", "cc by nc sa", False), ("cc-by-nc-nd", "cc by nc nd", False)]
VERSION = r"(?:[\s,-]*v(?:ersion|\.)?\s*|[\s-]*)"
ALNUM = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")  # what may not stand before a match


@lru_cache(maxsize=1)
def rules() -> list[Rule]:
    """All rules, highest priority first; patterns are for lower-cased text."""
    out = []
    for label, spdx, name, address in LICENSES:
        out.append(Rule(label, "tag", 100, 1.0, frozenset({"spdx-license"}), re.compile(
            rf"spdx-license-identifier:[ \t]*(?:\(?[a-z0-9.+-]+ (?:and|or|with) )*\(?(?P<id>{spdx.lower()})(?![a-z0-9.+-]*[a-z0-9])")))
        if address:
            domain = re.match(r"(?:[a-z0-9-]|\\\.)+", address)[0].replace("\\", "")
            out.append(Rule(label, "address", 90, 0.95, frozenset({domain}), re.compile(address)))
        out.append(Rule(label, "notice", 80, 0.9, _literals(name) | {"under"},
                        re.compile(_spaced(name) + END + r"(?:[\s,]+(?:public[\s]+)?licen[sc]e\b)?")))
        out.append(Rule(label, "name", 60, 0.7, _literals(name) | {"licen"},
                        re.compile(_spaced(name) + (END if "licen" in name else r"[\s,-]+licen[sc]e" + END))))
        value = rf"(?:(?:{spdx.lower()})(?![a-z0-9.+-]*[a-z0-9])|{_spaced(name)}{END})(?:[\s,-]+licen[sc]e\b)?"
        out.append(Rule(label, "field", 65, 0.8, frozenset({"licen"}), re.compile(value)))
    for label, name, versioned in SHORT:
        for way in sorted({name, name.replace(" ", "-"), name.replace(" ", "-").replace("-", " ", 1)}):
            version = r"(?:[\s-]+v?[1-4]\.0)" + ("" if versioned else "?")
            out.append(Rule(label, "short", 55, 0.7, frozenset({way}), re.compile(way + r"(?![\s-]+(?:sa|nc|nd)\b)" + version + END)))
    for family, names, versions in FAMILIES:
        for label, version in [(family, None), *versions]:
            for name, gate in names:
                full = _spaced(name) + (rf"{VERSION}{version}(?!\.\d)" if version else "") + END
                more = r"(?:[\s,-]+licen[sc]e\b)?"
                out.append(Rule(label, "notice", 80, 0.9, frozenset({gate, "under"}), re.compile(full + more)))
                out.append(Rule(label, "under", 75, 0.8, frozenset({gate, "under"}), re.compile(UNDER + full + more)))
                out.append(Rule(label, "field", 65, 0.8, frozenset({gate, "licen"}), re.compile(full)))
                alone = "licen" in name or version  # a bare abbreviation says nothing
                out.append(Rule(label, "name", 60, 0.7, frozenset({gate} if version and "gpl" in gate else {gate, "licen"}),
                                re.compile(full if alone else _spaced(name) + r"[\s,-]+licen[sc]ed?" + END)))
    for label, text in SENTENCES:
        out.append(Rule(label, "sentence", 70, 0.8, _literals(text), re.compile(_spaced(text))))
    return sorted(out, key=lambda r: -r.priority)


@lru_cache(maxsize=1)
def _prefilter() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for word in sorted({w for r in rules() for w in r.gate}):
        found.add_word(word, word)
    found.make_automaton()
    return found


# Word bytes once A-Z are lower-cased: digits, letters, everything beyond ASCII.
_WORD = np.zeros(256, bool)
_WORD[list(range(0x30, 0x3A)) + list(range(0x61, 0x7B)) + list(range(0x80, 0x100))] = True
_CLASS = rb"[0-9a-z\x80-\xff]"
_PHRASES = [(label, p.split()[-1].encode(), re.compile(rb"(?<!%b)" % _CLASS + rb"[^0-9a-z\x80-\xff]+".join(p.encode().split()) + rb"(?!%b)" % _CLASS))
            for p, label in BASE.items()]


def base_places(text: str | None) -> tuple[int, list[tuple[int, str]]]:
    """(number of words, [(first word of a place, label)]) of one text."""
    low = (text or "").encode("utf-8", "replace").lower()
    if not low:
        return 0, []
    word = _WORD[np.frombuffer(low, np.uint8)]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    places = [(m.start(), label) for label, last, pattern in _PHRASES if last in low for m in pattern.finditer(low)]
    n = int(np.count_nonzero(begins))
    if not places:
        return n, []
    upto = np.flatnonzero(begins)
    return n, sorted((int(np.searchsorted(upto, at)), label) for at, label in places)


def detections(text: str | None) -> list[tuple[int, int, Rule]]:
    """Detections of one text that stay, as (start, end, rule) in code points."""
    if not text:
        return []
    raw = text.encode("utf-8", "replace").lower()  # A-Z only, so offsets stay
    if not any(root in raw for root in ROOTS):
        return []
    low = raw.decode()
    there = {word for _, word in _prefilter().iter(low)}
    if not there:
        return []
    stays: list[tuple[int, int, Rule]] = []
    level: list[tuple[int, int, Rule]] = []
    starts: list[int] = []
    ends: list[int] = []

    def settle() -> None:
        """Suppress what is contained in a detection of higher priority, or in
        one of the same priority that starts no later and ends no earlier."""
        reach = -1
        for s, e, rule in sorted(level, key=lambda d: (d[0], -d[1])):
            k = bisect_right(starts, s)
            if e > reach and not (k and ends[k - 1] >= e):
                stays.append((s, e, rule))
                reach = e
        level.clear()
        spans = sorted((s, e) for s, e, _ in stays)
        starts[:] = [s for s, _ in spans]
        ends[:] = np.maximum.accumulate([e for _, e in spans]).tolist() if spans else []

    leads, denied = [], []
    for m in LEAD.finditer(low) if "under" in there else ():
        (denied if DENIED.search(low[max(0, m.start() - 40):m.start()]) else leads).append(m.span())
    fields = [m.span() for m in FIELD.finditer(low) if m.start() == 0 or low[m.start() - 1] not in ALNUM] if "licen" in there else []
    from_denied = [s for s, _ in denied]

    def is_denied(start: int) -> bool:
        k = bisect_right(from_denied, start)
        return k > 0 and start <= denied[k - 1][1]

    priority = None
    for rule in rules():
        if rule.priority != priority:
            settle()
            priority = rule.priority
        if not rule.gate <= there:
            continue
        if rule.kind in ("notice", "field"):
            level += [(s, m.end(), rule) for s, e in (leads if rule.kind == "notice" else fields) if (m := rule.pattern.match(low, e))]
            continue
        part = "id" if rule.kind == "tag" else 0  # of a tag with several licenses, each its own
        level += [(*m.span(part), rule) for m in rule.pattern.finditer(low)
                  if (m.start() == 0 or low[m.start() - 1] not in ALNUM) and not is_denied(m.start())]
    settle()
    return sorted(stays, key=lambda d: (d[0], d[1]))


_SCAN = StructType([StructField("n_words", LongType()), StructField("n_base", LongType()), StructField("first_word", LongType()),
                    StructField("last_word", LongType()), StructField("base_labels", StringType()), StructField("labels", StringType()),
                    StructField("score", DoubleType())])


def _summary(text: str | None) -> tuple:
    n, places = base_places(text)
    found = detections(text)
    base = sorted({label for _, label in places})
    labels = sorted({*base, *(r.label for *_, r in found)})
    doubt = 0.5 if places else 1.0
    for label in {r.label for *_, r in found}:
        doubt *= 1 - max(r.confidence for *_, r in found if r.label == label)
    return (n, len(places), places[0][0] if places else None, places[-1][0] if places else None,
            ",".join(base), ",".join(labels), round(1 - doubt, 6))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]
    for batch in batches:
        cols = list(zip(*(_summary(t.as_py()) for t in batch["text"]), strict=True)) or [()] * len(types)
        yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(c, t) for c, t in zip(cols, types, strict=True))],
                                         ["doc_id", *_SCAN.names])


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, word count, base places, labels, score."""
    return docs.select("doc_id", "text").mapInArrow(_scan, StructType([docs.schema["doc_id"], *_SCAN.fields]))


def spans(docs: DataFrame) -> DataFrame:
    """(doc_id, found): the detections that stay, as an array of (start, end,
    label, kind, confidence)."""
    item = StructType([StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("label", StringType()),
                       StructField("kind", StringType()), StructField("confidence", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("label", pa.string()),
                                   ("kind", pa.string()), ("confidence", pa.float64())]))
        for batch in batches:
            rows = [[{"start": s, "end": e, "label": r.label, "kind": r.kind, "confidence": r.confidence}
                     for s, e, r in detections(t.as_py())] for t in batch["text"]]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(rows, kind)], ["doc_id", "found"])
    return docs.select("doc_id", "text").mapInArrow(run, StructType([docs.schema["doc_id"], StructField("found", ArrayType(item))]))
