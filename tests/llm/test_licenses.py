import re

import pytest

from tests.conftest import SMOKE
from tests.llm.helpers import docs, lower, rows, words
from vendora.llm import licenses as lic


def brute(text):
    w = words(text)
    return len(w), sorted((i, label) for p, label in lic.BASE.items() for i in range(len(w)) if w[i:i + len(p.split())] == p.split())


TEXTS = [None, "", "MIT License", "the mit-license, MIT\nLicense mit license", "cc by cc by", "acc by ccc by", "CC-BY 4.0 é cc by",
         "GNU general public license general public license", "Ä apache license", "mit licenses", "x" * 500_000 + " mit license",
         "mit " * 50_000 + "license", "Licensed under the Apache License, Version 2.0 or the MIT License."]


def test_base_places_match_words_one_by_one(spark):
    texts = TEXTS + [r.text for r in spark.read.parquet(f"{SMOKE}/documents.parquet").select("text").collect()]
    for t in texts:
        assert lic.base_places(t) == brute(t)


def test_hundreds_of_rules_all_gated():
    rules = lic.rules()
    assert len(rules) >= 200
    assert all(r.gate and any(root.decode() in g for g in r.gate for root in lic.ROOTS) for r in rules)
    assert [r.priority for r in rules] == sorted((r.priority for r in rules), reverse=True)


@pytest.mark.parametrize(("text", "labels"), [
    ("SPDX-License-Identifier: (MIT OR Apache-2.0)", ["mit", "apache-2.0"]),
    ("# spdx-license-identifier: GPL-2.0-or-later", ["gpl-2.0"]),
    ("This work is licensed under the GNU General Public License, version 3.", ["gpl-3.0"]),
    ("Released under the MIT License.", ["mit"]), ("Licensed under CC BY-NC 4.0.", ["cc-by-nc"]),
    ("see https://creativecommons.org/licenses/by-sa/4.0/", ["cc-by-sa"]), ("Mozilla Public License 2.0", ["mpl-2.0"]),
    ("All rights reserved.", ["proprietary"]), ("BSD 3-Clause License", ["bsd-3-clause"]), ("a mitigated licensing", []),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy", ["mit"])])
def test_signatures(text, labels):
    assert [r.label for *_, r in lic.detections(text)] == labels


def test_gates_hide_no_match():
    """A rule's own pattern never matches a text that lacks its gate."""
    texts = [t for t in TEXTS if t and len(t) < 1000] + ["open data commons attribution license under cc0 license", "the unlicense license", "w3c software license"]
    for t in texts:
        low = t.lower()
        for r in lic.rules():
            if r.kind not in ("notice", "field") and r.pattern.search(low):
                assert all(g in low for g in r.gate), (t, r)


def test_containment_suppression():
    text = "Licensed under the Apache License, Version 2.0. Apache License 1.1"
    got = lic.detections(text)
    assert [(text[s:e], r.label) for s, e, r in got] == [(text[:46], "apache-2.0"), (text[48:], "apache-1.1")]
    spans = [(s, e) for s, e, _ in got]
    assert not any(a != b and b[0] <= a[0] and a[1] <= b[1] for a in spans for b in spans)


def test_frames(spark):
    d = docs(spark, TEXTS + ["MIT License", (None, "mit license")]).selectExpr("*", "1 as labels", "2 as n_words")
    got = rows(lic.scan(d))
    for doc, n, n_base, first, last, base, labels, score in got:
        text = "mit license" if doc is None else (TEXTS + ["MIT License"])[doc]
        want = brute(text)
        starts = [i for i, _ in want[1]]
        assert (n, n_base, first, last) == (want[0], len(starts), min(starts, default=None), max(starts, default=None))
        assert base == ",".join(sorted({x for _, x in want[1]})) and set(base.split(",")) <= set(labels.split(","))
        assert 0 <= score <= 1 and (score > 0) == bool(labels)
    assert lic.scan(docs(spark, [])).count() == 0
    assert rows(lic.spans(docs(spark, ["x", None, "All rights reserved"])).selectExpr("doc_id", "size(found) as n")) == [(0, 0), (1, 0), (2, 1)]


@pytest.mark.parametrize(("text", "labels"), [
    ("licensed under GPLv3", ["gpl-3.0"]), ("You may use it under the GPL.", ["gpl"]), ("LGPL v2.1", ["lgpl-2.1"]), ("GPL-2.0+", ["gpl-2.0"]),
    ("licensed under the GNU Lesser General Public License", ["lgpl"]), ("distributed under the terms of the AGPL, version 3", ["agpl-3.0"]),
    ("released under the MPL 2.0", ["mpl-2.0"]), ("under the Eclipse Public License", ["epl"]), ("License: EPL-2.0", ["epl-2.0"]),
    ("GNU Lesser GPL v3", ["lgpl-3.0"]), ("a BSD-style license", ["bsd"]), ("Licensed under the Apache License", ["apache"]), ('license = "GPL"', ["gpl"]),
    ("under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License", ["gpl", "gpl-3.0"]),
    ("You may obtain a copy of the License at\n http://www.apache.org/licenses/LICENSE-2.0", ["apache-2.0"]),
    ("the GPL is long", []), ("a simple example 2.0 license", []), ("2-clause BSD license", ["bsd-2-clause"])])
def test_abbreviations_and_versionless_names(text, labels):
    assert [r.label for *_, r in lic.detections(text)] == labels


@pytest.mark.parametrize(("text", "labels"), [
    ("License: MIT", ["mit"]), ('license = "ISC"', ["isc"]), ('"license": "Apache-2.0",', ["apache-2.0"]), ("license: bsd-3-clause", ["bsd-3-clause"]),
    ("License: GPL-2.0-or-later", ["gpl-2.0"]), ("licence: Zlib", ["zlib"]), ("license = ['CC0-1.0']", ["cc0-1.0"]), ("License: PostgreSQL License", ["postgresql"]),
    ("license: mitigated", []), ("sublicense: MIT", []), ("License: BSD", ["bsd"]), ("CC BY-SA 4.0", ["cc-by-sa"]), ("cc-by-nc-nd", ["cc-by-nc-nd"]),
    ("CC BY 4.0", ["cc-by-4.0"]), ("cc by", []), ("acc by-sa", []), ("CC BY NC SA 3.0", ["cc-by-nc-sa"]), ("licensed under CC BY-SA 4.0", ["cc-by-sa"])])
def test_fields_and_short_names(text, labels):
    assert [r.label for *_, r in lic.detections(text)] == labels


@pytest.mark.parametrize(("text", "labels"), [
    ("This is not licensed under the GPL.", []), ("It isn't released under the terms of the GNU General Public License, version 2.", []),
    ("never distributed under the MIT License, but licensed under the Apache License 2.0", ["apache-2.0"]), ("no longer available under a BSD license", []),
    ("has not yet been published under the MPL 2.0", []), ("It is not. Licensed under the GPL", ["gpl"]), ("why not? licensed under the GPL", ["gpl"])])
def test_denied_notices(text, labels):
    assert [r.label for *_, r in lic.detections(text)] == labels


def without_gates(text):
    """Every rule over the whole text, suppression by comparing all with all."""
    low = lower(text)
    leads = [(m.start(), m.end(), bool(lic.DENIED.search(low[max(0, m.start() - 40):m.start()]))) for m in lic.LEAD.finditer(low)]
    fields = [m.span() for m in lic.FIELD.finditer(low) if not (low[:m.start()][-1:] and low[m.start() - 1] in lic.ALNUM)]
    found = []
    for k, rule in enumerate(lic.rules()):
        if rule.kind == "notice":
            hits = [(s, m.end()) for s, e, no in leads if not no and (m := rule.pattern.match(low, e))]
        elif rule.kind == "field":
            hits = [(s, m.end()) for s, e in fields if (m := rule.pattern.match(low, e))]
        else:
            hits = [m.span("id" if rule.kind == "tag" else 0) for m in rule.pattern.finditer(low)
                    if not (m.start() and low[m.start() - 1] in lic.ALNUM) and not any(no and s <= m.start() <= e for s, e, no in leads)]
        found += [(s, e, rule.priority, k, rule.label) for s, e in hits]

    def beats(a, b):
        inside = a[0] <= b[0] and b[1] <= a[1]
        return inside and (a[2] > b[2] or (a[2] == b[2] and (a[:2] != b[:2] or a[3] < b[3])))
    return sorted({(s, e, label) for d in found for s, e, *_, label in [d] if not any(beats(o, d) for o in found)})


def test_gates_and_suppression_against_every_rule_ungated(spark):
    """All given texts, and texts made of every rule's own words, one after the other."""
    given = [r.text for r in spark.read.parquet(f"{SMOKE}/documents.parquet").select("text").collect() if r.text]
    names = [name.split("(?")[0].replace("\\", "") for _, _, name, _ in lic.LICENSES]
    made = [f"{how} {n}{more}" for n in names if n for how in ("licensed under the", "License:", "not licensed under", "see the") for more in ("", " license", " license 2.0")]
    made += [" ".join(made[k::97]) for k in range(97)]
    made += [re.sub(r"\\.", " ", t) for _, t in lic.SENTENCES]
    made += [f"SPDX-License-Identifier: ({spdx.split('(')[0]} OR MIT)".replace("\\", "") for _, spdx, *_ in lic.LICENSES]
    made += [address.split("(?")[0].replace("\\", "") for *_, address in lic.LICENSES if address]
    hits = 0
    for text in [*given, *made]:
        got = sorted((s, e, r.label) for s, e, r in lic.detections(text))
        assert got == without_gates(text), text[:300]
        hits += len(got)
    assert hits > 500
