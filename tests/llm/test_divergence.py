import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.helpers import DOCS, lower
from vendora.llm import divergence as dv

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def f(p, q):
    return (p - q) ** 2 // (p + q)


def brute(rows, least=10, top=10):
    docs = [(r[2] or "", r[3] or "", Counter(TERM.findall(lower(r[1])))) for r in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        held = Counter(t for d in mine for t in d[2])
        kept = [t for t in held if held[t] >= least]
        groups = {s: Counter() for s in {d[1] for d in mine}}
        for _, s, c in mine:
            groups[s].update({t: n for t, n in c.items() if t in set(kept)})
        whole = sum(groups.values(), Counter())

        def rates(c):
            total = sum(c.values()) + 2 * len(kept)
            return {t: 1 + 10**9 * (c[t] + 2) // total for t in kept}  # noqa: B023
        p, q = {s: rates(c) for s, c in groups.items()}, rates(whole)
        for s in groups:
            parts = {"pair": {o: sum(f(p[s][t], p[o][t]) for t in kept) for o in groups if o != s},
                     "term": {t: f(p[s][t], q[t]) for t in kept if groups[s][t] > 0 and p[s][t] > q[t]}}
            for part, values in parts.items():
                order = sorted(values, key=lambda i: (-values[i], i.encode()))
                out += [(lang, s, part, i, values[i], k) for k, i in enumerate(order, 1) if part == "pair" or k <= top]
    return sorted(out)


def corpus(seed=5, n=160):
    rng = random.Random(seed)
    vocab = ["the", "of", "Étude", "naïve", "straße", "x", "deep", "中文", *(f"w{c}" for c in "abcdefghijklmnopqrst")]
    rows = []
    for i in range(n):
        lang = rng.choice(["en", "en", "en", "de", None, ""])
        source = rng.choice(["hot", "hot", "b", "c", "ö", None, ""])
        words = [rng.choice(vocab[:rng.randint(2, len(vocab))]) for _ in range(rng.randint(0, 60))]
        rows.append((i % 90, rng.choice([" ", "1", "-", "\n"]).join(w.upper() if rng.random() < .2 else w for w in words), lang, source, 0))
    rows += [(None, None, "en", "no terms", None), (7, "", "fr", "alone", 0), (7, "rare words", "fr", "other", 0)]
    rows += [(8, "copy of the same", "en", "hot", 0)] * 30 + [(9, "the " * 30_000 + "long" * 9_000, "en", "c", 0)]
    return rows


def result(spark, rows, **how):
    frame = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as term", "2 as at", "'z' as value", "3 as n")
    return sorted(tuple(r) for r in dv.audit(frame, **how).collect())


def test_matches_brute_force(spark):
    rows = corpus()
    got = result(spark, rows)
    assert got == brute(rows) and len(got) > 100
    assert ("en", "no terms") in {r[:2] for r in got} and any(r[4] == 0 and r[2] == "pair" for r in got if r[0] == "fr")


def test_small_buffers_and_bounds_agree(spark, monkeypatch):
    rows = corpus(6, 60)
    want = brute(rows, 2, 3)
    assert result(spark, rows, min_docs=2, top=3) == want


@pytest.mark.parametrize("rows", [[], [(1, "a b", "en", "s", 1)], [(None, None, None, None, None)] * 12])
def test_tables_without_pairs(spark, rows):
    assert result(spark, rows) == brute(rows)


def test_overlap_is_the_sum_over_common_terms(monkeypatch):
    """The kernel in chunks of postings and batches, against all pairs."""
    monkeypatch.setattr(dv, "ROOM", 5)
    rng = np.random.default_rng(1)
    has = rng.random((12, 40)) < .5
    p, base = rng.integers(1, 10**9, (12, 40)), rng.integers(1, 10**6, 12)
    rows = [(0, "en", a, f"t{t}", p[a, t], base[a]) for a in range(12) for t in range(40) if has[a, t]]
    rows += [(1, "en", a, "u", 5, 9) for a in (2, 5)] + [(1, "fr", a, "u", 50, 9) for a in (0, 1)]
    names = ["block", "lang", "at", "term", "p", "base"]
    batches = [pa.RecordBatch.from_pydict(dict(zip(names, zip(*rows[i:i + 37], strict=True), strict=True))) for i in range(0, len(rows), 37)]
    got = Counter()
    for b in dv._overlap(iter(batches)):
        for r in b.to_pylist():
            got[r["lang"], r["a"], r["b"]] += r["v"]
    want = Counter()
    for lang, at in (("en", range(12)), ("fr", (0, 1))):
        mine = {(r[2], r[3], r[0]): (int(r[4]), int(r[5])) for r in rows if r[1] == lang}
        for (a, t, k), (x, bx) in mine.items():
            for b in at:
                if b > a and (b, t, k) in mine:
                    y, by = mine[b, t, k]
                    want[lang, a, b] += f(x, y) - f(x, by) - f(bx, y) + f(bx, by)
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}


def test_counters_pass_on_what_they_hold(monkeypatch):
    monkeypatch.setattr(dv, "HELD", 3)
    batch = pa.RecordBatch.from_pydict({"lang": ["en"] * 4, "source": ["s"] * 4, "text": ["a b c d", "a B e", None, "a a"]})
    rows = [r for b in dv._count(iter([batch])) for r in b.to_pylist()]
    n, docs = Counter(), Counter()
    for r in rows:
        if r["term"]:
            n[r["term"]] += r["n"]
            docs[r["term"]] += r["docs"]
    assert (n["a"], docs["a"], n["b"], docs["b"]) == (4, 3, 2, 2)
