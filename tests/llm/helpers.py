"""Small frames with every awkward row, and brute-force counterparts."""

from __future__ import annotations

import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return WORD.findall(lower(text))


def docs(spark, texts, schema=DOCS):
    """Documents from texts or (id, text) pairs."""
    rows = [(t if isinstance(t, tuple) else (i, t)) for i, t in enumerate(texts)]
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}", len(t) if t is not None else None) for i, t in rows], schema)


def rows(df, *cols):
    """Rows as sorted tuples (nulls sort first)."""
    got = [tuple(r[c] for c in cols) if cols else tuple(r) for r in df.collect()]
    return sorted(got, key=lambda r: [(x is not None, x if x is not None else 0) if not isinstance(x, (list, bytes)) else (True, str(x)) for x in r])


def root_of(parent, i):
    while parent[i] != i:
        i = parent[i]
    return i


def union_all(n, pairs):
    parent = list(range(n))
    for a, b in pairs:
        a, b = root_of(parent, a), root_of(parent, b)
        parent[max(a, b)] = min(a, b)
    return [root_of(parent, i) for i in range(n)]
