import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import DOCS, lower
from vendora.llm import merkle


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(doc, text, lang, source, chars):
    return sha("".join(field(v) for v in (doc, source, lang, chars, text)))


def tree(digests, fan):
    """Levels of nodes, leaves first, one node last."""
    levels = [digests]
    while len(levels[-1]) > 1:
        low = levels[-1]
        levels.append([sha("".join(low[i:i + fan])) for i in range(0, len(low), fan)])
    return levels


def sides(levels, i, fan):
    out = []
    for low in levels[:-1]:
        run = low[i // fan * fan:i // fan * fan + fan]
        out.append(("".join(run[:i % fan]), "".join(run[i % fan + 1:])))
        i //= fan
    return out


def brute(rows, fan=16):
    first = lambda v: (v is not None, (v.encode() if isinstance(v, str) else v) if v is not None else 0)
    sources = sorted({r[3] for r in rows}, key=first)
    trees, members = {}, {}
    for s in sources:
        members[s] = sorted((first(r[0]), leaf(*r), r) for r in rows if r[3] == s)
        trees[s] = tree([m[1] for m in members[s]], fan)
    top = tree([trees[s][-1][0] for s in sources], fan)
    root = top[-1][0] if rows else None
    out = []
    for k, s in enumerate(sources):
        for i, (_, digest, r) in enumerate(members[s]):
            path = sides(trees[s], i, fan) + sides(top, k, fan)
            h = digest
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                h = leaf(r[0], None if r[1] is None else lower(r[1]), *r[2:])
            for a, b in path:
                h = sha(a + h + b)
            out.append((r[0], digest, trees[s][-1][0], root, sha("".join(a + b for a, b in path)), h, h == root))
    return sorted(out, key=str)


def corpus():
    rows = [(i, f"Text {i} Größe\n", "en", "big", 7) for i in range(300)]  # three levels of its own
    rows += [(i, "x" if i % 2 else "X", "de", "run", 1) for i in range(16)]
    rows += [(1000 + i, "A" * 3, "fr", "more", None) for i in range(17)]
    rows += [(2000, "Lone", None, "lone", 4), (2001, "NUL", "en", None, 3), (None, "No Id", "en", None, 5), (None, None, None, None, None)]
    rows += [(5, "Same Row", "en", "copies", 8)] * 40 + [(5, "", "en", "copies", 0), (None, "a", "en", "copies", 1)]
    rows += [(3000 + i, "Z" * 20_000, "en", f"s{i}", 1) for i in range(14)] + [(-4, "negative", "", "", -1)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, DOCS)


def test_matches_brute_force(spark):
    rows = corpus()
    docs = frame(spark, rows).selectExpr("*", "1 as leaf", "2 as rank", "'z' as digest", "3 as place", "4 as path")
    got = sorted((tuple(r) for r in merkle.tamper_check(docs).collect()), key=str)
    assert got == brute(rows)
    assert {r[6] for r in got} == {True, False}


@pytest.mark.parametrize("rows", [[], [(1, "One", "en", "s", 3)], [(None, None, None, None, None)],
                                  [(i, "T", "en", None, 1) for i in range(17)]])
def test_small_tables(spark, rows):
    assert sorted((tuple(r) for r in merkle.tamper_check(frame(spark, rows)).collect()), key=str) == brute(rows)


def test_records_are_content_addressed_and_some_leaves_can_be_asked_for(spark):
    rows = corpus()
    m = merkle.build(frame(spark, rows), fan=4)
    nodes = {r["digest"]: r["children"] for r in m.nodes.collect()}
    assert all(len(c) <= 4 and sha("".join(c)) == d for d, c in nodes.items())
    asked = m.leaves.where("pmod(rank, 7) = 3 or doc_id = 2000").select("place", "rank", "leaf")
    proofs = merkle.prove(m, asked, fan=4).withColumn("folded", merkle.folded(F.col("digest"), F.col("path"))).collect()
    assert len(proofs) == asked.count() > 40
    root = m.root.first()["root"]
    assert all(r["digest"] == r["leaf"] and r["folded"] == root for r in proofs)
    assert {r["source"]: r["leaves"] for r in m.tops.collect()}["big"] == 300
