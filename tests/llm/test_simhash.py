import random

import numpy as np
import pytest
import xxhash

from tests.conftest import SMOKE
from tests.llm.helpers import DOCS, docs, lower, rows, union_all
from vendora.llm import simhash as sh


def brute_print(text):
    import re
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    if not w:
        return 0
    runs = [" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))]
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(texts, radius=2):
    prints = [brute_print(t) for _, t in texts]
    near = [(i, j) for i in range(len(texts)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= radius]
    roots = union_all(len(texts), near)
    out = []
    for (doc, _), p, r in zip(texts, prints, roots):
        ids = [d for (d, _), q in zip(texts, roots) if q == r and d is not None]
        out.append((doc, f"{p:016x}", min(ids) if ids else None))
    return sorted(out, key=lambda r: [(x is not None, x if x is not None else 0) for x in r])


def test_fingerprint_matches_bits_one_by_one():
    for text in [None, "", " \t\n\x0b\x0c\r", "One", "one TWO", "a b c", "a b c d", "É é Ñ straße " * 7, "a b c a b c a b c", "x " * 3000]:
        assert sh.fingerprint(text) == brute_print(text)


@pytest.mark.parametrize("radius", [0, 1, 2])
def test_bit_sliced_blocks_find_all_links(radius):
    rng = np.random.default_rng(radius)
    for n, bits in ((3, 3), (64, 5), (65, 63), (700, 12), (900, 22)):
        v = np.unique(rng.integers(0, 1 << bits, n).astype(np.uint64))
        i, j = sh.block_links(v, radius)
        near = np.bitwise_count(v[:, None] ^ v[None]) <= radius
        assert near[i, j].all()
        want = union_all(len(v), [(a, b) for a, b in zip(*np.nonzero(np.triu(near, 1)))])
        assert union_all(len(v), list(zip(i, j))) == want


@pytest.mark.parametrize("radius", [0, 1, 2])
def test_links_over_keys(spark, radius):
    rng = random.Random(radius)
    base = [rng.getrandbits(64) for _ in range(40)]
    values = {b ^ sum(1 << x for x in set(rng.choices(range(64), k=rng.randint(0, 4)))) for b in base for _ in range(6)}
    values = sorted(v - (1 << 64) if v >> 63 else v for v in values | {0})
    found = rows(sh.links(spark.createDataFrame([(v,) for v in values], "fp long"), radius))
    at = {v: i for i, v in enumerate(values)}
    near = [(i, j) for i in range(len(values)) for j in range(i) if ((values[i] ^ values[j]) & (1 << 64) - 1).bit_count() <= radius]
    assert union_all(len(values), [(at[a], at[b]) for a, b in found]) == union_all(len(values), near)


def edge_texts():
    rng = random.Random(5)
    base = " ".join(rng.choice("ab cd ef gh ij kl mn".split()) + str(rng.randint(0, 40)) for _ in range(400))
    w = base.split()
    copies = [" ".join(w[:k] + ["changed"] + w[k + 1:]) for k in (3, 90, 200, 399)]
    other = [" ".join(str(rng.random()) for _ in range(30)) for _ in range(5)]
    return [(9, base), (4, base), (12, base.upper()), *[(20 + k, c) for k, c in enumerate(copies)], (1, None), (2, ""), (3, "  "),
            (None, base), (5, "one"), (5, "one"), (6, "ONE"), (None, "alone " * 40), *[(40 + k, o) for k, o in enumerate(other)],
            (7, "long " * 60_000)]


def test_near_duplicates_match_brute_force(spark):
    texts = edge_texts()
    d = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts], DOCS).selectExpr("*", "1 as fp", "2 as component")
    got = rows(sh.near_duplicates(d))
    assert got == brute(texts)


def test_testdata_matches_brute_force(spark):
    d = spark.read.parquet(f"{SMOKE}/documents.parquet")
    texts = [(r.doc_id, r.text) for r in d.select("doc_id", "text").collect()]
    assert rows(sh.near_duplicates(d)) == brute(texts)


def test_dedup_keeps_one_of_each_group(spark):
    texts = edge_texts()
    d = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts], DOCS).selectExpr("*", "1 as simhash_fp", "2 as root")
    got = sh.dedup(d)
    assert got.columns == d.columns
    prints = {(i, brute_print(t)) for i, t in texts}
    groups = {}
    for doc, p, comp in brute(texts):
        groups.setdefault(comp if comp is not None else ("none", p), set()).add((doc, p))
    kept = [(r.doc_id, brute_print(r.text)) for r in got.collect()]
    assert len(kept) == len(set(kept)) and set(kept) <= prints
    roots = union_all(len(texts), [(i, j) for i in range(len(texts)) for j in range(i)
                                   if (brute_print(texts[i][1]) ^ brute_print(texts[j][1])).bit_count() <= 2])
    assert len(kept) == len(set(roots))


def test_dedup_with_distinct_ids_and_empty(spark):
    d = docs(spark, ["a b c d", "a b c d", "A B c d", "other words here now"])
    assert [r[0] for r in rows(sh.dedup(d), "doc_id")] == [0, 3]
    assert sh.near_duplicates(docs(spark, [])).count() == 0
    assert sh.dedup(docs(spark, [])).count() == 0


def test_ids_shared_by_different_texts_keep_both_groups(spark):
    d = docs(spark, [(5, "first text of all"), (5, "second and other words entirely"), (5, "first text of all"), (8, "first text of all")])
    assert sorted(r.text for r in sh.dedup(d).collect()) == ["first text of all", "second and other words entirely"]


def test_far_blocks_leave_the_work():
    rng = np.random.default_rng(7)
    for n in (130, 1000, 4096):
        values = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64) << np.uint64(1))
        values[1] = values[0] ^ np.uint64(3 << 20)  # one pair that links
        values = rng.permutation(np.unique(values))
        for radius in (0, 1, 2):
            tally = {}
            a, b = sh.block_links(values, radius, tally)
            d = np.bitwise_count(values[a] ^ values[b])
            assert len(a) == (radius == 2) and (d <= radius).all()
            assert tally["added"] < 0.4 * tally["all"], (n, radius, tally)


def test_forests_connect_what_brute_force_links():
    rng = np.random.default_rng(3)
    for n, bits in ((2, 3), (63, 5), (64, 6), (65, 6), (300, 9), (700, 12)):
        values = np.unique(rng.integers(0, 1 << bits, n, dtype=np.uint64) * np.uint64(0x10001))
        for radius in (0, 1, 2):
            near = [(i, j) for i in range(len(values)) for j in range(i) if int(values[i] ^ values[j]).bit_count() <= radius]
            a, b = sh.block_links(values, radius)
            assert union_all(len(values), list(zip(a.tolist(), b.tolist()))) == union_all(len(values), near)


def test_pairs_are_told_lane_by_lane():
    rng = np.random.default_rng(5)
    for n in (1, 63, 64, 65, 500):
        x = np.array([sum(1 << int(b) for b in rng.choice(64, k, replace=False)) for k in rng.integers(0, 6, n)], np.uint64)
        for radius in (0, 1, 2):
            assert (sh.pair_lanes(x, radius) == (np.bitwise_count(x) <= radius)).all()
    tally = {}
    sh.pair_lanes(rng.integers(0, 2**63, 6400, dtype=np.uint64), 2, tally)
    assert tally["added"] < 0.4 * tally["all"]
