import hashlib
import math

from tests.llm.helpers import DOCS, docs, rows
from vendora.llm import mixing as mx


def u(*parts):
    return int(hashlib.md5(":".join(parts).encode()).hexdigest()[:13], 16) / 2**52


def draw(rate, doc, seed="17"):
    """Inversion of the distribution function, one term after the other."""
    draws = max(math.ceil(rate / 16), 1)
    total = 0
    for j in range(1, draws + 1):
        x, p = u(seed, "n", doc, str(j)), math.exp(-rate / draws)
        c, k = p, 0
        while c <= x and k < 80:
            k += 1
            p *= rate / draws / k
            c += p
        total += k
    return total


def brute(texts, rate_of):
    out = []
    for doc, text, source in texts:
        name = "" if doc is None else str(doc)
        for copy in range(draw(rate_of[source], name)):
            out.append((doc, copy, hashlib.md5(f"17:s:{name}:{copy}".encode()).hexdigest()[:16]))
    return sorted(out, key=lambda r: [(x is not None, x if x is not None else 0) for x in r])


def test_copies_match_inversion_one_by_one(spark):
    texts = [(i, "x" * (i % 50), f"s{i % 4}") for i in range(300)] + [(300 + i, "tiny", "rare") for i in range(3)]
    texts += [(None, "no id", "s1"), (None, "no id", "s1"), (7, "again", "s2"), (400, None, "void"), (401, "", "void"), (402, "null source " * 9, None)]
    d = spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in texts], DOCS).selectExpr("*", "9 as copy", "8 as mix_draws")
    rate_of = {r.source: r.rate for r in mx.rates(d).collect()}
    size = {}
    for _, t, s in texts:
        size[s] = size.get(s, 0) + len(t or "")
    wall = sum(math.sqrt(v) for v in size.values())
    for s, v in size.items():
        assert math.isclose(rate_of[s], math.sqrt(v) / wall * sum(size.values()) / v if v else 1.0)
    got = mx.mix(d, shards=5)
    assert got.columns == [*d.columns, "copy_", "shuffle_key"]
    assert rows(got, "doc_id", "copy_", "shuffle_key") == brute(texts, rate_of)


def test_given_weights_large_rates_and_missing_sources(spark):
    d = spark.createDataFrame([(i, "w" * 10, "en", "big" if i < 400 else "small", 10) for i in range(410)], DOCS)
    got = mx.mix(d, {"small": 1.0}, shards=3)
    n = got.count()
    assert {r.source for r in got.select("source").distinct().collect()} == {"small"}
    assert abs(n - 410) < 5 * math.sqrt(410)  # rate 41: three draws of a third each
    assert rows(got, "doc_id", "copy", "shuffle_key") == brute([(i, "", "small") for i in range(400, 410)], {"small": 41.0})


def test_order_is_global_by_shards(spark):
    d = docs(spark, ["some text"] * 200)
    parts = mx.mix(d, shards=4).rdd.glom().collect()
    keys = [[r.shuffle_key for r in p] for p in parts]
    assert keys == [sorted(k) for k in keys]
    flat = [k for p in keys for k in p]
    assert flat == sorted(flat) and len([p for p in keys if p]) == 4


def test_empty(spark):
    assert mx.mix(docs(spark, [])).count() == 0
    assert mx.mix(docs(spark, ["a"]), {}).count() == 0
