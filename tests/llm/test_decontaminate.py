import hashlib
import random

from tests.llm.helpers import DOCS, docs, rows, words
from vendora.llm import decontaminate as dc

BENCH = "item_id long, text string"


def brute(texts, bench, size=13):
    windows = {}
    for item, text in bench:
        w = words(text)
        for i in range(max(len(w) - size, 0) + 1):
            if w:
                windows.setdefault(tuple(w[i:i + size]), set()).add(item)
    out = []
    for doc, text in texts:
        w = words(text)
        hit, items = set(), set()
        for g, ids in windows.items():
            for i in range(len(w) - len(g) + 1):
                if tuple(w[i:i + len(g)]) == g:
                    hit.update(range(i, i + len(g)))
                    items.update(str(x) for x in ids if x is not None)
        digest = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(items), digest, len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=lambda r: [(x is not None, x if x is not None else 0) for x in r])


def test_matches_brute_force_on_edges(spark):
    rng = random.Random(3)
    vocab = ["the", "of", "alpha", "béta", "gamma", "delta", "x1", "zeta"]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    long_item, item = text(30), "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    bench = [(1, item), (2, long_item), (2, long_item), (30, "Short, item!"), (4, None), (5, "..."), (None, "null id item here"), (6, "béta")]
    texts = [(1, item.upper()), (2, "x " + item.replace(" ", " -- ") + " y"), (3, text(400) + " " + long_item + " " + text(300)),
             (4, None), (5, ""), (5, "short ITEM"), (5, "short ITEM"), (5, "nothing at all"), (None, "a null id item here b"),
             (7, "word " * 5000 + item), (8, "short item " * 300), (9, "BÉTA"), (10, "béta short item"), (11, item[:-9])]
    d = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts], DOCS)
    got = dc.contamination(d, spark.createDataFrame(bench, BENCH))
    assert rows(got) == brute(texts, bench)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_clean_keeps_columns_and_clashing_names(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen"
    d = docs(spark, [item, "clean text", None, ""]).selectExpr("*", "1 as contamination", "2 as w", "'z' as items", "3 as decon_key", "4 as start")
    got = dc.clean(d, spark.createDataFrame([(1, item)], BENCH))
    assert got.columns == d.columns
    assert [r[0] for r in rows(got, "doc_id")] == [1, 2, 3]


def test_empty_tables(spark):
    none, bench = docs(spark, []), spark.createDataFrame([], BENCH)
    assert dc.contamination(none, bench).count() == 0
    assert rows(dc.contamination(docs(spark, ["a b"]), bench), "n_words", "n_hit", "contaminated") == [(2, 0, False)]


def test_proximity_and_phrases(spark):
    item = "aa bb cc dd ee ff gg hh ii jj kk ll mm"
    d = docs(spark, [item, item.replace("ff", "ff extra"), "aa zz mm", item + " " + item])
    bench = spark.createDataFrame([(1, item)], BENCH)
    assert rows(dc.phrase_matches(d, bench), "doc_id", "start") == [(0, 0), (3, 0), (3, 13)]
    near = {r[0] for r in rows(dc.proximity_matches(d, bench, slop=2), "doc_id")}
    assert near == {0, 1, 3}


def test_broadcast_and_shuffle_agree(spark, monkeypatch):
    from vendora.llm import common
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    d, bench = docs(spark, [item, "x " + item, "one two"]), spark.createDataFrame([(1, item)], BENCH)
    want = rows(dc.contamination(d, bench))
    monkeypatch.setattr(dc, "maybe_broadcast", lambda df, *a, **k: common.maybe_broadcast(df, *a, limit=0))
    assert rows(dc.contamination(d, bench)) == want


def test_proximity_finds_altered_words(spark):
    item = "aa bb cc dd ee ff gg hh ii jj kk ll mm"
    ws = item.split()
    one = [" ".join(["x"] * k + [w if j != k else "other" for j, w in enumerate(ws)]) for k in range(13)]
    two = [" ".join(w if j not in (k, (k + 5) % 13) else "changed" for j, w in enumerate(ws)) for k in range(13)]
    three = [item.replace("aa", "o").replace("bb", "o").replace("cc", "o")]
    texts = one + two + three
    bench = spark.createDataFrame([(1, item)], BENCH)
    for more in ([], ["bb cc dd ee " * 3]):  # other words are the rarest
        got = rows(dc.proximity_matches(docs(spark, texts + more), bench, slop=0), "doc_id", "start")
        assert got == [(k, k if k < 13 else 0) for k in range(26)]
    # a word that the corpus lacks counts as altered everywhere
    assert rows(dc.proximity_matches(docs(spark, [item.replace("aa", "zz")]), bench), "doc_id") == [(0,)]
    assert rows(dc.proximity_matches(docs(spark, ["aa", "bb"]), spark.createDataFrame([(1, "aa bb")], BENCH), slop=0, least=0.5), "doc_id") == [(0,), (1,)]


def test_rows_without_or_with_one_id(spark):
    """Thousands of rows that share an id, or have none, cost what others do."""
    import time
    rng = random.Random(1)
    item = " ".join(f"w{i}" for i in range(40))
    texts = [(None, item + f" own{i} " + " ".join(rng.choice("abc") for _ in range(5))) for i in range(2000)]
    texts += [(7, f"lead{i} " + item) for i in range(2000)] + [(8, item)] * 500 + [(9, "clean words only")] * 3
    d = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts], DOCS)
    start = time.time()
    got = dc.contamination(d, spark.createDataFrame([(1, item), (2, item)], BENCH))
    assert rows(got) == brute_planted(texts, item)
    assert time.time() - start < 90
    near = dc.proximity_matches(d, spark.createDataFrame([(1, item)], BENCH), slop=0, least=1.0)
    assert near.groupBy("doc_id").count().where("doc_id = 8").first()["count"] == 500 * 28


def brute_planted(texts, item):
    digest = hashlib.sha256(b"1,2").hexdigest()
    out = [(i, len(words(t)), 40, 2, digest, True) if item in t else (i, len(words(t)), 0, 0, hashlib.sha256(b"").hexdigest(), False) for i, t in texts]
    return sorted(out, key=lambda r: [(x is not None, x if x is not None else 0) for x in r])


def test_many_items_share_a_passage(spark):
    passage = " ".join(f"p{i}" for i in range(40))
    bench = [(i, passage + (f" more{i} " * 13 if i % 2 else "")) for i in range(600)]
    texts = [(i, f"start{i} {passage} end" if i % 3 else f"other {i}") for i in range(900)]
    got = dc.contamination(spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts], DOCS), spark.createDataFrame(bench, BENCH))
    every = hashlib.sha256(",".join(sorted(str(i) for i in range(600))).encode()).hexdigest()
    assert {(r["n_items"], r["items_sha256"] == every) for r in got.collect() if r["doc_id"] % 3} == {(600, True)}
    windows, items = dc.benchmark_windows(spark.createDataFrame(bench, BENCH))
    assert "items" not in windows.columns and items.count() < 600 * 20
    found = dc.phrase_matches(docs(spark, [passage]), spark.createDataFrame(bench[:3], BENCH))
    assert {tuple(r["items"]) for r in found.collect()} == {("0", "1", "2")}
