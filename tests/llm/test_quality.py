import zlib

import numpy as np
import pytest

from tests.conftest import SMOKE
from tests.llm.helpers import docs, rows
from vendora.llm import quality as q

LABELS = "doc_id long, quality int, toxic int"


def good(i):
    return f"The report number {i} says that all of it went well. Nobody asked twice, and we left.\nThen it rained for {i} days."


def junk(i):
    return f"{i} ### $$$ BUY!! " * 20


@pytest.fixture(scope="module")
def fitted(spark):
    d = docs(spark, [good(i) if i % 3 else junk(i) for i in range(240)])
    labels = spark.createDataFrame([(i, 1 if i % 3 else 0, 0) for i in range(240)], LABELS)
    return d, labels


def test_held_out_accuracy_and_columns(spark, fitted):
    got = rows(q.classify(*fitted))
    assert len(got) == 240
    for doc, held, score, predicted in got:
        assert held == (zlib.crc32(str(doc).encode()) % 5 == 0)
        assert predicted == int(score >= 0.3) == (1 if doc % 3 else 0)


def test_held_out_labels_are_never_read(spark, fitted):
    d, labels = fitted
    lied = labels.selectExpr("doc_id", "if(crc32(cast(doc_id as string)) % 5 = 0, 1 - quality, quality) as quality", "toxic")
    assert rows(q.classify(d, labels)) == rows(q.classify(d, lied))


def test_labels_inputs_are_no_features(spark, fitted):
    d, labels = fitted
    other = d.selectExpr("doc_id", "text", "'xx' as lang", "'yy' as source", "0L as n_chars", "'clash' as score", "1 as predicted")
    assert rows(q.classify(d, labels), "doc_id", "score") == rows(q.classify(other, labels), "doc_id", "score")
    assert q.with_score(other, labels, "own").columns == [*other.columns, "own"]


def test_edges(spark):
    odd = docs(spark, [None, "", "word", "x" * 2_000_000, "a b " * 100_000, (None, "no id"), (7, "twice"), (7, "twice")])
    labels = spark.createDataFrame([(1, 0, 0), (1, 1, 0), (2, None, 0), (None, 1, 0), (3, 1, None)], LABELS)
    scores = [r[0] for r in rows(q.classify(odd, labels), "score")]
    assert len(scores) == 8 and all(0 <= s <= 1 for s in scores)
    none = spark.createDataFrame([], LABELS)
    assert {r[0] for r in rows(q.classify(odd, none), "score")} == {0.5}
    assert q.classify(docs(spark, []), labels).count() == 0


def test_one_class(spark):
    d = docs(spark, ["a", "b", "c"])
    labels = spark.createDataFrame([(i, 1, 0) for i in range(3)], LABELS)
    assert all(r[0] > 0.99 for r in rows(q.classify(d, labels), "score"))


def test_flat_traversal_equals_node_by_node():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((500, len(q.FEATURES)))
    y = (x[:, 0] * x[:, 1] + 0.3 * x[:, 2] > 0).astype(float)
    m = q.fit(x, y)
    slow = []
    for row in x[:60]:
        raw = m.base
        for f, t, v in zip(m.feature, m.threshold, m.value):
            node = 0
            while node < len(f):
                node = 2 * node + (2 if row[f[node]] > t[node] else 1)
            raw += v[node - len(f)]
        slow.append(1 / (1 + np.exp(-raw)))
    assert np.allclose(slow, m.score(x[:60]))
    assert ((m.score(x) > 0.5) == y).mean() > 0.9


def test_accuracy_on_testdata(spark):
    """Held-out rows of the given tables: both classes right in at least 95 %."""
    sf = SMOKE.replace("sf0.001", "sf0.01")
    d, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = q.classify(d, labels).where("held_out").join(labels.select("doc_id", "quality"), "doc_id")
    right = [r["n"] for r in got.selectExpr("avg(cast(predicted = quality as int)) as n").collect()]
    assert right[0] >= 0.95


def test_fit_against_every_split_tried(monkeypatch):
    """Each node's split has the largest gain of all cuts of all features, summed row by
    row; leaves and the next tree's residuals follow from the same rows."""
    monkeypatch.setattr(q, "TREES", 4)
    rng = np.random.default_rng(5)
    x = np.round(rng.standard_normal((160, 6)), 1)  # ties
    x[:, 4] = 1.0                                   # a constant feature
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3) | (rng.random(160) < 0.1)).astype(float)
    m = q.fit(x, y)
    cuts = [sorted(set(np.quantile(x[:, j], np.linspace(0, 1, q.BINS + 1)[1:-1]).tolist())) for j in range(x.shape[1])]
    raw = [float(np.log(y.mean() / (1 - y.mean())))] * len(y)
    assert m.base == pytest.approx(raw[0])

    def gain(rows_, j, cut, g, h):
        left = [i for i in rows_ if x[i, j] <= cut]
        right = [i for i in rows_ if x[i, j] > cut]
        parts = [(sum(g[i] for i in part), sum(h[i] for i in part)) for part in (left, right, rows_)]
        if min(parts[0][1], parts[1][1]) < q.LEAST / 10:
            return 0.0
        (gl, hl), (gr, hr), (gt, ht) = parts
        return gl * gl / (hl + q.L2) + gr * gr / (hr + q.L2) - gt * gt / (ht + q.L2)

    splits = 0
    for feature, threshold, value in zip(m.feature, m.threshold, m.value, strict=True):
        p = [1 / (1 + np.exp(-r)) for r in raw]
        g, h = [y[i] - p[i] for i in range(len(y))], [v * (1 - v) for v in p]
        held = {0: list(range(len(y)))}
        for node in range(len(feature)):
            best = max((gain(held[node], j, c, g, h) for j in range(x.shape[1]) for c in cuts[j]), default=0.0)
            if np.isinf(threshold[node]):
                assert best < 1e-6
            else:
                assert gain(held[node], feature[node], threshold[node], g, h) == pytest.approx(best)
                splits += 1
            held[2 * node + 1] = [i for i in held[node] if x[i, feature[node]] <= threshold[node]]
            held[2 * node + 2] = [i for i in held[node] if x[i, feature[node]] > threshold[node]]
        for leaf, v in enumerate(value):
            members = held[len(feature) + leaf]
            want = q.RATE * sum(g[i] for i in members) / (sum(h[i] for i in members) + q.L2)
            assert v == pytest.approx(want, abs=1e-12)
            for i in members:
                raw[i] += want
    assert splits >= 12
    assert np.allclose(1 / (1 + np.exp(-np.array(raw))), m.score(x))
