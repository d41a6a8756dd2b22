"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of the whole text are computed by one vectorised function, the same
for training and scoring. Trees are grown level by level from per-bin gradient
histograms and stored as flat arrays (feature, threshold, leaf value), so that
scoring walks all trees of a batch with numpy indexing, one step per level.

Scale: the fit uses at most ``MAX_TRAIN`` labelled documents, those with the
smallest hash of their id, which bounds the broadcast, the driver's matrix and
the model. Scoring has no shuffle: documents stream through Arrow batches.

Defined results: null text counts as empty, and empty texts get a score like any
other; a null id counts as the empty string when held-out rows are chosen;
labels with a null id or quality are skipped, of several labels of a document
the worst counts; of several training rows with one id one is used; without
labels of both kinds the score is the share of label 1 (0.5 without any label).
Extra columns pass through ``with_score``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_TRAIN = 20_000     # labelled documents of one fit
TREES, DEPTH, BINS = 80, 4, 64
RATE, L2, LEAST = 0.15, 1.0, 20.0
CUT = 0.3              # predicted 1 from this score on

FEATURES = ["log_bytes", "log_words", "log_lines", "upper", "digit", "space", "stop_marks", "symbols", "pipes",
            "bangs", "non_ascii", "entropy", "word_len", "word_len_sd", "longest_word", "distinct_words",
            "top_word", "repeats", "distinct_lines", "line_words", "line_ends", "word_marks"]

_CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "space": b" \t\n\r\v\f",
            "stop_marks": b".,;:?", "symbols": b"#$%&*@^~+=<>{}[]\\/_", "pipes": b"|", "bangs": b"!"}
_INDEX = {k: np.frombuffer(v, np.uint8) for k, v in _CLASSES.items()}


def statistics(text: str | None) -> list[float]:
    """The features of one whole text, in the order of ``FEATURES``."""
    data = (text or "").encode("utf-8", "replace")
    n = max(len(data), 1)
    hist = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    share = {k: hist[v].sum() / n for k, v in _INDEX.items()}
    p = hist[hist > 0] / n
    words = data.split()
    count = max(len(words), 1)
    lens = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1)
    tally = Counter(words)
    lines = [x for x in data.split(b"\n") if x.strip()]
    n_lines = max(len(lines), 1)
    marked = sum(1 for w, c in tally.items() if not (w[-1] >= 128 or chr(w[-1]).isalnum()))
    return [np.log1p(len(data)), np.log1p(len(words)), np.log1p(len(lines)),
            share["upper"], share["digit"], share["space"], share["stop_marks"], share["symbols"], share["pipes"],
            share["bangs"], hist[128:].sum() / n, float(-(p * np.log2(p)).sum()) if len(p) else 0.0,
            float(lens.mean()), float(lens.std()), float(lens.max()), len(tally) / count,
            max(tally.values(), default=0) / count, sum(map(eq, words, words[1:])) / count,
            len(set(lines)) / n_lines, len(words) / n_lines,
            sum(x.rstrip()[-1:] in (b".", b"!", b"?", b":", b'"') for x in lines) / n_lines,
            marked / max(len(tally), 1)]


@dataclass
class Model:
    """Flat trees: ``feature`` and ``threshold`` are (trees, inner nodes) in
    heap order, ``value`` is (trees, leaves)."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            raw += v[node - len(f)]
        return 1 / (1 + np.exp(-raw))


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Boosted trees on the logistic loss; a constant if one class is missing."""
    empty = Model(0.0, np.zeros((0, 2**DEPTH - 1), np.int64), np.zeros((0, 2**DEPTH - 1)), np.zeros((0, 2**DEPTH)))
    if len(y) == 0:
        return empty
    mean = y.mean()
    if mean in (0.0, 1.0):
        empty.base = 30.0 if mean else -30.0
        return empty
    n, width = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)  # x <= cuts[b] iff bin <= b
    offset = np.arange(width) * BINS
    base = float(np.log(mean / (1 - mean)))
    raw = np.full(n, base)
    feats, thrs, vals = [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, p * (1 - p)
        feature, threshold = np.zeros(2**DEPTH - 1, np.int64), np.full(2**DEPTH - 1, np.inf)
        node = np.zeros(n, np.int64)  # within its level
        for level in range(DEPTH):
            m = 2**level
            cell = (node[:, None] * (width * BINS) + offset + binned).ravel()
            size = m * width * BINS
            hg = np.bincount(cell, np.repeat(g, width), size).reshape(m, width, BINS).cumsum(2)
            hh = np.bincount(cell, np.repeat(h, width), size).reshape(m, width, BINS).cumsum(2)
            tg, th = hg[:, :, -1:], hh[:, :, -1:]
            gain = hg**2 / (hh + L2) + (tg - hg) ** 2 / (th - hh + L2) - tg**2 / (th + L2)
            gain[(hh < LEAST / 10) | (th - hh < LEAST / 10)] = 0
            for j, c in enumerate(cuts):
                gain[:, j, len(c):] = 0  # no cut point there
            best = gain.reshape(m, -1).argmax(1)
            j, b = best // BINS, best % BINS
            ok = gain.reshape(m, -1)[np.arange(m), best] > 1e-9
            at = m - 1 + np.arange(m)
            feature[at] = np.where(ok, j, 0)
            threshold[at] = [cuts[jj][bb] if good else np.inf for jj, bb, good in zip(j, b, ok, strict=True)]
            right = ok[node] & (binned[np.arange(n), j[node]] > b[node])
            node = 2 * node + right
        sg, sh = np.bincount(node, g, 2**DEPTH), np.bincount(node, h, 2**DEPTH)
        value = RATE * sg / (sh + L2)
        raw += value[node]
        feats.append(feature)
        thrs.append(threshold)
        vals.append(value)
    return Model(base, np.array(feats), np.array(thrs), np.array(vals))


def held_out(doc_id: Column) -> Column:
    """Rows never used for a fit: crc32 of the id's text is divisible by 5."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def _matrix(texts: pd.Series) -> np.ndarray:
    return np.array([statistics(t) for t in texts], dtype=np.float64).reshape(-1, len(FEATURES))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN) -> Model:
    """Fit on at most ``max_rows`` labelled documents that are not held out."""
    chosen = (labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
              .groupBy("doc_id").agg(F.min("quality").alias("quality"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows))

    @F.pandas_udf("array<double>")
    def stats(texts: pd.Series) -> pd.Series:
        return pd.Series(list(_matrix(texts)))

    rows = (docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
            .select("doc_id", "quality", stats("text").alias("x"))
            .groupBy("doc_id", "quality").agg(F.min("x").alias("x"))).toPandas().sort_values("doc_id")
    x = np.array(list(rows["x"]), dtype=np.float64).reshape(-1, len(FEATURES))
    return fit(x, rows["quality"].to_numpy(np.float64))


def score_column(model: Model) -> "callable":
    """A column function text -> score."""
    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(model.score(_matrix(texts)))
    return score


def with_score(docs: DataFrame, labels: DataFrame, out: str, max_rows: int = MAX_TRAIN) -> DataFrame:
    """``docs`` with the score as column ``out``."""
    return docs.withColumn(out, score_column(train(docs, labels, max_rows))("text"))


def classify(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted."""
    return (with_score(docs.select("doc_id", "text"), labels, "score", max_rows)
            .select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                    (F.col("score") >= CUT).cast("int").alias("predicted")))
