"""Embedding near-dedup with spherical-cap filters.

Code: after a random rotation the space is cut into blocks; each block has its
own random unit vectors, and a filter direction is one vector of each block side
by side. A vector passes a filter if its inner product with the direction is at
least the cap's height. Thanks to the product structure the filters a vector
passes are listed without trying them all: the sums of the front blocks and of
the rear blocks are formed once, the rear ones sorted, and each front sum reads
off the rear sums that lift it over the height.

The number of directions follows the number of different vectors, so that a
filter holds few of them at any size. ``CODES`` independent codes are used, which
needs fewer filters in all than one code with lower caps. The height is
calibrated for dimension and code by seeded random pairs at exactly the wanted
cosine: the largest height at which ``RECALL`` of them share a filter of some
code. Closer pairs share more. All depends on seeds only, so tasks agree.

Vectors that share a filter are compared by 64 sign bits first (``sign_bits`` of
the wanted cosine may differ, 20 at 0.95, which a pair at just that cosine exceeds
less than once in a million);
what remains is joined with the vectors and verified by its cosine in doubles.
Only ids and sign bits travel with the filters, not the vectors.

Copies are folded to one class before; classes are named by a 64-bit hash of
their components. Skew: a filter's rows are dealt over cells of at most
``CELL`` rows, and cells are compared two by two, so no task holds a filter that
is large.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components, and rows without an id, link with nothing (component: own id); only
vectors of equal length link; copies link with each other; repeated rows count
row by row; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vendora.llm.common import maybe_broadcast, stored
from vendora.llm.components import components

COSINE = 0.95
RECALL = 0.97
CODES = 16
MISS = 1e-6  # chance that a pair at the wanted cosine differs in more than ``sign_bits``
CELL = 1024
SEED = 20
PAIRS = 400   # of a calibration
CHUNK = 1024  # vectors decoded at a time


def directions(n: int) -> int:
    """Filters for ``n`` different vectors: about one each, 4096 at least."""
    return max(4096, 1 << (max(n, 1) - 1).bit_length())


class Code:
    """Product code in ``dim`` dimensions with at least ``size`` directions."""

    def __init__(self, dim: int, size: int, number: int):
        rng = np.random.default_rng([SEED, 0, dim, size, number])
        self.rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        self.planes = rng.standard_normal((dim, 64))
        m = min(4, max(1, dim // 8))
        if dim == 1:
            self.blocks, self.words = [np.array([0])], [np.array([[1.0], [-1.0]])]
        else:
            each = int(np.ceil(size ** (1 / m) - 1e-9))
            self.blocks = np.array_split(np.arange(dim), m)
            self.words = []
            for b in self.blocks:
                w = rng.standard_normal((each, len(b)))
                self.words.append(w / np.linalg.norm(w, axis=1, keepdims=True) / np.sqrt(m))

    def sums(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, front) and (rows, rear) partial inner products of unit rows."""
        y = x @ self.rotation
        parts = [y[:, b] @ w.T for b, w in zip(self.blocks, self.words, strict=True)]
        half = len(parts) // 2
        return self._all(parts[:half], len(x)), self._all(parts[half:], len(x))

    @staticmethod
    def _all(parts: list[np.ndarray], n: int) -> np.ndarray:
        out = np.zeros((n, 1))
        for p in parts:
            out = (out[:, :, None] + p[:, None, :]).reshape(n, -1)
        return out

    @staticmethod
    def decode(front: np.ndarray, rear: np.ndarray, height: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter) of all filters the rows pass, given their partial sums."""
        need = height - front
        row, able = np.nonzero(need <= rear.max(1, keepdims=True))  # no rear sum lifts the others
        rows, filters = [], []
        step = max(1, (1 << 22) // rear.shape[1])
        for at in range(0, len(row), step):
            r, f = row[at:at + step], able[at:at + step]
            i, back = np.nonzero(rear[r] >= need[r, f][:, None])
            rows.append(r[i])
            filters.append(f[i] * rear.shape[1] + back)
        return (np.concatenate(rows), np.concatenate(filters)) if rows else (row, able)

    def signs(self, x: np.ndarray) -> np.ndarray:
        bits = np.packbits(x @ self.planes > 0, axis=1, bitorder="little")
        return bits.view("<i8")[:, 0]


@lru_cache(maxsize=64)
def codes(dim: int, size: int) -> list[Code]:
    return [Code(dim, size, k) for k in range(CODES)]


@lru_cache(maxsize=64)
def height(dim: int, size: int, cosine: float = COSINE, recall: float = RECALL) -> float:
    """Height at which random pairs at ``cosine`` share a filter of one of
    ``CODES`` codes with probability ``recall``."""
    code = codes(dim, size)[0]
    if dim == 1:
        return 0.5
    rng = np.random.default_rng([SEED, 1, dim, size])
    x = rng.standard_normal((PAIRS, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.standard_normal((PAIRS, dim))
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    y = cosine * x + np.sqrt(max(0.0, 1 - cosine**2)) * z
    (fx, rx), (fy, ry) = code.sums(x), code.sums(y)
    meet = np.full(PAIRS, -1.0)  # per pair the height at which its last common filter is lost
    for i in range(PAIRS):
        top = min(fx[i].max() + rx[i].max(), fy[i].max() + ry[i].max())
        for h in np.arange(0.9 * top, -1.0, -0.1 * top):
            # any filter both pass is found from the first height with one on: the best of them is exact
            both = np.intersect1d(code.decode(fx[i:i + 1], rx[i:i + 1], h)[1], code.decode(fy[i:i + 1], ry[i:i + 1], h)[1])
            if len(both):
                f, r = np.divmod(both, rx.shape[1])
                meet[i] = np.minimum(fx[i][f] + rx[i][r], fy[i][f] + ry[i][r]).max()
                break
    single = 1 - (1 - recall) ** (1 / CODES)
    return float(np.quantile(meet, 1 - single))


@lru_cache(maxsize=64)
def sign_bits(cosine: float) -> int:
    """The sign bits of 64 in which a pair at ``cosine`` may differ: each differs
    with the angle's share of a half turn. Above ``COSINE`` as many as there."""
    p = math.acos(max(min(cosine, COSINE), -1.0)) / math.pi
    return next(b for b in range(65) if math.fsum(math.comb(64, k) * p**k * (1 - p)**(64 - k) for k in range(b + 1, 65)) < MISS)


def unit_rows(vectors: list) -> tuple[np.ndarray, np.ndarray]:
    """(rows, lengths one): indexes and unit vectors of the usable ones among
    vectors of equal length."""
    x = np.array(vectors, dtype=np.float64)
    big = np.abs(x).max(axis=1, initial=0.0)
    ok = np.flatnonzero(np.isfinite(big) & (big > 0))
    x = x[ok] / big[ok, None]
    return ok, x / np.linalg.norm(x, axis=1, keepdims=True)


def _filters(size: int, cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch["id"].to_numpy()
            lengths = np.diff(batch["v"].offsets.to_numpy())
            flat = batch["v"].flatten().to_numpy(zero_copy_only=False)
            starts = np.cumsum(lengths) - lengths
            for dim in np.unique(lengths[lengths > 0]):
                mine = np.flatnonzero(lengths == dim)
                for at in range(0, len(mine), CHUNK):
                    some = mine[at:at + CHUNK]
                    ok, x = unit_rows(flat[starts[some][:, None] + np.arange(dim)])
                    some = some[ok]
                    for k, code in enumerate(codes(int(dim), size)):
                        if k == 0:
                            signs = code.signs(x)
                        row, number = code.decode(*code.sums(x), height(int(dim), size, min(cosine, COSINE)))
                        name = np.uint64(dim) * np.uint64(CODES) + np.uint64(k)  # of the code; mixed so that filters spread
                        key = (number.astype(np.uint64) + (name << np.uint64(40))).view(np.int64)
                        yield pa.RecordBatch.from_pydict({"filter": key, "id": ids[some[row]], "signs": signs[row]})
    return run


def _pairs(bits: int):
    """Sorted (filter, c, d, cell, id, signs) to (a, b) pairs whose signs differ in
    ``bits`` at most."""
    def compare(part: list[np.ndarray]) -> pa.RecordBatch:
        keys, cell, ids, signs = part[:3], part[3], part[4], part[5].view(np.uint64)
        change = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1
        starts = np.concatenate([[0], change])
        a, b = [], []
        for s, e in zip(starts.tolist(), [*change.tolist(), len(ids)], strict=True):
            if e - s < 2:
                continue
            near = np.bitwise_count(signs[s:e, None] ^ signs[None, s:e]) <= bits
            i, j = np.nonzero(np.triu(near, 1))
            if keys[1][s] != keys[2][s]:
                apart = cell[s + i] != cell[s + j]
                i, j = i[apart], j[apart]
            a.append(ids[s + i])
            b.append(ids[s + j])
        x, y = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (a, b))
        return pa.RecordBatch.from_pydict({"a": np.minimum(x, y), "b": np.maximum(x, y)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("filter", "c", "d", "cell", "id", "signs")
        held: list[np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [batch[n].to_numpy() for n in names]
            now = now if held is None else [np.concatenate(p) for p in zip(held, now, strict=True)]
            last = np.logical_and.reduce([k == k[-1] for k in now[:3]])
            cut = len(last) - int(last.sum())
            if cut:
                yield compare([x[:cut] for x in now])
            held = [x[cut:] for x in now]
        if held is not None:
            yield compare(held)
    return run


def _verified(cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (batch[c].flatten().to_numpy(zero_copy_only=False).astype(np.float64) for c in ("x", "y"))
            sizes = np.diff(batch["x"].offsets.to_numpy())
            line = np.repeat(np.arange(len(sizes)), sizes)

            def total(v: np.ndarray) -> np.ndarray:
                return np.bincount(line, v, len(sizes))
            x, y = (v / np.maximum.reduceat(np.abs(v), np.cumsum(sizes) - sizes)[line] for v in (x, y))
            cos = total(x * y) / np.sqrt(total(x * x) * total(y * y))
            ok = cos >= cosine
            yield pa.RecordBatch.from_pydict({"a": batch["a"].to_numpy()[ok], "b": batch["b"].to_numpy()[ok], "cosine": cos[ok]})
    return run


def links(classes: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(a, b, cosine) of different vectors of ``classes`` (id, v)."""
    size = directions(classes.count())
    rows = stored(classes.mapInArrow(_filters(size, cosine), "filter long, id long, signs long"), "sphere-filters")
    hot = (rows.groupBy("filter").agg(F.count("*").alias("n")).where(F.col("n") > CELL)
           .select("filter", F.ceil(F.col("n") / CELL).cast("int").alias("cells")))
    hot = stored(hot, "sphere-hot")
    n = F.coalesce("cells", F.lit(1))
    dealt = (rows.join(maybe_broadcast(hot), "filter", "left")
             .withColumn("cell", F.pmod(F.xxhash64("id"), n).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), n - 1)))
             .select("filter", F.least("cell", "other").alias("c"), F.greatest("cell", "other").alias("d"), "cell", "id", "signs"))
    pairs = (dealt.repartition("filter", "c", "d").sortWithinPartitions("filter", "c", "d")
             .mapInArrow(_pairs(sign_bits(cosine)), "a long, b long").distinct())
    same = F.size("x") == F.size("y")
    return (pairs.join(classes.toDF("a", "x"), "a").join(classes.toDF("b", "y"), "b").where(same)
            .select("a", "b", "x", "y").mapInArrow(_verified(cosine), "a long, b long, cosine double"))


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, embedding): vec_id, n_links,
    component_id, kept."""
    v = F.col("embedding").cast("array<double>")
    usable = (F.col("vec_id").isNotNull() & (F.size("embedding") > 0)
              & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
              & F.exists(v, lambda x: x != 0))
    rows = vectors.select("vec_id", F.when(usable, F.col("embedding")).alias("v")).withColumn("id", F.when(F.col("v").isNotNull(), F.xxhash64("v")))
    classes = stored(rows.where("id is not null").groupBy("id")
                     .agg(F.first("v").alias("v"), F.min("vec_id").alias("first"), F.count("*").alias("copies")), "sphere-classes")
    found = stored(links(classes.select("id", "v"), cosine).select("a", "b"), "sphere-links")
    both = found.union(found.select("b", "a")).toDF("id", "other")
    counts = (both.join(classes.select(F.col("id").alias("other"), "copies"), "other")
              .groupBy("id").agg(F.sum("copies").alias("others")))
    roots = components(found).toDF("id", "root")
    named = (classes.select("id", "first", "copies").join(counts, "id", "left").join(roots, "id", "left")
             .withColumn("root", F.coalesce("root", "id")))
    named = stored(named, "sphere-named")
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    facts = named.join(least, "root").select("id", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id")
    out = rows.select("vec_id", "id").join(facts, "id", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
