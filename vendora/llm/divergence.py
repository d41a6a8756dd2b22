"""Divergence audit of the sources of each language, by Gustavson accumulation.

A group is a (lang, source) pair; its profile gives each kept term of the language
the smoothed rate p = 1 + (SCALE * (count + 2)) div (N + 2 V), also terms that it
lacks (count 0: the group's base). Two profiles differ by the sum over all kept
terms of f(p, q) = (p - q)^2 div (p + q), a symmetric chi-square distance. Only
integers are added up, so results do not depend on the order of work.

1. Texts are counted to (lang, source, term) with documents per term; what a task
   has counted it folds before it shuffles.
2. The counts are dealt to blocks of terms. A task holds the term-major index of
   its block (per term the groups that have it) and takes the groups as rows, one
   after another: each scatters its terms through the index into a dense
   accumulator over its later peers. One row a pair of groups leaves the task, and
   no pair of postings does.
3. A term that only one of two groups has is not met in the index. The sum starts
   from the baseline V * f(base, base); each group adds f(p, base of the peer) less
   the baseline over its own terms, folded by equal p; and what the index meets
   takes back these two and adds f(p, q).

Terms that lift a group over its language are ranked by value, the first ``TOP``.

Skew: a hot group is spread over all blocks, a hot term is one row a group. The
arrays held are as long as a language has sources, which is a row of the result.

Defined results: null text, lang and source count as empty strings, so null and
empty sources are one group; groups without terms and languages without kept
terms have their pairs (value 0 if nothing is kept); repeated rows and null ids
count row by row; an empty table gives an empty result; only the three columns
are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vendora.llm.common import maybe_broadcast, stored

MIN_DOCS = 10
TOP = 10
SCALE = 1_000_000_000
HELD = 200_000   # counters that a task holds before it passes them on
ROOM = 1 << 20   # postings expanded at a time

# Bytes of a text: A-Z lower-cased, other ASCII but letters blank.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

_COUNTED = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, text) rows to (lang, source, term, n, docs), folded as far as
    a task may hold; a null term marks a group."""
    held: dict[tuple, tuple[Counter, Counter]] = {}
    size = 0

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            yield pa.RecordBatch.from_pydict({
                "lang": [lang] * (len(n) + 1), "source": [source] * (len(n) + 1), "term": [None, *(t.decode("utf-8", "replace") for t in n)],
                "n": [0, *n.values()], "docs": [0, *(docs[t] for t in n)]}, _COUNTED)

    for batch in batches:
        for lang, source, text in zip(batch["lang"], batch["source"], batch["text"], strict=True):
            n, docs = held.setdefault((lang.as_py(), source.as_py()), (Counter(), Counter()))
            before = len(n)
            mine = Counter((text.as_py() or "").encode("utf-8", "replace").translate(_TABLE).split())
            n.update(mine)
            docs.update(mine.keys())
            size += len(n) - before
            if size > HELD:
                yield from out()
                held, size = {}, 0
    yield from out()


def f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact for rates up to SCALE + 1: the square is under 2^63."""
    return (p - q) ** 2 // (p + q)


def _overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, lang, at, term, p, base) rows, sorted by block, lang and at, to
    (lang, a, b, v), a < b: sums over the terms that both have of
    f(p, q) - f(p, base) - f(base, q) + f(base, base)."""
    def block(lang: str, at: np.ndarray, term: np.ndarray, p: np.ndarray, base: np.ndarray) -> Iterator[pa.RecordBatch]:
        # Groups and terms by their place in the block; ``at`` ascends.
        groups, row = np.unique(at, return_inverse=True)
        _, column = np.unique(term, return_inverse=True)
        index = np.lexsort((row, column))  # term-major: a term's groups ascend
        place = np.empty(len(index), np.int64)
        place[index] = np.arange(len(index))
        ends = np.cumsum(np.bincount(column))[column]  # of a term's postings, for each entry
        peers, rates, bases = row[index], p[index], base[index]
        later = ends - place - 1  # postings of the entry's term by later groups
        starts = np.searchsorted(row, np.arange(len(groups) + 1))
        for a in range(len(groups)):
            total = np.zeros(len(groups), np.int64)
            s, end = starts[a], starts[a + 1]
            load = np.cumsum(later[s:end])
            while s < end:  # the row's entries, as many at a time as there is room for
                upto = max(int(np.searchsorted(load, (load[s - starts[a] - 1] if s > starts[a] else 0) + ROOM, "right")) + starts[a], s + 1)
                k = later[s:upto]
                own = np.repeat(np.arange(s, upto), k)
                met = place[own] + 1 + np.arange(len(own)) - np.repeat(np.cumsum(k) - k, k)
                x, bx, y, by = p[own], base[own], rates[met], bases[met]
                np.add.at(total, peers[met], f(x, y) - f(x, by) - f(bx, y) + f(bx, by))
                s = upto
            b = np.flatnonzero(total)
            if len(b):
                yield pa.RecordBatch.from_pydict({"lang": [lang] * len(b), "a": np.full(len(b), groups[a]), "b": groups[b], "v": total[b]})

    held: list = []

    def parts(cols: list, keep_last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal held
        key, lang = cols[0], cols[1]
        change = np.flatnonzero((key[1:] != key[:-1]) | (lang[1:] != lang[:-1])) + 1
        edges = [0, *change.tolist(), len(key)]
        for s, e in zip(edges[:-1], edges[1:] if not keep_last else edges[1:-1], strict=False):
            yield from block(lang[s], *(c[s:e] for c in cols[2:]))
        held = [c[edges[-2]:] for c in cols] if keep_last else []

    for batch in batches:
        if batch.num_rows:
            cols = [batch[c].to_numpy(zero_copy_only=False) for c in ("block", "lang", "at", "term", "p", "base")]
            yield from parts([np.concatenate(x) for x in zip(held, cols, strict=True)] if held else cols, True)
    if held:
        yield from parts(held, False)


def _one_sided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, at, base, v_all, ps, ns, bases) rows, one a group, to (lang, a, b,
    v): what the group's own terms add against each peer's base; the baseline
    over all kept terms is added on the pair's smaller side."""
    for batch in batches:
        for row in range(batch.num_rows):
            lang, at, base, kept, ps, ns, bases = (batch[c][row] for c in ("lang", "at", "base", "v_all", "ps", "ns", "bases"))
            ps, ns, bases = (x.values.to_numpy() for x in (ps, ns, bases))
            at, base, floor = at.as_py(), base.as_py(), f(np.int64(base.as_py()), bases)
            total = np.where(np.arange(len(bases)) > at, floor * kept.as_py(), 0)
            step = max(1, ROOM // len(bases))
            for s in range(0, len(ps), step):
                p, n = ps[s:s + step, None], ns[s:s + step, None]
                total += (n * (f(p, bases[None, :]) - floor[None, :])).sum(0)
            other = np.flatnonzero(np.arange(len(bases)) != at)
            if len(other):
                yield pa.RecordBatch.from_pydict({"lang": [lang.as_py()] * len(other), "a": np.minimum(at, other), "b": np.maximum(at, other), "v": total[other]})


def _rate(n: Column, total: Column, kept: Column) -> Column:
    """p of a count, in decimals, as SCALE * count may pass 2^63."""
    def big(c: Column) -> Column:
        return c.cast("decimal(18,0)")
    return F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * (big(n) + 2), big(total) + 2 * big(kept)).cast("long") + 1


def profiles(docs: DataFrame, min_docs: int = MIN_DOCS) -> tuple[DataFrame, DataFrame]:
    """(lang, term, source, n, p, q): the counts of kept terms with the rate in the
    group and in the language; (lang, source, at, total, v_all, base): the groups,
    with their place among the language's sources."""
    text = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    counted = docs.select(*text).mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    counts = stored(counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "divergence-counts")
    terms = (counts.where("term is not null").groupBy("lang", "term")
             .agg(F.sum("n").alias("in_lang"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs).drop("docs"))
    kept = stored(counts.where("term is not null").select("lang", "term", "source", "n").join(terms, ["lang", "term"]), "divergence-kept")
    langs = kept.groupBy("lang", "term").agg(F.sum("n").alias("n")).groupBy("lang").agg(F.count("*").alias("v_all"), F.sum("n").alias("lang_total"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    at = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = (counts.where("term is null").select("lang", "source").withColumn("at", at.cast("long"))
              .join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
              .na.fill(0, ["total", "v_all", "lang_total"])
              .withColumn("base", F.when(F.col("v_all") > 0, _rate(F.lit(0), F.col("total"), F.col("v_all"))).otherwise(F.lit(1).cast("long"))))
    groups = stored(groups, "divergence-groups")
    rated = kept.join(maybe_broadcast(groups), ["lang", "source"]).select(
        "lang", "term", "source", "n", "at", "base",
        _rate(F.col("n"), F.col("total"), F.col("v_all")).alias("p"), _rate(F.col("in_lang"), F.col("lang_total"), F.col("v_all")).alias("q"))
    return stored(rated, "divergence-rated"), groups


def pair_values(rated: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, a, b, value): all pairs a < b of places in a language's sources."""
    blocks = max(int(rated.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = (rated.select(F.pmod(F.xxhash64("lang", "term"), F.lit(blocks)).alias("block"), "lang", "at", "term", "p", "base")
             .repartition(blocks, "block").sortWithinPartitions("block", "lang", "at"))
    both = dealt.mapInArrow(_overlap, "lang string, a long, b long, v long")
    # Own terms of a group by equal rate: as many as it has different counts.
    folded = (rated.groupBy("lang", "at", "p").agg(F.count("*").alias("n"))
              .groupBy("lang", "at").agg(F.collect_list("p").alias("ps"), F.collect_list("n").alias("ns")))
    bases = groups.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "base"))), lambda c: c["base"]).alias("bases"))
    none = F.expr("cast(array() as array<bigint>)")
    rows = (groups.select("lang", "at", "base", "v_all").join(folded, ["lang", "at"], "left").join(bases, "lang")
            .select("lang", "at", "base", "v_all", F.coalesce("ps", none).alias("ps"), F.coalesce("ns", none).alias("ns"), "bases"))
    alone = rows.mapInArrow(_one_sided, "lang string, a long, b long, v long")
    return both.union(alone).groupBy("lang", "a", "b").agg(F.sum("v").alias("value"))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): for each group all other sources of
    its language (part ``pair``) and its first ``top`` lifted terms (part ``term``),
    by value descending and item ascending."""
    rated, groups = profiles(docs, min_docs)
    pairs = pair_values(rated, groups)
    both = pairs.select("lang", F.col("a").alias("at"), F.col("b").alias("to"), "value").union(pairs.select("lang", "b", "a", "value"))
    names = maybe_broadcast(groups.select("lang", "at", "source"))
    peers = maybe_broadcast(groups.select("lang", F.col("at").alias("to"), F.col("source").alias("item")))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pair = (both.join(names, ["lang", "at"]).join(peers, ["lang", "to"])
            .select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank")))
    p, q = (F.col(c).cast("decimal(18,0)") for c in ("p", "q"))
    lifted = rated.where("p > q").select("lang", "source", F.col("term").alias("item"),
                                         F.call_function("div", (p - q) * (p - q), p + q).cast("long").alias("value"))
    term = (lifted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
            .select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))
    return pair.union(term)
