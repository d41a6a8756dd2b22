"""Share of total, top-n, bucketing and tiering (operators P4, P6, P11, P14)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vendora.functions.exact import BIG, pct


def share_of_total(df: DataFrame, measure: str, out: str, scale: int = 2,
                   keys: Sequence[str] = ()) -> DataFrame:
    """Add ``round(measure * 100 / SUM(measure) OVER (PARTITION BY keys), scale)``.

    ``df`` is an aggregate with few rows per total (states, categories, buckets,
    statuses), so the total is a window over those rows: the facts behind them
    are read once. The measure must be integral (counts, cents).
    """
    total = F.sum(F.col(measure).cast(BIG)).over(Window.partitionBy(*keys))
    return df.withColumn(out, pct(F.col(measure), total, scale))


def with_totals(df: DataFrame, sums: dict[str, str]) -> DataFrame:
    """Attach grand totals ``{out: measure}`` to every row of a small aggregate
    (a window over its rows, as in ``share_of_total``)."""
    over = Window.partitionBy()
    return df.withColumns({o: F.sum(F.col(m).cast(BIG)).over(over) for o, m in sums.items()})


def top_n(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """``ORDER BY ... LIMIT n`` -> TakeOrderedAndProject (per-partition top-n,
    then a merge of n rows per partition); never a full sort."""
    return df.orderBy(*order).limit(n)


def bucketize(rules: Sequence[tuple[Column, str]], otherwise: str) -> Column:
    """Ordered rules as a group key: the first that holds wins; a NULL input
    fails every comparison and falls through to ``otherwise``."""
    expr = None
    for cond, label in rules:
        expr = F.when(cond, label) if expr is None else expr.when(cond, label)
    return expr.otherwise(otherwise) if expr is not None else F.lit(otherwise)


tier = bucketize


def bucket_table(df: DataFrame, rules: Sequence[tuple[Column, str]], otherwise: str, order: Column,
                 out: str, count: str, share: str, sums: dict[str, str] | None = None) -> DataFrame:
    """P14 in table form: per bucket its label, row count, share of all rows and
    sums, in the order of the smallest ``order`` value of each bucket."""
    aggs = [F.sum(c).alias(o) for o, c in (sums or {}).items()]
    g = df.groupBy(bucketize(rules, otherwise).alias(out)).agg(
        F.count(F.lit(1)).alias(count), *aggs, F.min(order).alias("__order"))
    return share_of_total(g, count, share).orderBy("__order").drop("__order")


def segment_2x2(df: DataFrame, x: str, y: str, out: str, labels: dict[tuple[bool, bool], str]) -> DataFrame:
    """Place each row in a 2x2 grid against the means of integral columns
    ``x`` and ``y`` over the frame, an aggregate of few rows (window totals).

    "High" is strictly above the mean, tested exactly as ``v * count > sum``
    (no rounded mean). ``labels[(x_high, y_high)]`` names a cell; a NULL input
    fails both tests and lands in the ``(False, False)`` cell, like the
    reference's ELSE branch."""
    over = Window.partitionBy()
    df = df.withColumns({"__sx": F.sum(F.col(x).cast(BIG)).over(over), "__nx": F.count(x).over(over),
                         "__sy": F.sum(F.col(y).cast(BIG)).over(over), "__ny": F.count(y).over(over)})
    xv, yv = F.col(x).cast(BIG) * F.col("__nx"), F.col(y).cast(BIG) * F.col("__ny")
    xh, xl, yh, yl = xv > F.col("__sx"), xv <= F.col("__sx"), yv > F.col("__sy"), yv <= F.col("__sy")
    label = (F.when(xh & yh, labels[(True, True)]).when(xh & yl, labels[(True, False)])
             .when(xl & yh, labels[(False, True)]).otherwise(labels[(False, False)]))
    return df.withColumn(out, label).drop("__sx", "__nx", "__sy", "__ny")


def distinct_counts(df: DataFrame, keys: Sequence[str], distinct: dict[str, str],
                    sums: dict[str, str] | None = None) -> DataFrame:
    """Several ``COUNT(DISTINCT col)`` (and plain sums) per group in one pass.

    Every row yields one ``(column number, value)`` per distinct column; the fold
    on ``(keys, number, value)`` removes duplicates on the map side, and counting
    folded rows per group gives all counts. Sums ride along with the first
    column. ``df`` should be folded as far as it can be; it is read once.
    Output: ``keys``, one column per ``distinct`` and ``sums`` entry; NULL is a
    group, NULL values are not counted.
    """
    keys, sums = list(keys), sums or {}
    tagged = F.array(*[F.struct(F.lit(i).alias("t"), F.col(c).cast("string").alias("x"),
                                *[F.when(F.lit(i == 0), F.col(m)).alias(f"s{j}") for j, m in enumerate(sums.values())])
                       for i, c in enumerate(distinct.values())])
    folded = (df.select(*keys, F.explode(tagged).alias("__e")).select(*keys, "__e.*")
              .groupBy(*keys, "t", "x").agg(*[F.sum(f"s{j}").alias(f"s{j}") for j in range(len(sums))] or [F.lit(1).alias("__one")]))
    return folded.groupBy(*keys).agg(
        *[F.count_if((F.col("t") == i) & F.col("x").isNotNull()).alias(o) for i, o in enumerate(distinct)],
        *[F.sum(f"s{j}").alias(o) for j, o in enumerate(sums)])
