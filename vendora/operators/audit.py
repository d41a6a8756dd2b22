"""Data-quality audits (operators D1-D5, P2, P3).

Spark does not enforce the declared keys, NOT NULL or CHECK constraints; these
jobs measure them after the load. Each audit is one pass (one aggregate or one
join) per table.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vendora.functions.exact import BIG, pct


def row_count_report(tables: Mapping[str, DataFrame]) -> DataFrame:
    """``table_name, row_count`` for every table, ordered by name.

    ``count()`` over Parquet needs no column data (row-group metadata)."""
    parts = [df.agg(F.count(F.lit(1)).alias("row_count"))
             .select(F.lit(name).alias("table_name"), "row_count")
             for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy("table_name")


def audit_nulls(df: DataFrame, cols: Sequence[str], scale: int = 2) -> DataFrame:
    """``column_name, null_count, null_pct`` for ``cols`` in one pass."""
    agg = df.agg(F.count(F.lit(1)).alias("__n"),
                 *[F.count_if(F.col(c).isNull()).alias(f"__z{i}") for i, c in enumerate(cols)])
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"__z{i}").alias("null_count"))
                               for i, c in enumerate(cols)]))
    return (agg.select("__n", each.alias("e"))
            .select("e.column_name", F.col("e.null_count").cast("long").alias("null_count"),
                    pct(F.col("e.null_count"), F.col("__n"), scale).alias("null_pct")))


def audit_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``rows, distinct_keys, duplicate_count`` (a two-phase aggregate on the
    key; a hot key collapses map-side). Rows with a NULL key part are not
    counted as distinct keys, like ``COUNT(DISTINCT)``."""
    keyed = df.select(*keys).withColumn("__has_key", F.lit(True))
    for k in keys:
        keyed = keyed.withColumn("__has_key", F.col("__has_key") & F.col(k).isNotNull())
    per_key = keyed.groupBy(*keys, "__has_key").agg(F.count(F.lit(1)).alias("__n"))
    return per_key.agg(F.sum("__n").alias("rows"),
                       F.count_if(F.col("__has_key")).alias("distinct_keys")) \
        .select(F.coalesce(F.col("rows"), F.lit(0)).cast("long").alias("rows"),
                F.col("distinct_keys").cast("long"),
                (F.coalesce(F.col("rows"), F.lit(0)) - F.col("distinct_keys")).cast("long")
                .alias("duplicate_count"))


def duplicate_count(df: DataFrame, key: Column) -> DataFrame:
    """``COUNT(*) - COUNT(DISTINCT key)`` as one row, column ``duplicate_count``."""
    per_key = df.groupBy(key.alias("__k")).agg(F.count(F.lit(1)).alias("__n"))
    return per_key.agg((F.coalesce(F.sum("__n"), F.lit(0)) - F.count("__k")).cast("long")
                       .alias("duplicate_count"))


def audit_foreign_key(child: DataFrame, child_col: str, parent: DataFrame, parent_col: str) -> DataFrame:
    """D3: child rows whose non-NULL key has no parent (``left_anti`` join)."""
    keys = parent.select(F.col(parent_col).alias("__pk")).distinct()
    return (child.where(F.col(child_col).isNotNull())
            .join(keys, F.col(child_col) == F.col("__pk"), "left_anti"))


def audit_rules(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """``rule, violations, total_rows`` - rows where a rule predicate is
    TRUE count as violations (write predicates for the bad case)."""
    agg = df.agg(F.count(F.lit(1)).alias("__n"),
                 *[F.count_if(pred).alias(f"__r{i}") for i, pred in enumerate(rules.values())])
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.col(f"__r{i}").alias("violations"))
                               for i, name in enumerate(rules)]))
    return agg.select(each.alias("e"), F.col("__n").alias("total_rows")).select("e.rule", "e.violations", "total_rows")


def audit_bounds(df: DataFrame, bounds: Mapping[str, tuple[Column, float]]) -> DataFrame:
    """D4 with the worst value: ``rule, violations, total_rows, bound, worst`` for
    rules given as (measure, bound), all in one pass.

    A row breaks a rule when its measure is above the bound; a NULL measure
    passes. ``worst`` is the largest measure met (NULL without any), so a rule
    that holds shows how near the data come to it."""
    agg = df.agg(F.count(F.lit(1)).alias("__n"), *[c for i, (measure, bound) in enumerate(bounds.values()) for c in (
        F.count_if(measure > F.lit(bound)).alias(f"__r{i}"), F.max(measure).cast("double").alias(f"__w{i}"))])
    each = F.explode(F.array(*[F.struct(
        F.lit(rule).alias("rule"), F.col(f"__r{i}").alias("violations"), F.col("__n").alias("total_rows"),
        F.lit(bound).cast("double").alias("bound"), F.col(f"__w{i}").alias("worst"))
        for i, (rule, (_, bound)) in enumerate(bounds.items())]))
    return agg.select(each.alias("e")).select("e.*")


def key_text(cols: Sequence[str]) -> Column:
    """The values of ``cols`` as one text, different for different values: parts
    joined by ``|``, with ``\\`` and ``|`` inside a part escaped, NULL as ``\\N``."""
    def part(c: str) -> Column:
        x = F.replace(F.col(c).cast("string"), F.lit("\\"), F.lit("\\\\"))
        return F.coalesce(F.replace(x, F.lit("|"), F.lit("\\|")), F.lit("\\N"))
    return F.concat_ws("|", *[part(c) for c in cols])


def broken_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """D2 as rows: ``row_key, n_rows`` of each key that several rows share or that
    has a NULL part. The rows fold to keys on the map side."""
    null = F.lit(False)
    for k in keys:
        null = null | F.col(k).isNull()
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
    return per_key.where((F.col("n_rows") > 1) | null).select(key_text(keys).alias("row_key"), "n_rows")


def orphan_keys(child: DataFrame, child_col: str, parent: DataFrame, parent_col: str) -> DataFrame:
    """D3 as rows: ``row_key, n_rows`` of each child key without a parent. The child
    folds to its keys before the anti join, so a hot key meets the parent once."""
    per_key = child.groupBy(child_col).agg(F.count(F.lit(1)).alias("n_rows"))
    return (audit_foreign_key(per_key, child_col, parent, parent_col)
            .select(key_text([child_col]).alias("row_key"), "n_rows"))


def broken_bounds(df: DataFrame, keys: Sequence[str], bounds: Mapping[str, tuple[Column, float]]) -> DataFrame:
    """D4 as rows: ``rule, row_key, n_rows, worst`` per rule and key of the rows that
    break it. One pass: a row yields only the rules it breaks."""
    hits = F.filter(F.array(*[F.struct(F.lit(rule).alias("rule"), (measure > F.lit(bound)).alias("broken"),
                                       measure.cast("double").alias("measure"))
                              for rule, (measure, bound) in bounds.items()]), lambda e: F.coalesce(e["broken"], F.lit(False)))
    return (df.select(key_text(keys).alias("row_key"), F.explode(hits).alias("e"))
            .groupBy(F.col("e.rule").alias("rule"), "row_key")
            .agg(F.count(F.lit(1)).alias("n_rows"), F.max("e.measure").alias("worst")))


def top_violations(found: DataFrame, by: Sequence[str], n: int) -> DataFrame:
    """The ``n`` keys with most rows per group of ``by`` (ties: smallest key first)
    and their ``place``. Spark limits each task to its first ``n`` rows of a group
    before the shuffle, so a rule that every row breaks stays small."""
    w = Window.partitionBy(*by).orderBy(F.col("n_rows").desc(), F.col("row_key"))
    return found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def coverage(base: DataFrame, satellites: Mapping[str, DataFrame], key: str) -> DataFrame:
    """Distinct base keys and how many also occur in each satellite.

    One shuffle in total: every table contributes ``(key, tag)`` rows, one
    ``groupBy(key)`` folds the tags with ``max`` (duplicates collapse
    map-side), then a single global aggregate counts. No base x satellite
    fan-out as in the literal left-join chain.
    Output: ``total``, ``with_<name>`` per satellite, ``with_all``.
    """
    names = list(satellites)
    flags = ["__base"] + [f"__s{i}" for i in range(len(names))]

    def tagged(df: DataFrame, idx: int) -> DataFrame:
        return df.select(F.col(key).alias("__key"),
                         *[F.lit(i == idx).alias(f) for i, f in enumerate(flags)])

    u = tagged(base, 0)
    for i, name in enumerate(names):
        u = u.unionByName(tagged(satellites[name], i + 1))
    per_key = (u.where(F.col("__key").isNotNull()).groupBy("__key")
               .agg(*[F.max(f).alias(f) for f in flags])
               .where(F.col("__base")))
    all_sat = F.lit(True)
    for f in flags[1:]:
        all_sat = all_sat & F.col(f)
    return per_key.agg(F.count(F.lit(1)).alias("total"),
                       *[F.count_if(F.col(f)).alias(f"with_{n}") for f, n in zip(flags[1:], names)],
                       F.count_if(all_sat).alias("with_all"))


def reconcile(left: DataFrame, right: DataFrame, key: str, left_amount: Column,
              right_amount: Column, tolerance_cents: int = 1) -> DataFrame:
    """Compare per-key totals of two sources (amounts as decimal money).

    Both sides are pre-aggregated by ``key`` - each aggregate is already hash
    partitioned on the key, so the inner join adds no shuffle. Per key the
    totals are ``round(sum, 2)``; a key mismatches when |difference| exceeds
    the tolerance. Output (one row, cents as decimal(38,0)):
    ``compared, mismatched, sum_abs_cents, net_cents, max_abs_cents``.
    """
    lt = left.groupBy(key).agg(F.sum(left_amount).alias("__l"))
    rt = right.groupBy(key).agg(F.sum(right_amount).alias("__r"))
    diff = (F.col("__l") - F.col("__r")) * 100
    j = lt.join(rt, key).select(diff.cast(BIG).alias("__d"))
    return j.agg(F.count(F.lit(1)).alias("compared"),
                 F.count_if(F.abs(F.col("__d")) > tolerance_cents).alias("mismatched"),
                 F.sum(F.abs(F.col("__d"))).alias("sum_abs_cents"),
                 F.count(F.col("__d")).alias("n_diff"),
                 F.sum(F.col("__d")).alias("net_cents"),
                 F.max(F.abs(F.col("__d"))).alias("max_abs_cents"))


__all__ = ["row_count_report", "audit_nulls", "audit_unique", "duplicate_count",
           "audit_foreign_key", "audit_rules", "audit_bounds", "key_text", "broken_keys", "orphan_keys",
           "broken_bounds", "top_violations", "coverage", "reconcile"]
