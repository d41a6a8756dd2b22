"""Constraint audits: keys, references and row rules that Spark does not enforce.

The other reports count orders, customers and sellers by rows where the declared
keys allow it; these three reports tell whether they hold. ``quality_keys`` guards
every count by key, ``quality_foreign_keys`` the inner joins (orphans leave them),
``quality_rules`` the NOT NULL and CHECK constraints and the declared lengths and
precisions; ``quality_violations`` lists the rows behind them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from vendora.operators.audit import (audit_bounds, audit_foreign_key, audit_unique, broken_bounds, broken_keys, orphan_keys,
                                     top_violations)
from vendora.oracle import with_tables
from vendora.plans.common import report
from vendora.sources.catalog import Tables
from vendora.sources.schemas import FOREIGN_KEYS, LENGTHS, NOT_NULL, PRIMARY_KEYS, RANGES, TABLES

LISTED = 10  # row keys that ``quality_violations`` lists per constraint


def _view(table: str) -> str:
    return "orders_m" if table == "orders" else table


def _keys_sql() -> str:
    parts = []
    for table, keys in PRIMARY_KEYS.items():
        whole = " AND ".join(f"{k} IS NOT NULL" for k in keys)
        parts.append(f"SELECT '{table}' AS table_name, '{', '.join(keys)}' AS key_columns, count(*) AS row_count, "
                     f"(SELECT count(*) FROM (SELECT DISTINCT {', '.join(keys)} FROM {_view(table)} WHERE {whole})) AS distinct_keys "
                     f"FROM {_view(table)}")
    return ("SELECT *, row_count - distinct_keys AS duplicate_count FROM (" + " UNION ALL ".join(parts) + ") ORDER BY table_name")


@report("quality_keys", with_tables(_keys_sql()))
def quality_keys(t: Tables) -> DataFrame:
    """Rows, distinct keys and surplus rows of each table with a declared key."""
    frames = t.as_dict()
    parts = [audit_unique(frames[table], keys).select(
        F.lit(table).alias("table_name"), F.lit(", ".join(keys)).alias("key_columns"),
        F.col("rows").alias("row_count"), "distinct_keys", "duplicate_count") for table, keys in PRIMARY_KEYS.items()]
    return reduce(DataFrame.unionByName, parts).orderBy("table_name")


@report("quality_foreign_keys", with_tables(" UNION ALL ".join(
    f"SELECT '{c}' AS child_table, '{cc}' AS child_column, '{p}' AS parent_table, "
    f"count(*) AS orphan_rows, count(DISTINCT {cc}) AS orphan_keys FROM {_view(c)} "
    f"WHERE {cc} IS NOT NULL AND {cc} NOT IN (SELECT {pc} FROM {_view(p)} WHERE {pc} IS NOT NULL)"
    for c, cc, p, pc in FOREIGN_KEYS)))
def quality_foreign_keys(t: Tables) -> DataFrame:
    """Child rows and keys without a parent, per declared reference."""
    frames = t.as_dict()
    parts = []
    for child, column, parent, key in FOREIGN_KEYS:
        orphans = audit_foreign_key(frames[child].select(column), column, frames[parent], key)
        per_key = orphans.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
        parts.append(per_key.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("orphan_rows"), F.count(column).alias("orphan_keys"))
                     .select(F.lit(child).alias("child_table"), F.lit(column).alias("child_column"),
                             F.lit(parent).alias("parent_table"), "orphan_rows", "orphan_keys"))
    return reduce(DataFrame.unionByName, parts)


def _measures(table: str) -> list[tuple[str, str, float]]:
    """(rule, measure, bound) of the declared row constraints of ``table``.

    The measure is an SQL expression that both engines read alike; a row breaks
    the rule when it is above the bound. Trailing spaces do not count towards a
    declared length, as the declared types cut them."""
    out = [(f"{c} is not null", f"CASE WHEN {c} IS NULL THEN 1 ELSE 0 END", 0) for c in NOT_NULL.get(table, [])]
    out += [(f"{c} between {lo} and {hi}", f"CASE WHEN {c} < {lo} THEN {lo} - {c} WHEN {c} > {hi} THEN {c} - {hi} WHEN {c} IS NOT NULL THEN 0 END", 0)
            for c, (lo, hi) in RANGES.get(table, {}).items()]
    out += [(f"length of {c} <= {n}", f"length(rtrim({c}))", n) for c, n in LENGTHS.get(table, {}).items()]
    out += [(f"{f.name} fits decimal({f.dataType.precision}, {f.dataType.scale})", f"round(abs({f.name}), {f.dataType.scale})",
             float(10 ** (f.dataType.precision - f.dataType.scale)) - 10.0 ** -f.dataType.scale)
            for f in TABLES[table].fields if isinstance(f.dataType, DecimalType)]
    return out


def _bounds(table: str) -> dict:
    return {rule: (F.expr(measure), bound) for rule, measure, bound in _measures(table)}


def _row_key(table: str) -> list[str]:
    """The columns that name a row: its key, or all columns of a table without one."""
    return PRIMARY_KEYS.get(table, TABLES[table].fieldNames())


@report("quality_rules", with_tables(" UNION ALL ".join(
    f"SELECT '{table}' AS table_name, '{rule}' AS rule, count(*) FILTER (WHERE {measure} > {bound}) AS violations, "
    f"count(*) AS total_rows, CAST({bound} AS DOUBLE) AS bound, CAST(max({measure}) AS DOUBLE) AS worst FROM {_view(table)}"
    for table in TABLES for rule, measure, bound in _measures(table))))
def quality_rules(t: Tables) -> DataFrame:
    """Rows that break a declared NOT NULL, CHECK, length or precision rule, with the
    largest value measured (a NULL passes all but NOT NULL). One read per table."""
    frames = t.as_dict()
    parts = [audit_bounds(frames[table], _bounds(table)).select(F.lit(table).alias("table_name"), "*")
             for table in TABLES if _measures(table)]
    return reduce(DataFrame.unionByName, parts)


def _key_sql(cols: list[str]) -> str:
    parts = [f"coalesce(replace(replace(CAST({c} AS VARCHAR), '\\', '\\\\'), '|', '\\|'), '\\N')" for c in cols]
    return f"concat_ws('|', {', '.join(parts)})"


def _violations_sql() -> str:
    parts = []
    for table, keys in PRIMARY_KEYS.items():
        null = " OR ".join(f"{k} IS NULL" for k in keys)
        parts.append(f"SELECT '{table}' AS table_name, 'key ({', '.join(keys)})' AS rule, {_key_sql(keys)} AS row_key, count(*) AS n_rows, "
                     f"CAST(NULL AS DOUBLE) AS worst FROM {_view(table)} GROUP BY {', '.join(keys)} HAVING count(*) > 1 OR {null}")
    for c, cc, p, pc in FOREIGN_KEYS:
        parts.append(f"SELECT '{c}', '{cc} in {p}', {_key_sql([cc])}, count(*), CAST(NULL AS DOUBLE) FROM {_view(c)} "
                     f"WHERE {cc} IS NOT NULL AND {cc} NOT IN (SELECT {pc} FROM {_view(p)} WHERE {pc} IS NOT NULL) GROUP BY {cc}")
    for table in TABLES:
        for rule, measure, bound in _measures(table):
            key = _key_sql(_row_key(table))
            parts.append(f"SELECT '{table}', '{rule}', {key}, count(*), CAST(max({measure}) AS DOUBLE) FROM {_view(table)} "
                         f"WHERE {measure} > {bound} GROUP BY {key}")
    return (f"SELECT *, row_number() OVER (PARTITION BY table_name, rule ORDER BY n_rows DESC, row_key) AS place "
            f"FROM ({' UNION ALL '.join(parts)}) QUALIFY place <= {LISTED} ORDER BY table_name, rule, place")


@report("quality_violations", with_tables(_violations_sql()))
def quality_violations(t: Tables) -> DataFrame:
    """The keys behind the counts of the other audits: per broken key, reference or
    rule the ``LISTED`` row keys with most rows, with ``worst`` for the rules. Each
    constraint reads only its own columns of a table."""
    frames = t.as_dict()
    none = F.lit(None).cast("double").alias("worst")

    def named(df: DataFrame, table: str, rule: Column) -> DataFrame:
        return df.select(F.lit(table).alias("table_name"), rule.alias("rule"), "row_key", "n_rows", "worst")
    parts = [named(broken_keys(frames[table], keys).withColumn("worst", none), table, F.lit(f"key ({', '.join(keys)})"))
             for table, keys in PRIMARY_KEYS.items()]
    parts += [named(orphan_keys(frames[c], cc, frames[p], pc).withColumn("worst", none), c, F.lit(f"{cc} in {p}"))
              for c, cc, p, pc in FOREIGN_KEYS]
    parts += [named(broken_bounds(frames[table], _row_key(table), _bounds(table)), table, F.col("rule"))
              for table in TABLES if _measures(table)]
    return top_violations(reduce(DataFrame.unionByName, parts), ["table_name", "rule"], LISTED).orderBy("table_name", "rule", "place")
