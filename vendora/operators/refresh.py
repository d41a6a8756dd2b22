"""Folds kept per period, recomputed only where rows came late.

A fold is a frame with a period column, stored as one Parquet partition per
period. A refresh overwrites the partitions of the named periods and leaves the
others alone, so it is repeatable: after a lost driver the same call ends in the
same store. Each refreshed period also gets a marker row, as a period that lost its
last row would otherwise keep its old partition.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

THERE = "__there"


def period_end(start: dt.date, unit: str = "month") -> dt.date:
    """The first day after the period of ``unit`` that starts at ``start``."""
    if unit == "week":
        return start + dt.timedelta(days=7)
    years, month = divmod(start.month - 1 + {"month": 1, "quarter": 3, "year": 12}[unit], 12)
    return dt.date(start.year + years, month + 1, 1)


def in_periods(ts: Column, periods: Sequence[dt.date | None], unit: str = "month") -> Column:
    """Rows whose zone-less ``ts`` lies in one of the periods (given by their
    starts; None: rows without ``ts``). Neighbouring periods become one range of
    plain comparisons, which reach the Parquet scan."""
    runs: list[list[dt.date]] = []
    for start in sorted({p for p in periods if p is not None}):
        if runs and runs[-1][1] == start:
            runs[-1][1] = period_end(start, unit)
        else:
            runs.append([start, period_end(start, unit)])
    at = [[F.lit(str(d)).cast("timestamp_ntz") for d in run] for run in runs]
    parts = [(ts >= lo) & (ts < hi) for lo, hi in at] + ([ts.isNull()] if None in periods else [])
    return reduce(Column.__or__, parts, F.lit(False))


def write_periods(fold: DataFrame, path: str, period_col: str, periods: Sequence[dt.date | None] | None = None) -> None:
    """Store ``fold`` (``period_col`` a DATE) under ``path``: the whole store anew, or
    with ``periods`` only these partitions, which then hold what ``fold`` holds.
    Rows of other periods must not be in ``fold``. A large period is written by
    many tasks."""
    rows = fold.withColumn(THERE, F.lit(True)).hint("rebalance", period_col)
    if periods is not None:
        marks = fold.sparkSession.createDataFrame([(p, False) for p in periods], f"{period_col} date, {THERE} boolean")
        rows = rows.unionByName(marks, allowMissingColumns=True)
    (rows.write.mode("overwrite").option("partitionOverwriteMode", "static" if periods is None else "dynamic")
     .partitionBy(period_col).parquet(path))


def read_periods(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The stored fold, without marker rows."""
    stored = StructType([*schema.fields, StructField(THERE, BooleanType())])
    return spark.read.schema(stored).parquet(path).where(F.col(THERE)).select(*schema.fieldNames())
