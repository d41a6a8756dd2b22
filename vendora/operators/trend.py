"""Period trends (operator P5): lag and rolling frames over one row per period."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vendora.functions.calendar import period_start
from vendora.operators.ranking import whole


# One period further, per unit of ``period_start``.
STEPS = {"week": "7 days", "month": "1 month", "quarter": "3 months", "year": "1 year"}


def densify(periods: DataFrame, period_col: str, unit: str, fill: dict[str, object] | None = None,
            keys: Sequence[str] = ()) -> DataFrame:
    """``periods`` (one row per ``keys`` and period start) with a row for every
    calendar ``unit`` between the first and the last period of all rows, for every
    key; the columns of added rows are NULL or as ``fill`` says. Rows without a
    period stay. The spine is as long as the calendar, times the keys; it meets the
    rows on (keys, period), so no key's periods need one task.
    """
    keys, periods = list(keys), whole(periods)  # span, keys and rows read one fold
    span = (periods.agg(F.min(period_col).alias("__lo"), F.max(period_col).alias("__hi"))
            .select(F.explode(F.sequence("__lo", "__hi", F.expr(f"interval {STEPS[unit]}"))).alias(period_col)))
    if keys:
        span = periods.select(*keys).distinct().crossJoin(F.broadcast(span))  # one row per period
    same = [F.col(f"__s_{c}").eqNullSafe(F.col(c)) for c in [*keys, period_col]]
    values = fill or {}
    added = F.col("__there").isNull()
    # Unmatched rows of both sides stay: spine rows without data, data without a period.
    joined = span.toDF(*[f"__s_{c}" for c in [*keys, period_col]]).join(
        periods.withColumn("__there", F.lit(True)), reduce(Column.__and__, same), "full")
    return joined.select(*[
        F.when(added, F.col(f"__s_{c}")).otherwise(F.col(c)).alias(c) if c in [*keys, period_col]
        else F.when(added, F.lit(values[c])).otherwise(F.col(c)).alias(c) if c in values else F.col(c)
        for c in periods.columns])


def period_trend(periods: DataFrame, period_col: str, value_col: str, lag: int = 1,
                 window: int = 3, prefix: str = "", keys: Sequence[str] = ()) -> DataFrame:
    """Add ``<prefix>prev`` (value ``lag`` rows back), ``<prefix>roll_sum`` and
    ``<prefix>roll_n`` (sum and non-NULL count over the current row and the
    ``window - 1`` rows before it), within ``keys`` if given.

    Frames step by *row*, so a missing period is skipped, not filled (S16);
    ``densify`` fills them before. ``periods`` must hold one row per key and period
    (group first): the window then runs over a calendar-bounded number of rows,
    which is why it may be unpartitioned. Periods sort ascending with NULL last.
    """
    w = Window.partitionBy(*keys).orderBy(F.col(period_col).asc_nulls_last())
    roll = w.rowsBetween(-(window - 1), Window.currentRow)
    return (periods.withColumn(f"{prefix}prev", F.lag(value_col, lag).over(w))
            .withColumn(f"{prefix}roll_sum", F.sum(value_col).over(roll))
            .withColumn(f"{prefix}roll_n", F.count(value_col).over(roll)))


def trend_by(df: DataFrame, ts: str, unit: str, measure: Column, lag: int = 1, window: int = 3,
             out: str = "value", period: str = "period", keys: Sequence[str] = (),
             dense: bool = False, fill: object = None) -> DataFrame:
    """P5 from raw rows: fold ``measure`` (an aggregate column) per ``unit`` of
    ``ts`` (and ``keys``) first, so that the windows see one row per period, then add
    ``prev``, ``roll_sum`` and ``roll_n``. Rows without ``ts`` are left out. With
    ``dense`` periods without rows are there too, with the value ``fill``, so that
    lag and frames step by the calendar."""
    periods = (df.where(F.col(ts).isNotNull()).groupBy(*keys, period_start(ts, unit).alias(period))
               .agg(measure.alias(out)))
    if dense:
        periods = densify(periods, period, unit, None if fill is None else {out: fill}, keys)
    return period_trend(periods, period, out, lag, window, keys=keys)
