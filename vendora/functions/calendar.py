"""Time and calendar expressions (semantics S7-S11, operator P15).

All timestamps are zone-less (TIMESTAMP_NTZ), so nothing here depends on the
session time zone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vendora.functions.exact import US_PER_DAY, idiv, round_div


def elapsed_us(t0, t1) -> Column:
    """``t1 - t0`` in whole microseconds, exact on zone-less timestamps.

    Replaces ``EXTRACT(EPOCH FROM t1 - t0)`` (seconds) scaled by 10^6.
    """
    return F.timestamp_diff("MICROSECOND", _col(t0), _col(t1)).cast("bigint")


def elapsed_days(t0, t1, scale: int = 1) -> Column:
    """``round(EXTRACT(EPOCH FROM t1 - t0) / 86400, scale)`` for one row."""
    return round_div(elapsed_us(t0, t1), US_PER_DAY, scale)


def whole_days_elapsed(t0, t1) -> Column:
    """``EXTRACT(DAY FROM t1 - t0)``: completed 24-hour blocks."""
    return idiv(elapsed_us(t0, t1), US_PER_DAY).cast("int")


def calendar_days_between(t0, t1) -> Column:
    """``t1::date - t0::date``: calendar days."""
    return F.datediff(F.to_date(_col(t1)), F.to_date(_col(t0)))


def period_start(ts, unit: str = "month") -> Column:
    """``DATE_TRUNC(unit, ts)`` for week, month, quarter or year, zone-less."""
    return F.trunc(F.to_date(_col(ts)), unit).cast("timestamp_ntz")


def month_start(ts) -> Column:
    """``DATE_TRUNC('month', ts)`` kept zone-less."""
    return period_start(ts, "month")


def dow_sunday0(ts) -> Column:
    """``EXTRACT(DOW FROM ts)``: Sunday = 0."""
    return (F.dayofweek(_col(ts)) - 1).cast("int")


def day_name_padded(ts) -> Column:
    """``TO_CHAR(ts, 'Day')``: English day name blank-padded to 9."""
    return F.rpad(F.date_format(_col(ts), "EEEE"), 9, " ")


def month_year_label(ts) -> Column:
    """``TO_CHAR(ts, 'Month YYYY')``: padded month name, space, year."""
    return F.concat(F.rpad(F.date_format(_col(ts), "MMMM"), 9, " "), F.lit(" "),
                    F.date_format(_col(ts), "yyyy"))


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x
