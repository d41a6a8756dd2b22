"""Exact arithmetic helpers (semantics S3/S4 of the survey).

Money and durations are handled in integer units (cents, microseconds) and
rounded with integer division, so results are the same on every engine and
never depend on how a double happens to sit at a .5 boundary. Rounding is half
away from zero, as SQL ``round(numeric, n)`` does.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BIG = "decimal(38,0)"
US_PER_DAY = 86_400_000_000


def lit_or_col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def big(x) -> Column:
    return lit_or_col(x).cast(BIG)


def idiv(a, b) -> Column:
    """SQL ``a div b``: exact integral division, truncating toward zero."""
    return F.call_function("div", big(a), big(b))


def cents(money) -> Column:
    """A decimal(·,2) amount as whole cents (exact, BIGINT: rows and partial sums
    stay in machine words; ratios are taken in decimal(38,0))."""
    return (lit_or_col(money) * 100).cast("bigint")


def round_div(num, den, scale: int = 2) -> Column:
    """``round(num / den, scale)`` half away from zero, returned as DOUBLE.

    ``num`` and ``den`` must be integral; a zero or NULL denominator gives
    NULL (the ``NULLIF(den, 0)`` idiom of the reports).
    """
    n = big(num)
    d = F.nullif(big(den), F.lit(0).cast(BIG))
    p = 10 ** scale
    q = idiv(F.abs(n) * (2 * p) + d, d * 2)
    signed = F.when(n < 0, -q).otherwise(q)
    return signed.cast("double") / F.lit(float(p))


def total(col) -> Column:
    """``SUM`` in decimal(38,0). Spans in microseconds pass the range of BIGINT within
    some million rows, where a sum of BIGINT fails."""
    return F.sum(big(F.col(col) if isinstance(col, str) else col))


def days_avg(sum_us, n, scale: int = 1) -> Column:
    """The mean span in days from a sum of microseconds and a count (``n`` times a
    day's microseconds passes BIGINT too)."""
    return round_div(sum_us, big(n) * US_PER_DAY, scale)


def pct(part, whole, scale: int = 2) -> Column:
    """``round(part * 100.0 / NULLIF(whole, 0), scale)`` for integral inputs."""
    return round_div(big(part) * 100, whole, scale)
