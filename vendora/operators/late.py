"""Late-delivery rates (operator P9)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vendora.functions.calendar import elapsed_us
from vendora.functions.exact import days_avg, pct, total


def late(delivered: str = "order_delivered_customer_date",
         estimated: str = "order_estimated_delivery_date") -> Column:
    """Delivered after the estimate; NULL when either date is missing."""
    return F.col(delivered) > F.col(estimated)


def on_time(delivered: str = "order_delivered_customer_date",
            estimated: str = "order_estimated_delivery_date") -> Column:
    return F.col(delivered) <= F.col(estimated)


def late_rate(df: DataFrame, keys: Sequence[str], order_col: str = "order_id",
              sums: Sequence[str] = (), one_row_per_order: bool = False,
              delivered: str = "order_delivered_customer_date",
              estimated: str = "order_estimated_delivery_date") -> DataFrame:
    """Late and on-time orders, their rates and the mean delay per group.

    Frames finer than an order (items, reviews) fold to ``(keys, order)`` first:
    the dates belong to the order, so one flag per pair, and the group counts
    are plain counts without a ``COUNT(DISTINCT)`` expansion. With
    ``one_row_per_order`` that fold, and its shuffle, is left out. ``sums`` are
    extra columns summed through both levels.

    Output: ``keys, total_orders, late_orders, on_time_orders, late_rate_pct,
    on_time_rate_pct, avg_days_late`` (over late orders, one decimal), ``sums``.
    """
    is_late, is_on_time = late(delivered, estimated), on_time(delivered, estimated)
    us = F.when(is_late, elapsed_us(estimated, delivered))
    if one_row_per_order:
        per = df.select("*", F.coalesce(is_late, F.lit(False)).alias("__late"), F.coalesce(is_on_time, F.lit(False)).alias("__on_time"),
                        us.alias("__us"))
    else:
        per = df.groupBy(*keys, order_col).agg(
            F.max(F.coalesce(is_late, F.lit(False))).alias("__late"),
            F.max(F.coalesce(is_on_time, F.lit(False))).alias("__on_time"), F.max(us).alias("__us"),
            *[F.sum(c).alias(c) for c in sums])
    per = per.where(F.col(order_col).isNotNull())
    g = per.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_orders"), F.count_if(F.col("__late")).alias("late_orders"),
        F.count_if(F.col("__on_time")).alias("on_time_orders"), total("__us").alias("__us"), F.count("__us").alias("__n"),
        *[F.sum(c).alias(c) for c in sums])
    return g.select(*keys, "total_orders", "late_orders", "on_time_orders",
                    pct(F.col("late_orders"), F.col("total_orders")).alias("late_rate_pct"),
                    pct(F.col("on_time_orders"), F.col("total_orders")).alias("on_time_rate_pct"),
                    days_avg(F.col("__us"), F.col("__n")).alias("avg_days_late"), *sums)
