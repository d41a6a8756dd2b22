"""Registry of named reports and the frames several reports share.

Reports rely on the declared primary keys (orders.order_id,
customers.customer_id, products.product_id, sellers.seller_id, the
translation's category name), as the reference database enforces them; the
``quality_*`` reports audit them. With unique order ids, a frame at order
grain counts orders with ``count`` instead of ``COUNT(DISTINCT)``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vendora.functions.exact import BIG, cents, idiv, round_div
from vendora.sources.catalog import Tables

Report = Callable[[Tables], DataFrame]
REGISTRY: dict[str, Report] = {}
ORACLE: dict[str, str] = {}

DELIVERED = "delivered"


def report(key: str, oracle: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``key`` with its oracle SQL."""
    def deco(fn: Report) -> Report:
        REGISTRY[key] = fn
        if oracle is not None:
            ORACLE[key] = oracle
        return fn
    return deco


def delivered(t: Tables, *cols: str) -> DataFrame:
    """Orders with status 'delivered' (S2), optionally projected."""
    o = t.orders.where(F.col("order_status") == DELIVERED)
    return o.select(*cols) if cols else o


def item_value_c() -> F.Column:
    """Item revenue ``price + freight_value`` in cents; NULL if either is."""
    return cents(F.col("price") + F.col("freight_value"))


def items_per_order(t: Tables) -> DataFrame:
    """Item lines folded to order grain before any join (map-side partial sums).

    ``rev_c``: sum of item values (cents), ``n_val``: items with a value,
    ``price_c`` / ``n_price`` / ``freight_c`` / ``n_freight``: the same for
    the two parts, ``n_items``: ``COUNT(order_item_id)``, ``n_rows``: rows.
    """
    return t.items.groupBy("order_id").agg(
        F.sum(item_value_c()).alias("rev_c"),
        F.count(item_value_c()).alias("n_val"),
        F.sum(cents(F.col("price"))).alias("price_c"),
        F.count("price").alias("n_price"),
        F.sum(cents(F.col("freight_value"))).alias("freight_c"),
        F.count("freight_value").alias("n_freight"),
        F.count("order_item_id").alias("n_items"),
        F.count(F.lit(1)).alias("n_rows"))


def review_stats(t: Tables) -> DataFrame:
    """Reviews folded to order grain, to reproduce ``LEFT JOIN order_reviews``
    fan-out without multiplying rows (S13): a row joined to k reviews counts
    k times (``mult``), once with NULL scores when there is none."""
    s = F.col("review_score")
    return t.reviews.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("r_rows"),
        F.sum(s).alias("r_sum"), F.count(s).alias("r_cnt"),
        F.count_if(s == 1).alias("r_1"), F.count_if(s == 5).alias("r_5"),
        F.count_if(s <= 2).alias("r_le2"), F.count_if(s >= 4).alias("r_ge4"))


def with_reviews(df: DataFrame, t: Tables) -> DataFrame:
    """Left join of per-order review stats; adds ``mult`` and zero-filled stats."""
    j = df.join(review_stats(t), "order_id", "left")
    return (j.withColumn("mult", F.coalesce(F.col("r_rows"), F.lit(1)).cast("long"))
            .fillna(0, subset=["r_sum", "r_cnt", "r_1", "r_5", "r_le2", "r_ge4"]))


def money_c(c) -> F.Column:
    """Cents (exact) as a DOUBLE money amount."""
    return round_div(c, 100, 2)


def avg_money(sum_c, n, scale: int = 2) -> F.Column:
    """``ROUND(AVG(money), scale)`` from a cents sum and a count."""
    return round_div(sum_c, F.col(n) * 100 if isinstance(n, str) else n * 100, scale)


def scaled_round(num, den, scale: int = 2) -> F.Column:
    """``round(num/den, scale) * 10^scale`` as an exact integer (decimal(38,0))."""
    n = num.cast(BIG)
    d = F.nullif(den.cast(BIG), F.lit(0).cast(BIG))
    p = 10 ** scale
    q = idiv(F.abs(n) * (2 * p) + d, d * 2)
    return F.when(n < 0, -q).otherwise(q).cast(BIG)
