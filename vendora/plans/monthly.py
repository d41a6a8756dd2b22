"""Monthly reports from folds that are refreshed month by month.

``refresh`` keeps three folds: sales and delivery with one row per month, and the
persons active in a month. Late or corrected rows change the folds of the months of
their orders, nothing else, so only these months of the orders table are read again.
Item lines have no month of their own: they are read, and cut to the orders of the
changed months before they fold. Who is new in a month depends on all months before
it; that step reads the fold of persons, never the facts.
"""

from __future__ import annotations

import datetime as dt
import uuid
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DecimalType, DoubleType, LongType, StringType, StructField, StructType

from vendora.functions.calendar import month_start
from vendora.operators.customer import new_vs_returning, person_orders
from vendora.operators.refresh import in_periods, read_periods, write_periods
from vendora.oracle import DAY_US, FOLDS, MONTH, PCT, RD, with_tables
from vendora.plans.common import report
from vendora.plans.delivery import D_SQL, ONTIME_SQL, _FILTER_SQL, delivery_by_month, delivery_trend
from vendora.plans.revenue import sales_by_month, sales_trend
from vendora.session import shared_path
from vendora.sources.catalog import Tables

MONTH_COL, TS, PERSON = "order_month", "order_purchase_timestamp", "customer_unique_id"


def _schema(**fields) -> StructType:
    return StructType([StructField(MONTH_COL, DateType()), *[StructField(n, k) for n, k in fields.items()]])


SCHEMAS = {
    "sales": _schema(total_orders=LongType(), rev_c=DecimalType(38, 0)),
    "delivery": _schema(total_orders=LongType(), on_time_orders=LongType(), on_time_rate_pct=DoubleType(), us=DecimalType(38, 0), n_us=LongType()),
    "active": _schema(customer_unique_id=StringType()),
}


def _folds(t: Tables) -> dict[str, DataFrame]:
    return {"sales": sales_by_month(t), "delivery": delivery_by_month(t),
            "active": person_orders(t.customers, t.orders).select(PERSON, month_start(TS).alias(MONTH_COL)).distinct()}


def changed_months(t: Tables, late: dict[str, DataFrame], before: DataFrame | None = None) -> list[dt.date | None]:
    """Months whose folds the ``late`` rows change: those of late or corrected
    ``orders``, and of the orders that late ``order_items`` and ``customers`` belong
    to. ``before`` holds corrected orders as they were, for those that left a month.
    As many values as the calendar has months come to the driver."""
    frames = [late["orders"]] if "orders" in late else []
    frames += [t.orders.join(late[name].select(key), key, "left_semi")
               for name, key in (("order_items", "order_id"), ("customers", "customer_id")) if name in late]
    frames += [before] if before is not None else []
    if not frames:
        return []
    months = [f.select(month_start(TS).cast("date").alias(MONTH_COL)).distinct() for f in frames]
    return [r[0] for r in reduce(DataFrame.union, months).distinct().collect()]


def refresh(t: Tables, root: str, late: dict[str, DataFrame] | None = None,
            before: DataFrame | None = None) -> list[dt.date | None] | None:
    """Bring the folds under ``root`` up to the tables ``t``: all of them, or with
    ``late`` (rows that came or were corrected since, by table name, all of them in
    ``t`` too) only the months they change. Returns these months (None: all)."""
    months = None
    if late is not None:
        months = changed_months(t, late, before)
        if not months:
            return months
        orders = t.orders.where(in_periods(F.col(TS), months))
        t = replace(t, orders=orders, items=t.items.join(orders.select("order_id"), "order_id", "left_semi"))
    for name, fold in _folds(t).items():
        typed = fold.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in SCHEMAS[name].fields])
        write_periods(typed, f"{root.rstrip('/')}/{name}", MONTH_COL, months)
    return months


def monthly_reports(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """R5, L11 and C10 from the folds under ``root``, equal to the reports over the tables."""
    at = F.col(MONTH_COL).cast("timestamp_ntz")
    folds = {name: read_periods(spark, f"{root.rstrip('/')}/{name}", schema).withColumn(MONTH_COL, at)
             for name, schema in SCHEMAS.items()}
    return {"revenue_monthly_trend": sales_trend(folds["sales"]), "delivery_monthly_trend": delivery_trend(folds["delivery"]),
            "customer_new_vs_returning": new_vs_returning(folds["active"], ts=MONTH_COL).orderBy(F.col(MONTH_COL).asc_nulls_last())}


@report("monthly_refresh", with_tables(FOLDS + f"""
, per_month AS (SELECT {MONTH('order_purchase_timestamp')} AS m, count(*) AS k, sum(rev_c) AS c FROM sold
                WHERE order_purchase_timestamp IS NOT NULL GROUP BY 1),
numbered AS (SELECT *, row_number() OVER (ORDER BY m) AS i FROM per_month),
back AS (SELECT n.m, sum(x.c) AS c3, count(x.c) AS k3 FROM numbered n JOIN numbered x ON x.i BETWEEN n.i - 2 AND n.i GROUP BY n.m),
sales AS (SELECT n.m AS order_month, n.k AS sold_orders, {RD('n.c', '100')} AS monthly_revenue, {PCT('n.c - b.c', 'b.c')} AS mom_growth_pct,
            {RD('c3', '100 * k3')} AS rolling_3m_avg FROM numbered n LEFT JOIN numbered b ON b.i = n.i - 1 JOIN back ON back.m = n.m),
dated AS (SELECT {MONTH('o.order_purchase_timestamp')} AS order_month, count(*) AS dated_orders, {PCT(f'count(*) FILTER (WHERE {ONTIME_SQL})', 'count(*)')} AS on_time_rate_pct,
            {RD(f'sum({D_SQL})', f'count({D_SQL}) * {DAY_US}', 1)} AS avg_delivery_days
          FROM orders_m o WHERE {_FILTER_SQL} AND o.order_purchase_timestamp IS NOT NULL GROUP BY 1),
active AS (SELECT DISTINCT person, {MONTH('bought_at')} AS m FROM buyer WHERE person IS NOT NULL),
since AS (SELECT m, m = min(m) OVER (PARTITION BY person) AS fresh FROM active),
persons AS (SELECT m AS order_month, count(*) FILTER (WHERE fresh) AS new_customers, count(*) FILTER (WHERE NOT fresh) AS returning_customers FROM since GROUP BY m)
SELECT order_month, max(sold_orders) AS sold_orders, max(monthly_revenue) AS monthly_revenue, max(mom_growth_pct) AS mom_growth_pct,
  max(rolling_3m_avg) AS rolling_3m_avg, max(dated_orders) AS dated_orders, max(on_time_rate_pct) AS on_time_rate_pct,
  max(avg_delivery_days) AS avg_delivery_days, max(new_customers) AS new_customers, max(returning_customers) AS returning_customers
FROM (FROM sales UNION ALL BY NAME FROM dated UNION ALL BY NAME FROM persons) GROUP BY order_month"""))
def monthly_refresh(t: Tables):
    """The folds as they stood when the last month began, refreshed with the orders
    placed or delivered since; the three reports side by side, one row per month."""
    cut = t.orders.agg(month_start(F.max(TS)).cast("string")).first()[0]
    since = F.lit(cut).cast("timestamp_ntz")
    late = F.coalesce(F.greatest(TS, "order_delivered_customer_date") >= since, F.lit(False))
    root = shared_path(t.spark, f"monthly-{uuid.uuid4().hex}")
    refresh(replace(t, orders=t.orders.where(~late)), root)
    refresh(t, root, {"orders": t.orders.where(late)})
    got = monthly_reports(t.spark, root)
    parts = [got["revenue_monthly_trend"].select(MONTH_COL, F.col("total_orders").alias("sold_orders"), "monthly_revenue", "mom_growth_pct", "rolling_3m_avg"),
             got["delivery_monthly_trend"].select(MONTH_COL, F.col("total_orders").alias("dated_orders"), "on_time_rate_pct", "avg_delivery_days"),
             got["customer_new_vs_returning"].select(MONTH_COL, "new_customers", "returning_customers")]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return rows.groupBy(MONTH_COL).agg(*[F.max(c).alias(c) for c in rows.columns if c != MONTH_COL])
