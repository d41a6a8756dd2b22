"""Person-level operators: inter-order gaps, RFM and cohorts.

A person (``customer_unique_id``) may own a large share of all orders, so no
operator here sorts all of one person's rows in a single task.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vendora.functions.calendar import calendar_days_between, elapsed_us, period_start, whole_days_elapsed
from vendora.functions.exact import BIG, cents
from vendora.operators.ranking import OVERSAMPLE, chosen_by_hash, cut_levels, every_cut, whole, with_cell

RUN = 1 << 20  # distinct timestamps of one entity that are sorted together


def interarrival_gaps(df: DataFrame, entity: str, ts: str,
                      cells: int | None = None, with_entities: bool = False, run: int = RUN):
    """Gaps between consecutive events of each entity (``LAG`` over ts).

    Output rows ``(entity, gap_us, w)``: ``w`` rows of the literal
    ``ts - LAG(ts)`` result share the value ``gap_us`` (rows with a NULL lag
    are dropped). Tied timestamps give gap 0, whatever their order. NULL
    timestamps sort last (PostgreSQL), so an entity with both NULL and
    non-NULL timestamps has one gap row whose value is NULL.

    Events first collapse to distinct ``(entity, ts)`` with multiplicity. The lag
    runs per entity, and an entity of more than ``run`` rows is cut into runs of
    about that many: its number of runs follows its counted rows, its cuts are
    evenly spaced values of a sample of them by hash, so a burst or a far-off date
    spans as many runs as its rows need. Only rows of such entities look anything
    up. Gaps across runs come from the first and last row of each. ``cells``
    instead of ``run`` gives the largest entity about that many runs.

    With ``with_entities`` the result is ``(gaps, entities)``; ``entities``
    has one row per entity: ``n_ts`` (non-NULL timestamps), ``n_null``.
    """
    # ``whole``: every branch reads the same fold.
    folded = whole(df.where(F.col(entity).isNotNull()).groupBy(entity, ts).agg(F.count(F.lit(1)).alias("__m")))
    share = F.lit(OVERSAMPLE / run)
    sample = folded.where(F.col(ts).isNotNull())
    if cells:
        most = folded.groupBy(entity).agg(F.count("__m").alias("__n")).agg((cells * OVERSAMPLE / F.max("__n")).alias("__share"))
        sample, share = sample.crossJoin(F.broadcast(most)), F.col("__share")
    # One row in ``run / OVERSAMPLE``: entities of fewer rows than a run have too few for a cut.
    cuts = (sample.where(chosen_by_hash(share, F.col(entity), F.col(ts))).withColumnRenamed(entity, "__e")
            .groupBy("__e").agg(every_cut(F.sort_array(F.collect_list(ts))).alias("__s"))
            .where(F.size("__s") > 0).select("__e", *[c.alias(f"__c{i}") for i, c in enumerate(cut_levels(F.col("__s")))]))
    levels = ["__c0", "__c1", "__c2"]
    # At most one cut in about ``run`` rows of all: small, and broadcast so that the rows are dealt by run, not by entity.
    placed = with_cell(folded.join(F.broadcast(cuts), F.col(entity) == F.col("__e"), "left"), ts, levels, "__at")
    # Without cuts an entity is one run; NULL timestamps follow the last cut.
    at = F.when(F.col("__c0").isNull(), F.lit(0)).when(F.col(ts).isNull(), F.size("__c0")).otherwise(F.col("__at"))
    ev = placed.select(entity, ts, "__m", at.cast("long").alias("__cell"), F.col("__c0").isNotNull().alias("__cut"))
    order = F.col(ts).asc_nulls_last()
    w = Window.partitionBy("__cell", entity).orderBy(order)
    place = F.row_number().over(w)
    seen = ev.withColumns({"__pt": F.lag(ts).over(w), "__first": place == 1, "__last": F.lead("__m").over(w).isNull()})

    # Ends of the runs of cut entities, two each: what stands before a first row is the last one of an earlier run.
    across = Window.partitionBy(entity).orderBy("__cell", order)
    ends = seen.where(F.col("__cut") & (F.col("__first") | F.col("__last")))
    ends = ends.withColumns({"__pt": F.lag(ts).over(across), "__n": F.row_number().over(across)}).where(F.col("__first") & (F.col("__n") > 1))
    # Repeated timestamps: m copies give m - 1 zero gaps, beside the one to the row before.
    zero, long = F.lit(0).cast(BIG), F.lit(1).cast("long")
    here = F.array(F.struct(elapsed_us(F.col("__pt"), F.col(ts)).cast(BIG).alias("gap_us"), F.when(F.col("__first"), 0).otherwise(long).alias("w")),
                   F.struct(zero.alias("gap_us"), F.when(F.col(ts).isNotNull(), F.col("__m") - 1).otherwise(0).cast("long").alias("w")))
    gaps = (seen.select(entity, F.explode(here).alias("g")).select(entity, "g.gap_us", "g.w").where("w > 0")
            .unionByName(ends.select(entity, elapsed_us(F.col("__pt"), F.col(ts)).cast(BIG).alias("gap_us"), long.alias("w"))))
    if with_entities:
        known = F.when(F.col(ts).isNotNull(), F.col("__m"))
        entities = folded.groupBy(entity).agg(
            F.coalesce(F.sum(known), F.lit(0)).alias("n_ts"),
            F.coalesce(F.sum(F.when(F.col(ts).isNull(), F.col("__m"))), F.lit(0)).alias("n_null"))
        return gaps, entities
    return gaps


def person_orders(customers: DataFrame, orders: DataFrame, status: str | None = "delivered",
                  cols: tuple[str, ...] = ("order_id", "order_purchase_timestamp")) -> DataFrame:
    """Orders with the person who placed them (``customers`` join ``orders``)."""
    o = orders.where(F.col("order_status") == status) if status else orders
    return (customers.select("customer_id", "customer_unique_id")
            .join(o.select("customer_id", *cols), "customer_id"))


def cohorts(person_ts: DataFrame, entity: str = "customer_unique_id",
            ts: str = "order_purchase_timestamp", unit: str = "month", out: str = "cohort") -> DataFrame:
    """P13 cohort assignment: ``entity, out``, the first period of each entity
    (week, month, quarter or year; a partial aggregate)."""
    return person_ts.groupBy(entity).agg(period_start(F.min(ts), unit).alias(out))


def first_month(person_ts: DataFrame, entity: str = "customer_unique_id",
                ts: str = "order_purchase_timestamp") -> DataFrame:
    """``cohorts`` by month: ``entity, first_month``."""
    return cohorts(person_ts, entity, ts, "month", "first_month")


def new_vs_returning(person_ts: DataFrame, entity: str = "customer_unique_id",
                     ts: str = "order_purchase_timestamp", unit: str = "month", out: str = "order_month") -> DataFrame:
    """P13 activity by period: new (first period), returning, all active persons.

    Works on distinct ``(entity, period)`` pairs, so each person counts once per
    period without a ``COUNT(DISTINCT)`` expansion; the join to the first period
    is on the entity (both sides hash partitioned on it)."""
    active = person_ts.select(entity, period_start(ts, unit).alias(out)).distinct()
    j = active.join(cohorts(person_ts, entity, ts, unit, "__first"), entity)
    return (j.groupBy(out)
            .agg(F.count_if(F.col(out) == F.col("__first")).alias("new_customers"),
                 F.count_if(F.col(out) > F.col("__first")).alias("returning_customers"),
                 F.count(F.lit(1)).alias("total_active_customers")))


def rfm(customers: DataFrame, orders: DataFrame, items: DataFrame, status: str | None = "delivered",
        as_of: dt.datetime | None = None, day_mode: str | None = None) -> DataFrame:
    """P12 RFM per person: ``recency`` (last purchase), ``frequency`` (distinct
    orders that have items), ``monetary_c`` (item revenue, cents).

    ``day_mode`` adds ``recency_days`` up to ``as_of`` (default: the latest
    purchase with the status): ``elapsed`` counts whole 24-hour blocks,
    ``calendar`` counts dates (S7).

    Items fold to order grain before the join, and the person aggregate is
    partial on the map side, so a very active person is never one task's
    whole input. Without ``as_of`` the latest purchase of *any* order with the
    status is needed, of those too that have no items or no customer: the joins
    keep such orders, the person fold carries their latest purchase beside the
    matched ones, and the reference date is the maximum over the fold, so the
    orders are read once."""
    per_order = items.groupBy("order_id").agg(
        F.sum(cents(F.col("price") + F.col("freight_value"))).alias("rev_c"), F.lit(True).alias("__sold"))
    kept = ["customer_unique_id", "recency", "frequency", "monetary_c"]
    if day_mode is None or as_of is not None:
        out = (person_orders(customers, orders, status).join(per_order, "order_id")
               .groupBy("customer_unique_id")
               .agg(F.max("order_purchase_timestamp").alias("recency"),
                    F.count("order_id").alias("frequency"), F.sum("rev_c").alias("monetary_c")))
        latest = None
    else:
        o = orders.where(F.col("order_status") == status) if status else orders
        known = customers.select("customer_id", "customer_unique_id", F.lit(True).alias("__known"))
        counted = F.col("__known") & F.col("__sold")
        fold = whole(o.select("order_id", "customer_id", "order_purchase_timestamp")
                     .join(known, "customer_id", "left").join(per_order, "order_id", "left")
                     .groupBy("customer_unique_id")
                     .agg(F.max(F.when(counted, F.col("order_purchase_timestamp"))).alias("recency"),
                          F.count(F.when(counted, F.col("order_id"))).alias("frequency"),
                          F.sum(F.when(counted, F.col("rev_c"))).alias("monetary_c"),
                          F.max("order_purchase_timestamp").alias("__any")))
        latest = F.broadcast(fold.agg(F.max("__any").alias("max_date")))  # one row
        out = fold.where(F.col("frequency") > 0).select(*kept)
    if day_mode is None:
        return out
    days = {"elapsed": whole_days_elapsed, "calendar": calendar_days_between}[day_mode]
    if latest is None:
        return out.withColumn("recency_days", days(F.col("recency"), F.lit(as_of).cast("timestamp_ntz")))
    return (out.crossJoin(latest).withColumn("recency_days", days(F.col("recency"), F.col("max_date"))).drop("max_date"))


def as_of_date(orders: DataFrame, status: str | None = "delivered") -> DataFrame:
    """One row: the latest purchase timestamp (``max_date``) - RFM's reference."""
    o = orders.where(F.col("order_status") == status) if status else orders
    return o.agg(F.max("order_purchase_timestamp").alias("max_date"))
