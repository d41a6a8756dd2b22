"""Folds refreshed month by month against reports over whole tables."""

from __future__ import annotations

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from tests.conftest import SMOKE, customer, item, make_tables, order
from vendora.cli import main
from vendora.operators.refresh import in_periods, period_end, read_periods, write_periods
from vendora.plans import REGISTRY
from vendora.plans.monthly import SCHEMAS, changed_months, monthly_reports, refresh
from vendora.sources.catalog import from_testdata
from vendora.sources.ingest import write_tables

KEYS = ("revenue_monthly_trend", "delivery_monthly_trend", "customer_new_vs_returning")


def same_as_full(spark, t, root):
    got = monthly_reports(spark, root)
    for key in KEYS:
        full = REGISTRY[key](t)
        assert got[key].schema.simpleString() == full.schema.simpleString()
        assert [tuple(r) for r in got[key].collect()] == [tuple(r) for r in full.collect()], key


def month(y, m):
    return dt.date(y, m, 1)


BASE = dict(
    customers=[customer("c1", "u1"), customer("c2", "u2"), customer("c3", "u1"), customer("c4", "u3"), customer("c5", "u4")],
    orders=[order("o1", "c1", pts="2017-01-31 23:59:59", delivered="2017-02-03 00:00:00", estimated="2017-02-02 00:00:00"),
            order("o2", "c2", pts="2017-02-01 00:00:00", delivered="2017-02-04 00:00:00", estimated="2017-02-09 00:00:00"),
            order("o3", "c3", pts="2017-04-05 00:00:00", delivered="2017-04-09 00:00:00", estimated="2017-04-09 00:00:00"),
            order("o5", "c5", pts="2017-04-06 00:00:00")],
    order_items=[item("o1", 1), item("o2", 1, price=None), item("o3", 1, price=30), item("o3", 2)])


def stored_files(root):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(root) for f in fs if f.endswith(".parquet")}


def test_late_rows_change_only_their_months(spark, tmp_path):
    root = str(tmp_path)
    t = make_tables(spark, **BASE)
    assert refresh(t, root) is None
    same_as_full(spark, t, root)
    old = stored_files(root)
    new_order, new_items = order("o4", "c4", pts="2017-02-10 00:00:00", delivered="2017-02-20 00:00:00", estimated="2017-02-19 00:00:00"), [item("o4", 1, price=7)]
    t2 = make_tables(spark, **{**BASE, "orders": [*BASE["orders"], new_order], "order_items": [*BASE["order_items"], *new_items]})
    late = make_tables(spark, orders=[new_order], order_items=new_items).as_dict()
    assert refresh(t2, root, {k: late[k] for k in ("orders", "order_items")}) == [month(2017, 2)]
    same_as_full(spark, t2, root)
    kept = {f: at for f, at in old.items() if "order_month=2017-02-01" not in f}
    assert kept and kept.items() <= stored_files(root).items()
    refresh(t2, root, {"orders": late["orders"]})   # once more: the same store
    same_as_full(spark, t2, root)


def test_order_that_leaves_its_month_and_month_left_empty(spark, tmp_path):
    """o3 and o5 are the only orders of April; o3 moves to March, o5 is cancelled."""
    root = str(tmp_path)
    t = make_tables(spark, **BASE)
    refresh(t, root)
    moved = [order("o3", "c3", pts="2017-03-31 00:00:00", delivered="2017-04-09 00:00:00", estimated="2017-04-09 00:00:00"),
             order("o5", "c5", status="canceled", pts="2017-04-06 00:00:00")]
    t2 = make_tables(spark, **{**BASE, "orders": BASE["orders"][:2] + moved})
    late = {"orders": make_tables(spark, orders=moved).orders}
    before = t.orders.where("order_id in ('o3', 'o5')")
    assert sorted(changed_months(t2, late, before)) == [month(2017, 3), month(2017, 4)]
    refresh(t2, root, late, before)
    same_as_full(spark, t2, root)
    assert REGISTRY["revenue_monthly_trend"](t2).where("order_month = '2017-04-01'").count() == 0


def test_late_items_and_customers_touch_their_orders_months(spark, tmp_path):
    root = str(tmp_path)
    refresh(make_tables(spark, **BASE), root)
    extra, renamed = [item("o1", 2, price=99), item("gone", 1)], [customer("c2", "u1")]
    t2 = make_tables(spark, **{**BASE, "order_items": [*BASE["order_items"], *extra],
                               "customers": [c for c in BASE["customers"] if c[0] != "c2"] + renamed})
    late = make_tables(spark, order_items=extra, customers=renamed).as_dict()
    assert sorted(refresh(t2, root, {k: late[k] for k in ("order_items", "customers")})) == [month(2017, 1), month(2017, 2)]
    same_as_full(spark, t2, root)
    assert refresh(t2, root, {}) == []
    none = make_tables(spark)
    assert refresh(t2, root, {"orders": none.orders}) == []


def test_testdata_after_a_late_year_and_empty_store(spark, tmp_path):
    t = from_testdata(spark, SMOKE)
    late = (F.year("order_delivered_customer_date") == 1997) & (F.month("order_purchase_timestamp") == 12)
    early = make_tables(spark)
    refresh(early, str(tmp_path / "none"))
    same_as_full(spark, early, str(tmp_path / "none"))
    part = type(t)(**{**t.__dict__, "orders": t.orders.where(~F.coalesce(late, F.lit(False)))})
    refresh(part, str(tmp_path / "all"))
    assert len(refresh(t, str(tmp_path / "all"), {"orders": t.orders.where(late)})) >= 1
    same_as_full(spark, t, str(tmp_path / "all"))


def test_changed_months_are_ranges_that_reach_the_scan(spark, tmp_path):
    t = make_tables(spark, **BASE)
    t.orders.write.parquet(str(tmp_path / "o"))
    o = spark.read.parquet(str(tmp_path / "o"))
    some = o.where(in_periods(F.col("order_purchase_timestamp"), [month(2017, 2), month(2017, 1)]))
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(order_purchase_timestamp,2017-01-01" in plan and "LessThan(order_purchase_timestamp,2017-03-01" in plan
    assert {r.order_id for r in some.collect()} == {"o1", "o2"}
    assert o.where(in_periods(F.col("order_purchase_timestamp"), [])).count() == 0


def test_from_the_command_line(spark, tmp_path):
    lake, folds, late = (str(tmp_path / n) for n in ("lake", "folds", "late"))
    write_tables(make_tables(spark, **BASE).as_dict(), lake)
    assert main(["--parquet", lake, "--monthly", folds]) == 0
    more = order("o9", "c1", pts="2017-05-02 00:00:00")
    make_tables(spark, orders=[more]).orders.write.parquet(f"{late}/orders")
    t = make_tables(spark, **{**BASE, "orders": [*BASE["orders"], more], "order_items": [*BASE["order_items"], item("o9", 1)]})
    write_tables(t.as_dict(), lake)
    assert main(["--parquet", lake, "--monthly", folds, "--late", late]) == 0
    for key in KEYS:
        assert spark.read.parquet(f"{folds}/_reports/{key}").exceptAll(REGISTRY[key](t)).count() == 0
    assert spark.read.parquet(f"{folds}/_reports/{KEYS[0]}").count() == 4


@pytest.mark.parametrize(("start", "unit", "end"), [
    (dt.date(2016, 12, 1), "month", dt.date(2017, 1, 1)), (dt.date(2016, 10, 1), "quarter", dt.date(2017, 1, 1)),
    (dt.date(2016, 1, 1), "year", dt.date(2017, 1, 1)), (dt.date(2016, 12, 26), "week", dt.date(2017, 1, 2))])
def test_period_end(start, unit, end):
    assert period_end(start, unit) == end


def test_rows_without_a_period(spark, tmp_path):
    schema = SCHEMAS["active"]
    df = spark.createDataFrame([(None, "u1"), (month(2017, 1), "u2")], schema)
    write_periods(df, str(tmp_path / "a"), "order_month")
    write_periods(df.where("order_month is null").withColumn("customer_unique_id", F.lit("u9")), str(tmp_path / "a"), "order_month", [None])
    got = read_periods(spark, str(tmp_path / "a"), schema)
    assert {tuple(r) for r in got.collect()} == {(None, "u9"), (month(2017, 1), "u2")}
