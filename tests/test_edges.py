"""Hand-made edge frames (FIXTURES.md section D) through the real reports."""

from __future__ import annotations

import datetime as dt

import pytest

from tests.conftest import customer, item, make_tables, order, review
from vendora.plans import REGISTRY


@pytest.mark.parametrize("key", sorted(REGISTRY))
def test_every_report_runs_on_empty_tables(spark, key):
    rows = REGISTRY[key](make_tables(spark)).collect()
    assert isinstance(rows, list)


def test_empty_input_gives_null_ratios(spark):
    t = make_tables(spark)
    r = REGISTRY["delivery_headline"](t).first()
    assert r["total_delivered_orders"] == 0 and r["on_time_rate_pct"] is None
    r = REGISTRY["revenue_headline"](t).first()
    assert r["total_orders"] == 0 and r["avg_order_value"] is None


def _late_orders(delays):
    orders, est = [], dt.datetime(2017, 3, 1)
    for i, d in enumerate(delays):
        delivered = est + dt.timedelta(days=d)
        orders.append(order(f"O{i}", f"C{i}", delivered=str(delivered), estimated=str(est)))
    return orders


DELAYS = [0.5, 1.5, 2.5, 3.5, 5, 7.5, 10, 14.5, 20]


def test_literal_delay_buckets_keep_their_gaps(spark):
    t = make_tables(spark, orders=_late_orders(DELAYS))
    rows = REGISTRY["delivery_late_severity"](t).collect()
    assert [(r["delay_bucket"], r["order_count"]) for r in rows] == [
        ("1 day late", 1), ("15+ days late", 5), ("2-3 days late", 1), ("4-7 days late", 1),
        ("8-14 days late", 1)]


def test_contiguous_delay_buckets(spark):
    t = make_tables(spark, orders=_late_orders(DELAYS))
    rows = REGISTRY["delivery_review_by_delay"](t).collect()
    assert [(r["delay_bucket"], r["total_orders"]) for r in rows] == [
        ("Late 1-3 days", 3), ("Late 4-7 days", 2), ("Late 8-14 days", 2), ("Late 15+ days", 2)]


def test_two_reviews_count_one_item_twice(spark):
    t = make_tables(spark, sellers=[("S1", "1", "c", "SP")],
                    orders=[order("O1", "C1")], items=[], order_items=[item("O1", 1, price=10, freight=1)],
                    order_reviews=[review("R1", "O1", 5), review("R2", "O1", 3)])
    r = REGISTRY["seller_top_revenue"](t).first()
    assert (r["total_orders"], r["total_items_sold"], r["total_revenue"], r["avg_review_score"]) == (1, 2, 22.0, 4.0)


def test_missing_month_lags_by_row(spark):
    t = make_tables(spark, orders=[order("O1", "C1", pts="2017-01-10 00:00:00"),
                                   order("O2", "C2", pts="2017-03-10 00:00:00")],
                    order_items=[item("O1", 1, price=100, freight=0), item("O2", 1, price=150, freight=0)])
    rows = REGISTRY["revenue_monthly_trend"](t).collect()
    assert [(r["monthly_revenue"], r["prev_month_revenue"], r["mom_growth_pct"]) for r in rows] == [
        (100.0, None, None), (150.0, 100.0, 50.0)]


def test_null_state_is_cross_state(spark):
    t = make_tables(spark, sellers=[("S1", "1", "c", None)], customers=[customer("C1", "U1", state=None)],
                    orders=[order("O1", "C1", delivered="2017-01-03 10:00:00", estimated="2017-02-01 00:00:00")],
                    order_items=[item("O1", 1)])
    r = REGISTRY["seller_shipping_type"](t).first()
    assert r["shipping_type"] == "Cross state" and r["pct_of_orders"] == 100.0 and r["avg_delivery_days"] == 2.0


def test_one_order_seller_bucket(spark):
    t = make_tables(spark, sellers=[("S1", "1", "c", "SP")], orders=[order("O1", "C1")],
                    order_items=[item("O1", 1)])
    r = REGISTRY["seller_activity_buckets"](t).first()
    assert (r["order_bucket"], r["seller_count"], r["pct_of_sellers"]) == ("1 order", 1, 100.0)


def test_blank_comment_does_not_count(spark):
    t = make_tables(spark, order_reviews=[review("R1", "O1", 5, "  "), review("R2", "O2", 4, None),
                                          review("R3", "O3", 3, "x")])
    r = REGISTRY["review_comment_rate"](t).first()
    assert (r["total_reviews"], r["reviews_with_comment"], r["pct_with_comment"]) == (3, 1, 33.33)


def test_tied_revenue_keeps_all_ties_in_top_k(spark):
    # Six categories: 100, 90, 80, 70, 60 (x2 tied at rank 5) -> top 5 holds both 60s.
    cats = [("c1", 100), ("c2", 90), ("c3", 80), ("c4", 70), ("c5", 60), ("c6", 60)]
    products = [(f"P{i}", name, 1, 1, 1, 1, 1, 1, 1) for i, (name, _) in enumerate(cats)]
    trans = [(name, name + "_en") for name, _ in cats]
    orders = [order(f"O{i}", f"C{i}") for i in range(len(cats))]
    items = [item(f"O{i}", 1, pid=f"P{i}", price=v, freight=0) for i, (_, v) in enumerate(cats)]
    t = make_tables(spark, products=products, product_category_translation=trans, orders=orders,
                    order_items=items)
    r = REGISTRY["revenue_category_concentration"](t).first()
    assert r["top_5_revenue"] == 460.0 and r["top_10_revenue"] == 460.0 and r["top_5_pct"] == 100.0


def test_person_level_headline(spark):
    t = make_tables(spark, customers=[customer("C1", "U1"), customer("C2", "U1"), customer("C3", "U2")],
                    orders=[order("O1", "C1"), order("O2", "C2"), order("O3", "C3"),
                            order("O4", "C3", status="canceled")])
    r = REGISTRY["customer_headline"](t).first()
    assert (r["total_unique_customers"], r["total_orders"], r["repeat_customers"], r["one_time_customers"],
            r["repeat_customer_rate_pct"]) == (2, 3, 1, 1, 50.0)


# --- sums of spans past the range of BIGINT -----------------------------------------------
def _long_spans(spark, n=60):
    """Orders under way for 7000 years: forty such spans in microseconds pass 2^63."""
    o = [order(f"O{i}", f"C{i}", pts="2000-01-01 00:00:00", carrier="9000-01-01 00:00:00", delivered="9001-01-01 00:00:00",
               estimated="2000-01-02 00:00:00") for i in range(n)]
    return make_tables(spark, orders=o, customers=[customer(f"C{i}", f"U{i}") for i in range(n)], sellers=[("S1", "1", "c", "SP")],
                       order_items=[item(f"O{i}", 1) for i in range(n)])


def test_pipeline_stages_sum_past_bigint(spark):
    a = (dt.datetime(9000, 1, 1) - dt.datetime(2000, 1, 1)).days
    r = REGISTRY["delivery_pipeline_stages"](_long_spans(spark)).first()
    assert tuple(r) == (float(a), 365.0, float(a + 365), 100.0, 0.0)


@pytest.mark.parametrize("key", ["delivery_by_state", "delivery_routes", "delivery_late_by_state", "delivery_monthly_trend",
                                 "monthly_refresh"])
def test_delivery_averages_sum_past_bigint(spark, key):
    rows = REGISTRY[key](_long_spans(spark)).collect()
    column = "avg_days_late" if key == "delivery_late_by_state" else "avg_delivery_days"
    days = (dt.datetime(9001, 1, 1) - dt.datetime(2000, 1, 1)).days
    assert [r[column] for r in rows] == [days - 1.0 if column == "avg_days_late" else float(days)]


def test_shipping_types_sum_past_bigint(spark):
    t = _long_spans(spark)
    r = REGISTRY["seller_shipping_type"](t).first()
    assert r["total_orders"] == 60 and r["avg_delivery_days"] == float((dt.datetime(9001, 1, 1) - dt.datetime(2000, 1, 1)).days)


# --- repeated and missing keys in the seller reports ---------------------------------------
def _repeated(spark):
    """Seller S1 sells in O1 (a row that comes twice, two lines) and O2 (late), S2 in O1 only;
    lines without order or seller, of an unknown seller, of an order not delivered."""
    o1 = order("O1", "C1", delivered="2017-01-03 10:00:00", estimated="2017-02-01 00:00:00")
    o2 = order("O2", "C2", delivered="2017-03-03 10:00:00", estimated="2017-02-01 00:00:00")
    return make_tables(
        spark, sellers=[("S1", "1", "c", "SP"), ("S2", "1", "c", None)], orders=[o1, o1, o2, order("O3", "C3", status="canceled")],
        customers=[customer(c, "U" + c) for c in ("C1", "C2", "C3")], order_reviews=[review("R1", "O1", 5), review("R2", "O1", 2)],
        order_items=[item("O1", 1), item("O1", 2), item("O2", 1), item("O1", 3, sid="S2"), item("O1", 4, sid="S9"),
                     item(None, 1), item("O2", 2, sid=None), item("O3", 1, sid="S2")])


def test_seller_counts_with_repeated_and_missing_keys(spark):
    t = _repeated(spark)
    rows = {r["seller_id"]: r for r in REGISTRY["seller_top_revenue"](t).collect()}
    # O1 comes twice with two reviews: each of its lines stands for four rows.
    assert {k: (r["total_orders"], r["total_items_sold"], r["total_revenue"], r["avg_review_score"]) for k, r in rows.items()} == {
        "S1": (2, 9, 99.0, 3.5), "S2": (1, 4, 44.0, 3.5)}
    assert tuple(REGISTRY["seller_headline"](t).first()) == (2, 2, 77.0, 11.0, 38.5, 1.0)
    got = {r["seller_state"]: (r["total_sellers"], r["total_orders"]) for r in REGISTRY["seller_by_state"](t).collect()}
    assert got == {"SP": (1, 2), None: (1, 1)}
    got = {r["shipping_type"]: (r["total_orders"], r["avg_delivery_days"]) for r in REGISTRY["seller_shipping_type"](t).collect()}
    assert got == {"Same state": (2, 8.6), "Cross state": (1, 2.0)}


def test_order_once_late_and_once_not_counts_in_both(spark):
    on_time = [order(f"O{i}", "C1", delivered="2017-01-03 10:00:00", estimated="2017-02-01 00:00:00") for i in range(10)]
    late = order("O0", "C1", delivered="2017-03-03 10:00:00", estimated="2017-02-01 00:00:00")
    t = make_tables(spark, sellers=[("S1", "1", "c", "SP")], orders=[*on_time, late, late],
                    order_items=[item(f"O{i}", n) for i in range(10) for n in (1, 2)])
    r = REGISTRY["seller_late_rate"](t).first()
    assert (r["total_orders"], r["late_deliveries"]) == (11, 1)
