"""Every registered report against its DuckDB oracle on the sf0.001 testdata:
same row count, same columns, same values (order-insensitive)."""

from __future__ import annotations

import hashlib
import math
from functools import partial

import pandas as pd
import pytest

import __spark_entry__ as se
from tests.conftest import SMOKE
from vendora.plans import ORACLE, REGISTRY

KEYS = sorted(REGISTRY)


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, pd.Timestamp) or hasattr(v, "isoformat"):
        return pd.Timestamp(v).isoformat()
    if hasattr(v, "item"):
        return _norm(v.item())
    if isinstance(v, (int, float)):
        return repr(round(float(v), 9))
    return str(v)


def _digest(df: pd.DataFrame) -> str:
    cols = sorted(df.columns)
    rows = sorted("|".join(_norm(r[c]) for c in cols) for r in df[cols].to_dict("records"))
    return hashlib.sha256("\n".join(rows).encode()).hexdigest()


def test_every_report_has_an_oracle():
    assert len(KEYS) == 71
    assert set(ORACLE) == set(KEYS)
    assert set(KEYS) <= set(se.queries()) and set(ORACLE) <= set(se.oracle_sql())


def test_entry_smoke(spark):
    df = se.entry(spark)
    assert df.columns == ["order_month", "total_orders", "monthly_revenue", "prev_month_revenue",
                          "mom_growth_pct", "rolling_3m_avg"]
    assert df.count() > 0


@pytest.mark.parametrize("key", KEYS)
def test_report_matches_oracle(spark, duck, key):
    got = se.queries()[key](spark, SMOKE).toPandas()
    want = duck.execute(se.oracle_sql()[key]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    assert _digest(got) == _digest(want)


@pytest.mark.parametrize("key", ["customer_interorder_gap", "revenue_order_value_percentiles",
                                 "customer_rfm_summary", "seller_pareto", "delivery_time_distribution"])
def test_sliced_and_multi_bucket_paths_match_oracle(spark, duck, monkeypatch, key):
    """Force the scale paths on small data: a person's orders split over
    runs of about 2 timestamps, value distributions over ranges of about 50 values."""
    import vendora.operators.ranking as rk
    import vendora.plans.customers as pc
    monkeypatch.setattr(pc, "interarrival_gaps", partial(pc.interarrival_gaps, run=2))
    monkeypatch.setattr(rk, "VALUES", 50)
    monkeypatch.setattr(rk, "BUCKETS", 7)
    got = se.queries()[key](spark, SMOKE).toPandas()
    want = duck.execute(se.oracle_sql()[key]).df()
    assert _digest(got) == _digest(want)


@pytest.mark.parametrize("zone", ["America/New_York", "Asia/Kolkata"])
def test_session_time_zone_does_not_change_results(spark, duck, zone):
    """Zone-less timestamps throughout: a DST zone and a half-hour offset zone
    give the oracle's results for the timestamp-heavy reports."""
    keys = ["explore_date_range", "revenue_monthly_trend", "revenue_by_weekday", "customer_rfm",
            "customer_interorder_gap", "delivery_time_distribution", "delivery_late_severity"]
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", zone)
        for key in keys:
            got = se.queries()[key](spark, SMOKE).toPandas()
            want = duck.execute(se.oracle_sql()[key]).df()
            assert _digest(got) == _digest(want), key
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
