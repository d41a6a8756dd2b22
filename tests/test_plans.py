"""Plan guards: the properties that keep the reports distributed at scale."""

from __future__ import annotations

import re

import pytest

from tests.conftest import SMOKE
from vendora.plans import REGISTRY
from vendora.sources import adapter, ingest
from vendora.sources.catalog import from_catalog, from_parquet, from_testdata

# Unpartitioned windows may only order rows whose count is bounded: value
# buckets of the cumulative distribution (<= 2^20) or calendar months.
BOUNDED_ORDER_COLS = {"b", "order_month", "__cell"}
EXTRA = {"delivery_peak_months": {"total_orders"},    # RANK() over the month rows
         "revenue_category_concentration": {"revenue"}}   # RANK() over one row per category


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _unpartitioned_window_orders(plan: str) -> list[str]:
    cols = []
    for m in re.finditer(r"windowspecdefinition\(([^,()]+)", plan):
        first = m.group(1)
        if " ASC" in first or " DESC" in first:          # no PARTITION BY: spec starts with the ordering
            cols.append(first.split("#")[0].strip())
    return cols


@pytest.mark.parametrize("key", sorted(REGISTRY))
def test_no_single_task_window_or_percentile_at_data_grain(spark, key):
    plan = _plan(REGISTRY[key](from_testdata(spark, SMOKE)))
    allowed = BOUNDED_ORDER_COLS | EXTRA.get(key, set())
    assert set(_unpartitioned_window_orders(plan)) <= allowed, plan
    assert "percentile(" not in plan.lower() and "approx_percentile" not in plan.lower()
    assert "PythonUDF" not in plan and "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
    assert not re.search(r"\bExpand\b", plan) or key == "product_category_counts", plan   # tiny lookup table


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tables")
    tables = adapter.derive_all(spark, SMOKE)
    ingest.write_tables(tables, str(root / "plain"))
    ingest.write_bucketed_tables(tables, str(root / "bucketed"), 4, database="vendora_test")
    return from_parquet(spark, str(root / "plain")), from_catalog(spark, "vendora_test")


def test_filters_pushed_and_columns_pruned(stored):
    plain, _ = stored
    plan = REGISTRY["revenue_monthly_trend"](plain)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(order_status,delivered)" in plan
    scans = [ln for ln in plan.split("\n") if "ReadSchema" in ln or "FileScan" in ln]
    assert scans and all("review" not in ln and "customer_id" not in ln for ln in scans)


def test_bucketed_tables_join_orders_and_items_without_shuffle(stored):
    _, bucketed = stored
    plan = _plan(REGISTRY["revenue_headline"](bucketed))
    # items fold by order_id and meet orders on order_id: no exchange on order_id
    assert not re.search(r"Exchange hashpartitioning\(order_id#\d+", plan), plan


SELLER_REPORTS = ("seller_headline", "seller_activity_buckets", "seller_pareto", "seller_top_revenue", "seller_top_volume",
                  "seller_review_quality", "seller_late_rate", "seller_scorecard", "seller_by_state", "seller_shipping_type")


@pytest.mark.parametrize("key", SELLER_REPORTS)
def test_seller_reports_hold_no_table_of_order_seller_pairs(stored, key):
    """Such a table is nearly as long as the item lines and was held twice in one task's memory."""
    keys = re.findall(r"Aggregate\(keys=\[([^\]]*)\]", _plan(REGISTRY[key](stored[0])))
    assert keys and not [k for k in keys if "order_id" in k and "seller_id" in k], keys


def test_seller_marks_need_no_shuffle_of_bucketed_tables(stored):
    plan = _plan(REGISTRY["seller_review_quality"](stored[1]))
    assert "Window" in plan and not re.search(r"Exchange hashpartitioning\(order_id#\d+", plan), plan


def test_results_same_on_every_storage_layout(spark, stored):
    plain, bucketed = stored
    lazy = from_testdata(spark, SMOKE)
    for key in ("revenue_order_value_percentiles", "seller_scorecard", "customer_interorder_gap"):
        rows = [sorted(map(tuple, REGISTRY[key](t).collect())) for t in (lazy, plain, bucketed)]
        assert rows[0] == rows[1] == rows[2]


# Reports that read a fact table more than once, and why.
MORE_SCANS = {
    "master_preview": {"orders": 3, "order_items": 3},              # ten ids first, then only their rows
    "quality_foreign_keys": {"orders": 4, "order_items": 3},        # a child and a parent in several references
    "quality_keys": {}, "validate_row_counts": {},
    # key, each reference and row rules: a narrow read for each
    "quality_violations": {"orders": 6, "order_items": 5, "order_payments": 3, "order_reviews": 3},
}
FACTS = ("orders", "order_items", "order_payments", "order_reviews")


def final_scans(df, root: str) -> dict[str, int]:
    """Scans per fact table in the plan that ran (reused exchanges count once)."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    return {f: n for f in FACTS if (n := len(re.findall(rf"FileScan parquet [^\n]*{re.escape(root)}/{f}\b", final)))}


def test_facts_are_read_once(spark, stored, tmp_path_factory):
    """With broadcasts off, each report reads each fact table at most once."""
    plain, _ = stored
    root = plain.orders.inputFiles()[0].rsplit("/orders/", 1)[0].split("/plain")[0].replace("file://", "") + "/plain"
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    try:
        wrong = {}
        for key in sorted(REGISTRY):
            allowed = MORE_SCANS.get(key, {})
            over = {f: n for f, n in final_scans(REGISTRY[key](plain), root).items() if n > allowed.get(f, 1)}
            if over:
                wrong[key] = over
        assert not wrong, wrong
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
