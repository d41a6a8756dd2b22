"""Declared bounds, violating keys as rows and the rejecting load, on planted faults."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as se
from tests.conftest import customer, item, make_tables, order, review
from tests.test_parity import _digest
from vendora.operators.audit import audit_bounds, broken_keys, key_text, top_violations
from vendora.oracle import body_of
from vendora.plans import REGISTRY
from vendora.sources import ingest
from vendora.sources.catalog import from_parquet
from vendora.sources.schemas import TABLES


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    import duckdb
    root = tmp_path_factory.mktemp("planted")
    long_city = "x" * 101
    t = make_tables(
        spark,
        customers=[customer("C1", "U1"), customer("C|2", "U2", state="ABC"), customer("C|2", "U2", state="AB "),
                   customer(None, "U3", city=long_city), customer("C4" + " " * 60, "U4"), customer("C5\\", "U5", city="y" * 150)],
        geolocation=[("12345678901", Decimal("1.5"), None, None, "SP")] * 2,
        orders=[order("O1", "C1"), order("O1", "C1"), order("O2", "gone", status="s" * 21)] + [order(f"X{i}", "gone") for i in range(12)],
        order_items=[item("O1", 1), item("O1", 1), item("O1", 1), item("O9", None)] + [item(f"N{i:02}", 1) for i in range(14)],
        order_reviews=[review("R1", "O1", 6), review("R2", "O2", 0), review("R3", "O2", 5), review("R3", "O2", -4), review("R4", "O1", None)])
    for name, df in t.as_dict().items():
        df.coalesce(2).write.parquet(str(root / name))
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {'orders_m' if name == 'orders' else name} AS SELECT * FROM read_parquet('{root}/{name}/*.parquet')")
    return from_parquet(spark, str(root)), con


@pytest.mark.parametrize("key", ["quality_rules", "quality_violations", "quality_keys", "quality_foreign_keys"])
def test_audits_match_sql_on_planted_faults(planted, key):
    tables, con = planted
    got, want = REGISTRY[key](tables).toPandas(), con.execute(body_of(se.oracle_sql()[key])).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _digest(got) == _digest(want)


def test_rules_measure_the_worst_value(planted):
    rows = {(r["table_name"], r["rule"]): r for r in REGISTRY["quality_rules"](planted[0]).collect()}
    city = rows["customers", "length of customer_city <= 100"]
    assert (city["violations"], city["total_rows"], city["bound"], city["worst"]) == (2, 6, 100.0, 150.0)
    state = rows["customers", "length of customer_state <= 2"]
    assert (state["violations"], state["worst"]) == (1, 3.0)                  # "AB " is two characters
    assert rows["customers", "length of customer_id <= 50"]["violations"] == 0
    assert rows["geolocation", "length of geolocation_zip_code <= 10"]["violations"] == 2
    score = rows["order_reviews", "review_score between 1 and 5"]
    assert (score["violations"], score["worst"]) == (3, 5.0)                  # -4 is five below the range
    assert rows["sellers", "length of seller_id <= 50"]["worst"] is None      # no rows


def test_violations_plan_limits_each_task(planted):
    plan = REGISTRY["quality_violations"](planted[0])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2                                # once before and once after the shuffle


def test_violating_keys_are_listed(planted):
    rows = REGISTRY["quality_violations"](planted[0]).collect()
    of = {}
    for r in rows:
        of.setdefault((r["table_name"], r["rule"]), []).append((r["place"], r["row_key"], r["n_rows"], r["worst"]))
    assert of["customers", "key (customer_id)"] == [(1, "C\\|2", 2, None), (2, "\\N", 1, None)]
    assert of["order_items", "key (order_id, order_item_id)"] == [(1, "O1|1", 3, None), (2, "O9|\\N", 1, None)]
    assert of["orders", "customer_id in customers"] == [(1, "gone", 13, None)]
    orphans = of["order_items", "order_id in orders"]                         # 15 keys: the list ends at ten, ties by key
    assert [k for _, k, _, _ in orphans] == [f"N{i:02}" for i in range(10)]
    assert of["customers", "length of customer_city <= 100"] == [(1, "C5\\\\", 1, 150.0), (2, "\\N", 1, 101.0)]
    assert of["geolocation", "length of geolocation_zip_code <= 10"] == [(1, "12345678901|1.500000|\\N|\\N|SP", 2, 11.0)]
    assert ("sellers", "key (seller_id)") not in of


def test_bounds_on_wider_types_and_empty_tables(spark):
    wide = spark.createDataFrame([(Decimal("100000000.00"),), (Decimal("-99999999.99"),), (None,)], "price decimal(20,2)")
    r = audit_bounds(wide, {"fits": (F.abs("price"), 99999999.99)}).first()
    assert (r["violations"], r["total_rows"], r["worst"]) == (1, 3, 100000000.0)
    r = audit_bounds(wide.limit(0), {"fits": (F.abs("price"), 1.0)}).first()
    assert (r["violations"], r["total_rows"], r["worst"]) == (0, 0, None)
    assert broken_keys(wide.limit(0), ["price"]).count() == 0


def test_key_text_tells_parts_apart(spark):
    rows = [("a|b", "c"), ("a", "b|c"), ("a\\", "|c"), (None, "c"), ("\\N", "c"), ("", "c")]
    df = spark.createDataFrame(rows, "x string, y string").select(key_text(["x", "y"]).alias("k"))
    assert len({r["k"] for r in df.collect()}) == len(rows)


def test_top_list_limits_before_the_shuffle(spark):
    found = spark.range(5000).select((F.col("id") >= 0).cast("string").alias("rule"), F.col("id").cast("string").alias("row_key"), (F.col("id") % 7).alias("n_rows"))
    top = top_violations(found, ["rule"], 10)
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()
    assert [r["place"] for r in top.orderBy("place").collect()] == list(range(1, 11))


REVIEW_HEAD = ("review_id,order_id,review_score,review_comment_title,review_comment_message,"
               "review_creation_date,review_answer_timestamp\n")


def test_load_sets_unfit_records_apart(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    for name, schema in TABLES.items():
        if name != "order_reviews":
            (src / f"{name}.csv").write_text(",".join(schema.fieldNames()) + "\n")
    (src / "order_reviews.csv").write_text(
        REVIEW_HEAD
        + 'R1,O1,5,,"two\nlines, ""quoted""",2018-01-01 00:00:00,2018-01-02 10:11:12\n'
        + 'R2,O2,five,,"a, b",2018-01-03 00:00:00,yesterday\n'
        + "R3,O3,4\n"
        + "R4,O4,3,,ok,2018-01-03 00:00:00,2018-01-03 00:00:00,extra\n"
        + "R5,O5,,,,,\n")
    (src / "order_items.csv").write_text(
        ",".join(TABLES["order_items"].fieldNames()) + "\n"
        + "O1,1,P1,S1,2018-01-01 00:00:00,10.00,1.00\n"
        + "O1,2,P1,S1,2018-01-01 00:00:00,12345678901.00,1.00\n")
    loaded, rejects = ingest.load_folder_with_rejects(spark, str(src), str(tmp_path / "root"))
    assert {r["review_id"]: r["review_comment_message"] for r in loaded["order_reviews"].collect()} == {
        "R1": 'two\nlines, "quoted"', "R5": None}
    # the split does not hang on the columns that a query reads
    assert loaded["order_reviews"].count() == loaded["order_reviews"].select("review_id").distinct().count() == 2
    found = {r["record"].split(",")[0] + r["table_name"]: r for r in rejects.collect()}
    assert set(found) == {"R2order_reviews", "R3order_reviews", "R4order_reviews", "O1order_items"}
    assert found["R2order_reviews"]["bad_columns"] == ["review_score", "review_answer_timestamp"]
    assert [(found[f"R{i}order_reviews"]["fields"], found[f"R{i}order_reviews"]["expected"]) for i in (2, 3, 4)] == [(7, 7), (3, 7), (8, 7)]
    assert found["O1order_items"]["bad_columns"] == ["price"]
    assert all(r["file"].endswith(f"/{r['table_name']}.csv") for r in found.values())
    counts = {r["table_name"]: (r["row_count"], r["rejected_count"], r["read_count"])
              for r in ingest.load_report(loaded, rejects).collect()}
    assert len(counts) == 9
    assert counts["order_reviews"] == (2, 3, 5) and counts["order_items"] == (1, 1, 2) and counts["orders"] == (0, 0, 0)


def test_rfm_reference_date_counts_orders_without_items_or_customer(spark):
    t = make_tables(spark, customers=[customer("C1", "U1"), customer("C2", "U2"), customer("C3", "U3")],
                    orders=[order("O1", "C1", pts="2017-01-01 10:00:00"), order("O2", "C2", pts="2017-03-01 10:00:00"),
                            order("O3", "nobody", pts="2017-04-01 10:00:00"), order("O4", "C3", pts="2017-02-01 10:00:00"),
                            order("O5", "C1", status="canceled", pts="2018-01-01 10:00:00")],
                    order_items=[item("O1", 1), item("O3", 1), item("O4", 1)])
    rows = {r["customer_unique_id"]: r for r in REGISTRY["customer_rfm"](t).collect()}
    assert set(rows) == {"U1", "U3"}                                # U2's order has no items
    assert rows["U1"]["recency_days"] == 90 and rows["U3"]["recency_days"] == 59
    assert rows["U1"]["recency"] == dt.datetime(2017, 1, 1, 10) and rows["U3"]["frequency"] == 1
