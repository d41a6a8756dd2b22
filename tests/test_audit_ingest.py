"""Audits find planted faults; CSV ingest handles BOM, quoted newlines and bad rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tests.conftest import item, make_tables, order, review
from vendora.operators.audit import audit_foreign_key, audit_nulls, audit_rules, audit_unique, coverage
from vendora.sources import ingest
from vendora.sources.catalog import from_parquet


def test_audits_find_planted_faults(spark):
    t = make_tables(spark, orders=[order("O1", "C1"), order("O1", "C1"), order("O2", "C2")],
                    order_items=[item("O1", 1), item("O1", 1), item("O9", 1, freight=-1)],
                    order_reviews=[review("R1", "O1", 6), review("R2", "O2", 5)])
    u = audit_unique(t.items, ["order_id", "order_item_id"]).first()
    assert (u["rows"], u["distinct_keys"], u["duplicate_count"]) == (3, 2, 1)
    assert audit_foreign_key(t.items, "order_id", t.orders, "order_id").count() == 1
    rules = {r["rule"]: r["violations"] for r in audit_rules(t.reviews, {
        "score_out_of_range": ~F.col("review_score").between(1, 5)}).collect()}
    assert rules == {"score_out_of_range": 1}
    neg = audit_rules(t.items, {"negative_freight": F.col("freight_value") < 0}).first()
    assert neg["violations"] == 1 and neg["total_rows"] == 3
    nulls = {r["column_name"]: (r["null_count"], r["null_pct"])
             for r in audit_nulls(t.orders, ["order_approved_at", "order_id"]).collect()}
    assert nulls == {"order_approved_at": (3, 100.0), "order_id": (0, 0.0)}
    cov = coverage(t.orders, {"items": t.items, "reviews": t.reviews}, "order_id").first()
    assert (cov["total"], cov["with_items"], cov["with_reviews"], cov["with_all"]) == (2, 1, 2, 1)


def test_csv_ingest_and_parquet_round_trip(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    (src / "order_reviews.csv").write_bytes(
        "﻿review_id,order_id,review_score,review_comment_title,review_comment_message,"
        "review_creation_date,review_answer_timestamp\n"
        'R1,O1,5,,"line one\nline two, with ""quotes""",2018-01-01 00:00:00,2018-01-02 10:11:12\n'
        "R2,O2,not_a_number,,ok,2018-01-03 00:00:00,2018-01-04 00:00:00\n".encode("utf-8"))
    (src / "product_category_translation.csv").write_bytes(
        "﻿product_category_name,product_category_name_english\nbeleza_saude,health_beauty\n".encode())
    rv = ingest.read_csv(spark, str(src / "order_reviews.csv"), "order_reviews",
                         bad_records_column="_corrupt").orderBy("review_id").collect()
    assert rv[0]["review_comment_message"] == 'line one\nline two, with "quotes"'
    assert rv[0]["review_answer_timestamp"].isoformat() == "2018-01-02T10:11:12"
    assert rv[1]["review_score"] is None and rv[1]["_corrupt"] is not None
    dropped = ingest.read_csv(spark, str(src / "order_reviews.csv"), "order_reviews", mode="DROPMALFORMED")
    assert [r["review_id"] for r in dropped.collect()] == ["R1"]
    tr = ingest.read_csv(spark, str(src / "product_category_translation.csv"), "product_category_translation")
    assert tr.columns[0] == "product_category_name" and tr.first()[0] == "beleza_saude"
    t = make_tables(spark, orders=[order("O1", "C1")])
    root = str(tmp_path / "tables")
    ingest.write_tables(t.as_dict(), root)
    back = from_parquet(spark, root)
    assert back.orders.count() == 1
    assert [(f.name, f.dataType) for f in back.orders.schema] == [(f.name, f.dataType) for f in t.orders.schema]


def test_cli_writes_tables_and_reports(spark, tmp_path):
    from vendora import cli
    tables, out = str(tmp_path / "tables"), str(tmp_path / "reports")
    assert cli.main(["--testdata", "/root/testdata/sf0.001", "--write-tables", tables,
                     "--out", out, "--reports", "revenue_monthly_trend,delivery_headline"]) == 0
    back = spark.read.parquet(f"{out}/revenue_monthly_trend")
    assert back.count() > 0 and "rolling_3m_avg" in back.columns
    assert spark.read.parquet(f"{out}/delivery_headline").count() == 1
    assert cli.main(["--parquet", tables, "--out", out + "2", "--reports", "validate_row_counts"]) == 0
    assert spark.read.parquet(f"{out}2/validate_row_counts").count() == 9


def test_read_source_folder_with_file_mapping(spark, tmp_path):
    from vendora.sources.schemas import TABLES
    for name, schema in TABLES.items():
        header = ",".join(schema.fieldNames())
        fname = "my_orders.csv" if name == "orders" else f"{name}.csv"
        body = "O1,C1,delivered,2018-01-01 10:00:00,,,,\n" if name == "orders" else ""
        (tmp_path / fname).write_text(header + "\n" + body)
    tables = ingest.read_source_folder(spark, str(tmp_path), files={"orders": "my_orders.csv"})
    assert set(tables) == set(TABLES)
    o = tables["orders"].collect()
    assert len(o) == 1 and o[0]["order_status"] == "delivered" and o[0]["order_approved_at"] is None
    assert tables["order_items"].count() == 0
