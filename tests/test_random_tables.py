"""Every report vs its oracle on seeded random marketplace tables.

Unlike the testdata adapter, these tables put NULLs in most columns, carry
orphan items, a customer who owns a third of the orders, a seller holding a
third of the item lines, orders without items and an order with 30 reviews.
Spark reads the tables from Parquet; DuckDB runs each oracle's report body on
the same Parquet files.
"""

from __future__ import annotations

import datetime as dt
import random
from decimal import Decimal

import pytest

import __spark_entry__ as se
from tests.test_parity import _digest
from vendora.oracle import body_of
from vendora.plans import REGISTRY
from vendora.sources.catalog import from_parquet
from vendora.sources.schemas import TABLES

STATUSES = ["delivered"] * 17 + ["shipped", "canceled", "invoiced"]
STATES = ["SP", "RJ", "MG", "BA", "PR", None]


def _m(rnd, lo, hi, p_null=0.0):
    if rnd.random() < p_null:
        return None
    return Decimal(rnd.randint(int(lo * 100), int(hi * 100))) / 100


def _rows(seed=20):
    rnd = random.Random(seed)
    t0 = dt.datetime(2017, 1, 1)
    customers = [(f"C{i}", "U_hot" if i % 3 == 0 else f"U{i // 2}", f"{i % 90:05d}",
                  rnd.choice(["sao paulo", "rio", "campinas", None]), rnd.choice(STATES)) for i in range(1500)]
    sellers = [(f"S{i}", f"{i:05d}", f"city{i % 4}", rnd.choice(STATES)) for i in range(30)]
    translation = [(f"cat{i}", f"cat_en_{i}") for i in range(9)]           # cat9 untranslated
    products = [(f"P{i}", None if rnd.random() < 0.05 else f"cat{rnd.randint(0, 9)}",
                 rnd.randint(5, 60), rnd.randint(50, 600), rnd.randint(1, 5),
                 None if rnd.random() < 0.03 else rnd.randint(100, 5000),
                 rnd.randint(10, 60), rnd.randint(2, 40), rnd.randint(10, 50)) for i in range(150)]
    orders, items, payments, reviews = [], [], [], []
    for i in range(1500):
        status = rnd.choice(STATUSES)
        pts = None if rnd.random() < 0.02 else t0 + dt.timedelta(seconds=rnd.randint(0, 600 * 86400))
        if pts is not None and i % 97 == 0:
            pts = t0 + dt.timedelta(days=30)                                   # tied purchase times
        delivered = (pts + dt.timedelta(hours=rnd.randint(30, 900))
                     if pts is not None and status == "delivered" and rnd.random() < 0.95 else None)
        est = (dt.datetime.combine(pts.date(), dt.time()) + dt.timedelta(days=rnd.randint(8, 35))
               if pts is not None else None)
        carrier = pts + dt.timedelta(hours=rnd.randint(20, 100)) if delivered is not None and rnd.random() < 0.9 else None
        appr = pts + dt.timedelta(hours=rnd.randint(0, 40)) if pts is not None and rnd.random() < 0.97 else None
        orders.append((f"O{i}", f"C{i}", status, pts, appr, carrier, delivered, est))
        total = Decimal(0)
        for n in range(1, (0 if i % 10 == 0 else rnd.randint(1, 4)) + 1):
            seller = "S0" if rnd.random() < 0.34 else ("S99" if rnd.random() < 0.01 else f"S{rnd.randint(1, 29)}")
            price, freight = _m(rnd, 1, 500, 0.01), _m(rnd, 0, 40, 0.01)
            items.append((f"O{i}", n, f"P{rnd.randint(0, 149)}", seller, pts, price, freight))
            total += (price or 0) + (freight or 0)
        if rnd.random() < 0.9:
            payments.append((f"O{i}", 1, rnd.choice(["credit_card", "boleto"]), rnd.randint(1, 8),
                             total + (Decimal("1.00") if i % 50 == 0 else 0)))
        n_rev = 30 if i == 7 else (0 if rnd.random() < 0.15 else (2 if rnd.random() < 0.05 else 1))
        for r in range(n_rev):
            score = None if rnd.random() < 0.03 else rnd.randint(1, 5)
            msg = rnd.choice([None, "  ", "nice", "bad"])
            created = pts + dt.timedelta(days=20) if pts else None
            reviews.append((f"R{i}_{r}", f"O{i}", score, None, msg, created, created))
    geolocation = [(f"{i:05d}", Decimal(i) / 10, Decimal(-i) / 10, f"city{i}", "SP") for i in range(20)]
    return {"customers": customers, "geolocation": geolocation, "sellers": sellers,
            "product_category_translation": translation, "products": products, "orders": orders,
            "order_items": items, "order_payments": payments, "order_reviews": reviews}


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    import duckdb
    root = tmp_path_factory.mktemp("random_tables")
    for name, rows in _rows().items():
        spark.createDataFrame(rows, TABLES[name]).coalesce(2).write.parquet(str(root / name))
    con = duckdb.connect()
    for name in TABLES:
        view = "orders_m" if name == "orders" else name
        con.execute(f"CREATE VIEW {view} AS SELECT * FROM read_parquet('{root}/{name}/*.parquet')")
    return from_parquet(spark, str(root)), con


@pytest.mark.parametrize("key", sorted(REGISTRY))
def test_report_matches_oracle_on_random_tables(stored, key):
    tables, con = stored
    got = REGISTRY[key](tables).toPandas()
    want = con.execute(body_of(se.oracle_sql()[key])).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want), (len(got), len(want))
    assert _digest(got) == _digest(want)
