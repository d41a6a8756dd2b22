"""Shared fixtures: one local Spark session, DuckDB views over sf0.001,
and a builder for small hand-made marketplace tables."""

from __future__ import annotations

import datetime as dt
import os
import sys
from decimal import Decimal

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from vendora.session import get_session  # noqa: E402
from vendora.sources.catalog import Tables  # noqa: E402
from vendora.sources.schemas import TABLES  # noqa: E402

SMOKE = "/root/testdata/sf0.001"
RAW = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]


@pytest.fixture(scope="session")
def spark():
    s = get_session("local[4]", app="vendora-tests", shuffle_partitions=4,
                    extra={"spark.ui.showConsoleProgress": "false"})
    yield s


@pytest.fixture(scope="session")
def duck():
    import duckdb
    con = duckdb.connect()
    for t in RAW:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMOKE}/{t}.parquet')")
    return con


def ts(s: str) -> dt.datetime:
    return dt.datetime.fromisoformat(s)


def money(x) -> Decimal:
    return Decimal(str(x)).quantize(Decimal("0.01"))


def make_tables(spark, **rows) -> Tables:
    """Nine tables from lists of tuples (missing tables are empty)."""
    frames = {name: spark.createDataFrame(rows.get(name, []), schema) for name, schema in TABLES.items()}
    return Tables.from_dict(frames)


def order(oid, cid, status="delivered", pts="2017-01-01 10:00:00", appr=None, carrier=None,
          delivered=None, estimated=None):
    f = (lambda s: ts(s) if s else None)
    return (oid, cid, status, f(pts), f(appr), f(carrier), f(delivered), f(estimated))


def item(oid, n, pid="P1", sid="S1", price=10, freight=1):
    return (oid, n, pid, sid, ts("2017-01-05 00:00:00"),
            money(price) if price is not None else None, money(freight) if freight is not None else None)


def customer(cid, uid, city="city", state="SP"):
    return (cid, uid, "00000", city, state)


def review(rid, oid, score, msg=None):
    return (rid, oid, score, None, msg, ts("2017-02-01 00:00:00"), ts("2017-02-02 00:00:00"))
