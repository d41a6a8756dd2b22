"""Exact rounding and calendar expressions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tests.conftest import ts
from vendora.functions import (calendar_days_between, day_name_padded, dow_sunday0, elapsed_days, month_start,
                               month_year_label, pct, round_div, whole_days_elapsed)


def test_round_div_half_away_from_zero(spark):
    cases = [(1005, 1000, 2, 1.01), (25, 10, 0, 3.0), (-25, 10, 0, -3.0), (1, 3, 2, 0.33), (2, 3, 2, 0.67),
             (-1, 8, 2, -0.13), (7, 0, 2, None), (0, 5, 1, 0.0)]
    df = spark.createDataFrame([(n, d) for n, d, _, _ in cases], "n long, d long")
    got = df.select(*[round_div(F.lit(n), F.lit(d), s).alias(f"c{i}") for i, (n, d, s, _) in
                      enumerate(cases)]).first()
    assert [got[f"c{i}"] for i in range(len(cases))] == [w for *_, w in cases]
    assert df.limit(1).select(pct(F.lit(1), F.lit(8)).alias("p")).first()["p"] == 12.5


def test_calendar_semantics(spark):
    schema = T.StructType([T.StructField("a", T.TimestampNTZType()), T.StructField("b", T.TimestampNTZType())])
    df = spark.createDataFrame([(ts("2017-01-01 00:01:00"), ts("2017-01-02 00:00:00"))], schema)
    r = df.select(whole_days_elapsed("a", "b").alias("w"), calendar_days_between("a", "b").alias("c"),
                  elapsed_days("a", "b", 3).alias("d"), dow_sunday0("a").alias("dow"),
                  day_name_padded("a").alias("dn"), month_year_label("a").alias("ml"),
                  month_start("b").alias("m")).first()
    assert (r["w"], r["c"]) == (0, 1)                  # 23h59: no full day, one calendar day (S7)
    assert r["d"] == 0.999
    assert r["dow"] == 0 and r["dn"] == "Sunday   "   # Sunday = 0, padded to 9 (S10, S11)
    assert r["ml"] == "January   2017"
    assert r["m"] == ts("2017-01-01 00:00:00")


def test_no_session_zone_dependence(spark):
    schema = T.StructType([T.StructField("a", T.TimestampNTZType()), T.StructField("b", T.TimestampNTZType())])
    df = spark.createDataFrame([(ts("2017-03-11 12:00:00"), ts("2017-03-13 12:00:00"))], schema)
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")   # DST starts 2017-03-12
        assert df.select(elapsed_days("a", "b", 2).alias("d")).first()["d"] == 2.0
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
