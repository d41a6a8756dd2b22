"""Distributed operators against brute force on small random frames."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vendora.operators.customer import interarrival_gaps
from vendora.operators.ranking import exact_percentiles, rank_desc, rank_desc_of, top_rank_sums, with_cell
from vendora.operators.trend import trend_by


def _values(seed=7, n=400):
    rnd = random.Random(seed)
    vals = [rnd.randint(-500, 5000) for _ in range(n)]
    vals += [42] * (n // 3)                      # one value holds a quarter of the rows
    vals += [None] * 7
    rnd.shuffle(vals)
    return vals


def _pct_x100(sorted_vals, pn):
    n = len(sorted_vals)
    pos = (n - 1) * pn
    lo, rem = pos // 100, pos % 100
    hi = lo + (1 if rem else 0)
    return 100 * sorted_vals[lo] + (sorted_vals[hi] - sorted_vals[lo]) * rem


@pytest.mark.parametrize("buckets", [1, 4, 4096])
def test_exact_percentiles_match_brute_force(spark, buckets):
    vals = _values()
    df = spark.createDataFrame([(v,) for v in vals], "v long")
    pts = {"p0": 0, "p10": 10, "p25": 25, "p50": 50, "p90": 90, "p99": 99, "p100": 100}
    got = exact_percentiles(df, "v", pts, buckets=buckets).first().asDict()
    s = sorted(v for v in vals if v is not None)
    assert {k: int(v) for k, v in got.items()} == {k: _pct_x100(s, p) for k, p in pts.items()}


def test_exact_percentiles_weighted_and_empty(spark):
    rows = [(5, 3), (1, 1), (9, 2), (None, 4)]
    df = spark.createDataFrame(rows, "v long, w long")
    got = exact_percentiles(df, "v", {"m": 50, "p90": 90}, weight_col="w").first()
    expanded = sorted([5] * 3 + [1] + [9] * 2)
    assert int(got["m"]) == _pct_x100(expanded, 50) and int(got["p90"]) == _pct_x100(expanded, 90)
    empty = spark.createDataFrame([], "v long")
    assert exact_percentiles(empty, "v", {"m": 50}).first()["m"] is None


def test_rank_desc_matches_sql_rank(spark):
    vals = _values(3, 200)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "id long, v long")
    got = {r["id"]: r["rk"] for r in rank_desc(df, "v", "rk", buckets=8).collect()}
    nulls = sum(v is None for v in vals)
    for i, v in enumerate(vals):
        want = 1 if v is None else 1 + nulls + sum(1 for w in vals if w is not None and w > v)
        assert got[i] == want


def test_rank_of_subset_and_top_sums(spark):
    vals = [100, 90, 90, 90, 50, 40, 40, 10, 5, 1]      # ties at ranks 2 and 6
    df = spark.createDataFrame([(f"s{i}", v) for i, v in enumerate(vals)], "k string, v long")
    sub = df.where(F.col("v").isin(90, 40))
    got = {r["k"]: r["rk"] for r in rank_desc_of(sub, df, "k", "v", "rk").collect()}
    assert set(got.values()) == {2, 6}
    s = top_rank_sums(df, "v", {"top1": ("rank_le", 1, 1), "top2": ("rank_le", 2, 1),
                                "f30": ("frac_le", 30, 100)}, buckets=3).first()
    assert int(s["top1"]) == 100 and int(s["top2"]) == 370 and int(s["total"]) == sum(vals)
    assert int(s["f30"]) == 370 and s["n_rows"] == 10     # rank <= 3: the three tied 90s are in


@pytest.mark.parametrize("cells", [1, 5, 60, None])
def test_interarrival_gaps_match_lag(spark, cells):
    rnd = random.Random(11)
    rows = []
    for person in ["hot"] * 60 + [f"p{i}" for i in range(30)]:
        day = rnd.randint(1, 28)
        rows.append((person, None if rnd.random() < 0.03 else
                     __import__("datetime").datetime(2017, rnd.randint(1, 12), day, rnd.randint(0, 23))))
    rows += [("hot", rows[0][1])] * 3                     # tied timestamps
    schema = T.StructType([T.StructField("p", T.StringType()), T.StructField("ts", T.TimestampNTZType())])
    df = spark.createDataFrame(rows, schema)
    got = Counter()
    for r in interarrival_gaps(df, "p", "ts", cells=cells).collect():
        got[(r["p"], None if r["gap_us"] is None else int(r["gap_us"]))] += r["w"]
    want = Counter()
    by = {}
    for p, t in rows:
        by.setdefault(p, []).append(t)
    for p, ts_ in by.items():
        seq = sorted([t for t in ts_ if t is not None]) + [t for t in ts_ if t is None]
        for a, b in zip(seq, seq[1:]):
            if a is None:
                continue
            want[(p, None if b is None else int((b - a).total_seconds() * 1_000_000))] += 1
    assert got == want


@pytest.mark.parametrize("bounded", [False, True])
def test_grouped_percentiles_match_per_group_brute_force(spark, bounded):
    rnd = random.Random(5)
    rows = [(g, rnd.randint(0, 300) if rnd.random() > 0.05 else None)
            for g in ["a"] * 120 + ["b"] * 40 + [None] * 30 + ["only_null"] * 0 for _ in [0]]
    rows += [("z", None), ("z", None)]
    df = spark.createDataFrame(rows, "g string, v long")
    got = {r["g"]: (r["m"], r["p9"]) for r in
           exact_percentiles(df, "v", {"m": 50, "p9": 90}, keys=["g"], buckets=3,
                             bounded_keys=bounded).collect()}
    want = {}
    for g in {r[0] for r in rows}:
        s = sorted(v for k, v in rows if k == g and v is not None)
        want[g] = (_pct_x100(s, 50), _pct_x100(s, 90)) if s else (None, None)
    assert {k: tuple(None if x is None else int(x) for x in v) for k, v in got.items()} == want


def test_buckets_follow_the_values_whatever_their_spread(spark):
    import vendora.operators.ranking as rk
    vals = [*range(20_000), 10**15]                     # one outlier, far away
    df = spark.createDataFrame([(v,) for v in vals], "v long")
    vb, offsets, _ = rk._bucketed(df, "v", 40, None, [], True)
    sizes = [r["n"] for r in vb.groupBy("b").count().withColumnRenamed("count", "n").collect()]
    assert len(sizes) == 40 and max(sizes) <= 2 * len(vals) / 40
    assert {(r["b"], r["bn"]) for r in offsets.collect()} == {(r["b"], r["n"]) for r in vb.groupBy("b").count().withColumnRenamed("count", "n").collect()}
    for count in (1, 7, None):
        got = rk.exact_percentiles(df, "v", {"p": 37, "m": 50, "z": 100}, buckets=count).first()
        assert [int(got[k]) for k in "pmz"] == [_pct_x100(vals, p) for p in (37, 50, 100)]


def test_decimals_are_exact_and_floats_refused(spark):
    from decimal import Decimal
    import vendora.operators.ranking as rk
    df = spark.createDataFrame([(Decimal(x),) for x in ("1.90", "2.90", "3.90")], "v decimal(10,2)")
    got = rk.exact_percentiles(df, "v", {"m": 50, "q": 25}, with_stats=True).first()
    assert (got["m"], got["q"], got["lo"], got["total"]) == (Decimal("290"), Decimal("240"), Decimal("1.90"), Decimal("8.70"))
    ranks = {str(r["v"]): r["rk"] for r in rk.rank_desc(df, "v", "rk").collect()}
    assert ranks == {"1.90": 3, "2.90": 2, "3.90": 1}
    with pytest.raises(TypeError):
        rk.exact_percentiles(df.selectExpr("cast(v as double) as v"), "v", {"m": 50})


def test_share_within_keys_and_bucket_table(spark):
    from vendora.operators.shares import bucket_table, share_of_total
    df = spark.createDataFrame([("a", "x", 1), ("a", "y", 3), ("b", "x", 5)], "g string, k string, n long")
    assert {(r["g"], r["k"]): r["s"] for r in share_of_total(df, "n", "s", keys=["g"]).collect()} == {
        ("a", "x"): 25.0, ("a", "y"): 75.0, ("b", "x"): 100.0}
    n = F.col("n")
    got = [tuple(r) for r in bucket_table(df, [(n < 2, "small"), (n < 4, "mid")], "big", n, "b", "rows", "pct", {"total": "n"}).collect()]
    assert got == [("small", 1, 1, 33.33), ("mid", 1, 3, 33.33), ("big", 1, 5, 33.33)]


def test_runs_follow_the_counted_rows(spark, monkeypatch):
    """A hundred times the rows of an entity make about a hundred times the runs."""
    from vendora.operators import customer
    kept = []
    monkeypatch.setattr(customer, "with_cell", lambda *a: kept.append(with_cell(*a)) or kept[-1])
    runs = {}
    for n in (2_000, 200_000):
        df = spark.range(n).selectExpr("'hot' as p", "timestamp_ntz'2017-01-01' + make_dt_interval(0, 0, 0, id) as ts")
        gaps = interarrival_gaps(df, "p", "ts", run=500)
        assert {(int(r["gap_us"]), r["n"]) for r in gaps.groupBy("gap_us").agg(F.sum("w").alias("n")).collect()} == {(1_000_000, n - 1)}
        runs[n] = kept[-1].groupBy("__at").count().count()
    assert 2 <= runs[2_000] <= 8 and 250 <= runs[200_000] <= 600


def test_gap_cells_follow_a_burst_and_a_late_event(spark):
    import datetime as dt
    import re as _re
    base = dt.datetime(2017, 1, 1)
    rows = [("hot", base + dt.timedelta(seconds=i)) for i in range(6000)] + [("hot", base + dt.timedelta(days=3000)), ("cold", base)]
    df = spark.createDataFrame(rows, T.StructType([T.StructField("p", T.StringType()), T.StructField("ts", T.TimestampNTZType())]))
    gaps = interarrival_gaps(df, "p", "ts", cells=30)
    got = Counter()
    for r in gaps.collect():
        got[int(r["gap_us"])] += r["w"]
    assert got == {1_000_000: 5999, (3000 * 86400 - 5999) * 1_000_000: 1}
    plan = gaps._jdf.queryExecution().executedPlan().toString()
    assert _re.search(r"Exchange hashpartitioning\(__cell", plan)


def test_distinct_counts_match_count_distinct(spark):
    from vendora.operators.shares import distinct_counts
    rows = [("a", 1, "x", 5), ("a", 1, "y", 1), ("a", 2, None, 2), ("b", None, "x", 3),
            (None, 3, "z", 4), (None, 3, "z", None)]
    df = spark.createDataFrame(rows, "g string, p long, q string, v long")
    got = {r["g"]: (r["np"], r["nq"], r["s"]) for r in
           distinct_counts(df, ["g"], {"np": "p", "nq": "q"}, {"s": "v"}).collect()}
    want = {}
    for g in {r[0] for r in rows}:
        sel = [r for r in rows if r[0] == g]
        vs = [r[3] for r in sel if r[3] is not None]
        want[g] = (len({r[1] for r in sel if r[1] is not None}), len({r[2] for r in sel if r[2] is not None}),
                   sum(vs) if vs else None)
    assert got == want
    one = distinct_counts(df, [], {"np": "p", "nq": "q"}).first()
    assert (one["np"], one["nq"]) == (3, 3)


def test_several_subset_ranks_in_one_pass(spark):
    from vendora.operators.ranking import ranks_desc_of
    rows = [("a", 10, 5), ("b", 10, None), ("c", 7, 9), ("d", 3, 9), ("e", None, 1)]
    df = spark.createDataFrame(rows, "k string, x long, y long")
    got = {r["k"]: (r["rx"], r["ry"]) for r in
           ranks_desc_of(df.where("k in ('a', 'c', 'e')"), df, "k", {"rx": "x", "ry": "y"}).collect()}

    def rank(col, v):
        vals = [r[col] for r in rows]
        if v is None:
            return 1
        return 1 + sum(1 for w in vals if w is None or w > v)
    want = {k: (rank(1, x), rank(2, y)) for k, x, y in rows if k in ("a", "c", "e")}
    assert got == want


def test_late_rate_rates_and_days(spark):
    import datetime as dt
    from vendora.operators.late import late_rate
    d = lambda n: dt.datetime(2017, 1, n)
    rows = [("a", "o1", d(5), d(3), 1), ("a", "o1", d(5), d(3), 2), ("a", "o2", d(2), d(3), 3), ("a", None, d(9), d(3), 4),
            ("b", "o3", None, d(3), 5), ("b", "o4", d(4), d(3), 6)]
    df = spark.createDataFrame(rows, T.StructType([T.StructField("g", T.StringType()), T.StructField("order_id", T.StringType()),
                                                   T.StructField("order_delivered_customer_date", T.TimestampNTZType()),
                                                   T.StructField("order_estimated_delivery_date", T.TimestampNTZType()),
                                                   T.StructField("x", T.LongType())]))
    got = {r["g"]: tuple(r)[1:] for r in late_rate(df, ["g"], sums=("x",)).collect()}
    assert got == {"a": (2, 1, 1, 50.0, 50.0, 2.0, 6), "b": (2, 1, 0, 50.0, 0.0, 1.0, 11)}
    one = df.where("x <> 2")
    assert late_rate(one, [], one_row_per_order=True).first()[:3] == (4, 2, 1)


def test_cohorts_trend_and_rfm_units(spark):
    import datetime as dt
    from tests.conftest import customer, item, make_tables, order
    from vendora.operators.customer import cohorts, new_vs_returning, rfm
    from vendora.operators.trend import trend_by
    t = make_tables(spark, customers=[customer("c1", "u1"), customer("c2", "u1"), customer("c3", "u2")],
                    orders=[order("o1", "c1", pts="2017-01-31 12:00:00"), order("o2", "c2", pts="2017-05-01 00:00:00"),
                            order("o3", "c3", pts="2017-02-01 06:00:00")],
                    order_items=[item("o1", 1), item("o2", 1, price=20), item("o3", 1)])
    po = t.customers.join(t.orders, "customer_id")
    ts = "order_purchase_timestamp"
    quarter = {r[0]: r[1] for r in cohorts(po, unit="quarter").collect()}
    assert quarter == {"u1": dt.datetime(2017, 1, 1), "u2": dt.datetime(2017, 1, 1)}
    by = {r[0]: tuple(r)[1:] for r in new_vs_returning(po, unit="quarter", out="q").collect()}
    assert by == {dt.datetime(2017, 1, 1): (2, 0, 2), dt.datetime(2017, 4, 1): (0, 1, 1)}
    trend = [tuple(r) for r in trend_by(po, ts, "month", F.count("order_id")).orderBy("period").collect()]
    assert trend == [(dt.datetime(2017, 1, 1), 1, None, 1, 1), (dt.datetime(2017, 2, 1), 1, 1, 2, 2), (dt.datetime(2017, 5, 1), 1, 1, 3, 3)]
    days = lambda **kw: {r["customer_unique_id"]: r["recency_days"] for r in rfm(t.customers, t.orders, t.items, **kw).collect()}
    assert days(day_mode="elapsed") == {"u1": 0, "u2": 88} and days(day_mode="calendar") == {"u1": 0, "u2": 89}
    assert days(day_mode="calendar", as_of=dt.datetime(2017, 5, 3)) == {"u1": 2, "u2": 91}


def test_master_frame_without_a_key_list(spark, duck):
    """The whole denormalised frame against the join chain written in SQL."""
    from tests.conftest import SMOKE
    from vendora.operators.master import master_orders
    from vendora.oracle import with_tables
    from vendora.sources.catalog import from_testdata
    got = master_orders(from_testdata(spark, SMOKE))
    money = [str(got.schema[c].dataType) for c in ("price", "freight_value", "payment_value")]
    assert all(m.startswith("DecimalType") for m in money)
    facts = got.agg(F.count(F.lit(1)), F.sum("price"), F.sum("freight_value"), F.sum("payment_value"), F.sum("review_score"),
                    F.count_if(F.col("category_english") == "Unknown"), F.count("seller_state"), F.count("customer_city")).first()
    want = duck.execute(with_tables("""
      SELECT count(*), sum(price), sum(freight_value), sum(payment_value), sum(review_score),
             count(*) FILTER (WHERE product_category_name_english IS NULL), count(seller_state), count(customer_city)
      FROM orders_m LEFT JOIN customers USING (customer_id) LEFT JOIN order_items USING (order_id)
      LEFT JOIN (FROM products LEFT JOIN product_category_translation USING (product_category_name)) USING (product_id)
      LEFT JOIN sellers USING (seller_id)
      LEFT JOIN (FROM order_payments WHERE payment_sequential = 1) USING (order_id) LEFT JOIN order_reviews USING (order_id)""")).fetchone()
    assert [float(x) for x in facts] == [float(x) for x in want]


@pytest.mark.parametrize("unit, starts", [("month", ["2016-11-01", "2016-12-01", "2017-01-01", "2017-02-01", "2017-03-01"]),
                                          ("week", ["2016-11-28", "2016-12-05", "2016-12-12"]), ("year", ["2015-01-01", "2016-01-01", "2017-01-01"]),
                                          ("quarter", ["2016-10-01", "2017-01-01", "2017-04-01"])])
def test_densified_trend_steps_by_the_calendar(spark, unit, starts):
    import datetime as dt
    days = [dt.datetime.fromisoformat(d) for d in starts]
    rows = [("a", days[0], 5), ("a", days[0] + dt.timedelta(hours=30), 2), ("a", days[-1], 9), ("b", days[1], 4), (None, days[-1], 1), ("a", None, 100)]
    df = spark.createDataFrame(rows, T.StructType([T.StructField("k", T.StringType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("v", T.LongType())]))
    got = {(r["k"], r["period"]): (r["value"], r["prev"], r["roll_sum"], r["roll_n"])
           for r in trend_by(df, "ts", unit, F.sum("v"), window=2, keys=["k"], dense=True, fill=0).collect()}
    want = {}
    for k in ("a", "b", None):
        value = [sum(v for kk, t, v in rows if kk == k and t is not None and d <= t < (days[i + 1] if i + 1 < len(days) else dt.datetime.max))
                 for i, d in enumerate(days)]
        for i, d in enumerate(days):
            want[k, d] = (value[i], value[i - 1] if i else None, sum(value[max(i - 1, 0):i + 1]), min(i + 1, 2))
    assert got == want
    # Not filled: an added period is NULL and does not count in the frames; not dense: it is skipped.
    plain = df.where("k = 'a'")
    empty = [r["value"] for r in trend_by(plain, "ts", unit, F.sum("v"), dense=True).orderBy("period").collect()]
    assert empty == [7, *[None] * (len(days) - 2), 9]
    assert [r["prev"] for r in trend_by(plain, "ts", unit, F.sum("v")).orderBy("period").collect()] == [None, 7]
    assert trend_by(df.where("false"), "ts", unit, F.sum("v"), keys=["k"], dense=True).count() == 0


def test_periods_without_start_stay_when_densified(spark):
    from vendora.operators.trend import densify
    df = spark.sql("select timestamp_ntz'2017-01-01' as m, 1 as v union all select timestamp_ntz'2017-03-01', 3 union all select null, 7")
    got = sorted(((r["m"] is None, r["m"].month if r["m"] else 0, r["v"]) for r in densify(df, "m", "month", {"v": -1}).collect()))
    assert got == [(False, 1, 1), (False, 2, -1), (False, 3, 3), (True, 0, 7)]


@pytest.mark.parametrize("buckets", [None, 1, 7])
def test_tail_sums_match_brute_force(spark, buckets):
    from decimal import Decimal
    from vendora.operators.ranking import tail_sums
    rnd = random.Random(8)
    rows = [(Decimal(rnd.randint(0, 400)) / 4 if rnd.random() > .1 else None, rnd.randint(0, 9), rnd.randint(0, 9) if rnd.random() > .3 else None) for _ in range(500)]
    df = spark.createDataFrame(rows, "v decimal(8,2), a int, b int")
    vals = sorted(r[0] for r in rows if r[0] is not None)
    for point in (0, 37, 90, 100):
        at = (len(vals) - 1) * point
        low, up = vals[at // 100], vals[min(at // 100 + (at % 100 > 0), len(vals) - 1)]
        limit = low + (up - low) * (at % 100) / 100
        over = [r for r in rows if r[0] is not None and r[0] >= limit]
        got = tail_sums(df, "v", point, sums=["a", "b"], buckets=buckets).first()
        assert got["n"] == len(over) and int(got["total"]) == sum(int(r[0] * 100) for r in over)
        assert (got["lo"], got["hi"]) == (int(min(r[0] for r in over) * 100), int(max(r[0] for r in over) * 100))
        assert (got["a"], got["b"]) == (sum(r[1] for r in over), sum(r[2] or 0 for r in over))
    none = tail_sums(df.where("false"), "v", 90, sums=["a"]).first()
    assert none["n"] == 0 and none["a"] is None


def test_branches_over_a_whole_fold_share_its_shuffle(spark):
    from vendora.operators.ranking import whole
    fold = whole(spark.range(100).selectExpr("id % 7 as k", "id as a", "-id as b").groupBy("k").agg(F.sum("a").alias("a"), F.sum("b").alias("b")))
    both = fold.select("k", "a").join(fold.select("k", F.col("b")), "k")
    assert both.count() == 7
    plan = fold.agg(F.max("a").alias("x")).crossJoin(fold.agg(F.min("b").alias("x2")))
    plan.collect()
    final = plan._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "ReusedExchange" in final
