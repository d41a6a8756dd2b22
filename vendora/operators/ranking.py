"""Distributed exact percentiles and global ranks (operators P7, P8).

``PERCENTILE_CONT`` and ``RANK() OVER (ORDER BY x)`` over a whole table are,
written literally, one-task operations in Spark (an object aggregate or an
``Exchange SinglePartition`` before the window). Both only need, for every
distinct value ``v``, how many rows sort at or before it. That is computed
here without ever sending the data through one task:

1. ``groupBy(v).count()`` - duplicates collapse map-side, so a value held by a
   third of all rows is one row after the partial aggregate;
2. the distinct values are cut into ranges that hold about equally many of them,
   wherever they lie (one per ``VALUES`` of them, ``BUCKETS`` at most): the cuts are taken from a sample of the
   distinct values chosen by their hash, so an outlier or a dense spot moves the
   cuts and not the load, and every branch of a plan and every retry finds the
   same cuts. Bucket totals (one row per bucket) give each bucket its offset;
3. a window *partitioned by bucket* gives the running count inside a bucket
   (for percentiles only in the few buckets that hold a wanted rank).

The distinct values with their counts are the only thing read: minimum, maximum,
row count and total come from them too, so the input is read once. Values must
be integers or decimals (scaled exactly); floats are refused. Every step is
lazy: no action runs while the plan is built.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vendora.functions.exact import BIG, idiv

BUCKETS = 1024   # most value ranges; the cuts ride with each row that is placed, so they are few
VALUES = 1 << 18  # distinct values that are worth a range of their own
OVERSAMPLE = 16  # sampled values per cut: ranges differ by a quarter or so in size
FAN = 16         # cuts are looked up in steps of at most FAN comparisons


def _join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], small: bool) -> DataFrame:
    """Join on ``keys`` treating NULL as a value (a NULL group is a group, as in
    GROUP BY). ``small`` marks a right side bounded by construction (broadcast);
    otherwise AQE decides from its measured size."""
    right = F.broadcast(right) if small else right
    if not keys:
        return left.crossJoin(right)
    r = right.select(*[F.col(k).alias(f"__r_{k}") for k in keys],
                     *[c for c in right.columns if c not in keys])
    cond = None
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"__r_{k}"))
        cond = c if cond is None else cond & c
    return left.join(r, cond).drop(*[f"__r_{k}" for k in keys])


def _scale(df: DataFrame, value_col: str) -> int:
    """Decimal places of the value column; floats have no exact order statistics."""
    kind = df.select(value_col).schema[0].dataType
    if isinstance(kind, T.DecimalType):
        return kind.scale
    if isinstance(kind, T.IntegralType):
        return 0
    raise TypeError(f"{value_col}: integers or decimals are needed, not {kind.simpleString()}")


def _units(c: Column, scale: int) -> Column:
    """In units of the last place, as a long."""
    return (c * F.lit(10 ** scale).cast(BIG) if scale else c).cast("long")


def _unscaled(c: Column, scale: int) -> Column:
    return (c / F.lit(10 ** scale).cast(BIG)).cast(f"decimal(38,{scale})") if scale else c


def whole(fold: DataFrame) -> DataFrame:
    """``fold`` with a filter that is always true and reads all its columns: a
    branch that needs a few of them does not prune the others, so all branches
    over the fold keep the same shuffle, and it runs once."""
    return fold.where(F.hash(*[F.col(c) for c in fold.columns]) >= -(1 << 31))


def chosen_by_hash(share: Column, *values: Column) -> Column:
    """Whether a distinct value belongs to the sample that cuts are taken from,
    by its hash alone: about ``share`` of them do."""
    return F.pmod(F.xxhash64(*values, F.lit("cut")), F.lit(1 << 53)).cast("double") / float(1 << 53) < share


def every_cut(sample: Column, most: int | None = None) -> Column:
    """Of a sorted sample one value in ``OVERSAMPLE``, or fewer: ``most`` in all."""
    step = F.lit(OVERSAMPLE)
    if most:
        step = F.greatest(step, F.ceil(F.size(sample) / most).cast("int"))
    return F.filter(sample, lambda x, i: (i + 1) % step == 0)


def spaced_cuts(sample: Column, count: int) -> Column:
    """``count - 1`` evenly spaced values of a sorted sample (repeated if it is
    smaller, which only leaves buckets empty)."""
    at = F.transform(F.sequence(F.lit(1), F.lit(max(count - 1, 1))),
                     lambda i: F.get(sample, F.floor(i * F.size(sample) / float(count)).cast("int")))
    return F.filter(at, lambda x: x.isNotNull()) if count > 1 else F.slice(sample, 1, 0)


def _every(n: int):
    return lambda x, i: i % n == 0


def cut_levels(cuts: Column) -> list[Column]:
    """The cuts, every FAN-th and every FAN squared-th of them."""
    return [cuts, *(F.filter(cuts, _every(n)) for n in (FAN, FAN * FAN))]


def with_cell(df: DataFrame, value: str, levels: Sequence[str], out: str) -> DataFrame:
    """Add ``out``: how many cuts are at or below column ``value``, from the
    coarsest level down (one column per step, so that no step is computed twice)."""
    def below(level):
        return F.size(F.filter(level, lambda c: c <= F.col(value)))
    df = df.withColumn(out, below(F.col(levels[-1])))
    for level in reversed(levels[:-1]):
        block = F.greatest(F.col(out) - 1, F.lit(0)) * FAN
        df = df.withColumn(out, F.when(F.col(out) == 0, F.lit(0)).otherwise(block + below(F.slice(F.col(level), block + 1, FAN))))
    return df.withColumn(out, F.col(out).cast("long"))


def _bucketed(df: DataFrame, value_col: str, buckets: int | None, weight_col: str | None,
              keys: list[str], small: bool, sums: Sequence[str] = ()):
    """Distinct values with multiplicity, sums of further measures and bucket; per
    bucket its rows, those before it (``off``) and in the group (``n``); stats.

    The NULL value keeps a row of its own with count 0 (a filter on the value would
    be pushed below the fold and keep the branches from sharing it; one on the
    count is not)."""
    wt = F.col(weight_col).cast("long") if weight_col else F.lit(1).cast("long")
    scale = _scale(df, value_col)
    v = _units(F.col(value_col), scale)
    folded = whole(df.select(*keys, v.alias("v"), wt.alias("__wt"), *sums).groupBy(*keys, "v").agg(
        F.sum("__wt").alias("__n"), *[F.sum(c).alias(c) for c in sums]))
    known = F.col("v").isNotNull()
    vc = folded.select(*keys, "v", *sums, F.when(known, F.col("__n")).otherwise(F.lit(0).cast("long")).alias("c"),
                       F.when(~known, F.col("__n")).alias("z"))
    # Cuts: the distinct values whose hash is smallest, in order, evenly spaced.
    if buckets is None:
        sampled = folded.groupBy(*keys).agg(F.sort_array(F.collect_list(
            F.when(chosen_by_hash(F.lit(OVERSAMPLE / VALUES), F.col("v")), F.col("v")))).alias("__s"))
        sampled = sampled.withColumn("__s", every_cut(F.col("__s"), BUCKETS))
    else:
        share = F.lit(float(buckets * OVERSAMPLE)) / F.greatest(F.col("__d"), F.lit(1))
        counted = folded.groupBy(*keys).agg(F.count("v").alias("__d"))
        sampled = _join_on(folded, counted, keys, small=small).groupBy(*keys).agg(
            F.sort_array(F.collect_list(F.when(chosen_by_hash(share, F.col("v")), F.col("v")))).alias("__s"))
        sampled = sampled.withColumn("__s", spaced_cuts(F.col("__s"), buckets))
    levels = ["__c0", "__c1", "__c2"]
    cuts = sampled.select(*keys, *[c.alias(n) for c, n in zip(cut_levels(F.col("__s")), levels, strict=True)])
    vb = with_cell(_join_on(vc, cuts, keys, small=small), "v", levels, "b").drop(*levels)
    # One row per bucket, at most BUCKETS a group, so the windows over them are bounded.
    per_bucket = vb.groupBy(*keys, "b").agg(
        F.sum("c").alias("bn"), F.sum("z").alias("bz"), F.min("v").alias("blo"), F.max("v").alias("bhi"),
        F.count("v").alias("bd"), F.sum(F.col("v").cast(BIG) * F.col("c")).alias("bt"))
    group = Window.partitionBy(*keys)
    before = group.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select(*keys, "b", "bn", F.coalesce(F.sum("bn").over(before), F.lit(0)).alias("off"),
                                F.sum("bn").over(group).alias("n"))
    stats = per_bucket.groupBy(*keys).agg(
        F.min("blo").alias("lo"), F.max("bhi").alias("hi"), F.coalesce(F.sum("bd"), F.lit(0)).alias("distinct"),
        F.coalesce(F.sum("bn"), F.lit(0)).alias("n"), F.coalesce(F.sum("bz"), F.lit(0)).alias("nulls"), F.sum("bt").alias("total"))
    return vb, offsets, stats


def _running(vb: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with value <= v inside v's bucket (window partitioned by bucket)."""
    w = Window.partitionBy(*keys, "b").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    return vb.withColumn("in_b", F.sum("c").over(w))


def value_cumulative(df: DataFrame, value_col: str, buckets: int | None = None,
                     weight_col: str | None = None, keys: Sequence[str] = (),
                     bounded_keys: bool = False):
    """Cumulative distribution of an integral column, per group of ``keys``.

    Returns ``(cum, stats)``. ``cum`` has one row per group and distinct
    non-NULL value: ``v`` (long), ``c`` (rows holding v), ``le`` (rows of the
    group with value <= v). ``stats`` has one row per group: ``n`` (non-NULL
    rows), ``nulls``, ``lo``, ``hi``, ``distinct``. With ``weight_col`` each
    input row stands for that many rows. Decimal values are in units of their
    last place. ``buckets`` sets the bucket count (default ``BUCKETS``).
    ``bounded_keys`` declares that the groups are few (e.g. a stack of a known
    number of columns), so per-group frames may be broadcast.
    """
    keys = list(keys)
    small = not keys or bounded_keys
    vb, offsets, stats = _bucketed(df, value_col, buckets, weight_col, keys, small)
    cum = (_join_on(_running(vb.where("c > 0"), keys), offsets.select(*keys, "b", "off"), [*keys, "b"], small=small)
           .select(*keys, "v", "c", (F.col("off") + F.col("in_b")).alias("le")))
    return cum, stats


def _located(vb: DataFrame, offsets: DataFrame, points: Sequence[int], den: int,
             keys: list[str], small: bool) -> DataFrame:
    """(keys, k, rem, v): the values at the lower (k = 2 i) and upper (2 i + 1) rank
    of point i. Only the buckets that hold a wanted rank are sorted."""
    wanted = F.array(*[F.struct(F.lit(k).alias("i"), F.lit(int(p)).cast("long").alias("p")) for k, p in enumerate(points)])
    pos = (F.col("n") - 1) * F.col("t.p")
    rows = (offsets.where("n > 0").select(*keys, "b", "off", "bn", "n", F.explode(wanted).alias("t"))
            .select(*keys, "b", "off", "bn", "t.i", idiv(pos, den).alias("r"), (pos % den).alias("rem")))
    ends = F.array(*[F.struct((F.col("i") * 2 + up).alias("k"), (F.col("r") + (F.when(F.col("rem") > 0, up).otherwise(0)) - F.col("off")).alias("local"), "rem")
                     for up in (0, 1)])
    targets = (rows.select(*keys, "b", "bn", F.explode(ends).alias("e")).where((F.col("e.local") >= 0) & (F.col("e.local") < F.col("bn")))
               .groupBy(*keys, "b").agg(F.collect_list("e").alias("__t")))   # <= 2 * points a group
    cand = _running(_join_on(vb.where("c > 0"), targets, [*keys, "b"], small=small), keys)
    # Local rank falls on value v when in_b - c <= local < in_b.
    mine = F.filter("__t", lambda e: (e["local"] >= F.col("in_b") - F.col("c")) & (e["local"] < F.col("in_b")))
    return cand.select(*keys, "v", F.explode(mine).alias("e")).select(*keys, "v", "e.k", "e.rem")


def _interpolated(i: int, den: int) -> Column:
    """Aggregate over ``_located``: percentile i times ``den``, in units of the
    value's last place."""
    lo, hi = (F.max(F.when(F.col("k") == 2 * i + up, F.col("v"))) for up in (0, 1))
    rem = F.max(F.when(F.col("k") == 2 * i, F.col("rem")))
    return (lo.cast(BIG) * den + (hi - lo).cast(BIG) * rem).cast(BIG)


def exact_percentiles(df: DataFrame, value_col: str, points: dict[str, int],
                      den: int = 100, buckets: int | None = None,
                      weight_col: str | None = None, keys: Sequence[str] = (),
                      with_stats: bool = False, bounded_keys: bool = False) -> DataFrame:
    """``PERCENTILE_CONT(pn/den) WITHIN GROUP (ORDER BY value_col)`` for each point.

    One row per group of ``keys`` (one row in all when there are none, even
    for empty input); column ``name`` holds the exact percentile multiplied by
    ``den`` (a decimal with the input's scale), NULL when the group has no non-NULL value.
    Interpolation is linear between ranks floor((n-1)p) and ceil((n-1)p), as
    SQL defines it; it is done in integers, so there is no double rounding.

    Only the buckets that hold a wanted rank (at most two per point) are
    sorted: bucket totals locate the ranks, a broadcast join keeps those
    buckets, and the running count runs over them alone.

    ``with_stats`` adds the group's ``n`` (non-NULL rows), ``nulls``, ``lo``
    (min), ``hi`` (max) and ``total`` (exact sum, decimal(38,0)) from the same
    pass, so a report needing mean/min/max too reads its input once.
    ``bounded_keys`` declares few groups (per-group frames are then broadcast).
    """
    keys = list(keys)
    small = not keys or bounded_keys
    scale = _scale(df, value_col)
    vb, offsets, stats = _bucketed(df, value_col, buckets, weight_col, keys, small)
    hit = _located(vb, offsets, list(points.values()), den, keys, small)
    aggs = [_unscaled(_interpolated(i, den), scale).alias(name) for i, name in enumerate(points)]
    if scale:
        stats = stats.withColumns({c: _unscaled(F.col(c).cast(BIG), scale) for c in ("lo", "hi", "total")})
    extra = ["n", "nulls", "lo", "hi", "total"] if with_stats else []
    if not keys:
        out = hit.agg(*aggs)
        return out.crossJoin(F.broadcast(stats.select(*extra))) if extra else out
    # Groups whose values are all NULL still get a row (with NULL percentiles).
    got = hit.groupBy(*keys).agg(*aggs)
    g = got.select(*[F.col(k).alias(f"__g_{k}") for k in keys], *points)
    cond = None
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"__g_{k}"))
        cond = c if cond is None else cond & c
    return stats.select(*keys, *extra).join(g, cond, "left").drop(*[f"__g_{k}" for k in keys])


def rank_desc(df: DataFrame, value_col: str, out: str, buckets: int | None = None) -> DataFrame:
    """Add ``RANK() OVER (ORDER BY value_col DESC)`` to every row of ``df``.

    rank = 1 + (rows with a larger value) + (rows with NULL; they sort first
    in a descending order, as in PostgreSQL). Ties share a rank.
    """
    scale = _scale(df, value_col)
    cum, stats = value_cumulative(df, value_col, buckets)
    ranks = (cum.crossJoin(F.broadcast(stats.select("n", "nulls")))
             .select(F.col("v").alias("__v"),
                     (F.col("n") - F.col("le") + F.col("nulls") + 1).alias(out)))
    v = (F.col(value_col) * F.lit(10 ** scale).cast(BIG) if scale else F.col(value_col)).cast("long")
    joined = df.join(ranks, v == F.col("__v"), "left").drop("__v")
    return joined.withColumn(out, F.coalesce(F.col(out), F.lit(1)).cast("int"))


def rank_desc_of(subset: DataFrame, population: DataFrame, key: str, value_col: str,
                 out: str) -> DataFrame:
    """Global descending rank of ``value_col`` for a few rows (``subset``)."""
    return ranks_desc_of(subset, population, key, {out: value_col})


def ranks_desc_of(subset: DataFrame, population: DataFrame, key: str,
                  ranks: dict[str, str], buckets: int | None = None) -> DataFrame:
    """Global descending ranks (``RANK() OVER (ORDER BY col DESC)``) for a few
    rows, e.g. a top-k list; ``ranks`` maps an output name to a value column
    (integers or decimals). ``key`` names the rows of ``subset``.

    rank = 1 + population rows with a strictly larger value (NULL counts as
    larger, as it sorts first descending), read from the cumulative counts of the
    values (``value_cumulative``), which the subset's values meet by an equi join:
    no rows are compared with each other. The subset is broadcast (its size is the
    k of a top-k report). Where it is taken from ``population`` itself, both read
    one fold.
    """
    cols = list(ranks.values())
    scales = [_scale(population, c) for c in cols]

    def stacked(df: DataFrame, *more: Column) -> DataFrame:
        each = F.explode(F.array(*[F.struct(F.lit(i).alias("c"), _units(F.col(c), scale).alias("v"))
                                   for i, (c, scale) in enumerate(zip(cols, scales, strict=True))]))
        return df.select(*more, each.alias("e")).select(*[f"`{m}`" for m in ["__k"] if more], F.col("e.c").alias("__c"), F.col("e.v").alias("__v"))
    cum, stats = value_cumulative(stacked(whole(population)), "__v", buckets, keys=["__c"], bounded_keys=True)
    wanted = stacked(subset, F.col(key).alias("__k")).withColumnRenamed("__c", "__w")
    placed = (cum.join(F.broadcast(wanted), (F.col("__c") == F.col("__w")) & (F.col("v") == F.col("__v")))
              .select("__k", "__w", "le"))
    sizes = stats.select(F.col("__c").alias("__w"), "n", "nulls")
    counted = (placed.join(F.broadcast(sizes), "__w").groupBy("__k").agg(*[
        F.max(F.when(F.col("__w") == i, F.col("n") - F.col("le") + F.col("nulls") + 1)).alias(f"__a{i}") for i in range(len(cols))]))
    out = subset.join(F.broadcast(counted), F.col(key) == F.col("__k"), "left")
    for i, name in enumerate(ranks):
        out = out.withColumn(name, F.coalesce(F.col(f"__a{i}"), F.lit(1)).cast("int"))
    return out.drop("__k", *[f"__a{i}" for i in range(len(cols))])


def tail_sums(df: DataFrame, value_col: str, point: int, den: int = 100, sums: Sequence[str] = (),
              buckets: int | None = None) -> DataFrame:
    """Totals of the rows whose value is at or above ``PERCENTILE_CONT(point /
    den)``: one row with ``n`` (rows), ``total``, ``lo`` and ``hi`` of the value (in
    units of its last place) and the sum of each column of ``sums``.

    Threshold and totals come from one fold to distinct values, which carries the
    sums of the other measures along; rows are not read again.
    """
    named = {f"__m{i}": c for i, c in enumerate(sums)}  # names that do not clash with those used here
    df = df.select(value_col, *[F.col(c).alias(m) for m, c in named.items()])
    vb, offsets, _ = _bucketed(df, value_col, buckets, None, [], True, list(named))
    limit = _located(vb, offsets, [point], den, [], True).agg(_interpolated(0, den).alias("__limit"))
    tail = vb.crossJoin(F.broadcast(limit)).where(F.col("v").cast(BIG) * den >= F.col("__limit"))
    return tail.agg(F.coalesce(F.sum("c"), F.lit(0)).cast("long").alias("n"), F.sum(F.col("v").cast(BIG) * F.col("c")).alias("total"),
                    F.min("v").alias("lo"), F.max("v").alias("hi"), *[F.sum(m).alias(c) for m, c in named.items()])


def top_rank_sums(df: DataFrame, value_col: str, limits: dict[str, tuple[str, int, int]],
                  buckets: int | None = None) -> DataFrame:
    """Sum of ``value_col`` over rows whose descending rank passes a limit.

    ``limits`` maps an output name to ``(mode, a, b)``:
    * ``("rank_le", k, 1)``  - rank <= k (ties at the edge are all kept);
    * ``("frac_le", num, den)`` - rank <= total_rows * num / den.
    One row out, sums as decimal(38,0) in units of the value's last place, plus ``n_rows``
    (all rows, NULL values included, as ``COUNT(*) OVER ()``) and ``total``.
    """
    cum, stats = value_cumulative(df, value_col, buckets)
    x = cum.crossJoin(F.broadcast(stats.select("n", "nulls")))
    rank = F.col("n") - F.col("le") + F.col("nulls") + 1
    n_rows = F.col("n") + F.col("nulls")
    aggs = [F.sum(F.col("v").cast(BIG) * F.col("c")).alias("total"),
            F.max(n_rows).alias("n_rows")]
    for name, (mode, a, b) in limits.items():
        cond = rank <= a if mode == "rank_le" else rank.cast(BIG) * b <= n_rows.cast(BIG) * a
        aggs.append(F.sum(F.when(cond, F.col("v").cast(BIG) * F.col("c"))).alias(name))
    return x.agg(*aggs)
