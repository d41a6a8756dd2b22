"""Connected components of an edge table by alternating large-star and
small-star steps, each a min-aggregate and an equi-join.

State between rounds is a table in the shared folder; the driver sees only a
row count and a checksum. Hub nodes are no problem for the aggregate (partial
minima) and are split by AQE's skew join; the joins feed a partial aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vendora.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b), with root the smallest
    node reachable. Loops, repeats and either direction are fine; null nodes are
    not allowed."""
    def small(a, b):
        return F.least(a, b), F.greatest(a, b)

    lo, hi = small(F.col("a"), F.col("b"))
    state = stored(edges.select(hi.alias("u"), lo.alias("v")).distinct(), "cc")
    before = None
    while True:
        # Large star: larger neighbours of u move to u's smallest neighbour.
        both = state.union(state.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.join(least, "u").where(F.col("v") > F.col("u"))
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        large = stored(large, "cc")
        # Small star: u and its smaller neighbours move to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        state = stored(joined.union(least.select("u", F.col("m").alias("v"))).distinct(), "cc")
        seen = state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == before:
            roots = state.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
            return state.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
        before = seen
