"""Mixing sources to target weights by Poisson replication.

Each source gets a target share of the mixed text: given weights, or its size
to the power ``alpha`` (0.5 lifts small sources, 1 keeps the proportions). The
mean repetition rate of a source is its target amount over its size, in
characters. A document's number of copies is a Poisson draw with that mean, by
inversion of a uniform number that is the hash of seed and id: the same on every
run and machine. Means over ``PART`` are drawn as sums of independent draws with
smaller means, which is exact. Documents are exploded by their counts and
shuffled globally: each copy's hash gives its place, in ``shards`` equal ranges
of the hash, sorted within each.

Skew: copies are made row by row after the sizes (one row per source) are
known; a hot source needs no task of its own, and places are uniform whatever
the source. The rates are broadcast after a count.

Defined results: null and empty texts have size 0 and are copied like others;
a source without characters keeps rate 1; the null source is a source; sources
missing from given weights have rate 0; null ids draw like the empty id; rows
that share an id draw the same count; extra columns pass through, and the new
columns get other names if theirs are taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vendora.llm.common import fresh, maybe_broadcast, stored

PART = 16.0   # largest mean of a single draw
TERMS = 80    # a draw of mean 16 beyond 80 has probability under 2^-52


def _uniform(*parts: Column) -> Column:
    """52 bits of the MD5 of the colon-separated parts, as a number in [0, 1)."""
    return F.conv(F.substr(F.md5(F.concat_ws(":", *parts)), F.lit(1), F.lit(13)), 16, 10).cast("double") / float(1 << 52)


def rates(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = 0.5, epochs: float = 1.0) -> DataFrame:
    """(source, rate): mean repetitions per document. The mixed text is
    ``epochs`` times the corpus's characters, in expectation."""
    sizes = docs.groupBy("source").agg(F.sum(F.char_length(F.coalesce("text", F.lit("")))).cast("double").alias("size"))
    sizes = stored(sizes, "mix-sizes")  # one row per source, read several times
    if weights is None:
        sized = sizes.withColumn("w", F.pow("size", F.lit(alpha)))
    else:
        pairs = [x for name, w in weights.items() for x in (F.lit(name), F.lit(float(w)))]
        given = F.create_map(*pairs) if pairs else F.expr("cast(map() as map<string,double>)")
        sized = sizes.withColumn("w", F.coalesce(F.when(F.col("source").isNotNull(), given[F.col("source")]), F.lit(0.0)))
    total = sized.agg(F.sum("size").alias("all"), F.sum(F.when(F.col("size") > 0, F.col("w"))).alias("wall"))
    rate = F.when(F.col("size") > 0, F.col("w") / F.nullif(F.col("wall"), F.lit(0.0)) * F.col("all") * epochs / F.col("size")).otherwise(F.lit(1.0))
    return sized.crossJoin(F.broadcast(total)).select("source", F.coalesce(rate, F.lit(0.0)).alias("rate"))


def _tables(rate: DataFrame) -> DataFrame:
    """(source, draws, cdf): how many draws, and the distribution of each."""
    draws = F.greatest(F.ceil(F.col("rate") / PART), F.lit(1)).cast("int")
    start = F.exp(-F.col("mean"))
    cdf = F.aggregate(
        F.sequence(F.lit(1), F.lit(TERMS - 1)),
        F.struct(start.alias("p"), start.alias("c"), F.array(start).alias("cdf")),
        lambda acc, k: F.struct((acc["p"] * F.col("mean") / k).alias("p"),
                                (acc["c"] + acc["p"] * F.col("mean") / k).alias("c"),
                                F.concat(acc["cdf"], F.array(acc["c"] + acc["p"] * F.col("mean") / k)).alias("cdf")),
        lambda acc: acc["cdf"])
    return (rate.withColumn("draws", draws).withColumn("mean", F.col("rate") / F.col("draws"))
            .select("source", "draws", cdf.alias("cdf")))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = 0.5, epochs: float = 1.0,
        seed: int = 17, shards: int | None = None) -> DataFrame:
    """``docs`` with each row as often as its draw says, globally shuffled; new
    columns ``copy`` (from 0) and ``shuffle_key`` (16 hex digits, the order)."""
    shards = shards or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    src, draws, cdf, copy, key, shard = fresh(docs, "mix_source", "mix_draws", "mix_cdf", "copy", "shuffle_key", "mix_shard")
    plan = _tables(rates(docs, weights, alpha, epochs)).toDF(src, draws, cdf)
    doc = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    count = F.aggregate(
        F.sequence(F.lit(1), F.col(draws)), F.lit(0),
        lambda acc, j: acc + F.size(F.filter(F.col(cdf), lambda c: c <= _uniform(F.lit(str(seed)), F.lit("n"), doc, j.cast("string")))))
    drawn = docs.join(maybe_broadcast(plan), F.col("source").eqNullSafe(F.col(src)))
    copies = (drawn.withColumn(draws, count).where(F.col(draws) > 0)
              .withColumn(copy, F.explode(F.sequence(F.lit(0), F.col(draws) - 1)))
              .drop(src, draws, cdf))
    place = F.substr(F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit("s"), doc, F.col(copy).cast("string"))), F.lit(1), F.lit(16))
    copies = copies.withColumn(key, place)
    at = F.floor(F.conv(F.substr(F.col(key), F.lit(1), F.lit(13)), 16, 10).cast("double") / float(1 << 52) * shards).cast("int")
    return (copies.withColumn(shard, at).repartitionById(shards, shard).drop(shard)
            .sortWithinPartitions(key, "doc_id"))
