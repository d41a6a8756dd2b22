"""Merkle manifest of a dataset: a content-addressed DAG and proofs by descent.

H is SHA-256 in lower-case hex over concatenated inputs, digests as hex text. A
row is a leaf: H of its fields, each ``-`` if null, else byte count, ``:`` and
value. The leaves of a source, by doc_id, are hashed in runs of ``FAN``, and so
are the results, until one node remains, the source's subroot; the subroots, by
source, are hashed to the root alike.

1. Every node with children is one record, digest to children, in one table; a
   node that stands in several places is stored once.
2. Requests for leaves descend from the root: the record of the node reached is
   looked up by its digest, a base-``FAN`` digit of the request's rank selects the
   child, and what stands left and right of it is put on the path. Requests that
   share a prefix of digits share the descent, so a level has as many rows as it
   has wanted nodes, and no digest is looked up by many rows.
3. The path, reversed, is the proof. Folding a leaf through it gives a root.

Ranks: leaves are dealt into sorted ranges, numbered within each, and the ranges'
counts added up, so no source is sorted by one task; rows equal in all fields are
told apart by a number of their own, so copies spread over ranges too.

Defined results: null ids come first in their source, the null source before all
others; ties by leaf digest; equal rows are leaves of their own; null and empty
fields hash differently; an empty table has no leaves and no root; columns other
than the five fields are neither read nor hashed; null ids are never tampered.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vendora.llm.common import ascii_lower, maybe_broadcast, stored

FAN = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


@dataclass
class Manifest:
    """``leaves``: (place, source, doc_id, leaf, rank, ...); ``nodes``: records
    (digest, children); ``tops``: (source, place, subroot, leaves, depth) with the
    subroot's place among the sources; ``root``: one row (root, depth), none if
    the table is empty."""

    leaves: DataFrame
    nodes: DataFrame
    tops: DataFrame
    root: DataFrame


def digest_of(*values: Column) -> Column:
    """The leaf digest over the given field values."""
    parts = []
    for v in values:
        s = v.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def _levels(n: Column, fan: int) -> Column:
    """How often ``n`` nodes are cut to runs of ``fan`` until one is left."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(63)), F.struct(n.cast("long").alias("n"), F.lit(0).alias("d")),
                       lambda a, _: F.struct(F.ceil(a["n"] / fan).cast("long").alias("n"), (a["d"] + (a["n"] > 1).cast("int")).alias("d")),
                       lambda a: a["d"])


def _ranked(df: DataFrame, group: list[str], order: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """``df`` (stored) with ``rank``, from 0 within ``group`` by ``order``, nulls
    first; and (group, total). Sorted ranges are numbered each for itself."""
    dealt = df.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
    dealt = stored(dealt.withColumn("at", F.monotonically_increasing_id()), name)
    part = F.shiftright("at", 33)  # the range; ``at`` counts up within it
    cells = dealt.groupBy(*group, part.alias("part")).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = f"sum(n) over (partition by {', '.join(group) or 'null'} order by part rows between unbounded preceding and 1 preceding)"
    cells = stored(cells.withColumn("before", F.coalesce(F.expr(before), F.lit(0))), f"{name}-cells")
    named = cells.select(*[F.col(g).alias(f"g_{g}") for g in group], F.col("part").alias("g_part"), "first", "before")
    same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"g_{g}")) for g in group], part == F.col("g_part"))
    out = (dealt.join(maybe_broadcast(named), same)
           .withColumn("rank", F.col("before") + F.col("at") - F.col("first")).select(*df.columns, "rank"))
    return out, cells.groupBy(*group).agg(F.sum("n").alias("total"))


def _build(level: DataFrame, key: list[str], fan: int, name: str) -> tuple[DataFrame, list[DataFrame]]:
    """Hash (key, rank, digest, n) level by level; the last nodes (key, digest)
    and the records of all levels."""
    tops, records = [], []
    while True:
        tops.append(level.where("n = 1").select(*key, "digest"))
        rest = level.where("n > 1")
        run = (rest.groupBy(*key, F.expr(f"rank div {fan}L").alias("rank"), F.expr(f"(n + {fan - 1}) div {fan}L").alias("n"))
               .agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "digest"))), lambda c: c["digest"]).alias("children")))
        run = stored(run.withColumn("digest", F.sha2(F.array_join("children", ""), 256)), name)
        if run.isEmpty():
            return reduce(DataFrame.union, tops), records
        records.append(run.select("digest", "children"))
        level = run.select(*key, "rank", "digest", "n")


def build(docs: DataFrame, fan: int = FAN, **more: Column) -> Manifest:
    """The manifest of ``docs``; ``more`` columns, computed from a row's fields,
    ride along with its leaf."""
    leaves = docs.select("source", "doc_id", digest_of(*[F.col(c) for c in FIELDS]).alias("leaf"),
                         *[c.alias(name) for name, c in more.items()], F.monotonically_increasing_id().alias("row"))
    ranked, totals = _ranked(stored(leaves, "merkle-leaves"), ["source"], ["doc_id", "leaf", "row"], "merkle-ranked")
    counted = totals.select(F.col("source").alias("s"), "total")
    sources, _ = _ranked(stored(counted, "merkle-sources"), [], ["s"], "merkle-places")
    sources = stored(sources.withColumnRenamed("rank", "place"), "merkle-placed")
    n = sources.count()
    ranked = stored(ranked.join(maybe_broadcast(sources, n), F.col("source").eqNullSafe(F.col("s"))).drop("s", "row"), "merkle-rows")
    subroots, records = _build(ranked.select("place", "rank", F.col("leaf").alias("digest"), F.col("total").alias("n")), ["place"], fan, "merkle-run")
    subroots = stored(subroots.withColumnRenamed("digest", "subroot"), "merkle-subroots")
    root, above = _build(subroots.select(F.col("place").alias("rank"), F.col("subroot").alias("digest"), F.lit(n).cast("long").alias("n")), [], fan, "merkle-top")
    empty = docs.sparkSession.createDataFrame([], "digest string, children array<string>")
    nodes = reduce(DataFrame.union, records + above, empty).dropDuplicates(["digest"])
    tops = sources.join(subroots, "place").select(F.col("s").alias("source"), "place", "subroot", F.col("total").alias("leaves"), _levels(F.col("total"), fan).alias("depth"))
    root = root.select(F.col("digest").alias("root"), _levels(F.lit(n), fan).alias("depth"))
    return Manifest(ranked.drop("total"), stored(nodes, "merkle-nodes"), stored(tops, "merkle-tops"), stored(root, "merkle-root"))


def _descend(front: DataFrame, nodes: DataFrame, wanted: DataFrame, key: list[str], fan: int, name: str) -> DataFrame:
    """One step down: ``front`` (key, up, digest, path) to the ``wanted`` (key,
    up, rank) children: (key, rank, digest, path). A node's own entry of the path
    is what stands left and right of it in its run."""
    child, digit = F.col("children"), (F.col("rank") % fan).cast("int")
    sides = F.struct(F.array_join(F.slice(child, F.lit(1), digit), "").alias("before"),
                     F.array_join(F.slice(child, digit + 2, F.lit(fan)), "").alias("behind"))
    below = front.join(nodes, "digest").drop("digest").join(wanted, [*key, "up"])
    return stored(below.select(*[c for c in wanted.columns if c != "up"], child[digit].alias("digest"), F.concat("path", F.array(sides)).alias("path")), name)


_PATH = "array<struct<before:string,behind:string>>"


def prove(m: Manifest, requests: DataFrame, fan: int = FAN) -> DataFrame:
    """``requests`` (place, rank and more, distinct leaves) with ``subroot``, the
    ``digest`` found at that rank, and its ``path``: sides left and right, from the
    leaf's run up to the root's."""
    root = m.root.first()
    if root is None:
        return requests.selectExpr("*", "cast(null as string) subroot", "cast(null as string) digest", f"cast(array() as {_PATH}) path")
    nodes, empty = m.nodes, F.expr(f"cast(array() as {_PATH})")

    def prefix(column: str, level: int) -> Column:
        return F.expr(f"{column} div {fan ** level}L")

    # From the root to the sources' subroots.
    places = stored(requests.select("place").distinct(), "merkle-asked")
    front = m.root.select(F.lit(0).cast("long").alias("up"), F.col("root").alias("digest"), empty.alias("path"))
    for level in reversed(range(root["depth"])):
        wanted = places.select(prefix("place", level + 1).alias("up"), prefix("place", level).alias("rank")).distinct()
        front = _descend(front, nodes, wanted, [], fan, "merkle-front").withColumnRenamed("rank", "up")
    # From the subroots to the leaves: sources join in at their own depth.
    start = front.withColumnRenamed("up", "place").join(m.tops.select("place", "depth"), "place")
    start = stored(start.withColumn("up", F.lit(0).cast("long")), "merkle-start")
    depths = m.tops.select("place", "depth")
    deepest = start.agg(F.max("depth")).first()[0] or 0
    asked = requests.join(maybe_broadcast(depths), "place")

    def starting(depth: int) -> DataFrame:
        return start.where(F.col("depth") == depth).select("place", "up", "digest", "path")

    front = starting(max(deepest, 1))
    for level in reversed(range(1, deepest)):
        wanted = asked.where(F.col("depth") > level).select("place", prefix("rank", level + 1).alias("up"), prefix("rank", level).alias("rank")).distinct()
        front = _descend(front, nodes, wanted, ["place"], fan, "merkle-front").withColumnRenamed("rank", "up")
        front = front.select("place", "up", "digest", "path").union(starting(level))
    # The last digit is left to the leaves themselves: at most ``fan`` share a run.
    front = (front.join(nodes, "digest").select("place", "up", "children", "path")
             .union(starting(0).select("place", "up", F.array("digest"), "path")))
    own = requests.withColumn("up", prefix("rank", 1))
    digit, child = (F.col("rank") % fan).cast("int"), F.col("children")
    sides = F.struct(F.array_join(F.slice(child, F.lit(1), digit), "").alias("before"), F.array_join(F.slice(child, digit + 2, F.lit(fan)), "").alias("behind"))
    tops = maybe_broadcast(m.tops.select("place", "subroot", "depth"))
    found = own.join(front, ["place", "up"]).join(tops, "place")
    path = F.when(F.col("depth") > 0, F.concat("path", F.array(sides))).otherwise(F.col("path"))
    return found.select(*[f"`{c}`" for c in requests.columns], "subroot", child[digit].alias("digest"), F.reverse(path).alias("path"))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf gives through a path."""
    return F.aggregate(path, leaf, lambda h, s: F.sha2(F.concat(s["before"], h, s["behind"]), 256))


def proof_digest(path: Column) -> Column:
    """H of all digests of a path, from the leaf's run up, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["behind"])), ""), 256)


def audit(docs: DataFrame, tampered: Column, text: Column, fan: int = FAN) -> DataFrame:
    """Proves every row's leaf, then folds what the row holds now, ``text`` in place
    of its text where ``tampered``: (doc_id, leaf, subroot, root, proof_sha256,
    folded_root, verified)."""
    fields = [F.col(c) for c in FIELDS if c != "text"]
    now = F.when(tampered, digest_of(*fields, text))
    m = build(docs, fan, now=now)
    proofs = prove(m, m.leaves, fan)
    root = F.broadcast(m.root.select("root"))  # one row
    out = proofs.crossJoin(root).select(
        "doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"),
        folded(F.coalesce("now", "leaf"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def tamper_check(docs: DataFrame, share: int = 5) -> DataFrame:
    """``audit`` with the texts of the rows whose CRC-32 of the id ``share``
    divides put in lower case (A-Z only)."""
    chosen = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % share == 0, F.lit(False))
    return audit(docs, chosen, ascii_lower(F.col("text")))
