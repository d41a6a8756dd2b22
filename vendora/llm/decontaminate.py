"""Benchmark decontamination with a distributed positional inverted index.

1. Every training word that also stands in the benchmark becomes a posting
   (word, document, position); the postings are written once to the shared
   folder. No other word can take part in a match.
2. Each benchmark window (13 consecutive words of an item; shorter items are
   one window) is anchored on its two rarest words, by corpus frequency. Their
   posting lists, shifted by their offsets in the window, are intersected on
   (document, start). Windows that share an anchor pair share the work.
3. The surviving starts go back to their documents, where the whole window is
   compared with the document's own words, so the result is exact.
4. Item ids come in last. A candidate carries the name of its window's item set
   only; documents that match the same sets share one list of ids.

A document is a row, named by a hash of its id and text: rows that share an id are
apart, and equal rows are one in the index.

Skew: postings are intersected on (document, pair, start), which no single hot
word, passage or document can pile up on. Benchmark-sized tables are broadcast
only after a count; beyond the limit the same joins shuffle.

Defined results: null or empty texts have no words and no hits; null and
repeated document ids are judged row by row on their own text; items
without words have no window; null item ids take part in matches but are not
listed; an empty benchmark flags nothing; extra columns pass through ``clean``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vendora.llm.common import fresh, maybe_broadcast, stored, word_list

WINDOW = 13
SALTS = 32  # parts that the documents of one list of items are dealt over


@dataclass
class Index:
    """``postings``: (doc, term, pos) of all training words that occur in the
    benchmark; ``windows``: (wid, w, set); ``terms``: (wid, off, term); ``items``:
    (set, item), the ids that hold the windows of a set."""

    postings: DataFrame
    windows: DataFrame
    terms: DataFrame
    items: DataFrame


def _row() -> Column:
    return F.xxhash64("doc_id", "text")


def benchmark_windows(bench: DataFrame, size: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(wid, w, set) of the distinct windows of all items, and (set, item): windows
    held by the same items have one set."""
    b = bench.select(F.col("item_id").cast("string").alias("item"), word_list(F.col("text")).alias("ws"))
    spans = F.transform(F.sequence(F.lit(0), F.greatest(F.size("ws") - size, F.lit(0))),
                        lambda i: F.slice(F.col("ws"), i + 1, size))
    held = stored(b.where(F.size("ws") > 0).select("item", F.explode(spans).alias("w")).distinct(), "decon-held")
    # A set is named by its size and two sums over the hashes of its ids, in any order.
    ids = F.col("item").isNotNull()
    sums = [F.coalesce(F.sum(F.when(ids, F.xxhash64("item", F.lit(k)).cast("decimal(38,0)"))), F.lit(0)) for k in (1, 2)]
    name = F.xxhash64(F.count("item"), *sums)
    windows = stored(held.groupBy("w").agg(name.alias("set")).withColumn("wid", F.xxhash64("w")), "decon-windows")
    items = held.where(ids).join(windows, "w").select("set", "item").distinct()
    return windows.select("wid", "w", "set"), stored(items, "decon-items")


def build_index(docs: DataFrame, bench: DataFrame, size: int = WINDOW) -> Index:
    windows, items = benchmark_windows(bench, size)
    terms = windows.select("wid", F.posexplode("w").alias("off", "term"))
    vocab = maybe_broadcast(terms.select("term").distinct())
    tokens = docs.select(_row().alias("doc"),
                         F.posexplode(word_list(F.col("text"))).alias("pos", "term"))
    postings = stored(tokens.join(vocab, "term", "left_semi").select("doc", "term", "pos"), "decon-postings")
    return Index(postings, windows, terms, items)


def _anchors(ix: Index) -> DataFrame:
    """Per window its two rarest words: (wid, pair, t1, o1, t2, gap). Windows
    with a word that the corpus lacks cannot occur and are left out."""
    freq = stored(ix.postings.groupBy("term").agg(F.count("*").alias("n")), "decon-freq")
    ranked = (ix.terms.join(maybe_broadcast(freq), "term", "left")
              .groupBy("wid")
              .agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "off", "term"))).alias("r")))
    first, last = F.col("r")[0], F.when(F.size("r") > 1, F.col("r")[1]).otherwise(F.col("r")[0])
    return (ranked.where(first["n"] > 0)
            .select("wid", first["term"].alias("t1"), first["off"].alias("o1"),
                    last["term"].alias("t2"), (last["off"] - first["off"]).alias("gap"))
            .withColumn("pair", F.xxhash64("t1", "t2", "gap")))


def _spare_anchors(ix: Index, least: float) -> DataFrame:
    """Per window pairs of its rarest words in the corpus, in the columns of
    ``_anchors``: two words more than may be missing under ``least``, less those
    that the corpus lacks, so that two of them are left in every match. Where one
    word is enough for a match, each word is paired with itself."""
    freq = stored(ix.postings.groupBy("term").agg(F.count("*").alias("n")), "decon-freq")
    distinct = ix.terms.groupBy("wid", "term").agg(F.collect_list("off").alias("offs"))
    ranked = (distinct.join(maybe_broadcast(freq), "term", "left")
              .groupBy("wid").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "term", "offs"))).alias("r")))
    need = F.greatest(F.ceil(F.size("r") * F.lit(least) - 1e-9), F.lit(1)).cast("int")
    present = F.filter("r", lambda c: c["n"] > 0)
    spare = F.size("present") - F.col("need")  # of the present words, how many may be missing
    placed = F.flatten(F.transform(F.slice("present", F.lit(1), spare + F.when(F.col("need") > 1, 2).otherwise(1)), lambda c: F.transform(
        c["offs"], lambda o: F.struct(c["n"].alias("n"), c["term"].alias("term"), o.alias("off")))))
    a, b = F.col("a"), F.col("b")
    rarer = F.struct(a["n"], a["term"]) < F.struct(b["n"], b["term"])
    return (ranked.select("wid", need.alias("need"), present.alias("present")).where(spare >= 0)
            .select("wid", "need", placed.alias("placed"))
            .select("wid", "need", "placed", F.explode("placed").alias("a"))
            .select("wid", "need", "a", F.explode("placed").alias("b"))
            .where(F.when(F.col("need") > 1, rarer).otherwise(a == b))
            .select("wid", a["term"].alias("t1"), a["off"].alias("o1"), b["term"].alias("t2"), (b["off"] - a["off"]).alias("gap"))
            .withColumn("pair", F.xxhash64("t1", "t2", "gap")))


def candidates(ix: Index, slop: int = 0, least: float | None = None) -> DataFrame:
    """(doc, wid, w, set, start) where the two rarest words of a window stand
    at their distance in the window, or within ``slop`` words of it; with
    ``least`` any pair of words that a match must leave two of."""
    anchors = stored(_anchors(ix) if least is None else _spare_anchors(ix, least), "decon-anchors")
    n = anchors.count()
    pairs = anchors.select("pair", "t1", "t2", "gap").distinct()
    left = (ix.postings.join(maybe_broadcast(pairs.select("pair", F.col("t1").alias("term")), n), "term")
            .select("doc", "pair", F.col("pos").alias("p1")).distinct())  # equal rows are one document
    right = (ix.postings.join(maybe_broadcast(pairs.select("pair", F.col("t2").alias("term"), "gap"), n), "term")
             .select("doc", "pair", (F.col("pos") - F.col("gap")).alias("p2")).distinct())
    if slop:
        # Equal-width cells of slop + 1 words; a neighbour is one cell off at most.
        left = left.withColumn("cell", F.floor(F.col("p1") / (slop + 1)))
        right = right.withColumn("cell", F.explode(F.array(*[F.floor(F.col("p2") / (slop + 1)) + k for k in (-1, 0, 1)])))
        met = left.join(right, ["doc", "pair", "cell"]).where(F.abs(F.col("p1") - F.col("p2")) <= slop)
        met = met.select("doc", "pair", "p1").distinct()
    else:
        met = left.join(right.withColumnRenamed("p2", "p1"), ["doc", "pair", "p1"])
    spans = anchors.select("wid", "pair", "o1").join(ix.windows, "wid")
    found = (met.join(maybe_broadcast(spans, n), "pair")
             .withColumn("start", F.col("p1") - F.col("o1"))
             .select("doc", "wid", "w", "set", "start"))
    return found if least is None else found.dropDuplicates(["doc", "wid", "start"])


def _with_found(docs: DataFrame, found: DataFrame, carry: str, words: str) -> DataFrame:
    """All rows of ``docs`` with their words and the candidates of their row."""
    key, key2 = fresh(docs, "decon_key", "decon_key_b")
    grouped = found.groupBy(F.col("doc").alias(key2)).agg(
        F.collect_list(F.struct("start", "w", "set")).alias(carry))
    return (docs.withColumn(key, _row())
            .join(grouped, F.col(key) == F.col(key2), "left")
            .drop(key, key2)
            .withColumn(words, word_list(F.col("text")))
            .withColumn(carry, F.coalesce(carry, F.expr("cast(array() as array<struct<start:int,w:array<string>,set:bigint>>)"))))


def _matches(carry: str, words: str) -> Column:
    """Of the candidates those whose whole window stands in the text."""
    return F.filter(carry, lambda c: (c["start"] >= 0) & (F.slice(F.col(words), F.greatest(c["start"], F.lit(0)) + 1, F.size(c["w"])) == c["w"]))


def annotate(docs: DataFrame, ix: Index, share: int = 20, out: str = "contamination") -> tuple[DataFrame, str]:
    """``docs`` with a struct column (n_words, n_hit, contaminated, sets: the sorted
    item sets of the windows found); returns the frame and that column's name.

    A document is contaminated if some words are hit and at least 1/``share`` of
    all its words are.
    """
    out, carry, words = fresh(docs, out, "decon_c", "decon_w")
    df = _with_found(docs, candidates(ix), carry, words).withColumn(carry, _matches(carry, words))
    positions = F.flatten(F.transform(carry, lambda c: F.sequence(c["start"], c["start"] + F.size(c["w"]) - 1)))
    sets = F.array_sort(F.array_distinct(F.transform(carry, lambda c: c["set"])))
    n_words, n_hit = F.size(words).cast("long"), F.size(F.array_distinct(positions)).cast("long")
    result = F.struct(n_words.alias("n_words"), n_hit.alias("n_hit"),
                      ((n_hit > 0) & (n_hit * share >= n_words)).alias("contaminated"), sets.alias("sets"))
    return df.withColumn(out, result).drop(carry, words), out


def contamination(docs: DataFrame, bench: DataFrame, size: int = WINDOW) -> DataFrame:
    """One row per row of ``docs``: doc_id and the contamination figures."""
    ix = build_index(docs, bench, size)
    df, out = annotate(docs.select("doc_id", "text"), ix)
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")
    df = stored(df.select("doc_id", f"{out}.*", salt.alias("salt")), "decon-figures")
    hit, none = df.where(F.size("sets") > 0), df.where(F.size("sets") == 0)
    # One list of ids for all documents that match the same sets. Documents without
    # any take no part, and those of one list, a third of all maybe, are dealt over
    # SALTS parts (the salt is stored, so a lost task deals them alike).
    lists = hit.select("sets").distinct()
    ids = (lists.select("sets", F.explode("sets").alias("set")).join(ix.items, "set")
           .groupBy("sets").agg(F.array_sort(F.collect_set("item")).alias("ids"))
           .select(F.col("sets").alias("of"), F.size("ids").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "ids"), 256).alias("sha"))
           .withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))))
    # A set of items without ids has no list.
    found = hit.join(ids, (F.col("sets") == F.col("of")) & (F.col("salt") == F.col("part")), "left")
    empty = none.withColumns({"n_items": F.lit(0).cast("long"), "sha": F.lit(None).cast("string")})
    return found.select(*empty.columns).unionByName(empty).select(
        "doc_id", "n_words", "n_hit", F.coalesce("n_items", F.lit(0)).alias("n_items"),
        F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("items_sha256"), "contaminated")


def clean(docs: DataFrame, bench: DataFrame, size: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, columns unchanged."""
    df, out = annotate(docs, build_index(docs, bench, size))
    return df.where(~F.col(out)["contaminated"]).select(*[f"`{c}`" for c in docs.columns])


def _with_items(matches: DataFrame, ix: Index) -> DataFrame:
    """``matches`` with the sorted ids of their ``set`` in its place, ``items``."""
    lists = ix.items.groupBy("set").agg(F.array_sort(F.collect_list("item")).alias("items"))
    return matches.join(lists, "set", "left").withColumn("items", F.coalesce("items", F.expr("cast(array() as array<string>)"))).drop("set")


def phrase_matches(docs: DataFrame, bench: DataFrame, size: int = WINDOW) -> DataFrame:
    """Exact matches: (doc_id, start, n_words, items), one row per occurrence."""
    base, ix = docs.select("doc_id", "text"), build_index(docs, bench, size)
    df = _with_found(base, candidates(ix), "c", "ws")
    found = df.select("doc_id", F.explode(_matches("c", "ws")).alias("c"))
    return _with_items(found.select("doc_id", "c.start", F.size("c.w").alias("n_words"), "c.set"), ix)


def proximity_matches(docs: DataFrame, bench: DataFrame, slop: int = 3, least: float = 0.8,
                      size: int = WINDOW) -> DataFrame:
    """Near matches: two of a window's rarest words stand within ``slop`` words
    of their distance, and at least ``least`` of the window's distinct words lie
    in the stretch it would cover, widened by ``slop`` on both sides. So many
    pairs are tried that any words may be altered as far as ``least`` allows.
    (doc_id, start, share, items), one row per window and start; words put in or
    left out between them can give a place several starts."""
    base, ix = docs.select("doc_id", "text"), build_index(docs, bench, size)
    df = _with_found(base, candidates(ix, slop, least), "c", "ws")
    lo = F.greatest(F.col("c.start") - slop, F.lit(0))
    stretch = F.slice("ws", lo + 1, F.greatest(F.col("c.start") + F.size("c.w") + slop - lo, F.lit(0)))
    share = F.size(F.array_intersect("c.w", stretch)) / F.size(F.array_distinct("c.w"))
    found = (df.select("doc_id", "ws", F.explode("c").alias("c"))
             .select("doc_id", F.col("c.start").alias("start"), share.alias("share"), F.col("c.set").alias("set"))
             .where(F.col("share") >= least))
    return _with_items(found, ix)
