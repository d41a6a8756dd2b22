"""Line dedup over a corpus: deletion-neighbourhood join with an edit bound of
one word.

A line is compared by its lower-cased words. Lines of fewer than ``min_words``
words say too little for an edit bound: of them exact copies go, all but the
earliest. A longer line goes if an earlier line of ``min_words`` or more, by
(doc_id, line number), has the same words or is one word insertion, deletion or
substitution away; the earlier line need not have stayed itself.

1. One pass hashes every line by two polynomials over its words' hashes, which
   also give the hashes of its halves and, later, of the line without any one
   word, all in time linear in the line. Equal lines fold to classes: (hashes,
   first place, count).
2. Only classes that can have a neighbour are expanded. One edit leaves either
   the half before it or the half behind it whole, so neighbours share a prefix
   or a suffix of half length (lengths n // 2 and (n - 1) // 2 meet for lines of
   equal length and of one word more). Halves no other class shares are out.
3. Each remaining class emits its deletion neighbourhood: the hash of the line
   without word p, for all p, and of the whole line. Equal variants with equal p
   are substitutions of each other, a variant equal to a whole line is a
   deletion: within such a group all members are neighbours of its earliest, so
   comparing each with the earliest loses nothing and pairs grow with the rows.
4. Every found pair is verified on its words: the parts before and behind p are
   equal. Members with an earlier verified neighbour go, in all their places.

Skew: hot lines and variants meet as partial minima; the joins back are split by
AQE. The hashes of one line cost one pass, however long the line.

Defined results: ids are integers; null and empty texts have no lines to drop and
come back unchanged (null as null); rows that share an id but not the text are
told apart, identical rows share all decisions, and lines at the same place of
rows that share an id do not drop each other; a null id counts as earliest;
extra columns pass through ``dedup``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from vendora.llm.common import fresh, maybe_broadcast, stored, word_list

MIN_WORDS = 5
CHUNK = 1 << 20  # bytes of text hashed at a time

# Odd bases of the two polynomial hashes, and their inverses modulo 2^64.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
INVERSES = tuple(pow(b, -1, 1 << 64) for b in BASES)

# Bytes of a line: A-Z lower-cased, other non-word bytes blank, line ends kept.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 or b == 10 else 32 for b in range(256))


def _row_key() -> Column:
    return F.xxhash64("doc_id", "text")


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Hashes:
    """Polynomial hashes of lines laid end to end, ``sizes`` words each (none
    empty): sum of word hash times base to the power of the place in the line."""

    def __init__(self, words: list, sizes: np.ndarray):
        raw = np.array(list(map(xxhash.xxh64_intdigest, words)), np.uint64)
        self.sizes, self.starts = sizes, np.cumsum(sizes) - sizes
        self.line = np.repeat(np.arange(len(sizes)), sizes)
        at = np.arange(len(raw)) - self.starts[self.line]
        longest = int(sizes.max(initial=1)) + 1
        self.back = [_powers(i, longest) for i in INVERSES]
        self.terms, self.upto = [], []  # upto: sum of the line's terms before each word
        for base, h in zip(BASES, (raw, (raw ^ (raw >> np.uint64(29))) * np.uint64(BASES[0])), strict=True):
            term = h * _powers(base, longest)[at]
            total = np.cumsum(term) - term
            self.terms.append(term)
            self.upto.append(total - total[self.starts][self.line])
        last = self.starts + sizes - 1
        self.whole = [u[last] + t[last] for u, t in zip(self.upto, self.terms, strict=True)]

    def without(self, k: int) -> np.ndarray:
        """Per word hash ``k`` of its line without it."""
        behind = self.whole[k][self.line] - self.upto[k] - self.terms[k]
        return self.upto[k] + behind * np.uint64(INVERSES[k])

    def halves(self) -> list[np.ndarray]:
        """Per line the hashes of its prefix and suffix of n // 2 and of
        (n - 1) // 2 words; suffixes are moved to the line's start."""
        out = []
        for length in (self.sizes // 2, (self.sizes - 1) // 2):
            cut = length.astype(np.uint64) * np.uint64(BASES[1])
            prefix = self.upto[0][self.starts + length]  # length < n
            skip = self.sizes - length
            before = np.where(length > 0, self.upto[0][self.starts + np.minimum(skip, self.sizes - 1)], self.whole[0])
            suffix = (self.whole[0] - before) * self.back[0][skip]
            out += [prefix + cut, (suffix + cut) ^ np.uint64(BASES[0])]
        return out


def _split(text: str) -> list[list[bytes]]:
    return [line.split() for line in text.encode("utf-8", "replace").translate(_TABLE).split(b"\n")]


def _hash_lines(min_words: int):
    """(k, doc_id, text) rows to (k, doc_id, no, h, h2, p0, s0, p1, s1) per line that
    has a word; lines of fewer than ``min_words`` have no halves (null)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids = batch["k"].to_numpy(), batch["doc_id"]
            words: list[bytes] = []
            row: list[int] = []
            number: list[int] = []
            sizes: list[int] = []
            load = 0
            for i in range(batch.num_rows):
                text = batch["text"][i].as_py()
                if text:
                    load += len(text)
                    for no, line in enumerate(_split(text)):
                        if line:
                            words += line
                            row.append(i)
                            number.append(no)
                            sizes.append(len(line))
                if sizes and (load >= CHUNK or i == batch.num_rows - 1):
                    h = Hashes(words, np.array(sizes))
                    at = np.array(row)
                    short = h.sizes < min_words
                    cols = [*(pa.array(c.view(np.int64)) for c in h.whole), *(pa.array(c.view(np.int64), mask=short) for c in h.halves())]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys[at]), ids.take(pa.array(at)), pa.array(number, pa.int64()), *cols],
                        ["k", "doc_id", "no", "h", "h2", "p0", "s0", "p1", "s1"])
                    words, row, number, sizes, load = [], [], [], [], 0
    return run


def _words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k, text, nos) rows to (k, no, w): the words of the lines asked for."""
    for batch in batches:
        out: list[tuple] = []
        for k, text, nos in zip(*(batch[c] for c in ("k", "text", "nos")), strict=True):
            lines = _split(text.as_py())
            out += [(k.as_py(), no, [w.decode() for w in lines[no]]) for no in nos.as_py()]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.list_(pa.string())), strict=True)],
                                             ["k", "no", "w"])


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, w) rows to their neighbourhoods (v1, v2, p, id); p is -1 for the whole."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.diff(batch["w"].offsets.to_numpy()).astype(np.int64)
        h = Hashes(batch["w"].flatten().to_pylist(), sizes)
        ids = batch["id"].to_numpy()
        p = np.arange(len(h.line)) - h.starts[h.line]
        v1, v2 = (np.concatenate([h.without(k), h.whole[k]]).view(np.int64) for k in (0, 1))
        yield pa.RecordBatch.from_pydict({"v1": v1, "v2": v2, "p": np.concatenate([p, np.full(len(sizes), -1)]),
                                          "id": np.concatenate([ids[h.line], ids])})


def _near(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(h, h2): classes with an earlier neighbour. ``docs`` has (k, text)."""
    half = F.explode(F.array_distinct(F.array("p0", "s0", "p1", "s1")))
    # The same rows feed the count and the join back: one shuffle, read twice.
    halves = classes.select("h", "h2", half.alias("half")).repartition("half")
    shared = halves.groupBy("half").agg(F.count("*").alias("n")).where("n > 1")
    live = stored(halves.join(shared, "half", "left_semi").select("h", "h2").distinct(), "line-live")
    n = live.count()
    live = stored(classes.select("h", "h2", "ord", "k", "no").join(maybe_broadcast(live, n), ["h", "h2"]), "line-firsts")
    wanted = live.groupBy("k").agg(F.collect_set("no").alias("nos"))
    words = docs.join(maybe_broadcast(wanted, n), "k").select("k", "text", "nos").mapInArrow(
        _words_of, StructType([StructField("k", LongType()), StructField("no", LongType()), StructField("w", ArrayType(StringType()))]))
    words = stored(live.join(words.dropDuplicates(["k", "no"]), ["k", "no"]).select("h", "h2", "ord", "w"), "line-words")
    # Ids in the order of places: ranges of it, counted up within each.
    words = stored(words.repartitionByRange("ord").sortWithinPartitions("ord").withColumn("id", F.monotonically_increasing_id()), "line-ids")
    emitted = stored(words.select("id", "w").mapInArrow(_emit, "v1 long, v2 long, p long, id long"), "line-variants")
    groups = emitted.where("p >= 0").groupBy("v1", "v2", "p").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    groups = stored(groups, "line-groups")
    whole = maybe_broadcast(emitted.where("p < 0").select("v1", "v2", F.col("id").alias("whole")), n)
    # Groups with more than one line, or with a line that is the variant itself.
    met = stored(groups.join(whole, ["v1", "v2"], "left").where("n > 1 or whole is not null"), "line-met")
    parts = emitted.join(maybe_broadcast(met), ["v1", "v2", "p"])
    pairs = (parts.where("first < id").select("id", F.col("first").alias("e"), "p", F.lit("sub").alias("how"))
             .union(parts.where("whole < id").select("id", F.col("whole").alias("e"), "p", F.lit("del").alias("how")))
             .union(met.where("first < whole").select(F.col("whole").alias("id"), F.col("first").alias("e"), "p", F.lit("ins").alias("how"))))
    both = (pairs.join(words, "id")
            .join(words.select(F.col("id").alias("e"), F.col("ord").alias("before"), F.col("w").alias("x")), "e"))
    a, b, p = F.col("w"), F.col("x"), F.col("p").cast("int")

    def without(line: Column) -> Column:
        return F.concat(F.slice(line, F.lit(1), p), F.slice(line, p + 2, F.size(line)))
    same = (F.when(F.col("how") == "sub", without(a) == without(b))
            .when(F.col("how") == "del", without(a) == b).otherwise(without(b) == a))
    return both.where((F.col("before") < F.col("ord")) & same).select("h", "h2").distinct()


def dropped_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(k, drop): per row key of ``docs`` the numbers (from 0) of lines that go."""
    keyed = docs.select(_row_key().alias("k"), "doc_id", "text")
    longs = ["no", "h", "h2", "p0", "s0", "p1", "s1"]
    hashed = keyed.mapInArrow(_hash_lines(min_words), StructType([
        StructField("k", LongType()), docs.schema["doc_id"], *(StructField(c, LongType()) for c in longs)]))
    # One number for a place, so that minima stay hash aggregates.
    place = F.coalesce(F.col("doc_id").cast("decimal(19,0)"), F.lit(str(-(1 << 63) - 1)).cast("decimal(20,0)")) * F.lit(1 << 31).cast("decimal(10,0)")
    lines = stored(hashed.withColumn("ord", (place + F.col("no")).cast("decimal(38,0)")), "lines")
    classes = stored(lines.groupBy("h", "h2").agg(
        F.min("ord").alias("ord"), F.min_by("k", "ord").alias("k"), F.min_by("no", "ord").alias("no"), F.count("*").alias("n"),
        *(F.min(c).alias(c) for c in ("p0", "s0", "p1", "s1"))), "line-classes")
    able = classes.where("p0 is not null")  # long enough for the edit bound
    near = stored(_near(keyed.select("k", "text"), able).withColumn("near", F.lit(True)), "line-near")
    going = classes.select("h", "h2", F.col("ord").alias("first"), "n").join(maybe_broadcast(near), ["h", "h2"], "left").where("n > 1 or near")
    return (lines.select("k", "no", "ord", "h", "h2").join(going, ["h", "h2"])
            .where(F.col("near").isNotNull() | (F.col("ord") > F.col("first")))
            .groupBy("k").agg(F.collect_set("no").alias("drop")))


@F.pandas_udf(StringType())
def _without_lines(texts: pd.Series, drops: pd.Series) -> pd.Series:
    def cut(text: str | None, drop) -> str | None:
        if text is None or drop is None:
            return text
        gone = set(drop)
        return "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone)
    return pd.Series([cut(t, d) for t, d in zip(texts, drops, strict=True)], dtype=object)


def annotate(docs: DataFrame, min_words: int = MIN_WORDS) -> tuple[DataFrame, str, str]:
    """``docs`` with two more columns: the remaining text and the number of
    dropped lines; returns the frame and the two names."""
    key, key2, drop, text, count = fresh(docs, "line_key", "line_key_b", "line_drop", "line_text", "line_dropped")
    drops = dropped_lines(docs.select("doc_id", "text"), min_words).toDF(key2, drop)
    df = docs.withColumn(key, _row_key()).join(drops, F.col(key) == F.col(key2), "left")
    touched = F.when(F.col(drop).isNotNull(), F.col("text"))  # other texts do not travel to Python
    df = (df.withColumn(text, _without_lines(touched, F.col(drop)))
          .withColumn(text, F.coalesce(text, "text"))
          .withColumn(count, F.coalesce(F.size(drop), F.lit(0)).cast("long")))
    return df.drop(key, key2, drop), text, count


def line_dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_lines, n_dropped, text (what stays)."""
    df, text, count = annotate(docs.select("doc_id", "text"), min_words)
    lines = F.when(F.coalesce(F.col("text"), F.lit("")) == "", F.lit(0)).otherwise(F.size(F.split("text", "\n")))
    return df.select("doc_id", lines.cast("long").alias("n_lines"), F.col(count).alias("n_dropped"),
                     F.col(text).alias("text"))


def dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the lines taken out of ``text`` (and ``n_chars``, if there,
    brought up to date); documents left without any word by this go."""
    df, text, count = annotate(docs, min_words)
    empty = (F.col(count) > 0) & (F.size(word_list(F.col(text))) == 0)
    changed = F.col(count) > 0
    cols = []
    for c in docs.columns:
        if c == "text":
            cols.append(F.col(text).alias("text"))
        elif c == "n_chars":
            cols.append(F.when(changed, F.char_length(text)).otherwise(F.col(c)).cast(docs.schema[c].dataType).alias(c))
        else:
            cols.append(F.col(f"`{c}`"))
    return df.where(~empty).select(*cols)
