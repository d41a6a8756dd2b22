"""SimHash near-dedup with bit-sliced comparison.

Fingerprint: per document, the XXH64 hashes of its word shingles vote on 64
bits. Equal fingerprints are folded first, so copies cost one row.

Candidates: the 64 bits are cut into ``BLOCKS`` blocks. Fingerprints within
``radius`` bits agree on all but ``radius`` blocks, so each is sent once per
choice of ``BLOCKS - radius`` blocks, keyed by their bits: 28 keys at radius 2.
48 of 64 bits are fixed by a key, so a key holds at most 2^16 different
fingerprints, whatever the data; no bucket needs a cap or a second way.

Comparison: the members of a key are laid out as bit planes (one bit of 64
fingerprints per machine word). For a batch of members, the differing bits of a
plane are added to carry-save counters (ones, twos, overflow) for all distances
at once. A block is one member against the 64 of a machine word; lanes that need no
comparison (itself, earlier members, padding) count as over from the start, and a
block leaves the work as soon as all its lanes are over the radius. Planes that
split the members most evenly come first, so that far blocks leave early.

Links found in a key are reduced to a spanning forest before they leave the
task, so a cluster of any size emits fewer rows than it has members. Components
are then found on the edge table.

Defined results: null and empty texts have fingerprint zero and link like any
other; documents of fewer words than a shingle hash their whole word sequence;
a component's id is its smallest doc_id, nulls last (null if all are null);
repeated rows are kept row by row; extra columns pass through ``dedup``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from vendora.llm.common import fresh, stored
from vendora.llm.components import components

SHINGLE, RADIUS, SEED, BLOCKS = 3, 2, 42, 8
BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)  # of a byte
ROWS = 256        # members compared with all blocks at a time
LANES = 64        # members of a machine word
FULL = np.uint64(2**64 - 1)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The unsigned 64-bit SimHash of one whole text."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    k = min(shingle, len(words))
    spaced = b" ".join([b"%b"] * k)
    hashes = np.array([xxhash.xxh64_intdigest(spaced % run, SEED)
                       for run in zip(*(words[i:] for i in range(k)), strict=False)], np.uint64)
    parts = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    votes = np.concatenate([np.bincount(parts[:, k], minlength=256) @ BITS for k in range(8)])
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view("<u8")[0])


@F.pandas_udf(LongType())
def _fingerprints(texts: pd.Series, shingle: pd.Series) -> pd.Series:
    found = np.array([fingerprint(t, k) for t, k in zip(texts, shingle, strict=True)], np.uint64)
    return pd.Series(found.view(np.int64))


def _mask(free: tuple[int, ...]) -> int:
    """Signed 64-bit mask of all blocks but those in ``free``."""
    width = 64 // BLOCKS
    mask = (1 << 64) - 1
    for b in free:
        mask &= ~(((1 << width) - 1) << (b * width))
    return mask - (1 << 64) if mask >> 63 else mask


def _planes(values: np.ndarray) -> np.ndarray:
    """(64, words) bit planes: bit i of plane b is bit b of value i."""
    bits = np.unpackbits(values.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    packed = np.packbits(bits.T, axis=1, bitorder="little")
    padded = np.zeros((64, -(-packed.shape[1] // 8) * 8), np.uint8)
    padded[:, :packed.shape[1]] = packed
    return padded.view("<u8")


def near_lanes(differ, over: np.ndarray, order: list[int], radius: int, tally: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(block, lanes) of the blocks that have lanes within ``radius`` bits.

    ``differ(plane, blocks)`` gives the differing bits of the blocks' lanes in a
    plane of ``order``; ``over`` marks lanes that are settled. ``tally`` counts the
    planes of blocks that were added up, and all there were.
    """
    blocks = np.flatnonzero(over != FULL)
    over = over[blocks]
    ones, twos, beyond = np.zeros_like(over), np.zeros_like(over), over.copy()
    if tally is not None:
        tally["all"] = tally.get("all", 0) + len(blocks) * len(order)
    for done, plane in enumerate(order, 1):
        if not len(blocks):
            break
        if tally is not None:
            tally["added"] = tally.get("added", 0) + len(blocks)
        x = differ(plane, blocks)
        carry = ones & x
        ones ^= x
        over |= twos & carry
        twos ^= carry
        beyond = over | (twos & ones if radius == 2 else twos if radius == 1 else ones | twos)
        if done > radius and done < len(order):
            live = beyond != FULL
            if 8 * np.count_nonzero(live) <= 7 * len(live):  # an eighth may leave: worth the copy
                blocks, ones, twos, over, beyond = (v[live] for v in (blocks, ones, twos, over, beyond))
    return blocks, ~beyond


def _even_first(values: np.ndarray) -> list[int]:
    """The planes in which ``values`` differ, the most even split first."""
    differ = int(np.bitwise_or.reduce(values ^ values[0]))
    alive = [b for b in range(64) if differ >> b & 1]
    return sorted(alive, key=lambda b: abs(2 * int((values >> np.uint64(b) & np.uint64(1)).sum()) - len(values)))


def block_links(values: np.ndarray, radius: int, tally: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs i < j of ``values`` within ``radius`` bits, bit-sliced, found
    block by block and given as a spanning forest (each found pair that joins
    two trees)."""
    n = len(values)
    parent = np.arange(n)

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    order, planes = _even_first(values), _planes(values)
    words = planes.shape[1]
    last = np.uint64((1 << (n - (words - 1) * LANES)) - 1)  # lanes of the last word that are members
    left, right = [], []
    for at in range(0, n, ROWS):
        mine = values[at:at + ROWS]
        first = at // LANES  # earlier members have been compared from their side
        member, word = (g.ravel() for g in np.meshgrid(np.arange(at, at + len(mine)), np.arange(first, words), indexing="ij"))
        own = member // LANES
        upto = (np.uint64(2) << (member % LANES).astype(np.uint64)) - np.uint64(1)  # itself and earlier ones
        over = np.where(word < own, FULL, np.where(word == own, upto, np.uint64(0)))
        over[word == words - 1] |= ~last

        def differ(plane: int, blocks: np.ndarray) -> np.ndarray:
            flip = np.uint64(0) - (values[member[blocks]] >> np.uint64(plane) & np.uint64(1))  # noqa: B023
            return planes[plane, word[blocks]] ^ flip  # noqa: B023
        blocks, near = near_lanes(differ, over, order, radius, tally)
        at_block, lane = np.nonzero(np.unpackbits(near.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        for a, b in zip(member[blocks[at_block]].tolist(), (word[blocks[at_block]] * LANES + lane).tolist(), strict=True):
            ra, rb = root(a), root(b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
                left.append(a)
                right.append(b)
    return np.array(left, np.int64), np.array(right, np.int64)


def pair_lanes(x: np.ndarray, radius: int, tally: dict | None = None) -> np.ndarray:
    """Which values of ``x``, the differing bits of pairs, have ``radius`` or fewer;
    one lane each."""
    planes = _planes(x)
    over = np.zeros(planes.shape[1], np.uint64)
    if len(x) % LANES:
        over[-1] = ~np.uint64((1 << (len(x) % LANES)) - 1)
    often = np.bitwise_count(planes).sum(1)
    order = sorted(np.flatnonzero(often).tolist(), key=lambda b: -int(often[b]))  # planes that tell most pairs apart
    out = np.zeros((planes.shape[1], LANES), bool)
    blocks, near = near_lanes(lambda plane, blocks: planes[plane, blocks], over, order, radius, tally)
    out[blocks] = np.unpackbits(near.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return out.ravel()[:len(x)]


def _links(radius: int):
    """Sorted (choice, key, fp) batches to links; a key's members may span batches."""
    def links_of(choice: np.ndarray, key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch | None:
        edge = np.flatnonzero((choice[1:] != choice[:-1]) | (key[1:] != key[:-1])) + 1
        starts = np.concatenate([[0], edge])
        sizes = np.diff(np.append(starts, len(fp)))
        a, b = [], []
        two = starts[sizes == 2]  # most shared keys have two members: all at once, one lane each
        if len(two):
            near = two[pair_lanes(fp[two] ^ fp[two + 1], radius)]
            a.append(fp[near])
            b.append(fp[near + 1])
        for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            members = fp[s:s + n]
            i, j = block_links(members, radius)
            a.append(members[i])
            b.append(members[j])
        if not a:
            return None
        return pa.RecordBatch.from_pydict({"a": np.concatenate(a).view(np.int64), "b": np.concatenate(b).view(np.int64)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append((batch["choice"].to_numpy(), batch["key"].to_numpy(), batch["fp"].to_numpy().view(np.uint64)))
            choice, key, fp = (np.concatenate(x) for x in zip(*held, strict=True))
            last = (choice == choice[-1]) & (key == key[-1])
            cut = len(fp) - int(last.sum())  # the last key may go on
            if cut and (out := links_of(choice[:cut], key[:cut], fp[:cut])):
                yield out
            held = [(choice[cut:], key[cut:], fp[cut:])]
        if held and (out := links_of(*held[0])):
            yield out
    return run


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b) pairs of different fingerprints (column ``fp``, distinct) within
    ``radius`` bits that connect all such pairs."""
    if not 0 <= radius <= 2:
        raise ValueError("the counters hold distances up to 2")
    masks = [_mask(c) for c in combinations(range(BLOCKS), radius)]
    choice = F.explode(F.array(*[F.struct(F.lit(k).alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("key"))
                                 for k, m in enumerate(masks)]))
    keyed = fps.select("fp", choice.alias("c")).select("c.choice", "c.key", "fp")
    return (keyed.repartition("choice", "key").sortWithinPartitions("choice", "key")
            .mapInArrow(_links(radius), "a long, b long").distinct())


def clusters(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, root, component): for each fingerprint of ``prints`` (doc_id, fp) its
    group's name, the smallest fingerprint reachable over links of at most
    ``radius`` bits, and the group's smallest doc_id."""
    folded = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-folded")
    roots = components(links(folded.select("fp"), radius).select("a", "b"))
    joined = folded.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    joined = stored(joined, "simhash-roots")
    least = joined.groupBy("root").agg(F.min("first").alias("component"))
    return joined.join(least, "root").select("fp", "root", "component")


def prints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    return stored(docs.select("doc_id", _fingerprints(F.col("text"), F.lit(shingle)).alias("fp")), "simhash-prints")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (hex), component_id."""
    p = prints(docs, shingle)
    return (p.join(clusters(p, radius), "fp")
            .select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                    F.col("component").alias("component_id")))


def dedup(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row of each group of near-duplicates of ``docs``: the one whose
    doc_id is the group's, columns unchanged."""
    p = prints(docs, shingle)
    fp, key, own = fresh(docs, "simhash_fp", "simhash_key", "simhash_own")
    keep = (p.join(clusters(p, radius), "fp").where(F.col("doc_id").eqNullSafe(F.col("component")))
            .groupBy("root").agg(F.min("doc_id").alias(key), F.min("fp").alias(fp)))
    named = F.col("doc_id").eqNullSafe(F.col(key))
    if not p.groupBy("doc_id").count().where("count > 1").limit(1).count():
        return docs.join(keep, named, "left_semi")
    # Rows share ids: a row is named by its id and its fingerprint together.
    rows = docs.withColumn(own, _fingerprints(F.col("text"), F.lit(shingle)))
    kept = rows.join(keep, named & (F.col(own) == F.col(fp)), "left_semi")
    return kept.dropDuplicates(["doc_id", own]).drop(own)
