"""Near-duplicate groups by b-bit MinHash.

1. Every text becomes the set of its five-word shingles. Texts with equal sets are one *class*, represented
   by the smallest id; from here on only representatives count, so copies never meet as pairs.
2. ``HASHES`` minima per set give ``BANDS`` band keys of ``ROWS`` minima each; of the minima only the low
   ``BITS`` bits are kept, packed. Two sets with similarity 0.75 miss every band with probability 3e-7.
3. In the buckets of the first ``STAR_BANDS`` bands every member is compared with the bucket's smallest id: by
   bit counts of their packed signatures, then on the full sets. Confirmed links are joined into components, which
   costs as much as there are members and swallows large groups of near copies.
4. Members of different components that still share a bucket are compared in tasks by bit counts, block against
   block. Those whose collision-corrected estimate reaches ``LOWEST`` (over four standard errors under the threshold)
   form groups, whose full sets are verified in tasks with a union-find (``set_links``). A task returns at most one
   row per member, so near misses, which no component swallows, never become rows of pairs.

So a link is lost only if the bands or the estimate miss it (less than one in a million), whatever the size
of the bucket, and no bucket is cut short.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from hedgewise.llm import set_links
from hedgewise.llm.common import hash_words, mix64, shingle_hashes, slices, split_words, texts_of
from hedgewise.llm.components import connected
from hedgewise.session import materialise

SHINGLE = 5
BANDS, ROWS, BITS = 40, 4, 4
HASHES = BANDS * ROWS
STAR_BANDS = 8
SHARE, OF = 75, 100  # a link: OF * intersection >= SHARE * union
LOWEST = 0.58
BROADCAST_IDS = 1 << 21  # candidate ids that may be broadcast (16 MB); beyond, the texts are shuffled to them
_LOW = np.uint64(0x1111111111111111)
_SEEDS = mix64(np.arange(1, 2 * HASHES + 1, dtype=np.uint64))
_FACTORS, _SHIFTS = _SEEDS[:HASHES] | np.uint64(1), _SEEDS[HASHES:]


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words, counts = split_words(texts)
    hashes, n = shingle_hashes(hash_words(words), counts, SHINGLE)
    ends = np.cumsum(n)
    return [np.unique(hashes[e - k : e]) for e, k in zip(ends, n, strict=True)]


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Packed low bits of the minima, and band keys; one row per non-empty set."""
    full = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    starts = np.cumsum([0, *map(len, sets)])[:-1]
    minima = np.zeros((len(sets), HASHES), np.uint64)
    if len(sets):
        for i in range(HASHES):
            minima[:, i] = np.minimum.reduceat(full * _FACTORS[i] + _SHIFTS[i], starts)
    low = mix64(minima) & np.uint64((1 << BITS) - 1)
    shifts = (np.arange(64 // BITS) * BITS).astype(np.uint64)
    packed = np.bitwise_or.reduce(low.reshape(len(sets), -1, 64 // BITS) << shifts, axis=2)
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(sets), BANDS))
    for r in range(ROWS):
        keys = mix64(keys * np.uint64(0x9E3779B97F4A7C15) + minima.reshape(len(sets), BANDS, ROWS)[:, :, r])
    return packed, keys


def _lists(values: np.ndarray) -> pa.Array:
    width = values.shape[1]
    return pa.ListArray.from_arrays(np.arange(0, (len(values) + 1) * width, width, dtype=np.int32), pa.array(values.astype(np.uint64).view(np.int64).reshape(-1)))


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 2048, 4 << 20):
        sets = shingle_sets(texts_of(batch))
        n = np.array([len(s) for s in sets], np.int64)
        some = np.flatnonzero(n > 0)
        packed, keys = np.zeros((len(sets), HASHES * BITS // 64), np.uint64), np.zeros((len(sets), BANDS), np.uint64)
        sums = np.zeros((2, len(sets)), np.uint64)
        if len(some):
            packed[some], keys[some] = signatures([sets[i] for i in some])
            full, starts = np.concatenate(sets), (np.cumsum(n) - n)[some]
            sums[0, some], sums[1, some] = np.add.reduceat(full, starts), np.add.reduceat(mix64(full ^ np.uint64(0xA5A5A5A5A5A5A5A5)), starts)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), _lists(packed), _lists(keys)],
            ["doc_id", "n", "k1", "k2", "bits", "bands"],
        )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 2048, 4 << 20):
        sets = shingle_sets(texts_of(batch))
        offsets = np.cumsum([0, *map(len, sets)]).astype(np.int32)
        values = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(offsets, pa.array(values))], ["node", "tokens"])


def estimated(a: str, b: str) -> Column:
    """Similarity of two packed signatures: share of equal codes, chance agreement taken out."""
    odd = F.lit(0x1111111111111111)

    def differing(x: Column) -> Column:
        any_bit = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseOR(F.shiftrightunsigned(x, 3))
        return F.bit_count(any_bit.bitwiseAND(odd))

    words = HASHES * BITS // 64
    apart = sum((differing(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in range(1, words)), differing(F.get(a, F.lit(0)).bitwiseXOR(F.get(b, F.lit(0)))))
    chance = 0.5**BITS
    return ((1 - apart / HASHES) - chance) / (1 - chance)


def _confirmed(pairs: DataFrame, nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs (a, b) that are links: first by size and estimate, then on the full sets."""
    side = lambda c: nodes.select(F.col("rep").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}"))
    likely = pairs.join(side("a"), "a").join(side("b"), "b")
    likely = likely.filter((OF * F.least("n_a", "n_b") >= SHARE * F.greatest("n_a", "n_b")) & (estimated("bits_a", "bits_b") >= LOWEST))
    likely = materialise(likely.select("a", "b"), "likely")
    sets = _full_sets(rows, likely.select(F.explode(F.array("a", "b")).alias("node")))
    full = lambda c: sets.select(F.col("node").alias(c), F.col("tokens").alias(f"set_{c}"))
    both = likely.join(full("a"), "a").join(full("b"), "b")
    shared = F.size(F.array_intersect("set_a", "set_b"))
    sized = both.select("a", "b", shared.alias("i"), (F.size("set_a") + F.size("set_b")).alias("s"))
    return materialise(sized.filter(OF * F.col("i") >= SHARE * (F.col("s") - F.col("i"))).select("a", "b"), "links")


def likely_pairs(components: np.ndarray, sides: np.ndarray, n: np.ndarray, codes: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """Every member with those of other components whose size and estimate may make a link (see ``set_links``)."""
    bits = np.stack(codes)
    crossing = len(np.unique(sides)) > 1
    right = np.flatnonzero(sides == 1) if crossing else np.arange(len(n))
    for i in np.flatnonzero(sides == 0) if crossing else right:
        j = right if crossing else right[i + 1 :]
        j = j[(components[j] != components[i]) & (OF * np.minimum(n[i], n[j]) >= SHARE * np.maximum(n[i], n[j]))]
        x = bits[i] ^ bits[j]
        x |= x >> np.uint64(1)
        x |= x >> np.uint64(2)
        equal = 1 - np.bitwise_count(x & _LOW).sum(axis=1) / HASHES
        j = j[(equal - 0.5**BITS) / (1 - 0.5**BITS) >= LOWEST]
        if len(j):
            yield int(i), j


def _full_sets(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """node and tokens of the wanted nodes, read again from the texts."""
    wanted = materialise(wanted.select(F.col("node").alias("doc_id")).distinct(), "wanted")
    few = wanted.count() <= BROADCAST_IDS
    texts = rows.join(F.broadcast(wanted) if few else wanted, "doc_id", "left_semi")
    return materialise(texts.mapInArrow(_sets, "node bigint, tokens array<bigint>").dropDuplicates(["node", "tokens"]), "shingles")


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable over links), kept (doc_id = component_id), one row per row.

    A text with fewer than five words has one shingle, its whole sequence; a null text or one without words
    has an empty set and is linked with nothing. Rows that share an id count as one document in their links;
    rows without an id are linked with nothing. An empty table gives an empty result.
    """
    rows = df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    described = materialise(rows.mapInArrow(_describe, "doc_id bigint, n bigint, k1 bigint, k2 bigint, bits array<bigint>, bands array<bigint>"), "signatures")
    classes = described.filter("n > 0 AND doc_id IS NOT NULL").groupBy("n", "k1", "k2").agg(
        F.min("doc_id").alias("rep"), F.count("*").alias("members"), F.first("bits").alias("bits"), F.first("bands").alias("bands")
    )
    nodes = materialise(classes, "classes")

    members = nodes.select("rep", F.posexplode("bands").alias("band", "key"))
    shared = materialise(members.groupBy("key").agg(F.min("rep").alias("pivot"), F.max("rep").alias("_last")).filter("pivot <> _last").select("key", "pivot"), "buckets")
    inside = materialise(members.join(shared, "key").select("key", "band", "pivot", "rep"), "members")
    stars = inside.filter((F.col("band") < STAR_BANDS) & (F.col("rep") != F.col("pivot"))).select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct()
    links = _confirmed(stars, nodes, rows)
    joined = connected(links).withColumnRenamed("node", "_node")
    placed = inside.select(F.col("key").alias("entry"), F.col("rep").alias("node")).join(joined, F.col("node") == F.col("_node"), "left")
    sizes = nodes.select(F.col("rep").alias("node"), F.col("n").alias("size"))
    placed = placed.select("entry", "node", F.coalesce("component", "node").alias("component")).join(sizes, "node")
    placed = materialise(placed.select("entry", "node", "size", "component"), "placed")
    codes = nodes.select(F.col("rep").alias("node"), F.col("bits").alias("payload"))
    more = set_links.links_across(placed, codes, likely_pairs, lambda wanted: _full_sets(rows, wanted), SHARE, OF)

    final = connected(links.unionByName(more)).withColumnRenamed("node", "_node")
    found = set_links.labelled(described, nodes.withColumnRenamed("rep", "node"), final)
    return found.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
