"""Exact Jaccard self-join on word n-grams by prefixes of token combinations.

Tokens are the hashes of a text's distinct four-word shingles. Texts with equal sets are one *node*, named by the
set's digest, so copies never meet as pairs.

1. Occurrences of every token are counted over all texts. Tokens counted at least ``floor`` times go to a table of
   at most ``TABLE`` entries (``floor`` is the least power of two that allows it); all others are *rare*.
2. All sets are sorted by (count, hash), rare tokens first. Rare tokens are class 1, tokens of the table class 2,
   those counted ``STEEP`` times the floor class 3. Classes 2 and 3 are dealt to groups by hash. A set with n tokens
   may lose e = n - ceil(0.85 n) of them to a partner. Its prefix is extended until the tokens that are at least
   the k-th of their group (k: the class) number e + 1. A partner then shares k tokens of some group within both
   prefixes: of two prefixes the one that ends first in the order holds at most e tokens that the partner lacks. So
   single rare tokens and k-combinations of the groups are indexed, and nothing else. The number of groups grows with
   the set's size level; a set is indexed on its own level and on that of its smallest possible partner.
3. Nodes that share an indexed entry are candidates. Every member of an entry is verified against the entry's smallest
   node first, which joins large groups of copies at the cost of one pair per member.
4. Entries whose members still lie in different components are dealt to tasks with a parity bitmap of each member,
   whose distance bounds the difference of two sets from below. Members of different components that bitmaps cannot
   tell apart form *groups*, those with common members one; they are dealt to tasks with their full sets and verified. A task keeps its own
   union-find and returns at most one link per member, so near misses and large groups never become rows of pairs.

Every step is exact: counts, table, order and groups steer the work, never the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from hedgewise.llm import set_links
from hedgewise.llm.common import hash_words, mix64, shingle_hashes, slices, split_words, texts_of
from hedgewise.llm.components import connected
from hedgewise.session import materialise

SHINGLE = 4
SHARE, OF = 85, 100  # a link: OF * intersection >= SHARE * union
PARTS, FLUSH = 4096, 1 << 21  # token counts: key ranges, and tokens a task holds before it sends them on
LEAST, TABLE, STEEP = 16, 1 << 20, 64
BROADCAST_NODES = 1 << 20
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def token_sets(texts: pa.Array, size: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words, counts = split_words(texts)
    hashes, n = shingle_hashes(hash_words(words), counts, size)
    ends = np.cumsum(n)
    return [np.unique(hashes[e - k : e]) for e, k in zip(ends, n, strict=True)]


# ---------------------------------------------------------------- counts


def _sent(tokens: np.ndarray) -> pa.RecordBatch:
    """Tokens as one sorted block of 32-bit remainders per key range."""
    keys = np.sort(tokens >> np.uint64(20))  # 44 bits: the range and the remainder
    part, rest = (keys >> np.uint64(32)).astype(np.int32), keys.astype(np.uint32)
    starts = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
    offsets = np.append(starts, len(rest)) * 4
    blobs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(rest.tobytes())])
    return pa.RecordBatch.from_arrays([pa.array(part[starts]), blobs.cast(pa.binary())], ["part", "rest"])


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []
    for batch in slices(batches, 4096, 4 << 20):
        held += token_sets(texts_of(batch))
        if sum(map(len, held)) >= FLUSH:
            yield _sent(np.concatenate(held))
            held = []
    if sum(map(len, held)):
        yield _sent(np.concatenate(held))


def _frequent(least: int):
    """Keys counted at least ``least`` times; blocks come sorted by key range."""

    def counted(part: int, blobs: list[bytes]) -> pa.RecordBatch:
        keys, n = np.unique(np.frombuffer(b"".join(blobs), np.uint32), return_counts=True)
        keys, n = keys[n >= least], n[n >= least]
        return pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64) | (np.int64(part) << np.int64(32))), pa.array(n.astype(np.int64))], ["key", "n"])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, blobs = None, []
        for batch in batches:
            for part, blob in zip(batch.column("part").to_pylist(), batch.column("rest").to_pylist(), strict=True):
                if part != current and blobs:
                    yield counted(current, blobs)
                    blobs = []
                current = part
                blobs.append(blob)
        if blobs:
            yield counted(current, blobs)

    return found


def frequent_tokens(rows: DataFrame, least: int = LEAST, table: int = TABLE) -> tuple[np.ndarray, np.ndarray, int]:
    """Sorted keys (the upper 44 bits of a token) and counts of the frequent tokens, at most ``table``, and the floor."""
    sent = rows.select("doc_id", "text").mapInArrow(_occurrences, "part int, rest binary")
    found = materialise(sent.repartition("part").sortWithinPartitions("part").mapInArrow(_frequent(least), "key bigint, n bigint"), "frequent")
    by_power = {r["power"]: r["tokens"] for r in found.groupBy(F.floor(F.log2("n")).alias("power")).agg(F.count("*").alias("tokens")).collect()}
    floor = 1 << (least - 1).bit_length()
    while sum(n for power, n in by_power.items() if 1 << power >= floor) > table:
        floor *= 2
    kept = found.filter(F.col("n") >= floor).toArrow()
    keys, n = kept.column("key").to_numpy().astype(np.uint64), kept.column("n").to_numpy()
    order = np.argsort(keys)
    return keys[order], n[order], floor


# ---------------------------------------------------------------- prefixes


def most_lost(n: int) -> int:
    """Tokens of a set of size n that a partner may lack."""
    return n + -SHARE * n // OF


def levels(n: int) -> set[int]:
    """Size levels on which a set meets partners: that of the smaller set of a pair."""
    return {n.bit_length() - 1, (-(-SHARE * n // OF)).bit_length() - 1}


def signatures(tokens: np.ndarray, counts: np.ndarray, floor: int) -> np.ndarray:
    """The entries under which a set is indexed. ``counts`` is 0 for rare tokens."""
    n = len(tokens)
    lost = most_lost(n)
    order = np.lexsort((tokens, counts))
    tokens, counts = tokens[order], counts[order]
    rare = int(np.searchsorted(counts, 1))
    if rare > lost:
        return tokens[: lost + 1]
    out = [tokens[:rare]]
    mixed = mix64(tokens ^ _SPREAD)
    wide = 2 + (counts >= STEEP * floor)
    for level in levels(n):
        groups = max(1, (1 << level) // 16)
        group = (mixed % np.uint64(groups)).astype(np.int64) * 2 + (wide - 2)
        by_group = rare + np.argsort(group[rare:], kind="stable")
        g = group[by_group]
        begins = np.append(True, g[1:] != g[:-1])
        place = np.arange(len(g)) - np.maximum.accumulate(np.where(begins, np.arange(len(g)), 0))
        counting = np.ones(n, bool)
        counting[by_group] = place >= wide[by_group] - 1
        reached = np.cumsum(counting)
        length = min(int(np.searchsorted(reached, lost + 1)) + 1, n)
        inside = by_group[by_group < length]
        for members in np.split(inside, np.flatnonzero(np.diff(group[inside])) + 1):
            k = int(wide[members[0]]) if len(members) else 0
            if k and len(members) >= k:
                picked = np.sort(tokens[members])[np.array(list(combinations(range(len(members)), k)))]
                entry = np.full(len(picked), level * 4 + k, np.uint64)
                for c in range(k):
                    entry = mix64(entry * _SPREAD + picked[:, c])
                out.append(entry)
    return np.unique(np.concatenate(out))


def _lists(values: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate(values) if values else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(np.cumsum([0, *map(len, values)]).astype(np.int32), pa.array(flat.view(np.int64)))


def _digests(sets: list[np.ndarray]) -> np.ndarray:
    """Two 64-bit sums over each set, zero for empty ones."""
    n = np.array([len(s) for s in sets], np.int64)
    sums = np.zeros((2, len(sets)), np.uint64)
    some = np.flatnonzero(n)
    if len(some):
        full, starts = np.concatenate(sets), (np.cumsum(n) - n)[some]
        sums[0, some], sums[1, some] = np.add.reduceat(mix64(full), starts), np.add.reduceat(mix64(full ^ np.uint64(0xA5A5A5A5A5A5A5A5)), starts)
    return sums.view(np.int64)


def _describer(keys: np.ndarray, counts: np.ndarray, floor: int, spark):
    shared = spark.sparkContext.broadcast((keys, counts))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = shared.value
        for batch in slices(batches, 2048, 4 << 20):
            sets = token_sets(texts_of(batch))
            full = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            short = full >> np.uint64(20)
            at = np.minimum(np.searchsorted(keys, short), max(len(keys) - 1, 0))
            known = np.where(keys[at] == short, counts[at], 0) if len(keys) else np.zeros(len(full), np.int64)
            ends = np.cumsum([0, *map(len, sets)])
            entries = [signatures(s, known[lo:hi], floor) if len(s) else s for s, lo, hi in zip(sets, ends[:-1], ends[1:], strict=True)]
            k1, k2 = _digests(sets)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(ends)), pa.array(k1), pa.array(k2), _lists(entries), _lists(set_links.bitmaps(sets))],
                ["doc_id", "n", "k1", "k2", "entries", "bits"],
            )

    return describe


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 2048, 4 << 20):
        sets = token_sets(texts_of(batch))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _lists(sets)], ["node", "tokens"])


# ---------------------------------------------------------------- verification


def _full_sets(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """node and tokens of the wanted nodes, read again from the texts."""
    wanted = materialise(wanted.select(F.col("node").alias("doc_id")).distinct(), "wanted")
    few = wanted.count() <= BROADCAST_NODES
    texts = rows.join(F.broadcast(wanted) if few else wanted, "doc_id", "left_semi")
    return materialise(texts.mapInArrow(_sets, "node bigint, tokens array<bigint>").dropDuplicates(["node", "tokens"]), "tokens")


def _verified(pairs: DataFrame, nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes that are links: first by bitmaps, then on their full sets."""
    small = lambda c: nodes.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}"))
    likely = materialise(pairs.join(small("a"), "a").join(small("b"), "b").filter(set_links.near("a", "b", SHARE, OF)).select("a", "b").distinct(), "likely")
    sets = _full_sets(rows, likely.select(F.explode(F.array("a", "b")).alias("node")))
    side = lambda c: sets.select(F.col("node").alias(c), F.col("tokens").alias(f"set_{c}"))
    both = likely.join(side("a"), "a").join(side("b"), "b")
    sized = both.select("a", "b", F.size(F.array_intersect("set_a", "set_b")).alias("i"), (F.size("set_a") + F.size("set_b")).alias("s"))
    return materialise(sized.filter(OF * F.col("i") >= SHARE * (F.col("s") - F.col("i"))).select("a", "b"), "links")


def ngram_join(df: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST, table: int = TABLE) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable over links), one row per row.

    A text with fewer than four words has one shingle, its whole sequence; a null text or one without words
    has an empty set and is linked with nothing. Rows that share an id count as one document in their links;
    rows without an id are linked with nothing. An empty table gives an empty result; texts are used whole; other
    columns are not looked at. ``least`` and ``table`` set which tokens count as frequent; no result depends on them.
    """
    spark = df.sparkSession
    rows = df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    keys, counts, floor = frequent_tokens(rows, least, table)
    described = materialise(rows.mapInArrow(_describer(keys, counts, floor, spark), "doc_id bigint, n bigint, k1 bigint, k2 bigint, entries array<bigint>, bits array<bigint>"), "described")
    filled = described.filter("n > 0 AND doc_id IS NOT NULL")
    named = ["n", "k1", "k2"]
    nodes = materialise(filled.groupBy(*named).agg(F.min("doc_id").alias("node"), F.count("*").alias("members"), F.first("entries").alias("entries"), F.first("bits").alias("bits")), "nodes")

    members = nodes.select("node", F.col("n").alias("size"), F.explode("entries").alias("entry"))
    buckets = members.groupBy("entry").agg(F.min("node").alias("pivot"), F.min_by("size", "node").alias("pivot_size"), F.max("node").alias("_last"))
    buckets = materialise(buckets.filter("pivot <> _last").drop("_last"), "entries")
    inside = materialise(members.join(buckets, "entry"), "members")
    likely = OF * F.least("size", "pivot_size") >= SHARE * F.greatest("size", "pivot_size")
    stars = inside.filter(likely & (F.col("node") != F.col("pivot"))).select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    links = _verified(stars, nodes, rows)
    joined = connected(links).withColumnRenamed("node", "_node")
    placed = inside.join(joined, F.col("node") == F.col("_node"), "left").select("entry", "node", "size", F.coalesce("component", "node").alias("component"))
    placed = materialise(placed, "placed")
    def pairs(component, sides, size, bits):
        return set_links.likely_pairs(component, sides, size, bits, SHARE, OF)

    bits = nodes.select("node", F.col("bits").alias("payload"))
    more = set_links.links_across(placed, bits, pairs, lambda wanted: _full_sets(rows, wanted), SHARE, OF)
    final = connected(links.unionByName(more)).withColumnRenamed("node", "_node")
    return set_links.labelled(described, nodes, final).withColumnRenamed("n", "n_shingles")
