"""Links inside many overlapping entries of set members, found in tasks that never return pairs.

Members (entry, node, size, component) are dealt with a payload to tasks; every two blocks of an entry meet in one.
A cheap test per pair (bitmaps, signatures) first names the *groups* that it cannot tell apart; groups with common
members become one, and their full sets are then dealt and verified with a union-find per task. So what leaves a task
is at most one row per member, however many pairs there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from hedgewise.llm.common import mix64
from hedgewise.llm.components import connected
from hedgewise.session import materialise

BLOCK, ROWS = 1 << 20, 4096  # tokens and members of one block of an entry; two blocks meet in a task
BITS = 2048  # of the narrowest bitmap
HOT = 1000  # sets that hold over a thousandth of the rows: fewer than HOT, so they may be broadcast
MEMBER = "entry bigint, node bigint, size bigint, component bigint"

def bitmaps(sets: list[np.ndarray]) -> list[np.ndarray]:
    """A bit is set if an odd number of tokens falls on it, so two bitmaps differ in no more bits than the sets in tokens.

    A bitmap has ``BITS`` bits or the power of two from four bits per token on; its halves, folded together, are the
    bitmap of half the width.
    """
    out = []
    for s in sets:
        width = max(BITS, 1 << (4 * max(len(s), 1) - 1).bit_length())
        odd = (np.bincount((s & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1).astype(np.uint8)
        out.append(np.packbits(odd).view(np.uint64))
    return out


def near(a: str, b: str, share: int, of: int) -> Column:
    """Whether bitmaps allow two sets to be a link: it differs in at most (of - share) / (of + share) of both sizes.

    Sizes of a link are so close that widths are equal or one is twice the other, which is folded.
    """
    one, other = F.col(f"bits_{a}"), F.col(f"bits_{b}")
    differ = lambda x, y: x.bitwiseXOR(y)

    def folded(bits: Column, to: Column) -> Column:
        n = F.size(to)
        return F.when(F.size(bits) > n, F.zip_with(F.slice(bits, F.lit(1), n), F.slice(bits, n + 1, n), differ)).otherwise(bits)

    apart = F.aggregate(F.zip_with(folded(one, other), folded(other, one), lambda x, y: F.bit_count(differ(x, y))), F.lit(0), lambda s, v: s + v)
    return (of + share) * apart <= (of - share) * (F.col(f"n_{a}") + F.col(f"n_{b}"))


def linked(a: np.ndarray, b: np.ndarray, share: int, of: int) -> bool:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return of * shared >= share * (len(a) + len(b) - shared)


def likely_pairs(components: np.ndarray, sides: np.ndarray, n: np.ndarray, bits: list[np.ndarray], share: int, of: int) -> Iterator[tuple[int, np.ndarray]]:
    """Every member with the later members of other components that sizes and bitmaps cannot tell from it.

    ``sides``: 0 and 1 meet each other; where all are alike, everyone meets everyone.
    """
    width = np.array([len(b) for b in bits], np.int64)
    at_width = {}
    for w in np.unique(width).tolist():
        members = np.flatnonzero((width == w) | (width == 2 * w))
        rows = np.full(len(n), -1)
        rows[members] = np.arange(len(members))
        at_width[w] = rows, np.stack([bits[m] if width[m] == w else bits[m][:w] ^ bits[m][w:] for m in members])
    crossing = len(np.unique(sides)) > 1
    right = np.flatnonzero(sides == 1) if crossing else np.arange(len(n))
    for i in np.flatnonzero(sides == 0) if crossing else right:
        j = right if crossing else right[i + 1 :]
        j = j[(components[j] != components[i]) & (of * np.minimum(n[i], n[j]) >= share * np.maximum(n[i], n[j]))]
        common = np.minimum(width[i], width[j])
        for w in np.unique(common).tolist():  # sizes are close, so a width is at most folded once
            rows, matrix = at_width[w]
            k = j[common == w]
            k = k[(of + share) * np.bitwise_count(matrix[rows[i]] ^ matrix[rows[k]]).sum(axis=1, dtype=np.int64) <= (of - share) * (n[i] + n[k])]
            if len(k):
                yield int(i), k


def alike_groups(members: int, pairs: Iterator[tuple[int, np.ndarray]]) -> list[np.ndarray]:
    """Places of the members that the pairs hold together, group by group."""
    label, inside = np.arange(members), np.zeros(members, bool)
    for i, j in pairs:
        inside[i], inside[j] = True, True
        other = np.unique(label[j])
        if len(other) > 1 or other[0] != label[i]:  # at most as many joins as members
            joined = np.append(other, label[i])
            label[np.isin(label, joined)] = joined.min()
    places = np.flatnonzero(inside)
    places = places[np.argsort(label[places], kind="stable")]
    return np.split(places, np.flatnonzero(np.diff(label[places])) + 1) if len(places) else []


def spanning_links(nodes: np.ndarray, components: np.ndarray, sides: np.ndarray, sets: list[np.ndarray], share: int, of: int) -> list[tuple[int, int]]:
    """Links between members of different components, at most one for each that they join."""
    _, label = np.unique(components, return_inverse=True)
    found = []
    for i, likely in likely_pairs(label.copy(), sides, np.array([len(s) for s in sets], np.int64), bitmaps(sets), share, of):
        left = likely[label[likely] != label[i]]
        while len(left):
            k, left = left[0], left[1:]
            if linked(sets[i], sets[k], share, of):
                found.append((int(nodes[i]), int(nodes[k])))
                label[label == label[k]] = label[i]
                left = left[label[left] != label[i]]
    return found


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of every (entry, lo, hi) together; they come sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        tags = np.stack([batch.column(c).to_numpy() for c in ("entry", "lo", "hi")])
        cuts = [0, *(np.flatnonzero((tags[:, 1:] != tags[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if hi == lo:
                continue
            tag = tuple(tags[:, lo])
            if tag != last and held:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            last = tag
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def columns(block: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    node, component, own, lo = (block.column(c).to_numpy() for c in ("node", "component", "own", "lo"))
    payload = block.column("payload").combine_chunks()
    flat, offsets = payload.flatten().to_numpy().view(np.uint64), np.append(0, np.cumsum(pc.list_value_length(payload).to_numpy()))
    return node, component, (own != lo).astype(np.int64), [flat[s:e] for s, e in zip(offsets[:-1], offsets[1:], strict=True)]


Pairs = Callable[[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]], Iterator[tuple[int, np.ndarray]]]


def _alike(pairs: Pairs) -> Callable:
    """Groups of members that ``pairs(component, sides, size, payload)`` hold together, named by their members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            node, component, sides, payload = columns(block)
            size = block.column("size").to_numpy()
            groups = alike_groups(len(node), pairs(component, sides, size, payload))
            if groups:
                names = np.concatenate([np.full(len(g), (mix64(node[g].astype(np.uint64)).sum() + np.uint64(len(g))).astype(np.int64)) for g in groups])
                at = np.concatenate(groups)
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(node[at]), pa.array(size[at]), pa.array(component[at])], ["entry", "node", "size", "component"])

    return run


def _links(share: int, of: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            links = spanning_links(*columns(block), share, of)
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], ["a", "b"])

    return run


def dealt_members(placed: DataFrame, payload: DataFrame) -> DataFrame:
    """The members (entry, node, size, component) of entries with several components, dealt to tasks with their payload.

    Entries with the same members are looked at once. A large one is cut into blocks; every two blocks meet in a task.
    """
    name = F.xxhash64("node")
    apart = placed.groupBy("entry").agg(
        F.count("*").alias("members"), F.sum("size").alias("tokens"),
        F.sum(F.shiftright(name, 32)).alias("name1"), F.sum(name.bitwiseAND(0xFFFFFFFF)).alias("name2"),
        F.min("component").alias("_least"), F.max("component").alias("_most"),
    ).filter("_least <> _most")
    apart = apart.groupBy("members", "tokens", "name1", "name2").agg(F.min("entry").alias("entry"))
    cuts = F.greatest(F.ceil(F.col("tokens") / BLOCK), F.ceil(F.col("members") / ROWS)).cast("int")
    dealt = placed.join(materialise(apart.select("entry", cuts.alias("blocks")), "apart"), "entry")
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.join(payload, "node").select("entry", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "node", "size", "component", "payload")
    return dealt.repartition("entry", "lo", "hi").sortWithinPartitions("entry", "lo", "hi")


def links_across(placed: DataFrame, payload: DataFrame, pairs: Pairs, sets_of: Callable[[DataFrame], DataFrame], share: int, of: int) -> DataFrame:
    """Links (a, b) with of * intersection >= share * union that join the components of members of common entries.

    ``payload`` (node, payload) is what ``pairs`` looks at; ``sets_of`` gives node and tokens for a table of nodes.
    """
    groups = materialise(dealt_members(placed, payload).mapInArrow(_alike(pairs), MEMBER).distinct(), "alike")
    # Groups that share members become one, so that a full set is sent once.
    hubs = groups.groupBy("entry").agg(F.min("node").alias("b"))
    whole = connected(groups.join(hubs, "entry").select(F.col("node").alias("a"), "b")).select("node", F.col("component").alias("entry"))
    groups = materialise(groups.select("node", "size", "component").distinct().join(whole, "node").select("entry", "node", "size", "component"), "alike")
    sets = sets_of(groups).select("node", F.col("tokens").alias("payload"))
    return materialise(dealt_members(groups, sets).mapInArrow(_links(share, of), "a bigint, b bigint").distinct(), "links")


def labelled(described: DataFrame, nodes: DataFrame, final: DataFrame) -> DataFrame:
    """doc_id, n, component_id of every row: that of the node of its set (n, k1, k2), null without an id.

    Sets that hold many rows are few and broadcast, so no key of the join is hot; empty sets are not joined.
    """
    named = ["n", "k1", "k2"]
    placed = nodes.join(final, F.col("node") == F.col("_node"), "left").select(*named, "members", F.coalesce("component", "node").alias("component_id"))
    placed = materialise(placed, "classes")
    total = described.count()
    often = placed.filter(F.col("members") * HOT > total)
    rows = described.select("doc_id", *named)
    hot = rows.join(F.broadcast(often.select(*named, F.col("component_id").alias("_hot"))), named, "left")
    other = placed.join(F.broadcast(often.select(*named)), named, "left_anti").select(*named, "component_id")
    found = hot.filter("_hot IS NOT NULL").select("doc_id", "n", F.col("_hot").alias("component_id")).unionByName(
        hot.filter("_hot IS NULL AND n > 0").join(other, named, "left").select("doc_id", "n", "component_id")
    ).unionByName(hot.filter("_hot IS NULL AND n = 0").select("doc_id", "n", F.lit(None).cast("bigint").alias("component_id")))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return found.select("doc_id", "n", component.alias("component_id"))
