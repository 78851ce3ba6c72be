"""Boosted trees for many fits at once: second-order splits on features binned by exact quantiles.

A fit is a (model, fold); a *setting* is (depth, rate, l1, l2). Trees follow the published objective: gradient and
hessian of the log loss, positives weighted by negatives / positives, 0.8 of the rows per tree drawn by hashes of the
row ids, gain (T(G_l)^2/(H_l+l2) + T(G_r)^2/(H_r+l2) - T(G)^2/(H+l2)) with T shrinking by l1, leaves -T(G)/(H+l2)
times the rate, no child with a hessian sum below 1. The 100 trees of a short fit are the first 100 of a long one.

Trees grow level by level from sums of gradient and hessian by (fit, setting, node, feature, bin). A fit whose rows
fit a task (``LOCAL_ROWS``) adds them up there, all its settings at once; the settings of many fits then grow side by side, one
task each. Of two children only the one with fewer rows is added up, the other one is the rest of its parent, and features
with few common values are counted together. For a larger fit every level is one Spark aggregate over its rows wherever
they lie, and only the sums come to the driver: settings x nodes x features x bins numbers, whatever the rows. Slopes are
multiples of a power of two that keeps every sum exact, so neither the order of rows nor the way they are added up
changes a tree: both ways use the same splits and give the same trees.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from hedgewise.operators.keyed import filled, preparation
from hedgewise.operators.ranks import percentile_rows
from hedgewise.session import join_small, materialise

BINS = 32
LOCAL_ROWS = 200_000
SPAN = 1 << 15  # rows of one or several settings that are worked on at a time, so that they stay in a core's cache
SHARE, MIN_HESSIAN = 0.8, 1.0
DEPTHS, RATES, L2, L1, TREES = (3, 4, 5), (0.01, 0.1), (0.0, 0.1, 1.0, 5.0), (0.0, 0.1, 1.0), (100, 200)


@dataclass(frozen=True)
class Settings:
    """The settings that share a depth, as columns; ``trees`` are the counts at which a fit is looked at."""

    depth: int
    rate: np.ndarray
    l1: np.ndarray
    l2: np.ndarray

    def __len__(self) -> int:
        return len(self.rate)


def grid(depths=DEPTHS, rates=RATES, l1=L1, l2=L2) -> list[Settings]:
    """The settings by depth and rate; those of one entry grow together in a task."""
    a, b = np.array(list(product(l1, l2)), float).T
    return [Settings(d, np.full(len(a), r), a, b) for d in depths for r in rates]


# ---------------------------------------------------------------- bins


def bin_edges(train: DataFrame, keys: list[str], columns: list[str], bins: int = BINS) -> DataFrame:
    """keys, feature, edges: the distinct exact quantiles that cut a filled feature into at most ``bins`` bins.

    ``train`` is filled. A feature with at most ``bins`` even quantiles apart keeps every one of them.
    """
    long = train.select(*keys, *columns).unpivot(keys, columns, "feature", "x")
    cuts = percentile_rows(long, [*keys, "feature"], "x", [(i + 1) / bins for i in range(bins - 1)])
    return cuts.groupBy(*keys, "feature").agg(F.array_sort(F.collect_set("edge")).alias("edges"))


def binned(rows: DataFrame, edges: DataFrame, keys: list[str], columns: list[str], kept: list[str]) -> DataFrame:
    """``kept`` and ``bins``: one byte per feature, how many edges lie below its value."""
    table = edges.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("feature", "edges"))).alias("_edges"))
    whole = join_small(rows, table, keys, "inner")

    def below(c: str):
        return F.size(F.filter(F.element_at("_edges", F.lit(c)), lambda e: e < F.col(c))).cast("int")

    return whole.select(*kept, F.array(*[below(c) for c in columns]).alias("bins"))


# ---------------------------------------------------------------- growing


def shrunk(g: np.ndarray, l1: np.ndarray) -> np.ndarray:
    return g - np.clip(g, -l1, l1)


def _score(g: np.ndarray, h: np.ndarray, l1: np.ndarray, l2: np.ndarray) -> np.ndarray:
    """T(g)^2 / (h + l2), for hessians that a node may have."""
    out = np.abs(g)
    out -= l1
    np.maximum(out, 0.0, out=out)
    out *= out
    out /= h + l2
    return out


def leaf_values(sums: np.ndarray, l1: np.ndarray, l2: np.ndarray, rate: np.ndarray) -> np.ndarray:
    return -shrunk(sums.real, l1) / np.maximum(sums.imag + l2, 1e-16) * rate


class Columns:
    """The columns of sums: bins of every feature in ascending order, one feature after the other."""

    def __init__(self, feature: np.ndarray, bin: np.ndarray):
        self.feature, self.bin = feature, bin
        first = np.diff(feature, prepend=-1) > 0
        self.firsts, self.ends = np.flatnonzero(first)[1:], int(np.append(np.flatnonzero(first), len(feature))[1])

    def __len__(self) -> int:
        return len(self.feature)

    @staticmethod
    def every(features: int) -> Columns:
        return Columns(np.repeat(np.arange(features), BINS), np.tile(np.arange(BINS), features))


def best_splits(sums: np.ndarray, columns: Columns, l1: np.ndarray, l2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """feature (-1: none), bin, gain, sums of the node and of its left child for every node of sums[node, column].

    Sums are gradient + i hessian and exact. Rows with a bin up to ``bin`` go left. Ties: the smallest feature, then the smallest bin.
    """
    total = sums[:, : columns.ends].sum(axis=1)
    feature, cut = np.full(len(total), -1, np.int64), np.zeros(len(total), np.int64)
    best, left = np.zeros(len(total)), np.zeros(len(total), complex)
    some = np.flatnonzero(total.imag >= 2 * MIN_HESSIAN)  # the nodes that two children can come from
    step = max(1, SPAN // (2 * len(columns)))
    for part in (some[a : a + step] for a in range(0, len(some), step)):
        value, at, low = _best_cuts(sums[part], total[part], columns, l1[part], l2[part])
        found = value > 1e-6
        feature[part], cut[part] = np.where(found, columns.feature[at], -1), np.where(found, columns.bin[at], 0)
        best[part], left[part] = np.where(found, value, 0.0), low
    return feature, cut, best, total, left


def _best_cuts(low: np.ndarray, total: np.ndarray, columns: Columns, l1: np.ndarray, l2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best gain of every node, the column behind which it cuts, and the sums up to there."""
    l1, l2, whole = l1[:, None], l2[:, None], total[:, None]
    low[:, columns.firsts] -= whole  # so that the running sum starts anew with every feature
    np.cumsum(low, axis=1, out=low)
    g, h = low.real.copy(), low.imag.copy()
    few = h < MIN_HESSIAN
    with np.errstate(divide="ignore", invalid="ignore"):  # at cuts without rows on a side, which do not count
        gain = _score(g, h, l1, l2)
        np.subtract(whole.real, g, out=g)
        np.subtract(whole.imag, h, out=h)
        few |= h < MIN_HESSIAN  # and so it is behind the last column of a feature
        gain += _score(g, h, l1, l2)
    gain -= _score(whole.real, whole.imag, l1, l2)
    gain *= 1e10  # ten digits count
    np.rint(gain, out=gain)
    gain[few] = -np.inf
    at, nodes = gain.argmax(axis=1), np.arange(len(gain))
    return gain[nodes, at] / 1e10, at, low[nodes, at]


@dataclass(frozen=True)
class Together:
    """Features that are counted together: the cell of every row, the number of cells, and each feature's column of every cell."""

    cell: np.ndarray
    cells: int
    columns: list[np.ndarray]

    def of(self, rows: np.ndarray) -> Together:
        return Together(self.cell.take(rows), self.cells, self.columns)


def together(bins: np.ndarray, most: int) -> tuple[Columns, list[Together]]:
    """The columns that some row falls into, and groups of features with at most ``most`` different combinations of bins.

    Sums by such a combination give the sums of each of its features, so one pass over the rows serves them all.
    """
    features = bins.shape[1]
    seen = np.stack([np.bincount(bins[:, f], minlength=BINS) > 0 for f in range(features)])
    column = np.cumsum(seen.ravel()).reshape(seen.shape) - 1
    found: list[tuple[np.ndarray, int, list[int]]] = []
    for f in np.argsort(-seen.sum(axis=1), kind="stable"):
        best = None
        for at, (cell, cells, _) in enumerate(found):
            both = np.bincount(cell * BINS + bins[:, f], minlength=cells * BINS) > 0
            n = int(both.sum())
            if n <= most and (best is None or n < best[0]):
                best = n, at, both
        if best is None:
            found.append(((np.cumsum(seen[f]) - 1)[bins[:, f]], int(seen[f].sum()), [int(f)]))
        else:
            n, at, both = best
            found[at] = (np.cumsum(both) - 1)[found[at][0] * BINS + bins[:, f]], n, [*found[at][2], int(f)]
    groups = []
    for cell, cells, members in found:
        sides = []
        for f in members:
            side = np.zeros(cells, np.int64)
            side[cell] = column[f][bins[:, f]]
            sides.append(side)
        groups.append(Together(cell, cells, sides))
    return Columns(*np.nonzero(seen)), groups


def sums_by_slot(groups: list[Together], width: int, rows: np.ndarray | None, slot: np.ndarray, slots: int, slope: np.ndarray) -> np.ndarray:
    """sums[slot, column] of the slopes (gradient + i hessian) of rows (None: of all, in order), each counted in its slot."""
    out = np.zeros((slots, width), complex)
    first = np.arange(0, out.size, width)[:, None]
    for group in groups:
        at = group.cell if rows is None else group.cell.take(rows)
        if slots > 1:
            first_cell = slot * group.cells
            at = np.add(at, first_cell, out=first_cell)
        cells = np.zeros(slots * group.cells, complex)
        np.add.at(cells, at, slope)
        if len(group.columns) == 1:
            out[:, group.columns[0]] = cells.reshape(slots, -1)
        else:
            for side in group.columns:
                np.add.at(out.ravel(), (first + side).ravel(), cells)
    return out


def level_sums(bins: np.ndarray, place: np.ndarray, slope: np.ndarray, nodes: int) -> np.ndarray:
    """sums[setting, node, column] over the rows, all bins of all features; place[setting, row] is -1 for rows that take no part."""
    settings, width = len(place), bins.shape[1] * BINS
    flat = bins.astype(np.int64) + np.arange(bins.shape[1]) * BINS
    out = np.zeros((settings, nodes * width), complex)
    for k in range(settings):
        rows = np.flatnonzero(place[k] >= 0)
        first, values = place[k][rows] * width, slope[k][rows]
        for f in range(bins.shape[1]):
            np.add.at(out[k], first + flat[rows, f], values)
    return out.reshape(settings, nodes, width)


def uniform(ids: np.ndarray, draw: int) -> np.ndarray:
    """A number from 0 to 1 for every row: a hash of row and draw."""
    x = ids.astype(np.uint64) ^ np.uint64((draw + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    for mix in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        x = (x ^ (x >> np.uint64(29))) * np.uint64(mix)
    return (x >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def drawn(ids: np.ndarray, tree: int) -> np.ndarray:
    """Which rows a tree learns from."""
    return uniform(ids, tree) < SHARE


def slopes(margin: np.ndarray, y: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray]:
    p = np.exp(-margin)
    p += 1.0
    np.reciprocal(p, out=p)
    w = np.where(y == 1, scale, 1.0)
    h = 1 - p
    h *= p
    np.maximum(h, 1e-16, out=h)
    h *= w
    p -= y
    p *= w
    return p, h


def exact_unit(rows: int, scale: float) -> float:
    """The power of two that slopes are rounded to, so that no sum over the rows needs more than 53 bits."""
    return 2.0 ** (math.ceil(math.log2(max(rows, 2) * max(scale, 1.0))) - 53)


def exact_slopes(margin: np.ndarray, y: np.ndarray, scale: float, unit: float) -> np.ndarray:
    """Gradient + i hessian in multiples of the unit; sums of them are exact in any order."""
    out = np.empty(margin.shape, complex)
    for values, part in zip(slopes(margin, y, scale), (out.real, out.imag), strict=True):
        values *= 1.0 / unit
        np.rint(values, out=values)
        np.multiply(values, unit, out=part)
    return out


def descend(bins: np.ndarray, place: np.ndarray, feature: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """One level down: children of node i are 2 i and 2 i + 1 of the next level; rows of a leaf leave."""
    f = np.take_along_axis(feature, np.maximum(place, 0), axis=1)
    c = np.take_along_axis(cut, np.maximum(place, 0), axis=1)
    rows = np.arange(bins.shape[0])
    right = (f >= 0) & (bins[rows[None, :], np.maximum(f, 0)] > c)
    return np.where((place >= 0) & (f >= 0), 2 * place + right, -1)


@dataclass
class Trees:
    """Nodes in heap order (root 0, children 2 i + 1 and 2 i + 2) of every tree and setting."""

    depth: int
    feature: list[np.ndarray] = field(default_factory=list)  # [setting, node], -1: leaf
    cut: list[np.ndarray] = field(default_factory=list)
    gain: list[np.ndarray] = field(default_factory=list)
    leaf: list[np.ndarray] = field(default_factory=list)

    def add(self, bins: np.ndarray, tree: int) -> np.ndarray:
        """What a tree adds to the margins [setting, row]."""
        return walk(bins, self.feature[tree], self.cut[tree], self.leaf[tree], self.depth)


def walk(bins: np.ndarray, feature: np.ndarray, cut: np.ndarray, leaf: np.ndarray, depth: int) -> np.ndarray:
    """The leaf value of every (setting, row)."""
    settings, size = feature.shape
    lane = np.repeat(np.arange(0, settings * size, size), len(bins))
    first = np.tile(np.arange(0, bins.size, bins.shape[1]), settings)
    node, flat, feature, cut = np.zeros(len(lane), np.int64), bins.ravel(), feature.ravel(), cut.ravel()
    for _ in range(depth):
        at = lane + node
        f = feature.take(at)
        right = flat.take(first + np.maximum(f, 0)) > cut.take(at)
        node = np.where(f >= 0, 2 * node + 1 + right, node)
    return leaf.ravel().take(lane + node).reshape(settings, -1)


@dataclass
class Tree:
    """The levels of one tree as they come: nodes in heap order for every setting."""

    settings: Settings
    feature: np.ndarray
    cut: np.ndarray
    gain: np.ndarray
    leaf: np.ndarray

    @staticmethod
    def blank(s: Settings) -> Tree:
        shape = (len(s), (1 << (s.depth + 1)) - 1)
        return Tree(s, np.full(shape, -1, np.int64), np.zeros(shape, np.int64), np.zeros(shape), np.zeros(shape))

    def split(self, setting: np.ndarray, node: np.ndarray, sums: np.ndarray, columns: Columns) -> tuple[np.ndarray, np.ndarray]:
        """Settle nodes (heap numbers) by their sums[node, column]: which of them are split, and the sums of their left and right children.

        Children of the last level are leaves, whose values are settled here, too.
        """
        s, at = self.settings, (setting, node)
        feature, cut, gain, total, left = best_splits(sums, columns, s.l1[setting], s.l2[setting])
        self.feature[at], self.cut[at], self.gain[at] = feature, cut, gain
        self.leaf[at] = leaf_values(total, s.l1[setting], s.l2[setting], s.rate[setting])
        some = feature >= 0
        children = np.stack([left, total - left], axis=1)[some]
        if len(children) and node[0] + 1 >= 1 << (s.depth - 1):
            setting, node = setting[some], node[some]
            for side in (0, 1):
                self.leaf[setting, 2 * node + 1 + side] = leaf_values(children[:, side], s.l1[setting], s.l2[setting], s.rate[setting])
        return some, children

    def keep(self, out: Trees) -> None:
        for name in ("feature", "cut", "gain", "leaf"):
            getattr(out, name).append(getattr(self, name))


def _part(s: Settings, at: slice) -> Settings:
    return Settings(s.depth, s.rate[at], s.l1[at], s.l2[at])


class Rows:
    """The rows of a fit in this task, which trees are grown from."""

    def __init__(self, ids: np.ndarray, bins: np.ndarray, y: np.ndarray):
        self.ids, self.y, self.n = ids, y, len(y)
        self.scale = float((y == 0).sum()) / max(float((y == 1).sum()), 1.0) if (y == 1).any() else 1.0
        self.unit = exact_unit(len(y), self.scale)
        self.columns, self.groups = together(bins, max(len(y) // 32, BINS))
        self.bins, self.first = np.ascontiguousarray(bins.astype(np.uint8)), np.arange(0, bins.size, bins.shape[1])

    def draw(self, tree: int) -> None:
        """Put the rows that the tree learns from first."""
        taken = drawn(self.ids, tree)
        self.order = np.concatenate([np.flatnonzero(taken), np.flatnonzero(~taken)])
        self.used = int(taken.sum())
        self.back = np.empty(self.n, np.int64)
        self.back[self.order] = np.arange(self.n)
        self.flat = self.bins.take(self.order, axis=0).ravel()
        at = self.order[: self.used]
        self.taught, self.cells = self.y.take(at), [g.of(at) for g in self.groups]

    def plant(self, s: Settings, margin: np.ndarray) -> Tree:
        """One tree of each setting; its leaves are added to margin[setting, row].

        A row of a leaf goes on to its left child, which has no sums, so all rows end on the last level.
        """
        tree, many, width, used = Tree.blank(s), len(s), len(self.columns), self.used
        slope = exact_slopes(margin.take(self.order[:used], axis=1), self.taught, self.scale, self.unit).ravel()
        setting, place = np.arange(many), np.zeros(many, np.int64)  # of the nodes at hand, numbered within their level
        lane, rows = np.arange(many)[:, None], None if many == 1 else np.tile(np.arange(used), many)
        sums = sums_by_slot(self.cells, width, rows, np.repeat(np.arange(many), used), many, slope)
        node = np.zeros((many, self.n), np.int64)  # of every row, the settings' nodes of a level in a row
        node += lane
        for d in range(s.depth):
            nodes = 1 << d
            some, _ = tree.split(setting, nodes - 1 + place, sums, self.columns)
            level = slice(nodes - 1, 2 * nodes - 1)
            start, until = np.maximum(tree.feature[:, level], 0).ravel(), np.where(tree.feature[:, level] >= 0, tree.cut[:, level], BINS).astype(np.uint8).ravel()
            at = start.take(node)
            at += self.first
            right = self.flat.take(at) > until.take(node)
            node <<= 1
            node += right
            if d + 1 < s.depth and some.any():
                setting, place, whole = setting[some], place[some], sums[some]
                taught = node[:, :used].ravel()
                left = 2 * (setting * nodes + place)
                count = np.bincount(taught, minlength=2 * many * nodes)
                side = (count[left + 1] < count[left]).astype(np.int64)  # the child that is added up
                slot = np.full(2 * many * nodes, -1)
                slot[left + side] = each = np.arange(len(left))
                slot = slot.take(taught)
                mine = np.flatnonzero(slot >= 0)
                sums = np.empty((len(left), 2, width), complex)
                sums[each, side] = sums_by_slot(self.cells, width, mine if rows is None else rows.take(mine), slot.take(mine), len(left), slope.take(mine))
                sums[each, 1 - side] = whole - sums[each, side]
                sums = sums.reshape(-1, width)
                setting, place = np.repeat(setting, 2), (2 * place[:, None] + np.arange(2)).ravel()
            else:
                setting, place, sums = setting[:0], place[:0], sums[:0]
        margin += self.last_values(tree).ravel().take(node).take(self.back, axis=1)
        return tree

    @staticmethod
    def last_values(tree: Tree) -> np.ndarray:
        """The values of the last level, where the left child of a leaf has that leaf's value."""
        value = tree.leaf[:, :1]
        for d in range(tree.settings.depth):
            nodes = 1 << d
            below = tree.leaf[:, 2 * nodes - 1 : 4 * nodes - 1].reshape(len(value), nodes, 2)
            leaf = (tree.feature[:, nodes - 1 : 2 * nodes - 1] < 0)[:, :, None]
            value = np.where(leaf, value[:, :, None], below).reshape(len(value), -1)
        return value


def grow_here(ids: np.ndarray, bins: np.ndarray, y: np.ndarray, s: Settings, trees: int, told: Callable[[Trees, int], None] | None = None) -> Trees:
    """All settings of a fit whose rows are in this task."""
    rows, out, margin = Rows(ids, bins, y), Trees(s.depth), np.zeros((len(s), len(y)))
    step = math.ceil(len(s) / max(1, math.ceil(len(s) * len(y) / SPAN)))
    for tree in range(trees):
        whole = Tree.blank(s)
        rows.draw(tree)
        for at in (slice(a, a + step) for a in range(0, len(s), step)):
            part = rows.plant(_part(s, at), margin[at])
            for name in ("feature", "cut", "gain", "leaf"):
                getattr(whole, name)[at] = getattr(part, name)
        whole.keep(out)
        if told:
            told(out, tree)
    return out


def grow_apart(rows: DataFrame, s: Settings, trees: int) -> Trees:
    """The same trees from rows (row_id, y, bins) that lie in many tasks: one aggregate per level.

    Margins are kept with the rows and written anew after every tree; the splits of the tree at hand go with the job.
    """
    counts = rows.agg(F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg"), F.count(F.lit(1)).alias("n")).first()
    scale = counts["neg"] / counts["pos"] if counts["pos"] else 1.0
    schema = "row_id bigint, y int, bins array<int>, margin array<double>"
    held = {"rows": materialise(rows.select("row_id", F.col("y").cast("int").alias("y"), "bins", F.array_repeat(F.lit(0.0), len(s)).alias("margin")), "boosting")}

    features = len(held["rows"].select("bins").first()["bins"])
    unit, columns = exact_unit(counts["n"], scale), Columns.every(features)

    def arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        n = batch.num_rows
        bins = batch.column("bins").flatten().to_numpy().reshape(n, -1)
        margin = batch.column("margin").flatten().to_numpy().reshape(n, -1).T
        return batch.column("row_id").to_numpy(), batch.column("y").to_numpy(), bins, margin

    def level(tree: int, splits: list, nodes: int) -> np.ndarray:
        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                if not batch.num_rows:
                    continue
                ids, y, bins, margin = arrays(batch)
                place = np.where(drawn(ids, tree), 0, -1)[None, :].repeat(len(s), axis=0)
                for f, c in splits:
                    place = descend(bins, place, f, c)
                part = level_sums(bins, place, exact_slopes(margin, y, scale, unit), nodes)
                total = part if total is None else total + part
            if total is not None:
                total = total.ravel()
                at = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.real[at]), pa.array(total.imag[at])], ["at", "g", "h"])

        found = held["rows"].mapInArrow(sums, "at bigint, g double, h double").groupBy("at").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).toArrow()
        out = np.zeros(len(s) * nodes * features * BINS, complex)
        out[found.column("at").to_numpy()] = found.column("g").to_numpy() + 1j * found.column("h").to_numpy()
        return out.reshape(len(s), nodes, -1)

    def planted(out: Trees, tree: int) -> None:
        f, c, leaf, depth = out.feature[tree], out.cut[tree], out.leaf[tree], out.depth

        def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    _, _, bins, margin = arrays(batch)
                    new = (margin + walk(bins, f, c, leaf, depth)).T
                    yield batch.set_column(3, "margin", pa.array(new.tolist(), pa.list_(pa.float64())))

        held["rows"] = materialise(held["rows"].mapInArrow(moved, schema), "boosting")

    out = Trees(s.depth)
    for tree in range(trees):
        new, splits = Tree.blank(s), []
        setting, place = np.arange(len(s)), np.zeros(len(s), np.int64)
        for d in range(s.depth):
            nodes = 1 << d
            some, _ = new.split(setting, nodes - 1 + place, level(tree, splits, nodes)[setting, place], columns)
            splits.append((new.feature[:, nodes - 1 : 2 * nodes - 1], new.cut[:, nodes - 1 : 2 * nodes - 1]))
            if not some.any():
                break
            setting, place = np.repeat(setting[some], 2), (2 * place[some][:, None] + np.arange(2)).ravel()
        new.keep(out)
        planted(out, tree)
    return out


# ---------------------------------------------------------------- many fits


def _numbers(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return pdf["row_id"].to_numpy(np.int64), np.stack(pdf["bins"].to_numpy()).astype(np.int64), pdf["y"].to_numpy(np.int64)


def _outcomes(margins: np.ndarray, y: np.ndarray) -> np.ndarray:
    """tp, fp, fn of every setting at probability one half."""
    flagged = margins > 0
    return np.stack([(flagged & (y == 1)).sum(axis=1), (flagged & (y == 0)).sum(axis=1), (~flagged & (y == 1)).sum(axis=1)])


def _large(rows: DataFrame, keys: list[str], local_rows: int) -> tuple[DataFrame, list[dict]]:
    """The rows of the fits that a task can hold, and the keys of the others."""
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    large = [{k: r[k] for k in keys} for r in sizes.filter(F.col("_n") > local_rows).select(*keys).collect()]
    if not large:
        return rows, []
    small = sizes.filter(F.col("_n") <= local_rows).select(*keys)
    return join_small(rows, small, keys, "inner"), large


def _spread(rows: DataFrame, keys: list[str]):
    """Groups dealt to so many partitions that fits, which take long and hold few rows, do not share a task."""
    parts = 4 * rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(max(parts, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys).groupBy(*keys)


def _of(rows: DataFrame, key: dict) -> DataFrame:
    for name, value in key.items():
        rows = rows.filter(F.col(name).eqNullSafe(F.lit(value)))
    return rows


def search(rows: DataFrame, keys: list[str], settings: list[Settings] | None = None, trees: tuple[int, ...] = TREES, local_rows: int = LOCAL_ROWS) -> DataFrame:
    """keys, fit, depth, rate, l1, l2, trees, f1: the F1 of every setting of every fit on the rows held out from it.

    ``rows``: keys, fit, ``held`` (0: learns, 1: is scored), row_id, y, bins.
    """
    settings = settings or grid()
    every, most = [*keys, "fit"], max(trees)
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join(f"`{k}` {types[k]}" for k in every) + ", depth int, rate double, l1 double, l2 double, trees int, tp bigint, fp bigint, fn bigint"

    def table(key: tuple, s: Settings, counts: dict[int, np.ndarray]) -> pd.DataFrame:
        out = [(*key, s.depth, s.rate[k], s.l1[k], s.l2[k], n, *found[:, k].tolist()) for n, found in counts.items() for k in range(len(s))]
        return pd.DataFrame(out, columns=[*every, "depth", "rate", "l1", "l2", "trees", "tp", "fp", "fn"])

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        s = settings[key[-1]]
        rest, seen = pdf[pdf["held"] == 0], pdf[pdf["held"] == 1]
        if not len(rest) or not len(seen):
            return table(key[:-1], s, {})
        _, bins, y = _numbers(seen)
        margins, counts = np.zeros((len(s), len(y))), {}

        def told(out: Trees, tree: int) -> None:
            margins[:] += out.add(bins, tree)
            if tree + 1 in trees:
                counts[tree + 1] = _outcomes(margins, y)

        grow_here(*_numbers(rest), s, most, told)
        return table(key[:-1], s, counts)

    small, large = _large(rows, every, local_rows)
    found = _spread(small.withColumn("_s", F.explode(F.array(*[F.lit(i) for i in range(len(settings))]))), [*every, "_s"]).applyInPandas(one, schema)
    for key in large:
        mine = _of(rows, key)
        for s in settings:
            grown = grow_apart(mine.filter("held = 0"), s, most)
            parts = mine.filter("held = 1").select("y", "bins").mapInArrow(_counting(grown, trees, len(s)), "trees int, setting int, c int, n bigint")
            totals: dict[int, np.ndarray] = {}
            for r in parts.groupBy("trees", "setting", "c").agg(F.sum("n").alias("n")).collect():
                totals.setdefault(r["trees"], np.zeros((3, len(s)), np.int64))[r["c"], r["setting"]] = r["n"]
            found = found.unionByName(rows.sparkSession.createDataFrame(table(tuple(key.values()), s, totals), schema))
    f1 = F.when(F.col("tp") + F.col("fp") + F.col("fn") > 0, 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))).otherwise(0.0)
    return found.select(*every, "depth", "rate", "l1", "l2", "trees", f1.alias("f1"))


def _counting(grown: Trees, trees: tuple[int, ...], settings: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            bins, y = batch.column("bins").flatten().to_numpy().reshape(n, -1), batch.column("y").to_numpy()
            margins, out = np.zeros((settings, n)), []
            for tree in range(len(grown.feature)):
                margins += grown.add(bins, tree)
                if tree + 1 in trees:
                    found = _outcomes(margins, y)
                    out += [(tree + 1, k, c, int(found[c, k])) for c in range(3) for k in range(settings)]
            columns = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)], ["trees", "setting", "c", "n"])

    return run


def best_settings(found: DataFrame, keys: list[str]) -> DataFrame:
    """keys, depth, rate, l1, l2, trees, cv_f1: the setting with the greatest mean F1; ties: the smallest values in that order."""
    order = ["rate", "depth", "trees", "l1", "l2"]
    means = found.groupBy(*keys, *order).agg(F.round(F.avg("f1"), 12).alias("cv_f1"))
    best = means.groupBy(*keys).agg(F.min(F.struct((-F.col("cv_f1")).alias("_f"), *order)).alias("b"))
    return best.select(*keys, *[F.col(f"b.{c}").alias(c) for c in order], (-F.col("b._f")).alias("cv_f1"))


NODE = "tree int, node int, feature int, bin int, gain double, leaf double"


def _nodes(grown: Trees) -> pd.DataFrame:
    """The nodes that rows can reach, for the only setting."""
    out = []
    for tree, (feature, cut, gain, leaf) in enumerate(zip(grown.feature, grown.cut, grown.gain, grown.leaf, strict=True)):
        todo = [0]
        while todo:
            i = todo.pop()
            out.append((tree, i, int(feature[0, i]), int(cut[0, i]), float(gain[0, i]), float(leaf[0, i])))
            if feature[0, i] >= 0:
                todo += [2 * i + 1, 2 * i + 2]
    return pd.DataFrame(out, columns=["tree", "node", "feature", "bin", "gain", "leaf"])


def fit_trees(rows: DataFrame, keys: list[str], settings: DataFrame, chosen_by: list[str], local_rows: int = LOCAL_ROWS) -> DataFrame:
    """keys and the nodes of every tree: one fit per key with the settings of its ``chosen_by`` columns.

    ``rows``: keys, row_id, y, bins.
    """
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    names = ["depth", "rate", "l1", "l2", "trees"]
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + f", {NODE}"

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        depth, rate, l1, l2, trees = (pdf[c].iloc[0] for c in names)
        s = Settings(int(depth), np.array([rate]), np.array([l1]), np.array([l2]))
        out = _nodes(grow_here(*_numbers(pdf), s, int(trees)))
        for at, (name, value) in enumerate(zip(keys, key, strict=True)):
            out.insert(at, name, value)
        return out

    small, large = _large(rows, keys, local_rows)
    found = _spread(join_small(small, settings.select(*chosen_by, *names), chosen_by, "inner"), keys).applyInPandas(one, schema)
    for key in large:
        own = _of(settings, {k: key[k] for k in chosen_by}).first()
        s = Settings(own["depth"], np.array([own["rate"]]), np.array([own["l1"]]), np.array([own["l2"]]))
        out = _nodes(grow_apart(_of(rows, key), s, own["trees"]))
        for at, (name, value) in enumerate(key.items()):
            out.insert(at, name, value)
        found = found.unionByName(rows.sparkSession.createDataFrame(out, schema))
    return found


@dataclass(frozen=True)
class Router:
    """Fitted trees of many keys as tables: medians, bin edges and nodes; they can be written, read and joined."""

    keys: list[str]
    columns: list[str]
    prepared: DataFrame
    edges: DataFrame
    nodes: DataFrame

    def save(self, path: str) -> None:
        for name in ("prepared", "edges", "nodes"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")

    @staticmethod
    def load(spark, path: str, keys: list[str], columns: list[str]) -> Router:
        return Router(keys, columns, *[spark.read.parquet(f"{path}/{name}") for name in ("prepared", "edges", "nodes")])

    def score(self, rows: DataFrame) -> DataFrame:
        """The rows without their features, with ``router_prob`` and 0/1 ``router_pred``; rows of other keys are left out.

        A matrix without a column that the router learned from is refused. The nodes of a fit are at most trees x
        2^(depth + 1); those of all keys go to the tasks.
        """
        missing = [c for c in self.columns if c not in rows.columns]
        if missing:
            raise ValueError(f"the matrix lacks the feature columns {missing}")
        kept = [c for c in rows.columns if c not in self.columns]
        ready = binned(filled(rows, self.prepared, self.keys, self.columns), self.edges, self.keys, self.columns, kept)
        schema = StructType([*ready.schema.fields, StructField("router_prob", DoubleType()), StructField("router_pred", IntegerType())])
        return ready.mapInArrow(_scoring(_forests(self.nodes, self.keys), self.keys), schema).drop("bins")


def _forests(nodes: DataFrame, keys: list[str]) -> dict[tuple, list[tuple[np.ndarray, ...]]]:
    table = nodes.toPandas()
    out: dict[tuple, list[tuple[np.ndarray, ...]]] = {}
    for (*key, _), tree in table.groupby([*keys, "tree"], sort=True, dropna=False):
        size = int(tree["node"].max()) + 1
        arrays = []
        for name, kind, blank in (("feature", np.int64, -1), ("bin", np.int64, 0), ("leaf", float, 0.0)):
            a = np.full((1, size), blank, kind)
            a[0, tree["node"].to_numpy()] = tree[name].to_numpy()
            arrays.append(a)
        out.setdefault(tuple(key), []).append((*arrays, size.bit_length()))
    return out


def _scoring(forests: dict, keys: list[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            bins = batch.column("bins").flatten().to_numpy().reshape(n, -1) if n else np.zeros((0, 1), np.int64)
            margin = np.zeros(n)
            places: dict[tuple, list[int]] = {}
            for at, key in enumerate(zip(*[batch.column(k).to_pylist() for k in keys], strict=True)):
                places.setdefault(key, []).append(at)
            for key, rows in places.items():
                mine = bins[rows]
                margin[rows] = sum((walk(mine, *tree)[0] for tree in forests.get(key, [])), np.zeros(len(rows)))
            prob = 1.0 / (1.0 + np.exp(-margin))
            columns = [*batch.columns, pa.array(prob), pa.array((prob > 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "router_prob", "router_pred"])

    return run


def prepare_bins(train: DataFrame, rows: DataFrame, keys: list[str], columns: list[str], kept: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows with ``bins``, preparation, edges): features filled and binned by what the training rows of each key say."""
    prepared = materialise(preparation(train, keys, columns), "prepared")
    edges = materialise(bin_edges(filled(train, prepared, keys, columns), keys, columns), "edges")
    return binned(filled(rows, prepared, keys, columns), edges, keys, columns, kept), prepared, edges


def fit_router(train: DataFrame, keys: list[str], columns: list[str], settings: DataFrame, chosen_by: list[str], label: str, local_rows: int = LOCAL_ROWS) -> Router:
    """Boosted trees of every key of the raw training rows, with given settings."""
    named = train.select(*keys, "row_id", F.col(label).cast("int").alias("y"), *columns)
    rows, prepared, edges = prepare_bins(named, named, keys, columns, [*keys, "row_id", "y"])
    nodes = materialise(fit_trees(materialise(rows, "binned"), keys, settings, chosen_by, local_rows), "nodes")
    return Router(keys, columns, prepared, edges, nodes)


def importances(router: Router) -> DataFrame:
    """keys, feature, gain: the mean gain of a feature's splits as a share of all features' means."""
    split = router.nodes.filter("feature >= 0").groupBy(*router.keys, "feature").agg(F.avg("gain").alias("g"))
    totals = split.groupBy(*router.keys).agg(F.sum("g").alias("_all"))
    names = F.array(*[F.lit(c) for c in router.columns])
    return split.join(totals, router.keys).select(*router.keys, F.get(names, F.col("feature")).alias("feature"), (F.col("g") / F.col("_all")).alias("gain"))


# ---------------------------------------------------------------- a level in DataFrame terms


def first_splits(rows: DataFrame, edges: DataFrame, keys: list[str], columns: list[str], rate: float, l1: float, l2: float) -> DataFrame:
    """keys, feature, edge, bin, gain, left_leaf, right_leaf: the first split of every key's first tree over all its rows.

    ``rows``: keys, y, bins. The sums of gradient and hessian are one aggregate by (keys, feature, bin); the
    prefixes of a feature are at most as many rows as it has bins. A key without a split has no row.
    """
    counts = rows.groupBy(*keys).agg(F.count_if(F.col("y") == 1).alias("_pos"), F.count_if(F.col("y") == 0).alias("_neg"))
    scale = F.when(F.col("_pos") > 0, F.col("_neg") / F.col("_pos")).otherwise(F.lit(1.0))
    weighted = join_small(rows, counts.select(*keys, scale.alias("_scale")), keys, "inner").withColumn("_w", F.when(F.col("y") == 1, F.col("_scale")).otherwise(F.lit(1.0)))
    slope = weighted.select(*keys, F.posexplode("bins").alias("at", "bin"), (F.col("_w") * (0.5 - F.col("y"))).alias("g"), (F.col("_w") * 0.25).alias("h"))
    sums = slope.groupBy(*keys, "at", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
    upto = Window.partitionBy(*keys, "at").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys, "at")
    names = F.array(*[F.lit(c) for c in columns])
    sides = sums.select(*keys, F.get(names, F.col("at")).alias("feature"), "bin", F.sum("g").over(upto).alias("lg"), F.sum("h").over(upto).alias("lh"), F.sum("g").over(whole).alias("tg"), F.sum("h").over(whole).alias("th"))
    pull = lambda g: F.greatest(F.abs(g) - l1, F.lit(0.0))
    lg, lh, rg, rh = F.col("lg"), F.col("lh"), F.col("tg") - F.col("lg"), F.col("th") - F.col("lh")
    score = lambda g, h: pull(g) * pull(g) / (h + l2)
    gain = score(lg, lh) + score(rg, rh) - score(F.col("tg"), F.col("th"))
    leaf = lambda g, h: -F.signum(g) * pull(g) / (h + l2) * rate
    each = sides.filter((lh >= MIN_HESSIAN) & (rh >= MIN_HESSIAN)).join(edges, [*keys, "feature"]).filter(F.col("bin") < F.size("edges"))
    named = each.select(*keys, "feature", F.get("edges", F.col("bin")).alias("edge"), "bin", gain.alias("gain"), leaf(lg, lh).alias("left_leaf"), leaf(rg, rh).alias("right_leaf"))
    order = F.struct((-F.round("gain", 10)).alias("o"), "feature", "edge", "bin", "gain", "left_leaf", "right_leaf")
    best = named.groupBy(*keys).agg(F.min(order).alias("b"))
    return best.select(*keys, *[F.col(f"b.{c}").alias(c) for c in ("feature", "edge", "bin", "gain", "left_leaf", "right_leaf")])


def router_of_splits(splits: DataFrame, prepared: DataFrame, edges: DataFrame, keys: list[str], columns: list[str]) -> Router:
    """A stored router of one split per key."""
    names = F.array(*[F.lit(c) for c in columns])
    at = (F.array_position(names, F.col("feature")) - 1).cast("int")

    def node(i: int, feature, leaf):
        return F.struct(F.lit(0).alias("tree"), F.lit(i).alias("node"), feature.alias("feature"), F.col("bin").cast("int").alias("bin"), F.col("gain").alias("gain"), leaf.alias("leaf"))

    none = F.lit(-1)
    three = F.array(node(0, at, F.lit(0.0)), node(1, none, F.col("left_leaf")), node(2, none, F.col("right_leaf")))
    return Router(keys, columns, prepared, edges, splits.select(*keys, F.explode(three).alias("n")).select(*keys, "n.*"))
