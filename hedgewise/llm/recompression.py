"""A run-length grammar of many word sequences by recompression, and longest common extensions on it.

All sequences stand one after another, each followed by a separator of its own. Levels alternate: *block*
levels turn every maximal run of one symbol into a run-length symbol, *pair* levels put symbols on a left or a
right side by a hash bit and turn every adjacent left-right pair into a new symbol. Separators are never paired.
Equal substrings get equal symbols but for one symbol at either border of a level, so an extension climbs
the levels, comparing at most one symbol (or the shorter rest of two blocks) at each, and comes down the same way.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from hedgewise.llm.common import mix64

SHORT = 8  # sequences of at most so many symbols are compared one by one on the top level


@dataclass
class Level:
    """Symbols of a level; ``start[i]`` is the first child of symbol i one level below (with one entry past the end)."""

    symbols: np.ndarray
    start: np.ndarray | None
    parent: np.ndarray | None = None
    block: bool = False


def _grouped(begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First children (and the end), and the parent of every child, from the marks of first children."""
    start = np.append(np.flatnonzero(begins), len(begins))
    return start.astype(np.int64), (np.cumsum(begins) - 1).astype(np.int64)


def build(words: np.ndarray, separators: np.ndarray, rounds: int = 64) -> list[Level]:
    """Levels from the words up. ``separators`` marks the positions that end a sequence; their symbols are unique.

    Rounds end when every sequence has at most ``SHORT`` symbols.
    """
    symbols, ends = words.astype(np.int64), separators.copy()
    levels, names = [Level(symbols, None)], int(symbols.max(initial=-1)) + 1
    for turn in range(rounds):
        marks = np.flatnonzero(ends)
        if not len(marks) or np.diff(np.append(-1, marks)).max() - 1 <= SHORT:
            break
        same = symbols[1:] == symbols[:-1]
        if same.any():
            start, parent = _grouped(np.append(True, ~same))
            count = np.diff(start)
            heads = symbols[start[:-1]]
            long = count > 1
            fresh, inverse = np.unique(heads[long] * np.int64(count.max() + 1) + count[long], return_inverse=True)
            above = heads.copy()
            above[long] = names + inverse
            names += len(fresh)
            levels[-1].parent = parent
            levels.append(Level(above, start, block=True))
            symbols, ends = above, ends[start[:-1]]
        side = (mix64(symbols.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(2 * turn + 1)) >> np.uint64(17)) & np.uint64(1)
        left, right = (side == 0) & ~ends, (side == 1) & ~ends
        one, other = left[:-1] & right[1:], right[:-1] & left[1:]
        second = np.append(False, one if one.sum() >= other.sum() else other)
        start, parent = _grouped(~second)
        above = symbols[start[:-1]].copy()
        paired = np.flatnonzero(np.diff(start) == 2)
        at = start[paired]
        fresh, inverse = np.unique(symbols[at] * np.int64(names) + symbols[at + 1], return_inverse=True)
        above[paired] = names + inverse
        names += len(fresh)
        levels[-1].parent = parent
        levels.append(Level(above, start))
        symbols, ends = above, ends[start[:-1]]
    return levels


def mirrored(levels: list[Level]) -> list[Level]:
    """The same grammar for the sequences read backwards."""
    out = []
    for below, level in zip([None, *levels[:-1]], levels, strict=True):
        start = None if level.start is None else len(below.symbols) - level.start[::-1]
        parent = None if level.parent is None else level.parent[-1] - level.parent[::-1]
        out.append(Level(level.symbols[::-1], start, parent, level.block))
    return out


def extensions(levels: list[Level], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many symbols from positions i and j on are equal, for i <> j of the same sequence."""
    a, b = i.astype(np.int64), j.astype(np.int64)
    stopped = np.full(len(a), -1, np.int64)  # the level on which the query met different symbols
    alive = np.arange(len(a))
    for t, level in enumerate(levels[:-1]):
        if not len(alive):
            break
        start = levels[t + 1].start
        x, y = a[alive], b[alive]
        up_x, up_y = level.parent[x], level.parent[y]
        uneven = (start[up_x] != x) | (start[up_y] != y)
        equal = level.symbols[x] == level.symbols[y]
        rest_x, rest_y = start[up_x + 1] - x, start[up_y + 1] - y
        step = np.where(uneven & equal, np.minimum(rest_x, rest_y), 0)
        apart = uneven & (~equal | (rest_x != rest_y))
        a[alive], b[alive] = x + step, y + step
        stopped[alive[apart]] = t
        alive = alive[~apart]
        if len(alive):
            # A query that has moved stands on a first child now; both go up.
            a[alive], b[alive] = level.parent[a[alive]], level.parent[b[alive]]
    top = levels[-1].symbols
    while len(alive):
        equal = top[a[alive]] == top[b[alive]]
        stopped[alive[~equal]] = len(levels) - 1
        alive = alive[equal]
        a[alive] += 1
        b[alive] += 1
    for t in range(len(levels) - 1, 0, -1):
        down = np.flatnonzero(stopped >= t)
        if not len(down):
            continue
        start, below = levels[t].start, levels[t - 1].symbols
        x, y = start[a[down]], start[b[down]]
        shared = np.minimum(start[a[down] + 1] - x, start[b[down] + 1] - y) if levels[t].block else 1
        step = np.where(below[x] == below[y], shared, 0)
        a[down], b[down] = x + step, y + step
    return a - i
