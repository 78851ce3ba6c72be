"""Runs of repeated word sequences in every text, by recompression.

A run is a stretch of words with smallest period q and length >= max(MIN_LENGTH, MIN_CYCLES * q) that no
neighbouring word extends keeping period q. The positions i with word[i] = word[i + q] inside a run are a stretch
of at least d = max(MIN_LENGTH - q, (MIN_CYCLES - 1) * q), so one of them is a multiple of d: for every period the
multiples of d (a harmonic grid, n log n candidates in all) whose words agree are extended both ways by
grammar queries (``recompression``). Extensions are exact; a stretch found with several periods keeps the
smallest, which is the smallest period of its words by the periodicity lemma.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from hedgewise.llm.common import hash_words, slices, texts_of
from hedgewise.llm.recompression import build, extensions, mirrored

MIN_LENGTH, MIN_CYCLES = 24, 3
CANDIDATES = 1 << 21  # candidates looked at together, which bounds memory
WORD = r"[^\x20\x09-\x0D]+"
RUN = "struct<start: bigint, length: bigint, period: bigint>"
SCHEMA = f"n_words bigint, runs array<{RUN}>, strongest {RUN}, collapsed string"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words as they are written, and how many each text has."""
    lists = pc.ascii_split_whitespace(texts)
    words, parents = lists.flatten(), pc.list_parent_indices(lists)
    some = pc.greater(pc.binary_length(words), 0)
    words, parents = words.filter(some), parents.filter(some)
    return words, np.bincount(parents.to_numpy(zero_copy_only=False), minlength=len(texts)).astype(np.int64)


def _grid(ids: np.ndarray, first: np.ndarray, counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Grid positions and periods whose words agree; positions count through all texts."""
    long = counts >= MIN_LENGTH
    periods = np.where(long, counts // MIN_CYCLES, 0)
    ends = np.cumsum(periods)
    for lo in range(0, int(ends[-1]) if len(ends) else 0, CANDIDATES // 8):
        pair = np.arange(lo, min(lo + CANDIDATES // 8, int(ends[-1])))
        text = np.searchsorted(ends, pair, side="right")
        q = pair - (ends[text] - periods[text]) + 1
        d = np.maximum(MIN_LENGTH - q, (MIN_CYCLES - 1) * q)
        points = (counts[text] - q - 1) // d + 1
        upto = np.cumsum(points)
        cuts = np.searchsorted(upto, np.arange(CANDIDATES, int(upto[-1]) + CANDIDATES, CANDIDATES), side="left") + 1
        for s, e in zip(np.append(0, cuts[:-1]), np.minimum(cuts, len(pair)), strict=True):
            if e <= s:
                continue
            n = points[s:e]
            total = int(n.sum())
            row = np.repeat(np.arange(s, e), n)
            k = np.arange(total) - np.repeat(np.cumsum(n) - n, n)
            at, period = first[text[row]] + k * d[row], q[row]
            agree = ids[at] == ids[at + period]
            if agree.any():
                yield at[agree], period[agree]


def find_runs(ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """text, start, length, period of all runs, by text, start and period. ``ids`` holds the words of all texts."""
    texts = len(counts)
    places = np.cumsum(counts + 1) - counts
    total = int(counts.sum()) + texts + 1
    ends = np.ones(total, bool)  # a separator before every text and one at the end, for both directions
    inside = np.repeat(places - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
    ends[inside] = False
    symbols = np.zeros(total, np.int64)
    symbols[inside] = ids
    symbols[ends] = int(ids.max(initial=-1)) + 1 + np.arange(texts + 1)
    forward = build(symbols, ends)
    backward = mirrored(forward)
    found = [np.zeros((4, 0), np.int64)]
    for at, q in _grid(symbols, places, counts):
        ahead = extensions(forward, at, at + q)
        last = total - 1
        behind = extensions(backward, last - at, last - at - q) - 1
        length = ahead + behind + q
        ok = length >= np.maximum(MIN_LENGTH, MIN_CYCLES * q)
        if ok.any():
            start = (at - behind)[ok]
            text = np.searchsorted(places, start, side="right") - 1
            found.append(np.unique(np.stack([text, start - places[text], length[ok], q[ok]]), axis=1))
    runs = np.concatenate(found, axis=1)
    runs = runs[:, np.lexsort((runs[3], runs[2], runs[1], runs[0]))]
    if runs.shape[1]:
        runs = runs[:, np.append(True, (runs[:3, 1:] != runs[:3, :-1]).any(axis=0))]
    return tuple(runs[:, np.lexsort((runs[3], runs[1], runs[0]))])


def _collapsed(words: pa.Array, counts: np.ndarray, runs: tuple[np.ndarray, ...]) -> pa.Array:
    """The words of each text that no run drops, joined by one space."""
    text, start, length, period = runs
    first = np.cumsum(counts) - counts
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, first[text] + start + period, 1)
    np.add.at(change, first[text] + start + length, -1)
    kept = np.cumsum(change[:-1]) == 0
    upto = np.append(0, np.cumsum(kept))
    offsets = upto[np.append(0, np.cumsum(counts))]
    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), words.filter(pa.array(kept)))
    return pc.binary_join(lists, pa.scalar(" ", words.type)).cast(pa.string())


def _strongest(length: np.ndarray, period: np.ndarray, start: np.ndarray) -> int:
    """The run with the greatest exact length / period; ties: the smallest start, then the smallest period."""
    return min(range(len(length)), key=lambda i: (-Fraction(int(length[i]), int(period[i])), start[i], period[i]))


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 4096, 4 << 20):
        words, counts = _split(texts_of(batch))
        _, ids = np.unique(hash_words(words), return_inverse=True)
        runs = find_runs(ids.astype(np.int64), counts)
        text, start, length, period = runs
        offsets = np.append(0, np.cumsum(np.bincount(text, minlength=len(counts)))).astype(np.int32)
        columns = [pa.array(c) for c in (start, length, period)]
        every = pa.StructArray.from_arrays(columns, fields=list(_RUN))
        best = [lo + _strongest(length[lo:hi], period[lo:hi], start[lo:hi]) if hi > lo else None for lo, hi in zip(offsets[:-1], offsets[1:], strict=True)]
        found = [pa.array(counts), pa.ListArray.from_arrays(offsets, every), every.take(pa.array(best, pa.int64())), _collapsed(words, counts, runs)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *found], ["doc_id", "n_words", "runs", "strongest", "collapsed"])


def periodic_runs(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, runs (by start, then period), strongest, collapsed, one row per row.

    Words are what white space ``[\\x20\\x09-\\x0D]`` leaves, compared as they are written. A word is dropped from
    ``collapsed`` if any run holds it after that run's first period. Null, empty and blank texts have no words, no
    runs, a null strongest and an empty collapsed text. Texts are used whole, however long; repeated rows give
    repeated results; an empty table gives an empty result; no other column of the table is looked at.
    """
    rows = df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(_find, f"doc_id bigint, {SCHEMA}")


def with_planted_runs(df: DataFrame) -> DataFrame:
    """doc_id and text; one text in ten repeats a stretch of its own words to its end.

    With h = crc32 of the id in decimal and g = h div 10: if h ends in 0, every word i >= a becomes word
    a + (i - a) mod p, where a = g mod n and p = 1 + (n - a) div (3 + g mod 8). Texts without words and rows
    without an id stay.
    """
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0))
    chosen = df.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string")).alias("h"))
    chosen = chosen.select("doc_id", "text", F.expr("h div 10").alias("g"), F.when(F.col("h") % 10 == 0, words).alias("w"))
    sized = chosen.withColumn("n", F.nullif(F.size("w").cast("bigint"), F.lit(0).cast("bigint")))
    cut = sized.withColumn("a", F.col("g") % F.col("n")).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    at = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
    moved = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1), lambda i: F.get("w", at(i).cast("int")))
    return cut.select("doc_id", F.when(F.col("n") > 0, F.array_join(moved, " ")).otherwise(F.col("text")).alias("text"))


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the strongest run with its exponent in thousandths, and hashes of all runs and of the collapsed text."""
    best = lambda c: F.col(f"strongest.{c}").alias(c)
    exponent = F.expr("strongest.length * 1000 div strongest.period")
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    text: Column = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, F.lit("\n")).otherwise(F.lit("")))
    return found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), best("start"), best("length"), best("period"),
        exponent.alias("exponent_milli"), F.sha2(text, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
