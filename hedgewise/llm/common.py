"""What the operators of this package share: the input tables, words and exact hashing of words in numpy."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An input table. Workers that start later find this package wherever the driver was started."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", ROOT)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(modulus: int, remainder: int, doc_id: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves ``remainder``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % modulus == remainder


def draw(seed: int, *columns: str) -> Column:
    """A number in [0, 1) that depends on the seed and the columns' values only."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11).cast("double") / float(1 << 53)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    """The text column with nulls as empty texts.

    A slice is copied: Arrow's string kernels misread arrays that start inside their buffers.
    """
    column = batch.column(name)
    column = column.take(pa.array(np.arange(len(column)))) if column.offset else column
    return pc.fill_null(column.cast(pa.large_string()), "")


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit over all output bits."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case, and how many each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words, parents = lists.flatten(), pc.list_parent_indices(lists)
    some = pc.greater(pc.binary_length(words), 0)
    words, parents = words.filter(some), parents.filter(some)
    return words, np.bincount(parents.to_numpy(zero_copy_only=False), minlength=len(texts)).astype(np.int64)


def hash_words(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word's bytes: a polynomial over the bytes, mixed with the length."""
    words = words.cast(pa.large_binary())
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64)
    _, offsets, data = words.buffers()
    ends = np.frombuffer(offsets, np.int64)[words.offset : words.offset + n + 1]
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    length = np.diff(ends)
    starts = (ends[:-1] - ends[0]).astype(np.int64)
    powers = np.cumprod(np.full(int(length.max(initial=0)) + 1, 0x9E3779B97F4A7C15 | 1, np.uint64))
    within = np.arange(len(raw), dtype=np.int64) - np.repeat(starts, length)
    parts = (raw.astype(np.uint64) + np.uint64(1)) * powers[within]
    out = np.zeros(n, np.uint64)
    full = length > 0
    if full.any():
        out[full] = np.add.reduceat(parts, starts[full])
    return mix64(out + length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def shingle_hashes(word_hashes: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of ``size`` words of each text, and how many each text has.

    A text with fewer words has one shingle, its whole sequence; one without words has none.
    """
    n, total = np.asarray(counts, np.int64), len(word_hashes)
    shingles = np.where(n == 0, 0, np.maximum(n - size + 1, 1))
    first = np.cumsum(n) - n
    starts = np.repeat(first, shingles) + (np.arange(shingles.sum()) - np.repeat(np.cumsum(shingles) - shingles, shingles))
    width = np.repeat(np.minimum(n, size), shingles)
    out = np.zeros(len(starts), np.uint64)
    for j in range(size):
        at = np.minimum(starts + j, max(total - 1, 0))
        step = mix64(out * np.uint64(0x9E3779B97F4A7C15) + word_hashes[at] + np.uint64(j + 1)) if total else out
        out = np.where(j < width, step, out)
    return out, shingles


def slices(batches: Iterator[pa.RecordBatch], rows: int, nbytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows`` rows and ``nbytes`` bytes (or one row), which bounds memory."""
    for batch in batches:
        sizes = np.zeros(batch.num_rows, np.int64)
        for column in batch.columns:
            if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
                sizes += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        upto, at = np.cumsum(sizes), 0
        while at < batch.num_rows:
            before = upto[at - 1] if at else 0
            end = int(np.searchsorted(upto, before + nbytes, side="right"))
            end = min(max(end, at + 1), at + rows, batch.num_rows)
            yield batch.slice(at, end - at)
            at = end


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of the texts one after another, and the length of each."""
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None and len(texts) else np.zeros(0, np.uint8)
    return raw, np.diff(ends)
