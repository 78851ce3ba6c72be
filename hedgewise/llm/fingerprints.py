"""Document fingerprints by one-permutation MinHash.

Every shingle (five words, A-Z in lower case) is hashed once: the high bits pick a bin, the low bits compete
for the bin's minimum. Empty bins borrow the minimum of a bin drawn by a hash of (bin, attempt) until that
one is full (optimal densification), so equal sets stay equal and two sets agree in a bin with probability
equal to their resemblance. Only the low ``BITS`` bits of each minimum are kept, packed; the chance agreement
of random low bits is taken out again when two fingerprints are compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from hedgewise.llm.common import hash_words, mix64, shingle_hashes, slices, split_words, texts_of
from hedgewise.operators.ranks import with_bucket

BINS, BITS, SHINGLE = 256, 4, 5
ATTEMPTS = 64  # draws before the next full bin to the right is taken
EMPTY = "empty"
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_DRAWS = (mix64(np.arange(1, ATTEMPTS * BINS + 1, dtype=np.uint64)) % np.uint64(BINS)).astype(np.int64).reshape(ATTEMPTS, BINS)


def bin_minima(shingles: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The densified minima of each text, one row of ``BINS``, and which texts have no shingle at all."""
    owner = np.repeat(np.arange(len(counts)), counts)
    bins = (shingles >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)
    found = np.full(len(counts) * BINS, _NONE)
    np.minimum.at(found, owner * BINS + bins, mix64(shingles) >> np.uint64(1))
    empty = np.asarray(counts) == 0
    filled = found.copy()
    holes = np.flatnonzero((found == _NONE) & ~np.repeat(empty, BINS))
    for attempt in range(ATTEMPTS):
        if not len(holes):
            break
        row, at = holes - holes % BINS, holes % BINS
        taken = found[row + _DRAWS[attempt][at]]
        filled[holes] = taken
        holes = holes[taken == _NONE]
    if len(holes):  # the nearest full bin to the right, in a circle
        rows = np.unique(holes // BINS)
        full = found.reshape(-1, BINS)[rows] != _NONE
        twice = np.concatenate([full, full], axis=1)
        where = np.where(twice, np.arange(2 * BINS), 4 * BINS)
        right = np.minimum.accumulate(where[:, ::-1], axis=1)[:, ::-1][:, :BINS] % BINS
        of = np.searchsorted(rows, holes // BINS)
        filled[holes] = found[holes - holes % BINS + right[of, holes % BINS]]
    return filled.reshape(-1, BINS), empty


def codes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The kept low bits of each text's minima, and which texts are empty."""
    words, counts = split_words(texts)
    minima, empty = bin_minima(*shingle_hashes(hash_words(words), counts, SHINGLE))
    return (minima & np.uint64((1 << BITS) - 1)).astype(np.uint8), empty


def packed(codes: np.ndarray) -> list[str]:
    """Two 4-bit codes to a byte, as hexadecimal text."""
    raw = (codes[:, ::2] << 4 | codes[:, 1::2]).tobytes()
    width = BINS * BITS // 8
    return [raw[i : i + width].hex() for i in range(0, len(raw), width)]


def likeness(a: np.ndarray, b: np.ndarray, a_empty: np.ndarray, b_empty: np.ndarray) -> np.ndarray:
    """Share of agreeing codes with chance agreement taken out; 1 for two empty texts, 0 for one."""
    chance = 0.5**BITS
    corrected = np.clip(((a == b).mean(axis=1) - chance) / (1 - chance), 0.0, 1.0)
    return np.where(a_empty | b_empty, (a_empty & b_empty).astype(float), corrected)


def _in_order(df: DataFrame, buckets: int) -> DataFrame:
    """Rows by (bucket, descending id), each bucket closed by a copy of the row that follows it.

    Buckets are cut at quantiles of the ids; the copies (one per bucket) are fetched by their ids. So every
    row meets its successor in one shuffle of the texts; the last row's successor is the first row.
    """
    spark = df.sparkSession
    rows = df.withColumn("tie", F.xxhash64("text"))
    cuts = rows.agg(F.percentile_approx("doc_id", [i / buckets for i in range(1, buckets)], 20 * buckets)).first()[0] or []
    at = spark.createDataFrame([(sorted(set(cuts)),)], "cuts array<bigint>").scalar()
    placed = with_bucket(rows, "doc_id", at, max(1, len(set(cuts))))
    # The first row of each bucket in the order; buckets run from the largest ids down.
    heads = placed.groupBy("_bucket").agg(F.max(F.struct("doc_id", "tie")).alias("head")).orderBy(F.col("_bucket").desc()).collect()
    if not heads:
        return placed.withColumn("closing", F.lit(False)).limit(0)
    follows = [(h["_bucket"], *heads[(i + 1) % len(heads)]["head"]) for i, h in enumerate(heads)]
    wanted = spark.createDataFrame(follows, "_bucket int, head_id bigint, head_tie bigint")  # one row per bucket
    same = F.col("doc_id").eqNullSafe(F.col("head_id")) & (F.col("tie") == F.col("head_tie"))
    closing = rows.join(F.broadcast(wanted), same).dropDuplicates(["_bucket"]).select("doc_id", "text", "tie", "_bucket", F.lit(True).alias("closing"))
    both = placed.select("doc_id", "text", "tie", "_bucket", F.lit(False).alias("closing")).unionByName(closing)
    return both.repartition("_bucket").sortWithinPartitions("_bucket", "closing", F.col("doc_id").desc_nulls_last(), F.col("tie").desc())


def fingerprint_pairs(df: DataFrame, doc_id: str = "doc_id", text: str = "text", buckets: int | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited form, and their likeness.

    The edited text keeps the first half and takes the second from the beginning of the next document in
    descending id order. A null text is empty; an empty text's fingerprint is ``empty``. Rows with equal ids
    follow one another by the hash of their texts. An empty table gives an empty result.
    """
    buckets = buckets or 8 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in slices(batches, 512):
            texts = texts_of(batch).to_pylist()
            rows = list(zip(batch.column("doc_id").to_pylist(), batch.column("closing").to_pylist(), texts, strict=True))
            rows = ([held] if held else []) + rows
            held = rows[-1]
            if len(rows) > 1:
                yield _described(rows)

    rows = df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return _in_order(rows, buckets).select("doc_id", "closing", "text").mapInArrow(
        run, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )


def _described(rows: list[tuple]) -> pa.RecordBatch:
    """All rows but the last, which is only there as a successor."""
    own = [i for i in range(len(rows) - 1) if not rows[i][1]]
    texts = [r[2] for r in rows]
    edited = [texts[i][: len(texts[i]) - len(texts[i]) // 2] + texts[i + 1][: len(texts[i]) // 2] for i in own]
    codes, empty = codes_of(pa.array(texts, pa.large_string()))
    changed, changed_empty = codes_of(pa.array(edited, pa.large_string()))
    at = np.asarray(own, np.int64)
    name = lambda c, e: [EMPTY if x else h for h, x in zip(packed(c), e, strict=True)]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([rows[i][0] for i in own], pa.int64()),
            pa.array([len(texts[i]) for i in own], pa.int64()),
            pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
            pa.array(name(codes[at], empty[at]), pa.string()),
            pa.array(name(changed, changed_empty), pa.string()),
            pa.array(likeness(codes[at], changed, empty[at], changed_empty), pa.float64()),
            pa.array(likeness(codes[at], codes[at + 1], empty[at], empty[at + 1]), pa.float64()),
        ],
        ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )
