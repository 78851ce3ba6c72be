"""Benchmark decontamination by FM-indexes over shards of the training texts.

Test items become windows of 13 words (a shorter item is one window). Each task cuts its documents into shards
of bounded size, builds an FM-index of each, searches every window backwards through wavelet-matrix ranks,
locates all occurrences by sampled suffix positions and merges them into removal spans.

The index's alphabet is the windows' vocabulary; a run of other words, over which no window can match, is one
separator. Windows are handed to the tasks in blocks of bounded size, one pass over the documents per block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from hedgewise.llm.common import slices, texts_of
from hedgewise.llm.fm_index import FmIndex

WINDOW = 13
SHARD_BYTES = 8 << 20
WINDOWS_PER_BLOCK = 200_000
ONE_IN = 20  # contaminated: at least one word in ONE_IN is hit
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_BYTES = np.arange(256, dtype=np.uint8)
_BYTES[65:91] += 32
_BYTES[: 0x30], _BYTES[0x3A:0x41], _BYTES[0x5B:0x61], _BYTES[0x7B:0x80] = 32, 32, 32, 32


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of each text (A-Z in lower case; digits, letters and all non-ASCII characters), and their number."""
    n = len(texts)
    _, offsets, data = texts.buffers()
    folded = pa.py_buffer(_BYTES[np.frombuffer(data, np.uint8)]) if data is not None and data.size else data
    clean = pa.Array.from_buffers(pa.large_string(), n, [None, offsets, folded])
    lists = pc.ascii_split_whitespace(clean)
    words, owners = lists.flatten(), pc.list_parent_indices(lists)
    some = pc.greater(pc.binary_length(words), 0)
    return words.filter(some), np.bincount(owners.filter(some).to_numpy(zero_copy_only=False), minlength=n).astype(np.int64)


@dataclass
class Block:
    """Windows as rows of word numbers from 1, their lengths, and the items each belongs to."""

    words: list[str]
    windows: np.ndarray
    lengths: np.ndarray
    items: list[list[int]]


def windows_of(benchmark: DataFrame, item_id: str, text: str) -> DataFrame:
    """Distinct windows (arrays of words) with the ids of the items that hold them."""
    words = F.regexp_extract_all(F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER), F.lit(PATTERN), F.lit(0))
    items = benchmark.select(F.col(item_id).cast("bigint").alias("item"), words.alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (WINDOW - 1), F.lit(1)))
    cut = F.transform(starts, lambda i: F.slice("w", i, WINDOW))
    return items.select("item", F.explode(cut).alias("window")).groupBy("window").agg(F.array_sort(F.collect_set("item")).alias("items"))


def _block(rows: list) -> Block:
    words = sorted({w for r in rows for w in r["window"]})
    number = {w: i for i, w in enumerate(words, 1)}
    lengths = np.array([len(r["window"]) for r in rows], np.int64)
    windows = np.zeros((len(rows), WINDOW), np.int64)
    for i, r in enumerate(rows):
        windows[i, : lengths[i]] = [number[w] for w in r["window"]]
    return Block(words, windows, lengths, [list(r["items"]) for r in rows])


def find(texts: pa.Array, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words per text; and for every occurrence its text, first word (within the shard) and window."""
    words, counts = words_of(texts)
    numbers = pc.index_in(words, value_set=pa.array(block.words, pa.large_string())).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    owner = np.repeat(np.arange(len(counts)), counts)
    # Runs of other words shrink to one separator; a new text begins with one.
    begins = np.zeros(len(numbers), bool)
    begins[(np.cumsum(counts) - counts)[counts > 0]] = True
    other = numbers == 0
    kept = ~(other & np.concatenate([[False], other[:-1]]))
    width = kept.astype(np.int64) + (begins & ~other)
    place = np.cumsum(width) - 1
    symbols, origin = np.zeros(int(width.sum()), np.int64), np.zeros(int(width.sum()), np.int64)
    symbols[place[kept]], origin[place[kept]] = numbers[kept], np.flatnonzero(kept)
    if not len(symbols) or not len(block.lengths):
        return counts, *[np.zeros(0, np.int64)] * 3
    index = FmIndex(symbols, len(block.words) + 1)
    low, high = index.search(block.windows, block.lengths)
    times = high - low
    window = np.repeat(np.arange(len(times)), times)
    rows = np.repeat(low, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    start = origin[index.locate(rows)]
    return counts, owner[start], start, window


def _merged(counts: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Which words lie inside an occurrence."""
    edge = np.zeros(int(counts.sum()) + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + length, -1)
    return np.cumsum(edge[:-1]) > 0


def decontaminate(
    df: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
    item_text: str = "text", carry: list[str] | None = None,
) -> DataFrame:
    """Per row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans, items and the columns in ``carry``.

    ``spans`` are the merged removal spans [first word, end); ``items`` the sorted ids of the items found. A
    null text has no words; an item without words has no window; an empty benchmark hits nothing. Repeated
    rows are judged each, copies of an item all count as found, and an empty table gives an empty result.
    Carried columns keep their names, so they must not be called like a result column.
    """
    carry = list(carry or [])
    windows = windows_of(benchmark, item_id, item_text).withColumn("part", F.xxhash64("window"))
    blocks = max(1, -(-windows.count() // WINDOWS_PER_BLOCK))
    out = df.select(
        F.col(doc_id).cast("bigint").alias("doc_id"),
        F.col(text).alias("text"),
        F.struct(*[F.col(c) for c in carry], F.lit(0).alias("_")).alias("row"),
        F.lit(0).cast("bigint").alias("n_words"),
        F.array().cast("array<struct<first:bigint,end:bigint>>").alias("spans"),
        F.array().cast("array<bigint>").alias("items"),
    )
    for number in range(blocks):
        rows = windows.filter(F.pmod("part", F.lit(blocks)) == number).select("window", "items").collect()
        shared = df.sparkSession.sparkContext.broadcast(_block(rows))  # at most about WINDOWS_PER_BLOCK windows
        out = out.mapInArrow(_pass(shared), out.schema)
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda s, x: s + x["end"] - x["first"])
    ids = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    out = out.withColumn("n_hit", hit)
    return out.select(
        "doc_id",
        *[F.col("row")[c].alias(c) for c in carry if c != doc_id],
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (ONE_IN * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
        "spans",
        "items",
    )


def _pass(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        for batch in slices(batches, 1 << 14, SHARD_BYTES):
            counts, owner, start, window = find(texts_of(batch), block)
            first = np.cumsum(counts) - counts
            spans, items = batch.column("spans").to_pylist(), batch.column("items").to_pylist()
            touched = set(owner.tolist()) | {i for i, s in enumerate(spans) if s}
            if touched:
                for i, found in enumerate(spans):  # what earlier blocks found
                    for s in found:
                        owner, start = np.append(owner, i), np.append(start, first[i] + s["first"])
                lengths = np.concatenate([block.lengths[window], np.array([s["end"] - s["first"] for f in spans for s in f], np.int64)])
                hit = _merged(counts, start, lengths)
                order = np.argsort(owner[: len(window)], kind="stable")
                cuts = np.searchsorted(owner[: len(window)][order], np.arange(len(counts) + 1))
                for i in sorted(touched):
                    own = np.concatenate([[0], hit[first[i] : first[i] + counts[i]].astype(np.int8), [0]])
                    edges = np.flatnonzero(np.diff(own))
                    spans[i] = [{"first": int(a), "end": int(b)} for a, b in zip(edges[::2], edges[1::2], strict=True)]
                    items[i] = sorted({x for w in set(window[order[cuts[i] : cuts[i + 1]]].tolist()) for x in block.items[w]} | set(items[i]))
            columns = {name: batch.column(name) for name in batch.schema.names}
            columns["n_words"] = pa.array(counts)
            columns["spans"] = pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())])))
            columns["items"] = pa.array(items, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run


def digest(found: DataFrame) -> DataFrame:
    """The columns that describe a document's contamination, without the spans."""
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{PATTERN}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{PATTERN}') AS w FROM benchmark),
bw AS (
  SELECT item_id, least(len(w), {WINDOW}) AS l, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {WINDOW - 2}, 2))) AS i FROM b WHERE len(w) > 0)
),
sizes AS (SELECT DISTINCT l FROM bw),
dw AS (
  SELECT doc_id, i, l, array_to_string(w[i:i + l - 1], ' ') AS win
  FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM d, sizes WHERE len(w) >= l)
),
found AS (SELECT doc_id, i, l, item_id FROM dw JOIN bw USING (l, win)),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + l)) AS p FROM found) GROUP BY 1),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM found) GROUP BY 1
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND {ONE_IN} * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""
