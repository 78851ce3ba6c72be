"""Language identification by prediction by partial matching over bytes.

Every language has a context tree of up to ``ORDER`` bytes, built from a sample of labelled texts and then
frozen. A byte is coded in the longest context the tree holds for the bytes before it; a byte not seen there
costs an escape (method C: as many escape counts as distinct followers) and is coded in the next shorter
context without the bytes already excluded, and at last uniformly among what is left. The language whose
tree codes the whole text in the fewest bits is predicted; the score is its posterior under equal priors.

As statistics are frozen, the cost of every (context, byte) is worked out once; a text is then scored by two
table lookups per byte and language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from hedgewise.llm.common import draw, raw_bytes, slices, texts_of

ORDER = 3
SYMBOLS = 128  # the most frequent bytes have a symbol of their own, the others share symbol 0
SAMPLE_DOCS = 400  # expected labelled texts per language that the trees are built from
LEAST = 3  # a context that occurred less often is left out, its bytes are coded in the shorter one
UNDETERMINED = "und"
BLOCK = 1 << 20


@dataclass
class Trees:
    """Per language: context keys per length, and bits per (context, symbol); the symbol of every byte."""

    names: list[str]
    symbol: np.ndarray
    keys: list[list[np.ndarray]]
    bits: list[np.ndarray]
    base: int

    def lookups(self) -> list[np.ndarray]:
        """For every ``ORDER`` symbols, the number of the longest context that the language's tree holds."""
        found = []
        for levels in self.keys:
            full = np.zeros((self.base,) * ORDER, np.int32)
            number = 1
            for length, keys in enumerate(levels, 1):
                symbols = np.stack(np.unravel_index(keys, (self.base,) * length))
                view = np.moveaxis(full, range(ORDER - length), range(length, ORDER)) if length < ORDER else full
                view[tuple(symbols)] = (number + np.arange(len(keys)))[(slice(None), *[None] * (ORDER - length))]
                number += len(keys)
            found.append(full.reshape(-1))
        return found


def build_trees(grams: dict[str, tuple[np.ndarray, np.ndarray]]) -> Trees:
    """Trees from each language's counted runs of ``ORDER`` + 1 bytes (packed big-endian, 256 = before the text)."""
    names = sorted(grams)
    totals = np.zeros(257)
    for keys, counts in grams.values():
        np.add.at(totals, keys % 257, counts)
    common = np.argsort(-totals[:256], kind="stable")[: SYMBOLS - 1]
    symbol = np.zeros(257, np.int64)
    symbol[common[totals[common] > 0]] = np.arange(1, 1 + (totals[common] > 0).sum())
    symbol[256] = SYMBOLS
    others = 256 - int((symbol[:256] > 0).sum())
    base = SYMBOLS + 1
    keys_of, bits_of = [], []
    for name in names:
        packed, counts = grams[name]
        run = [symbol[packed // 257**k % 257] for k in range(ORDER, -1, -1)]
        levels, dense, parents, previous = [], [], [], None
        for length in range(ORDER + 1):
            context = np.zeros(len(packed), np.int64)
            for part in run[ORDER - length : ORDER]:
                context = context * base + part
            found, at = np.unique(context, return_inverse=True)
            table = np.bincount(at * base + run[ORDER], weights=counts, minlength=len(found) * base).reshape(-1, base)[:, :SYMBOLS]
            if length:
                parent = np.searchsorted(previous, found % base ** (length - 1)) if length > 1 else np.zeros(len(found), np.int64)
                known = (previous[np.minimum(parent, len(previous) - 1)] == found % base ** (length - 1)) if length > 1 else True
                kept = (table.sum(axis=1) >= LEAST) & known
                found, table, parent = found[kept], table[kept], parent[kept]
                levels.append(found)
                parents.append(parent)
            previous = found
            dense.append(table)
        keys_of.append(levels)
        bits_of.append(_bits(dense, parents, others))
    return Trees(names, symbol[:256].astype(np.int64), keys_of, bits_of, base)


def _bits(dense: list[np.ndarray], parents: list[np.ndarray], others: int) -> np.ndarray:
    """Exact code lengths with exclusion, one row per context (the empty one first)."""
    rows = []
    for length, own in enumerate(dense):
        bits, spent, excluded = np.zeros(own.shape), np.zeros(len(own)), np.zeros(own.shape, bool)
        at = np.arange(len(own))
        for level in range(length, -1, -1):
            counts = np.where(excluded, 0.0, dense[level][at])
            total, distinct = counts.sum(axis=1), (counts > 0).sum(axis=1)
            some = total > 0
            whole = np.log2(np.where(some, total + distinct, 1.0))
            seen = counts > 0
            bits = np.where(seen, spent[:, None] + whole[:, None] - np.log2(np.where(seen, counts, 1.0)), bits)
            spent = spent + np.where(some, whole - np.log2(np.where(some, distinct, 1)), 0.0)
            excluded |= seen
            if level:
                at = parents[level - 1][at]
        # What no context holds is equally likely; symbol 0 stands for several bytes.
        left = np.where(excluded, 0, np.where(np.arange(own.shape[1]) == 0, others, 1)).sum(axis=1)
        bits = np.where(excluded, bits, spent[:, None] + np.log2(np.maximum(left, 1))[:, None])
        bits[:, 0] += np.where(excluded[:, 0], np.log2(max(others, 1)), 0.0)
        rows.append(bits)
    return np.concatenate(rows).astype(np.float32)


def code_lengths(trees: Trees, lookups: list[np.ndarray], texts: pa.Array) -> np.ndarray:
    """Bits of every whole text under every language."""
    raw, sizes = raw_bytes(texts)
    out = np.zeros((len(sizes), len(trees.names)))
    ends = np.cumsum(sizes)
    starts = ends - sizes
    for at in range(0, len(raw), BLOCK):
        end = min(at + BLOCK, len(raw))
        first, last = np.searchsorted(ends, at, side="right"), np.searchsorted(starts, end, side="left")
        begins = np.maximum(starts[first:last], at) - at
        own = begins[np.append(begins[1:] > begins[:-1], True)] if len(begins) else begins
        which = first + np.flatnonzero(np.append(begins[1:] > begins[:-1], True))
        symbols = trees.symbol[raw[at:end]].astype(np.int32)
        key = np.zeros(end - at, np.int32)
        position = np.arange(at, end) - np.repeat(starts[which], np.diff(np.append(own, end - at)))
        for back in range(ORDER, 0, -1):
            before = np.full(end - at, SYMBOLS, np.int32)
            low = max(0, back - at)
            before[low:] = trees.symbol[raw[at + low - back : end - back]]
            key = key * trees.base + np.where(position >= back, before, SYMBOLS)
        for j, (lookup, bits) in enumerate(zip(lookups, trees.bits, strict=True)):
            cost = bits.reshape(-1)[lookup[key].astype(np.int64) * SYMBOLS + symbols]
            out[which, j] += np.add.reduceat(cost.astype(np.float64), own)
    return out


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 1024):
        langs = batch.column("lang").to_pylist()
        for lang in sorted(set(langs)):
            chosen = texts_of(batch).filter(pa.array([x == lang for x in langs]))
            keys = []
            for text in chosen.to_pylist():
                raw = np.concatenate([np.full(ORDER, 256), np.frombuffer(text.encode(), np.uint8)]).astype(np.int64)
                key = np.zeros(len(raw) - ORDER, np.int64)
                for k in range(ORDER + 1):
                    key = key * 257 + raw[k : k + len(key)]
                keys.append(key)
            found, n = np.unique(np.concatenate(keys), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])


def fit(df: DataFrame, training: Column, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Trees:
    """Trees from about ``SAMPLE_DOCS`` texts of each language among the labelled training rows.

    Rows with a null text or label teach nothing. The sample depends on ids only; its n-gram counts are
    added up by Spark, and as many as the sample's bytes at most come to the driver.
    """
    rows = df.filter(training & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).alias("lang"), F.col(text).alias("text"), draw(5, doc_id).alias("_draw")
    )
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    share = F.lit(0.0)
    for name, n in sizes.items():
        share = F.when(F.col("lang") == name, SAMPLE_DOCS / n).otherwise(share)
    counted = rows.filter(F.col("_draw") < share).select("lang", "text").mapInArrow(_gram_counts, "lang string, gram bigint, n bigint")
    counted = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    return build_trees({k: (g["gram"].to_numpy(), g["n"].to_numpy(np.float64)) for k, g in counted.groupby("lang")})


_LOOKUPS: dict[int, tuple[Trees, list[np.ndarray]]] = {}


def predict(df: DataFrame, trees: Trees, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score per row; ``und`` with score 0 for a text without a letter (or no language learned).

    A null or empty text has no letter. Of languages with equal code lengths the first by name is taken.
    Repeated rows are predicted each; an empty table gives an empty result.
    """
    shared = df.sparkSession.sparkContext.broadcast(trees)  # bounded: languages x contexts of the sample x SYMBOLS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        if id(known) not in _LOOKUPS:
            _LOOKUPS.clear()
            _LOOKUPS[id(known)] = (known, known.lookups())
        lookups = _LOOKUPS[id(known)][1]
        for batch in slices(batches, 4096, 4 << 20):
            texts = texts_of(batch)
            letters = pc.match_substring_regex(texts, r"\p{L}").to_numpy(zero_copy_only=False)
            if known.names:
                bits = code_lengths(known, lookups, texts)
                best = bits.argmin(axis=1)
                gap = np.minimum(bits - bits.min(axis=1, keepdims=True), 1000.0)
                score = 1.0 / np.exp2(-gap).sum(axis=1)
            else:
                best, score, letters = np.zeros(len(texts), int), np.zeros(len(texts)), np.zeros(len(texts), bool)
            names = [known.names[b] if ok else UNDETERMINED for b, ok in zip(best, letters, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(names, pa.string()), pa.array(np.where(letters, score, 0.0))], ["doc_id", "lang_pred", "score"]
            )

    return df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, "doc_id bigint, lang_pred string, score double"
    )
