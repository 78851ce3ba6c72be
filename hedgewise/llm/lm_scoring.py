"""A log-bilinear language model trained by noise-contrastive estimation, with normalised token probabilities.

Words (A-Z in lower case) and an end per text are tokens. The most frequent ``HEAD`` words are symbols of
their own; every other word belongs to one of ``TAIL`` symbols by its last two bytes, within which it has its
smoothed share. The model predicts a symbol from the two before it:

    s(w | a, b) = (r_a * c_1 + r_b * c_2) . t_w + bias_w

1. exact counts of all words are added up by Spark and kept as a table;
2. every task trains on all tokens of its own documents by noise-contrastive estimation (minibatches, noise
   symbols shared inside one, Adagrad); the tasks' parameters are averaged by Spark, weighted by tokens, and
   the next epoch starts from the average;
3. the normaliser of every pair of context symbols is worked out by batched matrix products, so that each
   token's log-probability is exactly normalised and costs four lookups;
4. documents are scored in one pass. Counts of frequent words come from a dictionary of bounded size; rarer
   words are joined with the count table, and as none of them is frequent, no join key is hot.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from hedgewise.llm.common import slices, split_words, texts_of
from hedgewise.session import materialise

HEAD, TAIL = 1024, 128
SYMBOLS = HEAD + TAIL + 1  # the last one is the end of a text
END = SYMBOLS - 1
START = SYMBOLS  # stands before a text, is never predicted
SIZE = 24
EPOCHS, BATCH, NOISE, WEIGHT, RATE = 2, 8192, 48, 12.0, 0.05
DICTIONARY = 1 << 18  # words whose counts are handed to every task
ADD = 1.0
SLICE_BYTES = 3 << 20  # text that a task holds as symbols at a time


@dataclass
class Vocabulary:
    """``head``: the frequent words; ``unigram``: training counts by symbol; tails' tokens and distinct words; totals."""

    head: list[str]
    unigram: np.ndarray
    tail_words: np.ndarray
    tokens: int
    distinct: int
    ends: int

    def symbols(self, words: pa.Array) -> np.ndarray:
        """The symbol of each word."""
        at = pc.index_in(words, value_set=pa.array(self.head, pa.large_string())).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = pc.binary_slice(words.cast(pa.large_binary()), -2, None).dictionary_encode()
        tail = np.array([zlib.crc32(e) % TAIL for e in ends.dictionary.to_pylist()], np.int64)
        return np.where(at >= 0, at, HEAD + tail[ends.indices.to_numpy()] if len(words) else 0)

    @property
    def tail_total(self) -> np.ndarray:
        """The denominator of a word's share of its tail symbol: known words smoothed by ADD, and one unit for all unknown."""
        return self.unigram[HEAD:END] + ADD * self.tail_words + ADD


@dataclass
class Model:
    vocabulary: Vocabulary
    context: np.ndarray  # r, one row per symbol and START
    target: np.ndarray  # t
    mix: np.ndarray  # c_1, c_2
    bias: np.ndarray

    def flat(self) -> np.ndarray:
        return np.concatenate([x.reshape(-1) for x in (self.context, self.target, self.mix, self.bias)]).astype(np.float64)

    def with_flat(self, values: np.ndarray) -> Model:
        out, at = [], 0
        for x in (self.context, self.target, self.mix, self.bias):
            out.append(values[at : at + x.size].reshape(x.shape))
            at += x.size
        return Model(self.vocabulary, *out)


def word_counts(df: DataFrame, training: Column, text: str = "text") -> DataFrame:
    """word, c (in training rows), c_all (in all rows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1 << 14):
            words, counts = split_words(texts_of(batch))
            coded = words.dictionary_encode()
            learn = np.repeat(batch.column("learn").to_numpy(zero_copy_only=False), counts)
            at, size = coded.indices.to_numpy(), len(coded.dictionary)
            taught = np.bincount(at[learn], minlength=size).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [coded.dictionary.cast(pa.string()), pa.array(taught), pa.array(np.bincount(at, minlength=size).astype(np.int64))], ["word", "c", "c_all"]
            )

    rows = df.select(F.col(text).alias("text"), training.alias("learn"))
    partial = rows.mapInArrow(run, "word string, c bigint, c_all bigint")
    return materialise(partial.groupBy("word").agg(F.sum("c").alias("c"), F.sum("c_all").alias("c_all")), "word-counts")


def vocabulary(counts: DataFrame, ends: int) -> Vocabulary:
    """From the count table and the number of training texts; HEAD words and TAIL sums come to the driver."""
    known = counts.filter("c > 0")
    head = [r["word"] for r in known.orderBy(F.col("c").desc(), "word").limit(HEAD).select("word").collect()]
    bare = Vocabulary(head, np.zeros(SYMBOLS), np.zeros(TAIL), 0, 0, ends)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, v = np.zeros(SYMBOLS, np.int64), np.zeros(SYMBOLS, np.int64)
        for batch in batches:
            at = bare.symbols(batch.column("word").cast(pa.large_string()))
            n += np.bincount(at, weights=batch.column("c").to_numpy(), minlength=SYMBOLS).astype(np.int64)
            v += np.bincount(at, minlength=SYMBOLS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(SYMBOLS)), pa.array(n), pa.array(v)], ["symbol", "n", "v"])

    sums = known.select("word", "c").mapInArrow(run, "symbol bigint, n bigint, v bigint").groupBy("symbol").agg(F.sum("n").alias("n"), F.sum("v").alias("v"))
    unigram, distinct = np.zeros(SYMBOLS), np.zeros(SYMBOLS)
    for r in sums.collect():
        unigram[r["symbol"]], distinct[r["symbol"]] = r["n"], r["v"]
    unigram[END] = ends
    return Vocabulary(head, unigram, distinct[HEAD:END], int(unigram.sum()), int(distinct.sum()) + (ends > 0), ends)


def _sequence(vocab: Vocabulary, texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray, np.ndarray]:
    """Coded words; their numbers per text; all symbols with the ends; where each text's symbols begin."""
    words, counts = split_words(texts)
    coded = words.dictionary_encode()
    symbols = vocab.symbols(coded.dictionary)[coded.indices.to_numpy()] if len(words) else np.zeros(0, np.int64)
    full = np.full(len(symbols) + len(counts), END, np.int64)
    full[np.arange(len(symbols)) + np.repeat(np.arange(len(counts)), counts)] = symbols
    begins = np.cumsum(counts + 1) - (counts + 1)
    return coded, counts, full, begins


def _contexts(full: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols two and one before each."""
    back2, back1 = np.full(len(full), START, np.int64), np.full(len(full), START, np.int64)
    back1[1:], back2[2:] = full[:-1], full[:-2]
    back1[begins] = START
    back2[begins] = START
    after = begins + 1
    back2[after[after < len(full)]] = START
    return back2, back1


def _train(model: Model, stream: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], seed: int) -> tuple[np.ndarray, int]:
    """One pass of noise-contrastive estimation over (back2, back1, target) arrays."""
    noise = (model.vocabulary.unigram + 1.0) / (model.vocabulary.unigram + 1.0).sum()
    cut, log_noise = np.cumsum(noise), np.log(WEIGHT * noise).astype(np.float32)
    r, t, c, b = (x.astype(np.float32) for x in (model.context, model.target, model.mix, model.bias))
    seen = [np.full(x.shape, 1e-2, np.float32) for x in (r, t, c, b)]
    draws = np.random.default_rng(seed)
    dims = np.arange(SIZE)
    total = 0

    def scatter(at: np.ndarray, values: np.ndarray, rows: int) -> np.ndarray:
        return np.bincount((at[:, None] * SIZE + dims).reshape(-1), weights=values.reshape(-1), minlength=rows * SIZE).reshape(rows, SIZE)

    for back2, back1, target in stream:
        for k in range(0, len(target), BATCH):
            a, p, w = back2[k : k + BATCH], back1[k : k + BATCH], target[k : k + BATCH]
            n = np.minimum(np.searchsorted(cut, draws.random(NOISE)), SYMBOLS - 1)
            ra, rp, tw, tn = r[a], r[p], t[w], t[n]
            x = ra * c[0] + rp * c[1]
            good = 1 / (1 + np.exp((x * tw).sum(axis=1) + b[w] - log_noise[w]))
            bad = -(WEIGHT / NOISE) / (1 + np.exp(-(x @ tn.T + b[n] - log_noise[n])))
            dx = good[:, None] * tw + bad @ tn
            grads = (
                scatter(np.concatenate([a, p]), np.concatenate([dx * c[0], dx * c[1]]), len(r)),
                scatter(np.concatenate([w, n]), np.concatenate([good[:, None] * x, bad.T @ x]), len(t)),
                np.stack([(dx * ra).sum(axis=0), (dx * rp).sum(axis=0)]),
                np.bincount(np.concatenate([w, n]), weights=np.concatenate([good, bad.sum(axis=0)]), minlength=len(b)),
            )
            for value, grad, square in zip((r, t, c, b), grads, seen, strict=True):
                g = (grad / len(w) * 64).astype(np.float32)
                square += g * g
                value += RATE * g / np.sqrt(square)
            total += len(w)
    return np.concatenate([v.reshape(-1) for v in (r, t, c, b)]), total


def fit(df: DataFrame, training: Column, counts: DataFrame, text: str = "text") -> Model:
    """Train on all training rows. The order of rows inside a task does not depend on anything but the input files."""
    ends = df.filter(training).count()
    vocab = vocabulary(counts, ends)
    start = np.random.default_rng(7)
    small = lambda *shape: (start.random(shape) - 0.5) * 0.2
    model = Model(vocab, small(SYMBOLS + 1, SIZE), small(SYMBOLS, SIZE), np.ones((2, SIZE)), np.log((vocab.unigram + 1) / (vocab.unigram + 1).sum()))
    rows = df.filter(training).select(F.col(text).alias("text"))
    for _ in range(EPOCHS):
        shared = df.sparkSession.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            known = shared.value

            def stream() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
                for batch in slices(batches, 1 << 14, SLICE_BYTES):
                    _, _, full, begins = _sequence(known.vocabulary, texts_of(batch))
                    yield *_contexts(full, begins), full

            values, n = _train(known, stream(), TaskContext.get().partitionId())
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([float(n)]), pa.array([values.tolist()], pa.list_(pa.float64()))], ["n", "v"])

        parts = rows.mapInArrow(run, "n double, v array<double>").select("n", F.posexplode("v").alias("at", "x"))
        mean = parts.groupBy("at").agg((F.sum(F.col("n") * F.col("x")) / F.sum("n")).alias("x")).toPandas()
        if len(mean):
            values = model.flat()
            values[mean["at"].to_numpy()] = mean["x"].to_numpy()
            model = model.with_flat(values)
    return model


def normalisers(spark, model: Model) -> np.ndarray:
    """log sum_w exp s(w | a, b) for all context symbols a (rows) and b, by one matrix product per row."""
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        target, bias = m.target.astype(np.float32).T, m.bias.astype(np.float32)
        for batch in batches:
            for a in batch.column("id").to_pylist():
                s = (m.context[a] * m.mix[0] + m.context * m.mix[1]).astype(np.float32) @ target + bias
                top = s.max(axis=1)
                value = top + np.log(np.exp(s - top[:, None]).sum(axis=1, dtype=np.float64))
                yield pa.RecordBatch.from_arrays([pa.array([a]), pa.array([value.tolist()], pa.list_(pa.float64()))], ["a", "v"])

    out = np.zeros((SYMBOLS + 1, SYMBOLS + 1))
    for r in spark.range(0, SYMBOLS + 1, 1, 24).mapInArrow(run, "a bigint, v array<double>").toLocalIterator():
        out[r["a"]] = r["v"]
    return out


@dataclass
class Scorer:
    """Everything a task needs: lookup tables of log10 parts, and counts of the frequent words."""

    vocabulary: Vocabulary
    far: np.ndarray
    near: np.ndarray
    words: pa.Array
    counts: np.ndarray


def scorer(spark, model: Model, counts: DataFrame) -> Scorer:
    """Frequent words are those above the smallest count that leaves at most DICTIONARY of them."""
    level = F.floor(F.log2(F.col("c_all").cast("double")) * 8)
    sizes = counts.groupBy(level.alias("level")).agg(F.count("*").alias("n"), F.min("c_all").alias("least")).collect()
    least, held = None, 0
    for r in sorted(sizes, key=lambda r: -r["level"]):
        if held + r["n"] > DICTIONARY:
            break
        held, least = held + r["n"], r["least"]
    frequent = counts.filter(F.col("c_all") >= least).select("word", "c").toArrow() if least is not None else None
    words = frequent.column("word").cast(pa.large_string()).combine_chunks() if frequent is not None else pa.array([], pa.large_string())
    number = frequent.column("c").to_numpy() if frequent is not None else np.zeros(0, np.int64)
    m, log = model, normalisers(spark, model)
    far = ((m.context * m.mix[0]) @ m.target.T + m.bias).astype(np.float32)
    near = ((m.context * m.mix[1]) @ m.target.T).astype(np.float32)
    return Scorer(m.vocabulary, far, near, words, number), log.astype(np.float32)


def score(df: DataFrame, model: Model, counts: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score per row.

    ``base_score`` is the smoothed unigram log10 probability, ``score`` the model's. A null or empty text is
    its end token alone. Repeated rows are scored each; an empty table gives an empty result. Without any
    training text all words are unknown and every score is finite. Words equally frequent are taken in
    alphabetical order where the vocabulary ends between them.
    """
    spark = df.sparkSession
    known, log = scorer(spark, model, counts)
    shared = spark.sparkContext.broadcast((known, log))  # (SYMBOLS + 1) ** 2 numbers three times, and DICTIONARY words
    vocab = model.vocabulary
    base_total = np.log10(vocab.tokens + ADD * (vocab.distinct + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (s, log_z), part, row = shared.value, TaskContext.get().partitionId(), 0
        tail_log = np.log10(s.vocabulary.tail_total)
        ends_log = np.log10(s.vocabulary.ends + ADD)
        for batch in slices(batches, 1 << 14, SLICE_BYTES):
            coded, n, full, begins = _sequence(s.vocabulary, texts_of(batch))
            back2, back1 = _contexts(full, begins)
            value = (s.far[back2, full] + s.near[back1, full] - log_z[back2, back1]).astype(np.float64) / np.log(10)
            tail = (full >= HEAD) & (full < END)
            value[tail] -= tail_log[full[tail] - HEAD]
            model_part = np.add.reduceat(value, begins) if len(full) else np.zeros(0)

            at = pc.index_in(coded.dictionary, value_set=s.words).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            held = at >= 0
            c = np.where(held, s.counts[np.maximum(at, 0)] if len(s.counts) else 0, 0)
            logs = np.where(held, np.log10(c + ADD), 0.0)
            where, owner = coded.indices.to_numpy(), np.repeat(np.arange(len(n)), n)
            total = lambda x: np.bincount(owner, weights=x, minlength=len(n))
            in_tail = s.vocabulary.symbols(coded.dictionary) >= HEAD if len(coded.dictionary) else np.zeros(0, bool)
            base = total(logs[where]) + ends_log
            tail_logs = total(np.where(in_tail, logs, 0.0)[where])
            known_tokens = total((held & (c > 0)).astype(float)[where]) + (s.vocabulary.ends > 0)

            rare = ~held[where]
            pair, times = np.unique(owner[rare] * max(1, len(held)) + where[rare], return_counts=True)
            sizes = np.bincount(pair // max(1, len(held)), minlength=len(n)) if len(pair) else np.zeros(len(n), np.int64)
            names = coded.dictionary.cast(pa.string()).take(pa.array(pair % max(1, len(held))))
            items = pa.StructArray.from_arrays([names, pa.array(times.astype(np.int64))], ["word", "tf"])
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            uid = (part << 40) + row + np.arange(len(n))
            row += len(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(uid), batch.column("doc_id"), pa.array(n + 1), pa.array(known_tokens.astype(np.int64)), pa.array(base - (n + 1) * base_total),
                 pa.array(model_part + tail_logs), pa.ListArray.from_arrays(offsets, items)],
                ["uid", "doc_id", "n_tokens", "n_known", "base_score", "score", "rare"],
            )

    rows = df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    schema = "uid bigint, doc_id bigint, n_tokens bigint, n_known bigint, base_score double, score double, rare array<struct<word:string,tf:bigint>>"
    scored = materialise(rows.mapInArrow(run, schema), "scored")
    rare = scored.select("uid", F.explode("rare").alias("r")).select("uid", F.col("r.word").alias("word"), F.col("r.tf").alias("tf"))
    met = rare.join(counts.filter("c > 0").select("word", "c"), "word")  # an unknown word adds log10(0 + ADD) = 0
    added = met.groupBy("uid").agg(F.sum("tf").alias("_known"), F.sum(F.col("tf") * F.log10(F.col("c") + ADD)).alias("_log"))
    more, known_more = F.coalesce(F.col("_log"), F.lit(0.0)), F.coalesce(F.col("_known"), F.lit(0))
    return scored.drop("rare").join(added, "uid", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + known_more).alias("n_known"),
        F.lit(vocab.tokens).cast("bigint").alias("train_tokens"),
        (F.col("base_score") + more).alias("base_score"),
        (F.col("score") + more).alias("score"),
    )
