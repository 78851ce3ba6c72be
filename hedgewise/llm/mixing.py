"""Mixing documents to target domain weights by soft membership.

A classifier trained on a labelled table gives every document a probability for each domain. Document rates
r >= 0 are fitted so that the expected domain tokens ``sum_i tokens_i * p_ik * r_i`` meet the targets: least
squares by implicit projected-gradient (proximal) steps, starting from r = 1. A step moves a document's rate by
the inner product of its posterior with one vector per step, and that vector is the gradient at the step's end;
it has as many numbers as there are domains and is found by Newton's method. So the rates after any number of
steps follow from the posteriors and the few vectors so far. Every evaluation is one distributed sum of a small
matrix; neither rates nor posteriors leave the workers. Steps end when the targets are met or the rates no
longer move, which is the least-squares optimum of targets that cannot be met.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from hedgewise.llm.common import draw, raw_bytes, slices, texts_of
from hedgewise.session import materialise

SAMPLE_PER_DOMAIN = 400  # expected labelled documents of each domain the classifier is trained on
PAIRS = 512  # hashed pairs of neighbouring bytes
WIDTH = 256 + PAIRS + 3
EPOCHS, RIDGE = 200, 1e-4
STEPS, TOLERANCE = 40, 1e-3  # safety limit on steps; largest miss of a target, in parts of the mean target
EVALUATIONS = 200  # safety limit on evaluations within a step
PULL, SHRINK = 1e-4, 0.1  # weight of staying near the rates of the step before, and its factor from step to step
REST = 1e-8  # bound on what more steps could gain at which targets count as out of reach

log = logging.getLogger(__name__)


@dataclass
class Classifier:
    domains: list[str]
    weights: np.ndarray

    def posteriors(self, features: np.ndarray) -> np.ndarray:
        z = features @ self.weights
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


@dataclass
class Mix:
    classifier: Classifier
    steps: np.ndarray  # one row per step
    targets: dict[str, float]
    totals: dict[str, float]
    settled: bool = True  # False when a safety limit came before the targets were met or the rates came to rest

    def rates(self, posteriors: np.ndarray) -> np.ndarray:
        return rates_after(posteriors, self.steps)


def rates_after(posteriors: np.ndarray, steps: np.ndarray) -> np.ndarray:
    rate = np.ones(len(posteriors))
    for step in steps:
        rate = np.maximum(0.0, rate - posteriors @ step)
    return rate


def describe(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Features of each text (square roots of byte and byte-pair shares, concentration, length) and its words."""
    raw, sizes = raw_bytes(texts)
    n = len(sizes)
    starts = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(n), sizes)
    single = np.bincount(owner * 256 + raw, minlength=n * 256).reshape(n, 256)
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    first = np.ones(len(raw), bool)
    first[1:] = space[:-1]
    first[starts[sizes > 0]] = True
    words = np.bincount(owner[first & ~space], minlength=n)
    code = (raw[:-1].astype(np.uint32) * 2654435761 + raw[1:].astype(np.uint32) * 40503) >> 7 & (PAIRS - 1)
    inside = owner[:-1] == owner[1:] if len(raw) else np.zeros(0, bool)
    pairs = np.bincount(owner[:-1][inside] * PAIRS + code[inside], minlength=n * PAIRS).reshape(n, PAIRS) if len(raw) else np.zeros((n, PAIRS))
    share = pairs / np.maximum(pairs.sum(axis=1, keepdims=True), 1)
    out = np.empty((n, WIDTH))
    out[:, :256] = np.sqrt(single / np.maximum(sizes, 1)[:, None])
    out[:, 256 : 256 + PAIRS] = np.sqrt(share)
    out[:, -3] = 10 * np.square(share).sum(axis=1)
    out[:, -2] = np.log1p(sizes) / 10
    out[:, -1] = 1.0
    return out, words.astype(np.int64)


def fit_classifier(df: DataFrame, labelled: DataFrame, doc_id: str = "doc_id", text: str = "text", domain: str = "domain") -> Classifier:
    """Multinomial logistic regression on about SAMPLE_PER_DOMAIN labelled texts of each domain.

    ``labelled`` has (doc_id, domain); rows with a null label or text teach nothing. The sample depends on ids.
    """
    marks = labelled.filter(F.col(domain).isNotNull()).groupBy(doc_id).agg(F.max(domain).alias("domain"))
    sizes = {r["domain"]: r["n"] for r in marks.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    share = F.lit(0.0)
    for name, n in sizes.items():
        share = F.when(F.col("domain") == name, SAMPLE_PER_DOMAIN / n).otherwise(share)
    picked = marks.filter(draw(21, doc_id) < share).select(F.col(doc_id).alias("_id"), "domain")
    # The sample's ids, bounded by its parameter and the number of domains, go to the texts.
    texts = df.filter(F.col(text).isNotNull()).select(F.col(doc_id).alias("_id"), F.col(text).alias("text"))
    rows = texts.join(F.broadcast(picked), "_id").select("_id", "domain", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 512):
            features, _ = describe(texts_of(batch))
            flat = pa.array(features.astype(np.float32).reshape(-1))
            lists = pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, WIDTH, dtype=np.int32), flat)
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("domain"), lists], ["_id", "domain", "features"])

    found = rows.mapInArrow(run, "_id bigint, domain string, features array<float>").toArrow().sort_by([("_id", "ascending")])
    names = sorted(set(found.column("domain").to_pylist()))
    if not names:
        return Classifier([], np.zeros((WIDTH, 0)))
    x = np.stack(found.column("features").to_pylist()).astype(np.float64)
    y = np.array([names.index(d) for d in found.column("domain").to_pylist()])
    truth = np.eye(len(names))[y]
    share = 1.0 / np.bincount(y)[y] / len(names)
    rate = 2.0 / (np.linalg.norm((x * share[:, None]).T @ x, 2) + RIDGE)
    w = look = np.zeros((WIDTH, len(names)))
    for k in range(EPOCHS):
        z = x @ look
        z = np.exp(z - z.max(axis=1, keepdims=True))
        grad = x.T @ ((z / z.sum(axis=1, keepdims=True) - truth) * share[:, None]) + RIDGE * look
        new = look - rate * grad
        look, w = new + k / (k + 3) * (new - w), new
    return Classifier(names, w)


def _posterior_table(df: DataFrame, classifier: Classifier, text: str) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(classifier)
    k = len(classifier.domains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024, 4 << 20):
            features, words = describe(texts_of(batch))
            flat = pa.array(shared.value.posteriors(features).reshape(-1))
            yield pa.RecordBatch.from_arrays([pa.array(words), pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, k, dtype=np.int32), flat)], ["tokens", "p"])

    return df.select(F.col(text).alias("text")).mapInArrow(run, "tokens bigint, p array<double>")


@dataclass
class Sums:
    """Token-weighted sums under the rates after all steps: expected domain tokens, moments of the documents with a
    rate above zero, squared rates, squared moves of the last step, and tokens."""

    reached: np.ndarray
    moments: np.ndarray
    square: float
    moved: float
    tokens: float

    @staticmethod
    def of(p: np.ndarray, t: np.ndarray, steps: np.ndarray) -> np.ndarray:
        before = rates_after(p, steps[:-1])
        rate = rates_after(p, steps) if not len(steps) else np.maximum(0.0, before - p @ steps[-1])
        moments = (p * (t * (rate > 0))[:, None]).T @ p
        return np.concatenate([p.T @ (t * rate), moments.reshape(-1), [t @ rate**2, t @ (rate - before) ** 2, t.sum()]])

    @classmethod
    def read(cls, v: np.ndarray, k: int) -> Sums:
        return cls(v[:k], v[k : k + k * k].reshape(k, k), *map(float, v[k + k * k :]))


def _sums(table: DataFrame, steps: np.ndarray, k: int) -> Sums:
    """One small row per task is added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k + k * k + 3)
        for batch in batches:
            p, t = batch.column("p").flatten().to_numpy().reshape(-1, k), batch.column("tokens").to_numpy().astype(float)
            total += Sums.of(p, t, steps)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["at", "v"])

    rows = table.mapInArrow(run, "at bigint, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(k + k * k + 3)
    for r in rows:
        out[r["at"]] = r["v"]
    return Sums.read(out, k)


def solve(sums: Callable[[np.ndarray], Sums], wanted: np.ndarray, total: float | None = None) -> tuple[np.ndarray, np.ndarray, Sums, bool]:
    """Steps, targets, the sums after the steps, and whether the iteration ended by itself.

    Minimises the miss in the metric of all documents' moments. A step minimises miss / 2 + pull / 2 * (move of the
    rates)^2: its vector maximises a concave dual function of as many numbers as there are domains. The gradient at
    its end is pull * move, so pull * move * (size of the rates) bounds what is left to gain, to a factor.
    """
    k = len(wanted)
    steps = np.zeros((0, k))
    now = sums(steps)
    targets = wanted / wanted.sum() * (now.reached.sum() if total is None else total)
    size, whole = max(now.tokens, 1.0), now.moments
    values, vectors = np.linalg.eigh(whole / size)
    basis = vectors[:, values > 1e-9 * max(values.max(), 1e-300)]  # directions in which documents differ at all
    aim = basis @ (basis.T @ targets)
    limit = TOLERANCE * max(targets.sum(), 1.0) / k

    def gap(at: Sums, vector: np.ndarray) -> np.ndarray:
        return basis.T @ (at.reached - aim - pull * whole @ vector) / size

    def cost(at: Sums, vector: np.ndarray) -> float:
        return (at.square / 2 + aim @ vector + pull / 2 * vector @ whole @ vector) / size

    while np.abs(now.reached - targets).max() > limit and basis.shape[1]:
        if len(steps) == STEPS:
            return steps, targets, now, False
        pull, vector = PULL * SHRINK ** len(steps), np.zeros(k)
        at = sums(np.vstack([steps, vector]))
        for _ in range(EVALUATIONS):
            slope = gap(at, vector)
            if np.abs(slope).max() * size <= limit / 10:
                break
            curve = basis.T @ (at.moments + pull * whole) @ basis / size
            move, length = np.linalg.solve(curve, slope), 1.0
            while True:
                trial = vector + length * basis @ move
                there = sums(np.vstack([steps, trial]))
                if cost(there, trial) <= cost(at, vector) - 1e-4 * length * slope @ move or length < 1e-6:
                    break
                length /= 2
            if length < 1e-6:
                return steps, targets, now, False
            vector, at = trial, there
        else:
            return steps, targets, now, False
        steps, now = np.vstack([steps, vector]), at
        if pull * np.sqrt(now.moved * (now.square + now.moved)) / size <= REST:
            break
    return steps, targets, now, True


def fit(df: DataFrame, classifier: Classifier, weights: dict[str, float], text: str = "text", total: float | None = None) -> Mix:
    """Rates for ``df`` so that its domains' expected tokens are ``weights`` (scaled to 1) of ``total`` (default: all its tokens).

    Weights of unknown domains are left out. A target no document can serve stays unmet, the others are still
    fitted; ``totals`` tells what was reached. Unmet targets, and a safety limit that was hit, are logged.
    """
    k = len(classifier.domains)
    wanted = np.array([max(0.0, weights.get(d, 0.0)) for d in classifier.domains])
    if not k or wanted.sum() <= 0:
        return Mix(classifier, np.zeros((0, k)), {}, {})
    table = materialise(_posterior_table(df, classifier, text), "posteriors")
    steps, targets, sums, settled = solve(lambda steps: _sums(table, steps, k), wanted, total)
    named = lambda x: dict(zip(classifier.domains, map(float, x), strict=True))
    mix = Mix(classifier, steps, named(targets), named(sums.reached), settled)
    if not settled:
        log.warning("the rates are unfinished: a safety limit was hit after %d steps; wanted %s, reached %s", len(steps), mix.targets, mix.totals)
    elif np.abs(sums.reached - targets).max() > TOLERANCE * max(targets.sum(), 1.0) / k:
        log.warning("the targets cannot all be met: wanted %s, reached %s", mix.targets, mix.totals)
    return mix


def apply(df: DataFrame, mix: Mix, doc_id: str = "doc_id", text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """doc_id, n_tokens, domain (likeliest), posterior, rate, copies and the columns in ``carry``, one row per row.

    ``copies`` is the rate rounded up or down by a draw on the id, so that it is right on average. A null or
    empty text has no tokens; it gets the rate of its posterior like any other. Without domains all rates are 1.
    Repeated rows get the same rate each; an empty table gives an empty result. Carried columns must not be
    called like a result column.
    """
    carry = list(carry or [])
    shared = df.sparkSession.sparkContext.broadcast(mix)
    rows = df.select(
        F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"), draw(22, doc_id).alias("u"),
        F.struct(*[F.col(c) for c in carry], F.lit(0).alias("_")).alias("row"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in slices(batches, 1024, 4 << 20):
            features, words = describe(texts_of(batch))
            if known.classifier.domains:
                p = known.classifier.posteriors(features)
                names, best, rate = [known.classifier.domains[j] for j in p.argmax(axis=1)], p.max(axis=1), known.rates(p)
            else:
                names, best, rate = [None] * len(words), np.zeros(len(words)), np.ones(len(words))
            copies = np.floor(rate + batch.column("u").to_numpy()).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row"), pa.array(words), pa.array(names, pa.string()), pa.array(best), pa.array(rate), pa.array(copies)],
                ["doc_id", "row", "n_tokens", "domain", "posterior", "rate", "copies"],
            )

    schema = f"doc_id bigint, row {rows.schema['row'].dataType.simpleString()}, n_tokens bigint, domain string, posterior double, rate double, copies int"
    out = rows.mapInArrow(run, schema)
    return out.select("doc_id", *[F.col("row")[c].alias(c) for c in carry if c != "doc_id"], "n_tokens", "domain", "posterior", "rate", "copies")


def quality_domains(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The labelled table: language and quality label of each labelled document."""
    marks = labels.filter(F.col("quality").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(F.max("quality").alias("_q"))
    named = F.concat_ws(":", F.col("lang"), F.when(F.col("_q") == 1, "high").otherwise("low"))
    spoken = documents.filter(F.col("lang").isNotNull()).select(F.col("doc_id").alias("_id"), "lang")
    return spoken.join(marks, "_id").select(F.col("_id").alias("doc_id"), named.alias("domain"))


def balanced_weights(domains: list[str], low: float = 0.1) -> dict[str, float]:
    """The same share for every language, ``low`` of it from low-quality text where there is any."""
    langs = {d.rpartition(":")[0] for d in domains}
    return {d: (low if d.endswith(":low") else 1 - low) / max(1, len(langs)) for d in domains}
