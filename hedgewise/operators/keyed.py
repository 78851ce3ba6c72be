"""Preparation, logistic fits and Platt scaling for many fits at once.

A *fit* is one combination of key columns (model, fold, feature set); its rows may lie anywhere. All fits share
the jobs: one aggregate for the preparation, one per Newton step. Only one small row per fit reaches the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from hedgewise.functions.common import let, missing_if_nan
from hedgewise.operators.ranks import percentile_rows
from hedgewise.session import join_small, materialise

TOLERANCE, STEPS = 1e-9, 60


def present(column: str) -> Column:
    """A feature as double; NaN is missing."""
    return missing_if_nan(F.col(column))


# ---------------------------------------------------------------- preparation


def preparation(train: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """keys, feature, median, mean, deviation: what the training rows of each key say about each feature.

    The mean and the population deviation are those of the filled feature. A feature without any value is filled
    with 0; a constant one has deviation 0.
    """
    long = train.select(*keys, *[present(c).alias(c) for c in columns]).unpivot(keys, columns, "feature", "x")
    found = percentile_rows(long, [*keys, "feature"], "x", [0.5]).select(*keys, "feature", F.col("edge").alias("_median"))
    every = [*keys, "feature"]
    filled = join_small(long, found, every).withColumn("_median", F.coalesce("_median", F.lit(0.0)))
    value = F.coalesce("x", "_median")
    return filled.groupBy(*every).agg(F.max("_median").alias("median"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("deviation"))


def _beside(rows: DataFrame, prepared: DataFrame, keys: list[str]) -> DataFrame:
    entry = F.struct("feature", F.struct("median", "mean", "deviation"))
    table = prepared.groupBy(*keys).agg(F.map_from_entries(F.collect_list(entry)).alias("_prepared"))
    return join_small(rows, table, keys, "inner") if keys else rows.withColumn("_prepared", table.select("_prepared").scalar())


def filled(rows: DataFrame, prepared: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """The rows with missing features replaced by the medians of their key."""
    whole = _beside(rows, prepared, keys)
    values = {c: F.coalesce(present(c), F.element_at("_prepared", F.lit(c))["median"]) for c in columns}
    return whole.withColumns(values).select(*rows.columns)


def _scaled(column: str) -> Column:
    p = F.element_at("_prepared", F.lit(column))
    spread = F.when(p["deviation"] > 0, p["deviation"]).otherwise(F.lit(1.0))
    return (F.coalesce(present(column), p["median"]) - p["mean"]) / spread


def standardised(rows: DataFrame, prepared: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(x - mean) / deviation of the filled features; a constant feature is only centred."""
    whole = _beside(rows, prepared, keys)
    return whole.withColumns({c: _scaled(c) for c in columns}).select(*rows.columns)


def feature_vectors(rows: DataFrame, prepared: DataFrame, keys: list[str], columns: list[str], kept: list[str]) -> DataFrame:
    """``kept`` columns and ``x``: the standardised features in the order of ``columns``."""
    return _beside(rows, prepared, keys).select(*kept, F.array(*[_scaled(c) for c in columns]).alias("x"))


def balanced(rows: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Weight n / (classes * n_c) of every row within its key as ``w``."""
    counts = rows.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("_n"))
    totals = counts.groupBy(*keys).agg(F.sum("_n").alias("_all"), F.count(F.lit(1)).alias("_classes"))
    weights = counts.join(totals, keys).select(*keys, label, (F.col("_all") / (F.col("_classes") * F.col("_n"))).alias("w"))
    return join_small(rows, weights, [*keys, label], "inner")


def training_copies(rows: DataFrame, folds: int, fold: str = "fold") -> DataFrame:
    """Every row once for the whole set (``fit`` = -1) and once for each fold it does not lie in (``fit`` = that fold)."""
    fits = F.filter(F.array(*[F.lit(k) for k in range(-1, folds)]), lambda k: k != F.col(fold))
    return rows.withColumn("fit", F.explode(fits))


# ---------------------------------------------------------------- Newton steps


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -700, 700)))


def _groups(batch: pa.RecordBatch, keys: list[str]) -> Iterator[tuple[tuple, np.ndarray]]:
    """The key values of a batch and the places of their rows."""
    places: dict[tuple, list[int]] = {}
    for at, key in enumerate(zip(*[batch.column(k).to_pylist() for k in keys], strict=True)):
        places.setdefault(key, []).append(at)
    for key, rows in places.items():
        yield key, np.array(rows)


def _moments(keys: list[str], coefficients: dict[tuple, np.ndarray]) -> Callable:
    """Per batch and fit: the loss, its gradient and its curvature as one list of sums."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[tuple, np.ndarray] = {}
            vectors = batch.column("x")
            y, w = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("y", "w"))
            for key, rows in _groups(batch, keys):
                x = vectors.take(pa.array(rows)).flatten().to_numpy().reshape(len(rows), -1)
                x = np.column_stack([x, np.ones(len(rows))])
                b = coefficients.get(key, np.zeros(x.shape[1]))
                z = x @ b
                p = _sigmoid(z)
                loss = (w[rows] * (np.logaddexp(0.0, z) - y[rows] * z)).sum()
                curve = (x * (w[rows] * p * (1 - p))[:, None]).T @ x
                found[key] = np.concatenate([[loss], x.T @ (w[rows] * (p - y[rows])), curve[np.triu_indices(len(b))]])
            if found:
                columns = [pa.array(c, batch.schema.field(k).type) for k, c in zip(keys, zip(*found, strict=True), strict=True)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([v.tolist() for v in found.values()], pa.list_(pa.float64()))], [*keys, "sums"])

    return sums


def fit_logistic(rows: DataFrame, keys: list[str], penalty: float = 1.0) -> DataFrame:
    """keys, ``coefficients`` (the intercept last), ``steps``, ``settled``: logistic regressions of all keys at once.

    ``rows`` has the keys, ``x`` (list of numbers), ``y`` (0 to 1, fractions are soft targets) and ``w``. Minimised is
    the weighted log loss plus half the penalty times the squared coefficients without the intercept. A step that
    raises the loss is halved. Every step is one aggregate over the rows; its sums come back as one row per key.
    Rows with a null target or weight are left out.
    """
    kept = materialise(rows.select(*keys, "x", F.col("y").cast("double").alias("y"), F.col("w").cast("double").alias("w")).filter("y IS NOT NULL AND w IS NOT NULL"), "fits")
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields if f.name in keys)
    best: dict[tuple, tuple[float, np.ndarray]] = {}  # the accepted loss and coefficients
    trial: dict[tuple, np.ndarray] = {}
    move: dict[tuple, np.ndarray] = {}
    settled: dict[tuple, int] = {}
    step = 0
    for step in range(1, STEPS + 1):
        parts = kept.mapInArrow(_moments(keys, trial), f"{types}, sums array<double>")
        added = parts.select(*keys, F.posexplode("sums").alias("at", "v")).groupBy(*keys, "at").agg(F.sum("v").alias("v"))
        totals = added.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("at", "v"))).alias("s")).collect()
        for row in totals:
            key, sums = tuple(row[k] for k in keys), np.array([s["v"] for s in row["s"]])
            if key in settled:
                continue
            d = int((np.sqrt(8 * (len(sums) - 1) + 9) - 3) / 2 + 0.5)
            b = trial.get(key, np.zeros(d))
            ridge = np.full(d, penalty)
            ridge[-1] = 0.0
            loss = sums[0] + 0.5 * (ridge * b * b).sum()
            if key in best and loss > best[key][0] + 1e-12 * abs(loss):
                move[key] = move[key] / 2
                trial[key] = best[key][1] + move[key]
                if np.abs(move[key]).max() < 1e-15:
                    trial[key], settled[key] = best[key][1], step
                continue
            best[key] = (loss, b)
            gradient = sums[1 : d + 1] + ridge * b
            if np.abs(gradient).max() <= TOLERANCE * max(1.0, sums[0]):
                trial[key], settled[key] = b, step
                continue
            curve = np.zeros((d, d))
            curve[np.triu_indices(d)] = sums[d + 1 :]
            curve = curve + np.triu(curve, 1).T + np.diag(ridge)
            move[key] = -np.linalg.lstsq(curve, gradient, rcond=None)[0]
            trial[key] = b + move[key]
        if len(settled) == len(totals):
            break
    table = [(*key, [float(v) for v in b], settled.get(key, step), key in settled) for key, (_, b) in best.items()]
    return rows.sparkSession.createDataFrame(table, f"{types}, coefficients array<double>, steps int, settled boolean")


def dot(a: str | Column, b: str | Column) -> Column:
    """The sum of products of two lists, the second one longer by an intercept."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    one = F.concat(a, F.array(F.lit(1.0)))
    return F.aggregate(F.zip_with(one, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def logistic(z: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-z))


def score_logistic(rows: DataFrame, fits: DataFrame, keys: list[str]) -> DataFrame:
    """The rows (with ``x``) of every fitted key with ``router_prob`` and ``router_pred``; x is dropped."""
    whole = join_small(rows, fits.select(*keys, "coefficients"), keys, "inner")
    p = logistic(dot("x", "coefficients"))
    kept = [c for c in rows.columns if c != "x"]
    return whole.select(*kept, p.alias("router_prob"), (p > 0.5).cast("int").alias("router_pred"))


def gradients(rows: DataFrame, fits: DataFrame, keys: list[str], penalty: float = 1.0) -> DataFrame:
    """keys, position, gradient: the slope of the stated objective at the coefficients, added up by Spark alone."""
    whole = join_small(rows, fits.select(*keys, "coefficients"), keys, "inner")
    slope = F.col("w") * (logistic(dot("x", "coefficients")) - F.col("y"))
    one = F.concat("x", F.array(F.lit(1.0)))
    products = let(slope, lambda s: F.transform(one, lambda v: v * s))  # a slope inside the inner function would be worked out for each feature
    each = whole.select(*keys, "coefficients", F.posexplode(products).alias("position", "g"))
    last = F.size("coefficients") - 1
    ridge = F.when(F.col("position") < last, penalty * F.get("coefficients", F.col("position"))).otherwise(0.0)
    return each.select(*keys, "position", "g", ridge.alias("r")).groupBy(*keys, "position").agg((F.sum("g") + F.max("r")).alias("gradient"))


# ---------------------------------------------------------------- Platt scaling


def platt_rows(scored: DataFrame, keys: list[str], score: str, label: str) -> DataFrame:
    """Soft targets (n1 + 1) / (n1 + 2) and 1 / (n0 + 2) by key, ready for a one-feature fit."""
    counts = scored.groupBy(*keys).agg(F.count_if(F.col(label) == 1).alias("_n1"), F.count_if(F.col(label) == 0).alias("_n0"))
    soft = F.when(F.col(label) == 1, (F.col("_n1") + 1.0) / (F.col("_n1") + 2.0)).otherwise(1.0 / (F.col("_n0") + 2.0))
    return join_small(scored, counts, keys, "inner").select(*keys, F.array(score).alias("x"), soft.alias("y"), F.lit(1.0).alias("w"))


def fit_platt(scored: DataFrame, keys: list[str], score: str, label: str) -> DataFrame:
    """keys, slope, shift: the sigmoid of every key at once, without a penalty."""
    fits = fit_logistic(platt_rows(scored, keys, score, label), keys, penalty=0.0)
    return fits.select(*keys, F.get("coefficients", F.lit(0)).alias("slope"), F.get("coefficients", F.lit(1)).alias("shift"))
