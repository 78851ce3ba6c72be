"""Training and applying single classifiers of ``pyspark.ml``, comparing strategies and conditions.

Fits of many models and folds at once are in ``keyed`` and ``boosting``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window, functions as F

from hedgewise.operators.calibration import ece_weighted, f1_at_threshold
from hedgewise.operators.ranking import binary_scores, roc_auc
from hedgewise.operators.ranks import percentile_rows

LABEL = "target_label"
WEIGHT = "class_weight"
Fit = Callable[[DataFrame], Model]
PARTITIONS = 8  # of the training rows of one fit, whatever their number; raise it for large tables


# ---------------------------------------------------------------- preparation


def column_medians(df: DataFrame, columns: list[str], exact: bool = True) -> dict[str, float]:
    """Median per column, missing values skipped: one number per column comes back.

    Exact medians take the distributed ranks of a long form; ``exact=False`` reads a sketch.
    """
    clean = df.select(*[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c) for c in columns])
    if not exact:
        row = clean.agg(*[F.percentile_approx(c, 0.5, 10000).alias(c) for c in columns]).first()
        return {c: row[c] for c in columns if row[c] is not None}
    long = clean.unpivot([], columns, "feature", "x")
    rows = percentile_rows(long, ["feature"], "x", [0.5]).select("feature", "edge").collect()
    return {r["feature"]: r["edge"] for r in rows}


PREPARED = "prepared_"


class Preparation(Estimator):
    """Median imputation and population scaling as a stage, so every fold is prepared by its own training rows.

    Fitting gives a SQLTransformer that holds the numbers; it is saved and loaded with the pipeline and takes a
    raw matrix.
    """

    def __init__(self, columns: list[str]):
        super().__init__()
        self._columns = list(columns)

    def _fit(self, dataset: DataFrame) -> SQLTransformer:
        medians = column_medians(dataset, self._columns)
        number = lambda x: f"CAST('{float(x)!r}' AS DOUBLE)"
        filled = {c: f"coalesce(nanvl(CAST(`{c}` AS DOUBLE), CAST(NULL AS DOUBLE)), {number(medians.get(c, 0.0))})" for c in self._columns}
        row = dataset.agg(
            *[F.avg(F.expr(x)).alias(f"m_{c}") for c, x in filled.items()], *[F.stddev_pop(F.expr(x)).alias(f"s_{c}") for c, x in filled.items()]
        ).first()
        scaled = [f"({x} - {number(row[f'm_{c}'] or 0.0)}) / {number(row[f's_{c}'] or 1.0)} AS `{PREPARED}{c}`" for c, x in filled.items()]
        return SQLTransformer(statement=f"SELECT *, {', '.join(scaled)} FROM __THIS__")


def router_columns(model: Model) -> list[str]:
    """The raw feature columns a fitted router expects, in its own order."""
    assembler = next(s for s in model.stages if isinstance(s, VectorAssembler))
    return [c.removeprefix(PREPARED) for c in assembler.getInputCols()]


def save_router(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_router(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def class_weights(df: DataFrame, label: str = LABEL) -> DataFrame:
    """Balanced weight n/(classes*n_c) per class, and negatives/positives for boosting."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.agg(
        F.struct(
            F.sum("n").alias("all"),
            F.count(F.lit(1)).alias("classes"),
            F.sum(F.when(F.col(label) == 1, F.col("n"))).alias("pos"),
            F.sum(F.when(F.col(label) == 0, F.col("n"))).alias("neg"),
        ).alias("t")
    ).scalar()
    t = counts.withColumn("t", totals)
    return t.select(
        label,
        "n",
        (F.col("t.all") / (F.col("t.classes") * F.col("n"))).alias("balanced_weight"),
        F.coalesce(F.try_divide(F.coalesce("t.neg", F.lit(0)), F.col("t.pos")), F.lit(1.0)).alias("scale_pos_weight"),
    )


def with_balanced_weights(df: DataFrame, label: str = LABEL) -> DataFrame:
    rows = class_weights(df, label).collect()  # one row per class
    weight = F.lit(1.0)
    for r in rows:
        weight = F.when(F.col(label) == r[label], F.lit(r["balanced_weight"])).otherwise(weight)
    return df.withColumn(WEIGHT, weight)


# ---------------------------------------------------------------- estimators


@contextmanager
def _training_rows(df: DataFrame, columns: list[str], *others: str, partitions: int = PARTITIONS) -> Iterator[tuple[DataFrame, int]]:
    """The columns a fit needs, kept for its many passes, and their number.

    Rows are dealt by their id to a fixed number of partitions and sorted there, because a forest draws its samples by
    partition and place: the same rows give the same forest.
    """
    kept = df.select("row_id", *columns, *others).repartition(partitions, "row_id").sortWithinPartitions("row_id").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield kept, kept.count()
    finally:
        kept.unpersist()


def _assembler(columns: list[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=[f"{PREPARED}{c}" for c in columns], outputCol="features")


def _pipeline(columns: list[str], classifier: Estimator) -> Pipeline:
    return Pipeline(stages=[Preparation(columns), _assembler(columns), classifier])


def fit_logreg(train: DataFrame, columns: list[str], label: str = LABEL, max_iter: int = 5000) -> PipelineModel:
    """Balanced logistic regression with unit L2 strength (the penalty is shared over the rows) on raw columns."""
    weighted = with_balanced_weights(train, label)
    with _training_rows(weighted, columns, label, WEIGHT) as (rows, n):
        lr = LogisticRegression(
            labelCol=label, weightCol=WEIGHT, standardization=False, regParam=1.0 / max(n, 1), maxIter=max_iter
        )
        return _pipeline(columns, lr).fit(rows)


def fit_forest(
    train: DataFrame, columns: list[str], label: str = LABEL, trees: int = 100, depth: int = 30, seed: int = 42
) -> PipelineModel:
    # Deep trees: each row keeps the node it reached, so the trees are not sent along and walked again at every level.
    forest = RandomForestClassifier(
        labelCol=label, weightCol=WEIGHT, numTrees=trees, maxDepth=depth, featureSubsetStrategy="sqrt", seed=seed, cacheNodeIds=True
    )
    with _training_rows(with_balanced_weights(train, label), columns, label, WEIGHT) as (rows, _):
        return _pipeline(columns, forest).fit(rows)


def apply_router(model: Model, rows: DataFrame) -> DataFrame:
    """``router_prob`` and 0/1 ``router_pred`` per row of a raw matrix; rows are never paired by position.

    A matrix without a column the router was trained on is refused; further columns and their order do not matter.
    """
    missing = [c for c in router_columns(model) if c not in rows.columns]
    if missing:
        raise ValueError(f"the matrix lacks the feature columns {missing}")
    scored = model.transform(rows)
    return scored.select(
        *[c for c in rows.columns],
        F.get(vector_to_array("probability"), F.lit(1)).alias("router_prob"),
        F.col("prediction").cast("int").alias("router_pred"),
    )


def strategy_table(scored: DataFrame, keys: list[str], label: str = LABEL) -> DataFrame:
    """keys, strategy, train_f1, cv_f1 (mean over folds), test_f1, test_auc, all strategies and keys in one go.

    ``scored``: keys, strategy, ``part`` (train, fold, test), ``fit`` (the fold), router_prob, router_pred, label.
    """
    named = [*keys, "strategy"]
    scores = binary_scores(scored, "router_pred", label, [*named, "part", "fit"])
    of = lambda part: F.when(F.col("part") == part, F.col("f1"))
    f1 = scores.groupBy(*named).agg(F.max(of("train")).alias("train_f1"), F.avg(of("fold")).alias("cv_f1"), F.max(of("test")).alias("test_f1"))
    auc = roc_auc(scored.filter("part = 'test'"), "router_prob", label, named).select(*named, F.col("auc").alias("test_auc"))
    return f1.join(auc, named, "left")


def top_features(gains: DataFrame, keys: list[str], value: str, top_k: int) -> DataFrame:
    """The features of greatest importance of every key, with readable names; ties by feature."""
    order = Window.partitionBy(*keys).orderBy(F.desc(value), "feature")
    best = gains.withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= top_k)
    words = F.replace(F.regexp_replace("feature", "^feat_", ""), F.lit("_"), F.lit(" "))
    shown = F.concat(F.upper(F.substring(words, 1, 1)), F.lower(F.substring(words, 2, 1000)))
    return best.select(*keys, "feature", shown.alias("readable"), F.col(value).alias("importance"))


# ---------------------------------------------------------------- calibration of the router


def calibration_report(df: DataFrame, probs: list[str], label: str = LABEL, keys: list[str] | None = None) -> DataFrame:
    """F1 at one half and the weighted calibration error of several probability columns."""
    named = [*(keys or []), "series"]
    long = df.select(*(keys or []), "row_id", label, *probs).unpivot([*(keys or []), "row_id", label], probs, "series", "p")
    f1 = f1_at_threshold(long, "p", label, 0.5, named).select(*named, "f1")
    return f1.join(ece_weighted(long, "p", label, named), named)


# ---------------------------------------------------------------- three conditions


def three_conditions(
    vanilla: DataFrame, always_rag: DataFrame, flags: DataFrame, contexts: DataFrame, keys: list[str] | None = None
) -> DataFrame:
    """Per row: plain answer, always-retrieve answer, and the routed one.

    The routed answer is the retrieved one only where the router flags the row and a passage
    survived the filter. Answers and flags meet on ``keys`` (default row_id), contexts on row_id. Every plain
    answer stays: without a flag it is not flagged, without a retrieved answer it keeps its own.
    """
    keys = keys or ["row_id"]
    rows = (
        vanilla.select(*keys, "source", "gold_label", F.col("pred").alias("vanilla_pred"))
        .join(always_rag.select(*keys, F.col("pred").alias("rag_pred")), keys, "left")
        .join(flags.select(*keys, "router_pred"), keys, "left")
        .withColumn("router_pred", F.coalesce("router_pred", F.lit(0)))
        .join(contexts.select("row_id", "raw_context", "filtered_context"), "row_id", "left")
    )
    used = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    routed = (F.col("router_pred") == 1) & used("filtered_context")
    right = lambda c: F.coalesce(c == F.col("gold_label"), F.lit(False))
    answer = F.when(routed & F.col("rag_pred").isNotNull(), F.col("rag_pred")).otherwise(F.col("vanilla_pred"))
    return rows.select(
        *keys,
        "source",
        "gold_label",
        "vanilla_pred",
        "rag_pred",
        answer.alias("router_rag_pred"),
        "router_pred",
        right(F.col("vanilla_pred")).alias("vanilla_correct"),
        right(F.col("rag_pred")).alias("rag_correct"),
        right(answer).alias("router_rag_correct"),
        used("raw_context").alias("rag_context_raw_used"),
        used("filtered_context").alias("rag_context_filtered_used"),
    )


def _condition_aggs() -> list[Column]:
    share = lambda c: F.avg(F.col(c).cast("double"))
    flagged = F.sum(F.col("router_pred").cast("bigint"))
    return [
        F.count(F.lit(1)).alias("n"),
        share("vanilla_correct").alias("vanilla_accuracy"),
        share("rag_correct").alias("rag_accuracy"),
        share("router_rag_correct").alias("router_rag_accuracy"),
        (F.count(F.lit(1)) - flagged).alias("calls_saved"),
        F.count_if((F.col("router_pred") == 1) & F.col("rag_context_filtered_used")).alias("actual_rag_calls"),
    ]


def condition_summary(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return rows.groupBy(*(keys or [])).agg(*_condition_aggs())


def condition_by_source(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Per source and overall (source null) in one job, for each of the keys."""
    each = [F.col(k) for k in keys or []]
    return rows.groupingSets([[*each, F.col("source")], each], *each, F.col("source")).agg(*_condition_aggs())
