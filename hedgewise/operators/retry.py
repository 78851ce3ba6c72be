"""Re-asking the questions that were answered wrong, and comparing models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def oracle_retry_candidates(direct: DataFrame) -> DataFrame:
    """Only rows answered wrong, before anything else is computed for them."""
    return direct.filter(F.col("correct_by_probs") == 0)


def retry_outcomes(direct: DataFrame, retries: DataFrame, keys: list[str]) -> DataFrame:
    """Wrong answers with their recorded second answer; old and new signals side by side.

    A wrong answer whose retry was not recorded stays: ``retried`` is false, nothing changed or recovered.
    """
    wrong = oracle_retry_candidates(direct).select(
        *keys,
        "row_id",
        "source",
        "gold_label",
        F.col("pred_by_probs").alias("orig_pred"),
        F.col("entropy_over_labels").alias("orig_entropy"),
        F.col("margin").alias("orig_margin"),
    )
    second = retries.select(
        *keys,
        "row_id",
        F.col("pred_by_probs").alias("retry_pred"),
        F.col("entropy_over_labels").alias("retry_entropy"),
        F.col("margin").alias("retry_margin"),
        F.col("top1_prob").alias("retry_top1_prob"),
        F.lit(True).alias("retried"),
    )
    both = wrong.join(second, [*keys, "row_id"], "left").withColumn("retried", F.coalesce("retried", F.lit(False)))
    return both.withColumns(
        {
            "retry_correct": F.coalesce(F.col("retry_pred") == F.col("gold_label"), F.lit(False)).cast("int"),
            "changed_answer": (F.col("retried") & ~F.col("retry_pred").eqNullSafe(F.col("orig_pred"))).cast("int"),
        }
    )


def _rate(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def _with_baseline(direct: DataFrame, outcomes: DataFrame, keys: list[str]) -> DataFrame:
    """Direct totals and retry totals per key, added up in one aggregate of both tables."""
    zero = F.lit(0).cast("bigint")
    one = F.lit(1).cast("bigint")
    big = lambda c: F.col(c).cast("bigint")
    first = direct.select(
        *keys,
        one.alias("n_total"),
        big("correct_by_probs").alias("n_correct"),
        zero.alias("n_wrong"),
        zero.alias("n_retried"),
        zero.alias("n_changed"),
        zero.alias("n_recovered"),
        zero.alias("recovered_changed"),
    )
    second = outcomes.select(
        *keys,
        zero.alias("n_total"),
        zero.alias("n_correct"),
        one.alias("n_wrong"),
        big("retried").alias("n_retried"),
        big("changed_answer").alias("n_changed"),
        big("retry_correct").alias("n_recovered"),
        (big("retry_correct") * big("changed_answer")).alias("recovered_changed"),
    )
    names = ["n_total", "n_correct", "n_wrong", "n_retried", "n_changed", "n_recovered", "recovered_changed"]
    return first.unionByName(second).groupBy(*keys).agg(*[F.sum(n).alias(n) for n in names])


def retry_summary(direct: DataFrame, outcomes: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Recovery and change rates and the accuracy after the retry; nothing wrong gives zeros.

    Both rates are shares of all wrong answers, retried (``n_retried``) or not.
    """
    keys = keys or []
    t = _with_baseline(direct, outcomes, keys)
    unchanged = F.col("n_retried") - F.col("n_changed")
    return t.select(
        *keys,
        "n_total",
        "n_wrong",
        "n_retried",
        "n_changed",
        "n_recovered",
        _rate(F.col("n_recovered"), F.col("n_wrong")).alias("recovery_rate"),
        _rate(F.col("n_changed"), F.col("n_wrong")).alias("change_rate"),
        F.try_divide(F.col("recovered_changed").cast("double"), F.col("n_changed").cast("double")).alias(
            "changed_accuracy"
        ),
        F.try_divide(
            (F.col("n_recovered") - F.col("recovered_changed")).cast("double"), unchanged.cast("double")
        ).alias("unchanged_accuracy"),
        _rate(F.col("n_correct"), F.col("n_total")).alias("baseline_accuracy"),
        _rate(F.col("n_correct") + F.col("n_recovered"), F.col("n_total")).alias("post_retry_accuracy"),
    )


def retry_by_source(outcomes: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return outcomes.groupBy(*(keys or []), "source").agg(
        F.count(F.lit(1)).alias("n_wrong"),
        F.count_if("retried").alias("n_retried"),
        F.sum("retry_correct").alias("recovered"),
        F.sum("changed_answer").alias("changed"),
        F.avg(F.col("retry_correct").cast("double")).alias("recovery_rate"),
        F.avg(F.col("changed_answer").cast("double")).alias("change_rate"),
    )


def uncertainty_shift(outcomes: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Mean change of entropy and margin between the two answers, for recovered and not, over retried rows."""
    return outcomes.filter("retried").groupBy(*(keys or []), "retry_correct").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.col("retry_entropy") - F.col("orig_entropy")).alias("mean_entropy_change"),
        F.avg(F.col("retry_margin") - F.col("orig_margin")).alias("mean_margin_change"),
    )


def self_confidence_summary(confidences: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Mean self-reported confidence for all, right and wrong answers, with the parse success rate."""
    keys = keys or []
    c = F.col("self_confidence").cast("double")
    aggs = [
        F.count(F.lit(1)).alias("n"),
        F.count("self_confidence").alias("n_parsed"),
        F.avg(F.col("self_confidence").isNotNull().cast("double")).alias("parse_success_rate"),
        F.avg(c).alias("mean_confidence"),
    ]
    sets = [[*[F.col(k) for k in keys], F.col("correct")], [F.col(k) for k in keys]]
    return confidences.groupingSets(sets, *[F.col(k) for k in keys], F.col("correct")).agg(*aggs)


def model_comparison(direct: DataFrame, outcomes: DataFrame, keys: list[str]) -> DataFrame:
    """One row per model: accuracy before and after the retry; models are a column, not a loop."""
    s = retry_summary(direct, outcomes, keys)
    return s.select(
        *keys,
        "baseline_accuracy",
        "post_retry_accuracy",
        (F.col("post_retry_accuracy") - F.col("baseline_accuracy")).alias("delta"),
        "n_wrong",
        "n_retried",
        "n_changed",
        "recovery_rate",
    )


def source_model_matrix(
    direct: DataFrame, outcomes: DataFrame, models: list, sources: list[str] | None = None, model: str = "model"
) -> DataFrame:
    """Per source and model: baseline accuracy, and retry accuracy minus it (no retries count as 0)."""
    rows = (
        direct.groupBy("source", model)
        .agg(F.avg(F.col("correct_by_probs").cast("double")).alias("baseline"))
        .join(
            outcomes.filter("retried").groupBy("source", model).agg(F.avg(F.col("retry_correct").cast("double")).alias("retry")),
            ["source", model],
            "left",
        )
    )
    if sources is not None:
        rows = rows.filter(F.col("source").isin(*sources))
    pick = lambda m, c: F.max(F.when(F.col(model) == m, c))
    gain = F.coalesce(F.col("retry"), F.lit(0.0)) - F.col("baseline")
    return rows.groupBy("source").agg(
        *[pick(m, F.col("baseline")).alias(f"baseline_{m}") for m in models],
        *[pick(m, gain).alias(f"gain_{m}") for m in models],
    )
