"""Choosing the score above which an answer is worth another look."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from hedgewise.operators.ranks import percentile_rows


def _one() -> Column:
    return F.lit(1).cast("bigint")


def _flagged_at(df: DataFrame, score: str, target: str, percents: list[int], keys: list[str]) -> DataFrame:
    """Per percentile threshold: rows flagged (score >= threshold) and errors among them."""
    sums = {"rows": _one(), "wrong": F.col(target).cast("bigint")}
    at = percentile_rows(df, keys, score, [k / 100 for k in percents], sums)
    return at.select(
        *keys,
        F.get(F.array(*[F.lit(k) for k in percents]), F.col("prob_index")).alias("percent"),
        F.col("edge").alias("threshold"),
        "n",
        F.col("all_wrong").alias("wrong"),
        (F.col("n") - F.col("below_rows")).alias("flagged"),
        (F.col("all_wrong") - F.col("below_wrong")).alias("wrong_flagged"),
    )


def threshold_sweep(
    df: DataFrame, score: str, target: str, recovery: Column, keys: list[str] | None = None, step: int = 2
) -> DataFrame:
    """Reflected share and simulated accuracy at percentile thresholds 0, 2, ..., 100.

    ``recovery`` is the share of re-asked wrong answers that become right. The optimistic
    accuracy assumes a re-asked right answer stays right, the pessimistic one that it is lost.
    """
    at = _flagged_at(df, score, target, list(range(0, 101, step)), keys or [])
    n, right = F.col("n").cast("double"), F.col("n") - F.col("wrong")
    gained = F.col("wrong_flagged") * recovery
    kept = right - (F.col("flagged") - F.col("wrong_flagged"))
    return at.withColumns(
        {
            "fraction_reflected": F.col("flagged") / n,
            "accuracy_optimistic": (right + gained) / n,
            "accuracy_pessimistic": (kept + gained) / n,
            "gain_pessimistic": (kept + gained) / n - right / n,
        }
    )


def upper_bound(baseline: Column, recovery: Column) -> Column:
    """Accuracy if exactly the wrong answers were re-asked."""
    return baseline + (1.0 - baseline) * recovery


def best_f1_threshold(df: DataFrame, score: str, target: str, keys: list[str] | None = None) -> DataFrame:
    """The percentile threshold (5..95) with the best F1; the lowest wins ties, no F1 above 0 gives nulls."""
    keys = keys or []
    at = _flagged_at(df, score, target, list(range(5, 96)), keys)
    tp, flagged, wrong = F.col("wrong_flagged"), F.col("flagged"), F.col("wrong")
    scored = at.select(
        *keys,
        F.struct(
            F.try_divide(2.0 * tp, flagged + wrong).alias("f1"),
            (-F.col("percent")).alias("order"),
            F.col("threshold"),
            F.try_divide(tp, flagged).alias("precision"),
            F.try_divide(tp, wrong).alias("recall"),
        ).alias("c"),
    )
    best = scored.groupBy(*keys).agg(F.max(F.when(F.col("c.f1") > 0, F.col("c"))).alias("c"))
    return best.select(*keys, "c.threshold", "c.f1", "c.precision", "c.recall")


def decile_error(
    df: DataFrame, score: str, target: str, keys: list[str] | None = None, bins: int = 10
) -> DataFrame:
    """Equal-frequency bins, closed on the right, repeated edges merged: mean score, error rate, count."""
    keys = keys or []
    sums = {"rows": _one(), "wrong": F.col(target).cast("double"), "score": F.col(score).cast("double")}
    at = percentile_rows(df, keys, score, [i / bins for i in range(bins + 1)], sums)
    edges = at.groupBy(*keys, "edge").agg(*[F.max(f"upto_{s}").alias(s) for s in sums])
    order = Window.partitionBy(*keys).orderBy("edge")  # at most bins + 1 rows per key
    number = F.row_number().over(order) - 1
    since = lambda s: F.col(s) - F.when(number > 1, F.lag(s).over(order)).otherwise(F.lit(0))
    bins_of = edges.select(*keys, (number - 1).alias("bin"), *[since(s).alias(s) for s in sums]).filter("bin >= 0")
    return bins_of.select(
        *keys,
        "bin",
        F.col("rows").alias("n"),
        (F.col("score") / F.col("rows")).alias("mean_score"),
        (F.col("wrong") / F.col("rows")).alias("error_rate"),
    )
