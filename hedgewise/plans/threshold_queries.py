"""Thresholds and calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from hedgewise.operators import calibration as C
from hedgewise.operators import retry
from hedgewise.operators import thresholds as T
from hedgewise.plans import inputs
from hedgewise.plans.catalog import VIEWS, query
from hedgewise.plans.ranking_queries import scores_sql

KEYS = ["model", "signal"]
VIEWS["fx_recovery"] = """
SELECT avg((r.pred_by_probs = d.gold_label)::INT) AS recovery FROM fx_direct d
JOIN fx_retries r USING (model, row_id) WHERE d.correct_by_probs = 0"""
# Percentiles by hand: position (n-1)*p between its two neighbours in the sorted list.
VIEWS["fx_sorted"] = "SELECT model, signal, list_sort(list(score)) AS v FROM fx_long GROUP BY ALL"


def _percentile_sql(percents: str, divisor: int = 100) -> str:
    return f"""SELECT model, signal, percent, v[lo + 1] + (v[hi + 1] - v[lo + 1]) * (pos - lo) AS threshold FROM (
  SELECT *, floor(pos)::INT AS lo, ceil(pos)::INT AS hi FROM (
    SELECT model, signal, v, percent, (len(v) - 1) * (percent / {divisor}::DOUBLE) AS pos
    FROM fx_sorted, (SELECT unnest(range({percents})) AS percent)))"""


VIEWS["fx_flagged"] = f"""
SELECT t.model, t.signal, t.percent, t.threshold, count(*) AS n, sum(l.error) AS wrong,
  count(*) FILTER (l.score >= t.threshold) AS flagged, coalesce(sum(l.error) FILTER (l.score >= t.threshold), 0) AS wrong_flagged
FROM ({_percentile_sql('0, 101, 1')}) t JOIN fx_long l USING (model, signal)
GROUP BY t.model, t.signal, t.percent, t.threshold"""


def _recovery(spark, sf):
    out = retry.retry_outcomes(inputs.direct(spark, sf), inputs.retries(spark, sf), ["model"])
    return out.filter("retried").agg(F.avg(F.col("retry_correct").cast("double")).alias("r")).scalar()


@query(
    "threshold_sweep",
    "model:i signal:s percent:i threshold:d flagged:i wrong_flagged:i fraction_reflected:d accuracy_optimistic:d "
    "accuracy_pessimistic:d gain_pessimistic:d",
    """SELECT *, flagged / n AS fraction_reflected, (n - wrong + wrong_flagged * recovery) / n AS accuracy_optimistic,
  (n - wrong - (flagged - wrong_flagged) + wrong_flagged * recovery) / n AS accuracy_pessimistic,
  (wrong_flagged * recovery - (flagged - wrong_flagged)) / n AS gain_pessimistic
FROM fx_flagged, fx_recovery WHERE percent % 2 = 0""",
)
def threshold_sweep(spark, sf):
    return T.threshold_sweep(inputs.long_signals(spark, sf), "score", "error", _recovery(spark, sf), KEYS)


@query(
    "upper_bound",
    "model:i upper_bound:d",
    """SELECT model, avg(correct_by_probs) + (1 - avg(correct_by_probs)) * max(recovery) AS upper_bound
FROM fx_direct, fx_recovery GROUP BY model""",
)
def upper_bound(spark, sf):
    base = inputs.direct(spark, sf).groupBy("model").agg(F.avg("correct_by_probs").alias("base"))
    return base.select("model", T.upper_bound(F.col("base"), _recovery(spark, sf)).alias("upper_bound"))


@query(
    "best_f1_threshold",
    "model:i signal:s threshold:d f1:d precision:d recall:d",
    """SELECT model, signal, threshold, f1, wrong_flagged / flagged AS precision, wrong_flagged / wrong AS recall FROM (
  SELECT *, row_number() OVER (PARTITION BY model, signal ORDER BY f1 DESC, percent) AS k FROM (
    SELECT *, 2.0::DOUBLE * wrong_flagged / (flagged + wrong) AS f1 FROM fx_flagged WHERE percent BETWEEN 5 AND 95))
WHERE k = 1""",
)
def best_f1_threshold(spark, sf):
    return T.best_f1_threshold(inputs.long_signals(spark, sf), "score", "error", KEYS)


@query(
    "decile_error",
    "model:i signal:s bin:i n:i mean_score:d error_rate:d",
    f"""WITH e AS (SELECT model, signal, list_sort(list_distinct(list(threshold))) AS edges
  FROM ({_percentile_sql('0, 11, 1', 10)}) GROUP BY ALL)
SELECT model, signal, bin, count(*) AS n, avg(score) AS mean_score, avg(error) AS error_rate FROM (
  SELECT l.*, greatest(len(list_filter(edges, lambda x: x < score)) - 1, 0) AS bin FROM fx_long l JOIN e USING (model, signal))
GROUP BY ALL""",
)
def decile_error(spark, sf):
    return T.decile_error(inputs.long_signals(spark, sf), "score", "error", KEYS)


@query(
    "reliability_uniform",
    "model:i bin:i n:i mean_predicted:d fraction_positive:d",
    """SELECT model, bin, count(*) AS n, avg(p) AS mean_predicted, avg(correct_by_probs) AS fraction_positive FROM (
  SELECT model, p, correct_by_probs, len(list_filter(range(1, 10), lambda i: i * 0.1::DOUBLE < p)) AS bin FROM (
    SELECT model, correct_by_probs, least(greatest(top1_prob, 1e-7), 1 - 1e-7) AS p FROM fx_direct)) GROUP BY ALL""",
)
def reliability_uniform(spark, sf):
    return C.reliability_uniform(inputs.direct(spark, sf), "top1_prob", "correct_by_probs", ["model"])


VIEWS["fx_top1_sorted"] = "SELECT model, list_sort(list(top1_prob)) AS v FROM fx_direct GROUP BY ALL"
VIEWS["fx_top1_edges"] = """
SELECT model, list(v[lo + 1] + (v[hi + 1] - v[lo + 1]) * (pos - lo)) AS edges FROM (
  SELECT *, floor(pos)::INT AS lo, ceil(pos)::INT AS hi FROM (
    SELECT model, v, (len(v) - 1) * (i / 10::DOUBLE) AS pos FROM fx_top1_sorted, (SELECT unnest(range(1, 10)) AS i)))
GROUP BY model"""
VIEWS["fx_quantile_bins"] = """
SELECT model, bin, count(*) AS n, avg(top1_prob) AS mean_predicted, avg(correct_by_probs) AS fraction_positive FROM (
  SELECT d.*, len(list_filter(edges, lambda x: x < top1_prob)) AS bin FROM fx_direct d JOIN fx_top1_edges USING (model))
GROUP BY ALL"""


@query("reliability_quantile", "model:i bin:i n:i mean_predicted:d fraction_positive:d", "SELECT * FROM fx_quantile_bins")
def reliability_quantile(spark, sf):
    return C.reliability_quantile(inputs.direct(spark, sf), "top1_prob", "correct_by_probs", ["model"])


def _ece_sql(rows: str, last_closed: bool) -> str:
    hit = "bin < 10 OR p = 1" if last_closed else "bin < 10"
    return f"""SELECT model, sum(n) AS n, sum(CASE WHEN bin < 10 THEN n * abs(acc - conf) ELSE 0 END) / sum(n) AS ece FROM (
  SELECT model, bin, count(*) AS n, avg(y) AS acc, avg(p) AS conf FROM (
    SELECT model, p, y, CASE WHEN p < 0 OR p > 1 THEN 10 WHEN p = 1 THEN {9 if last_closed else 10}
      ELSE len(list_filter(range(1, 10), lambda i: i * 0.1::DOUBLE <= p)) END AS bin FROM ({rows}))
  GROUP BY ALL) GROUP BY model"""


# Self-reported confidence reaches both ends of [0, 1]; 99 stands for certainty.
VIEWS["fx_stated"] = """
SELECT model, least(self_confidence / 99::DOUBLE, 1.0) AS p, correct AS y FROM fx_confidences WHERE self_confidence IS NOT NULL"""


def _stated(spark, sf):
    c = inputs.confidences(spark, sf).filter("self_confidence IS NOT NULL")
    return c.select("model", F.least(F.col("self_confidence") / 99.0, F.lit(1.0)).alias("p"), F.col("correct").alias("y"))


@query("ece_weighted", "model:i n:i ece:d", _ece_sql("SELECT * FROM fx_stated", True))
def ece_weighted(spark, sf):
    return C.ece_weighted(_stated(spark, sf), "p", "y", ["model"])


@query("ece_weighted_open", "model:i n:i ece:d", _ece_sql("SELECT * FROM fx_stated", False))
def ece_weighted_open(spark, sf):
    return C.ece_weighted_open(_stated(spark, sf), "p", "y", ["model"])


@query(
    "ece_unweighted_quantile",
    "model:i bins:i ece:d",
    "SELECT model, count(*) AS bins, avg(abs(fraction_positive - mean_predicted)) AS ece FROM fx_quantile_bins GROUP BY model",
)
def ece_unweighted_quantile(spark, sf):
    return C.ece_unweighted_quantile(inputs.direct(spark, sf), "top1_prob", "correct_by_probs", ["model"])


@query(
    "f1_at_threshold",
    "model:i n:i tp:i fp:i fn:i f1:d",
    scores_sql("SELECT model, (1 - top1_prob >= 0.5)::INT AS p, 1 - correct_by_probs AS t FROM fx_direct"),
)
def f1_at_threshold(spark, sf):
    return C.f1_at_threshold(inputs.signals(spark, sf), "one_minus_top1", "error", 0.5, ["model"])


@query(
    "vanilla_error_prob",
    "model:i row_id:i error_prob:d",
    "SELECT model, row_id, CASE WHEN chosen_token_prob IS NOT NULL THEN least(greatest(1 - chosen_token_prob, 1e-7), 1 - 1e-7) END AS error_prob FROM fx_generations",
)
def vanilla_error_prob(spark, sf):
    p = F.col("chosen_token_prob")
    return inputs.generations(spark, sf).select(
        "model", "row_id", F.when(p.isNotNull(), C.vanilla_error_prob(p)).alias("error_prob")
    )


@query(
    "confidence_buckets",
    "model:i bucket:s n:i accuracy:d",
    """SELECT model, CASE WHEN c < 25 THEN '0-25' WHEN c < 50 THEN '25-50' WHEN c < 75 THEN '50-75' WHEN c < 90 THEN '75-90'
  ELSE '90-100' END AS bucket, count(*) AS n, avg(correct) AS accuracy
FROM (SELECT model, correct, self_confidence AS c FROM fx_confidences WHERE self_confidence IS NOT NULL) GROUP BY ALL""",
)
def confidence_buckets(spark, sf):
    return C.confidence_buckets(inputs.confidences(spark, sf), "self_confidence", "correct", ["model"])
