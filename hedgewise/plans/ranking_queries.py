"""Ranking metrics; the SQL checks sort whole tables, the Spark plans never do."""

from __future__ import annotations

from pyspark.sql import functions as F

from hedgewise.operators import ranking as R
from hedgewise.plans import inputs
from hedgewise.plans.catalog import VIEWS, query

KEYS = ["model", "signal"]
CONFIDENT = ["entropy_labels", "entropy_vocab", "one_minus_margin", "one_minus_top1", "one_minus_self_confidence"]

# Tie groups with everything above them, by a plain global window per group.
VIEWS["fx_ties"] = """
SELECT *, sum(pos) OVER w AS cum_pos, sum(neg) OVER w AS cum_neg,
  sum(pos) OVER (PARTITION BY model, signal) AS n_pos, sum(neg) OVER (PARTITION BY model, signal) AS n_neg
FROM (SELECT model, signal, score, sum(error) AS pos, sum(1 - error) AS neg FROM fx_long GROUP BY ALL)
WINDOW w AS (PARTITION BY model, signal ORDER BY score DESC)"""


def _auc_sql(source: str, keys: str) -> str:
    """AUC from average ranks and AP from the sorted list."""
    return f"""
SELECT {keys}, count(*) AS n, sum(y) AS n_pos,
  CASE WHEN sum(y) > 0 AND sum(y) < count(*) THEN
    (sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y)::DOUBLE * (count(*) - sum(y))) END AS auc,
  sum(CASE WHEN y = 1 THEN cum_pos::DOUBLE / cum_all END) / nullif(sum(y), 0) AS average_precision
FROM (SELECT {keys}, y,
    rank() OVER (PARTITION BY {keys} ORDER BY score) + (count(*) OVER (PARTITION BY {keys}, score) - 1) / 2.0 AS r,
    sum(y) OVER d AS cum_pos, count(*) OVER d AS cum_all
  FROM ({source}) WINDOW d AS (PARTITION BY {keys} ORDER BY score DESC))
GROUP BY {keys}"""


LONG = "SELECT model, signal, source, score, error AS y FROM fx_long"


@query("roc_auc", "model:i signal:s n:i n_pos:i auc:d", _auc_sql(LONG, "model, signal"))
def roc_auc(spark, sf):
    return R.roc_auc(inputs.long_signals(spark, sf), "score", "error", KEYS)


@query(
    "roc_auc_overall",
    "n:i n_pos:i auc:d",
    _auc_sql("SELECT 1 AS one, entropy_over_labels AS score, error AS y FROM fx_signals", "one"),
)
def roc_auc_overall(spark, sf):
    return R.roc_auc(inputs.signals(spark, sf), "entropy_over_labels", "error")


@query(
    "average_precision", "model:i signal:s n:i n_pos:i average_precision:d", _auc_sql(LONG, "model, signal")
)
def average_precision(spark, sf):
    return R.average_precision(inputs.long_signals(spark, sf), "score", "error", KEYS)


@query(
    "roc_curve",
    "model:i signal:s threshold:d fpr:d tpr:d",
    """SELECT model, signal, score AS threshold, cum_neg::DOUBLE / n_neg AS fpr, cum_pos::DOUBLE / n_pos AS tpr FROM fx_ties
UNION ALL SELECT DISTINCT model, signal, NULL, 0.0, 0.0 FROM fx_ties""",
)
def roc_curve(spark, sf):
    return R.roc_curve(inputs.long_signals(spark, sf), "score", "error", KEYS)


@query(
    "pr_curve",
    "model:i signal:s threshold:d precision:d recall:d",
    """SELECT model, signal, score AS threshold, cum_pos::DOUBLE / (cum_pos + cum_neg) AS precision,
  cum_pos::DOUBLE / n_pos AS recall FROM fx_ties
UNION ALL SELECT DISTINCT model, signal, NULL, 1.0, 0.0 FROM fx_ties""",
)
def pr_curve(spark, sf):
    return R.pr_curve(inputs.long_signals(spark, sf), "score", "error", KEYS)


_MATRIX = ", ".join(f"max(CASE WHEN signal = '{s}' THEN auc END) AS {s}" for s in inputs.SIGNALS)


@query(
    "auc_matrix",
    "source:s " + " ".join(f"{s}:d" for s in inputs.SIGNALS),
    f"SELECT source, {_MATRIX} FROM ({_auc_sql(LONG, 'source, signal')}) GROUP BY source",
)
def auc_matrix(spark, sf):
    return R.auc_matrix(inputs.signals(spark, sf), inputs.SIGNALS, "error")


_CONFIDENT_SQL = """
SELECT model, row_id, 1 - correct_by_probs AS y, entropy_over_labels AS entropy_labels, entropy_over_vocab AS entropy_vocab,
  1 - margin AS one_minus_margin, 1 - top1_prob AS one_minus_top1,
  1 - {0} / 100.0::DOUBLE AS one_minus_self_confidence
FROM fx_direct LEFT JOIN (SELECT model, row_id, self_confidence FROM fx_confidences) USING (model, row_id)"""
_UNPIVOTED = "SELECT model, signal, y, score FROM ({0}) UNPIVOT (score FOR signal IN (" + ", ".join(CONFIDENT) + "))"
_TABLE_50 = _auc_sql(_UNPIVOTED.format(_CONFIDENT_SQL.format("coalesce(self_confidence, 50)")), "model, signal")
_TABLE_DROP = _auc_sql(_UNPIVOTED.format(_CONFIDENT_SQL.format("self_confidence")), "model, signal")


@query("signal_table", "model:i signal:s n:i n_pos:i auc:d average_precision:d", _TABLE_50)
def signal_table(spark, sf):
    return R.signal_table(inputs.direct(spark, sf), inputs.confidences(spark, sf), ["model"])


def _advantage_sql(table: str) -> str:
    own = "signal = 'one_minus_self_confidence'"
    return f"""SELECT model, max(CASE WHEN NOT {own} THEN auc END) AS best_logit_auc,
  max(CASE WHEN {own} THEN auc END) AS self_confidence_auc,
  max(CASE WHEN NOT {own} THEN auc END) - max(CASE WHEN {own} THEN auc END) AS advantage FROM ({table}) GROUP BY model"""


@query("signal_advantage", "model:i best_logit_auc:d self_confidence_auc:d advantage:d", _advantage_sql(_TABLE_50))
def signal_advantage(spark, sf):
    return R.signal_advantage(R.signal_table(inputs.direct(spark, sf), inputs.confidences(spark, sf), ["model"]), ["model"])


@query(
    "signal_advantage_parsed_only",
    "model:i best_logit_auc:d self_confidence_auc:d advantage:d",
    _advantage_sql(_TABLE_DROP),
)
def signal_advantage_parsed_only(spark, sf):
    table = R.signal_table(inputs.direct(spark, sf), inputs.confidences(spark, sf), ["model"], missing=None)
    return R.signal_advantage(table, ["model"])


def _with_p(sql: str) -> str:
    """Adds the p-value of Student's t by Simpson's rule over theta: I_x(a, 1/2) = 2 int sin^(2a-1) / B(a, 1/2), x = 1 - rho^2."""
    return f"""SELECT n, rho, 2 * exp(lgamma(n / 2.0 - 0.5) - lgamma(n / 2.0 - 1) - lgamma(0.5)) * sum(pow(sin(asin(sqrt(1 - rho * rho)) * i / 20000.0), n - 3)
    * CASE WHEN i IN (0, 20000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * asin(sqrt(1 - rho * rho)) / 60000.0 AS p_value
FROM ({sql}), (SELECT unnest(range(0, 20001)) AS i) GROUP BY n, rho"""


@query(
    "spearman",
    "n:i rho:d p_value:d",
    _with_p("""SELECT count(*) AS n, corr(rx, ry) AS rho FROM (
SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx,
       rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry
FROM (SELECT self_confidence AS x, value AS y FROM fx_confidences
      JOIN (SELECT row_id // 4 AS row_id, (row_id % 4)::INT AS model, value FROM fx_replies) USING (model, row_id)
      WHERE self_confidence IS NOT NULL AND value IS NOT NULL))"""),
)
def spearman(spark, sf):
    from hedgewise.functions.labels import parse_confidence

    rows = inputs.replies(spark, sf).select(parse_confidence(F.col("reply")).alias("x"), F.col("value").alias("y"))
    return R.spearman(rows, "x", "y")


@query(
    "spearman_signals",
    "n:i rho:d p_value:d",
    _with_p("""SELECT count(*) AS n, corr(rx, ry) AS rho FROM (
SELECT rank() OVER (ORDER BY margin) AS rx, rank() OVER (ORDER BY entropy_over_labels) AS ry FROM fx_direct)"""),
)
def spearman_signals(spark, sf):
    return R.spearman(inputs.direct(spark, sf), "margin", "entropy_over_labels")


@query(
    "pearson",
    "model:i n:i pearson_r:d",
    """SELECT model, count(*) AS n, corr(self_confidence, top1_prob) AS pearson_r FROM fx_direct
JOIN (SELECT model, row_id, self_confidence FROM fx_confidences) USING (model, row_id)
WHERE self_confidence IS NOT NULL GROUP BY model""",
)
def pearson(spark, sf):
    conf = inputs.confidences(spark, sf).select("model", "row_id", "self_confidence")
    return R.pearson(inputs.direct(spark, sf).join(conf, ["model", "row_id"]), "self_confidence", "top1_prob", ["model"])


_COUNTS = """SELECT model, count(*) AS n, count(*) FILTER (p = 1 AND t = 1) AS tp, count(*) FILTER (p = 1 AND t = 0) AS fp,
  count(*) FILTER (p = 0 AND t = 1) AS fn, count(*) FILTER (p = 0 AND t = 0) AS tn FROM ({0}) GROUP BY model"""
_SCORES = """SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall,
  coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1,
  (coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) + coalesce(2 * tn / nullif(2 * tn + fp + fn, 0), 0)) / 2 AS f1_macro,
  (tp + tn) / n AS accuracy FROM ({0})"""


def scores_sql(rows: str) -> str:
    return _SCORES.format(_COUNTS.format(rows))


@query(
    "binary_scores",
    "model:i n:i tp:i fp:i fn:i tn:i precision:d recall:d f1:d f1_macro:d accuracy:d",
    scores_sql("SELECT model, (top1_prob < 0.5)::INT AS p, 1 - correct_by_probs AS t FROM fx_direct"),
)
def binary_scores(spark, sf):
    rows = inputs.direct(spark, sf).select(
        "model", (F.col("top1_prob") < 0.5).cast("int").alias("p"), (1 - F.col("correct_by_probs")).alias("t")
    )
    return R.binary_scores(rows, "p", "t", ["model"])


@query(
    "accuracy_rollup",
    "source:s n:i accuracy_greedy:d accuracy_argmax:d",
    """SELECT source, count(*) AS n, avg(correct_generated) AS accuracy_greedy, avg(correct_by_probs) AS accuracy_argmax
FROM fx_direct GROUP BY ROLLUP (source)""",
)
def accuracy_rollup(spark, sf):
    return R.accuracy_rollup(inputs.direct(spark, sf), "correct_generated", "correct_by_probs")


@query(
    "means_by_correctness",
    "model:i correct_by_probs:i n:i mean_top1_prob:d mean_margin:d mean_entropy_over_labels:d mean_entropy_over_vocab:d",
    """SELECT model, correct_by_probs, count(*) AS n, avg(top1_prob) AS mean_top1_prob, avg(margin) AS mean_margin,
  avg(entropy_over_labels) AS mean_entropy_over_labels, avg(entropy_over_vocab) AS mean_entropy_over_vocab
FROM fx_direct GROUP BY ALL""",
)
def means_by_correctness(spark, sf):
    shown = ["top1_prob", "margin", "entropy_over_labels", "entropy_over_vocab"]
    return R.means_by_correctness(inputs.direct(spark, sf), "correct_by_probs", shown, ["model"])


def _histogram_sql(bins: int) -> str:
    return f"""WITH s AS (SELECT min(entropy_over_labels) AS lo, max(entropy_over_labels) AS hi FROM fx_direct)
SELECT correct_by_probs, bin, max(lo + bin * (hi - lo) / {bins}) AS bin_start, count(*) AS n FROM (
  SELECT correct_by_probs, lo, hi, least(floor((entropy_over_labels - lo) / ((hi - lo) / {bins}.0::DOUBLE)), {bins - 1})::INT AS bin
  FROM fx_direct, s) GROUP BY ALL"""


@query("signal_histogram", "correct_by_probs:i bin:i bin_start:d n:i", _histogram_sql(40))
def signal_histogram(spark, sf):
    return R.signal_histogram(inputs.direct(spark, sf), "entropy_over_labels", "correct_by_probs", 40)


@query("signal_histogram_30", "correct_by_probs:i bin:i bin_start:d n:i", _histogram_sql(30))
def signal_histogram_30(spark, sf):
    return R.signal_histogram(inputs.direct(spark, sf), "entropy_over_labels", "correct_by_probs", 30)


@query(
    "box_summary",
    "correct_by_probs:i minimum:d q1:d median:d q3:d maximum:d",
    """SELECT correct_by_probs, min(margin) AS minimum, quantile_cont(margin, 0.25) AS q1, median(margin) AS median,
  quantile_cont(margin, 0.75) AS q3, max(margin) AS maximum FROM fx_direct GROUP BY ALL""",
)
def box_summary(spark, sf):
    return R.box_summary(inputs.direct(spark, sf), "margin", "correct_by_probs")
