"""Reflection policies, retries and model comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from hedgewise.operators import policies as P
from hedgewise.operators import retry as Y
from hedgewise.plans import inputs
from hedgewise.plans.catalog import VIEWS, query

M = ["model"]
_QUARTERS = ", ".join(
    f"quantile_cont({c}, {q}) AS {s}_{n}"
    for s, c in (("entropy", "entropy_over_labels"), ("margin", "margin"))
    for n, q in (("p25", 0.25), ("p50", 0.5), ("p75", 0.75))
)
VIEWS["fx_thresholds"] = f"SELECT model, {_QUARTERS} FROM fx_direct GROUP BY model"


def _regime_sql(entropy: str, margin: str) -> str:
    return f"""CASE WHEN {entropy} <= entropy_p50 AND {margin} >= margin_p50 THEN 'high'
  WHEN {entropy} >= entropy_p75 OR {margin} <= margin_p25 THEN 'low' ELSE 'medium' END"""


VIEWS["fx_regimes"] = f"""
SELECT d.*, {_regime_sql('entropy_over_labels', 'margin')} AS regime FROM fx_direct d JOIN fx_thresholds USING (model)"""
VIEWS["fx_reflected_regimes"] = f"""
SELECT r.model, r.row_id, r.style, r.reflection_pass, r.pred_by_probs AS pred,
  {_regime_sql('r.entropy_over_labels', 'r.margin')} AS regime FROM fx_reflected r JOIN fx_thresholds USING (model)"""
VIEWS["fx_policies"] = """
SELECT unnest(['direct_baseline','always_reflect_once','always_reflect_twice','blind_gate_once','blind_gate_twice',
               'oracle_gate_once','oracle_gate_twice']) AS policy,
  unnest(['never','always','always','blind','blind','oracle','oracle']) AS gate, unnest([0,1,2,1,2,1,2]) AS max_passes"""
VIEWS["fx_runs"] = """
SELECT d.model, d.row_id, d.source, d.gold_label, d.pred_by_probs, d.correct_by_probs, d.regime, t.style, p.policy, p.gate,
  p.max_passes, coalesce(a.pred, d.pred_by_probs) AS pred_1, coalesce(a.regime, d.regime) AS regime_1,
  coalesce(b.pred, a.pred, d.pred_by_probs) AS pred_2, coalesce(b.regime, a.regime, d.regime) AS regime_2,
  CASE p.gate WHEN 'always' THEN true WHEN 'never' THEN false WHEN 'blind' THEN d.regime <> 'high'
    ELSE d.correct_by_probs = 0 END AS triggered
FROM fx_regimes d CROSS JOIN (SELECT DISTINCT style FROM fx_reflected) t CROSS JOIN fx_policies p
LEFT JOIN fx_reflected_regimes a ON a.model = d.model AND a.row_id = d.row_id AND a.style = t.style AND a.reflection_pass = 1
LEFT JOIN fx_reflected_regimes b ON b.model = d.model AND b.row_id = d.row_id AND b.style = t.style AND b.reflection_pass = 2"""
VIEWS["fx_final"] = """
SELECT *, (final_label = gold_label)::INT AS final_correct,
  CASE WHEN final_regime = 'low' THEN 'NOT_SURE' ELSE final_label END AS output_label FROM (
SELECT *, CASE passes_run WHEN 0 THEN pred_by_probs WHEN 1 THEN pred_1 ELSE pred_2 END AS final_label,
  CASE passes_run WHEN 0 THEN regime WHEN 1 THEN regime_1 ELSE regime_2 END AS final_regime FROM (
SELECT *, CASE WHEN NOT triggered THEN 0 WHEN max_passes = 2 AND regime_1 <> 'high' THEN 2 ELSE 1 END AS passes_run FROM fx_runs))"""


def thresholds(spark, sf):
    return P.regime_thresholds(inputs.direct(spark, sf), M)


def final(spark, sf):
    return P.resolve_final(inputs.direct(spark, sf), inputs.reflected(spark, sf), thresholds(spark, sf), M)


def cells(spark, sf):
    return P.resolve_cells(inputs.direct(spark, sf), inputs.reflected(spark, sf), thresholds(spark, sf), M)


@query(
    "regime_thresholds",
    "model:i entropy_p25:d entropy_p50:d entropy_p75:d margin_p25:d margin_p50:d margin_p75:d",
    "SELECT * FROM fx_thresholds",
)
def regime_thresholds(spark, sf):
    return thresholds(spark, sf)


@query("assign_regime", "model:i row_id:i source:s regime:s", "SELECT * FROM fx_regimes")
def assign_regime(spark, sf):
    return P.assign_regime(inputs.direct(spark, sf), thresholds(spark, sf), M)


@query(
    "policy_gate",
    "model:i policy:s gate:s n:i triggered:i",
    """SELECT model, policy, gate, count(*) AS n, sum(triggered::INT) AS triggered FROM fx_runs WHERE style = 'plain_retry' GROUP BY ALL""",
)
def policy_gate(spark, sf):
    gated = P.policy_gate(P.assign_regime(inputs.direct(spark, sf), thresholds(spark, sf), M))
    return gated.groupBy("model", "policy", "gate").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("triggered").alias("triggered")
    )


@query(
    "resolve_final",
    "model:i row_id:i style:s policy:s passes_run:i final_label:s final_regime:s final_correct:i",
    "SELECT * FROM fx_final",
)
def resolve_final(spark, sf):
    return final(spark, sf)


@query(
    "abstain",
    "model:i policy:s style:s output_label:s n:i",
    "SELECT model, policy, style, output_label, count(*) AS n FROM fx_final GROUP BY ALL",
)
def abstain(spark, sf):
    return final(spark, sf).groupBy("model", "policy", "style", "output_label").agg(F.count(F.lit(1)).alias("n"))


_METRIC_COLUMNS = (
    "n:i forced_accuracy:d selective_accuracy:d coverage:d abstention_rate:d trigger_rate:d correction_rate:d degradation_rate:d"
)
_METRIC_SQL = """count(*) AS n, avg(final_correct) AS forced_accuracy,
  avg(final_correct) FILTER (output_label <> 'NOT_SURE') AS selective_accuracy,
  avg((output_label <> 'NOT_SURE')::INT) AS coverage, avg((output_label = 'NOT_SURE')::INT) AS abstention_rate,
  avg(triggered::INT) AS trigger_rate, coalesce(avg(final_correct) FILTER (correct_by_probs = 0), 0) AS correction_rate,
  coalesce(avg(1 - final_correct) FILTER (correct_by_probs = 1), 0) AS degradation_rate"""
VIEWS["fx_metrics"] = f"SELECT model, policy, style, gate, max_passes, {_METRIC_SQL} FROM fx_final GROUP BY ALL"


@query("policy_metrics", "model:i policy:s style:s " + _METRIC_COLUMNS, "SELECT * FROM fx_metrics")
def policy_metrics(spark, sf):
    return P.policy_metrics(cells(spark, sf), M)


@query(
    "policy_metrics_by_source",
    "model:i policy:s style:s source:s " + _METRIC_COLUMNS,
    f"""SELECT model, policy, style, source, {_METRIC_SQL} FROM fx_final
GROUP BY GROUPING SETS ((model, policy, style, source), (model, policy, style))""",
)
def policy_metrics_by_source(spark, sf):
    return P.policy_metrics_by_source(cells(spark, sf), M)


@query(
    "blind_oracle_gap",
    "model:i style:s max_passes:i blind_accuracy:d oracle_accuracy:d gap:d",
    """SELECT b.model, b.style, b.max_passes, b.forced_accuracy AS blind_accuracy, o.forced_accuracy AS oracle_accuracy,
  o.forced_accuracy - b.forced_accuracy AS gap
FROM fx_metrics b JOIN fx_metrics o USING (model, style, max_passes) WHERE b.gate = 'blind' AND o.gate = 'oracle'""",
)
def blind_oracle_gap(spark, sf):
    return P.blind_oracle_gap(P.policy_metrics(cells(spark, sf), M), M)


_DELTAS = ["forced_accuracy", "coverage", "correction_rate", "degradation_rate"]


@query(
    "one_vs_two_pass",
    "model:i style:s gate:s " + " ".join(f"delta_{c}:d" for c in _DELTAS),
    f"""SELECT t.model, t.style, t.gate, {', '.join(f't.{c} - o.{c} AS delta_{c}' for c in _DELTAS)}
FROM fx_metrics t JOIN fx_metrics o USING (model, style, gate) WHERE t.max_passes = 2 AND o.max_passes = 1""",
)
def one_vs_two_pass(spark, sf):
    return P.one_vs_two_pass(P.policy_metrics(cells(spark, sf), M), M)


@query(
    "regime_breakdown",
    "model:i policy:s style:s regime:s n:i trigger_rate:d direct_accuracy:d final_accuracy:d",
    """SELECT model, policy, style, regime, count(*) AS n, avg(triggered::INT) AS trigger_rate,
  avg(correct_by_probs) AS direct_accuracy, avg(final_correct) AS final_accuracy FROM fx_final GROUP BY ALL""",
)
def regime_breakdown(spark, sf):
    return P.regime_breakdown(cells(spark, sf), M)


# ---------------------------------------------------------------- retries

VIEWS["fx_outcomes"] = """
SELECT *, coalesce(retry_pred = gold_label, false)::INT AS retry_correct,
  coalesce(retry_pred <> orig_pred, false)::INT AS changed_answer, retry_pred IS NOT NULL AS retried FROM (
SELECT d.model, d.row_id, d.source, d.gold_label, d.pred_by_probs AS orig_pred, r.pred_by_probs AS retry_pred,
  d.entropy_over_labels AS orig_entropy, d.margin AS orig_margin, r.entropy_over_labels AS retry_entropy,
  r.margin AS retry_margin, r.top1_prob AS retry_top1_prob
FROM fx_direct d LEFT JOIN fx_retries r USING (model, row_id) WHERE d.correct_by_probs = 0)"""
VIEWS["fx_retry_summary"] = """
SELECT *, n_recovered / n_wrong AS recovery_rate, n_changed / n_wrong AS change_rate,
  baseline_accuracy + n_recovered / n_total AS post_retry_accuracy FROM (
SELECT model, count(*) AS n_total, avg(correct_by_probs) AS baseline_accuracy FROM fx_direct GROUP BY model)
JOIN (SELECT model, count(*) AS n_wrong, count(*) FILTER (retried) AS n_retried, sum(changed_answer) AS n_changed,
  sum(retry_correct) AS n_recovered, avg(retry_correct) FILTER (changed_answer = 1) AS changed_accuracy,
  avg(retry_correct) FILTER (retried AND changed_answer = 0) AS unchanged_accuracy FROM fx_outcomes GROUP BY model) USING (model)"""


def outcomes(spark, sf):
    return Y.retry_outcomes(inputs.direct(spark, sf), inputs.retries(spark, sf), M)


@query(
    "oracle_retry_candidates",
    "model:i row_id:i source:s pred_by_probs:s",
    "SELECT * FROM fx_direct WHERE correct_by_probs = 0",
)
def oracle_retry_candidates(spark, sf):
    return Y.oracle_retry_candidates(inputs.direct(spark, sf))


@query(
    "retry_outcomes",
    "model:i row_id:i source:s gold_label:s orig_pred:s retry_pred:s retried:b retry_correct:i changed_answer:i orig_entropy:d "
    "orig_margin:d retry_entropy:d retry_margin:d retry_top1_prob:d",
    "SELECT * FROM fx_outcomes",
)
def retry_outcomes(spark, sf):
    return outcomes(spark, sf)


@query(
    "retry_summary",
    "model:i n_total:i n_wrong:i n_retried:i n_changed:i n_recovered:i recovery_rate:d change_rate:d changed_accuracy:d "
    "unchanged_accuracy:d baseline_accuracy:d post_retry_accuracy:d",
    "SELECT * FROM fx_retry_summary",
)
def retry_summary(spark, sf):
    return Y.retry_summary(inputs.direct(spark, sf), outcomes(spark, sf), M)


@query(
    "retry_by_source",
    "model:i source:s n_wrong:i n_retried:i recovered:i changed:i recovery_rate:d change_rate:d",
    """SELECT model, source, count(*) AS n_wrong, count(*) FILTER (retried) AS n_retried, sum(retry_correct) AS recovered, sum(changed_answer) AS changed,
  avg(retry_correct) AS recovery_rate, avg(changed_answer) AS change_rate FROM fx_outcomes GROUP BY ALL""",
)
def retry_by_source(spark, sf):
    return Y.retry_by_source(outcomes(spark, sf), M)


@query(
    "uncertainty_shift",
    "model:i retry_correct:i n:i mean_entropy_change:d mean_margin_change:d",
    """SELECT model, retry_correct, count(*) AS n, avg(retry_entropy - orig_entropy) AS mean_entropy_change,
  avg(retry_margin - orig_margin) AS mean_margin_change FROM fx_outcomes WHERE retried GROUP BY ALL""",
)
def uncertainty_shift(spark, sf):
    return Y.uncertainty_shift(outcomes(spark, sf), M)


@query(
    "self_confidence_summary",
    "model:i correct:i n:i n_parsed:i parse_success_rate:d mean_confidence:d",
    """SELECT model, correct, count(*) AS n, count(self_confidence) AS n_parsed,
  count(self_confidence) / count(*) AS parse_success_rate, avg(self_confidence) AS mean_confidence
FROM fx_confidences GROUP BY GROUPING SETS ((model, correct), (model))""",
)
def self_confidence_summary(spark, sf):
    return Y.self_confidence_summary(inputs.confidences(spark, sf), M)


@query(
    "model_comparison",
    "model:i baseline_accuracy:d post_retry_accuracy:d delta:d n_wrong:i n_retried:i n_changed:i recovery_rate:d",
    "SELECT *, post_retry_accuracy - baseline_accuracy AS delta FROM fx_retry_summary",
)
def model_comparison(spark, sf):
    return Y.model_comparison(inputs.direct(spark, sf), outcomes(spark, sf), M)


_PAIRS = ", ".join(
    f"max(CASE WHEN model = {m} THEN b END) AS baseline_{m}, max(CASE WHEN model = {m} THEN coalesce(r, 0) - b END) AS gain_{m}"
    for m in inputs.MODELS
)


@query(
    "source_model_matrix",
    "source:s " + " ".join(f"baseline_{m}:d gain_{m}:d" for m in inputs.MODELS),
    f"""SELECT source, {_PAIRS} FROM (SELECT model, source, avg(correct_by_probs) AS b FROM fx_direct GROUP BY ALL)
LEFT JOIN (SELECT model, source, avg(retry_correct) AS r FROM fx_outcomes WHERE retried GROUP BY ALL) USING (model, source) GROUP BY source""",
)
def source_model_matrix(spark, sf):
    return Y.source_model_matrix(inputs.direct(spark, sf), outcomes(spark, sf), inputs.MODELS)
