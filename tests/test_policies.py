import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from hedgewise.operators import policies as P
from hedgewise.operators import retry as Y
from hedgewise.plans import inputs


@pytest.fixture(scope="module")
def final(spark):
    thresholds = P.regime_thresholds(inputs.direct(spark, SMALL), ["model"])
    return P.resolve_final(inputs.direct(spark, SMALL), inputs.reflected(spark, SMALL), thresholds, ["model"]).cache()


def test_every_row_meets_every_policy_and_style(spark, final):
    rows = inputs.direct(spark, SMALL).count()
    assert final.count() == rows * len(P.POLICIES) * 4
    assert final.groupBy("model", "row_id", "style", "policy").count().filter("count > 1").count() == 0


def test_baseline_never_fires_and_keeps_answers(final):
    base = final.filter("policy = 'direct_baseline'")
    assert base.filter("triggered OR passes_run > 0 OR final_label <> pred_by_probs").count() == 0


def test_oracle_touches_only_wrong_rows(final):
    oracle = final.filter("gate = 'oracle'")
    assert oracle.filter("correct_by_probs = 1 AND passes_run > 0").count() == 0
    metrics = P.policy_metrics(oracle, ["model"])
    assert metrics.filter("degradation_rate > 0").count() == 0


def test_second_pass_is_skipped_once_high(final):
    assert final.filter("max_passes = 1 AND passes_run = 2").count() == 0
    assert final.filter("gate = 'always' AND max_passes = 2 AND passes_run = 1 AND final_regime <> 'high'").count() == 0


def test_coverage_and_abstention_add_up(final):
    m = P.policy_metrics(final, ["model"])
    assert m.filter(F.abs(F.col("coverage") + F.col("abstention_rate") - 1) > 1e-12).count() == 0


def test_high_is_tested_first(spark):
    row = {"entropy_p25": 0.0, "entropy_p50": 1.0, "entropy_p75": 1.0, "margin_p25": 0.5, "margin_p50": 0.5, "margin_p75": 1.0}
    df = spark.createDataFrame([(1.0, 0.5), (2.0, 0.9), (0.5, 0.1), (1.0, 0.4)], "e double, m double")
    for name, v in row.items():
        df = df.withColumn(name, F.lit(v))
    got = [r[0] for r in df.select(P.regime(F.col("e"), F.col("m"))).collect()]
    assert got == ["high", "low", "low", "low"]


def test_a_missing_second_pass_falls_back(spark):
    schema = "model int, row_id int, source string, gold_label string, pred_by_probs string, correct_by_probs int, entropy_over_labels double, margin double"
    direct = spark.createDataFrame([(0, 1, "s", "B", "A", 0, 1.0, 0.0)], schema)
    refl = spark.createDataFrame(
        [(0, 1, "plain_retry", 1, "B", 1.0, 0.0, 0.5)],
        "model int, row_id int, style string, reflection_pass int, pred string, entropy_over_labels double, margin double, top1_prob double",
    )
    out = P.resolve_final(direct, refl, P.regime_thresholds(direct, ["model"]), ["model"])
    twice = out.filter("policy = 'always_reflect_twice'").first()
    assert twice["final_label"] == "B" and twice["final_correct"] == 1


def test_cells_give_the_same_metrics_as_rows(spark, final):
    thresholds = P.regime_thresholds(inputs.direct(spark, SMALL), ["model"])
    cells = P.resolve_cells(inputs.direct(spark, SMALL), inputs.reflected(spark, SMALL), thresholds, ["model"])
    order = ["model", "policy", "style", "source"]
    by_cells = P.policy_metrics_by_source(cells, ["model"]).orderBy(*order).collect()
    assert by_cells == P.policy_metrics_by_source(final, ["model"]).orderBy(*order).collect()


def test_nothing_wrong(spark):
    schema = "row_id int, source string, gold_label string, pred_by_probs string, correct_by_probs int, entropy_over_labels double, margin double, top1_prob double"
    direct = spark.createDataFrame([(1, "s", "A", "A", 1, 0.1, 0.9, 0.9)], schema)
    row = Y.retry_summary(direct, Y.retry_outcomes(direct, direct, [])).first()
    assert row["n_wrong"] == 0 and row["recovery_rate"] == 0.0 and row["change_rate"] == 0.0
    assert row["post_retry_accuracy"] == 1.0 and row["changed_accuracy"] is None


def test_source_without_retries_counts_zero(spark):
    schema = "model int, row_id int, source string, gold_label string, pred_by_probs string, correct_by_probs int, entropy_over_labels double, margin double, top1_prob double"
    direct = spark.createDataFrame([(0, 1, "s", "A", "A", 1, 0.1, 0.9, 0.9)], schema)
    row = Y.source_model_matrix(direct, Y.retry_outcomes(direct, direct, ["model"]), [0]).first()
    assert row["baseline_0"] == 1.0 and row["gain_0"] == -1.0
