"""Rows and texts that an earlier version lost: each case is small and states what must stay."""

import pytest
from conftest import SMALL  # noqa: F401
from pyspark.sql import functions as F

from hedgewise import session
from hedgewise.functions.labels import parse_list_literal
from hedgewise.operators import curation as C
from hedgewise.operators import policies as P
from hedgewise.operators import retry as Y
from hedgewise.operators.features import token_class_shares
from hedgewise.operators.ranking import roc_auc

DIRECT = "model int, row_id int, source string, gold_label string, pred_by_probs string, correct_by_probs int, entropy_over_labels double, margin double"
PASSES = "model int, row_id int, style string, reflection_pass int, pred string, entropy_over_labels double, margin double, top1_prob double"


@pytest.fixture(scope="module")
def three(spark):
    rows = [(0, 1, "s", "A", "A", 1, 1.0, 0.2), (0, 2, "s", "B", "B", 1, 1.0, 0.2), (0, 3, "s", "B", "A", 0, 1.0, 0.2)]
    return spark.createDataFrame(rows, DIRECT)


def test_policies_keep_rows_without_a_reflection(spark, three):
    passes = spark.createDataFrame([(0, 3, "plain_retry", 1, "B", 1.0, 0.0, 0.5)], PASSES)
    cells = P.resolve_cells(three, passes, P.regime_thresholds(three, ["model"]), ["model"])
    got = {r["policy"]: (r["n"], r["forced_accuracy"]) for r in P.policy_metrics(cells, ["model"]).collect()}
    assert got["direct_baseline"] == (3, pytest.approx(2 / 3))
    assert got["oracle_gate_once"] == (3, 1.0)
    assert {n for n, _ in got.values()} == {3}


def test_policies_without_any_reflection(spark, three):
    cells = P.resolve_cells(three, spark.createDataFrame([], PASSES), P.regime_thresholds(three, ["model"]), ["model"])
    assert {r["n"] for r in P.policy_metrics(cells, ["model"]).collect()} == {3}


def test_retries_count_all_wrong_answers(spark):
    direct = spark.createDataFrame([(0, i, "s", "B", "A", 0, 1.0, 0.2) for i in range(4)], DIRECT)
    second = spark.createDataFrame([(0, 1, "B", 0.5, 0.5, 0.9)], "model int, row_id int, pred_by_probs string, entropy_over_labels double, margin double, top1_prob double")
    got = Y.retry_summary(direct, Y.retry_outcomes(direct, second, ["model"]), ["model"]).first()
    assert (got["n_wrong"], got["n_retried"], got["n_recovered"], got["recovery_rate"]) == (4, 1, 1, 0.25)


def test_nan_scores_are_missing(spark):
    df = spark.createDataFrame([(1, 0.1, 0), (2, float("nan"), 0), (3, 0.9, 1), (4, 0.5, 0)], "row_id int, s double, y int")
    got = roc_auc(df, "s", "y").first()
    assert (got["n"], got["auc"]) == (3, 1.0)


def test_none_inside_a_quoted_text_is_text(one):
    assert one(parse_list_literal(F.col("t")), t="['red, None, blue', 'x']") == ["red, None, blue", "x"]
    assert one(parse_list_literal(F.col("t")), t="[None, 'a', None]") == [None, "a", None]
    assert one(parse_list_literal(F.col("t")), t='["it\'s, None,", None]') == ["it's, None,", None]


def test_a_token_with_two_classes_counts_once(spark):
    rows = spark.createDataFrame([(1, "run run cat")], "row_id int, question string")
    lexicon = spark.createDataFrame([("run", "NOUN"), ("run", "VERB"), ("cat", "NOUN")], "token string, token_class string")
    got = token_class_shares(rows, lexicon).first()
    assert (got["feat_noun_ratio"], got["feat_verb_ratio"]) == (1.0, pytest.approx(2 / 3))


def test_any_of_many_splits_can_be_chosen(spark):
    df = spark.range(3000).select("id", F.concat(F.lit("s"), "id").alias("split"))
    for name in ("s0", "s1500", "S2999"):
        assert C.select_split(df, name).count() == 1
    with pytest.raises(ValueError, match="several splits"):
        C.select_split(df)


def test_questions_that_differ_late_are_different(spark):
    rows = [(1, "q" * 250 + "one"), (2, "q" * 250 + "two"), (3, "q" * 250 + "ONE ")]
    df = spark.createDataFrame(rows, "row_id int, question string")
    assert sorted(r["row_id"] for r in C.drop_repeats(df).collect()) == [1, 2]
    assert C.dedup_against_pool(df, df.filter("row_id = 2")).count() == 2
    assert C.dedup_against_pool(df, df.filter("row_id = 2"), 200).count() == 0


def test_long_texts_count_towards_the_broadcast_limit(spark, monkeypatch):
    monkeypatch.setattr(session, "BROADCAST_LIMIT_BYTES", 50_000)
    big = spark.range(10).select((F.col("id") % 3).alias("k"))
    small = spark.range(10).select(F.col("id").alias("k"), F.repeat(F.lit("x"), 10_000).alias("v"))
    assert "broadcast" not in session.join_small(big, small, ["k"])._jdf.queryExecution().logical().toString().lower()
