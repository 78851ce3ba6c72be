import math

import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from hedgewise.operators import curation as C
from hedgewise.operators import features as X
from hedgewise.operators import router as R
from hedgewise.plans import catalog, router_queries as Q


@pytest.fixture(scope="module")
def toy(spark):
    """Label follows feat_a, with a few flips; class 1 is a third of the rows."""
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=300), rng.normal(size=300)
    y = ((a > 0.45) ^ (rng.random(300) < 0.05)).astype(int)
    rows = [(i, float(a[i]), float(b[i]), int(y[i])) for i in range(300)]
    return spark.createDataFrame(rows, "row_id int, feat_a double, feat_b double, target_label int").cache()


COLS = ["feat_a", "feat_b"]


def newton(x, y, w, lam):
    """Weighted logistic regression with an unpenalised intercept."""
    z = np.c_[x, np.ones(len(x))]
    beta, pen = np.zeros(z.shape[1]), np.diag([lam] * x.shape[1] + [0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ beta))
        grad = z.T @ (w * (p - y)) + pen @ beta
        hess = (z * (w * p * (1 - p))[:, None]).T @ z + pen
        beta -= np.linalg.solve(hess, grad)
    return beta


def test_logreg_equals_newton(toy):
    pdf = toy.toPandas()
    n, pos = len(pdf), pdf.target_label.sum()
    w = np.where(pdf.target_label == 1, n / (2 * pos), n / (2 * (n - pos)))
    x = pdf[COLS].to_numpy()
    beta = newton((x - x.mean(axis=0)) / x.std(axis=0), pdf.target_label.to_numpy(), w, 1.0)
    lr = R.fit_logreg(toy, COLS).stages[-1]
    assert np.allclose([*lr.coefficients, lr.intercept], beta, atol=1e-4)


def test_trees_learn_the_rule(toy):
    scored = R.apply_router(R.fit_forest(toy, COLS, trees=10, depth=4), toy)
    assert R.binary_scores(scored, "router_pred", "target_label").first()["f1"] > 0.85


def test_forest_keeps_node_ids_and_grows_the_same_trees(toy):
    """Rows keep the node they reached between levels; the forest is the one grown without that."""
    from pyspark.ml.classification import RandomForestClassifier

    model = R.fit_forest(toy, COLS, trees=10, depth=8)
    assert model.stages[-1].getCacheNodeIds()
    plain = RandomForestClassifier(labelCol=R.LABEL, weightCol=R.WEIGHT, numTrees=10, maxDepth=8, featureSubsetStrategy="sqrt", seed=42)
    with R._training_rows(R.with_balanced_weights(toy), COLS, R.LABEL, R.WEIGHT) as (rows, _):
        walked = R._pipeline(COLS, plain).fit(rows)
    got = lambda m: R.apply_router(m, toy).orderBy("row_id").select("router_prob").collect()
    assert got(model) == got(walked)


def test_class_weights(toy, spark):
    rows = {r["target_label"]: r for r in R.class_weights(toy).collect()}
    n, pos, neg = 300, rows[1]["n"], rows[0]["n"]
    assert math.isclose(rows[1]["balanced_weight"], n / (2 * pos))
    assert math.isclose(rows[1]["scale_pos_weight"], neg / pos)
    only = spark.createDataFrame([(0,), (0,)], "target_label int")
    assert R.class_weights(only).first()["scale_pos_weight"] == 1.0


def test_folds_are_even_per_label(toy):
    counts = C.stratified_folds(toy, "target_label").groupBy("target_label", "fold").count().toPandas()
    spread = counts.groupby("target_label")["count"].agg(lambda c: c.max() - c.min())
    assert (spread <= 1).all() and counts["count"].sum() == 300


def test_splits_are_disjoint_and_complete(toy):
    split = C.stratified_holdout(toy, "target_label")
    assert split.count() == 300 and split.select("row_id").distinct().count() == 300
    assert split.filter("split = 'test'").count() == 60
    again = C.stratified_holdout(toy.repartition(7), "target_label")
    assert split.orderBy("row_id").collect() == again.orderBy("row_id").collect()


def test_split3_sizes(spark):
    df = spark.range(3000).select(F.col("id").alias("row_id"), F.concat(F.lit("s"), F.col("id") % 6).alias("source"))
    sizes = {(r["source"], r["split"]): r["count"] for r in C.stratified_split3(df).groupBy("source", "split").count().collect()}
    assert {v for (_, s), v in sizes.items() if s == "train"} == {400}
    assert {v for (_, s), v in sizes.items() if s != "train"} == {50}


def test_matrix_has_22_or_38_features(spark):
    m = Q.matrix(spark, SMALL)
    assert len(X.feature_columns(m)) == 22 and X.feature_columns(m) == sorted(X.FEATURE_NAMES)
    parts = spark.createDataFrame([(0, 1.0)], "row_id long, feat_pc_01 double")
    with pytest.raises(ValueError, match="23 feature columns"):
        Q.matrix(spark, SMALL, parts)
    assert len(X.feature_columns(Q.matrix(spark, SMALL, Q.semantic(spark, SMALL)[0]))) == 38
    with pytest.raises(ValueError):
        X.feature_columns(m, ("feat_",))


def test_generation_without_steps_is_missing(spark):
    rows = spark.createDataFrame([(1,), (2,)], "row_id int")
    steps = spark.createDataFrame(
        [(1, 0, 1, [0.0, 0.0]), (1, 1, 0, [0.0, 0.0]), (1, 2, None, [9.0, 0.0])],
        "row_id int, step int, token_id int, logits array<double>",
    )
    got = {r["row_id"]: r for r in X.generation_signals(steps, rows, ["row_id"]).collect()}
    assert math.isclose(got[1]["perplexity"], 2.0) and math.isclose(got[1]["avg_entropy"], math.log(2))
    assert got[1]["first_token_top5_logprobs"][2:] == [None] * 3
    assert got[2]["perplexity"] is None and got[2]["first_token_top5_logprobs"] is None


def test_three_conditions_needs_flag_and_passage(spark):
    one = lambda rows, schema: spark.createDataFrame(rows, schema)
    ids = range(4)
    vanilla = one([(i, "s", "A", "B") for i in ids], "row_id int, source string, gold_label string, pred string")
    rag = one([(i, "A") for i in ids], "row_id int, pred string")
    flags = one([(0, 0), (1, 1), (2, 1), (3, 1)], "row_id int, router_pred int")
    contexts = one([(0, "x", "x"), (1, "x", ""), (2, "x", "x")], "row_id int, raw_context string, filtered_context string")
    got = {r["row_id"]: r["router_rag_pred"] for r in R.three_conditions(vanilla, rag, flags, contexts).collect()}
    assert got == {0: "B", 1: "B", 2: "A", 3: "B"}
    s = R.condition_summary(R.three_conditions(vanilla, rag, flags, contexts)).first()
    assert (s["calls_saved"], s["actual_rag_calls"]) == (1, 1)


def test_a_kept_router_takes_a_raw_matrix(toy, tmp_path):
    holes = toy.withColumn("feat_a", F.when(F.col("row_id") % 7 != 0, F.col("feat_a")))
    model = R.fit_logreg(holes, COLS)
    R.save_router(model, str(tmp_path / "router"))
    again = R.load_router(str(tmp_path / "router"))
    assert R.router_columns(again) == COLS
    shown = lambda m, df: [(r["row_id"], r["router_prob"]) for r in R.apply_router(m, df).orderBy("row_id").collect()]
    assert shown(model, holes) == shown(again, holes.select("feat_b", "row_id", "feat_a", "target_label"))
    with pytest.raises(ValueError, match="feat_b"):
        R.apply_router(again, holes.drop("feat_b"))


def test_held_out_outliers_do_not_move_a_fold(toy, spark):
    odd = toy.withColumn("feat_a", F.when(F.col("row_id") == 0, F.lit(1e9)).otherwise(F.col("feat_a")))
    rest = lambda df: df.filter("row_id <> 0")
    assert R.Preparation(COLS).fit(rest(odd)).getStatement() == R.Preparation(COLS).fit(rest(toy)).getStatement()
    assert R.Preparation(COLS).fit(odd).getStatement() != R.Preparation(COLS).fit(toy).getStatement()


@pytest.mark.parametrize("name", ["apply_router", "semantic_pca"])
def test_every_model_has_a_router_of_its_own(spark, name):
    """All recorded answers are used, each model's by its own fit."""
    asked = Q.inputs.direct(spark, SMALL).groupBy("model").count().collect()
    rows = catalog.queries()[name](spark, SMALL)
    assert len(asked) == 4 and {r["model"] for r in rows.select("model").distinct().collect()} == {r["model"] for r in asked}
    marks = [c for c in ("router_prob", "feat_pc_01") if c in rows.columns]
    assert rows.groupBy("row_id").agg(F.countDistinct(*marks).alias("n")).filter("n > 1").count() > 0
