"""Preparation, logistic fits, boosted trees and components of many fits at once, against numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hedgewise.operators import boosting as B
from hedgewise.operators import components as PC
from hedgewise.operators import curation as C
from hedgewise.operators import forests as FO
from hedgewise.operators import keyed as K

COLS = ["feat_a", "feat_b", "feat_c"]


@pytest.fixture(scope="module")
def table():
    """Two models; the label follows feat_a for one and feat_b for the other; some holes."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 3))
    model = np.arange(400) % 2
    y = ((x[np.arange(400), model] > 0.4) ^ (rng.random(400) < 0.08)).astype(int)
    x[rng.random(400) < 0.1, 2] = np.nan
    return model, x, y


@pytest.fixture(scope="module")
def rows(spark, table):
    model, x, y = table
    data = [(int(m), i, *[None if math.isnan(v) and i % 2 else float(v) for v in r], int(t)) for i, (m, r, t) in enumerate(zip(model, x, y))]
    return spark.createDataFrame(data, "model int, row_id bigint, feat_a double, feat_b double, feat_c double, target_label int").repartition(5).cache()


def prepared_by_hand(x):
    filled = np.where(np.isnan(x), np.nanmedian(x, axis=0), x)
    return filled, (filled - filled.mean(axis=0)) / filled.std(axis=0)


def test_preparation_is_each_models_own(rows, table):
    model, x, _ = table
    prepared = K.preparation(rows, ["model"], COLS)
    got = K.standardised(rows, prepared, ["model"], COLS).orderBy("row_id").toPandas()
    filled = K.filled(rows, prepared, ["model"], COLS).orderBy("row_id").toPandas()
    for m in (0, 1):
        fill, scaled = prepared_by_hand(x[model == m])
        assert np.allclose(got.loc[got.model == m, COLS], scaled) and np.allclose(filled.loc[filled.model == m, COLS], fill)


def test_preparation_of_constant_and_empty_features(spark):
    train = spark.createDataFrame([(0, 1, 2.0, None), (0, 2, 2.0, float("nan"))], "model int, row_id int, a double, b double")
    prepared = K.preparation(train, ["model"], ["a", "b"])
    other = spark.createDataFrame([(0, 3, 5.0, 1.0), (0, 4, None, None), (1, 5, 1.0, 1.0)], "model int, row_id int, a double, b double")
    got = {r["row_id"]: (r["a"], r["b"]) for r in K.standardised(other, prepared, ["model"], ["a", "b"]).collect()}
    assert got == {3: (3.0, 1.0), 4: (0.0, 0.0)}  # a key without training rows has no result


def newton(x, y, w, penalty):
    z = np.c_[x, np.ones(len(x))]
    beta, ridge = np.zeros(z.shape[1]), np.diag([penalty] * x.shape[1] + [0.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-z @ beta))
        beta -= np.linalg.solve((z * (w * p * (1 - p))[:, None]).T @ z + ridge, z.T @ (w * (p - y)) + ridge @ beta)
    return beta


def test_logistic_fits_equal_newton_by_hand(rows, table):
    model, x, y = table
    keys = ["model", "fit"]
    fold = C.stratified_folds(rows, "target_label", 3, keys=["model"]).select("model", "row_id", "fold")
    copies = K.training_copies(rows.join(fold, ["model", "row_id"]), 3)
    prepared = K.preparation(copies, keys, COLS)
    taught = K.balanced(K.feature_vectors(copies, prepared, keys, COLS, [*keys, "row_id", "target_label"]), keys, "target_label")
    taught = taught.withColumn("y", F.col("target_label"))
    fits = K.fit_logistic(taught, keys)
    held = {(r["model"], r["row_id"]): r["fold"] for r in fold.collect()}
    got = {(r["model"], r["fit"]): r for r in fits.collect()}
    assert len(got) == 8 and all(r["settled"] and r["steps"] < 12 for r in got.values())
    for (m, k), r in got.items():
        mine = np.array([i for i in range(400) if model[i] == m and held[m, i] != k])
        _, z = prepared_by_hand(x[mine])
        t = y[mine]
        w = np.where(t == 1, len(t) / (2 * t.sum()), len(t) / (2 * (len(t) - t.sum())))
        assert np.allclose(r["coefficients"], newton(z, t, w, 1.0), atol=1e-8)
    slopes = K.gradients(taught, fits, keys).agg(F.max(F.abs("gradient"))).first()[0]
    assert slopes < 1e-6


def test_gradients_work_out_a_rows_slope_once(spark, tmp_path):
    """The slope of a row is one number; its products with the features must not work it out again for each of them."""
    rows = spark.createDataFrame([(0, [1.0, 2.0, 3.0], 1.0, 2.0), (0, [0.5, 0.0, -1.0], 0.0, 1.0)], "k int, x array<double>, y double, w double")
    fits = spark.createDataFrame([(0, [0.1, 0.2, 0.3, 0.4])], "k int, coefficients array<double>")
    found = K.gradients(rows, fits, ["k"])
    x, y, w, b = np.array([[1.0, 2, 3, 1], [0.5, 0, -1, 1]]), np.array([1.0, 0]), np.array([2.0, 1]), np.array([0.1, 0.2, 0.3, 0.4])
    want = x.T @ (w * (1 / (1 + np.exp(-x @ b)) - y)) + b * [1, 1, 1, 0]
    assert np.allclose([r["gradient"] for r in found.orderBy("position").collect()], want)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    inner = [line for line in plan.splitlines() if "posexplode" in line]
    assert inner and all("EXP" not in line.upper().split("TRANSFORM(CONCAT(")[1].split("LAMBDAFUNCTION(")[1].split(",")[0] for line in inner)


def test_logistic_of_separable_rows_settles(spark):
    data = [(i, [float(i)], int(i > 5), 1.0) for i in range(12)]
    fit = K.fit_logistic(spark.createDataFrame(data, "k int, x array<double>, y int, w double").withColumn("k", F.lit(1)), ["k"]).first()
    assert fit["settled"] and fit["coefficients"][0] > 0


def test_platt_targets_and_slope(spark):
    rng = np.random.default_rng(5)
    s = rng.random(300)
    y = (rng.random(300) < s**2).astype(int)
    df = spark.createDataFrame([(1, float(a), int(b)) for a, b in zip(s, y)], "k int, p double, y int")
    got = K.fit_platt(df, ["k"], "p", "y").first()
    n1, n0 = y.sum(), len(y) - y.sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    want = newton(s[:, None], target, np.ones(300), 0.0)
    assert np.allclose([got["slope"], got["shift"]], want, atol=1e-7)


# ---------------------------------------------------------------- trees


def binned_rows(rows, keys=("model",)):
    named = rows.withColumn("y", F.col("target_label"))
    return B.prepare_bins(named, named, list(keys), COLS, [*keys, "row_id", "y"])


def test_bins_are_exact_quantiles(rows, table):
    model, x, _ = table
    got, _, edges = binned_rows(rows)
    e = {(r["model"], r["feature"]): np.array(r["edges"]) for r in edges.collect()}
    for m in (0, 1):
        fill, _ = prepared_by_hand(x[model == m])
        for j, c in enumerate(COLS):
            assert np.allclose(e[m, c], np.unique(np.quantile(fill[:, j], [(i + 1) / B.BINS for i in range(B.BINS - 1)])))
    for r in got.collect():
        fill, _ = prepared_by_hand(x[model == r["model"]])
        at = fill[r["row_id"] // 2]
        assert r["bins"] == [int((e[r["model"], c] < v).sum()) for c, v in zip(COLS, at)]


def split_by_hand(bins, g, h, l1, l2):
    score = lambda a, b: max(abs(a) - l1, 0.0) ** 2 / (b + l2)
    best = (-1.0, None, None)
    for f in range(bins.shape[1]):
        for c in range(B.BINS - 1):
            left = bins[:, f] <= c
            if h[left].sum() >= 1 and h[~left].sum() >= 1:
                gain = score(g[left].sum(), h[left].sum()) + score(g[~left].sum(), h[~left].sum()) - score(g.sum(), h.sum())
                if gain > best[0] + 1e-9:
                    best = (gain, f, c)
    return best


def numbers(df):
    pdf = df.orderBy("row_id").toPandas()
    return pdf.row_id.to_numpy(), np.stack(pdf.bins.to_numpy()).astype(np.int64), pdf.y.to_numpy()


def test_a_tree_equals_one_grown_by_hand(rows):
    ids, bins, y = numbers(binned_rows(rows)[0].filter("model = 0"))
    s = B.Settings(2, np.array([0.3]), np.array([0.1]), np.array([1.0]))
    grown = B.grow_here(ids, bins, y, s, 1)
    scale = (y == 0).sum() / (y == 1).sum()
    g, h = B.slopes(np.zeros(len(y)), y, scale)
    taken = B.drawn(ids, 0)
    assert 0.7 < taken.mean() < 0.9
    gain, f, c = split_by_hand(bins[taken], g[taken], h[taken], 0.1, 1.0)
    assert (grown.feature[0][0, 0], grown.cut[0][0, 0]) == (f, c) and math.isclose(grown.gain[0][0, 0], gain, abs_tol=1e-8)
    for node, side in ((1, bins[:, f] <= c), (2, bins[:, f] > c)):
        part = taken & side
        gain, f2, c2 = split_by_hand(bins[part], g[part], h[part], 0.1, 1.0)
        leaf, at = part, node
        if gain > 1e-6:
            assert (grown.feature[0][0, node], grown.cut[0][0, node]) == (f2, c2)
            leaf, at = part & (bins[:, f2] <= c2), 2 * node + 1
        assert grown.feature[0][0, at] == -1
        want = -np.sign(g[leaf].sum()) * max(abs(g[leaf].sum()) - 0.1, 0) / (h[leaf].sum() + 1.0) * 0.3
        assert math.isclose(grown.leaf[0][0, at], want)


def test_level_by_level_over_tasks_gives_the_same_trees(rows):
    mine = binned_rows(rows)[0].filter("model = 1").repartition(4)
    ids, bins, y = numbers(mine)
    s = B.Settings(2, np.array([0.3, 0.3]), np.array([0.0, 1.0]), np.array([1.0, 5.0]))
    here, apart = B.grow_here(ids, bins, y, s, 2), B.grow_apart(mine, s, 2)
    for tree in range(2):
        assert (here.feature[tree] == apart.feature[tree]).all() and (here.cut[tree] == apart.cut[tree]).all()
        assert np.allclose(here.leaf[tree], apart.leaf[tree])


def test_sums_are_exact_in_any_order_of_rows(rows):
    """The same rows give the same trees to the last bit, however they are ordered, dealt or counted together."""
    mine = binned_rows(rows)[0].filter("model = 1").repartition(3)
    ids, bins, y = numbers(mine)
    s = B.Settings(3, np.array([0.3, 0.1]), np.array([0.0, 1.0]), np.array([1.0, 5.0]))
    here, apart = B.grow_here(ids, bins, y, s, 3), B.grow_apart(mine, s, 3)
    for seed in range(5):
        other = np.random.default_rng(seed).permutation(len(y))
        again = B.grow_here(ids[other], bins[other], y[other], s, 3)
        for tree in range(3):
            for name in ("feature", "cut", "gain", "leaf"):
                assert (getattr(here, name)[tree] == getattr(again, name)[tree]).all()
                assert (getattr(here, name)[tree] == getattr(apart, name)[tree]).all()


@pytest.mark.parametrize("most", [32, 100, 5000])
def test_features_counted_together_have_the_sums_of_each(most):
    rng = np.random.default_rng(1)
    bins = np.column_stack([rng.integers(0, 32, 700), rng.integers(0, 2, 700), rng.integers(3, 9, 700), rng.integers(0, 32, 700)])
    bins = np.column_stack([bins, 31 - bins[:, 0], bins[:, 2] // 3])
    columns, groups = B.together(bins, most)
    assert len(groups) < 6 and all(g.cells <= most for g in groups) and sum(len(g.columns) for g in groups) == 6
    slot, slope = rng.integers(0, 3, 700), rng.integers(-9, 9, 700) + 1j * rng.integers(0, 9, 700)
    got = B.sums_by_slot(groups, len(columns), np.arange(700), slot, 3, slope)
    for k, (f, b) in enumerate(zip(columns.feature, columns.bin)):
        assert [got[i, k] for i in range(3)] == [slope[(slot == i) & (bins[:, f] == b)].sum() for i in range(3)]


def test_first_splits_equal_the_numpy_split(rows):
    ready, _, edges = binned_rows(rows)
    got = {r["model"]: r for r in B.first_splits(ready, edges, ["model"], COLS, 0.1, 0.1, 1.0).collect()}
    for m in (0, 1):
        _, bins, y = numbers(ready.filter(F.col("model") == m))
        g, h = B.slopes(np.zeros(len(y)), y, (y == 0).sum() / (y == 1).sum())
        gain, f, c = split_by_hand(bins, g, h, 0.1, 1.0)
        assert (got[m]["feature"], got[m]["bin"]) == (COLS[f], c) and math.isclose(got[m]["gain"], gain, abs_tol=1e-8)
        assert got[m]["feature"] == COLS[m]


def test_search_fits_and_scores_every_model(spark, rows, tmp_path):
    keys = ["model", "fit"]
    fold = C.stratified_folds(rows, "target_label", 2, keys=["model"]).select("model", "row_id", "fold")
    folded = rows.join(fold, ["model", "row_id"])
    copies = K.training_copies(folded, 2)
    taught = copies.filter("fit >= 0")
    both = taught.withColumn("held", F.lit(0)).unionByName(folded.withColumn("fit", F.col("fold")).withColumn("held", F.lit(1)))
    ready, _, _ = B.prepare_bins(taught, both.withColumn("y", F.col("target_label")), keys, COLS, [*keys, "held", "row_id", "y"])
    grid = B.grid(depths=(1, 2), rates=(0.3,), l1=(0.0, 1.0), l2=(1.0,))
    found = B.search(ready, ["model"], grid, (2, 5)).collect()
    assert len(found) == 2 * 2 * 2 * 2 * 2 and all(0 <= r["f1"] <= 1 for r in found)
    small = B.grid(depths=(1,), rates=(0.3,), l1=(0.0,), l2=(1.0,))
    order = ["model", "fit", "depth", "l1", "trees"]
    near = B.search(ready, ["model"], small, (2,)).orderBy(*order).collect()
    far = B.search(ready, ["model"], small, (2,), local_rows=10).orderBy(*order).collect()
    assert near == far
    best = B.best_settings(spark.createDataFrame(found), ["model"])
    assert best.count() == 2
    router = B.fit_router(copies, keys, COLS, best, ["model"], "target_label")
    router.save(str(tmp_path / "router"))
    again = B.Router.load(spark, str(tmp_path / "router"), keys, COLS)
    asked = rows.withColumn("fit", F.lit(-1))
    scored = again.score(asked)
    assert scored.count() == 400 and {"router_prob", "router_pred", "row_id"} <= set(scored.columns)
    right = scored.agg(F.avg((F.col("router_pred") == F.col("target_label")).cast("int"))).first()[0]
    assert right > 0.85
    with pytest.raises(ValueError, match="feat_b"):
        again.score(asked.drop("feat_b"))
    top = {r["model"]: r["feature"] for r in B.importances(router).filter("fit = -1 AND gain > 0.5").collect()}
    assert top == {0: "feat_a", 1: "feat_b"}


# ---------------------------------------------------------------- forests


def test_a_forest_tree_has_pure_leaves_and_does_not_see_the_order_of_rows(rows):
    ids, bins, y = numbers(binned_rows(rows)[0].filter("model = 0"))
    for tree in range(3):
        grown = FO.grow(ids, bins, y, tree)
        taken = np.searchsorted(FO.TIMES, B.uniform(ids, (FO.SEED << 20) + tree), side="right") > 0
        assert 0.5 < taken.mean() < 0.75
        alike = {}
        for b, t in zip(bins[taken], y[taken]):
            alike.setdefault(tuple(b), set()).add(t)
        pure = np.array([len(alike[tuple(b)]) == 1 for b in bins[taken]])
        assert pure.mean() > 0.95 and (grown.score(bins)[taken][pure] == y[taken][pure]).all()
        other = np.random.default_rng(tree).permutation(len(y))
        again = FO.grow(ids[other], bins[other], y[other], tree)
        assert all((getattr(grown, c) == getattr(again, c)).all() for c in ("feature", "bin", "child", "prob"))


def test_forest_cuts_fall_most_in_weighted_impurity():
    rng = np.random.default_rng(2)
    bins, y = rng.integers(0, 6, (90, 3)), rng.integers(0, 2, 90)
    counts, weights = np.where(y == 1, 1 + 0j, 1j), (0.7, 1.9)
    sums = FO._sums(bins, np.arange(90), np.zeros(90, np.int64), counts, np.array([[0, 1, 2]]))
    f, b, left, right = FO._cuts(sums, weights)

    def impurity(side):
        pos, neg = (y[side] == 1).sum() * weights[1], (y[side] == 0).sum() * weights[0]
        return (pos + neg) * (1 - (pos / (pos + neg)) ** 2 - (neg / (pos + neg)) ** 2)

    every = {(j, c): impurity(bins[:, j] <= c) + impurity(bins[:, j] > c) for j in range(3) for c in range(5)}
    assert math.isclose(every[f[0], b[0]], min(every.values()))
    assert (left[0].real, right[0].imag) == ((y[bins[:, f[0]] <= b[0]] == 1).sum(), (y[bins[:, f[0]] > b[0]] == 0).sum())


def test_forests_of_all_models_share_a_job(rows, monkeypatch):
    named = rows.withColumn("y", F.col("target_label"))
    taught = named.filter("row_id % 4 <> 0").withColumn("held", F.lit(0))
    both = taught.unionByName(named.withColumn("held", F.lit(1)))
    ready, _, _ = B.prepare_bins(taught, both, ["model"], COLS, ["model", "held", "row_id", "y"])
    got = FO.scores(ready, ["model"], ["row_id", "y"], trees=20).orderBy("row_id").collect()
    assert len(got) == 400
    fresh = [r for r in got if r["row_id"] % 4 == 0]
    assert np.mean([r["router_pred"] == r["y"] for r in fresh]) > 0.7
    assert np.mean([r["router_pred"] == r["y"] for r in got if r["row_id"] % 4]) > 0.95
    monkeypatch.setattr(FO, "TREES_PER_TASK", 3)
    assert FO.scores(ready.repartition(7), ["model"], ["row_id", "y"], trees=20).orderBy("row_id").collect() == got


# ---------------------------------------------------------------- components, quotas


def test_components_of_every_model(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(160, 5)) * [5, 3, 1, 0.5, 0.1] + 100
    data = [(i % 2, i, [float(v) for v in r]) for i, r in enumerate(x)] + [(0, 999, None), (1, 1000, None)]
    df = spark.createDataFrame(data, "model int, row_id int, vector array<double>").repartition(4)
    got, variances = PC.principal_components(df, ["model"], df, 2)
    got = got.orderBy("row_id").toPandas()
    assert len(got) == 162 and got[got.row_id >= 999][["feat_pc_01", "feat_pc_02"]].isna().all().all()
    for m in (0, 1):
        mine = x[m::2]
        u, s, vt = np.linalg.svd(mine - mine.mean(0), full_matrices=False)
        flip = np.sign(vt[:2][np.arange(2), np.abs(vt[:2]).argmax(axis=1)])
        have = got[(got.model == m) & (got.row_id < 999)][["feat_pc_01", "feat_pc_02"]].to_numpy()
        assert np.allclose(have, u[:, :2] * s[:2] * flip, atol=1e-8)
        v = {r["component"]: r["variance"] for r in variances.filter(F.col("model") == m).collect()}
        assert np.allclose([v[1], v[2]], s[:2] ** 2 / (len(mine) - 1))


def test_components_are_never_more_than_rows(spark):
    df = spark.createDataFrame([(0, 1, [1.0, 2.0, 3.0]), (0, 2, [2.0, 2.0, 2.0])], "model int, row_id int, vector array<double>")
    got = PC.principal_components(df, ["model"], df, 3)[0].collect()
    assert all(r["feat_pc_03"] is None and r["feat_pc_01"] is not None for r in got)
    none = PC.principal_components(df, ["model"], df.limit(0), 3)[0].collect()
    assert len(none) == 2 and all(r["feat_pc_01"] is None for r in none)


def test_quotas_of_a_million_strata(spark):
    strata = spark.range(1_000_000).select(F.col("id").alias("s"), (1 + F.col("id") % 3).alias("_n"))
    plan = C._quotas(strata, "s", F.col("_n"), F.lit(300_000), "_q", [])
    got = plan.agg(F.sum("_q").alias("q"), F.max("_q").alias("most"), F.count("*").alias("n")).first()
    assert tuple(got) == (300_000, 1, 1_000_000)


def test_splits_and_folds_within_models(rows):
    part = C.stratified_holdout(rows, "target_label", keys=["model"])
    sizes = {(r["model"], r["split"]): r["count"] for r in part.groupBy("model", "split").count().collect()}
    assert sizes == {(0, "test"): 40, (0, "train"): 160, (1, "test"): 40, (1, "train"): 160}
    folds = C.stratified_folds(rows, "target_label", 5, keys=["model"]).groupBy("model", "target_label").agg(F.count("*").alias("n"), F.countDistinct("fold").alias("k"))
    assert all(r["k"] == 5 for r in folds.collect())
