import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hedgewise.operators import calibration as K
from hedgewise.operators import ranking as R
from hedgewise.operators import thresholds as T
from hedgewise.operators.ranks import percentile_rows, row_ranks, running_totals


def scores(n, seed, hot=0.34):
    """Scores where one key and one value each hold a third of all rows."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = "hot" if rng.random() < hot else f"k{rng.randrange(5)}"
        s = 0.5 if rng.random() < hot else round(rng.gauss(0, 1), 2)
        y = int(rng.random() < 1 / (1 + math.exp(-s)))
        rows.append((i, key, None if rng.random() < 0.02 else s, y))
    return pd.DataFrame(rows, columns=["row_id", "k", "s", "y"]).astype({"s": "float64"})


@pytest.fixture(scope="module")
def pdf():
    return scores(3000, 7)


@pytest.fixture(scope="module")
def df(spark, pdf):
    return spark.createDataFrame(pdf).withColumn("s", F.nanvl("s", F.lit(None).cast("double"))).cache()


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("keys", [["k"], []])
def test_running_totals(df, pdf, keys, descending):
    got = running_totals(df, keys, "s", {"n": F.lit(1), "pos": F.col("y")}, descending).toPandas()
    clean = pdf.dropna(subset=["s"])
    want = clean.groupby([*keys, "s"], as_index=False).agg(n=("y", "size"), pos=("y", "sum")).sort_values("s", ascending=not descending)
    groups = want.groupby(keys) if keys else want.assign(_=0).groupby("_")
    for c in ("n", "pos"):
        want[f"cum_{c}"] = groups[c].cumsum()
        want[f"all_{c}"] = groups[c].transform("sum")
    order = [*keys, "s"]
    pd.testing.assert_frame_equal(
        got.sort_values(order).reset_index(drop=True), want.sort_values(order).reset_index(drop=True)[got.columns], check_dtype=False
    )


def test_totals_do_not_depend_on_partitioning(df):
    a = running_totals(df.repartition(1), ["k"], "s", {"n": F.lit(1)}).orderBy("k", "s").collect()
    b = running_totals(df.repartition(13), ["k"], "s", {"n": F.lit(1)}).orderBy("k", "s").collect()
    assert a == b


def test_empty_and_single(spark, df):
    empty = df.filter("row_id < 0")
    assert running_totals(empty, ["k"], "s", {"n": F.lit(1)}).count() == 0
    assert R.roc_auc(empty, "s", "y").first()["auc"] is None
    single = spark.createDataFrame([(1, 0.3)], "row_id int, s double")
    assert percentile_rows(single, [], "s", [0.25, 0.5]).select("edge").distinct().collect()[0][0] == 0.3


def test_row_ranks(df, pdf):
    got = row_ranks(df.filter("s is not null"), ["k"], ["s", "row_id"]).toPandas()
    want = pdf.dropna(subset=["s"]).sort_values(["s", "row_id"])
    want["rank"] = want.groupby("k").cumcount() + 1
    merged = got.merge(want, on="row_id")
    assert len(merged) == len(want) and (merged["rank_x"] == merged["rank_y"]).all()


@pytest.mark.parametrize("probs", [[0.0, 0.25, 0.5, 0.75, 1.0], [0.01, 0.33, 0.9], [0.5], [i / 100 for i in range(0, 101, 2)]])
def test_percentiles(df, pdf, probs):
    got = percentile_rows(df, ["k"], "s", probs, {"rows": F.lit(1)}).toPandas()
    for k, part in pdf.dropna(subset=["s"]).groupby("k"):
        mine = got[got.k == k].sort_values("prob_index")
        edges = np.percentile(part.s, [p * 100 for p in probs])
        assert np.allclose(mine.edge, edges)
        assert list(mine.below_rows) == [(part.s < e).sum() for e in mine.edge]
        assert list(mine.upto_rows) == [(part.s <= e).sum() for e in mine.edge]


def brute_auc(s, y):
    pos, neg = s[y == 1].to_numpy(), s[y == 0].to_numpy()
    wins = (pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()
    return wins / (len(pos) * len(neg))


def test_auc_brute_force_and_mirror(df, pdf):
    got = {r["k"]: r["auc"] for r in R.roc_auc(df, "s", "y", ["k"]).collect()}
    mirrored = {r["k"]: r["auc"] for r in R.roc_auc(df.withColumn("s", -F.col("s")), "s", "y", ["k"]).collect()}
    for k, part in pdf.dropna(subset=["s"]).groupby("k"):
        assert math.isclose(got[k], brute_auc(part.s, part.y))
        assert math.isclose(got[k] + mirrored[k], 1.0)


def test_auc_single_class(spark):
    df = spark.createDataFrame([(0.1, 1), (0.2, 1)], "s double, y int")
    assert R.roc_auc(df, "s", "y").first()["auc"] is None


def test_average_precision_is_stepwise(spark):
    df = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.7, 1), (0.1, 0)], "s double, y int")
    assert math.isclose(R.average_precision(df, "s", "y").first()["average_precision"], 5 / 6)


def test_curves_end_points(spark):
    df = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.7, 1), (0.7, 0)], "s double, y int")
    roc = {(r["fpr"], r["tpr"]) for r in R.roc_curve(df, "s", "y").collect()}
    assert roc == {(0.0, 0.0), (0.0, 0.5), (0.5, 0.5), (1.0, 1.0)}
    pr = {(round(r["precision"], 4), r["recall"]) for r in R.pr_curve(df, "s", "y").collect()}
    assert pr == {(1.0, 0.0), (1.0, 0.5), (0.5, 0.5), (0.5, 1.0)}


def test_spearman_with_ties(spark, pdf):
    part = pdf.dropna(subset=["s"]).assign(z=lambda d: d.s.round(0) + d.y)
    row = R.spearman(spark.createDataFrame(part[["s", "z"]]), "s", "z").first()
    assert row["n"] == len(part)
    assert math.isclose(row["rho"], part.s.rank().corr(part.z.rank()), rel_tol=1e-9)
    assert 0 <= row["p_value"] < 1e-6


@pytest.mark.parametrize("freedom, t, want", [(8, 0.5, 0.630536), (8, 2.306004, 0.05), (1, 1.0, 0.5), (2, 4.302653, 0.05), (30, 2.042272, 0.05), (998, 1.962344, 0.05), (100_000, 1.959988, 0.05)])
def test_student_tail(one, freedom, t, want):
    rest = F.lit(freedom / (freedom + t * t))
    assert math.isclose(one(R.t_two_sided(rest, F.lit(float(freedom)))), want, abs_tol=1e-6)


def test_spearman_of_ten_rows(spark):
    x, y = [1, 2, 3, 4, 5, 6, 7, 8, 9, 10], [2, 1, 4, 3, 7, 5, 6, 10, 8, 9]
    got = R.spearman(spark.createDataFrame(list(zip(x, y)), "x int, y int"), "x", "y").first()
    rho = 1 - 6 * sum((a - b) ** 2 for a, b in zip(x, y)) / (10 * 99)
    assert got["n"] == 10 and math.isclose(got["rho"], rho)
    t, steps = rho * math.sqrt(8 / (1 - rho * rho)), 200_000  # the tail of Student's t with 8 degrees, by Simpson's rule
    top = math.asin(math.sqrt(8 / (8 + t * t)))
    area = sum((1 if i in (0, steps) else 4 if i % 2 else 2) * math.sin(top * i / steps) ** 7 for i in range(steps + 1)) * top / steps / 3
    assert math.isclose(got["p_value"], 2 * area * math.gamma(4.5) / math.gamma(4) / math.gamma(0.5), abs_tol=1e-6)


def test_spearman_skips_missing_and_needs_spread(spark):
    rows = [(1.0, 1.0), (2.0, 2.0), (3.0, 3.0), (float("nan"), 9.0), (4.0, None)]
    got = R.spearman(spark.createDataFrame(rows, "x double, y double"), "x", "y").first()
    assert got["n"] == 3 and math.isclose(got["rho"], 1.0) and got["p_value"] < 1e-6
    flat = R.spearman(spark.createDataFrame([(1.0, 1.0), (1.0, 2.0), (1.0, 5.0)], "x double, y double"), "x", "y").first()
    assert flat["rho"] is None and flat["p_value"] is None
    none = R.spearman(spark.createDataFrame([], "x double, y double"), "x", "y").first()
    assert none["n"] == 0 and none["rho"] is None


def test_nan_is_missing(spark):
    from hedgewise.operators import calibration as C

    rows = [(0.1, 0), (float("nan"), 0), (0.9, 1), (0.95, 1), (None, 1)]
    df = spark.createDataFrame(rows, "p double, y int").withColumn("g", F.lit("a"))
    uniform = {r["bin"]: (r["n"], r["fraction_positive"]) for r in C.reliability_uniform(df, "p", "y").collect()}
    assert uniform == {0: (1, 0.0), 8: (1, 1.0), 9: (1, 1.0)} or uniform == {0: (1, 0.0), 9: (2, 1.0)}
    assert C.ece_weighted(df, "p", "y").first()["n"] == 3
    assert C.f1_at_threshold(df, "p", "y").first()["f1"] == 1.0
    assert R.signal_histogram(df, "p", "g", 4).agg(F.sum("n")).first()[0] == 3
    assert R.pearson(df, "p", "y").first()["n"] == 3
    assert math.isclose(R.means_by_correctness(df, "g", ["p"]).first()["mean_p"], 0.65)
    errors = [r[0] for r in df.select(C.vanilla_error_prob(F.col("p"))).collect()]
    assert errors[1] is None and errors[4] is None and math.isclose(errors[0], 0.9)


def test_binary_scores_zero_division(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "p int, t int")
    row = R.binary_scores(df, "p", "t").first()
    assert (row["precision"], row["recall"], row["f1"], row["accuracy"]) == (0.0, 0.0, 0.0, 1.0)


def test_sweep_and_best_f1_brute_force(df, pdf):
    sweep = T.threshold_sweep(df, "s", "y", F.lit(0.4)).toPandas().sort_values("percent")
    part = pdf.dropna(subset=["s"])
    cuts = np.percentile(part.s, np.arange(0, 101, 2))
    assert np.allclose(sweep.threshold, cuts)
    assert list(sweep.flagged) == [(part.s >= t).sum() for t in sweep.threshold]
    right = (part.y == 0).sum()
    want = [(right + ((part.s >= t) & (part.y == 1)).sum() * 0.4) / len(part) for t in sweep.threshold]
    assert np.allclose(sweep.accuracy_optimistic, want)
    best = T.best_f1_threshold(df, "s", "y").first()
    tried = []
    for t in np.percentile(part.s, np.arange(5, 96)):
        flag = part.s >= t
        tp = (flag & (part.y == 1)).sum()
        tried.append((2 * tp / (flag.sum() + (part.y == 1).sum()), t))
    top = max(f for f, _ in tried)
    assert math.isclose(best["f1"], top)
    assert math.isclose(best["threshold"], min(t for f, t in tried if f == top))


def test_best_f1_without_errors_is_null(spark):
    df = spark.createDataFrame([(float(i), 0) for i in range(10)], "s double, y int")
    assert T.best_f1_threshold(df, "s", "y").first()["threshold"] is None


def test_decile_duplicates_and_constant(spark):
    rows = [1, 1, 1, 1, 1, 1, 2, 3, 4, 5]
    df = spark.createDataFrame([(float(x), 0) for x in rows], "s double, y int")
    got = [(r["bin"], r["n"]) for r in T.decile_error(df, "s", "y").orderBy("bin").collect()]
    assert got == [(0, 6), (1, 1), (2, 1), (3, 1), (4, 1)]
    flat = spark.createDataFrame([(2.0, 0)] * 5, "s double, y int")
    assert T.decile_error(flat, "s", "y").count() == 0


def test_deciles_match_qcut(df, pdf):
    part = pdf.dropna(subset=["s"]).copy()
    part["b"] = pd.qcut(part.s, 10, labels=False, duplicates="drop")
    want = part.groupby("b").agg(n=("s", "size"), m=("s", "mean"), e=("y", "mean"))
    got = T.decile_error(df, "s", "y").toPandas().sort_values("bin")
    assert list(got.n) == list(want.n)
    assert np.allclose(got.mean_score, want.m) and np.allclose(got.error_rate, want.e)


# ---------------------------------------------------------------- calibration


def test_ece_edges(spark):
    df = spark.createDataFrame([(0.3, 1), (0.6, 1), (0.7, 0), (1.0, 1)], "p double, y int")
    edges = np.linspace(0, 1, 11)
    bins = {p: int((edges[1:-1] <= p).sum()) for p in (0.3, 0.6, 0.7)}
    assert bins == {0.3: 2, 0.6: 5, 0.7: 6}
    closed, opened = K.ece_weighted(df, "p", "y").first(), K.ece_weighted_open(df, "p", "y").first()
    assert math.isclose(closed["ece"], (0.7 + 0.4 + 0.7 + 0.0) / 4)
    assert closed["n"] == opened["n"] == 4


def test_open_ece_drops_certain_rows(spark):
    df = spark.createDataFrame([(1.0, 0), (0.5, 1)], "p double, y int")
    assert math.isclose(K.ece_weighted(df, "p", "y").first()["ece"], (1.0 + 0.5) / 2)
    assert math.isclose(K.ece_weighted_open(df, "p", "y").first()["ece"], 0.5 / 2)


def test_reliability_edge_goes_down(spark):
    df = spark.createDataFrame([(0.5, 1), (0.51, 0), (0.0, 0), (1.0, 1)], "p double, y int")
    got = {r["bin"]: r["n"] for r in K.reliability_uniform(df, "p", "y").collect()}
    assert got == {0: 1, 4: 1, 5: 1, 9: 1}


def test_confidence_bucket_ends(spark):
    df = spark.createDataFrame([(c, 1) for c in (0, 25, 90, 100, None)], "c int, y int")
    got = {r["bucket"]: r["n"] for r in K.confidence_buckets(df, "c", "y").collect()}
    assert got == {"0-25": 1, "25-50": 1, "90-100": 2}


# ---------------------------------------------------------------- plans


def test_no_row_level_single_partition(spark):
    """Only per-bucket totals may meet in one task."""
    df = spark.range(1000).select(F.col("id").alias("row_id"), F.rand(1).alias("s"), (F.col("id") % 2).alias("y"))
    plan = R.roc_auc(df, "s", "y")._jdf.queryExecution().executedPlan().toString()
    for chunk in plan.split("Exchange SinglePartition")[1:]:
        below = chunk[:1500]
        assert "HashAggregate" in below or "TakeOrdered" in below
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_small_side_is_broadcast_and_large_is_not(spark, monkeypatch):
    from hedgewise import session

    big = spark.range(1000).withColumn("k", F.col("id") % 10)
    small = spark.range(10).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    hinted = session.join_small(big, small, ["k"])
    assert "broadcast" in hinted._jdf.queryExecution().logical().toString().lower()
    monkeypatch.setattr(session, "BROADCAST_LIMIT_BYTES", 10)
    plain = session.join_small(big, small, ["k"])
    assert "broadcast" not in plain._jdf.queryExecution().logical().toString().lower()
    assert hinted.orderBy("id").collect() == plain.orderBy("id").collect()


def test_a_small_side_is_worked_out_once(spark, tmp_path):
    """Not for its size and again for the join, nor for each join that it is a part of."""
    import time

    from hedgewise import session

    def marked(batches):
        for batch in batches:
            if batch.num_rows:
                (tmp_path / f"{time.time_ns()}").touch()
            yield batch

    big = spark.range(1000).withColumn("k", F.col("id") % 10)
    few = spark.range(10).coalesce(1).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v")).mapInArrow(marked, "k bigint, v bigint")
    small = session.join_small(spark.range(10).withColumnRenamed("id", "k"), few, ["k"])
    assert session.join_small(big, small, ["k"]).agg(F.sum("v")).first()[0] == 9000
    assert len(list(tmp_path.iterdir())) == 1


def test_weighted_correlation_without_spread_is_null(spark):
    flat = spark.createDataFrame([(1.0, 1.0, 2), (1.0, 3.0, 1), (1.0, 5.0, 4)], "x double, y double, w long")
    got = R.weighted_correlation(flat, "x", "y", "w").first()
    assert got["n"] == 7 and got["rho"] is None and got["p_value"] is None
