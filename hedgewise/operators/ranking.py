"""Ranking quality of a score against a 0/1 target, per group."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from hedgewise.functions.common import missing_if_nan
from hedgewise.operators.ranks import percentile_table, running_totals
from hedgewise.session import join_small, materialise


def unpivot_signals(df: DataFrame, ids: list[str], signals: list[str]) -> DataFrame:
    """Long form: one row per input row and signal, columns ``signal`` and ``score``."""
    wide = df.select(*ids, *[F.col(s).cast("double").alias(s) for s in signals])
    return wide.unpivot(ids, signals, "signal", "score")


def _class_totals(df: DataFrame, keys: list[str], score: str, target: str, descending: bool) -> DataFrame:
    pos = F.col(target).cast("bigint")
    return running_totals(df, keys, score, {"pos": pos, "neg": 1 - pos}, descending=descending)


def _ranking(df: DataFrame, keys: list[str], score: str, target: str) -> DataFrame:
    """AUC and AP per key from one descending pass."""
    t = _class_totals(df, keys, score, target, descending=True)
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    cum_pos, cum_neg = F.col("cum_pos").cast("double"), F.col("cum_neg").cast("double")
    # Pairs won against negatives ranked above are lost; ties count half.
    lost = pos * (cum_neg - neg) + pos * neg * 0.5
    step = pos * cum_pos / (cum_pos + cum_neg)
    n_pos, n_neg = F.sum(pos), F.sum(neg)
    both = (n_pos > 0) & (n_neg > 0)
    return t.groupBy(*keys).agg(
        F.sum(F.col("pos") + F.col("neg")).alias("n"),
        F.sum("pos").alias("n_pos"),
        F.when(both, 1.0 - F.try_divide(F.sum(lost), n_pos * n_neg)).alias("auc"),
        F.try_divide(F.sum(step), n_pos).alias("average_precision"),
    )


def roc_auc(df: DataFrame, score: str, target: str, keys: list[str] | None = None) -> DataFrame:
    """Area under the ROC curve; null where one class is absent."""
    return _ranking(df, keys or [], score, target).drop("average_precision")


def average_precision(df: DataFrame, score: str, target: str, keys: list[str] | None = None) -> DataFrame:
    """Step-wise average precision; null without positives."""
    return _ranking(df, keys or [], score, target).drop("auc")


def ranking_summary(df: DataFrame, score: str, target: str, keys: list[str] | None = None) -> DataFrame:
    return _ranking(df, keys or [], score, target)


def roc_curve(df: DataFrame, score: str, target: str, keys: list[str] | None = None) -> DataFrame:
    """fpr and tpr at every distinct threshold, plus the (0, 0) start whose threshold is null."""
    keys = keys or []
    t = _class_totals(df, keys, score, target, True)
    points = t.select(
        *keys,
        F.col(score).cast("double").alias("threshold"),
        F.try_divide(F.col("cum_neg"), F.col("all_neg")).alias("fpr"),
        F.try_divide(F.col("cum_pos"), F.col("all_pos")).alias("tpr"),
    )
    zero = F.lit(0.0)
    start = df.filter(F.col(score).isNotNull()).select(*keys, F.lit(0).alias("_one")).groupBy(*keys).agg(
        F.lit(None).cast("double").alias("threshold"), zero.alias("fpr"), zero.alias("tpr")
    )
    return points.unionByName(start)


def pr_curve(df: DataFrame, score: str, target: str, keys: list[str] | None = None) -> DataFrame:
    """precision and recall at every distinct threshold, plus the final (1, 0) point."""
    keys = keys or []
    t = _class_totals(df, keys, score, target, True)
    points = t.select(
        *keys,
        F.col(score).cast("double").alias("threshold"),
        F.try_divide(F.col("cum_pos"), F.col("cum_pos") + F.col("cum_neg")).alias("precision"),
        F.try_divide(F.col("cum_pos"), F.col("all_pos")).alias("recall"),
    )
    end = df.filter(F.col(score).isNotNull()).groupBy(*keys).agg(
        F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall")
    )
    return points.unionByName(end)


def signal_ranking(df: DataFrame, signals: list[str], target: str, keys: list[str] | None = None) -> DataFrame:
    """AUC and AP of several signals at once, one row per (keys, signal)."""
    keys = keys or []
    long = unpivot_signals(df, keys + [target], signals)
    return ranking_summary(long, "score", target, keys + ["signal"])


def auc_matrix(df: DataFrame, signals: list[str], target: str, row_key: str = "source") -> DataFrame:
    """AUC per group (rows) and signal (columns); groups with one class stay null."""
    ranked = signal_ranking(df, signals, target, [row_key])
    return ranked.groupBy(row_key).agg(*[F.max(F.when(F.col("signal") == s, F.col("auc"))).alias(s) for s in signals])


def confidence_signal(confidence: Column, missing: int | None = 50) -> Column:
    """1 - confidence/100 as an error score; missing confidences count as ``missing`` or drop out."""
    value = confidence if missing is None else F.coalesce(confidence, F.lit(missing))
    return 1.0 - value.cast("double") / 100.0


def signal_table(
    direct: DataFrame, confidences: DataFrame, keys: list[str] | None = None, missing: int | None = 50
) -> DataFrame:
    """AUC and AP of the logit signals and of self-reported confidence for predicting errors."""
    keys = keys or []
    rows = direct.join(confidences.select(*keys, "row_id", "self_confidence"), keys + ["row_id"], "left")
    scored = rows.select(
        *keys,
        (1 - F.col("correct_by_probs")).alias("error"),
        F.col("entropy_over_labels").alias("entropy_labels"),
        F.col("entropy_over_vocab").alias("entropy_vocab"),
        (1.0 - F.col("margin")).alias("one_minus_margin"),
        (1.0 - F.col("top1_prob")).alias("one_minus_top1"),
        confidence_signal(F.col("self_confidence"), missing).alias("one_minus_self_confidence"),
    )
    signals = ["entropy_labels", "entropy_vocab", "one_minus_margin", "one_minus_top1", "one_minus_self_confidence"]
    return signal_ranking(scored, signals, "error", keys)


def signal_advantage(table: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Best logit AUC minus the AUC of self-reported confidence."""
    own = F.col("signal") == "one_minus_self_confidence"
    best, self_auc = F.max(F.when(~own, F.col("auc"))), F.max(F.when(own, F.col("auc")))
    return table.groupBy(*(keys or [])).agg(
        best.alias("best_logit_auc"), self_auc.alias("self_confidence_auc"), (best - self_auc).alias("advantage")
    )


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rank correlation with average ranks over the rows where both are present; null below two rows or without spread.

    Equal pairs are collapsed and written once; ranks and their correlation are worked out on those. The mean rank is
    (n + 1) / 2. The p-value is that of Student's t with n - 2 degrees of freedom, null below three rows.
    """
    known = lambda c: missing_if_nan(F.col(c))
    both = df.select(known(x).alias("x"), known(y).alias("y")).filter("x IS NOT NULL AND y IS NOT NULL")
    pairs = materialise(both.groupBy("x", "y").agg(F.count(F.lit(1)).alias("w")), "pairs")
    one = {"n": F.col("w")}
    average = F.col("cum_n") - (F.col("n") - 1) / 2.0
    rank_x = running_totals(pairs, [], "x", one).select("x", average.alias("rank_x"), "all_n")
    rank_y = running_totals(pairs, [], "y", one).select("y", average.alias("rank_y"))
    # Few distinct values can each hold many rows; their ranks are then few and broadcast.
    ranked = join_small(join_small(pairs, rank_x, ["x"], "inner"), rank_y, ["y"], "inner")
    mean = (F.col("all_n") + 1) / 2.0
    d = ranked.select("w", (F.col("rank_x") - mean).alias("dx"), (F.col("rank_y") - mean).alias("dy"))
    return _correlation(d)


def _correlation(d: DataFrame) -> DataFrame:
    """n, rho and p_value of the distances dx, dy from the means, each row standing for ``w``."""
    sum_of = lambda a, b: F.sum(F.col("w") * F.col(a) * F.col(b))
    rho = F.try_divide(sum_of("dx", "dy"), F.sqrt(sum_of("dx", "dx")) * F.sqrt(sum_of("dy", "dy")))
    # least and greatest skip nulls: clamp only a rho that exists, or no spread would read as 1.
    clamped = F.when(rho.isNotNull(), F.greatest(F.least(rho, F.lit(1.0)), F.lit(-1.0)))
    out = d.agg(F.coalesce(F.sum("w"), F.lit(0)).alias("n"), clamped.alias("rho"))
    freedom = F.col("n") - 2.0
    rest = 1.0 - F.col("rho") * F.col("rho")
    p = F.when(F.col("rho").isNull() | (F.col("n") < 3), F.lit(None).cast("double")).otherwise(t_two_sided(rest, freedom))
    return out.withColumn("p_value", p)


def weighted_correlation(df: DataFrame, x: str, y: str, w: str) -> DataFrame:
    """Pearson correlation of rows standing for ``w`` copies each: n, rho and the p-value of Student's t."""
    n = F.sum(w).cast("double")
    wx, wy = F.sum(F.col(w) * F.col(x)), F.sum(F.col(w) * F.col(y))
    means = df.agg(F.struct((wx / n).alias("mx"), (wy / n).alias("my")).alias("m")).scalar()
    d = df.withColumn("_m", means).select(F.col(w).alias("w"), (F.col(x) - F.col("_m.mx")).alias("dx"), (F.col(y) - F.col("_m.my")).alias("dy"))
    return _correlation(d)


def log_gamma(z: Column) -> Column:
    """ln Gamma(z) for z > 0: Stirling's series at z + 8, carried back by the recurrence."""
    up = z + 8.0
    # B(2k) / (2k (2k - 1)) for k = 1 to 5.
    series = sum((F.lit(c) / F.pow(up, F.lit(2.0 * i + 1)) for i, c in enumerate((1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188))), F.lit(0.0))
    back = sum((F.log(z + float(i)) for i in range(8)), F.lit(0.0))
    return (up - 0.5) * F.log(up) - up + 0.5 * F.log(F.lit(2 * math.pi)) + series - back


def incomplete_beta(x: Column, a: Column, b: Column, terms: int = 300) -> Column:
    """The regularised incomplete beta function by its continued fraction, for x below (a + 1) / (a + b + 2)."""
    tiny = 1e-300
    safe = lambda v: F.when(F.abs(v) < tiny, F.lit(tiny)).otherwise(v)
    start = 1.0 / safe(1.0 - (a + b) * x / (a + 1.0))
    state = F.struct(F.lit(1.0).alias("c"), start.alias("d"), start.alias("h"))

    def step(s: Column, k: Column) -> Column:
        m = F.floor(k / 2).cast("double")
        even = m * (b - m) * x / ((a + 2 * m - 1.0) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1.0))
        term = F.when(k % 2 == 0, even).otherwise(odd)
        d, c = 1.0 / safe(1.0 + term * s["d"]), safe(1.0 + term / s["c"])
        return F.struct(c.alias("c"), d.alias("d"), (s["h"] * d * c).alias("h"))

    fraction = F.aggregate(F.sequence(F.lit(2), F.lit(terms)), state, step)["h"]
    front = F.exp(a * F.log(x) + b * F.log(1.0 - x) + log_gamma(a + b) - log_gamma(a) - log_gamma(b))
    return front * fraction / a


def t_two_sided(rest: Column, freedom: Column) -> Column:
    """P(|T| > t) where ``rest`` = freedom / (freedom + t^2), which is 1 - rho^2 of a correlation."""
    a, half = freedom / 2.0, F.lit(0.5)
    low = rest < (a + 1.0) / (a + 2.5)
    whole = F.when(low, incomplete_beta(rest, a, half)).otherwise(1.0 - incomplete_beta(1.0 - rest, half, a))
    return F.when(rest <= 0, F.lit(0.0)).when(rest >= 1, F.lit(1.0)).otherwise(whole)


def pearson(df: DataFrame, x: str, y: str, keys: list[str] | None = None) -> DataFrame:
    """Linear correlation over rows where both are present."""
    known = lambda c: missing_if_nan(F.col(c))
    both = df.select(*(keys or []), known(x).alias("_x"), known(y).alias("_y")).filter("_x IS NOT NULL AND _y IS NOT NULL")
    return both.groupBy(*(keys or [])).agg(F.count(F.lit(1)).alias("n"), F.corr("_x", "_y").alias("pearson_r"))


def binary_scores(df: DataFrame, pred: str, target: str, keys: list[str] | None = None) -> DataFrame:
    """Precision, recall and F1 of class 1 and the macro F1; divisions by zero give 0."""
    p, t = F.col(pred).cast("int"), F.col(target).cast("int")
    counts = df.groupBy(*(keys or [])).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if((p == 1) & (t == 1)).alias("tp"),
        F.count_if((p == 1) & (t == 0)).alias("fp"),
        F.count_if((p == 0) & (t == 1)).alias("fn"),
        F.count_if((p == 0) & (t == 0)).alias("tn"),
    )
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    f1_pos, f1_neg = ratio(2 * tp, 2 * tp + fp + fn), ratio(2 * tn, 2 * tn + fp + fn)
    return counts.withColumns(
        {
            "precision": ratio(tp, tp + fp),
            "recall": ratio(tp, tp + fn),
            "f1": f1_pos,
            "f1_macro": (f1_pos + f1_neg) / 2.0,
            "accuracy": ratio(tp + tn, F.col("n")),
        }
    )


def accuracy_rollup(df: DataFrame, greedy: str, argmax: str, group: str = "source") -> DataFrame:
    """Accuracy of the greedy and the argmax reading, per group and overall (group null)."""
    return df.rollup(group).agg(
        F.count(F.lit(1)).alias("n"), F.avg(greedy).alias("accuracy_greedy"), F.avg(argmax).alias("accuracy_argmax")
    )


def means_by_correctness(df: DataFrame, correct: str, signals: list[str], keys: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(keys or []), correct).agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(missing_if_nan(F.col(s))).alias(f"mean_{s}") for s in signals]
    )


def signal_histogram(df: DataFrame, signal: str, by: str, bins: int = 40) -> DataFrame:
    """Counts in equal-width bins between the overall minimum and maximum; the maximum is in the last bin."""
    rows = df.select(missing_if_nan(F.col(signal)).alias("x"), by).filter("x IS NOT NULL")
    span = rows.agg(F.struct(F.min("x").alias("lo"), F.max("x").alias("hi")).alias("s")).scalar()
    width = (F.col("_s.hi") - F.col("_s.lo")) / float(bins)
    spot = F.coalesce(F.floor(F.try_divide(F.col("x") - F.col("_s.lo"), width)), F.lit(0))
    binned = rows.withColumn("_s", span).select(
        by,
        F.least(spot, F.lit(bins - 1)).cast("int").alias("bin"),
        F.col("_s.lo").alias("lo"),
        width.alias("width"),
    )
    return binned.groupBy(by, "bin").agg(
        F.max(F.col("lo") + F.col("bin") * F.col("width")).alias("bin_start"), F.count(F.lit(1)).alias("n")
    )


def box_summary(df: DataFrame, value: str, by: str) -> DataFrame:
    """Five-number summary per group, exact and without holding a group in one task."""
    names = {"minimum": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "maximum": 1.0}
    return percentile_table(df, [by], value, names)
