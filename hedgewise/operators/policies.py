"""Confidence regimes, reflection policies, abstention and their metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hedgewise.operators.ranks import percentile_table
from hedgewise.session import join_small

ABSTAINED = "NOT_SURE"
# Gate x passes. A gate says which direct answers are reconsidered.
POLICIES = [
    ("direct_baseline", "never", 0),
    ("always_reflect_once", "always", 1),
    ("always_reflect_twice", "always", 2),
    ("blind_gate_once", "blind", 1),
    ("blind_gate_twice", "blind", 2),
    ("oracle_gate_once", "oracle", 1),
    ("oracle_gate_twice", "oracle", 2),
]


def regime_thresholds(
    direct: DataFrame, keys: list[str], entropy: str = "entropy_over_labels", margin: str = "margin"
) -> DataFrame:
    """25/50/75 percentiles of entropy and margin per key: one small row per key."""
    quarters = {"p25": 0.25, "p50": 0.5, "p75": 0.75}
    long = direct.select(*keys, "row_id", entropy, margin).unpivot(
        [*keys, "row_id"], [entropy, margin], "signal", "score"
    )
    table = percentile_table(long, [*keys, "signal"], "score", quarters)
    return table.groupBy(*keys).agg(
        *[
            F.max(F.when(F.col("signal") == signal, F.col(q))).alias(f"{short}_{q}")
            for short, signal in (("entropy", entropy), ("margin", margin))
            for q in quarters
        ]
    )


def regime(entropy: Column, margin: Column, prefix: str = "") -> Column:
    """high / low / medium against the threshold columns of the row; high is tested first."""
    t = lambda name: F.col(prefix + name)
    return (
        F.when((entropy <= t("entropy_p50")) & (margin >= t("margin_p50")), F.lit("high"))
        .when((entropy >= t("entropy_p75")) | (margin <= t("margin_p25")), F.lit("low"))
        .otherwise(F.lit("medium"))
    )


def assign_regime(
    rows: DataFrame,
    thresholds: DataFrame,
    keys: list[str],
    entropy: str = "entropy_over_labels",
    margin: str = "margin",
    name: str = "regime",
) -> DataFrame:
    """Add the regime of every row; thresholds have one row per key."""
    joined = join_small(rows, thresholds, keys)
    return joined.select(*rows.columns, regime(F.col(entropy), F.col(margin)).alias(name))


def policy_gate(rows: DataFrame, regime_col: str = "regime", correct: str = "correct_by_probs") -> DataFrame:
    """One row per input row and policy, with whether the policy asks again (``triggered``).

    The policies are a fixed handful, carried as a literal array and exploded in place.
    """
    grid = F.array(
        *[
            F.struct(F.lit(p).alias("policy"), F.lit(g).alias("gate"), F.lit(n).alias("max_passes"))
            for p, g, n in POLICIES
        ]
    )
    wide = rows.select(*rows.columns, F.explode(grid).alias("_p")).select(
        *rows.columns, "_p.policy", "_p.gate", "_p.max_passes"
    )
    fires = (
        F.when(F.col("gate") == "always", F.lit(True))
        .when(F.col("gate") == "blind", F.col(regime_col).isin("medium", "low"))
        .when(F.col("gate") == "oracle", F.col(correct) == 0)
        .otherwise(F.lit(False))
    )
    return wide.withColumn("triggered", fires)


def collect_passes(reflections: DataFrame, keys: list[str]) -> DataFrame:
    """Recorded passes 1 and 2 side by side, one row per key and style.

    The aggregate and the later join share one shuffle by the join key.
    """
    at = lambda p, c: F.max(F.when(F.col("reflection_pass") == p, F.col(c)))
    return reflections.groupBy(*keys, "row_id", "style").agg(
        *[
            at(p, c).alias(f"{c}_{p}")
            for p in (1, 2)
            for c in ("pred", "entropy_over_labels", "margin", "top1_prob")
        ]
    )


GRID = ["policy", "style"]
DIRECT = ["source", "gold_label", "pred_by_probs", "correct_by_probs", "regime"]


def _with_passes(direct: DataFrame, reflections: DataFrame, thresholds: DataFrame, keys: list[str]) -> DataFrame:
    """One row per (row, style): the direct answer and what each pass would say, with regimes.

    Every direct row stays, in every style that was recorded at all: re-asking is normally recorded for gated
    rows only. Without any recorded style there is one, named null. A pass that was not recorded says what the one before it said. Thresholds are attached once;
    the regimes are then plain expressions.
    """
    passes = collect_passes(reflections, keys)
    plain = ["gold_label", "pred_by_probs", "correct_by_probs", "source", "entropy_over_labels", "margin"]
    styles = [r[0] for r in reflections.select("style").distinct().collect()] or [None]  # a handful
    grid = F.explode(F.array(*[F.lit(s).cast("string") for s in styles]))
    met = direct.select(*keys, "row_id", *plain, grid.alias("style")).join(passes, [*keys, "row_id", "style"], "left")
    rows = join_small(met, thresholds, keys).withColumn("regime", regime(F.col("entropy_over_labels"), F.col("margin")))
    for p, before in ((1, ("pred_by_probs", "regime")), (2, ("label_1", "regime_1"))):
        recorded = F.col(f"pred_{p}").isNotNull()
        own = regime(F.col(f"entropy_over_labels_{p}"), F.col(f"margin_{p}"))
        rows = rows.withColumns(
            {
                f"label_{p}": F.coalesce(F.col(f"pred_{p}"), F.col(before[0])),
                f"regime_{p}": F.when(recorded, own).otherwise(F.col(before[1])),
            }
        )
    right = lambda p: F.coalesce(F.col(f"label_{p}") == F.col("gold_label"), F.lit(False)).cast("int")
    return rows.withColumns({"right_1": right(1), "right_2": right(2)})


def _run_policies(rows: DataFrame) -> DataFrame:
    """Fan out over the policies: passes run, and the right/regime (and label) of the last one."""
    gated = policy_gate(rows)
    ran_1 = F.col("triggered") & (F.col("max_passes") >= 1)
    ran_2 = ran_1 & (F.col("max_passes") >= 2) & (F.col("regime_1") != "high")
    last = lambda d, r: F.when(ran_2, F.col(f"{r}_2")).when(ran_1, F.col(f"{r}_1")).otherwise(F.col(d))
    out = {
        "passes_run": ran_1.cast("int") + ran_2.cast("int"),
        "final_regime": last("regime", "regime"),
        "final_correct": last("correct_by_probs", "right"),
    }
    if "label_1" in rows.columns:
        out["final_label"] = last("pred_by_probs", "label")
    return gated.withColumns(out)


def resolve_final(
    direct: DataFrame, reflections: DataFrame, thresholds: DataFrame, keys: list[str]
) -> DataFrame:
    """Final answer and regime of every (row, style, policy).

    Reflections are joined once per row and style, before the policies fan out, so the join
    moves neither side more than once. A second pass is skipped once the first one is high.
    """
    final = _run_policies(_with_passes(direct, reflections, thresholds, keys))
    return final.select(
        *keys,
        "row_id",
        *DIRECT,
        *GRID,
        "gate",
        "max_passes",
        "triggered",
        "passes_run",
        "final_label",
        "final_regime",
        "final_correct",
        abstain(F.col("final_label"), F.col("final_regime")).alias("output_label"),
        F.lit(1).cast("bigint").alias("rows"),
    )


def resolve_cells(
    direct: DataFrame, reflections: DataFrame, thresholds: DataFrame, keys: list[str]
) -> DataFrame:
    """The same outcomes counted: one row per combination of what the metrics look at.

    Rows are counted by regimes and right/wrong before the policies fan out, so the fan-out runs
    on a few thousand cells, however many rows there are. ``rows`` is the number in each cell.
    """
    rows = _with_passes(direct, reflections, thresholds, keys)
    cell = [*keys, "source", "style", "correct_by_probs", "regime", "regime_1", "regime_2", "right_1", "right_2"]
    return _run_policies(rows.groupBy(*cell).agg(F.count(F.lit(1)).alias("rows")))


def abstain(label: Column, final_regime: Column) -> Column:
    return F.when(final_regime == "low", F.lit(ABSTAINED)).otherwise(label)


def _metrics() -> list[Column]:
    count = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("rows"))), F.lit(0)).cast("double")
    n = F.sum("rows")
    kept = F.col("final_regime") != "low"
    right, was_right = F.col("final_correct") == 1, F.col("correct_by_probs") == 1
    rate = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return [
        n.alias("n"),
        rate(count(right), n).alias("forced_accuracy"),
        F.try_divide(count(right & kept), count(kept)).alias("selective_accuracy"),
        rate(count(kept), n).alias("coverage"),
        rate(count(~kept), n).alias("abstention_rate"),
        rate(count(F.col("triggered")), n).alias("trigger_rate"),
        rate(count(right & ~was_right), count(~was_right)).alias("correction_rate"),
        rate(count(~right & was_right), count(was_right)).alias("degradation_rate"),
    ]


def policy_metrics(final: DataFrame, keys: list[str]) -> DataFrame:
    """Accuracy, coverage and change rates per key, policy and style, from final rows or cells."""
    return final.groupBy(*keys, *GRID).agg(*_metrics())


def policy_metrics_by_source(final: DataFrame, keys: list[str]) -> DataFrame:
    """The same per source and over all sources (source null), in one pass with grouping sets."""
    dims = [*keys, *GRID]
    every = [F.col(c) for c in dims]
    return final.groupingSets([[*every, F.col("source")], every], *every, F.col("source")).agg(*_metrics())


def blind_oracle_gap(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """Forced accuracy of the oracle gate minus the blind gate, per key, style and passes."""
    gates = policy_table(metrics)
    acc = lambda g: F.max(F.when(F.col("gate") == g, F.col("forced_accuracy")))
    return (
        gates.filter(F.col("gate").isin("blind", "oracle"))
        .groupBy(*keys, "style", "max_passes")
        .agg(
            acc("blind").alias("blind_accuracy"),
            acc("oracle").alias("oracle_accuracy"),
            (acc("oracle") - acc("blind")).alias("gap"),
        )
    )


def policy_table(metrics: DataFrame) -> DataFrame:
    """Add gate and number of passes back from the policy's name."""
    name = F.col("policy")
    gate, passes = F.lit(None).cast("string"), F.lit(None).cast("int")
    for p, g, n in POLICIES:
        gate = F.when(name == p, F.lit(g)).otherwise(gate)
        passes = F.when(name == p, F.lit(n)).otherwise(passes)
    return metrics.withColumns({"gate": gate, "max_passes": passes})


def one_vs_two_pass(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """Two-pass minus one-pass, per key, style and gate."""
    shown = ["forced_accuracy", "coverage", "correction_rate", "degradation_rate"]
    rows = policy_table(metrics).filter(F.col("max_passes") > 0)
    at = lambda n, c: F.max(F.when(F.col("max_passes") == n, F.col(c)))
    return rows.groupBy(*keys, "style", "gate").agg(*[(at(2, c) - at(1, c)).alias(f"delta_{c}") for c in shown])


def regime_breakdown(final: DataFrame, keys: list[str]) -> DataFrame:
    """Trigger rate and accuracy within each regime of the direct answer."""
    share = lambda c: F.sum(F.col(c).cast("double") * F.col("rows")) / F.sum("rows")
    return final.groupBy(*keys, *GRID, "regime").agg(
        F.sum("rows").alias("n"),
        share("triggered").alias("trigger_rate"),
        share("correct_by_probs").alias("direct_accuracy"),
        share("final_correct").alias("final_accuracy"),
    )
