"""Ranking, threshold and policy operators on many more rows, with one source holding a third of them.

The given vectors' signals are repeated SCALE_COPIES times with a perturbed score (default: about
10 million rows) and written once to the shared folder. Prints one JSON line with seconds per
operator and, for the running totals, the share of rows in the fullest task.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import functions as F

from hedgewise.operators import calibration, curation, ranking, thresholds
from hedgewise.operators.ranks import running_totals
from hedgewise.plans import inputs
from hedgewise.session import local_session, materialise


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    copies = int(os.environ.get("SCALE_COPIES", "1250"))
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench_scale", shuffle_partitions=64)
    spark.sparkContext.setLogLevel("ERROR")
    copy = F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))
    rows = materialise(inputs.signals(spark, sf_dir).repartition(32).withColumn("copy", copy), "signals")
    draw = F.xxhash64("model", "row_id", "copy")
    score = F.col("entropy_over_labels") + F.pmod(draw, F.lit(1000003)) / 1.0e7
    wide = rows.select(
        (F.col("row_id") * copies + F.col("copy")).alias("row_id"),
        F.when(F.pmod(draw, F.lit(3)) == 0, F.lit("hot")).otherwise(F.col("source")).alias("source"),
        score.alias("score"),
        F.col("one_minus_top1").alias("p"),
        "error",
    )
    work = {
        "roc_auc": lambda: ranking.roc_auc(wide, "score", "error", ["source"]),
        "roc_auc_overall": lambda: ranking.roc_auc(wide, "score", "error"),
        "best_f1_threshold": lambda: thresholds.best_f1_threshold(wide, "score", "error", ["source"]),
        "decile_error": lambda: thresholds.decile_error(wide, "score", "error", ["source"]),
        "reliability_quantile": lambda: calibration.reliability_quantile(wide, "p", "error"),
        "sample_n_per_source": lambda: curation.sample_n_per_source(wide.select("row_id", "source"), 500),
        "stratified_holdout": lambda: curation.stratified_holdout(wide.select("row_id", "error"), "error"),
    }
    times = {}
    for name, make in work.items():
        start = time.perf_counter()
        make().write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 2)
        print(name, times[name], file=sys.stderr, flush=True)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    totals = running_totals(wide, ["source"], "score", {"n": F.lit(1)})
    sizes = totals.groupBy(F.spark_partition_id().alias("task")).agg(F.count(F.lit(1)).alias("n"))
    share = sizes.agg((F.max("n") / F.sum("n")).alias("share")).first()["share"]
    print(json.dumps({"rows": wide.count(), "seconds": times, "fullest_task_share": round(share, 4)}))
    spark.stop()


if __name__ == "__main__":
    main()
