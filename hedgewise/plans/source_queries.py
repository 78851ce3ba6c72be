"""Readers and writers, each fed from and checked against the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from hedgewise.operators.curation import select_split as pick_split
from hedgewise.operators.policies import regime_thresholds
from hedgewise.plans import inputs
from hedgewise.plans.catalog import VIEWS, query
from hedgewise.session import scratch_path
from hedgewise.sources import readers as R
from hedgewise.sources import writers as W
from hedgewise.streaming import route as S

VIEWS["fx_csv"] = """
SELECT row_id, question, kind, CASE WHEN kind = 'PROMO' THEN 'A, B' ELSE '[]' END AS raw_labels, answer, choices,
  CASE WHEN kind = 'PROMO' THEN 'choice_labels is not a list' WHEN kind = 'STANDARD' THEN 'lists differ in length'
       WHEN answer = 4 THEN 'gold_label does not fit the labels' END AS reject_reason FROM fx_parts"""


def _mcq_csv(spark, sf) -> str:
    """Questions as a CSV with list literals; some kinds of parts are written in a broken way."""
    quoted = F.concat(F.lit("["), F.array_join(F.transform("choices", lambda c: F.concat(F.lit("'"), c, F.lit("'"))), ", "), F.lit("]"))
    labels = (
        F.when(F.col("kind") == "PROMO", F.lit("A, B"))
        .when(F.col("kind") == "STANDARD", F.lit("['A', 'B', 'C']"))
        .otherwise(F.lit("['A', 'B', 'C', 'D']"))
    )
    path = scratch_path(spark, "mcq-csv")
    inputs.parts(spark, sf).select(
        "row_id",
        F.concat(F.lit(" "), "question", F.lit(" ")).alias("question"),
        labels.alias("choice_labels"),
        quoted.alias("choice_texts"),
        F.lower(F.char(F.col("answer") + 65)).alias("gold_label"),
        F.concat(F.lit(" "), F.upper("kind")).alias("split"),
    ).write.csv(path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return path


_KEPT = "'ECONOMY'"


@query(
    "scan_mcq_csv",
    "row_id:i question:s n_choices:i gold_label:s",
    f"""SELECT row_id, question, 4 AS n_choices, chr(65 + answer) AS gold_label FROM fx_csv
WHERE kind = {_KEPT} AND reject_reason IS NULL""",
)
def scan_mcq_csv(spark, sf):
    rows = R.scan_mcq_csv(spark, _mcq_csv(spark, sf), split="economy", strict=False)
    return rows.withColumn("n_choices", F.size("choice_texts"))


@query("scan_mcq_csv_rejects", "row_id:i reject_reason:s", "SELECT row_id, reject_reason FROM fx_csv")
def scan_mcq_csv_rejects(spark, sf):
    raw = spark.read.csv(_mcq_csv(spark, sf), header=True, multiLine=True, escape='"')
    return R.validate_mcq(raw)


@query("select_split", "row_id:i split:s", "SELECT doc_id AS row_id, lang AS split FROM documents WHERE lang = 'en'")
def select_split(spark, sf):
    docs = inputs.all_questions(spark, sf).select("row_id", F.concat(F.lit(" "), F.upper("lang"), F.lit("\n")).alias("split"))
    return pick_split(docs, "EN ")


@query(
    "scan_json_dataset",
    "source:s n:i",
    "SELECT source, count(*) AS n FROM documents GROUP BY source",
)
def scan_json_dataset(spark, sf):
    rows = inputs.all_questions(spark, sf)
    chunk = F.floor(F.col("row_id") / 1000).alias("chunk")
    arrays = rows.groupBy(chunk).agg(F.to_json(F.collect_list(F.struct("row_id", "source", "question"))).alias("value"))
    path = scratch_path(spark, "json-arrays")
    arrays.write.partitionBy("chunk").text(path)
    return R.rows_per_source(R.scan_json_dataset(spark, path, "row_id bigint, source string, question string"))


@query(
    "scan_jsonl_tolerant",
    "row_id:i source:s value:d",
    "SELECT row_id, source, value FROM fx_replies WHERE source <> 'error'",
)
def scan_jsonl_tolerant(spark, sf):
    rows = inputs.replies(spark, sf).select("row_id", "source", "value")
    line = F.to_json(F.struct("row_id", "source", "value"))
    broken = F.when(F.col("source") == "error", F.substring_index(line, ",", 1)).otherwise(line)
    path = scratch_path(spark, "jsonl")
    rows.select(broken.alias("value")).write.text(path)
    return R.scan_jsonl_tolerant(spark, path, rows.schema)


@query("coerce_numeric", "row_id:i brand:d size:d", "SELECT row_id, NULL AS brand, size::DOUBLE AS size FROM fx_parts")
def coerce_numeric(spark, sf):
    return R.coerce_numeric(inputs.parts(spark, sf).select("row_id", "brand", "size"), ["brand", "size"])


_SPLIT = "CASE WHEN source IN ('S0', 'S1') THEN 'test' ELSE 'train' END"


@query(
    "sink_by_model_split",
    "model_name:s split:s n:i right_answers:i",
    f"SELECT 'family_m' || model AS model_name, {_SPLIT} AS split, count(*) AS n, sum(correct_by_probs) AS right_answers FROM fx_direct GROUP BY ALL",
)
def sink_by_model_split(spark, sf):
    split = F.when(F.col("source").isin("S0", "S1"), "test").otherwise("train")
    rows = inputs.direct(spark, sf).withColumns(
        {"model_name": F.concat(F.lit(" family/m"), F.col("model")), "split": split}
    )
    path = scratch_path(spark, "by-model")
    W.sink_by_model_split(rows, path)
    W.sink_by_model_split(rows.filter("split = 'test'"), path)  # replaces the test folders only
    back = spark.read.parquet(path)
    return back.groupBy("model_name", "split").agg(
        F.count(F.lit(1)).alias("n"), F.sum("correct_by_probs").alias("right_answers")
    )


@query(
    "sink_csv_flat",
    "row_id:i question:s choices:s",
    """SELECT row_id, question, '["' || array_to_string(choices, '","') || '"]' AS choices FROM fx_parts""",
)
def sink_csv_flat(spark, sf):
    path = scratch_path(spark, "csv-flat")
    W.sink_csv_flat(inputs.parts(spark, sf).select("row_id", "question", "choices"), path)
    return spark.read.csv(path, header=True, escape='"', schema="row_id bigint, question string, choices string")


@query(
    "sink_jsonl",
    "row_id:i self_confidence:i n:i",
    "SELECT row_id, self_confidence, count(*) AS n FROM fx_confidences GROUP BY ALL",
)
def sink_jsonl(spark, sf):
    rows = inputs.confidences(spark, sf).select("row_id", "self_confidence", "source")
    path = scratch_path(spark, "sink-jsonl")
    W.sink_jsonl(rows.filter("source = 'click'"), path)
    W.sink_jsonl(rows.filter("source <> 'click'"), path)
    back = spark.read.json(path, schema="row_id bigint, self_confidence int")
    return back.groupBy("row_id", "self_confidence").agg(F.count(F.lit(1)).alias("n"))


@query(
    "resume_incremental",
    "row_id:i source:s",
    "SELECT row_id, source FROM fx_all_questions WHERE row_id NOT IN (SELECT doc_id FROM labels)",
)
def resume_incremental(spark, sf):
    done = inputs.table(spark, sf, "labels").select(F.col("doc_id").alias("row_id"))
    return W.resume_incremental(inputs.all_questions(spark, sf).select("row_id", "source"), done)


@query("limit_rows", "row_id:i source:s", "SELECT row_id, source FROM fx_replies ORDER BY row_id LIMIT 100")
def limit_rows(spark, sf):
    return W.limit_rows(inputs.replies(spark, sf).select("row_id", "source"), 100)


# ---------------------------------------------------------------- streaming

VIEWS["fx_stream_records"] = """
SELECT event_id AS row_id, event_type AS source, value AS entropy, regexp_extract(props, '([0-9]+)', 1)::INT / 100.0::DOUBLE AS margin FROM events"""
VIEWS["fx_stream"] = """
SELECT row_id, source, CASE WHEN entropy <= e50 AND margin >= m50 THEN 'high' WHEN entropy >= e75 OR margin <= m25 THEN 'low' ELSE 'medium' END AS regime
FROM fx_stream_records JOIN (SELECT source, quantile_cont(entropy, 0.5) AS e50, quantile_cont(entropy, 0.75) AS e75, quantile_cont(margin, 0.25) AS m25,
  quantile_cont(margin, 0.5) AS m50 FROM fx_stream_records GROUP BY source) USING (source)"""


def _records(spark, sf):
    """Event values stand for entropies, the recorded k for margins."""
    return inputs.table(spark, sf, "events").select(
        F.col("event_id").alias("row_id"),
        F.col("event_type").alias("source"),
        F.col("value").alias("entropy"),
        (F.regexp_extract("props", "([0-9]+)", 1).cast("int") / 100.0).alias("margin"),
    )


@query("stream_route", "row_id:i source:s regime:s", "SELECT * FROM fx_stream")
def stream_route(spark, sf):
    """Every record arrives twice in one batch and once more in a later run; what the sink holds is shown as it is.

    The thresholds are a stored table with a row per source.
    """
    records, stored, folder, sink = _records(spark, sf), *[scratch_path(spark, n) for n in ("thresholds", "arrived", "routed")]
    regime_thresholds(records, ["source"], "entropy", "margin").write.parquet(stored)
    for arriving in (records.unionByName(records), records):
        arriving.write.mode("append").parquet(folder)
        S.stream_route(
            S.read_records(spark, folder, records.schema),
            sink,
            sink + "-checkpoint",
            spark.read.parquet(stored),
            F.col("entropy"),
            F.col("margin"),
            on=["source"],
        ).awaitTermination()
    return spark.read.parquet(sink)
