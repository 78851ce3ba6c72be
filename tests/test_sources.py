import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from hedgewise.operators import curation as C
from hedgewise.session import scratch_path
from hedgewise.sources import readers as R
from hedgewise.sources import writers as W
from hedgewise.streaming import route as S


def csv(spark, rows, header="question,choice_labels,choice_texts,gold_label,split"):
    path = scratch_path(spark, "t") + ".csv"
    spark.createDataFrame([(header,), *[(r,) for r in rows]], "value string").coalesce(1).write.text(path)
    return path


GOOD = """"a, ""quoted"" q","['A', 'B']","['x', 'it\\'s']",b,Train"""
BAD = """q2,"['A', 'B']",not a list,A,Train"""
UNEQUAL = """q3,"['A', 'B']","['x']",A,Train"""
GOLD = """q4,"['A', 'B']","['x', 'y']",Z,Train"""


def test_scan_mcq_csv(spark):
    row = R.scan_mcq_csv(spark, csv(spark, [GOOD]), split=" TRAIN ").first()
    assert row["question"] == 'a, "quoted" q' and row["choice_texts"] == ["x", "it's"] and row["gold_label"] == "B"


@pytest.mark.parametrize("bad", [BAD, UNEQUAL, GOLD])
def test_strict_scan_fails_and_loose_scan_drops(spark, bad):
    path = csv(spark, [GOOD, bad])
    with pytest.raises(PySparkException, match="invalid row"):
        R.scan_mcq_csv(spark, path).collect()
    assert R.scan_mcq_csv(spark, path, strict=False).count() == 1
    reasons = R.scan_mcq_csv(spark, path, strict=None).filter("reject_reason is not null")
    assert reasons.count() == 1


def test_missing_columns(spark):
    with pytest.raises(ValueError, match="choice_texts"):
        R.scan_mcq_csv(spark, csv(spark, ["q,x,A"], "question,choice_labels,gold_label"))


def test_select_split(spark):
    df = spark.createDataFrame([(1, " Train"), (2, "test ")], "row_id int, split string")
    assert [r[0] for r in C.select_split(df, "TEST").select("row_id").collect()] == [2]
    with pytest.raises(ValueError, match="several splits"):
        C.select_split(df)
    with pytest.raises(ValueError, match="present"):
        C.select_split(df, "dev")
    assert C.select_split(df.filter("row_id = 1")).count() == 1
    with pytest.raises(ValueError, match="no 'split' column"):
        C.select_split(df.drop("split"), "train")


def test_jsonl_ignores_broken_lines(spark):
    path = scratch_path(spark, "jsonl")
    lines = ['{"row_id": 1, "v": 0.5}', '{"row_id": 2, "v"', "", "oops", '{"row_id": 3}']
    spark.createDataFrame([(x,) for x in lines], "value string").write.text(path)
    df = R.scan_jsonl_tolerant(spark, path, StructType.fromDDL("row_id int, v double"))
    assert sorted((r["row_id"], r["v"]) for r in df.collect()) == [(1, 0.5), (3, None)]
    assert df.count() == 2


def test_coerce_numeric(spark):
    df = spark.createDataFrame([("1.5",), ("x",), ("NaN",), (None,)], "a string")
    assert [r[0] for r in R.coerce_numeric(df, ["a"]).collect()] == [1.5, None, None, None]


def test_partitions_are_replaced_one_by_one(spark):
    path = scratch_path(spark, "sink")
    rows = [(1, "m/1", "train"), (2, "m/1", "test"), (3, "m2", "test")]
    df = spark.createDataFrame(rows, "row_id int, model_name string, split string")
    W.sink_by_model_split(df, path)
    W.sink_by_model_split(spark.createDataFrame([(9, "m/1", "test")], df.schema), path)
    got = sorted((r["row_id"], r["model_name"], r["split"]) for r in spark.read.parquet(path).collect())
    assert got == [(1, "m_1", "train"), (3, "m2", "test"), (9, "m_1", "test")]
    with pytest.raises(PySparkException, match="model name is empty"):
        W.sink_by_model_split(spark.createDataFrame([(9, "  ", "test")], df.schema), path)
    with pytest.raises(ValueError):
        W.safe_model_name(" ")


def test_resume(spark):
    todo = spark.range(5).withColumnRenamed("id", "row_id")
    done = spark.createDataFrame([(1,), (1,), (4,)], "row_id long")
    assert sorted(r[0] for r in W.resume_incremental(todo, done).collect()) == [0, 2, 3]
    assert W.resume_incremental(todo, None).count() == 5


THRESHOLDS = {"entropy_p25": 0.2, "entropy_p50": 0.5, "entropy_p75": 0.8, "margin_p25": 0.2, "margin_p50": 0.5, "margin_p75": 0.8}
SCHEMA = StructType().add("row_id", "long").add("entropy", "double").add("margin", "double")


def test_stream_continues_and_never_repeats(spark):
    folder, sink = scratch_path(spark, "arriving"), scratch_path(spark, "routed")

    def arrive(rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)

    def run():
        S.stream_route(
            S.read_records(spark, folder, SCHEMA, files=1), sink, sink + "-cp", THRESHOLDS,
            F.col("entropy"), F.col("margin"), S.finished_rows(spark, sink, "row_id long"),
        ).awaitTermination()
        return {r["row_id"]: r["regime"] for r in S.read_routed(spark, sink).collect()}

    arrive([(1, 0.1, 0.9), (2, 0.9, 0.1)])
    arrive([(3, 0.6, 0.4), (3, 0.6, 0.4)])
    assert run() == {1: "high", 2: "low", 3: "medium"}
    assert run() == {1: "high", 2: "low", 3: "medium"}
    arrive([(1, 0.9, 0.1), (4, 0.1, 0.9)])  # row 1 comes again, differently: the first decision stands
    assert run() == {1: "high", 2: "low", 3: "medium", 4: "high"}
    written = spark.read.parquet(sink)
    assert written.filter("row_id = 1").count() == 1


def test_stream_equals_batch(spark):
    rows = spark.range(200).select(
        F.col("id").alias("row_id"), ((F.col("id") * 7) % 10 / 10.0).alias("entropy"), ((F.col("id") * 3) % 10 / 10.0).alias("margin")
    )
    folder, sink = scratch_path(spark, "a"), scratch_path(spark, "b")
    rows.repartition(4).write.parquet(folder)
    S.stream_route(
        S.read_records(spark, folder, rows.schema), sink, sink + "-cp", THRESHOLDS, F.col("entropy"), F.col("margin")
    ).awaitTermination()
    batch = S.routed_rows(rows, THRESHOLDS, F.col("entropy"), F.col("margin"))
    got = S.read_routed(spark, sink).select(*sorted(batch.columns)).orderBy("row_id").collect()
    assert got == batch.select(*sorted(batch.columns)).orderBy("row_id").collect()
