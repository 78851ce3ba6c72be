"""Writing results by model and split, as flat CSV, as JSON lines, and continuing earlier runs."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from hedgewise.functions.common import strip

NESTED = ("array", "map", "struct")


def safe_model_name(name: str) -> str:
    cleaned = re.sub(r"[/\\]", "_", name.strip())
    if not cleaned:
        raise ValueError("the model name is empty")
    return cleaned


def safe_model_column(name: Column) -> Column:
    cleaned = F.regexp_replace(strip(name), r"[/\\]", "_")
    return F.when(cleaned != "", cleaned).otherwise(F.raise_error(F.lit("the model name is empty")).cast("string"))


def sink_by_model_split(df: DataFrame, path: str) -> None:
    """One folder per model and split; only the folders written to are replaced.

    Rows are gathered per (model, split) and a hash of the row, so that a large split is written
    by many tasks and a small one does not become a file per task.
    """
    named = df.withColumn("model_name", safe_model_column(F.col("model_name")))
    spread = F.pmod(F.xxhash64("row_id"), F.lit(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    (
        named.repartition("model_name", "split", spread)
        .write.partitionBy("model_name", "split")
        .mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .parquet(path)
    )


def flatten_nested(df: DataFrame) -> DataFrame:
    """List, map and struct columns as JSON text."""
    cols = [F.to_json(f.name).alias(f.name) if f.dataType.typeName() in NESTED else F.col(f.name) for f in df.schema]
    return df.select(*cols)


def sink_csv_flat(df: DataFrame, path: str) -> None:
    flatten_nested(df).write.mode("overwrite").csv(path, header=True, escape='"')


def sink_jsonl(df: DataFrame, path: str) -> None:
    """Append one object per row; missing values are written out as null."""
    df.write.mode("append").option("ignoreNullFields", False).json(path)


def resume_incremental(todo: DataFrame, done: DataFrame | None, key: str = "row_id") -> DataFrame:
    """Rows that are not finished yet."""
    if done is None:
        return todo
    return todo.join(done.select(key).distinct(), key, "left_anti")


def limit_rows(df: DataFrame, n: int, key: str = "row_id") -> DataFrame:
    """The first n rows by key (each task keeps n, then they are merged)."""
    return df.orderBy(key).limit(n)
