"""Assigning regimes to answers as they are recorded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from hedgewise.operators.policies import regime
from hedgewise.session import join_small


def read_records(spark: SparkSession, folder: str, schema: StructType, glob: str | None = None, files: int = 64) -> DataFrame:
    """Recorded answers arriving as Parquet files."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(folder)


def routed_rows(records: DataFrame, thresholds: DataFrame | dict[str, float], entropy: Column, margin: Column, on: list[str] | None = None) -> DataFrame:
    """The batch and the streaming form of the decision.

    ``thresholds`` are frozen numbers, or a stored table as ``regime_thresholds`` gives it, one row per value of
    the ``on`` columns; records of a value without thresholds are medium.
    """
    if isinstance(thresholds, DataFrame):
        names = [c for c in thresholds.columns if c not in (on or [])]
        frozen = join_small(records, thresholds, on)
    else:
        names = list(thresholds)
        frozen = records.withColumns({name: F.lit(float(v)) for name, v in thresholds.items()})
    return frozen.withColumn("regime", regime(entropy, margin)).drop(*names)


def finished_rows(spark: SparkSession, sink: str, schema: StructType) -> DataFrame | None:
    """What earlier runs wrote, or None before the first."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(sink)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return None
    return spark.read.schema(schema).parquet(sink)


ON_DISK = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_route(
    records: DataFrame,
    sink: str,
    checkpoint: str,
    thresholds: DataFrame | dict[str, float],
    entropy: Column,
    margin: Column,
    finished: DataFrame | None = None,
    key: str = "row_id",
    on: list[str] | None = None,
    event_time: str | None = None,
    delay: str | None = None,
) -> StreamingQuery:
    """Decide every record that has arrived, each key once, and stop; a later call goes on from there.

    Keys that were decided are state of the query, spread over the state partitions by key and kept with the
    checkpoint, so a repeat within a batch, in a later batch or in a later run never reaches the sink. With an
    ``event_time`` column and a ``delay``, a key is forgotten once the watermark has passed it, which bounds the
    state; repeats later than that would be decided again. Of repeats that differ one stands. The file sink commits
    each batch once, so a lost executor or a restart repeats nothing. ``finished`` are keys decided elsewhere.
    """
    spark = records.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", ON_DISK).endswith("HDFSBackedStateStoreProvider"):
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ON_DISK)  # keys on disk, not on the heap
    fresh = records if finished is None else records.join(finished.select(key).distinct(), key, "left_anti")
    if event_time and delay:
        once = fresh.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])
    else:
        once = fresh.dropDuplicates([key])
    return (
        routed_rows(once, thresholds, entropy, margin, on)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("path", sink)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_routed(spark: SparkSession, sink: str, key: str = "row_id") -> DataFrame:
    """All decisions, one per row, also of a sink that several queries wrote. Copies combine in each task before the shuffle."""
    rows = spark.read.parquet(sink)
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.min(F.struct(*others)).alias("_r")).select(key, "_r.*")
