"""Session helpers: local sessions for tests, shared scratch folders, size-checked broadcasts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

BROADCAST_LIMIT_BYTES = 64 * 1024 * 1024


def local_session(cpus: int | str = "*", app: str = "hedgewise", shuffle_partitions: int = 8) -> SparkSession:
    """A single-JVM session for tests and the benchmark."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it in ``spark.checkpoint.dir``.

    Only when the setting is absent in a local session (tests) a folder of this machine is made and set;
    it is deleted when the driver ends. On a cluster an absent setting is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="hedgewise-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other run uses."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a result once to the shared folder and read it back, which cuts its lineage."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Give heavy per-row work one piece per core when a table comes in fewer pieces than cores.

    Large tables have many more splits than cores and pass through without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)


def _row_bytes(df: DataFrame) -> Column:
    """Bytes of a row, with the real lengths of its texts."""
    total = F.lit(16)
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        if kind in ("string", "binary"):
            total = total + F.coalesce(F.octet_length(f.name), F.lit(0))
        elif kind in ("array", "map", "struct"):
            total = total + F.coalesce(F.octet_length(F.to_json(F.struct(f.name))), F.lit(0))
        else:
            total = total + 8
    return total


def join_small(big: DataFrame, small: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Join a side that is expected to be small, broadcasting it only after measuring it.

    The small side is worked out once, into the shared folder, and its bytes are added up there; above the limit the join
    is left to Spark, which shuffles both sides and splits skewed partitions. So a side that takes long to work out is not
    done for the measurement and again for the join, and not four times where small sides are made of small sides.
    Nothing stays cached.
    """
    if not any(f.dataType.typeName() == "void" for f in small.schema.fields):  # Parquet has no such type
        small = materialise(small, "small")
    size = small.agg(F.sum(_row_bytes(small)).alias("bytes")).first()["bytes"] or 0
    return big.join(F.broadcast(small) if size <= BROADCAST_LIMIT_BYTES else small, on, how)
