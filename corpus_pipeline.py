"""From raw documents to training shards: the stages in order, each reading what the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``. ``run`` writes each result as a Parquet table in the shared folder and reads it back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from hedgewise.llm import decontamination, mixing, near_dedup, queries, sharding, toxicity
from hedgewise.llm.common import held_out, table
from hedgewise.session import materialise


RESULT = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]


def packed(docs: DataFrame) -> DataFrame:
    """doc_id, text and the whole row as ``_document``, so that no further column can clash with an operator's own."""
    return docs.select("doc_id", "text", F.struct(*docs.columns).alias("_document"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the string-kernel machine does not call toxic.

    It learns from the labelled documents of the input tables, as in the registered query. Null and empty
    texts stay.
    """
    machine = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out(5, 0))
    scored = toxicity.score(packed(docs), machine, carry=["_document"])
    return scored.filter("predicted = 0").select("_document.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of near duplicates. Texts without words stay."""
    found = near_dedup.near_duplicates(docs).filter("kept AND n_shingles > 0").select(F.col("doc_id").alias("_kept")).distinct()
    whole = packed(docs).join(found, F.col("doc_id") == F.col("_kept"), "left")
    blank = F.coalesce(F.trim(F.regexp_replace("text", r"[\x09-\x0D]", " ")), F.lit("")) == ""
    return whole.filter(F.col("_kept").isNotNull() | blank | F.col("doc_id").isNull()).select("_document.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents in which benchmark passages do not reach the share that counts as contamination."""
    found = decontamination.decontaminate(packed(docs), table(spark, sf_dir, "benchmark"), carry=["_document"])
    return found.filter(~F.col("contaminated")).select("_document.*")


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents by their rates, so that languages and quality meet the target shares."""
    mixed = mixing.apply(packed(docs), queries.fitted_mix(spark, docs, sf_dir), carry=["_document"])
    copies = F.explode(F.sequence(F.lit(1), F.col("copies")))
    return mixed.filter("copies > 0").select("_document", copies.alias("_copy")).select("_document.*")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near equal bytes per shard; every row of the predecessor gets a shard and a slot.

    A column of the predecessor that is called like a result column gives way to it.
    """
    return sharding.shard_by_bytes(docs, queries.SHARDS, carry=[c for c in docs.columns if c not in RESULT])


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_to_targets),
    ("sharding", shard),
]
ORACLE_SQL = None  # SQL cannot express the trained stages; tests compare each stage with a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
