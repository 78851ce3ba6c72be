"""Reading question sets, record files, checkpoints and feature matrices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from hedgewise.functions.common import strip
from hedgewise.functions.labels import coerce_gold_label, parse_list_literal
from hedgewise.operators.curation import select_split
from hedgewise.operators.features import feature_columns

MCQ_REQUIRED = ["question", "choice_labels", "choice_texts", "gold_label"]
MCQ_OPTIONAL = ["row_id", "split", "source", "context"]


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns {missing}; found {df.columns}")
    return df


def validate_mcq(df: DataFrame) -> DataFrame:
    """Parse the list cells and say in ``reject_reason`` why a row cannot be used (null: usable)."""
    require_columns(df, MCQ_REQUIRED)
    parsed = df.withColumns(
        {
            "question": strip(F.col("question")),
            "choice_labels": parse_list_literal(F.col("choice_labels")),
            "choice_texts": parse_list_literal(F.col("choice_texts")),
        }
    )
    labels, texts = F.col("choice_labels"), F.col("choice_texts")
    coerced = coerce_gold_label(F.col("gold_label"), labels)
    reason = (
        F.when(texts.isNull(), F.lit("choice_texts is not a list"))
        .when(labels.isNull(), F.lit("choice_labels is not a list"))
        .when(F.size(labels) != F.size(texts), F.lit("lists differ in length"))
        .when(F.coalesce(coerced, F.lit("")) == "", F.lit("gold_label does not fit the labels"))
    )
    return parsed.withColumn("reject_reason", reason).withColumn("gold_label", coerced)


def keep_valid(df: DataFrame, strict: bool = True) -> DataFrame:
    """Drop ``reject_reason``: strict fails on the first bad row, otherwise bad rows are left out."""
    reason = F.col("reject_reason")
    if not strict:
        return df.filter(reason.isNull()).drop("reject_reason")
    message = F.concat(F.lit("invalid row: "), reason, F.lit(": "), F.coalesce("question", F.lit("")))
    checked: Column = F.when(reason.isNull(), F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))
    return df.filter(checked).drop("reject_reason")


def scan_mcq_csv(
    spark: SparkSession, path: str, split: str | None = None, strict: bool | None = True, multi_line: bool = True
) -> DataFrame:
    """A question CSV as typed rows. ``strict=None`` keeps every row with its ``reject_reason``.

    ``multi_line`` allows line breaks inside cells, but then a file is read by one task; files
    without them should be read with ``multi_line=False``, which lets Spark split them.
    """
    options = {"header": True, "multiLine": multi_line, "escape": '"'}
    header = spark.read.options(**options).csv(path).columns
    schema = StructType([StructField(c, StringType()) for c in header])
    raw = spark.read.schema(schema).options(**options).option("enforceSchema", False).csv(path)
    rows = validate_mcq(select_split(require_columns(raw, MCQ_REQUIRED), split))
    return rows if strict is None else keep_valid(rows, strict)


def scan_json_dataset(spark: SparkSession, path: str, schema: str | StructType, array: bool = True) -> DataFrame:
    """Records from one JSON array per file; ``array=False`` reads JSON lines, which Spark can split."""
    return spark.read.schema(schema).json(path, multiLine=array)


def rows_per_source(df: DataFrame) -> DataFrame:
    return df.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def scan_jsonl_tolerant(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Checkpoint lines; malformed ones are ignored."""
    wide = StructType([*schema.fields, StructField("_corrupt_record", StringType())])
    parsed = F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    rows = spark.read.text(path).select(parsed.alias("r"))
    return rows.filter(F.col("r").isNotNull() & F.col("r._corrupt_record").isNull()).select(
        *[F.col("r")[f.name].alias(f.name) for f in schema.fields]
    )


def coerce_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """Anything that is not a number becomes missing."""
    number = lambda c: F.nanvl(F.col(c).cast("string").try_cast("double"), F.lit(None).cast("double"))
    return df.withColumns({c: number(c) for c in columns})


def scan_matrix(spark: SparkSession, path: str, drop_prefixes: tuple[str, ...] = ()) -> tuple[DataFrame, list[str]]:
    """A stored matrix and its sorted feature names without the dropped prefixes."""
    df = spark.read.parquet(path)
    return df, feature_columns(df, drop_prefixes)
