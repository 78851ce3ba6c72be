"""Evaluation records derived from the given tables, in Spark and (for the checks) in SQL.

Vectors stand for recorded logits: block b of a 64-long embedding holds positions 8b+1..8b+8.
Model m answers with block m; its gold label is the best position of a related score.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hedgewise.functions.common import letter
from hedgewise.functions.labels import parse_confidence
from hedgewise.functions.prompts import REFLECTION_STYLES
from hedgewise.operators.features import direct_pass, generation_signals
from hedgewise.plans.catalog import VIEWS
from hedgewise.session import spread

MODELS = [0, 1, 2, 3]
SIGNALS = ["entropy_over_labels", "entropy_over_vocab", "one_minus_margin", "one_minus_top1"]


def labels() -> Column:
    return F.array(*[F.lit(x) for x in "ABCD"])


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _block(block: Column, width: int = 4, start: int = 1) -> Column:
    return F.slice("e", block * 8 + start, width)


def _argmax(values: Column) -> Column:
    return F.array_position(values, F.array_max(values)).cast("int") - 1


def recorded(spark: SparkSession, sf: str) -> DataFrame:
    """One row per (model, row_id) with the vector as doubles."""
    rows = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("row_id"),
        F.concat(F.lit("S"), F.col("label")).alias("source"),
        F.col("embedding").cast("array<double>").alias("e"),
    )
    return rows.select(F.explode(F.array(*[F.lit(m) for m in MODELS])).alias("model"), "row_id", "source", "e")


def logits(spark: SparkSession, sf: str) -> DataFrame:
    """model, row_id, source, logits (4), vocab (8), gold_score (4)."""
    m = F.col("model")
    times8 = lambda v: F.transform(v, lambda x: x * 8.0)
    return recorded(spark, sf).select(
        "model",
        "row_id",
        "source",
        times8(_block(m)).alias("logits"),
        times8(_block(m, 8)).alias("vocab"),
        F.zip_with(_block(m), _block(m, 4, 5), lambda a, b: a + b).alias("gold_score"),
    )


VIEWS["fx_logits"] = """
SELECT m.model, e.vec_id AS row_id, 'S' || e.label AS source,
  [e.embedding[8*m.model+i]::DOUBLE*8 FOR i IN [1,2,3,4]] AS logits,
  [e.embedding[8*m.model+i]::DOUBLE*8 FOR i IN [1,2,3,4,5,6,7,8]] AS vocab,
  [e.embedding[8*m.model+i]::DOUBLE + e.embedding[8*m.model+4+i]::DOUBLE FOR i IN [1,2,3,4]] AS gold_score
FROM embeddings e, (SELECT unnest([0,1,2,3]) AS model) m"""


def _direct(rows: DataFrame, scores: Column, vocab: Column) -> DataFrame:
    gold = F.get(labels(), _argmax(F.col("gold_score")))
    return direct_pass(rows, scores, labels(), gold, vocab)


def direct(spark: SparkSession, sf: str) -> DataFrame:
    """The direct-pass table of every model."""
    d = _direct(logits(spark, sf), F.col("logits"), F.col("vocab"))
    generated = letter(F.pmod(_argmax(F.col("vocab")), F.lit(4)))
    d = d.withColumn("pred_generated", generated)
    return d.withColumn(
        "correct_generated", (F.col("pred_generated") == F.col("gold_label")).cast("int")
    ).drop("logits", "vocab", "gold_score")


VIEWS["fx_spread"] = """
SELECT *, list_transform(logits, lambda x: exp(x - list_max(logits))) AS ex,
  list_transform(vocab, lambda x: exp(x - list_max(vocab))) AS ex8 FROM fx_logits"""
VIEWS["fx_probs"] = """
SELECT *, list_transform(ex, lambda x: x / list_sum(ex)) AS p,
  list_transform(ex8, lambda x: x / list_sum(ex8)) AS p8 FROM fx_spread"""
_DIRECT_COLUMNS = """model, row_id, source,
  substr('ABCD', list_position(gold_score, list_max(gold_score))::INT, 1) AS gold_label,
  substr('ABCD', list_position(p, list_max(p))::INT, 1) AS pred_by_probs,
  list_reverse_sort(p)[1] AS top1_prob, list_reverse_sort(p)[2] AS top2_prob,
  list_reverse_sort(p)[1] - list_reverse_sort(p)[2] AS margin,
  -list_sum(list_transform(p, lambda x: x * ln(x + 1e-12))) AS entropy_over_labels"""
VIEWS["fx_direct"] = f"""
SELECT *, (pred_by_probs = gold_label)::INT AS correct_by_probs, (pred_generated = gold_label)::INT AS correct_generated
FROM (SELECT {_DIRECT_COLUMNS},
  -list_sum(list_transform(p8, lambda x: x * ln(x + 1e-12))) AS entropy_over_vocab,
  substr('ABCD', 1 + ((list_position(vocab, list_max(vocab)) - 1) % 4)::INT, 1) AS pred_generated FROM fx_probs)"""


def reflected(spark: SparkSession, sf: str) -> DataFrame:
    """Recorded answers of reflection passes 1 and 2; a quarter of the first and half of the second passes are missing."""
    m = F.col("model")
    grid = F.array(
        *[
            F.struct(F.lit(i).alias("style_index"), F.lit(s).alias("style"), F.lit(p).alias("reflection_pass"))
            for i, s in enumerate(REFLECTION_STYLES)
            for p in (1, 2)
        ]
    )
    rows = recorded(spark, sf).withColumn("g", F.explode(grid)).select("*", "g.*").drop("g")
    turn = F.pmod(F.col("row_id") + m + F.col("style_index"), F.lit(4))
    rows = rows.filter((turn != 0) & ((F.col("reflection_pass") == 1) | (turn != 1)))
    other = F.pmod(m + 3 + F.col("style_index") + F.col("reflection_pass"), F.lit(8))
    mixed = F.zip_with(
        F.zip_with(_block(m), _block(m, 4, 5), lambda a, b: a + b * 0.6), _block(other), lambda ab, c: (ab + c * 0.8) * 8.0
    )
    rows = rows.select(
        "model",
        "row_id",
        "source",
        "style",
        "reflection_pass",
        mixed.alias("logits"),
        F.zip_with(_block(m), _block(m, 4, 5), lambda a, b: a + b).alias("gold_score"),
    )
    d = _direct(rows, F.col("logits"), F.col("logits"))
    return d.drop("logits", "gold_score", "entropy_over_vocab").withColumn("pred", F.col("pred_by_probs"))


VIEWS["fx_reflected_spread"] = """
SELECT *, list_transform(logits, lambda x: exp(x - list_max(logits))) AS ex FROM (
SELECT m.model, e.vec_id AS row_id, 'S' || e.label AS source, s.style, r.reflection_pass,
  [(e.embedding[8*m.model+i]::DOUBLE + e.embedding[8*m.model+4+i]::DOUBLE * 0.6::DOUBLE
    + e.embedding[8*((m.model+3+s.style_index+r.reflection_pass) % 8)+i]::DOUBLE * 0.8::DOUBLE) * 8 FOR i IN [1,2,3,4]] AS logits,
  [e.embedding[8*m.model+i]::DOUBLE + e.embedding[8*m.model+4+i]::DOUBLE FOR i IN [1,2,3,4]] AS gold_score
FROM embeddings e, (SELECT unnest([0,1,2,3]) AS model) m,
  (SELECT unnest([0,1,2,3]) AS style_index,
          unnest(['plain_retry','error_scan','option_elimination','evidence_reconstruction']) AS style) s,
  (SELECT unnest([1,2]) AS reflection_pass) r
WHERE (e.vec_id + m.model + s.style_index) % 4 <> 0 AND (r.reflection_pass = 1 OR (e.vec_id + m.model + s.style_index) % 4 <> 1))"""
VIEWS["fx_reflected"] = f"""
SELECT *, (pred_by_probs = gold_label)::INT AS correct_by_probs FROM (
SELECT {_DIRECT_COLUMNS}, style, reflection_pass
FROM (SELECT *, list_transform(ex, lambda x: x / list_sum(ex)) AS p FROM fx_reflected_spread))"""


def retries(spark: SparkSession, sf: str) -> DataFrame:
    """The second answer after being told that the first was wrong."""
    return reflected(spark, sf).filter("style = 'plain_retry' AND reflection_pass = 1").drop("style", "reflection_pass")


VIEWS["fx_retries"] = "SELECT * FROM fx_reflected WHERE style = 'plain_retry' AND reflection_pass = 1"


def signals(spark: SparkSession, sf: str) -> DataFrame:
    """Direct pass as error scores: model, row_id, source, error and four signals."""
    return direct(spark, sf).select(
        "model",
        "row_id",
        "source",
        (1 - F.col("correct_by_probs")).alias("error"),
        "entropy_over_labels",
        "entropy_over_vocab",
        (1.0 - F.col("margin")).alias("one_minus_margin"),
        (1.0 - F.col("top1_prob")).alias("one_minus_top1"),
    )


VIEWS["fx_signals"] = """
SELECT model, row_id, source, 1 - correct_by_probs AS error, entropy_over_labels, entropy_over_vocab,
  1 - margin AS one_minus_margin, 1 - top1_prob AS one_minus_top1 FROM fx_direct"""
VIEWS["fx_long"] = """
SELECT model, row_id, source, error, signal, score FROM fx_signals
UNPIVOT (score FOR signal IN (entropy_over_labels, entropy_over_vocab, one_minus_margin, one_minus_top1))"""


def long_signals(spark: SparkSession, sf: str) -> DataFrame:
    return signals(spark, sf).unpivot(["model", "row_id", "source", "error"], SIGNALS, "signal", "score")


def steps(spark: SparkSession, sf: str) -> DataFrame:
    """Generation steps: zero to three per row, an eighth of the longest ones cut short."""
    step = F.col("step")
    rows = recorded(spark, sf).withColumn(
        "step", F.explode(F.filter(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda s: s < F.pmod("row_id", F.lit(4))))
    )
    block = F.pmod(F.col("model") + step * 2, F.lit(8))
    cut = (step == 2) & (F.pmod("row_id", F.lit(8)) == 3)
    return rows.select(
        "model",
        "row_id",
        "step",
        F.when(~cut, F.pmod(F.col("row_id") + step, F.lit(8)).cast("int")).alias("token_id"),
        F.transform(_block(block, 8), lambda x: x * 8.0).alias("logits"),
    )


VIEWS["fx_steps"] = """
SELECT m.model, e.vec_id AS row_id, s.step,
  CASE WHEN NOT (s.step = 2 AND e.vec_id % 8 = 3) THEN (e.vec_id + s.step) % 8 END AS token_id,
  [e.embedding[8*((m.model+2*s.step) % 8)+i]::DOUBLE*8 FOR i IN [1,2,3,4,5,6,7,8]] AS logits
FROM embeddings e, (SELECT unnest([0,1,2,3]) AS model) m, (SELECT unnest([0,1,2]) AS step) s
WHERE s.step < e.vec_id % 4"""
VIEWS["fx_step_lse"] = """
SELECT *, list_max(logits) + ln(list_sum(list_transform(logits, lambda x: exp(x - list_max(logits))))) AS lse
FROM fx_steps WHERE token_id IS NOT NULL"""
VIEWS["fx_step_signals"] = """
SELECT model, row_id, step, lse - logits[token_id + 1] AS nll,
  -list_sum(list_transform(logits, lambda x: exp(x - lse) * (x - lse))) AS entropy,
  list_transform(list_reverse_sort(logits)[1:5], lambda x: x - lse) AS top5 FROM fx_step_lse"""


def generations(spark: SparkSession, sf: str) -> DataFrame:
    """Every (model, row_id) with its generation signals."""
    rows = recorded(spark, sf).select("model", "row_id")
    return generation_signals(steps(spark, sf), rows, ["model", "row_id"])


VIEWS["fx_generations"] = """
SELECT l.model, l.row_id, s0.entropy AS first_token_entropy, g.avg_entropy, g.perplexity,
  exp(-s0.nll) AS chosen_token_prob, s0.top5 FROM fx_logits l
LEFT JOIN (SELECT model, row_id, avg(entropy) AS avg_entropy, exp(avg(nll)) AS perplexity
           FROM fx_step_signals GROUP BY ALL) g USING (model, row_id)
LEFT JOIN (SELECT * FROM fx_step_signals WHERE step = 0) s0 USING (model, row_id)"""


def replies(spark: SparkSession, sf: str) -> DataFrame:
    """Short replies from the event log: row_id, source, reply, value, correct."""
    return table(spark, sf, "events").select(
        F.col("event_id").alias("row_id"),
        F.col("event_type").alias("source"),
        F.when(F.col("event_type") == "error", F.col("event_type")).otherwise(F.col("props")).alias("reply"),
        "value",
        F.when(F.pmod("user_id", F.lit(3)) != 0, 1).otherwise(0).alias("correct"),
    )


VIEWS["fx_replies"] = """
SELECT event_id AS row_id, event_type AS source, CASE WHEN event_type = 'error' THEN event_type ELSE props END AS reply,
  value, (user_id % 3 <> 0)::INT AS correct FROM events"""


def confidences(spark: SparkSession, sf: str) -> DataFrame:
    """Self-reported confidence per (model, row_id), read from the replies."""
    return replies(spark, sf).select(
        F.pmod("row_id", F.lit(4)).cast("int").alias("model"),
        F.floor(F.col("row_id") / 4).alias("row_id"),
        "source",
        "correct",
        parse_confidence(F.col("reply")).alias("self_confidence"),
    )


VIEWS["fx_confidences"] = """
SELECT (row_id % 4)::INT AS model, row_id // 4 AS row_id, source, correct,

  CASE WHEN regexp_matches(reply, '[0-9]') THEN least(regexp_extract(reply, '([0-9]{1,3})', 1)::INT, 100) END AS self_confidence
FROM fx_replies"""


def messages(spark: SparkSession, sf: str) -> DataFrame:
    """Long replies: every conversation turn, whole."""
    return table(spark, sf, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("row_id"), "conv_id", "turn", F.col("role").alias("source"), F.col("text").alias("reply")
    )


VIEWS["fx_messages"] = (
    "SELECT conv_id * 1000 + turn AS row_id, conv_id, turn, role AS source, text AS reply FROM conversations"
)


def questions(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled questions: whole texts with a 0/1 target."""
    docs = table(spark, sf, "documents").select("doc_id", "source", "lang", F.col("text").alias("question"))
    marks = table(spark, sf, "labels").select("doc_id", (F.col("quality") == 0).cast("int").alias("target"))
    return docs.join(marks, "doc_id").withColumnRenamed("doc_id", "row_id")


VIEWS["fx_questions"] = """
SELECT d.doc_id AS row_id, d.source, d.lang, d.text AS question, (l.quality = 0)::INT AS target
FROM documents d JOIN labels l USING (doc_id)"""


def all_questions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("row_id"), "source", "lang", F.col("text").alias("question")
    )


def long_texts(spark: SparkSession, sf: str) -> DataFrame:
    """The same rows for text features, which cost much more than moving the text once."""
    return spread(all_questions(spark, sf), "row_id")


VIEWS["fx_all_questions"] = "SELECT doc_id AS row_id, source, lang, text AS question FROM documents"


def pool(spark: SparkSession, sf: str) -> DataFrame:
    """The existing set: documents that already carry a label."""
    return questions(spark, sf).select("row_id", "source", "question")


def newcomers(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates: documents without a label yet."""
    marks = table(spark, sf, "labels").select(F.col("doc_id").alias("row_id"))
    return all_questions(spark, sf).join(marks, "row_id", "left_anti").select("row_id", "source", "question")


VIEWS["fx_pool"] = "SELECT row_id, source, question FROM fx_questions"
VIEWS["fx_newcomers"] = """
SELECT row_id, source, question FROM fx_all_questions WHERE row_id NOT IN (SELECT doc_id FROM labels)"""


def parts(spark: SparkSession, sf: str) -> DataFrame:
    """Part attributes as answer options in raw form."""
    size = F.col("p_size").cast("string")
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("row_id"),
        F.col("p_name").alias("question"),
        F.col("p_brand").alias("brand"),
        F.col("p_type").alias("kind"),
        size.alias("size"),
        F.array("p_brand", "p_type", "p_name", size).alias("choices"),
        F.pmod("p_partkey", F.lit(5)).cast("int").alias("answer"),
    )


VIEWS["fx_parts"] = """
SELECT p_partkey AS row_id, p_name AS question, p_brand AS brand, p_type AS kind, p_size::VARCHAR AS size,
  [p_brand, p_type, p_name, p_size::VARCHAR] AS choices, (p_partkey % 5)::INT AS answer FROM part"""


def passages(spark: SparkSession, sf: str) -> DataFrame:
    """Web pages as passages: title and text without markup."""
    return table(spark, sf, "pages").select(
        "page_id",
        F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"),
        F.trim(F.regexp_replace("html", "<[^>]*>", " ")).alias("text"),
    )


VIEWS["fx_passages"] = """
SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title,
  trim(regexp_replace(html, '<[^>]*>', ' ', 'g')) AS text FROM pages"""


def searches(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("row_id"), F.col("text").alias("question"))


VIEWS["fx_searches"] = "SELECT item_id AS row_id, text AS question FROM benchmark"
