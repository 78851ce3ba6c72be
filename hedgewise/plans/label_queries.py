"""Labels and confidences read out of replies."""

from __future__ import annotations

from pyspark.sql import functions as F

from hedgewise.functions import labels as B
from hedgewise.functions.common import text_list
from hedgewise.plans import inputs
from hedgewise.plans.catalog import VIEWS, query

# \\w spelt out; RE2 has no look-around, so the stand-alone letter is found among the words.
W = r"[\p{L}\p{N}_]"
WS = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]"


def strip_sql(value: str) -> str:
    return f"regexp_replace({value}, '^{WS}+|{WS}+$', '', 'g')"


VIEWS["fx_upper"] = f"SELECT *, upper({strip_sql('reply')}) AS t FROM fx_messages"
VIEWS["fx_words"] = f"SELECT *, regexp_extract_all(t, '{W}+') AS words FROM fx_upper"
_FIRST = r"CASE WHEN regexp_matches(t, '^\p{L}') THEN t[1] ELSE t END"


@query(
    "normalize_label",
    "row_id:i source:s label:s",
    rf"SELECT row_id, source, coalesce(list_filter(words, lambda w: regexp_full_match(w, '[A-Z]'))[1], {_FIRST}) AS label FROM fx_words",
)
def normalize_label(spark, sf):
    return inputs.messages(spark, sf).select("row_id", "source", B.normalize_label(F.col("reply")).alias("label"))


@query("normalize_label_first_char", "row_id:i label:s", f"SELECT row_id, {_FIRST} AS label FROM fx_upper")
def normalize_label_first_char(spark, sf):
    return inputs.messages(spark, sf).select("row_id", B.normalize_label(F.col("reply"), "first_char").alias("label"))


VIEWS["fx_letters"] = """
SELECT *, coalesce(list_filter(words, lambda w: w IN ('A','B','C','D','E'))[1],
  nullif(regexp_extract(t, '([A-E])', 1), '')) AS letter,
  coalesce(list_filter(words, lambda w: regexp_full_match(w, '[A-Z]'))[1], nullif(regexp_extract(t, '([A-Z])', 1), '')) AS any_letter
FROM fx_words"""


@query("extract_choice_letter", "row_id:i source:s letter:s any_letter:s", "SELECT * FROM fx_letters")
def extract_choice_letter(spark, sf):
    allowed = F.array(*[F.lit(x) for x in "ABCDE"])
    return inputs.messages(spark, sf).select(
        "row_id",
        "source",
        B.extract_choice_letter(F.col("reply"), allowed).alias("letter"),
        B.extract_choice_letter(F.col("reply")).alias("any_letter"),
    )


@query(
    "is_correct",
    "source:s n:i correct:i",
    "SELECT source, count(*) AS n, sum(coalesce(letter = 'A', false)::INT) AS correct FROM fx_letters GROUP BY source",
)
def is_correct(spark, sf):
    letter = B.extract_choice_letter(F.col("reply"), F.array(*[F.lit(x) for x in "ABCDE"]))
    rows = inputs.messages(spark, sf).select("source", B.is_correct(letter, F.lit("A")).alias("ok"))
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("correct"))


@query("parse_confidence", "row_id:i source:s confidence:i", "SELECT row_id * 4 + model AS row_id, source, self_confidence AS confidence FROM fx_confidences")
def parse_confidence(spark, sf):
    return inputs.replies(spark, sf).select("row_id", "source", B.parse_confidence(F.col("reply")).alias("confidence"))


@query(
    "parse_failures",
    "source:s n:i failures:i success_rate:d",
    """SELECT source, count(*) AS n, sum((NOT regexp_matches(reply, '[0-9]'))::INT) AS failures,
  avg(regexp_matches(reply, '[0-9]')::INT) AS success_rate
FROM (SELECT source, reply FROM fx_replies UNION ALL SELECT source, reply FROM fx_messages) GROUP BY source""",
)
def parse_failures(spark, sf):
    both = inputs.replies(spark, sf).select("source", "reply").unionByName(
        inputs.messages(spark, sf).select("source", "reply")
    )
    parsed = both.select("source", B.parse_confidence(F.col("reply")).alias("c"))
    return parsed.groupBy("source").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("c").isNull()).alias("failures"),
        F.avg(F.col("c").isNotNull().cast("double")).alias("success_rate"),
    )


@query(
    "parse_list_literal",
    "row_id:i n_items:i items:s",
    "SELECT row_id, len(choices) AS n_items, array_to_string(choices, '|') AS items FROM fx_parts",
)
def parse_list_literal(spark, sf):
    quoted = F.transform("choices", lambda c: F.concat(F.lit("'"), c, F.lit("'")))
    literal = F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))
    rows = inputs.parts(spark, sf).select("row_id", B.parse_list_literal(literal).alias("items"))
    return rows.select("row_id", F.size("items").alias("n_items"), text_list(F.col("items")).alias("items"))


@query(
    "coerce_gold_label",
    "row_id:i gold_label:s",
    """SELECT row_id, CASE WHEN upper(size) IN ('A','B','C','D') THEN upper(size)
  WHEN upper(regexp_extract(raw, '([A-Za-z])', 1)) IN ('A','B','C','D') THEN upper(regexp_extract(raw, '([A-Za-z])', 1))
  ELSE '' END AS gold_label FROM (SELECT row_id, size, ' ' || kind || ' ' AS raw FROM fx_parts)""",
)
def coerce_gold_label(spark, sf):
    raw = F.concat(F.lit(" "), F.col("kind"), F.lit(" "))
    labels = F.array(*[F.lit(x) for x in (" a", "B", "c ", "D")])
    return inputs.parts(spark, sf).select("row_id", B.coerce_gold_label(raw, labels).alias("gold_label"))
