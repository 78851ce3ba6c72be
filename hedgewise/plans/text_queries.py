"""Text features and prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from hedgewise.functions import prompts as P
from hedgewise.functions import text as X
from hedgewise.functions.common import safe_text as safe, strip
from hedgewise.operators.features import token_class_shares
from hedgewise.plans import inputs
from hedgewise.plans.catalog import VIEWS, query
from hedgewise.plans.label_queries import W, WS, strip_sql

VIEWS["fx_stripped"] = f"SELECT row_id, source, question, {strip_sql('question')} AS t FROM fx_all_questions"
VIEWS["fx_basic"] = f"""
SELECT row_id, length(t) AS feat_char_count, len(list_filter(string_split_regex(t, '{WS}+'), lambda w: w <> '')) AS feat_word_count,
  coalesce(length(regexp_replace(t, '{WS}+', '', 'g'))::DOUBLE
    / nullif(len(list_filter(string_split_regex(t, '{WS}+'), lambda w: w <> '')), 0), 0) AS feat_avg_word_len,
  length(regexp_replace(t, '[\\p{{L}}\\p{{N}}_\\s\\x0B\\x1C-\\x1F\\x{{85}}\\p{{Z}}]', '', 'g')) AS feat_punct_count
FROM fx_stripped"""


@query(
    "feat_basic_text",
    "row_id:i feat_char_count:d feat_word_count:d feat_avg_word_len:d feat_punct_count:d",
    "SELECT * FROM fx_basic",
)
def feat_basic_text(spark, sf):
    cols = X.basic_text(F.col("question"))
    return inputs.long_texts(spark, sf).select("row_id", *[c.alias(n) for n, c in cols.items()])


def _counted(words: list[str]) -> str:
    """Single words among the tokens, phrases and contractions with explicit borders."""
    single = ", ".join(f"'{w}'" for w in words if w.isalpha())
    out = f"len(list_filter(tokens, lambda w: w IN ({single})))"
    for w in words:
        if not w.isalpha():
            pattern = w.replace("'", "''").replace(" ", WS + "+")
            # Borders are doubled so that neighbours do not share one.
            doubled = rf"regexp_replace(low, '([^\p{{L}}\p{{N}}_])', '\1\1', 'g')"
            if " " in w:
                out += rf" + len(regexp_extract_all({doubled}, '(?:^|[^\p{{L}}\p{{N}}_]){pattern}(?:$|[^\p{{L}}\p{{N}}_])'))"
            else:
                out += rf" + len(regexp_extract_all(low, '(?:^|[^\p{{L}}\p{{N}}_]){pattern}(?:$|[^\p{{L}}\p{{N}}_])'))"
    return out


VIEWS["fx_tokens"] = f"""
SELECT row_id, question, lower(question) AS low, regexp_extract_all(lower(question), '{W}+') AS tokens,
  regexp_extract_all(question, '{W}+') AS cased FROM fx_all_questions"""
VIEWS["fx_keywords"] = f"""
SELECT *, (feat_negation_count > 0)::INT AS feat_has_negation, (feat_comparison_count > 0)::INT AS feat_has_comparison,
  (feat_quant_count > 0)::INT AS feat_has_quant FROM (SELECT row_id, {_counted(X.NEGATION_WORDS)} AS feat_negation_count,
  {_counted(X.COMPARISON_WORDS)} AS feat_comparison_count, {_counted(X.QUANTITY_WORDS)} AS feat_quant_count FROM fx_tokens)"""
_FLAGS = " ".join(f"feat_has_{n}:d feat_{n}_count:d" for n in ("negation", "comparison", "quant"))


@query("feat_keywords", "row_id:i " + _FLAGS, "SELECT * FROM fx_keywords")
def feat_keywords(spark, sf):
    cols = X.keyword_flags(F.col("question"))
    return inputs.long_texts(spark, sf).select("row_id", *[c.alias(n) for n, c in cols.items()])


@query(
    "feat_simple_flags",
    "row_id:i feat_length_char:i feat_has_why:i feat_has_how:i feat_ner_estimate:i",
    """SELECT row_id, length(question) AS feat_length_char, contains(low, 'why')::INT AS feat_has_why,
  contains(low, 'how')::INT AS feat_has_how,
  len(list_filter(cased, lambda w: regexp_full_match(w, '[A-Z][a-z]+'))) AS feat_ner_estimate FROM fx_tokens""",
)
def feat_simple_flags(spark, sf):
    cols = X.simple_flags(F.col("question"))
    return inputs.long_texts(spark, sf).select("row_id", *[c.alias(n) for n, c in cols.items()])


def lexicon(spark, sf):
    """Words of the search texts, classed by their ending."""
    text = inputs.searches(spark, sf).select(F.explode(F.regexp_extract_all(F.lower("question"), F.lit(f"({W}+)"), F.lit(1))).alias("token"))
    kind = (
        F.when(F.col("token").rlike("(ed|ing|en)$"), F.lit("VERB"))
        .when(F.col("token").rlike("(tion|er|ble|s)$"), F.lit("NOUN"))
        .otherwise(F.lit("OTHER"))
    )
    return text.distinct().withColumn("token_class", kind)


VIEWS["fx_lexicon"] = f"""
SELECT token, CASE WHEN regexp_matches(token, '(ed|ing|en)$') THEN 'VERB' WHEN regexp_matches(token, '(tion|er|ble|s)$') THEN 'NOUN'
  ELSE 'OTHER' END AS token_class
FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(question), '{W}+')) AS token FROM fx_searches)"""
# A phrase is a run of capitalised words with nothing but white space between them.
VIEWS["fx_phrases"] = rf"""
SELECT row_id, len(list_filter(regexp_extract_all(regexp_replace(question, '({W}+)', '<\1>', 'g'),
  '<[A-Z][a-z]+>(?:{WS}+<[A-Z][a-z]+>)*'), lambda x: true)) AS feat_entity_count FROM fx_all_questions"""
VIEWS["fx_class_shares"] = """
SELECT q.row_id, p.feat_entity_count, coalesce(s.noun, 0) AS feat_noun_ratio, coalesce(s.verb, 0) AS feat_verb_ratio
FROM fx_all_questions q JOIN fx_phrases p USING (row_id) LEFT JOIN (
  SELECT row_id, avg((token_class IS NOT DISTINCT FROM 'NOUN')::INT) AS noun, avg((token_class IS NOT DISTINCT FROM 'VERB')::INT) AS verb
  FROM (SELECT row_id, unnest(tokens) AS token FROM fx_tokens) LEFT JOIN fx_lexicon USING (token) GROUP BY row_id) s USING (row_id)"""


@query(
    "feat_token_class",
    "row_id:i feat_entity_count:d feat_noun_ratio:d feat_verb_ratio:d",
    "SELECT * FROM fx_class_shares",
)
def feat_token_class(spark, sf):
    return token_class_shares(inputs.long_texts(spark, sf), lexicon(spark, sf))


@query(
    "safe_text",
    "row_id:i value:s",
    "SELECT d.doc_id AS row_id, coalesce(l.quality::VARCHAR, '') AS value FROM documents d LEFT JOIN labels l USING (doc_id)",
)
def safe_text(spark, sf):
    docs = inputs.table(spark, sf, "documents").select("doc_id")
    marks = inputs.table(spark, sf, "labels").select("doc_id", "quality")
    return docs.join(marks, "doc_id", "left").select(F.col("doc_id").alias("row_id"), safe(F.col("quality")).alias("value"))


# ---------------------------------------------------------------- prompts

VIEWS["fx_prompts"] = f"""
SELECT row_id, question, kind AS source, {strip_sql('brand')} AS passage, chr(65 + (answer % 4)) AS previous,
  'A. ' || brand || chr(10) || 'B. ' || kind || chr(10) || 'C. ' || question || chr(10) || 'D. ' || size AS lines
FROM fx_parts"""
_SYSTEM = (
    "'You are a multiple-choice question answering system. {0}Read the question and options carefully. "
    "Return ONLY the final answer label, one of A, B, C, D. Do not explain your reasoning. Do not write anything else.'"
)
_REFERENCE = "Use the provided reference information if relevant, otherwise rely on your own knowledge. "
_USER = (
    "'Question:' || chr(10) || question || chr(10) || chr(10) || 'Options:' || chr(10) || lines || chr(10) || chr(10) "
    "|| 'Answer with only the label.'"
)


def _prompts(spark, sf):
    return inputs.parts(spark, sf).select(
        "row_id",
        "question",
        F.col("kind").alias("source"),
        F.col("brand").alias("passage"),
        inputs.labels().alias("labels"),
        F.array("brand", "kind", "question", "size").alias("texts"),
        F.char(F.pmod("answer", F.lit(4)) + 65).alias("previous"),
        F.pmod("answer", F.lit(4)).alias("style_index"),
    )


def _parts():
    return F.col("question"), F.col("labels"), F.col("texts")


def _flat(messages):
    """A chat as one text: role: content, turns separated by ###."""
    return F.array_join(F.transform(messages, lambda m: F.concat(m["role"], F.lit(": "), m["content"])), " ### ")


@query(
    "mcq_user_message",
    "row_id:i message:s",
    "SELECT row_id, question || chr(10) || chr(10) || 'Choices:' || chr(10) || lines || chr(10) || chr(10) "
    "|| 'Reply with only the letter of the correct answer (A, B, C, D).' AS message FROM fx_prompts",
)
def mcq_user_message(spark, sf):
    return _prompts(spark, sf).select("row_id", P.mcq_user_message(*_parts()).alias("message"))


@query(
    "system_prompt",
    "row_id:i plain:s with_reference:s brief:s",
    f"""SELECT row_id, {_SYSTEM.format('')} AS plain, {_SYSTEM.format(_REFERENCE)} AS with_reference,
  'You are a multiple-choice question answering system. Read the question and options carefully. ' ||
  'Return only the final answer label, one of A, B, C, D. Do not explain your reasoning.' AS brief FROM fx_prompts""",
)
def system_prompt(spark, sf):
    return _prompts(spark, sf).select(
        "row_id", P.system_prompt(F.col("labels")).alias("plain"), P.system_prompt(F.col("labels"), True).alias("with_reference"),
        P.system_prompt(F.col("labels"), brief=True).alias("brief"),
    )


@query(
    "user_prompt",
    "row_id:i plain:s full_prompt:s",
    f"""SELECT row_id, {_USER} AS plain, 'Reference Information:' || chr(10) || source || chr(10) || chr(10)
  || 'Passage:' || chr(10) || passage || chr(10) || chr(10) || {_USER} AS full_prompt FROM fx_prompts""",
)
def user_prompt(spark, sf):
    return _prompts(spark, sf).select(
        "row_id",
        P.user_prompt(*_parts()).alias("plain"),
        P.user_prompt(*_parts(), F.col("passage"), F.col("source")).alias("full_prompt"),
    )


@query(
    "passage_gate",
    "row_id:i passage:s",
    "SELECT row_id, CASE WHEN source IN ('ECONOMY', 'PROMO') AND passage NOT IN ('', 'nan', 'None') THEN passage END AS passage FROM fx_prompts",
)
def passage_gate(spark, sf):
    gated = P.passage_gate(F.col("source"), F.concat(F.lit("\n "), "passage", F.lit("\t")), ["ECONOMY", "PROMO"])
    return _prompts(spark, sf).select("row_id", gated.alias("passage"))


_BRIEF = (
    "'You are a multiple-choice question answering system. Read the question and options carefully. "
    "Return only the final answer label, one of A, B, C, D. Do not explain your reasoning.'"
)
_DIRECT = f"'system: ' || {_BRIEF} || ' ### user: ' || {_USER}"


@query("direct_messages", "row_id:i chat:s", f"SELECT row_id, {_DIRECT} AS chat FROM fx_prompts")
def direct_messages(spark, sf):
    return _prompts(spark, sf).select("row_id", _flat(P.direct_messages(*_parts())).alias("chat"))


@query(
    "retrieval_messages",
    "row_id:i chat:s",
    f"""SELECT row_id, 'system: ' || CASE WHEN source = 'PROMO' THEN {_SYSTEM.format('')} ELSE {_SYSTEM.format(_REFERENCE)} END
  || ' ### user: ' || CASE WHEN source = 'PROMO' THEN '' ELSE 'Reference Information:' || chr(10) || passage || chr(10) || chr(10) END
  || {_USER} AS chat FROM fx_prompts""",
)
def retrieval_messages(spark, sf):
    reference = F.when(F.col("source") != "PROMO", F.col("passage")).otherwise("")
    chat = P.retrieval_messages(*_parts(), reference=reference)
    return _prompts(spark, sf).select("row_id", _flat(chat).alias("chat"))


@query(
    "retry_messages",
    "row_id:i chat:s",
    f"""SELECT row_id, {_DIRECT} || ' ### assistant: ' || previous || ' ### user: Your answer ''' || previous
  || ''' is incorrect. Please reconsider and provide a different answer label.' AS chat FROM fx_prompts""",
)
def retry_messages(spark, sf):
    return _prompts(spark, sf).select("row_id", _flat(P.retry_messages(*_parts(), F.col("previous"))).alias("chat"))


@query(
    "confidence_messages",
    "row_id:i chat:s",
    f"""SELECT row_id, {_DIRECT} || ' ### assistant: ' || previous || ' ### user: You answered ' || previous
  || '. How confident are you in this answer on a scale of 0 to 100? Reply with ONLY a number between 0 and 100.' AS chat
FROM fx_prompts""",
)
def confidence_messages(spark, sf):
    return _prompts(spark, sf).select(
        "row_id", _flat(P.confidence_messages(*_parts(), F.col("previous"))).alias("chat")
    )


_STYLES = list(P.REFLECTION_STYLES.items())
_NAME_CASES = " ".join(f"WHEN {i} THEN '{n}'" for i, (n, _) in enumerate(_STYLES))
_TEXT_CASES = " ".join(f"WHEN {i} THEN '{t}'" for i, (_, t) in enumerate(_STYLES))


@query(
    "reflection_messages",
    "row_id:i reflection_pass:i style:s chat:s",
    f"""SELECT row_id, reflection_pass, CASE k {_NAME_CASES} END AS style,
  'system: ' || {_BRIEF} || ' ' || CASE k {_TEXT_CASES} END || ' ### user: ' || {_USER} AS chat
FROM (SELECT *, (unicode(previous) - 65 + reflection_pass - 1) % 4 AS k
      FROM fx_prompts, (SELECT unnest([1, 2]) AS reflection_pass) r)""",
)
def reflection_messages(spark, sf):
    rows = _prompts(spark, sf).withColumn("reflection_pass", F.explode(F.array(F.lit(1), F.lit(2))))
    style, turn = F.col("style_index"), F.col("reflection_pass")
    return rows.select(
        "row_id",
        "reflection_pass",
        P.reflection_style(style, turn).alias("style"),
        _flat(P.reflection_messages(*_parts(), style, turn)).alias("chat"),
    )


@query("strip_text", "row_id:i stripped:s", "SELECT row_id, t AS stripped FROM fx_stripped")
def strip_text(spark, sf):
    return inputs.long_texts(spark, sf).select("row_id", strip(F.col("question")).alias("stripped"))
