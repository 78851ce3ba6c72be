"""Building evaluation sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from hedgewise.functions.common import text_list
from hedgewise.operators import curation as C
from hedgewise.operators import normalize as N
from hedgewise.plans import inputs
from hedgewise.plans.catalog import VIEWS, query
from hedgewise.plans.label_queries import strip_sql

CANON = (
    "row_id:i source:s task_type:s source_id:s question:s context:s choice_labels:s choice_texts:s gold_label:s gold_index:i "
    "gold_text:s explanation:s subject:s"
)


def _shown(df):
    return df.withColumns({c: text_list(F.col(c)) for c in ("choice_labels", "choice_texts")})


def _letter():
    return F.char(F.col("answer") + 65)


def by_index(spark, sf):
    return N.normalize_choice_index(inputs.parts(spark, sf).withColumn("subject", F.col("kind")))


def prefixed(spark, sf):
    c = F.col
    options = F.array(
        F.concat(F.lit(" A)"), c("brand")), F.concat(F.lit("B. "), c("kind")), F.concat(F.lit("C: "), c("question")), c("size"), c("kind")
    )
    rows = inputs.parts(spark, sf).select("row_id", "question", options.alias("options"), _letter().alias("correct"), c("brand").alias("rationale"))
    return N.normalize_prefixed_options(rows)


def passage(spark, sf):
    rows = inputs.parts(spark, sf).select(
        "row_id", "question", F.col("brand").alias("id_string"), F.col("kind").alias("context"), F.col("choices").alias("answers"), F.col("answer").alias("label")
    )
    return N.normalize_passage_mcq(rows)


def mapped(spark, sf):
    options = F.map_from_arrays(inputs.labels(), F.col("choices"))
    rows = inputs.parts(spark, sf).select(
        "row_id", "question", F.col("kind").alias("meta_info"), options.alias("options"), _letter().alias("answer_idx"),
        F.get("choices", F.col("answer")).alias("answer"), F.array("brand").alias("metamap_phrases"),
    )
    return N.normalize_map_options(rows)


def struct(spark, sf):
    choices = F.struct(inputs.labels().alias("label"), F.col("choices").alias("text"))
    rows = inputs.parts(spark, sf).select("row_id", F.col("brand").alias("id"), "question", choices.alias("choices"), _letter().alias("answerKey"))
    return N.normalize_struct_options(rows)


def scalar(spark, sf, seed=None):
    rows = inputs.parts(spark, sf).select(
        "row_id", "question", F.col("brand").alias("correct_answer"), F.col("kind").alias("distractor1"),
        F.col("question").alias("distractor2"), F.col("size").alias("distractor3"), F.col("kind").alias("support"),
    )
    return N.normalize_scalar_options(rows, shuffle_seed=seed)


def everything(spark, sf):
    return N.union_sources(*[f(spark, sf) for f in (by_index, prefixed, passage, mapped, struct, scalar)])


_BASE = """row_id, '{source}' AS source, '{task}' AS task_type, {sid} AS source_id, question, {context} AS context, {labels} AS labels,
  {texts} AS texts, {gold} AS gold_label, {index} AS gold_index, {text} AS gold_text, {why} AS explanation, {subject} AS subject"""
_L4 = "['A','B','C','D']"
_LETTER = "chr(65 + answer)"
_KNOWN = "CASE WHEN answer < 4 THEN answer END"


def _canon(source, task, index, text, gold, sid="NULL", context="NULL", labels=_L4, texts="choices", why="NULL", subject="NULL", rows="fx_parts"):
    body = _BASE.format(source=source, task=task, sid=sid, context=context, labels=labels, texts=texts, gold=gold, index=index, text=text, why=why, subject=subject)
    return f"SELECT {body} FROM {rows}"


_KIND_SPLIT = "CASE WHEN kind[1] BETWEEN 'A' AND 'H' THEN kind[1] ELSE 'E' END"
VIEWS["fx_by_index"] = _canon("MMLU", "mcq", "answer", "choices[answer + 1]", f"CASE WHEN answer < 4 THEN {_LETTER} END", subject="kind")
VIEWS["fx_prefixed_rows"] = f"""SELECT *, ['A','B','C','D', {_KIND_SPLIT}] AS l5,
  [brand, kind, question, size, CASE WHEN kind[1] BETWEEN 'A' AND 'H' THEN ltrim(substr(kind, 2)) ELSE kind END] AS t5 FROM fx_parts"""
VIEWS["fx_prefixed"] = _canon(
    "AQUA-RAT", "mcq_rationale", f"nullif(list_position(l5, {_LETTER}), 0) - 1", f"t5[list_position(l5, {_LETTER})]", _LETTER,
    labels="l5", texts="t5", why="brand", rows="fx_prefixed_rows",
)
VIEWS["fx_passage_rows"] = _canon(
    "ReClor", "reading_comp_mcq", "answer", "choices[answer + 1]", f"CASE WHEN answer < 4 THEN {_LETTER} END", sid="brand", context="kind"
)
VIEWS["fx_mapped"] = _canon("MedQA", "mcq_medical", _KNOWN, "choices[answer + 1]", _LETTER, context="kind")
VIEWS["fx_struct"] = _canon("ARC-Easy", "mcq_science", _KNOWN, "choices[answer + 1]", _LETTER, sid="brand")
VIEWS["fx_scalar"] = _canon("SciQ", "mcq_science", "0", "brand", "'A'", context="kind", texts="[brand, kind, question, size]")
VIEWS["fx_canonical"] = " UNION ALL ".join(
    f"SELECT * FROM {v}" for v in ("fx_by_index", "fx_prefixed", "fx_passage_rows", "fx_mapped", "fx_struct", "fx_scalar")
)


def _canon_sql(view: str) -> str:
    return f"SELECT *, array_to_string(labels, '|') AS choice_labels, array_to_string(texts, '|') AS choice_texts FROM {view}"


@query("normalize_choice_index", CANON, _canon_sql("fx_by_index"))
def normalize_choice_index(spark, sf):
    return _shown(by_index(spark, sf))


@query("normalize_prefixed_options", CANON, _canon_sql("fx_prefixed"))
def normalize_prefixed_options(spark, sf):
    return _shown(prefixed(spark, sf))


@query("normalize_passage_mcq", CANON, _canon_sql("fx_passage_rows"))
def normalize_passage_mcq(spark, sf):
    return _shown(passage(spark, sf))


@query("normalize_map_options", CANON, _canon_sql("fx_mapped"))
def normalize_map_options(spark, sf):
    return _shown(mapped(spark, sf))


@query("normalize_struct_options", CANON, _canon_sql("fx_struct"))
def normalize_struct_options(spark, sf):
    return _shown(struct(spark, sf))


@query("normalize_scalar_options", CANON, _canon_sql("fx_scalar"))
def normalize_scalar_options(spark, sf):
    return _shown(scalar(spark, sf))


def draw_sql(seed: int, key: str = "row_id") -> str:
    return f"('0x' || substr(md5('{seed}:' || {key}), 1, 15))::BIGINT"


_DRAWS = ", ".join(f"{{'d': {draw_sql(7 + i)}, 't': texts[{i + 1}]}}" for i in range(4))
VIEWS["fx_shuffled"] = f"""
SELECT row_id, gold_text, list_transform(list_sort([{_DRAWS}]), lambda m: m.t) AS texts FROM fx_scalar"""


@query(
    "normalize_scalar_options_shuffled",
    "row_id:i choice_texts:s gold_label:s gold_index:i",
    """SELECT row_id, array_to_string(texts, '|') AS choice_texts, chr(64 + list_position(texts, gold_text)::INT) AS gold_label,
  list_position(texts, gold_text) - 1 AS gold_index FROM fx_shuffled""",
)
def normalize_scalar_options_shuffled(spark, sf):
    return _shown(scalar(spark, sf, seed=7))


@query("union_sources", CANON, _canon_sql("fx_canonical"))
def union_sources(spark, sf):
    return _shown(everything(spark, sf))


# ---------------------------------------------------------------- fingerprints, sampling, splits


def fingerprint_sql(question: str, chars: int | None = 200) -> str:
    return f"md5(lower({strip_sql(f'substr({question}, 1, {chars})' if chars else question)}))"


@query(
    "question_fingerprint",
    "row_id:i fingerprint:s whole_text:s",
    f"SELECT row_id, {fingerprint_sql('question')} AS fingerprint, {fingerprint_sql('question', None)} AS whole_text FROM fx_all_questions",
)
def question_fingerprint(spark, sf):
    rows = C.with_fingerprint(inputs.all_questions(spark, sf), 200)  # both forms side by side
    return rows.withColumn("whole_text", C.question_fingerprint(F.col("question"), None))


def _dedup_sql(chars: int | None) -> str:
    fp = fingerprint_sql("question", chars)
    return f"SELECT row_id, source, {fp} AS fingerprint FROM fx_newcomers WHERE {fp} NOT IN (SELECT {fp} FROM fx_pool)"


@query("dedup_against_pool", "row_id:i source:s fingerprint:s", _dedup_sql(None))
def dedup_against_pool(spark, sf):
    return C.dedup_against_pool(inputs.newcomers(spark, sf), inputs.pool(spark, sf))


@query("dedup_against_pool_whole_text", "row_id:i source:s fingerprint:s", _dedup_sql(None))
def dedup_against_pool_whole_text(spark, sf):
    return C.dedup_against_pool(inputs.newcomers(spark, sf), inputs.pool(spark, sf), None)


@query(
    "dedup_report",
    "available:i excluded:i available_distinct:i",
    f"""SELECT count(*) FILTER (NOT known) AS available, count(*) FILTER (known) AS excluded,
  count(DISTINCT fp) FILTER (NOT known) AS available_distinct
FROM (SELECT fp, fp IN (SELECT {fingerprint_sql('question', None)} FROM fx_pool) AS known
      FROM (SELECT {fingerprint_sql('question', None)} AS fp FROM fx_newcomers))""",
)
def dedup_report(spark, sf):
    return C.dedup_report(inputs.newcomers(spark, sf), inputs.pool(spark, sf))


@query(
    "drop_repeats",
    "row_id:i fingerprint:s",
    f"SELECT min(row_id) AS row_id, fp AS fingerprint FROM (SELECT row_id, {fingerprint_sql('question', None)} AS fp FROM fx_all_questions) GROUP BY fp",
)
def drop_repeats(spark, sf):
    return C.drop_repeats(inputs.all_questions(spark, sf).select("row_id", "question"))


@query(
    "sample_n_per_source",
    "row_id:i source:s",
    f"SELECT row_id, source FROM (SELECT row_id, source, row_number() OVER (PARTITION BY source ORDER BY {draw_sql(42)}, row_id) AS k FROM fx_all_questions) WHERE k <= 25",
)
def sample_n_per_source(spark, sf):
    return C.sample_n_per_source(inputs.all_questions(spark, sf).select("row_id", "source"), 25)


def _quota_sql(rows: str, stratum: str, share: str, wanted: str, name: str, key: str = "") -> str:
    part = f"PARTITION BY {key}" if key else ""
    exact = f"(({wanted}) * {share} / (sum({share}) OVER ({part})))"
    return f"""SELECT *, floor(exact)::BIGINT + (row_number() OVER ({part} ORDER BY exact - floor(exact) DESC, {stratum})
    <= ({wanted}) - sum(floor(exact)) OVER ({part}))::BIGINT AS {name} FROM (SELECT *, {exact} AS exact FROM ({rows}))"""


_SIZES = "SELECT source, count(*) AS n FROM fx_all_questions GROUP BY source"
_HELD = f"SELECT source, n, held FROM ({_quota_sql(_SIZES, 'source', 'n', '600', 'held')})"
_TEST = f"SELECT source, held, test FROM ({_quota_sql(_HELD, 'source', 'held', '300', 'test')})"


@query(
    "stratified_split3",
    "row_id:i source:s split:s",
    f"""SELECT row_id, source, CASE WHEN k <= test THEN 'test' WHEN k <= held THEN 'validation' ELSE 'train' END AS split
FROM (SELECT row_id, source, row_number() OVER (PARTITION BY source ORDER BY {draw_sql(42)}, row_id) AS k FROM fx_all_questions)
JOIN ({_TEST}) USING (source)""",
)
def stratified_split3(spark, sf):
    return C.stratified_split3(inputs.all_questions(spark, sf).select("row_id", "source"))


def holdout_sql(rows: str, label: str, key: str = "") -> str:
    """The 80/20 split by label, within each value of ``key`` if one is named."""
    keyed, part = (f"{key}, ", f"PARTITION BY {key}") if key else ("", "")
    sizes = f"""SELECT {keyed}{label}, n, ceil(sum(n) OVER ({part}) * 0.2::DOUBLE) AS want
    FROM (SELECT {keyed}{label}, count(*) AS n FROM {rows} GROUP BY {keyed}{label})"""
    held = _quota_sql(sizes, label, "n", "want", "held", key)
    return f"""SELECT {keyed}row_id, {label}, CASE WHEN k <= held THEN 'test' ELSE 'train' END AS split
FROM (SELECT {keyed}row_id, {label}, row_number() OVER (PARTITION BY {keyed}{label} ORDER BY {draw_sql(42)}, row_id) AS k FROM {rows})
JOIN (SELECT {keyed}{label}, held FROM ({held})) USING ({keyed}{label})"""


@query("stratified_holdout", "row_id:i target:i split:s", holdout_sql("fx_questions", "target"))
def stratified_holdout(spark, sf):
    return C.stratified_holdout(inputs.questions(spark, sf).select("row_id", "target"), "target")


def folds_sql(rows: str, label: str, folds: int, order: str, key: str = "") -> str:
    keyed = f"{key}, " if key else ""
    return f"""SELECT {keyed}row_id, {label}, (row_number() OVER (PARTITION BY {keyed}{label} ORDER BY {order}) - 1) % {folds} AS fold FROM {rows}"""


@query("stratified_folds", "row_id:i target:i fold:i", folds_sql("fx_questions", "target", 5, f"{draw_sql(42)}, row_id"))
def stratified_folds(spark, sf):
    return C.stratified_folds(inputs.questions(spark, sf).select("row_id", "target"), "target")


@query("stratified_folds_unshuffled", "row_id:i target:i fold:i", folds_sql("fx_questions", "target", 3, "row_id"))
def stratified_folds_unshuffled(spark, sf):
    return C.stratified_folds(inputs.questions(spark, sf).select("row_id", "target"), "target", 3, None)


@query("hash_folds", "row_id:i fold:i", f"SELECT row_id, {draw_sql(42)} % 5 AS fold FROM fx_all_questions")
def hash_folds(spark, sf):
    return C.hash_folds(inputs.all_questions(spark, sf).select("row_id"))


# ---------------------------------------------------------------- checks and profiles

VIEWS["fx_checked"] = """
SELECT *, len(labels) = len(texts) AND len(labels) >= 2 AS valid_choices,
  (gold_index IS NULL OR (gold_index < len(texts) AND texts[gold_index + 1] IS NOT DISTINCT FROM gold_text))
  AND (gold_label IS NULL OR NOT list_contains(labels, gold_label)
       OR texts[list_position(labels, gold_label)] IS NOT DISTINCT FROM gold_text) AS valid_gold,
  question IS NULL OR trim(question) = '' AS bad_question FROM fx_canonical"""


@query("check_choices", "row_id:i source:s valid_choices:b", "SELECT * FROM fx_checked")
def check_choices(spark, sf):
    return C.with_checks(everything(spark, sf))


@query("check_gold", "row_id:i source:s valid_gold:b", "SELECT * FROM fx_checked")
def check_gold(spark, sf):
    return C.with_checks(everything(spark, sf))


@query(
    "check_question",
    "row_id:i bad_question:b",
    f"SELECT row_id, {strip_sql('reply')} = '' AS bad_question FROM fx_messages",
)
def check_question(spark, sf):
    from hedgewise.functions.text import is_blank

    return inputs.messages(spark, sf).select("row_id", is_blank(F.col("reply")).alias("bad_question"))


@query(
    "health_summary",
    "n:i invalid_choices:i invalid_gold:i empty_questions:i any_issue:i sample_bad_row:i",
    """SELECT count(*) AS n, count(*) FILTER (NOT valid_choices) AS invalid_choices, count(*) FILTER (NOT valid_gold) AS invalid_gold,
  count(*) FILTER (bad_question) AS empty_questions, count(*) FILTER (NOT valid_choices OR NOT valid_gold OR bad_question) AS any_issue,
  min(row_id) FILTER (NOT valid_choices OR NOT valid_gold OR bad_question) AS sample_bad_row FROM fx_checked""",
)
def health_summary(spark, sf):
    return C.health_summary(everything(spark, sf))


_MISSING = ["source_id", "context", "gold_label", "gold_index", "gold_text", "explanation", "subject", "question"]


@query(
    "missing_by_column",
    "column_name:s n_missing:i",
    " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS n_missing FROM fx_canonical" for c in _MISSING),
)
def missing_by_column(spark, sf):
    return C.missing_by_column(everything(spark, sf).select(*_MISSING))


_DOC = {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint"}


def _profile_sql(column: str, kind: str) -> str:
    length = f"length({column})" if kind == "string" else "NULL"
    return f"""SELECT '{column}' AS column_name, '{kind}' AS dtype, count(*) FILTER ({column} IS NULL) AS n_missing,
  count(DISTINCT {column}) AS n_unique, min({column}::VARCHAR) AS sample_value, min({length}) AS min_length,
  max({length}) AS max_length FROM documents"""


@query(
    "profile_columns",
    "column_name:s dtype:s n_missing:i n_unique:i sample_value:s min_length:i max_length:i",
    " UNION ALL ".join(_profile_sql(c, k) for c, k in _DOC.items()),
)
def profile_columns(spark, sf):
    return C.profile_columns(inputs.table(spark, sf, "documents"))


@query(
    "profile_values",
    "column_name:s value:s n:i",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, {c} AS value, count(*) AS n FROM documents GROUP BY ALL HAVING (SELECT count(DISTINCT {c}) FROM documents) <= 20"
        for c in ("lang", "source", "text")
    ),
)
def profile_values(spark, sf):
    return C.profile_values(inputs.table(spark, sf, "documents"))


@query(
    "profile_lengths",
    "column_name:s length:i n:i",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, length({c}) AS length, count(*) AS n FROM documents GROUP BY ALL" for c in ("lang", "source", "text")
    ),
)
def profile_lengths(spark, sf):
    return C.profile_lengths(inputs.table(spark, sf, "documents"))


@query(
    "profile_lists",
    "column_name:s dtype:s n_missing:i n_unique:i min_length:i max_length:i",
    """SELECT 'choices' AS column_name, 'array<string>' AS dtype, 0 AS n_missing, count(DISTINCT choices::VARCHAR) AS n_unique,
  min(len(choices)) AS min_length, max(len(choices)) AS max_length FROM fx_parts""",
)
def profile_lists(spark, sf):
    return C.profile_columns(inputs.parts(spark, sf).select("choices"))


@query(
    "group_count_stats",
    "n_groups:i min_size:i max_size:i mean_size:d",
    "SELECT count(*) AS n_groups, min(n) AS min_size, max(n) AS max_size, avg(n) AS mean_size FROM (SELECT source, count(*) AS n FROM documents GROUP BY source)",
)
def group_count_stats(spark, sf):
    return C.group_count_stats(inputs.table(spark, sf, "documents").select("source"), "source")


@query(
    "group_extremes",
    "source:s n:i extreme:s",
    """WITH g AS (SELECT source, count(*) AS n FROM documents GROUP BY source)
(SELECT source, n, 'largest' AS extreme FROM g ORDER BY n DESC, source LIMIT 5) UNION ALL
(SELECT source, n, 'smallest' AS extreme FROM g ORDER BY n, source LIMIT 5)""",
)
def group_extremes(spark, sf):
    return C.group_extremes(inputs.table(spark, sf, "documents").select("source"), "source")


@query(
    "value_counts",
    "value:s n:i",
    "SELECT gold_label AS value, count(*) AS n FROM fx_canonical GROUP BY ALL",
)
def value_counts(spark, sf):
    return C.value_counts(everything(spark, sf), F.col("gold_label"))


@query(
    "value_counts_options",
    "value:i n:i",
    "SELECT len(texts) AS value, count(*) AS n FROM fx_canonical GROUP BY ALL",
)
def value_counts_options(spark, sf):
    return C.value_counts(everything(spark, sf), F.size("choice_texts"))
