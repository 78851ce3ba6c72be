"""Six raw question shapes brought to one canonical row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from hedgewise.functions.common import draw_key, let, letter, strip

CANONICAL = [
    "row_id", "source", "task_type", "source_id", "question", "context", "choice_labels", "choice_texts",
    "gold_label", "gold_index", "gold_text", "explanation", "subject", "meta",
]


def _positional_labels(texts: Column) -> Column:
    return F.transform(texts, lambda _, i: letter(i))


def _stripped(items: Column) -> Column:
    return F.transform(items, lambda x: strip(x))


def _index_of(labels: Column, label: Column) -> Column:
    """0-based position of the label, null when it is not there."""
    return F.nullif(F.array_position(labels, label).cast("int"), F.lit(0)) - 1


def _canonical(df: DataFrame, **cols: Column) -> DataFrame:
    defaults = {c: F.lit(None).cast("string") for c in ("source_id", "context", "explanation", "subject")}
    defaults["meta"] = F.lit(None).cast("map<string,string>")
    picked = {**defaults, **cols}
    return df.select(*[picked[c].alias(c) if c in picked else F.col(c) for c in CANONICAL])


def normalize_choice_index(df: DataFrame, source: str = "MMLU") -> DataFrame:
    """``choices`` list and 0-based ``answer``; an index past the end leaves label and text null."""
    texts, at = F.col("choices"), F.col("answer").cast("int")
    labels = _positional_labels(texts)
    return _canonical(
        df,
        source=F.lit(source),
        task_type=F.lit("mcq"),
        question=strip(F.col("question")),
        choice_labels=labels,
        choice_texts=texts,
        gold_label=F.get(labels, at),
        gold_index=at,
        gold_text=F.get(texts, at),
        subject=strip(F.col("subject")),
    )


# A capital, an optional separator, then the text up to the end of the line.
PREFIXED = r"(?d)^\s*([A-Z])[).:\-]?\s*(.*)\s*$"
PREFIX_LETTERS = ["A", "B", "C", "D", "E", "F", "G", "H"]


def split_prefixed(option: Column, position: Column) -> Column:
    """(label, text) of an option such as ``B. 42``; without a usable prefix the position names it."""

    def parts(s: Column) -> Column:
        found = F.regexp_extract(s, PREFIXED, 1)
        return F.when(
            found.isin(*PREFIX_LETTERS), F.struct(found.alias("label"), F.regexp_extract(s, PREFIXED, 2).alias("text"))
        ).otherwise(F.struct(letter(position).alias("label"), s.alias("text")))

    return let(strip(option), parts)


def normalize_prefixed_options(df: DataFrame, source: str = "AQUA-RAT") -> DataFrame:
    """``options`` such as ``A)12`` and a letter in ``correct``."""
    rows = df.withColumn("_parsed", F.transform("options", split_prefixed))
    labels, texts = F.col("_parsed.label"), F.col("_parsed.text")
    gold = strip(F.col("correct"))
    return _canonical(
        rows,
        source=F.lit(source),
        task_type=F.lit("mcq_rationale"),
        question=strip(F.col("question")),
        choice_labels=labels,
        choice_texts=texts,
        gold_label=gold,
        gold_index=_index_of(labels, gold),
        gold_text=F.get(texts, _index_of(labels, gold)),
        explanation=strip(F.col("rationale")),
    )


def normalize_passage_mcq(df: DataFrame, source: str = "ReClor") -> DataFrame:
    """``answers`` with 0-based ``label`` and a reading passage."""
    texts, at = F.col("answers"), F.col("label").cast("int")
    labels = _positional_labels(texts)
    return _canonical(
        df,
        source=F.lit(source),
        task_type=F.lit("reading_comp_mcq"),
        source_id=strip(F.col("id_string")),
        question=strip(F.col("question")),
        context=strip(F.col("context")),
        choice_labels=labels,
        choice_texts=texts,
        gold_label=F.get(labels, at),
        gold_index=at,
        gold_text=F.get(texts, at),
    )


def normalize_map_options(df: DataFrame, source: str = "MedQA") -> DataFrame:
    """``options`` as a map label -> text, the answer's label in ``answer_idx`` and text in ``answer``."""
    labels = _stripped(F.map_keys("options"))
    texts = _stripped(F.map_values("options"))
    gold = strip(F.col("answer_idx"))
    return _canonical(
        df,
        source=F.lit(source),
        task_type=F.lit("mcq_medical"),
        question=strip(F.col("question")),
        context=strip(F.col("meta_info")),
        choice_labels=labels,
        choice_texts=texts,
        gold_label=gold,
        gold_index=_index_of(labels, gold),
        gold_text=strip(F.col("answer")),
        meta=F.create_map(F.lit("metamap_phrases"), F.to_json("metamap_phrases")),
    )


def normalize_struct_options(df: DataFrame, source: str = "ARC-Easy") -> DataFrame:
    """``choices`` as a struct of label and text arrays, the answer's label in ``answerKey``."""
    labels, texts = F.col("choices.label"), F.col("choices.text")
    gold = strip(F.col("answerKey"))
    return _canonical(
        df,
        source=F.lit(source),
        task_type=F.lit("mcq_science"),
        source_id=strip(F.col("id")),
        question=strip(F.col("question")),
        choice_labels=labels,
        choice_texts=texts,
        gold_label=gold,
        gold_index=_index_of(labels, gold),
        gold_text=F.get(texts, _index_of(labels, gold)),
    )


def normalize_scalar_options(df: DataFrame, source: str = "SciQ", shuffle_seed: int | None = None) -> DataFrame:
    """One right and three wrong columns. The right one comes first unless a seed shuffles each row."""
    texts = _stripped(F.array("correct_answer", "distractor1", "distractor2", "distractor3"))
    rows = df.withColumn("_gold", strip(F.col("correct_answer")))
    if shuffle_seed is not None:
        draws = F.array(*[draw_key(shuffle_seed + i, "row_id") for i in range(4)])
        mixed = F.array_sort(F.zip_with(draws, texts, lambda d, t: F.struct(d.alias("d"), t.alias("t"))))
        rows = rows.withColumn("_texts", F.transform(mixed, lambda m: m["t"]))
    else:
        rows = rows.withColumn("_texts", texts)
    at = _index_of(F.col("_texts"), F.col("_gold"))
    labels = _positional_labels(F.col("_texts"))
    return _canonical(
        rows,
        source=F.lit(source),
        task_type=F.lit("mcq_science"),
        question=strip(F.col("question")),
        context=strip(F.col("support")),
        choice_labels=labels,
        choice_texts=F.col("_texts"),
        gold_label=F.get(labels, at),
        gold_index=at,
        gold_text=F.col("_gold"),
        meta=F.create_map(
            F.lit("choice_order"),
            F.lit("constructed_from_correct_plus_distractors" if shuffle_seed is None else "shuffled"),
        ),
    )


def union_sources(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
