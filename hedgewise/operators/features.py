"""Generation signals and the router's feature matrix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from hedgewise.functions.common import WORD, safe_text
from hedgewise.functions.logits import (
    entropy_from_logits,
    label_distribution,
    log_sum_exp,
    smoothed_entropy,
    softmax,
    top5_features,
    topk_logprobs,
)
from hedgewise.functions.text import basic_text, capitalised_phrases, keyword_flags
from hedgewise.session import join_small

BASE_FEATURES = 22
PCA_FEATURES = 16


def step_signals(steps: DataFrame, k: int = 5) -> DataFrame:
    """Entropy, NLL and top-k of each generation step; the vector itself is dropped here.

    A step without a chosen token lies past the shorter of the two recordings and is left out.
    """
    v = F.col("logits")
    kept = steps.filter(F.col("token_id").isNotNull() & v.isNotNull())
    return kept.select(
        *[c for c in steps.columns if c not in ("logits", "token_id")],
        entropy_from_logits(v).alias("step_entropy"),
        (log_sum_exp(v) - F.get(v, F.col("token_id"))).alias("step_nll"),
        topk_logprobs(v, k).alias("step_topk"),
    )


def generation_signals(steps: DataFrame, rows: DataFrame, keys: list[str], k: int = 5) -> DataFrame:
    """Five signals per generation; generations without steps are all missing.

    Each step shrinks to a few numbers before the shuffle on the row key. The top-k travel as
    single numbers, which keeps the aggregate a hash aggregate.
    """
    first = lambda c: F.min_by(c, "step")
    top = [f"_top{i}" for i in range(k)]
    numbers = step_signals(steps, k).withColumns({t: F.get("step_topk", F.lit(i)) for i, t in enumerate(top)})
    per_row = numbers.groupBy(*keys).agg(
        first("step_entropy").alias("first_token_entropy"),
        F.avg("step_entropy").alias("avg_entropy"),
        F.exp(F.avg("step_nll")).alias("perplexity"),
        F.exp(-first("step_nll")).alias("chosen_token_prob"),
        *[first(t).alias(t) for t in top],
    )
    per_row = per_row.withColumn("first_token_top5_logprobs", F.array(*top)).drop(*top)
    return rows.join(per_row, keys, "left")


def topk_long(logits: DataFrame, keys: list[str], k: int = 5) -> DataFrame:
    """Top-k of logits kept one row per token; Spark cuts each task to k before the shuffle."""
    order = Window.partitionBy(*keys).orderBy(F.desc("logit"), "token_id")
    return logits.withColumn("token_rank", F.row_number().over(order)).filter(F.col("token_rank") <= k)


def label_scores(token_logprobs: DataFrame, label_tokens: DataFrame, keys: list[str]) -> DataFrame:
    """Log-sum-exp over the tokens that spell each label; a label without tokens scores -inf.

    ``token_logprobs``: keys, token_id, logprob. ``label_tokens``: label, token_id (a small table).
    """
    wanted = join_small(token_logprobs, label_tokens, ["token_id"], "inner")
    peak = wanted.groupBy(*keys, "label").agg(F.max("logprob").alias("_max"), F.collect_list("logprob").alias("_lp"))
    scored = peak.select(*keys, "label", log_sum_exp(F.col("_lp")).alias("score"))
    return scored


def label_score_arrays(scores: DataFrame, keys: list[str], labels: list[str], missing: str = "neg_inf") -> DataFrame:
    """One row per key with ``scores`` in the order of ``labels``.

    A label none of whose tokens was recorded scores -inf, or fails with ``missing="error"``.
    """
    if missing not in ("neg_inf", "error"):
        raise ValueError(f"unknown rule {missing!r}")
    absent = F.lit(float("-inf"))
    columns = []
    for label in labels:
        found = F.max(F.when(F.col("label") == label, F.col("score")))
        gap = absent if missing == "neg_inf" else F.raise_error(F.lit(f"no token for label {label}")).cast("double")
        columns.append(F.when(found.isNotNull(), found).otherwise(gap))
    return scores.groupBy(*keys).agg(F.array(*columns).alias("scores"))


def label_scores_wide(logprobs: Column, token_sets: list[tuple[str, list[int]]]) -> Column:
    """The same from a whole log-probability vector, without leaving the row."""
    scores = []
    for _, tokens in token_sets:
        picked = F.array(*[F.get(logprobs, F.lit(t)) for t in tokens])
        scores.append(log_sum_exp(picked) if tokens else F.lit(float("-inf")))
    return F.array(*scores)


def direct_pass(rows: DataFrame, scores: Column, labels: Column, gold: Column, vocab: Column) -> DataFrame:
    """The first-pass table: prediction, its signals and its correctness, all from one row."""
    d = rows.withColumn("_d", label_distribution(scores, labels)).withColumn("_gold", gold)
    return d.select(
        *rows.columns,
        F.col("_gold").alias("gold_label"),
        F.col("_d.pred").alias("pred_by_probs"),
        F.coalesce(F.col("_d.pred") == F.col("_gold"), F.lit(False)).cast("int").alias("correct_by_probs"),
        F.col("_d.top1_prob").alias("top1_prob"),
        F.col("_d.top2_prob").alias("top2_prob"),
        F.col("_d.margin").alias("margin"),
        F.col("_d.entropy").alias("entropy_over_labels"),
        smoothed_entropy(softmax(vocab)).alias("entropy_over_vocab"),
    )


def token_class_shares(questions: DataFrame, lexicon: DataFrame, text: str = "question") -> DataFrame:
    """Share of noun-like and verb-like tokens per row, and the number of capitalised phrases.

    The lexicon (token, token_class) is user data; a token listed under several classes counts once for
    each share and once in the total. Tokens of a row meet in one task, so the
    aggregate sends one row per question. No tokens give 0.
    """
    tokens = questions.select(
        "row_id", F.explode(F.regexp_extract_all(F.lower(safe_text(F.col(text))), F.lit(f"({WORD}+)"), F.lit(1))).alias("token")
    )
    listed = lambda *names: F.max(F.col("token_class").isin(*names))
    classes = lexicon.groupBy("token").agg(listed("NOUN", "PROPN").alias("noun"), listed("VERB", "AUX").alias("verb"))
    known = join_small(tokens, classes, ["token"], "left")
    shares = known.groupBy("row_id").agg(
        (F.count_if("noun").cast("double") / F.count(F.lit(1))).alias("_noun"),
        (F.count_if("verb").cast("double") / F.count(F.lit(1))).alias("_verb"),
    )
    phrases = F.size(capitalised_phrases(safe_text(F.col(text)))).cast("double")
    zero = F.lit(0.0)
    return (
        questions.select("row_id", phrases.alias("feat_entity_count"))
        .join(shares, "row_id", "left")
        .select(
            "row_id",
            "feat_entity_count",
            F.coalesce("_noun", zero).alias("feat_noun_ratio"),
            F.coalesce("_verb", zero).alias("feat_verb_ratio"),
        )
    )


def target_label(is_correct: Column) -> Column:
    """1 where the model was wrong."""
    return (~is_correct).cast("int")


# The columns of a router matrix without components.
FEATURE_NAMES = """
feat_char_count feat_word_count feat_avg_word_len feat_punct_count feat_has_negation feat_negation_count feat_has_comparison
feat_comparison_count feat_has_quant feat_quant_count feat_entity_count feat_noun_ratio feat_verb_ratio feat_first_token_entropy
feat_avg_entropy feat_perplexity feat_chosen_token_prob feat_prob_margin feat_top2_margin feat_top5_entropy feat_dist_kurtosis
feat_dist_std
""".split()


def model_features() -> dict[str, Column]:
    signals = ["first_token_entropy", "avg_entropy", "perplexity", "chosen_token_prob"]
    shape = F.col("_shape")
    return {
        **{f"feat_{s}": F.col(s).cast("double") for s in signals},
        "feat_prob_margin": 1.0 - F.col("chosen_token_prob").cast("double"),
        **{f"feat_{s}": shape[s] for s in ("top2_margin", "top5_entropy", "dist_kurtosis", "dist_std")},
    }


def build_router_matrix(
    inference: DataFrame, lexicon: DataFrame, components: DataFrame | None = None, question: str = "original_question",
    questions: DataFrame | None = None,
) -> DataFrame:
    """All inference columns, ``target_label`` and 22 ``feat_*`` columns (38 with components).

    Text features are worked out once per question and joined to the answers by ``row_id``; ``questions`` (row_id and
    question) says which questions there are, without it they are taken from the answers. Components are joined on
    the columns they share with the answers (row_id, model).
    """
    text = F.col(question)
    answers = inference.withColumn("_shape", top5_features(F.col("first_token_top5_logprobs"))).select(
        *inference.columns, target_label(F.col("is_correct")).alias("target_label"), *[c.alias(n) for n, c in model_features().items()]
    )
    asked = inference.select("row_id", question).dropDuplicates(["row_id"]) if questions is None else questions
    described = asked.select("row_id", *[c.alias(n) for n, c in {**basic_text(text), **keyword_flags(text)}.items()])
    matrix = answers.join(described, "row_id").join(token_class_shares(asked, lexicon, question), "row_id")
    expected = BASE_FEATURES
    if components is not None:
        shared = [c for c in ("model", "row_id") if c in components.columns]
        matrix = matrix.join(components, shared, "left")  # a row without a vector stays, its components missing
        expected += PCA_FEATURES
    found = len(feature_columns(matrix))
    if found != expected:
        raise ValueError(f"{found} feature columns instead of {expected}")
    return matrix


def feature_columns(df: DataFrame, drop_prefixes: tuple[str, ...] = ()) -> list[str]:
    """Sorted ``feat_*`` names without the given prefixes; none left is an error."""
    names = sorted(c for c in df.columns if c.startswith("feat_") and not c.startswith(tuple(drop_prefixes)))
    if not names:
        raise ValueError("no feat_ columns left")
    return names


def feature_name_list(df: DataFrame) -> DataFrame:
    """The feature names in matrix order with how many rows have a value, in one aggregate."""
    names = feature_columns(df)
    counts = df.agg(*[F.count(n).alias(n) for n in names]).unpivot([], names, "feature", "n_present")
    order = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("feature")).cast("int") - 1
    return counts.withColumn("position", order)


