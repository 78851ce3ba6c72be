"""Signals from logits and log-probabilities."""

from __future__ import annotations

from pyspark.sql import functions as F

from hedgewise.functions import logits as L
from hedgewise.functions.common import letter, text_list
from hedgewise.operators import features
from hedgewise.plans import inputs
from hedgewise.plans.catalog import VIEWS, query

ID = "model:i row_id:i"


def _numbers(values):
    """Rounded numbers as text, so that arrays compare exactly."""
    return text_list(F.transform(values, lambda x: F.format_string("%.5f", x + 0.0)))


NUMBERS = "array_to_string(list_transform({0}, lambda x: printf('%.5f', x + 0.0)), '|')"


@query(
    "log_softmax",
    ID + " position:i logprob:d",
    """SELECT model, row_id, unnest([0,1,2,3,4,5,6,7]) AS position,
  unnest(list_transform(ex8, lambda x: ln(x / list_sum(ex8)))) AS logprob FROM fx_spread""",
)
def log_softmax(spark, sf):
    return inputs.logits(spark, sf).select("model", "row_id", F.posexplode(L.log_softmax(F.col("vocab"))).alias("position", "logprob"))


@query(
    "entropy_from_logits",
    ID + " entropy:d",
    "SELECT model, row_id, -list_sum(list_transform(p8, lambda x: x * ln(x))) AS entropy FROM fx_probs",
)
def entropy_from_logits(spark, sf):
    return inputs.logits(spark, sf).select("model", "row_id", L.entropy_from_logits(F.col("vocab")).alias("entropy"))


@query(
    "vocab_entropy",
    "model:i source:s n:i mean_entropy:d",
    "SELECT model, source, count(*) AS n, avg(entropy_over_vocab) AS mean_entropy FROM fx_direct GROUP BY ALL",
)
def vocab_entropy(spark, sf):
    return inputs.direct(spark, sf).groupBy("model", "source").agg(
        F.count(F.lit(1)).alias("n"), F.avg("entropy_over_vocab").alias("mean_entropy")
    )


@query(
    "topk_logprobs",
    ID + " k1:d k2:d k5:d k9:d",
    """SELECT model, row_id, l[1] AS k1, l[2] AS k2, l[5] AS k5, NULL AS k9 FROM (
  SELECT model, row_id, list_reverse_sort(list_transform(p8, lambda x: ln(x))) AS l FROM fx_probs)""",
)
def topk_logprobs(spark, sf):
    t = inputs.logits(spark, sf).select("model", "row_id", L.topk_logprobs(F.col("vocab"), 9).alias("t"))
    return t.select("model", "row_id", *[F.get("t", F.lit(k - 1)).alias(f"k{k}") for k in (1, 2, 5, 9)])


@query(
    "topk_logits_long",
    ID + " step:i token_id:i logit:d token_rank:i",
    """SELECT model, row_id, step, token_id, logit, token_rank FROM (
  SELECT *, row_number() OVER (PARTITION BY model, row_id, step ORDER BY logit DESC, token_id) AS token_rank FROM (
    SELECT model, row_id, step, unnest([0,1,2,3,4,5,6,7]) AS token_id, unnest(logits) AS logit FROM fx_steps))
WHERE token_rank <= 5""",
)
def topk_logits_long(spark, sf):
    long = inputs.steps(spark, sf).select("model", "row_id", "step", F.posexplode("logits").alias("token_id", "logit"))
    return features.topk_long(long, ["model", "row_id", "step"], 5)


@query(
    "generation_signals",
    ID + " first_token_entropy:d avg_entropy:d perplexity:d chosen_token_prob:d top_logprob:d fifth_logprob:d",
    "SELECT *, top5[1] AS top_logprob, top5[5] AS fifth_logprob FROM fx_generations",
)
def generation_signals(spark, sf):
    g = inputs.generations(spark, sf)
    top = F.col("first_token_top5_logprobs")
    return g.withColumns({"top_logprob": F.get(top, F.lit(0)), "fifth_logprob": F.get(top, F.lit(4))})


VIEWS["fx_label_scores"] = """
SELECT model, row_id, k AS k, substr('ABCD', k, 1) AS label, ln(p8[k] + p8[k + 4]) AS score
FROM fx_probs, (SELECT unnest([1,2,3,4]) AS k) s"""


@query("label_scores", ID + " label:s score:d", "SELECT model, row_id, label, score FROM fx_label_scores")
def label_scores(spark, sf):
    rows = inputs.logits(spark, sf)
    tokens = rows.select("model", "row_id", F.posexplode(L.log_softmax(F.col("vocab"))).alias("token_id", "logprob"))
    # Token t spells label t mod 4: every label has two spellings, as "A" and " A" do.
    spelling = rows.select(F.explode(F.sequence(F.lit(0), F.size("vocab") - 1)).alias("token_id")).distinct()
    spelling = spelling.withColumn("label", letter(F.pmod("token_id", F.lit(4))))
    return features.label_scores(tokens, spelling, ["model", "row_id"])


@query(
    "label_scores_prediction",
    ID + " pred:s top1_prob:d margin:d",
    """SELECT model, row_id, arg_max(label, score) AS pred, max(w) AS top1_prob, max(w) - list_reverse_sort(list(w))[2] AS margin
FROM (SELECT *, exp(score) / sum(exp(score)) OVER (PARTITION BY model, row_id) AS w FROM fx_label_scores) GROUP BY ALL""",
)
def label_scores_prediction(spark, sf):
    wide = features.label_score_arrays(label_scores(spark, sf), ["model", "row_id"], ["A", "B", "C", "D", "E"])
    labels = F.array(*[F.lit(x) for x in "ABCDE"])
    d = wide.withColumn("d", L.label_distribution(F.col("scores"), labels))
    return d.select("model", "row_id", "d.pred", "d.top1_prob", "d.margin")


@query(
    "label_scores_wide",
    ID + " label:s score:d",
    "SELECT model, row_id, label, score FROM fx_label_scores UNION ALL SELECT model, row_id, 'E', NULL FROM fx_logits",
)
def label_scores_wide(spark, sf):
    sets = [("A", [0, 4]), ("B", [1, 5]), ("C", [2, 6]), ("D", [3, 7]), ("E", [])]
    scores = features.label_scores_wide(L.log_softmax(F.col("vocab")), sets)
    rows = inputs.logits(spark, sf).select("model", "row_id", F.posexplode(scores).alias("k", "s"))
    finite = F.when(F.col("s") > float("-inf"), F.col("s"))
    return rows.select("model", "row_id", letter(F.col("k")).alias("label"), finite.alias("score"))


@query(
    "label_distribution",
    ID + " source:s gold_label:s pred_by_probs:s correct_by_probs:i top1_prob:d top2_prob:d margin:d probs:s",
    f"SELECT *, {NUMBERS.format('p')} AS probs FROM fx_direct JOIN (SELECT model, row_id, p FROM fx_probs) USING (model, row_id)",
)
def label_distribution(spark, sf):
    d = inputs._direct(inputs.logits(spark, sf), F.col("logits"), F.col("vocab"))
    return d.withColumn("probs", _numbers(L.softmax(F.col("logits"))))


@query("label_entropy", ID + " entropy_over_labels:d", "SELECT * FROM fx_direct")
def label_entropy(spark, sf):
    return inputs.logits(spark, sf).select(
        "model", "row_id", L.smoothed_entropy(L.softmax(F.col("logits"))).alias("entropy_over_labels")
    )


VIEWS["fx_shape_base"] = """
SELECT model, row_id, top5, list_avg(top5) AS m, list_sum(list_transform(top5, lambda x: exp(x))) AS z
FROM fx_generations WHERE top5 IS NOT NULL"""
VIEWS["fx_shape"] = """
SELECT model, row_id, exp(top5[1]) - exp(top5[2]) AS top2_margin,
  -list_sum(list_transform(top5, lambda x: exp(x)/z * ln(exp(x)/z))) AS top5_entropy,
  sqrt(list_avg(list_transform(top5, lambda x: (x-m)*(x-m)))) AS dist_std,
  list_avg(list_transform(top5, lambda x: (x-m)*(x-m)*(x-m)*(x-m)))
    / pow(list_avg(list_transform(top5, lambda x: (x-m)*(x-m))), 2) - 3 AS dist_kurtosis
FROM fx_shape_base"""


@query(
    "top5_features",
    ID + " top2_margin:d top5_entropy:d dist_std:d dist_kurtosis:d",
    "SELECT model, row_id, top2_margin, top5_entropy, dist_std, dist_kurtosis FROM fx_logits LEFT JOIN fx_shape USING (model, row_id)",
)
def top5_features(spark, sf):
    shape = L.top5_features(F.col("first_token_top5_logprobs"))
    return inputs.generations(spark, sf).withColumn("_s", shape).select("model", "row_id", "_s.*")


@query(
    "prob_margin",
    ID + " prob_margin:d",
    "SELECT model, row_id, 1 - chosen_token_prob AS prob_margin FROM fx_generations",
)
def prob_margin(spark, sf):
    return inputs.generations(spark, sf).select("model", "row_id", (1.0 - F.col("chosen_token_prob")).alias("prob_margin"))


@query(
    "target_label",
    "model:i source:s n:i wrong:i",
    "SELECT model, source, count(*) AS n, sum(1 - correct_by_probs) AS wrong FROM fx_direct GROUP BY ALL",
)
def target_label(spark, sf):
    d = inputs.direct(spark, sf).withColumn("t", features.target_label(F.col("correct_by_probs") == 1))
    return d.groupBy("model", "source").agg(F.count(F.lit(1)).alias("n"), F.sum("t").alias("wrong"))
