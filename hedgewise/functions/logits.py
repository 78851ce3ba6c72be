"""Uncertainty signals from recorded logits and log-probabilities (array columns)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from hedgewise.functions.common import finite, let, missing_if_nan, total

NEG_INF = float("-inf")


def log_sum_exp(values: Column) -> Column:
    """Stable log of the summed exponentials; all -inf stays -inf."""

    def shifted(arr: Column) -> Column:
        return let(
            F.array_max(arr),
            lambda mx: F.when(mx == NEG_INF, mx).otherwise(
                mx + F.ln(F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + F.exp(x - mx)))
            ),
        )

    return let(values, shifted)


def log_softmax(values: Column) -> Column:
    return let(log_sum_exp(values), lambda lse: F.transform(values, lambda x: x - lse))


def softmax(values: Column) -> Column:
    return F.transform(log_softmax(values), lambda x: F.exp(x))


def entropy_from_logits(values: Column) -> Column:
    """Shannon entropy in nats; undefined (null) when the distribution is."""
    return missing_if_nan(
        let(
            log_sum_exp(values),
            lambda lse: F.aggregate(values, F.lit(0.0), lambda acc, x: acc - F.exp(x - lse) * (x - lse)),
        )
    )


def smoothed_entropy(probs: Column, eps: float = 1e-12) -> Column:
    """Entropy of given probabilities with the small constant inside the logarithm."""
    return F.aggregate(probs, F.lit(0.0), lambda acc, p: acc - p * F.ln(p + F.lit(eps)))


def topk_logprobs(values: Column, k: int = 5) -> Column:
    """The k largest log-probabilities, descending, padded with nulls."""
    best = F.slice(F.sort_array(values, asc=False), 1, k)
    lse = log_sum_exp(values)
    padded = F.slice(F.concat(best, F.array_repeat(F.lit(None).cast("double"), k)), 1, k)
    return let(lse, lambda z: F.transform(padded, lambda x: x - z))


def label_distribution(scores: Column, labels: Column) -> Column:
    """Softmax over the labels as a struct.

    Fields: ``probs, pred, top1_label, top1_prob, top2_label, top2_prob, margin, entropy``.
    The first label wins ties; one label leaves the margin null; no usable score leaves all null.
    """

    def fields(probs: Column) -> Column:
        def ranked(top: Column) -> Column:
            best, next_best = F.get(top, F.lit(0)), F.get(top, F.lit(1))
            at = F.array_position(probs, best).cast("int")
            rest = F.slice(probs, at + 1, F.size(probs))
            tied = at + F.array_position(rest, best).cast("int")
            second = F.when(next_best == best, tied).otherwise(F.array_position(probs, next_best).cast("int"))
            return F.struct(
                probs.alias("probs"),
                F.get(labels, at - 1).alias("pred"),
                F.get(labels, at - 1).alias("top1_label"),
                best.alias("top1_prob"),
                F.get(labels, second - 1).alias("top2_label"),
                next_best.alias("top2_prob"),
                (best - next_best).alias("margin"),
                smoothed_entropy(probs).alias("entropy"),
            )

        return let(F.sort_array(probs, asc=False), ranked)

    usable = F.exists(scores, lambda s: s > F.lit(NEG_INF))
    return F.when(usable, let(softmax(scores), fields))


def top5_features(logprobs: Column) -> Column:
    """Shape of the recorded top log-probabilities.

    Fields: ``top2_margin, top5_entropy, dist_std, dist_kurtosis``. Values that are not finite
    are dropped and fewer than two left give nulls; kurtosis is excess kurtosis and needs four
    values that are not all equal.
    """

    def shape(v: Column) -> Column:
        n = F.size(v).cast("double")

        def entropy() -> Column:
            return let(
                log_sum_exp(v),
                lambda z: F.aggregate(
                    v,
                    F.lit(0.0),
                    lambda acc, x: acc
                    - F.greatest(F.exp(x - z), F.lit(1e-30)) * F.ln(F.greatest(F.exp(x - z), F.lit(1e-30))),
                ),
            )

        def moments(mean: Column) -> Column:
            second = total(F.transform(v, lambda x: (x - mean) * (x - mean))) / n
            fourth = total(F.transform(v, lambda x: (x - mean) * (x - mean) * (x - mean) * (x - mean))) / n
            return let(
                F.struct(second.alias("m2"), fourth.alias("m4")),
                lambda m: F.struct(
                    (F.exp(F.get(v, F.lit(0))) - F.exp(F.get(v, F.lit(1)))).alias("top2_margin"),
                    entropy().alias("top5_entropy"),
                    F.sqrt(m["m2"]).alias("dist_std"),
                    F.when((m["m2"] > 0) & (n >= 4), m["m4"] / (m["m2"] * m["m2"]) - 3.0).alias("dist_kurtosis"),
                ),
            )

        return F.when(n >= 2, let(total(v) / n, moments))

    kept = F.sort_array(F.filter(logprobs, finite), asc=False)
    return let(kept, shape)


def top5_from_json(text: Column) -> Column:
    """Recorded log-probabilities kept as JSON text; unreadable text is missing."""
    return F.from_json(text, "array<double>", {"mode": "PERMISSIVE", "allowNonNumericNumbers": "true"})


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors, normalised explicitly; null when either has no length."""
    dot = total(F.zip_with(a, b, lambda x, y: x * y))
    norm = F.sqrt(total(F.transform(a, lambda x: x * x))) * F.sqrt(total(F.transform(b, lambda x: x * x)))
    return F.try_divide(dot, norm)
