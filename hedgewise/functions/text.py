"""Text statistics and keyword flags of a question, and its fingerprint."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from hedgewise.functions.common import NOT_SPACE, SPACE, WHITE_SPACE, WORD_END, WORD_START, let, safe_text, strip

# The keyword lists that define the three flag families.
NEGATION_WORDS = ["not", "n't", "no", "never", "none", "neither", "except", "unless", "without"]
COMPARISON_WORDS = ["most", "least", "best", "worst", "better", "worse", "than", "more", "less"]
QUANTITY_WORDS = [
    "how many", "how much", "percent", "percentage", "ratio", "average", "mean", "median",
    "total", "sum", "increase", "decrease", "twice", "half", "double",
]


def keyword_pattern(words: list[str]) -> str:
    """Any of the words, whole and in any case; a blank stands for any white space."""
    longest_first = sorted(words, key=len, reverse=True)
    # Looking at the first letter first skips most positions without trying any word.
    first = "".join(sorted({w[0] for w in words}))
    return f"(?iu)(?=[{first}]){WORD_START}(?:{'|'.join(w.replace(' ', SPACE + '+') for w in longest_first)}){WORD_END}"


def basic_text(text: Column) -> dict[str, Column]:
    t = strip(safe_text(text))
    words = F.regexp_count(t, F.lit(f"{NOT_SPACE}+")).cast("double")
    letters = F.char_length(F.translate(t, WHITE_SPACE, "")).cast("double")
    return {
        "feat_char_count": F.char_length(t).cast("double"),
        "feat_word_count": words,
        "feat_avg_word_len": F.coalesce(F.try_divide(letters, words), F.lit(0.0)),
        "feat_punct_count": F.regexp_count(t, F.lit(r"[^\p{L}\p{N}_\s\x0B\x1C-\x1F\x85\p{Z}]")).cast("double"),
    }


def keyword_flags(text: Column) -> dict[str, Column]:
    t = safe_text(text)
    out = {}
    for name, words in (("negation", NEGATION_WORDS), ("comparison", COMPARISON_WORDS), ("quant", QUANTITY_WORDS)):
        count = F.regexp_count(t, F.lit(keyword_pattern(words))).cast("double")
        out[f"feat_has_{name}"] = (count > 0).cast("double")
        out[f"feat_{name}_count"] = count
    return out


def capitalised_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"{WORD_START}[A-Z][a-z]+{WORD_END}"))


def capitalised_phrases(text: Column) -> Column:
    """Runs of capitalised words, each run one phrase."""
    word = f"[A-Z][a-z]+{WORD_END}"
    return F.regexp_extract_all(text, F.lit(f"{WORD_START}({word}(?:{SPACE}+{word})*)"), F.lit(1))


def simple_flags(text: Column) -> dict[str, Column]:
    t = safe_text(text)
    low = F.lower(t)
    return {
        "feat_length_char": F.char_length(t),
        "feat_has_why": F.contains(low, F.lit("why")).cast("int"),
        "feat_has_how": F.contains(low, F.lit("how")).cast("int"),
        "feat_ner_estimate": capitalised_words(t),
    }


def question_fingerprint(text: Column, head_chars: int | None = None) -> Column:
    """md5 of the question after cutting, stripping and lower-casing, in that order.

    The whole text by default; ``head_chars=200`` gives the published form, which looks at the beginning only.
    """
    t = safe_text(text)
    if head_chars is not None:
        t = F.substring(t, 1, head_chars)
    return F.md5(F.lower(strip(t)))


def is_blank(text: Column) -> Column:
    return let(text, lambda t: t.isNull() | (strip(t) == ""))
