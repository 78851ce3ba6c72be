"""Reading labels, letters and confidences out of raw replies and list literals."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from hedgewise.functions.common import WORD, WORD_END, WORD_START, let, strip, upper

LETTERS = [chr(65 + i) for i in range(26)]


def _none_if_empty(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def parse_list_literal(text: Column) -> Column:
    """``['A', 'B']`` as an array of strings; anything that is not a list gives null.

    ``None`` between commas is a missing entry; inside a quoted text it is text.
    """
    # Cut into quoted texts, which stay as they are, and what lies between them.
    single, double = r"'(?:[^'\\]|\\.)*'", r'"(?:[^"\\]|\\.)*"'
    parts = F.regexp_extract_all(strip(text), F.lit(rf"(?s)({single}|{double}|[^'\"]+|['\"])"), F.lit(1))
    quoted = lambda x: x.startswith("'") | x.startswith('"')
    named = lambda x: F.regexp_replace(x, r"(?<=[\[,\s])None(?=\s*[,\]])", "null")
    body = F.array_join(F.transform(parts, lambda x: F.when(quoted(x), x).otherwise(named(x))), "")
    parsed = F.from_json(
        body, "array<string>", {"allowSingleQuotes": "true", "allowBackslashEscapingAnyCharacter": "true"}
    )
    return F.when(body.startswith("[") & body.endswith("]"), parsed)


def normalize_label(text: Column, mode: str = "word") -> Column:
    """A reply reduced to a label.

    ``word`` takes the first stand-alone capital, else the first letter, else the text itself.
    ``first_char`` skips the stand-alone search.
    """
    if mode not in ("word", "first_char"):
        raise ValueError(f"unknown mode {mode!r}")

    def reduce(t: Column) -> Column:
        first = F.substring(t, 1, 1)
        fallback = F.when(first.rlike(r"^\p{L}"), first).otherwise(t)
        if mode == "first_char":
            return fallback
        return F.coalesce(_none_if_empty(F.regexp_extract(t, f"{WORD_START}([A-Z]){WORD_END}", 1)), fallback)

    return let(upper(strip(text)), reduce)


def extract_choice_letter(text: Column, allowed: Column | None = None) -> Column:
    """First allowed label standing alone, else the first allowed character, else null."""

    def search(t: Column) -> Column:
        if allowed is None:
            alone = F.regexp_extract(t, f"{WORD_START}([A-Z]){WORD_END}", 1)
            anywhere = F.regexp_extract(t, "([A-Z])", 1)
            return F.coalesce(_none_if_empty(alone), _none_if_empty(anywhere))
        words = F.regexp_extract_all(t, F.lit(f"({WORD}+)"), F.lit(1))
        alone = F.get(F.filter(words, lambda w: F.array_contains(allowed, w)), F.lit(0))
        anywhere = F.get(F.filter(F.split(t, ""), lambda c: F.array_contains(allowed, c)), F.lit(0))
        return F.coalesce(alone, anywhere)

    return let(upper(strip(text)), search)


def parse_confidence(text: Column) -> Column:
    """First run of one to three digits, at most 100; no digits give null."""
    return let(
        F.regexp_extract(text, r"([0-9]{1,3})", 1).try_cast("int"),
        lambda n: F.when(n.isNotNull(), F.least(n, F.lit(100))),
    )


def coerce_gold_label(value: Column, labels: Column) -> Column:
    """The recorded gold label mapped onto the labels in use, '' when it cannot be."""
    known = F.transform(labels, lambda x: upper(strip(x)))

    def choose(raw: Column) -> Column:
        first = upper(F.regexp_extract(raw, "([A-Za-z])", 1))
        return (
            F.when(F.array_contains(known, upper(raw)), upper(raw))
            .when((first != "") & F.array_contains(known, first), first)
            .otherwise(F.lit(""))
        )

    return let(strip(value), choose)


def is_correct(predicted: Column, gold: Column) -> Column:
    return F.coalesce(predicted == gold, F.lit(False))
