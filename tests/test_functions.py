import math

import pytest
from pyspark.sql import functions as F

from hedgewise.functions import labels as B
from hedgewise.functions import logits as L
from hedgewise.functions import prompts as P
from hedgewise.functions import text as X
from hedgewise.functions.common import strip
from hedgewise.operators import curation as C
from hedgewise.operators.normalize import split_prefixed


@pytest.mark.parametrize(
    "text, want",
    [
        ("""['A', 'it"s']""", ["A", 'it"s']),
        (r"""['it\'s']""", ["it's"]),
        ("""["it's", 'B']""", ["it's", "B"]),
        ("['A', None]", ["A", None]),
        ("[None, 'None']", [None, "None"]),
        (" ['A'] \n", ["A"]),
        ("[]", []),
        ("A, B", None),
        ("['A'", None),
        ("", None),
    ],
)
def test_parse_list_literal(one, text, want):
    assert one(B.parse_list_literal(F.col("t")), t=text) == want


@pytest.mark.parametrize(
    "text, word, first",
    [("Answer: B", "B", "A"), (" c", "C", "C"), ("(d) because", "D", "("), ("42", "42", "42"), ("", "", ""), ("été", "É", "É")],
)
def test_normalize_label(one, text, word, first):
    assert one(B.normalize_label(F.col("t")), t=text) == word
    got = one(B.normalize_label(F.col("t"), "first_char"), t=text)
    assert got == (first if first != "(" else "(D) BECAUSE")


@pytest.mark.parametrize(
    "text, want",
    [("The answer is C.", "C"), ("none", None), ("bad", "B"), ("", None), ("E or D", "D"), ("xyd", "D")],
)
def test_extract_choice_letter(one, text, want):
    allowed = F.array(F.lit("A"), F.lit("B"), F.lit("C"), F.lit("D"))
    assert one(B.extract_choice_letter(F.col("t"), allowed), t=text) == want


def test_extract_choice_letter_any(one):
    assert one(B.extract_choice_letter(F.col("t")), t="42 then q") == "Q"
    assert one(B.extract_choice_letter(F.col("t")), t="42") is None


def test_extract_choice_letter_upper_cases_one_code_point_at_a_time(one):
    # The JVM writes ß as SS; one code point each keeps the first capital where SQL finds it.
    assert one(B.extract_choice_letter(F.col("t")), t="Äßkeit mit") == "K"
    assert one(B.normalize_label(F.col("t"), "first_char"), t="ß") == "\u1e9e"


@pytest.mark.parametrize("text, want", [("1000", 100), ("95%", 95), ("none", None), ("about 7 of 10", 7), ("", None)])
def test_parse_confidence(one, text, want):
    assert one(B.parse_confidence(F.col("t")), t=text) == want


@pytest.mark.parametrize("raw, want", [("b", "B"), (" (c) ", "C"), ("Z", ""), ("7", ""), ("answer a", "A")])
def test_coerce_gold_label(one, raw, want):
    labels = F.array(F.lit("a"), F.lit("B "), F.lit("C"))
    assert one(B.coerce_gold_label(F.col("t"), labels), t=raw) == want


def test_is_correct_without_letter(one):
    assert one(B.is_correct(F.lit(None).cast("string"), F.lit("A"))) is False


@pytest.mark.parametrize("text, want", [("don't", 0), ("n't", 1), ("not", 1), ("NOT no knot", 2), ("noé", 0), ("no_no", 0)])
def test_negation(one, text, want):
    assert one(X.keyword_flags(F.col("t"))["feat_negation_count"], t=text) == want


@pytest.mark.parametrize("text, want", [("How  many are there", 1), ("how\nmuch percent percentage", 3), ("showmany", 0)])
def test_quantity(one, text, want):
    assert one(X.keyword_flags(F.col("t"))["feat_quant_count"], t=text) == want


def test_basic_text(one):
    cols = X.basic_text(F.col("t"))
    assert one(cols["feat_punct_count"], t="été n't") == 1
    assert one(cols["feat_word_count"], t="  a  bc d \n") == 3
    assert one(cols["feat_char_count"], t=" ab \n") == 2
    assert one(cols["feat_avg_word_len"], t="a bcd") == 2.0
    assert one(cols["feat_avg_word_len"], t="  ") == 0.0


@pytest.mark.parametrize("text", ["\t x \n", "　x ", "\x1cx\x85", "  x\x0b"])
def test_strip_is_unicode(one, text):
    assert one(strip(F.col("t")), t=text) == text.strip() == "x"


def test_simple_flags(one):
    cols = X.simple_flags(F.col("t"))
    assert one(cols["feat_has_why"], t="WHYever") == 1
    assert one(cols["feat_ner_estimate"], t="New York and iPhone Café A") == 2


def test_fingerprint_cuts_before_it_strips(one):
    import hashlib

    text = " " + "Q" * 199 + " tail"
    want = hashlib.md5(text[:200].strip().lower().encode()).hexdigest()
    assert one(X.question_fingerprint(F.col("t"), 200), t=text) == want
    whole = hashlib.md5(text.strip().lower().encode()).hexdigest()
    assert one(X.question_fingerprint(F.col("t")), t=text) == whole  # the whole text by default


@pytest.mark.parametrize(
    "option, want",
    [("A)12", ("A", "12")), ("B. 42", ("B", "42")), ("Apple", ("A", "pple")), ("I)x", ("D", "I)x")), ("9", ("D", "9")), ("C: a\nb", ("D", "C: a\nb"))],
)
def test_split_prefixed(one, option, want):
    got = one(split_prefixed(F.col("t"), F.lit(3)), t=option)
    assert (got["label"], got["text"]) == want


# ---------------------------------------------------------------- numbers


def test_label_distribution_ties_and_single(one):
    labels = F.array(F.lit("A"), F.lit("B"), F.lit("C"))
    tie = one(L.label_distribution(F.col("v"), labels), v=[1.0, 2.0, 2.0])
    assert tie["pred"] == "B" and tie["top2_label"] == "C" and tie["margin"] == 0.0
    assert math.isclose(sum(tie["probs"]), 1.0)
    single = one(L.label_distribution(F.col("v"), F.array(F.lit("A"))), v=[3.0])
    assert single["pred"] == "A" and single["margin"] is None and single["top2_prob"] is None
    none = one(L.label_distribution(F.col("v"), labels), v=[float("-inf")] * 3)
    assert none is None
    part = one(L.label_distribution(F.col("v"), labels), v=[float("-inf"), 0.0, float("-inf")])
    assert part["pred"] == "B" and part["top1_prob"] == 1.0


def test_softmax_is_stable(one):
    got = one(L.log_softmax(F.col("v")), v=[1000.0, 1001.0])
    assert math.isclose(got[1], -math.log1p(math.exp(-1)))


def test_topk_pads(one):
    got = one(L.topk_logprobs(F.col("v"), 5), v=[0.0, 0.0])
    assert got[:2] == [pytest.approx(-math.log(2))] * 2 and got[2:] == [None] * 3


def test_top5_features(one):
    col = L.top5_features(F.col("v"))
    assert one(col, v=[float("nan"), -1.0, float("inf")]) is None
    flat = one(col, v=[-2.0] * 5)
    assert flat["dist_std"] == 0 and flat["dist_kurtosis"] is None
    assert math.isclose(flat["top5_entropy"], math.log(5))
    v = [-0.1, -2.0, -3.0, -7.0]
    got = one(col, v=v)
    m = sum(v) / 4
    m2, m4 = (sum((x - m) ** k for x in v) / 4 for k in (2, 4))
    assert math.isclose(got["dist_kurtosis"], m4 / m2**2 - 3)
    assert math.isclose(got["top2_margin"], math.exp(-0.1) - math.exp(-2.0))
    assert one(col, v=[-1.0, -2.0, float("nan")])["dist_kurtosis"] is None


def test_top5_from_json(one):
    assert one(L.top5_from_json(F.col("t")), t="[-1.5, -2]") == [-1.5, -2.0]
    assert one(L.top5_from_json(F.col("t")), t="oops") is None


def test_entropy_of_masked_logits_is_missing(one):
    assert one(L.entropy_from_logits(F.col("v")), v=[0.0, float("-inf")]) is None
    assert math.isclose(one(L.entropy_from_logits(F.col("v")), v=[0.0, 0.0]), math.log(2))


def test_cosine_normalises(one):
    assert one(L.cosine(F.array(F.lit(3.0), F.lit(0.0)), F.array(F.lit(2.0), F.lit(2.0)))) == pytest.approx(math.sqrt(0.5))
    assert one(L.cosine(F.array(F.lit(0.0)), F.array(F.lit(2.0)))) is None


# ---------------------------------------------------------------- prompts


@pytest.mark.parametrize(
    "source, context, want",
    [("ReClor", " text ", "text"), ("ReClor", "nan", None), ("ReClor", " ", None), ("SciQ", "text", None), ("ReClor", None, None)],
)
def test_passage_gate(one, source, context, want):
    assert one(P.passage_gate(F.col("s"), F.col("c")), "s string, c string", s=source, c=context) == want


def test_reflection_never_shows_the_old_answer_and_rotates(one):
    args = (F.lit("q?"), F.array(F.lit("A"), F.lit("B")), F.array(F.lit("x"), F.lit("y")))
    seen = [one(P.reflection_style(F.lit(3), F.lit(p))) for p in (1, 2)]
    assert seen == ["evidence_reconstruction", "plain_retry"]
    chat = one(P.reflection_messages(*args, F.lit(1), F.lit(1)))
    assert [m["role"] for m in chat] == ["system", "user"]


def test_retry_does_not_leak_gold(one):
    args = (F.lit("q?"), F.array(F.lit("A"), F.lit("B")), F.array(F.lit("x"), F.lit("y")))
    chat = one(P.retry_messages(*args, F.lit("A")))
    assert [m["role"] for m in chat] == ["system", "user", "assistant", "user"]
    assert chat[2]["content"] == "A" and "'A' is incorrect" in chat[3]["content"]


# ---------------------------------------------------------------- checks


def test_check_choices(one):
    arr = lambda *x: F.array(*[F.lit(i) for i in x])
    assert one(C.check_choices(arr("A", "B"), arr("x", "y"))) is True
    assert one(C.check_choices(arr("A"), arr("x"))) is False
    assert one(C.check_choices(F.lit(None).cast("array<string>"), arr("x", "y"))) is False


def test_check_gold(one):
    labels, texts = F.array(F.lit("A"), F.lit("B")), F.array(F.lit("x"), F.lit("y"))
    null_int, null_str = F.lit(None).cast("int"), F.lit(None).cast("string")
    assert one(C.check_gold(labels, texts, F.lit("B"), F.lit(1), F.lit("y"))) is True
    assert one(C.check_gold(labels, texts, F.lit("B"), F.lit(0), F.lit("y"))) is False
    assert one(C.check_gold(labels, texts, F.lit("B"), F.lit(2), F.lit("y"))) is False
    assert one(C.check_gold(labels, texts, F.lit("Z"), null_int, null_str)) is True
    assert one(C.check_gold(labels, texts, F.lit("A"), null_int, F.lit("y"))) is False


def test_list_literals_keep_every_character(one):
    parse = lambda t: one(B.parse_list_literal(F.col("t")), t=t)
    assert parse("['a\ue000b', None, \"None, \ue000\"]") == ["a\ue000b", None, "None, \ue000"]
    assert parse("[None, 'x, None]', None]") == [None, "x, None]", None]
    assert parse("['a\nb']") is None or parse("['a\nb']") == ["a\nb"]
    assert parse("no list") is None and parse("[]") == []
