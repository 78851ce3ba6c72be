import random
import re

import pytest
from pyspark.sql import functions as F

from hedgewise.operators import curation as C
from hedgewise.operators import retrieval as R


@pytest.mark.parametrize(
    "question, want",
    [
        (
            "Which mountain is Mount Kilimanjaro near Lake Victoria?",
            ["Mount Kilimanjaro Lake Victoria", "Mount Kilimanjaro", "Lake Victoria", "mountain Mount Kilimanjaro near Lake"],
        ),
        ("what is water?", ["water", "is water"]),
        ("", []),
        ("A b.", []),
        ("He ran. Paris is big. It was Rome", ["Rome", "ran Paris big Rome", "he ran. paris is big. it was rome"]),
    ],
)
def test_extract_queries(one, question, want):
    assert one(R.extract_queries(F.col("q")), q=question) == want


def test_cut_is_a_parameter(one):
    text = "x " * 300 + "Final Answer"
    assert "Final Answer" not in one(R.extract_queries(F.col("q"), 500, 200, 80), q=text)
    assert "Final Answer" in one(R.extract_queries(F.col("q")), q=text)
    long = "y" * 9_990 + " end"
    assert long in one(R.extract_queries(F.col("q")), q=long)


def terms(text):
    words = re.findall(r"\w+", text.lower())
    return set(words) | {"=" + " ".join(words)}


def test_search_equals_brute_force_with_a_hot_word(spark):
    rng = random.Random(5)
    words = ["the"] + [f"w{i}" for i in range(30)]
    title = lambda: " ".join([*(["the"] if rng.random() < 0.6 else []), *rng.sample(words[1:], rng.randint(1, 4))])
    titles = [title() for _ in range(150)]
    texts = [f"text u{i} of {t}" for i, t in enumerate(titles)]
    rows = [(i, t, x) for i, (t, x) in enumerate(zip(titles, texts))]
    passages = spark.createDataFrame(rows, "page_id int, title string, text string")
    asked = [(i, 0, title() if rng.random() < 0.7 else "the") for i in range(120)] + [(500, 0, "nothing here"), (501, 0, titles[3])]
    asked += [(1000 + i, 0, f"u{i}") for i in range(150)]
    got = {}
    for r in R.search_passages(spark.createDataFrame(asked, "row_id int, query_rank int, query string"), passages).collect():
        got.setdefault(r["row_id"], {})[r["hit_rank"]] = r["page_id"]
    held = [terms(t) | set(re.findall(r"\w+", x.lower())) for t, x in zip(titles, texts)]
    df = {}
    for ws in held:
        for w in ws:
            df[w] = df.get(w, 0) + 1
    for row_id, _, q in asked:
        scored = sorted(
            (min(df[w] for w in terms(q) & held[i]), len(terms(t)), t, i) for i, t in enumerate(titles) if terms(q) & held[i]
        )
        assert got.get(row_id, {}) == {k + 1: s[-1] for k, s in enumerate(scored[:3])}
    # Every passage can be found, whether or not others share its title.
    assert all(i in got[1000 + i].values() for i in range(150))


def test_topk_skips_titles_seen_in_other_case(spark):
    rows = [(1, 0, 1, "Paris", "a"), (1, 0, 2, "Rome", "b"), (1, 1, 1, "PARIS", "c"), (1, 1, 2, "Oslo", "d"), (1, 2, 1, "Bern", "e")]
    hits = spark.createDataFrame(rows, "row_id int, query_rank int, hit_rank int, title string, text string")
    got = [(r["passage_rank"], r["title"]) for r in R.retrieve_topk(hits).orderBy("passage_rank").collect()]
    assert got == [(1, "Paris"), (2, "Rome"), (3, "Oslo")]


def test_context(spark):
    questions = spark.createDataFrame([(1,), (2,)], "row_id int")
    passages = spark.createDataFrame([(1, 2, "B", "two"), (1, 1, "A", "one")], "row_id int, passage_rank int, title string, text string")
    got = {r["row_id"]: r["context"] for r in R.assemble_context(questions, passages).collect()}
    assert got == {1: "[A]\none\n\n[B]\ntwo", 2: ""}
    cut = {r["row_id"]: r["context"] for r in R.assemble_context(questions, passages, 5).collect()}
    assert cut[1] == "[A]\no"


def test_dedup_keeps_repeats_inside_the_new_rows(spark):
    new = spark.createDataFrame([(1, "Q one "), (2, "q one"), (3, "old")], "row_id int, question string")
    pool = spark.createDataFrame([("OLD\n",)] * 3, "question string")
    assert sorted(r["row_id"] for r in C.dedup_against_pool(new, pool).collect()) == [1, 2]
    report = C.dedup_report(new, pool).first()
    assert (report["available"], report["excluded"], report["available_distinct"]) == (2, 1, 1)
    assert sorted(r["row_id"] for r in C.drop_repeats(new).collect()) == [1, 3]


def test_sample_is_stable_and_bounded(spark):
    df = spark.range(500).select(F.col("id").alias("row_id"), F.when(F.col("id") < 400, "hot").otherwise("cold").alias("source"))
    a = C.sample_n_per_source(df, 120).orderBy("row_id").collect()
    b = C.sample_n_per_source(df.repartition(9), 120).orderBy("row_id").collect()
    assert a == b and len(a) == 220


def test_profile_values_keeps_only_small_columns(spark):
    df = spark.range(100).select("id", (F.col("id") % 3).cast("string").alias("c"), F.array(F.col("id") % 2).alias("l"))
    got = {(r["column_name"], r["value"]): r["n"] for r in C.profile_values(df).collect()}
    assert got == {("c", "0"): 34, ("c", "1"): 33, ("c", "2"): 33, ("l", "[0]"): 50, ("l", "[1]"): 50}
