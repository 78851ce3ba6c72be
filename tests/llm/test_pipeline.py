"""Each stage against a brute-force version of its own decision, and the whole run."""

import pytest
from conftest import SMALL
from test_operators import brute_contamination, brute_groups, check_shards

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from hedgewise.llm import mixing, queries, toxicity
from hedgewise.llm.common import held_out, table
from hedgewise.session import materialise


@pytest.fixture(scope="module")
def steps(spark):
    docs, out = table(spark, SMALL, "documents"), []
    for name, stage in pipeline.STAGES:
        after = materialise(stage(spark, docs, SMALL), name)
        out.append((docs, after))
        docs = after
    return dict(zip([n for n, _ in pipeline.STAGES], out))


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_stages_keep_the_columns(steps):
    for name, (before, after) in list(steps.items())[:-1]:
        assert after.columns == before.columns == ["doc_id", "text", "lang", "source", "n_chars"], name


def test_toxic_documents_go(spark, steps):
    before, after = steps["toxicity"]
    machine = toxicity.fit(before, table(spark, SMALL, "labels"), ~held_out(5, 0))
    assert ids(after) == ids(toxicity.score(before, machine).filter("predicted = 0"))


def test_one_of_each_group_stays(steps):
    before, after = steps["near_dedup"]
    groups = brute_groups([(r["doc_id"], r["text"]) for r in before.collect()])
    assert ids(after) == sorted(d for d, (_, c) in groups.items() if d == c)


def test_contaminated_documents_go(spark, steps):
    before, after = steps["decontamination"]
    items = [(r["item_id"], r["text"]) for r in table(spark, SMALL, "benchmark").collect()]
    found = brute_contamination([(r["doc_id"], r["text"]) for r in before.collect()], items)
    assert ids(after) == sorted(d for d, v in found.items() if not v[-1])


def test_copies_follow_the_rates(spark, steps):
    before, after = steps["mixing"]
    copies = mixing.apply(before, queries.fitted_mix(spark, before, SMALL)).collect()
    assert ids(after) == sorted(d for r in copies for d in [r["doc_id"]] * r["copies"])


def test_every_row_is_sharded(steps):
    before, after = steps["sharding"]
    assert ids(before) == ids(after)
    check_shards(after.collect(), queries.SHARDS)


def test_stages_take_awkward_rows(spark, clashing, edge, nothing):
    for name, stage in pipeline.STAGES:
        after = stage(spark, clashing, SMALL)
        assert (after.columns == clashing.columns or name == "sharding") and len(set(after.columns)) == len(after.columns), name
        assert after.count() > 0 and after.filter("n <> 'mine'").count() == 0, name
        assert stage(spark, nothing, SMALL).count() == 0, name
    blank = pipeline.drop_near_duplicates(spark, edge, SMALL)
    assert {1, 2, 3} <= set(ids(blank.filter("doc_id IS NOT NULL"))) and blank.filter("doc_id IS NULL").count() == 1


def test_all_are_registered():
    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "mixing", "sharding"]
