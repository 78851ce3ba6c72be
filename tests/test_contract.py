import subprocess
import sys

from conftest import SMALL


def test_queries_are_listed_without_a_session():
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q) and len(q) > 140"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=".")


def test_flagship(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() > 0
    assert {"model", "policy", "style", "source", "forced_accuracy"} <= set(df.columns)


def test_no_python_workers_in_checked_queries(spark):
    import __spark_entry__ as e

    for name in ("feat_keywords", "extract_queries", "roc_auc", "policy_metrics", "search_passages", "build_router_matrix"):
        plan = e.queries()[name](spark, SMALL)._jdf.queryExecution().toString()
        assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan and "MapInPandas" not in plan, name
