"""Registration of queries: the Spark plan, the output columns and the SQL that checks it."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

Plan = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    columns: str
    plan: Plan
    sql: str | None


CATALOG: dict[str, Entry] = {}
# Named sub-queries the SQL checks may use; a name is pulled in wherever it is mentioned.
VIEWS: dict[str, str] = {}
# Engines round exact halves differently; a nudge in both keeps halves off the border.
NUDGE = 1e-9
KINDS = {"i": "bigint", "d": "double", "s": "string", "b": "boolean"}


def query(name: str, columns: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    """Register ``plan``. ``columns`` lists ``name:kind`` with kind i, d, s or b."""

    def add(plan: Plan) -> Plan:
        if name in CATALOG:
            raise ValueError(f"query {name} registered twice")
        CATALOG[name] = Entry(columns, plan, sql)
        return plan

    return add


def _fields(columns: str) -> list[tuple[str, str]]:
    return [tuple(c.split(":")) for c in columns.split()]


def shape(df: DataFrame, columns: str) -> DataFrame:
    """Select, cast and round the columns so that both engines print the same values."""
    out = []
    for name, kind in _fields(columns):
        c = F.col(name).cast(KINDS[kind])
        out.append((F.round(c + F.lit(NUDGE), 6) + F.lit(0.0) if kind == "d" else c).alias(name))
    return df.select(*out)


def _views_for(text: str) -> list[str]:
    found: list[str] = []

    def visit(body: str) -> None:
        for v in re.findall(r"\bfx_\w+", body):
            if v not in found:
                visit(VIEWS[v])
                found.append(v)

    visit(text)
    return found


def render_sql(entry: Entry) -> str:
    """The check as one statement with the same casts and rounding."""
    casts = {
        "i": "CAST({0} AS BIGINT)",
        "d": "round(CAST({0} AS DOUBLE) + 1e-9, 6) + 0.0",
        "s": "CAST({0} AS VARCHAR)",
        "b": "CAST({0} AS BOOLEAN)",
    }
    cols = ", ".join(f"{casts[k].format(n)} AS {n}" for n, k in _fields(entry.columns))
    views = _views_for(entry.sql)
    head = "WITH " + ", ".join(f"{v} AS ({VIEWS[v]})" for v in views) + " " if views else ""
    return f"{head}SELECT {cols} FROM ({entry.sql}) AS checked"


def load_all() -> dict[str, Entry]:
    from hedgewise.plans import (  # noqa: F401
        curation_queries,
        label_queries,
        policy_queries,
        ranking_queries,
        retrieval_queries,
        router_queries,
        source_queries,
        text_queries,
        threshold_queries,
        uncertainty_queries,
    )

    return CATALOG


def queries() -> dict[str, Plan]:
    def bind(e: Entry) -> Plan:
        return lambda spark, sf_dir: shape(e.plan(spark, sf_dir), e.columns)

    return {name: bind(e) for name, e in load_all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: render_sql(e) for name, e in load_all().items() if e.sql is not None}
