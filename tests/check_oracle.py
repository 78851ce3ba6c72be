"""Compare every query with its SQL check: same columns, types, row counts and values."""

from __future__ import annotations

import math
import sys
import time

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _key(row: tuple) -> tuple:
    return tuple((v is not None, str(v) if not isinstance(v, (int, float)) else "", v if isinstance(v, (int, float)) else 0) for v in row)


def _same(a, b, tol: float) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return a == b or (math.isnan(a) and math.isnan(b)) or abs(a - b) <= tol
    return a == b


def compare(spark_df, con, sql: str, tol: float = 0.0) -> str | None:
    """None when equal, else what differs."""
    names = sorted(spark_df.columns)
    got = sorted((tuple(r[n] for n in names) for r in spark_df.collect()), key=_key)
    rel = con.execute(sql)
    cols = [d[0] for d in rel.description]
    if sorted(cols) != names:
        return f"columns {names} vs {sorted(cols)}"
    order = [cols.index(n) for n in names]
    want = sorted((tuple(r[i] for i in order) for r in rel.fetchall()), key=_key)
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}"
    for g, w in zip(got, want):
        for n, a, b in zip(names, g, w):
            if type(a) is not type(b) and a is not None and b is not None:
                return f"type of {n}: {type(a)} vs {type(b)}"
            if not _same(a, b, tol):
                return f"{n}: {a!r} vs {b!r} in {dict(zip(names, g))} / {dict(zip(names, w))}"
    return None


def main(argv: list[str]) -> int:
    sys.path.insert(0, ".")
    import __spark_entry__ as entry
    from hedgewise.session import local_session

    sf = argv[0]
    only = set(argv[1:])
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf)
    sqls = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if only and not any(name.startswith(o) for o in only):
            continue
        start = time.time()
        try:
            df = fn(spark, sf)
            if name in sqls:
                diff = compare(df, con, sqls[name])
                rows = ""
            else:
                rows = len(df.collect())
                diff = None if rows else "no rows"
            state = "ok" if diff is None else "DIFF " + diff[:600]
            if name not in sqls:
                state += f" (rows only: {rows})"
        except Exception as exc:  # noqa: BLE001
            state = f"ERROR {type(exc).__name__}: {str(exc)[:900]}"
        bad += not state.startswith("ok")
        print(f"{name:32s} {time.time() - start:6.2f}s {state}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
