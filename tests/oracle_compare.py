"""Run queries against their SQL equivalents and compare rows, columns and values."""

from __future__ import annotations

import math
import sys
import time

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return 0.0 if v == 0 else float(f"{v:.12g}")
    return v


def _rows(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_cell(r[i]) for i in order) for r in records]
    return sorted(out, key=lambda r: tuple((v is None, str(type(v)), str(v)) for v in r))


def kind(name: str) -> str:
    n = name.lower()
    if any(k in n for k in ("int", "long", "short", "byte")):
        return "int" if "bigint" not in n and "long" not in n else "bigint"
    if n in ("double", "float") or n.startswith("decimal"):
        return "double"
    return {"varchar": "string", "boolean": "boolean", "string": "string"}.get(n, n)


def compare(df, con, sql) -> str:
    """Empty when equal, else what differs."""
    got = [tuple(r) for r in df.collect()]
    rel = con.sql(sql)
    want = rel.fetchall()
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {sorted(df.columns)} != {sorted(rel.columns)}"
    types = dict(zip(rel.columns, map(str, rel.types)))
    notes = [
        f"{n}: {t} vs {types[n]}" for n, t in df.dtypes
        if kind(t) != kind(types[n]) and not t.startswith("timestamp")
    ]
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    a, b = _rows(df.columns, got), _rows(rel.columns, want)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"{len(bad)} of {len(a)} rows differ, first {bad[0]}"
    return ("types " + "; ".join(notes)) if notes else ""


def main(sf_dir: str, names: list[str]) -> None:
    import __spark_entry__ as e
    from regatta.session import get_session

    spark = get_session("compare")
    con = connect(sf_dir)
    queries, oracle = e.queries(), e.oracle_sql()
    failed = 0
    for name in names or queries:
        started = time.time()
        try:
            df = queries[name](spark, sf_dir)
            if name in oracle:
                result = compare(df, con, oracle[name])
            else:
                result = f"rows only: {df.count()}"
        except Exception as problem:  # noqa: BLE001
            result = f"ERROR {type(problem).__name__}: {str(problem)[:600]}"
        ok = not result or result.startswith("rows only")
        failed += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - started:.1f}s {result}", flush=True)
    print(f"{failed} failed")


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
