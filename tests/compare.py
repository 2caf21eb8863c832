"""Run registered queries next to their SQL on the same files and report differences."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb
import pandas as pd

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _cell(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    if value is None or value is pd.NaT or value is pd.NA:
        return None
    if isinstance(value, (list, tuple)) or hasattr(value, "tolist") and getattr(value, "ndim", 0):
        return tuple(_cell(v) for v in value)
    return value.item() if hasattr(value, "item") else value


def rows(columns: list[str], values) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in values), key=repr)


def differences(df, con, sql: str) -> str | None:
    """None when columns, row count and values agree."""
    got = rows(df.columns, df.collect())
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    want = rows(names, result.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    if len(got) != len(want):
        return f"{len(got)} rows against {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    kinds = {(type(a).__name__, type(b).__name__) for g, w in zip(got, want) for a, b in zip(g, w)
             if a is not None and b is not None and type(a) is not type(b)}
    if bad:
        return f"{len(bad)} of {len(got)} rows differ, first {bad[0]}"
    return f"types {kinds}" if kinds else None


def main(names: list[str]) -> None:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as contract
    from tests.session import make_session

    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark, con = make_session(), connect(folder)
    sql = contract.oracle_sql()
    failed = []
    for name, function in contract.queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            if name in sql:
                answer = differences(function(spark, folder), con, sql[name]) or "ok"
            else:
                answer = f"rows {function(spark, folder).count()} (no SQL)"
        except Exception as error:
            answer = f"{type(error).__name__}: {str(error)[:600]}"
        if answer != "ok" and "no SQL" not in answer:
            failed.append(name)
        print(f"{name:32s} {time.time() - start:6.2f}s {answer[:900]}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main(sys.argv[1:])
