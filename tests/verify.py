"""Compare a Spark result with a DuckDB result: row count, column names and
the multiset of rows (columns sorted by name, floats at 6 decimals)."""

from __future__ import annotations

import datetime as dt
import decimal
import os

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def norm(v):
    if isinstance(v, float):
        if v != v:
            return "nan"
        return f"{round(v, 6) + 0.0:.6f}"
    if isinstance(v, decimal.Decimal):
        return f"{float(v):.6f}"
    if isinstance(v, dt.datetime):
        return v.isoformat(sep=" ")
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    return repr(v)


def canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in rows)


def compare(spark_cols, spark_rows, duck_cols, duck_rows) -> list[str]:
    msg = []
    if sorted(spark_cols) != sorted(duck_cols):
        msg.append(f"cols spark={sorted(spark_cols)} oracle={sorted(duck_cols)}")
    if len(spark_rows) != len(duck_rows):
        msg.append(f"rows spark={len(spark_rows)} oracle={len(duck_rows)}")
    if not msg:
        a, b = canon(spark_cols, spark_rows), canon(duck_cols, duck_rows)
        if a != b:
            diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
            msg.append(f"values differ e.g. {diff}")
    return msg
