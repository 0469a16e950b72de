"""The registry of named queries: ``QUERIES[name](spark, sf_dir) -> DataFrame``
and ``ORACLES[name]`` = the DuckDB SQL restating it independently.

Query modules register themselves with ``@query(name, oracle_sql)``.  Every
query ends in ``present`` (doubles rounded to ``digits`` decimals, 6 unless a
query's values are small; the oracle rounds the same columns with ``rnd``), so
that sums in another order compare equal.  The operators themselves, and the
tables they write, are not rounded.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plantlens.functions.stats import present
from plantlens.plans.context import refresh

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}
KIND: dict[str, str] = {}  # 'O' oracle-checked, 'P' property/rows-only, 'S' streaming


def query(name: str, oracle: str | None = None, kind: str | None = None, digits: int = 6):
    def deco(fn: QueryFn) -> QueryFn:
        def run(spark: SparkSession, sf: str) -> DataFrame:
            refresh(spark, sf)  # changed input files drop what was built from the old ones
            return present(fn(spark, sf), digits)
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        KIND[name] = kind or ("O" if oracle is not None else "P")
        return run
    return deco


def rnd(sql: str, *cols: str, digits: int = 6) -> str:
    """Wrap an oracle so the listed DOUBLE columns are rounded like ``present``."""
    if not cols:
        return sql
    scale = f"{10 ** digits}.0E0"
    repl = ", ".join(f"(round({c} * {scale}) / {scale} + 0.0E0) AS {c}" for c in cols)
    return f"SELECT * REPLACE ({repl}) FROM (\n{sql}\n) AS _q"


def union(*selects: str) -> str:
    return "\nUNION ALL\n".join(selects)


def load_all() -> None:
    """Import every query module (each registers on import)."""
    from plantlens.plans import (  # noqa: F401
        q_generations, q_layout, q_ranges, q_profile, q_clean, q_kpi, q_eda, q_cluster, q_shift, q_ops, q_whatif, q_stream, q_io, q_events)
