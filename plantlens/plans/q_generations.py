"""Registered queries on the log's merged per-generation statistics."""

from __future__ import annotations

from plantlens.plans import context as ctx
from plantlens.plans.oracle import on_plant
from plantlens.plans.registry import query, rnd, union
from plantlens.schema import ALL_NUMERIC, NUMERIC16


@query("log_moments", rnd(on_plant(union(*[
    f"""SELECT '{c}' AS col, count(*) AS "rows", count({c}) AS n, avg({c}) AS mean, stddev_samp({c}) AS std,
  CAST(min({c}) AS DOUBLE) AS least, CAST(max({c}) AS DOUBLE) AS most FROM plant""" for c in ALL_NUMERIC])), "mean", "std", "least", "most", digits=5),
    digits=5)
def log_moments(spark, sf):
    """Rows, values, mean, deviation and range of every numeric column of the raw log,
    merged from the statistics of its generations; the log itself is not read."""
    return ctx.generations(spark, sf).column_moments()


@query("log_correlations", rnd(on_plant(union(*[
    f"SELECT '{a}' AS a, '{b}' AS b, count(*) FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL) AS n, corr({a}, {b}) AS r FROM plant"
    for i, a in enumerate(NUMERIC16) for b in NUMERIC16[i + 1:]])), "r"))
def log_correlations(spark, sf):
    """Pearson correlation of every pair of sensors of the raw log, merged from the
    co-moments of its generations."""
    return ctx.generations(spark, sf).correlations()
