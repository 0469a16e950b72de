"""Registered queries over date ranges, from stored summaries of the log (B2, B6, B8, C3,
C5), and the exact silhouette of the shift table (G6)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantlens.operators import bitmaps as M
from plantlens.operators import cluster as K
from plantlens.operators import quantile_store as Q
from plantlens.operators.shift import with_shift_instance
from plantlens.operators.silhouette import silhouettes
from plantlens.plans import context as ctx
from plantlens.plans.oracle import lloyd_sql, on_clean, on_plant
from plantlens.plans.q_shift import _SI, _SZ, Z4
from plantlens.plans.registry import query, rnd, union
from plantlens.schema import CLIP14

#: (first day, last day, line or all): the ranges of the registered query.
RANGES = [("2024-01-02", "2024-01-04", None), ("2024-01-01", "2024-01-07", "L1"), ("2024-01-06", "2024-01-06", "L2")]
PROBS = [0.25, 0.5, 0.75]


def quantile_store(spark, sf) -> Q.Store:
    """The stored sketches and chunks of the raw log's sensors."""
    v = ctx.version(spark, sf)
    day = F.to_date("timestamp")
    return Q.Store(v.table("quantile-sketches", lambda: Q.sketches(ctx.plant(spark, sf), CLIP14, day)),
                   v.table("quantile-chunks", lambda: Q.chunks(ctx.plant(spark, sf), CLIP14, day)), list(CLIP14))


def _in_range(first: str, last: str, line: str | None):
    days = F.col("day").between(F.lit(dt.date.fromisoformat(first)), F.lit(dt.date.fromisoformat(last)))
    return days if line is None else days & (F.col("line") == line)


@query("range_quantiles", rnd(on_plant(union(*[
    f"""SELECT '{first}' AS first_day, '{last}' AS last_day, '{line or 'all'}' AS line, '{c}' AS col, count({c}) AS n,
  quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS median, quantile_cont({c}, 0.75) AS q3
FROM plant WHERE CAST("timestamp" AS DATE) BETWEEN DATE '{first}' AND DATE '{last}'{f" AND line_id = '{line}'" if line else ''} HAVING count({c}) > 0"""
    for first, last, line in RANGES for c in CLIP14])), "q1", "median", "q3"))
def range_quantiles(spark, sf):
    """Exact quartiles of the sensors over ranges of days and lines, from stored
    sketches and the chunks that overlap their brackets."""
    store, rows = quantile_store(spark, sf), []
    for first, last, line in RANGES:
        for c, (n, qs) in store.quantiles(PROBS, _in_range(first, last, line)).items():
            rows.append((first, last, line or "all", c, n, *map(float, qs)))
    return spark.createDataFrame(rows, "first_day string, last_day string, line string, col string, n long, q1 double, median double, q3 double")


DIMS = ["machine_id", "operator_id", "product_type", "shift_instance_id"]


def daily_bitmaps(spark, sf) -> DataFrame:
    v = ctx.version(spark, sf)
    log = with_shift_instance(ctx.plant(spark, sf))
    return v.table("daily-bitmaps", lambda: M.daily(log, F.col("date"), DIMS, lambda df, name: v.table(name, lambda: df)))


@query("distinct_by_period", on_plant(union(*[f"""SELECT CAST(f.d AS VARCHAR) AS first_day, CAST(l.d AS VARCHAR) AS last_day,
  '{c}' AS dim, count(DISTINCT {c}) AS n_distinct
FROM (SELECT DISTINCT CAST("timestamp" AS DATE) AS d FROM plant) AS f
JOIN (SELECT DISTINCT CAST("timestamp" AS DATE) AS d FROM plant) AS l ON f.d <= l.d
JOIN (SELECT *, {_SI} AS shift_instance_id FROM plant) AS p ON CAST(p."timestamp" AS DATE) BETWEEN f.d AND l.d
GROUP BY f.d, l.d HAVING count({c}) > 0""" for c in DIMS])))
def distinct_by_period(spark, sf):
    """Exact distinct machines, operators, products and shifts of every period between
    two days of the log, by the union of daily bitmaps."""
    days = daily_bitmaps(spark, sf)
    dates = days.select("day").distinct()
    last = dates.agg(F.max("day")).first()[0]
    periods = (dates.select(F.col("day").alias("first_day"), F.explode(F.sequence("day", F.lit(last))).alias("day"))
               .join(dates, "day", "left_semi").withColumnRenamed("day", "last_day"))
    return M.distinct_in(days, periods).select(F.col("first_day").cast("string").alias("first_day"), F.col("last_day").cast("string").alias("last_day"),
                                               "dim", "n_distinct")


KS = range(2, 10)
_FITS = "".join(lloyd_sql("sz", Z4, k, "units_produced", f"e{k}") for k in KS)
_DIST = "sqrt(" + " + ".join(f"(a.{z} - b.{z}) * (a.{z} - b.{z})" for z in Z4) + ")"


def _exact_sql(k: int) -> str:
    return f"""SELECT CAST({k} AS INTEGER) AS k, avg(CASE WHEN n <= 1 OR greatest(a, b) = 0 THEN 0.0E0 ELSE (b - a) / greatest(a, b) END) AS silhouette FROM (
  SELECT i, max(CASE WHEN own THEN n END) AS n, max(CASE WHEN own THEN d / nullif(n - 1, 0) END) AS a, min(CASE WHEN NOT own THEN d / n END) AS b FROM (
    SELECT a.i, a.lbl = b.lbl AS own, b.lbl, count(*) AS n, sum({_DIST}) AS d
    FROM (SELECT *, row_number() OVER () AS i FROM e{k}) AS a CROSS JOIN e{k} AS b GROUP BY a.i, a.lbl, b.lbl) AS s GROUP BY i) AS t"""


@query("shift_silhouette", rnd(on_clean(union(*[_exact_sql(k) for k in KS]), _SZ, _FITS), "silhouette"))
def shift_silhouette(spark, sf):
    """The exact Euclidean silhouette of K8 on the shift table for k = 2..9, by tile sums."""
    zdf, zcols = ctx.shift_z(spark, sf)
    fits = ctx.shift_curve(spark, sf, KS)
    v = ctx.version(spark, sf)
    lab = zdf.select(*zcols, *[K.nearest(zcols, fits[k]).alias(f"k{k}") for k in KS])
    found = silhouettes(lab, zcols, [f"k{k}" for k in KS], lambda df: v.table("shift-tiles", lambda: df))
    return spark.createDataFrame([(k, found[f"k{k}"]) for k in KS], "k int, silhouette double")
