"""The generic operators on the driver's ``events`` table (heavy-tailed
``value``): describe, IQR report and histogram (B2, C3, D3), and a stream of
events read directly from its parquet files (S1 shape, per event type)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plantlens.operators import clean as C
from plantlens.operators import eda as D
from plantlens.operators import profile as B
from plantlens.plans import context as ctx
from plantlens.plans.registry import query, rnd
from plantlens.streaming import stream as S

FMT = "'%Y-%m-%d %H:%M:%S'"


def events(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/events.parquet")


@query("events_value_describe", rnd("""SELECT 'value' AS "column", count(value) AS "count", avg(value) AS mean,
  stddev_samp(value) AS std, CAST(min(value) AS DOUBLE) AS "min", CAST(quantile_cont(value, 0.25) AS DOUBLE) AS q25,
  CAST(quantile_cont(value, 0.5) AS DOUBLE) AS q50, CAST(quantile_cont(value, 0.75) AS DOUBLE) AS q75,
  CAST(max(value) AS DOUBLE) AS "max" FROM events""", "mean", "std", '"min"', "q25", "q50", "q75", '"max"'))
def events_value_describe(spark, sf):
    """B2 on the heavy-tailed events.value."""
    return B.describe(events(spark, sf), ["value"])


@query("events_value_iqr", rnd("""WITH q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3
  FROM events)
SELECT 'value' AS "column", q1, q3, q3 - q1 AS iqr, q1 - 1.5E0 * (q3 - q1) AS lower_bound,
  q3 + 1.5E0 * (q3 - q1) AS upper_bound,
  CAST(count(*) FILTER (WHERE value < q1 - 1.5E0 * (q3 - q1) OR value > q3 + 1.5E0 * (q3 - q1)) AS BIGINT)
    AS n_outliers
FROM events CROSS JOIN q GROUP BY q1, q3""", "q1", "q3", "iqr", "lower_bound", "upper_bound"))
def events_value_iqr(spark, sf):
    """C3 on events.value: the fences and the rows outside them."""
    return C.iqr_outliers(events(spark, sf), ["value"])


@query("events_value_hist", rnd("""WITH st AS (SELECT min(value) AS mn, max(value) AS mx,
  (max(value) - min(value)) / 30.0E0 AS step FROM events),
b AS (SELECT (SELECT count(*) FROM range(1, 30) AS e(k) WHERE value >= e.k * step + mn) AS b
      FROM events CROSS JOIN st WHERE value IS NOT NULL)
SELECT CAST(k.i AS INTEGER) AS bin, k.i * step + mn AS bin_lo,
  CASE WHEN k.i + 1 < 30 THEN (k.i + 1) * step + mn ELSE mx END AS bin_hi, CAST(coalesce(c.n, 0) AS BIGINT) AS "count"
FROM range(30) AS k(i) CROSS JOIN st LEFT JOIN (SELECT b, count(*) AS n FROM b GROUP BY b) AS c ON c.b = k.i""",
    "bin_lo", "bin_hi"))
def events_value_hist(spark, sf):
    """D3 on events.value (30 equal-width bins, empty bins kept)."""
    return D.histogram(events(spark, sf), "value", 30)


def event_stream(spark: SparkSession, sf: str) -> DataFrame:
    return S.file_stream(spark, f"{sf}/events.parquet").withColumn("event_time", S.ntz_to_instant(F.col("ts")))


def _event_parts(df: DataFrame) -> DataFrame:
    return df.withColumn("start", S._aligned(3600)).groupBy("event_type", "start").agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


@query("stream_event_counts", rnd(f"""SELECT event_type, strftime(ws, {FMT}) AS window_start,
  strftime(ws + INTERVAL '1' HOUR, {FMT}) AS window_end, count(*) AS "rows", sum(value) AS total_value
FROM (SELECT *, date_trunc('hour', ts) AS ws FROM events) AS e
GROUP BY event_type, ws""", "total_value"), kind="S")
def stream_event_counts(spark, sf):
    """S1 shape on the events stream: hourly count and value per event type."""
    base = ctx.version(spark, sf).path("stream-events", lambda path: S.drain(spark, event_stream(spark, sf), path, _event_parts))
    m = S._merged(S.drain(spark, event_stream(spark, sf), base, _event_parts), ["event_type", "start"])
    return m.select("event_type", *S._bounds("start", 3600), F.col("n").alias("rows"), F.col("total").alias("total_value"))
