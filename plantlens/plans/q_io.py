"""Registered queries A1-A4: timestamp parsing and the enriched log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plantlens.operators import eda as D
from plantlens.operators import shift as G
from plantlens.plans import context as ctx
from plantlens.plans.context import CONDITION_LABEL, SHIFT_LABEL
from plantlens.plans.oracle import on_clean, on_plant
from plantlens.plans.q_cluster import _CK, Z8
from plantlens.plans.q_eda import _CUT_CTE
from plantlens.plans.q_shift import _SK
from plantlens.plans.registry import query, rnd
from plantlens.schema import CLIP14, LOG_SCHEMA, SHIFT_KEYS
from plantlens.sources.log_io import CORRUPT, parse_ts, read_log, write_log

LOG = [f.name for f in LOG_SCHEMA.fields]


@query("parse_ts", on_plant("""SELECT count(*) AS "rows", count(t) AS parsed, count(*) - count(t) AS rejected,
  strftime(min(t), '%Y-%m-%d %H:%M:%S') AS first_ts, strftime(max(t), '%Y-%m-%d %H:%M:%S') AS last_ts
FROM (SELECT try_strptime(txt, '%Y-%m-%d %H:%M:%S') AS t FROM
      (SELECT CASE WHEN hour = 3 THEN 'not a time' ELSE strftime("timestamp", '%Y-%m-%d %H:%M:%S') END AS txt
       FROM plant) AS a) AS b"""))
def parse_ts_query(spark, sf):
    """A2: timestamps arriving as text (one hour of them corrupted) parsed
    with a reject count instead of failing the job."""
    txt = ctx.plant(spark, sf).select(
        F.when(F.col("hour") == 3, F.lit("not a time"))
        .otherwise(F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss")).alias("timestamp"))
    p = parse_ts(txt, "timestamp")
    return p.agg(F.count(F.lit(1)).alias("rows"), F.count("timestamp").alias("parsed"),
                 (F.count(F.lit(1)) - F.count("timestamp")).alias("rejected"),
                 F.date_format(F.min("timestamp"), "yyyy-MM-dd HH:mm:ss").alias("first_ts"),
                 F.date_format(F.max("timestamp"), "yyyy-MM-dd HH:mm:ss").alias("last_ts"))


def enrich(spark: SparkSession, sf: str) -> DataFrame:
    """A4: the analysis' final table: cleaned log + cycle-time bin + condition
    cluster + date + shift instance + shift cluster (lazy)."""
    lab, _ = ctx.condition_labels(spark, sf)
    binned, _ = D.cut(lab, "cycle_time", 5, name="cycle_time_bin")
    with_si = G.with_shift_instance(binned)
    slab, _ = ctx.shift_labels(spark, sf)
    out = G.attach(with_si, slab, SHIFT_KEYS, SHIFT_LABEL)
    return out.select(*LOG, F.col("cycle_time_bin_idx").alias("cycle_time_bin"), CONDITION_LABEL,
                      F.col("date").cast("string").alias("date"), "shift_instance_id", SHIFT_LABEL)


@query("enriched_log", rnd(on_clean(f"""SELECT ck.* EXCLUDE (true_state, lbl, {', '.join(Z8)}),
  CAST(1 + (SELECT count(*) FROM edges WHERE k BETWEEN 1 AND 4 AND ck.cycle_time > e) AS INTEGER) AS cycle_time_bin,
  ck.lbl AS {CONDITION_LABEL}, CAST(CAST(ck."timestamp" AS DATE) AS VARCHAR) AS "date",
  CAST(CAST(ck."timestamp" AS DATE) AS VARCHAR) || '_' || ck.shift AS shift_instance_id,
  sk.lbl AS {SHIFT_LABEL}
FROM ck LEFT JOIN sk ON sk.shift_instance_id = CAST(CAST(ck."timestamp" AS DATE) AS VARCHAR) || '_' || ck.shift
  AND sk.machine_id = ck.machine_id AND sk.line_id = ck.line_id""", _CK, _CUT_CTE, _SK), *CLIP14))
def enriched_log(spark, sf):
    """A3/A4: the enriched log written once as parquet (partitioned by date and
    line) in the shared folder and served from there."""
    path = ctx.version(spark, sf).path(
        "enriched", lambda p: write_log(enrich(spark, sf), p, partition_by=["date", "line_id"]))
    back = spark.read.option("basePath", path).parquet(path)
    return back.select(*LOG[:3], F.col("line_id").cast("string").alias("line_id"), *LOG[4:], "cycle_time_bin",
                       CONDITION_LABEL, F.col("date").cast("string").alias("date"), "shift_instance_id", SHIFT_LABEL)


@query("csv_log", rnd(on_plant(f"SELECT * EXCLUDE (true_state) FROM plant"), *[f.name for f in LOG_SCHEMA.fields if f.dataType.typeName() == "double"]))
def csv_log(spark, sf):
    """A1/A3: the whole log written as CSV and scanned with the explicit schema."""
    path = ctx.version(spark, sf).path("csv-log", lambda p: write_log(ctx.plant(spark, sf), p, fmt="csv"))
    return read_log(spark, path)


def _write_damaged(spark, sf, path: str) -> None:
    """The log as CSV text with a word where hour 5's temperature belongs and no readable
    time at hour 3."""
    log = ctx.plant(spark, sf)
    log.withColumns({
        "temperature": F.when(F.col("hour") == 5, F.lit("n.a.")).otherwise(F.col("temperature").cast("string")),
        "timestamp": F.when(F.col("hour") == 3, F.lit("not a time")).otherwise(F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss")),
    }).write.mode("overwrite").option("header", True).csv(path)


@query("csv_rejects", on_plant("""SELECT line_id, count(*) AS "rows", count(*) FILTER (WHERE hour = 5) AS malformed,
  count(*) FILTER (WHERE hour = 3) AS bad_time, count(temperature) FILTER (WHERE hour <> 5) AS readings
FROM plant GROUP BY line_id"""))
def csv_rejects(spark, sf):
    """A1: a damaged CSV scanned in full: malformed lines and unreadable times are counted
    per line, not lost."""
    path = ctx.version(spark, sf).path("csv-damaged", lambda p: _write_damaged(spark, sf, p))
    df = read_log(spark, path, keep_corrupt=True)
    return df.groupBy("line_id").agg(
        F.count(F.lit(1)).alias("rows"), F.count(CORRUPT).alias("malformed"),
        F.count_if(F.col("timestamp").isNull()).alias("bad_time"), F.count("temperature").alias("readings"))
