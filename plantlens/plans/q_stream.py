"""Registered streaming queries S1-S6.

Each one drains the plant stream with ``trigger(availableNow=True)``, folding
every micro-batch into partial results in the shared folder, and merges them:
all rows count and no window is withheld, so the oracles are the plain batch
statements.  A stream is drained once per version of the input files.
"""

from __future__ import annotations

from plantlens.plans import context as ctx
from plantlens.plans.oracle import on_clean, on_plant, with_plant
from plantlens.plans.q_cluster import _CK
from plantlens.plans.registry import query, rnd
from plantlens.schema import MACHINE_FEATURES8
from plantlens.session import scratch_path
from plantlens.streaming import late as L
from plantlens.streaming import stream as S



def _drained(spark, sf, name, reduce):
    """The partial results of the drained plant stream."""
    path = ctx.version(spark, sf).path(f"stream-{name}", lambda base: S.drain(spark, S.plant_stream(spark, sf), base, reduce))
    return S.drain(spark, S.plant_stream(spark, sf), path, reduce)


FMT = "'%Y-%m-%d %H:%M:%S'"
_KPI_SEL = f"""machine_id, strftime(ws, {FMT}) AS window_start, strftime(ws + INTERVAL '1' HOUR, {FMT}) AS window_end,
  count(*) AS "rows", CAST(sum(units_produced) AS BIGINT) AS total_units,
  CAST(sum(defect_count) AS BIGINT) AS total_defects, sum(downtime) AS total_downtime,
  count(*) FILTER (WHERE downtime > 0) AS downtime_freq,
  (count(*) - count(*) FILTER (WHERE downtime > 0)) / count(*) AS availability,
  CAST(sum(units_produced) - sum(defect_count) AS DOUBLE) / nullif(sum(units_produced), 0) AS quality"""


@query("stream_kpi", rnd(on_plant(f"""SELECT {_KPI_SEL}
FROM (SELECT *, date_trunc('hour', "timestamp") AS ws FROM plant) AS p
GROUP BY machine_id, ws"""),
    "total_downtime", "availability", "quality"), kind="S")
def stream_kpi(spark, sf):
    """Hourly KPIs per machine on the stream."""
    return S.kpi_total(_drained(spark, sf, "kpi", S.kpi_parts))


_ALARM = on_plant(f"""SELECT machine_id, strftime(ws, {FMT}) AS window_start,
  strftime(ws + INTERVAL '1' HOUR, {FMT}) AS window_end, count(*) AS "rows",
  count(*) FILTER (WHERE downtime > 0) AS down_rows,
  count(*) FILTER (WHERE downtime > 0) / count(*) AS down_share,
  count(*) FILTER (WHERE downtime > 0) / count(*) > 0.4E0 AS alarm
FROM (SELECT p.*, time_bucket(INTERVAL '15' MINUTE, "timestamp") - INTERVAL '15' MINUTE * k.k AS ws
      FROM plant p CROSS JOIN range(4) AS k(k)) AS s
GROUP BY machine_id, ws""")


@query("stream_alarm", rnd(_ALARM, "down_share"), kind="S")
def stream_alarm(spark, sf):
    """Sliding 1-hour downtime share per machine every 15 minutes, with alarm flag."""
    return S.alarm_total(_drained(spark, sf, "alarm", S.alarm_parts))


_EPIS = on_plant(f"""SELECT machine_id, strftime(min(t), {FMT}) AS episode_start,
  strftime(max(t) + INTERVAL '10' MINUTE, {FMT}) AS episode_end, count(*) AS "rows", sum(downtime) AS total_downtime
FROM (SELECT *, sum(nw) OVER (PARTITION BY machine_id ORDER BY t, nw DESC ROWS UNBOUNDED PRECEDING) AS sid
      FROM (SELECT *, CASE WHEN lag(t) OVER (PARTITION BY machine_id ORDER BY t) IS NULL
                  OR t - lag(t) OVER (PARTITION BY machine_id ORDER BY t) > INTERVAL '10' MINUTE THEN 1 ELSE 0 END
                  AS nw
            FROM (SELECT machine_id, "timestamp" AS t, downtime FROM plant WHERE downtime > 0) AS d) AS g) AS s
GROUP BY machine_id, sid""")


@query("stream_episodes", rnd(_EPIS, "total_downtime"), kind="S")
def stream_episodes(spark, sf):
    """S3: downtime episodes per machine (gap 10 minutes)."""
    return S.episodes_total(_drained(spark, sf, "episodes", S.episode_parts))


@query("stream_tag", on_clean(f"""SELECT strftime("timestamp", {FMT}) AS "timestamp", machine_id, line_id,
  lbl AS cluster_efficiency_machine FROM ck""", _CK), kind="S")
def stream_tag(spark, sf):
    """Live clean + condition tag with the frozen batch statistics."""
    cl, stats, centers = ctx.cleaned(spark, sf), ctx.condition_stats(spark, sf), ctx.condition_centers(spark, sf)
    return _drained(spark, sf, "tag", lambda df: S.stream_tag(df, cl.means, cl.bounds, stats, centers, MACHINE_FEATURES8))


@query("stream_dedup", on_plant(f"""SELECT DISTINCT machine_id, strftime("timestamp", {FMT}) AS "timestamp"
FROM plant"""), kind="S")
def stream_dedup(spark, sf):
    """Distinct readings by (machine, time)."""
    return S.dedup_total(_drained(spark, sf, "dedup", S.dedup_parts))


_SHIFT_SEL = f"""shift_instance_id, machine_id, line_id, strftime(ws, {FMT}) AS window_start,
  strftime(ws + INTERVAL '1' DAY, {FMT}) AS window_end, CAST(sum(units_produced) AS BIGINT) AS units_produced,
  sum(downtime) AS downtime, avg(error_rate) AS error_rate, avg(cycle_time) AS cycle_time, count(*) AS "rows\""""


@query("stream_shift", rnd(on_plant(f"""SELECT {_SHIFT_SEL}
FROM (SELECT *, date_trunc('day', "timestamp") AS ws,
        CAST(CAST("timestamp" AS DATE) AS VARCHAR) || '_' || shift AS shift_instance_id FROM plant) AS p
GROUP BY shift_instance_id, machine_id, line_id, ws"""),
    "downtime", "error_rate", "cycle_time"), kind="S")
def stream_shift(spark, sf):
    """Shift-instance totals per machine and line in daily windows."""
    return S.shift_total(_drained(spark, sf, "shift", S.shift_parts))


# ------------------------------------------- arrival in steps: late readings, live windows

#: Steps of arrival, and seconds that a reading may be behind the latest one before.
STEPS, DELAY_S = 6, 3600
_ARRIVED = f""",
timed AS (SELECT *, CAST(floor(epoch("timestamp") / 60) AS BIGINT) AS minute FROM plant WHERE "timestamp" IS NOT NULL),
span AS (SELECT min(minute) AS lo, max(minute) AS hi FROM timed),
arrived AS (SELECT t.*, least((minute + CASE WHEN minute % 7 = 0 THEN 600 ELSE 0 END - lo) * {STEPS} // (hi - lo + 1), {STEPS - 1}) AS step
            FROM timed t CROSS JOIN span),
marks AS (SELECT s.step, max(a."timestamp") - INTERVAL '{DELAY_S}' SECOND AS mark
          FROM range({STEPS + 1}) AS s(step) LEFT JOIN arrived a ON a.step < s.step GROUP BY s.step),
judged AS (SELECT a.*, m.mark FROM arrived a JOIN marks m USING (step))"""


def _log(spark, sf):
    """The log with its event time, as it arrives in steps."""
    log = ctx.plant(spark, sf)
    return log.withColumn("event_time", S.ntz_to_instant(log["timestamp"]))


def _judged(spark, sf):
    """(partial KPIs of the readings in time, late readings) of the log arriving in steps."""
    def build(base):
        L.by_arrival(_log(spark, sf), STEPS, lambda sdf: L.split_late(spark, sdf, base, DELAY_S, S.kpi_parts))
    base = ctx.version(spark, sf).path("stream-late", build)
    return L.split_results(spark, base, _log(spark, sf), S.kpi_parts)


@query("stream_late", rnd(with_plant(_ARRIVED) + """
SELECT machine_id, count(*) AS n_late, max((epoch(mark) - epoch("timestamp")) / 60) AS most_minutes_late
FROM judged WHERE "timestamp" < mark GROUP BY machine_id""", "most_minutes_late"), kind="S")
def stream_late(spark, sf):
    """Late readings per machine, when the log arrives in steps and every seventh minute's
    readings ten hours late: kept in a side table, counted, with the most minutes behind."""
    return L.late_counts(_judged(spark, sf)[1])


@query("stream_in_time", rnd(with_plant(_ARRIVED) + f"""
SELECT {_KPI_SEL} FROM (SELECT *, date_trunc('hour', "timestamp") AS ws FROM judged WHERE mark IS NULL OR "timestamp" >= mark) AS p
GROUP BY machine_id, ws""", "total_downtime", "availability", "quality"), kind="S")
def stream_in_time(spark, sf):
    """Hourly KPIs per machine of the readings in time of the log arriving in steps."""
    return S.kpi_total(_judged(spark, sf)[0])


def _live(spark, sf):
    """The folder of a live hourly KPI query that ran, and was resumed, after each step."""
    def build(base):
        L.by_arrival(_log(spark, sf), STEPS, lambda sdf: L.run_live(spark, S.stream_kpi(sdf, watermark=f"{DELAY_S} seconds"), base))
    return ctx.version(spark, sf).path("stream-live", build)


#: A live query drops a reading only when its whole window is behind the watermark.
_LIVE = _ARRIVED + f""",
held AS (SELECT *, date_trunc('hour', "timestamp") AS ws FROM judged
         WHERE mark IS NULL OR date_trunc('hour', "timestamp") + INTERVAL '1' HOUR > mark),
last AS (SELECT mark FROM marks WHERE step = {STEPS})"""


@query("stream_live_kpi", rnd(with_plant(_LIVE) + f"""
SELECT {_KPI_SEL} FROM held WHERE ws + INTERVAL '1' HOUR <= (SELECT mark FROM last) GROUP BY machine_id, ws""",
    "total_downtime", "availability", "quality"), kind="S")
def stream_live_kpi(spark, sf):
    """S1 live: the closed hourly windows of a watermarked append query that is stopped after
    each step of arrival and resumed from its checkpoint."""
    base = _live(spark, sf)
    schema = S.stream_kpi(_log(spark, sf)).schema
    return spark.read.schema(schema).parquet(f"{base}/out")


@query("stream_open_windows", with_plant(_LIVE) + f"""
SELECT DISTINCT machine_id, strftime(ws, {FMT}) AS window_start, strftime(ws + INTERVAL '1' HOUR, {FMT}) AS window_end
FROM held WHERE ws + INTERVAL '1' HOUR > (SELECT mark FROM last)""", kind="S")
def stream_open_windows(spark, sf):
    """S1 live: the windows that the stopped query still holds, read from its state store."""
    w = L.open_windows(spark, _live(spark, sf))
    return w.select("machine_id", S.instant_text(w["start"]).alias("window_start"), S.instant_text(w["end"]).alias("window_end"))
