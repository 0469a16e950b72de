"""Registered queries T1-T4 (temperature), H1-H7 (bottlenecks), R1-R6 (rules)."""

from __future__ import annotations

from pyspark.sql import functions as F

from plantlens.operators import bottleneck as H
from plantlens.operators import rules as R
from plantlens.operators import scenario as T
from plantlens.plans import context as ctx
from plantlens.plans.oracle import on_clean, on_plant
from plantlens.plans.registry import query, rnd, union
from plantlens.schema import NOISE_NORMS, SENSOR_RANGES, TEMP_METRICS4

# ------------------------------------------------------------ temperature

_TQ = """,
tq AS (SELECT quantile_cont(temperature, 0.25) AS q1, quantile_cont(temperature, 0.75) AS q3 FROM clean)"""


@query("temp_thresholds", rnd(on_clean("SELECT q1, q3 FROM tq", _TQ), "q1", "q3"))
def temp_thresholds(spark, sf):
    """Temperature Q1 and Q3."""
    q1, q3 = T.thresholds(ctx.clean(spark, sf))
    return spark.range(1).select(F.lit(q1).alias("q1"), F.lit(q3).alias("q3"))


def _scen_oracle() -> str:
    conds = [("low", "temperature <= q1"), ("normal", "temperature > q1 AND temperature < q3"),
             ("high", "temperature >= q3")]
    sel = []
    for i, (s, c) in enumerate(conds):
        ms = ", ".join(f"avg({m}) FILTER (WHERE {c}) AS {m}" for m in TEMP_METRICS4)
        sel.append(f"""SELECT {i} AS ord, '{s}' AS scenario, q1, q3, count(*) FILTER (WHERE {c}) AS "rows", {ms}
FROM clean CROSS JOIN tq GROUP BY q1, q3""")
    return rnd(on_clean(union(*sel), _TQ), "q1", "q3", *TEMP_METRICS4)


@query("temp_scenarios", _scen_oracle())
def temp_scenarios(spark, sf):
    """Mean power, error, downtime and units in the low / normal / high
    temperature scenarios."""
    return T.scenario_means(ctx.clean(spark, sf))


# ------------------------------------------------------------- bottlenecks

_LINE_SUM = """sum(downtime) AS total_downtime, count(*) FILTER (WHERE downtime > 0) AS downtime_freq,
  avg(error_rate) AS avg_error_rate, CAST(sum(units_produced) AS BIGINT) AS total_units"""


@query("bottleneck_lines", rnd(on_clean(f"""SELECT line_id, {_LINE_SUM} FROM clean
WHERE line_id IS NOT NULL GROUP BY line_id"""), "total_downtime", "avg_error_rate"))
def bottleneck_lines(spark, sf):
    """H1-H5: the per-line bottleneck summary."""
    return H.line_summary(ctx.clean(spark, sf))


def _rank_oracle(dims) -> str:
    agg = union(*[f"""SELECT '{d}' AS dim, CAST({d} AS VARCHAR) AS "key", {_LINE_SUM}
FROM clean WHERE {d} IS NOT NULL GROUP BY {d}""" for d in dims])
    return rnd(on_clean(f"""SELECT *, rank() OVER (PARTITION BY dim ORDER BY rank_sum ASC) AS score_rank FROM (
  SELECT *, r_downtime + r_freq + r_error + r_units AS rank_sum FROM (
    SELECT *, rank() OVER (PARTITION BY dim ORDER BY total_downtime DESC) AS r_downtime,
      rank() OVER (PARTITION BY dim ORDER BY downtime_freq DESC) AS r_freq,
      rank() OVER (PARTITION BY dim ORDER BY avg_error_rate DESC) AS r_error,
      rank() OVER (PARTITION BY dim ORDER BY total_units ASC) AS r_units
    FROM ({agg}) AS a) AS b) AS c"""), "total_downtime", "avg_error_rate")


@query("bottleneck_rank", _rank_oracle(["machine_id", "line_id", "shift"]))
def bottleneck_rank(spark, sf):
    """H6: machines, lines and shifts ranked as bottlenecks (rank-sum score)."""
    return H.rank_bottlenecks(ctx.clean(spark, sf))


@query("machine_shift_cube", rnd(on_clean("""SELECT machine_id, shift, CAST(grouping(machine_id, shift) AS INTEGER)
  AS grouping_id, count(*) AS "rows", CAST(sum(units_produced) AS BIGINT) AS total_units,
  sum(downtime) AS total_downtime, count(*) FILTER (WHERE downtime > 0) AS downtime_freq,
  avg(error_rate) AS avg_error_rate, avg(cycle_time) AS avg_cycle_time
FROM clean GROUP BY CUBE (machine_id, shift)"""), "total_downtime", "avg_error_rate", "avg_cycle_time"))
def machine_shift_cube(spark, sf):
    """H7: machine x shift performance with all subtotals (CUBE)."""
    return H.machine_shift_cube(ctx.clean(spark, sf))


# ------------------------------------------------------------------- rules

_BAND = "CASE WHEN oil_level >= 70 THEN 'Good' WHEN oil_level >= 40 THEN 'Low' " \
        "WHEN oil_level IS NOT NULL THEN 'Critical' END"


@query("lubrication_band", on_plant(f"""SELECT band, count(*) AS "rows" FROM (SELECT {_BAND} AS band FROM plant) AS b
WHERE band IS NOT NULL GROUP BY band"""))
def lubrication_band(spark, sf):
    """Rows per lubrication band derived from oil level."""
    return R.band_counts(ctx.plant(spark, sf))


@query("band_mismatch", on_plant(f"""SELECT count(*) AS "rows",
  count(*) FILTER (WHERE ({_BAND}) IS NOT DISTINCT FROM lubrication_status) AS matching,
  count(*) FILTER (WHERE ({_BAND}) IS DISTINCT FROM lubrication_status) AS mismatching FROM plant"""))
def band_mismatch(spark, sf):
    """Stored lubrication status versus the derived band."""
    return R.band_mismatch(ctx.plant(spark, sf))


_SHIFT_OF = "CASE WHEN h >= 6 AND h < 14 THEN 'Shift_1_Pagi' WHEN h >= 14 AND h < 22 THEN 'Shift_2_Sore' " \
            "ELSE 'Shift_3_Malam' END"


@query("shift_of_hour", on_plant(f"""SELECT CAST(h AS INTEGER) AS hour, any_value({_SHIFT_OF}) AS derived_shift,
  count(*) AS "rows", count(*) FILTER (WHERE ({_SHIFT_OF}) = shift) AS matching
FROM (SELECT hour("timestamp") AS h, shift FROM plant) AS p GROUP BY h"""))
def shift_of_hour(spark, sf):
    """R2: the shift derived from the hour of day, checked against the log."""
    return R.shift_check(ctx.plant(spark, sf))


@query("calendar_features", on_plant("""SELECT CAST(d AS INTEGER) AS day_of_week, CAST(h AS INTEGER) AS hour,
  max(CASE WHEN d >= 5 THEN 1 ELSE 0 END) AS is_weekend, count(*) AS "rows",
  count(*) FILTER (WHERE h = hour AND d = day_of_week AND (CASE WHEN d >= 5 THEN 1 ELSE 0 END) = is_weekend)
    AS matching
FROM (SELECT isodow("timestamp") - 1 AS d, hour("timestamp") AS h, hour, day_of_week, is_weekend FROM plant) AS p
GROUP BY d, h"""))
def calendar_features(spark, sf):
    """Hour / weekday / weekend derived from the timestamp, per (day, hour)."""
    return R.calendar_check(ctx.plant(spark, sf))


@query("range_audit", rnd(on_plant(union(*[
    f"""SELECT '{c}' AS "column", {lo!r}E0 AS stated_min, {hi!r}E0 AS stated_max,
  CAST(min({c}) AS DOUBLE) AS observed_min, CAST(max({c}) AS DOUBLE) AS observed_max,
  count(*) FILTER (WHERE {c} < {lo!r}E0) AS n_below, count(*) FILTER (WHERE {c} > {hi!r}E0) AS n_above FROM plant"""
    for c, (lo, hi) in SENSOR_RANGES.items()])), "stated_min", "stated_max", "observed_min", "observed_max"))
def range_audit(spark, sf):
    """Readings outside the dictionary's stated ranges, per sensor."""
    return R.range_audit(ctx.plant(spark, sf))


_NORM = "CASE machine_type " + " ".join(f"WHEN '{k}' THEN {v!r}E0" for k, v in NOISE_NORMS.items()) + " END"


@query("noise_deviation", rnd(on_plant(f"""SELECT machine_type, any_value(nrm) AS norm_db,
  avg(noise_level_db) AS avg_noise_db, avg(noise_level_db - nrm) AS avg_deviation,
  avg(abs(noise_level_db - nrm)) AS avg_abs_deviation, count(*) AS "rows"
FROM (SELECT *, {_NORM} AS nrm FROM plant) AS p WHERE nrm IS NOT NULL GROUP BY machine_type"""),
    "norm_db", "avg_noise_db", "avg_deviation", "avg_abs_deviation"))
def noise_deviation(spark, sf):
    """Noise against the typical level of each machine type."""
    return R.noise_deviation(ctx.plant(spark, sf))
