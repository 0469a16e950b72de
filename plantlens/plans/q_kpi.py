"""Registered queries E1-E18 and Q1-Q7 (KPI, OEE, defects), on the cleaned log."""

from __future__ import annotations

from pyspark.sql import functions as F

from plantlens.operators import kpi as K
from plantlens.plans import context as ctx
from plantlens.plans.oracle import on_clean
from plantlens.plans.registry import query, rnd, union

OEE_DOUBLES = ("run_time", "availability", "performance_ref", "performance_norm", "quality",
               "oee_ref", "oee_norm")


def _oee_sql(keys: str = "") -> str:
    """OEE aggregates in SQL (rows mode)."""
    return f"""count(*) AS "rows",
  CAST(sum(units_produced) AS BIGINT) AS total_units, CAST(sum(defect_count) AS BIGINT) AS total_defects,
  CAST(count(*) - count(*) FILTER (WHERE downtime > 0) AS DOUBLE) AS run_time,
  (count(*) - count(*) FILTER (WHERE downtime > 0)) / count(*) AS availability,
  120.0E0 * sum(units_produced) / nullif(count(*) - count(*) FILTER (WHERE downtime > 0), 0) AS performance_ref,
  120.0E0 * sum(units_produced) / nullif(count(*) - count(*) FILTER (WHERE downtime > 0), 0) / 60.0E0
    AS performance_norm,
  (sum(units_produced) - sum(defect_count)) / nullif(sum(units_produced), 0) AS quality"""


def _oee_select(src: str, group: str = "", key_cols: str = "") -> str:
    return f"""SELECT {key_cols}*, availability * performance_ref * quality AS oee_ref,
  availability * performance_norm * quality AS oee_norm
FROM (SELECT {key_cols}{_oee_sql()} FROM {src} {group}) AS o"""


@query("oee_global", rnd(on_clean(_oee_select("clean")), *OEE_DOUBLES))
def oee_global(spark, sf):
    """Availability x performance x quality for the whole log."""
    return K.oee(ctx.clean(spark, sf))


@query("oee_by_machine", rnd(on_clean(
    _oee_select("clean WHERE machine_id IS NOT NULL", "GROUP BY machine_id", "machine_id, ").replace(
        "SELECT machine_id, *,", "SELECT *,")), *OEE_DOUBLES))
def oee_by_machine(spark, sf):
    """E5 per machine (flagship)."""
    return K.oee(ctx.clean(spark, sf), ["machine_id"])


def _sets_oee_oracle(dims) -> str:
    parts = []
    for d in dims:
        parts.append(f"""SELECT '{d}' AS dim, CAST({d} AS VARCHAR) AS "key", {_oee_sql()}
FROM clean WHERE {d} IS NOT NULL GROUP BY {d}""")
    inner = union(*parts)
    return rnd(on_clean(f"""SELECT *, availability * performance_ref * quality AS oee_ref,
  availability * performance_norm * quality AS oee_norm FROM (
{inner}) AS o"""), *OEE_DOUBLES)


@query("oee_grouping_sets", _sets_oee_oracle(["machine_id", "shift", "line_id"]))
def oee_grouping_sets(spark, sf):
    """E5 by machine, shift and line in one grouping-sets aggregation."""
    return K.oee_sets(ctx.clean(spark, sf), [["machine_id"], ["shift"], ["line_id"]])


@query("oee_vs_target", rnd(on_clean(f"""
SELECT availability, performance_norm, quality, oee_norm, 0.85E0 AS target, oee_norm - 0.85E0 AS gap,
  CASE WHEN oee_norm >= 0.85E0 THEN 'meets' ELSE 'below' END AS verdict
FROM ({_oee_select("clean")}) AS x"""), "availability", "performance_norm", "quality", "oee_norm", "target", "gap"))
def oee_vs_target(spark, sf):
    """Normalised OEE against the 85 % benchmark."""
    return K.oee_vs_target(ctx.clean(spark, sf))


@query("kpi_cards", rnd(on_clean("""
SELECT CAST(sum(units_produced) AS BIGINT) AS total_units, CAST(sum(defect_count) AS BIGINT) AS total_defects,
  (count(*) - count(*) FILTER (WHERE downtime > 0)) / count(*) AS availability,
  sum(downtime) AS total_downtime, avg(error_rate) AS avg_error_rate FROM clean"""),
    "availability", "total_downtime", "avg_error_rate"))
def kpi_cards(spark, sf):
    """The dashboard's KPI cards."""
    return K.kpi_cards(ctx.clean(spark, sf))


def _by_dim_oracle(dims, metric_sql: str, name: str) -> str:
    return rnd(on_clean(union(*[
        f"""SELECT '{d}' AS dim, CAST({d} AS VARCHAR) AS "key", {metric_sql} AS {name}
FROM clean WHERE {d} IS NOT NULL GROUP BY {d}""" for d in dims])), name)


@query("cycle_time_by_dim", _by_dim_oracle(["machine_id", "shift", "line_id"], "avg(cycle_time)", "avg_cycle_time"))
def cycle_time_by_dim(spark, sf):
    """Mean cycle time per machine, shift and line (one scan)."""
    return K.cycle_time_by_dim(ctx.clean(spark, sf))


def _downtime_oracle(key: str) -> str:
    return rnd(on_clean(f"""SELECT {key}, sum(downtime) AS total_downtime,
  CAST(count(*) FILTER (WHERE downtime > 0) AS BIGINT) AS downtime_freq
FROM clean WHERE {key} IS NOT NULL GROUP BY {key}"""), "total_downtime")


@query("downtime_by_machine", _downtime_oracle("machine_id"))
def downtime_by_machine(spark, sf):
    """Total downtime and downtime frequency per machine."""
    return K.downtime_by(ctx.clean(spark, sf), "machine_id")


@query("downtime_by_shift", _downtime_oracle("shift"))
def downtime_by_shift(spark, sf):
    """Total downtime per shift."""
    return K.downtime_by(ctx.clean(spark, sf), "shift")


@query("operator_error_mean", rnd(on_clean("""SELECT operator_id, avg(error_rate) AS avg_error_rate
FROM clean WHERE operator_id IS NOT NULL GROUP BY operator_id"""), "avg_error_rate"))
def operator_error_mean(spark, sf):
    """Mean error rate per operator."""
    return K.error_by(ctx.clean(spark, sf), "operator_id", "mean")


@query("operator_error_total", rnd(on_clean("""SELECT operator_id, sum(error_rate) AS total_error_rate
FROM clean WHERE operator_id IS NOT NULL GROUP BY operator_id"""), "total_error_rate"))
def operator_error_total(spark, sf):
    """E12s: summed error rate per operator."""
    return K.error_by(ctx.clean(spark, sf), "operator_id", "sum")


@query("error_by_product", rnd(on_clean("""SELECT product_type, sum(error_rate) AS total_error_rate
FROM clean WHERE product_type IS NOT NULL GROUP BY product_type"""), "total_error_rate"))
def error_by_product(spark, sf):
    """Summed error rate per product type."""
    return K.error_by(ctx.clean(spark, sf), "product_type", "sum")


@query("worst_operator", rnd(on_clean("""SELECT operator_id, avg(error_rate) AS "value"
FROM clean WHERE operator_id IS NOT NULL GROUP BY operator_id
ORDER BY "value" DESC, operator_id ASC LIMIT 1"""), '"value"'))
def worst_operator(spark, sf):
    """The operator with the highest mean error (first id on ties)."""
    return K.worst(ctx.clean(spark, sf), "operator_id", "error_rate")


@query("operator_rank", rnd(on_clean("""SELECT operator_id, "value", round_even("value", 2) AS value_2dp,
  CAST(dense_rank() OVER (ORDER BY "value" DESC) AS INTEGER) AS "rank"
FROM (SELECT operator_id, avg(error_rate) AS "value" FROM clean
      WHERE operator_id IS NOT NULL GROUP BY operator_id) AS g"""), '"value"', "value_2dp"))
def operator_rank(spark, sf):
    """Operators ranked by mean error; value also shown at 2 decimals
    (half-even, as pandas rounds)."""
    r = K.rank_by(ctx.clean(spark, sf), "operator_id", "error_rate")
    return r.select("operator_id", "value", F.bround("value", 2).alias("value_2dp"), "rank")


@query("operator_defect_pct", rnd(on_clean("""SELECT operator_id,
  CAST(sum(units_produced) AS BIGINT) AS total_units_produced, CAST(sum(defect_count) AS BIGINT) AS total_defects,
  CASE WHEN sum(units_produced) = 0 AND sum(defect_count) = 0 THEN 0.0E0
       ELSE CAST(sum(defect_count) AS DOUBLE) / nullif(sum(units_produced), 0) * 100.0E0 END AS defect_percentage
FROM clean WHERE operator_id IS NOT NULL GROUP BY operator_id"""), "defect_percentage"))
def operator_defect_pct(spark, sf):
    """Defect percentage per operator (0/0 -> 0)."""
    return K.defect_pct_by(ctx.clean(spark, sf), "operator_id")


@query("good_vs_defective", rnd(on_clean("""SELECT CAST(sum(units_produced) AS BIGINT) AS total_units,
  CAST(sum(units_produced) - sum(defect_count) AS BIGINT) AS good_units,
  CAST(sum(defect_count) AS BIGINT) AS defective_units,
  CAST(sum(units_produced) - sum(defect_count) AS DOUBLE) / nullif(sum(units_produced), 0) * 100.0E0 AS good_pct,
  CAST(sum(defect_count) AS DOUBLE) / nullif(sum(units_produced), 0) * 100.0E0 AS defect_pct
FROM clean"""), "good_pct", "defect_pct"))
def good_vs_defective(spark, sf):
    """Good vs defective units and the overall defect percentage."""
    return K.good_vs_defective(ctx.clean(spark, sf))


_PRODUCT = """SELECT product_type, CAST(sum(defect_count) AS BIGINT) AS total_defects,
  CAST(sum(units_produced) AS BIGINT) AS units FROM clean WHERE product_type IS NOT NULL GROUP BY product_type"""


@query("defects_by_product", on_clean(f"SELECT product_type, total_defects FROM ({_PRODUCT}) AS g"))
def defects_by_product(spark, sf):
    """Q1: total defects per product type."""
    return K.defects_by(ctx.clean(spark, sf)).select("product_type", "total_defects")


@query("defect_pct_of_units", rnd(on_clean(f"""SELECT product_type,
  CAST(total_defects AS DOUBLE) / nullif((SELECT sum(units_produced) FROM clean), 0) * 100.0E0 AS defect_pct_of_units
FROM ({_PRODUCT}) AS g"""), "defect_pct_of_units"))
def defect_pct_of_units(spark, sf):
    """Q2: defects per product as a percentage of all units produced."""
    return K.defects_by(ctx.clean(spark, sf)).select("product_type", "defect_pct_of_units")


@query("defect_share", rnd(on_clean(f"""SELECT product_type,
  CAST(total_defects AS DOUBLE) / nullif((SELECT sum(defect_count) FROM clean), 0) AS defect_share
FROM ({_PRODUCT}) AS g"""), "defect_share"))
def defect_share(spark, sf):
    """Q3: each product's share of all defects (the pie chart)."""
    return K.defects_by(ctx.clean(spark, sf)).select("product_type", "defect_share")


_DEFECT_DIMS = ["machine_type", "machine_id", "lubrication_status", "product_type"]


@query("defect_rate_by_dim", rnd(on_clean(union(*[
    f"""SELECT '{d}' AS dim, CAST({d} AS VARCHAR) AS "key", avg(defect_count) AS avg_defect_count,
  count(*) AS "rows" FROM clean WHERE {d} IS NOT NULL GROUP BY {d}""" for d in _DEFECT_DIMS])),
    "avg_defect_count"))
def defect_rate_by_dim(spark, sf):
    """Q4-Q7: mean defect count by machine type, machine, lubrication status
    and product type (one grouping-sets pass)."""
    return K.defect_rate_by(ctx.clean(spark, sf), _DEFECT_DIMS)


@query("oee_minutes", rnd(on_clean("""SELECT *, availability * performance_ref * quality AS oee_ref,
  availability * performance_norm * quality AS oee_norm FROM (
  SELECT count(*) AS "rows", CAST(sum(units_produced) AS BIGINT) AS total_units,
    CAST(sum(defect_count) AS BIGINT) AS total_defects,
    count(*) * 60.0E0 - sum(downtime) AS run_time,
    (count(*) * 60.0E0 - sum(downtime)) / nullif(count(*) * 60.0E0, 0) AS availability,
    120.0E0 * sum(units_produced) / nullif(count(*) * 60.0E0 - sum(downtime), 0) AS performance_ref,
    120.0E0 * sum(units_produced) / nullif(count(*) * 60.0E0 - sum(downtime), 0) / 60.0E0 AS performance_norm,
    (sum(units_produced) - sum(defect_count)) / nullif(sum(units_produced), 0) AS quality
  FROM clean) AS o"""), *OEE_DOUBLES))
def oee_minutes(spark, sf):
    """E2 (minutes mode): every row is one hour and ``downtime`` its lost minutes."""
    return K.oee(ctx.clean(spark, sf), mode="minutes")
