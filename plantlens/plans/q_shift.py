"""Registered queries G1-G12 and Q9 (shift-efficiency study) on the cleaned log."""

from __future__ import annotations

from pyspark.sql import functions as F

from plantlens.operators import cluster as K
from plantlens.operators import shift as G
from plantlens.plans import context as ctx
from plantlens.plans.context import SHIFT_K, SHIFT_LABEL as LBL
from plantlens.plans.oracle import lloyd_sql, on_clean, restarts_sql, zscore_sql
from plantlens.plans.q_cluster import k_selection_sql
from plantlens.plans.registry import query, rnd
from plantlens.schema import EFF4, SHIFT_KEYS

KEYS = ", ".join(SHIFT_KEYS)
Z4 = [f"{c}_z" for c in EFF4]
_SI = """CAST(CAST("timestamp" AS DATE) AS VARCHAR) || '_' || shift"""
_SHIFT_CTE = f""",
sa AS (SELECT shift_instance_id, machine_id, line_id, CAST(sum(units_produced) AS BIGINT) AS units_produced,
         sum(downtime) AS downtime, avg(error_rate) AS error_rate, avg(cycle_time) AS cycle_time
       FROM (SELECT *, {_SI} AS shift_instance_id FROM clean) AS c
       WHERE shift_instance_id IS NOT NULL AND machine_id IS NOT NULL AND line_id IS NOT NULL
       GROUP BY shift_instance_id, machine_id, line_id),
se AS (SELECT *, 1.0E0 - error_rate AS efficiency_error_rate, 1.0E0 / (1.0E0 + downtime) AS efficiency_downtime,
         1.0E0 / (1.0E0 + cycle_time) AS efficiency_cycle_time,
         CAST(units_produced AS DOUBLE) AS efficiency_units_produced FROM sa)"""
_SZ = _SHIFT_CTE + zscore_sql("se", EFF4, "sz")
_SK = _SZ + lloyd_sql("sz", Z4, SHIFT_K, "units_produced", "sk")
_LOGK = f""",
logk AS (SELECT c.*, {_SI} AS shift_instance_id_, k.lbl AS {LBL}
         FROM clean c LEFT JOIN sk k ON k.shift_instance_id = ({_SI.replace('"timestamp"', 'c."timestamp"')})
           AND k.machine_id = c.machine_id AND k.line_id = c.line_id)"""
METRICS = ["units_produced", "downtime", "error_rate", "cycle_time"]


@query("shift_instances", on_clean(f"""SELECT shift_instance_id, CAST(d AS VARCHAR) AS "date", shift,
  count(*) AS "rows" FROM (SELECT CAST("timestamp" AS DATE) AS d, shift, {_SI} AS shift_instance_id FROM clean) AS s
GROUP BY shift_instance_id, d, shift"""))
def shift_instances(spark, sf):
    """Calendar date and shift-instance key, rows per instance."""
    s = G.with_shift_instance(ctx.clean(spark, sf))
    return s.groupBy("shift_instance_id", F.col("date").cast("string").alias("date"), "shift").agg(
        F.count(F.lit(1)).alias("rows"))


@query("shift_agg", rnd(on_clean("SELECT * FROM sa", _SHIFT_CTE), "downtime", "error_rate", "cycle_time"))
def shift_agg(spark, sf):
    """Units, downtime, error and cycle time per (shift instance, machine, line)."""
    return G.shift_agg(G.with_shift_instance(ctx.clean(spark, sf)))


@query("shift_efficiency", rnd(on_clean("SELECT * FROM se", _SHIFT_CTE), "downtime", "error_rate", "cycle_time", *EFF4, digits=10),
       digits=10)
def shift_efficiency(spark, sf):
    """The shift table with the four efficiency scores."""
    return G.shift_efficiency_table(ctx.clean(spark, sf))


@query("shift_efficiency_z", rnd(on_clean(f"SELECT {KEYS}, {', '.join(Z4)} FROM sz", _SZ), *Z4))
def shift_efficiency_z(spark, sf):
    """Z-scores (ddof 0) of the efficiency scores."""
    zdf, zcols = ctx.shift_z(spark, sf)
    return zdf.select(*SHIFT_KEYS, *zcols)


@query("shift_cluster_profile", rnd(on_clean(f"""SELECT lbl AS {LBL}, count(*) AS "rows",
  {', '.join(f'avg({m}) AS {m}' for m in METRICS)} FROM sk GROUP BY lbl""", _SK), *METRICS))
def shift_cluster_profile(spark, sf):
    """Mean units, downtime, error and cycle time per shift cluster (K8)."""
    lab, _ = ctx.shift_labels(spark, sf)
    return K.centroid_profile(lab, LBL, METRICS)


@query("shift_cluster_sizes", on_clean(f'SELECT lbl AS {LBL}, count(*) AS "rows" FROM sk GROUP BY lbl', _SK))
def shift_cluster_sizes(spark, sf):
    """Shift-level rows per cluster."""
    lab, _ = ctx.shift_labels(spark, sf)
    return K.cluster_sizes(lab, LBL)


@query("shift_cluster_names", rnd(on_clean(f"""SELECT lbl AS {LBL},
  CASE WHEN row_number() OVER (ORDER BY u DESC, lbl ASC) = 1 THEN 'Higher Efficiency' ELSE 'Lower Efficiency' END
    AS efficiency, u AS units_produced
FROM (SELECT lbl, avg(units_produced) AS u FROM sk GROUP BY lbl) AS p""", _SK), "units_produced"))
def shift_cluster_names(spark, sf):
    """Clusters named by mean output, not by label number."""
    lab, _ = ctx.shift_labels(spark, sf)
    prof = K.centroid_profile(lab, LBL, ["units_produced"])
    names = K.name_shift_clusters({r[LBL]: {"units_produced": r["units_produced"]} for r in prof.collect()})
    return K.names_frame(prof, LBL, names, "efficiency").select(LBL, "efficiency", "units_produced")


def _attached(spark, sf):
    lab, _ = ctx.shift_labels(spark, sf)
    log = G.with_shift_instance(ctx.clean(spark, sf))
    return G.attach(log, lab, SHIFT_KEYS, LBL)


@query("attach_shift_cluster", on_clean(f"""SELECT strftime("timestamp", '%Y-%m-%d %H:%M:%S') AS "timestamp",
  machine_id, line_id, shift, shift_instance_id_ AS shift_instance_id, {LBL} FROM logk""", _SK, _LOGK))
def attach_shift_cluster(spark, sf):
    """Shift-cluster labels joined back to every observation (left join
    on the three keys; the row count is unchanged)."""
    return _attached(spark, sf).select(F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
                                       "machine_id", "line_id", "shift", "shift_instance_id", LBL)


@query("shift_mix", on_clean(f"""SELECT {LBL}, shift, count(*) AS "count" FROM logk
WHERE {LBL} IS NOT NULL AND shift IS NOT NULL GROUP BY {LBL}, shift""", _SK, _LOGK))
def shift_mix(spark, sf):
    """Observations of each shift inside each shift cluster."""
    return G.label_mix(_attached(spark, sf), LBL, "shift")


@query("defect_rate_by_shift_cluster", rnd(on_clean(f"""SELECT {LBL}, avg(defect_count) AS avg_defect_count,
  count(*) AS "rows" FROM logk WHERE {LBL} IS NOT NULL GROUP BY {LBL}""", _SK, _LOGK), "avg_defect_count"))
def defect_rate_by_shift_cluster(spark, sf):
    """Q9: mean defect count per shift cluster (labels joined back to the log)."""
    return _attached(spark, sf).filter(F.col(LBL).isNotNull()).groupBy(LBL).agg(F.avg("defect_count").alias("avg_defect_count"),
                                                 F.count(F.lit(1)).alias("rows"))


_CURVE, _CURVE_ROWS = k_selection_sql("sz", Z4, range(1, 11), "units_produced", range(2, 10), 60)


@query("shift_k_selection", rnd(on_clean(_CURVE_ROWS, _SZ, _CURVE), "inertia", "silhouette", "davies_bouldin"))
def shift_k_selection(spark, sf):
    """Inertia (k = 1..10), squared silhouette and Davies-Bouldin (k = 2..9) of K8 run
    to rest on the shift table."""
    found = ctx.k_indices(spark, sf, "shift", ctx.shift_points, range(1, 11), "units_produced")
    rows = [(k, float(v[0]), *(v[1:] if 2 <= k <= 9 else (None, None))) for k, v in found.items()]
    return spark.createDataFrame(rows, "k int, inertia double, silhouette double, davies_bouldin double")


_BEST = _SZ + restarts_sql("sz", Z4, ", ".join(f"coalesce({c}, '')" for c in SHIFT_KEYS), SHIFT_K, ctx.RESTARTS, "sb")


@query("shift_clusters", rnd(on_clean(f"""SELECT CASE WHEN row_number() OVER (ORDER BY units_produced DESC, lbl) = 1
  THEN 'Higher Efficiency' ELSE 'Lower Efficiency' END AS efficiency, "rows", {', '.join(METRICS)}
FROM (SELECT lbl, count(*) AS "rows", {', '.join(f'avg({m}) AS {m}' for m in METRICS)} FROM sb GROUP BY lbl) AS p""", _BEST), *METRICS))
def shift_clusters(spark, sf):
    """K-Means k=2 run to rest, the best of 10 restarts seeded by squared distance, on the
    shift table, clusters named by mean output, with their profile in original units."""
    zdf, zcols = ctx.shift_z(spark, sf)
    lab = zdf.withColumn(LBL, K.nearest(zcols, ctx.shift_best(spark, sf)))
    prof = K.centroid_profile(lab, LBL, METRICS)
    names = K.name_shift_clusters({r[LBL]: {"units_produced": r["units_produced"]} for r in prof.collect()})
    return K.names_frame(prof, LBL, names, "efficiency").select("efficiency", "rows", *METRICS)


_SI_BIZ = """CAST(CAST("timestamp" - INTERVAL '6' HOUR AS DATE) AS VARCHAR) || '_' || shift"""


@query("shift_instances_business_day", on_clean(f"""SELECT shift_instance_id, CAST(d AS VARCHAR) AS "date", shift,
  count(*) AS "rows" FROM (SELECT CAST("timestamp" - INTERVAL '6' HOUR AS DATE) AS d, shift,
                                 {_SI_BIZ} AS shift_instance_id FROM clean) AS s
GROUP BY shift_instance_id, d, shift"""))
def shift_instances_business_day(spark, sf):
    """G1/G2 with ``business_day=True``: rows are dated by ts - 6 h, so a night
    shift (22-06) is one instance instead of two split at midnight."""
    s = G.with_shift_instance(ctx.clean(spark, sf), business_day=True)
    return s.groupBy("shift_instance_id", F.col("date").cast("string").alias("date"), "shift").agg(
        F.count(F.lit(1)).alias("rows"))
