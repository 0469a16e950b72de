"""Registered queries D1-D7 (exploratory statistics) on the cleaned log."""

from __future__ import annotations

from pyspark.sql import functions as F

from plantlens.operators import eda as D
from plantlens.plans import context as ctx
from plantlens.plans.oracle import on_clean
from plantlens.plans.registry import query, rnd, union
from plantlens.schema import NUMERIC16, TEMP_CORR5


def _corr_oracle(cols) -> str:
    sel = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            if j < i:
                continue
            r = f"covar_pop({a}, {b}) / nullif(stddev_pop({a}) * stddev_pop({b}), 0)"
            sel.append(f"SELECT '{a}' AS x, '{b}' AS y, {r} AS r FROM clean")
            if i != j:
                sel.append(f"SELECT '{b}' AS x, '{a}' AS y, {r} AS r FROM clean")
    return rnd(on_clean(union(*sel)), "r")


@query("corr_matrix", _corr_oracle(NUMERIC16))
def corr_matrix(spark, sf):
    """16 x 16 Pearson matrix in long form (one aggregate)."""
    return D.corr_matrix(ctx.clean(spark, sf), NUMERIC16)


@query("corr_with_temperature", rnd(on_clean(union(*[
    f"SELECT '{c}' AS feature, corr(temperature, {c}) AS r FROM clean" for c in TEMP_CORR5[1:]])), "r"))
def corr_with_temperature(spark, sf):
    """Correlation of temperature with power, error, downtime, units."""
    return D.corr_with(ctx.clean(spark, sf), "temperature", TEMP_CORR5)


def _strength_oracle(cols) -> str:
    sel = [f"SELECT '{a}' AS x, '{b}' AS y, corr({a}, {b}) AS r FROM clean"
           for i, a in enumerate(cols) for j, b in enumerate(cols) if i < j]
    return rnd(on_clean(f"""SELECT x, y, r, CASE WHEN r IS NULL THEN 'undefined'
  WHEN abs(r) >= 0.5 THEN 'strong' WHEN abs(r) >= 0.2 THEN 'moderate' ELSE 'weak' END AS strength
FROM ({union(*sel)}) AS p"""), "r")


@query("corr_strength", _strength_oracle(NUMERIC16))
def corr_strength(spark, sf):
    """D2r: every distinct sensor pair with its strength band."""
    return D.corr_pairs(ctx.clean(spark, sf), NUMERIC16)


_HIST = on_clean("""SELECT CAST(k.i AS INTEGER) AS bin, k.i * step + mn AS bin_lo,
  CASE WHEN k.i + 1 < 30 THEN (k.i + 1) * step + mn ELSE mx END AS bin_hi,
  CAST(coalesce(c.n, 0) AS BIGINT) AS "count"
FROM range(30) AS k(i) CROSS JOIN st
LEFT JOIN (SELECT b, count(*) AS n FROM binned GROUP BY b) AS c ON c.b = k.i""",
                 """,
st AS (SELECT min(cycle_time) AS mn, max(cycle_time) AS mx, (max(cycle_time) - min(cycle_time)) / 30.0E0 AS step
       FROM clean),
binned AS (SELECT (SELECT count(*) FROM range(1, 30) AS e(k) WHERE cycle_time >= e.k * step + mn) AS b
           FROM clean CROSS JOIN st WHERE cycle_time IS NOT NULL)""")


@query("hist_cycle_time", rnd(_HIST, "bin_lo", "bin_hi"))
def hist_cycle_time(spark, sf):
    """D3: 30-bin histogram of cycle time (empty bins kept)."""
    return D.histogram(ctx.clean(spark, sf), "cycle_time", 30)


def _kde_sql(c: str) -> str:
    return on_clean(f"""SELECT CAST(r.i AS INTEGER) AS i, g0 + r.i * step AS x,
  sum(w * exp(-0.5E0 * ((g0 + r.i * step - v) / bw) * ((g0 + r.i * step - v) / bw)))
    * (1.0E0 / (n * bw * sqrt(2.0E0 * pi()))) AS density
FROM grid CROSS JOIN range(200) AS r(i) CROSS JOIN vals
GROUP BY r.i, g0, step, n, bw""", f""",
st AS (SELECT count({c}) AS n, stddev_samp({c}) AS sd, min({c}) AS lo, max({c}) AS hi FROM clean),
bwt AS (SELECT *, sd * pow(n, -0.2E0) AS bw FROM st),
grid AS (SELECT *, lo - 3.0E0 * bw AS g0, ((hi + 3.0E0 * bw) - (lo - 3.0E0 * bw)) / 199.0E0 AS step FROM bwt),
vals AS (SELECT {c} AS v, count(*) AS w FROM clean WHERE {c} IS NOT NULL GROUP BY {c})""")


@query("kde_cycle_time", rnd(_kde_sql("cycle_time"), "x", "density"))
def kde_cycle_time(spark, sf):
    """Gaussian KDE (Scott bandwidth, 200 grid points) of cycle time."""
    return D.kde(ctx.clean(spark, sf), "cycle_time")


@query("kde_ambient_temperature", rnd(_kde_sql("ambient_temperature"), "x", "density"))
def kde_ambient_temperature(spark, sf):
    """D4 of a continuous column, against the estimate over every single value."""
    return D.kde(ctx.clean(spark, sf), "ambient_temperature")


_CUT_CTE = """,
cst AS (SELECT min(cycle_time) AS mn, max(cycle_time) AS mx, (max(cycle_time) - min(cycle_time)) / 5.0E0 AS step
        FROM clean),
edges AS (SELECT CAST(k AS INTEGER) AS k,
  CASE WHEN k = 0 THEN (0 * step + mn) - (mx - mn) * 0.001E0 WHEN k = 5 THEN mx ELSE k * step + mn END AS e
  FROM range(6) AS t(k) CROSS JOIN cst),
cbin AS (SELECT clean.*, 1 + (SELECT count(*) FROM edges WHERE k BETWEEN 1 AND 4 AND cycle_time > e) AS bin_idx
         FROM clean WHERE cycle_time IS NOT NULL)"""


@query("cut_cycle_time", rnd(on_clean("""SELECT g.cycle_time, CAST(g.bin_idx AS INTEGER) AS bin_idx,
  lo.e AS bin_lo, hi.e AS bin_hi, g.n AS "rows"
FROM (SELECT cycle_time, bin_idx, count(*) AS n FROM cbin GROUP BY cycle_time, bin_idx) AS g
JOIN edges lo ON lo.k = g.bin_idx - 1 JOIN edges hi ON hi.k = g.bin_idx""", _CUT_CTE),
    "cycle_time", "bin_lo", "bin_hi"))
def cut_cycle_time(spark, sf):
    """Pandas-style cut of cycle time into 5 right-closed bins."""
    binned, _ = D.cut(ctx.clean(spark, sf), "cycle_time", 5)
    return binned.groupBy("cycle_time", "bin_idx", "bin_lo", "bin_hi").agg(F.count(F.lit(1)).alias("rows"))


_PROFILE = """SELECT CAST(e.k + 1 AS INTEGER) AS bin_idx, e.e AS bin_lo, e2.e AS bin_hi,
  avg(c.defect_count) AS avg_defect_count, avg(c.error_rate) AS avg_error_rate,
  CAST(coalesce(sum(c.units_produced), 0) AS BIGINT) AS total_units_produced, count(c.bin_idx) AS "rows"
FROM edges e JOIN edges e2 ON e2.k = e.k + 1
LEFT JOIN cbin c ON c.bin_idx = e.k + 1
GROUP BY e.k, e.e, e2.e"""


@query("cycle_time_bins", rnd(on_clean(_PROFILE, _CUT_CTE), "bin_lo", "bin_hi", "avg_defect_count",
                              "avg_error_rate"))
def cycle_time_bins(spark, sf):
    """Defects, errors and units per cycle-time bin (empty bins kept)."""
    binned, edges = D.cut(ctx.clean(spark, sf), "cycle_time", 5)
    return D.bin_profile(binned, edges)


@query("best_cycle_bin", rnd(on_clean(f"SELECT * FROM ({_PROFILE}) AS p "
                                      "ORDER BY total_units_produced DESC, bin_idx ASC LIMIT 1", _CUT_CTE),
                             "bin_lo", "bin_hi", "avg_defect_count", "avg_error_rate"))
def best_cycle_bin(spark, sf):
    """The cycle-time bin with the most units produced."""
    binned, edges = D.cut(ctx.clean(spark, sf), "cycle_time", 5)
    return D.best_bin(D.bin_profile(binned, edges))
