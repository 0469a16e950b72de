"""Registered queries C1-C6 (cleaning)."""

from __future__ import annotations

from pyspark.sql import functions as F

from plantlens.operators import clean as C
from plantlens.plans import context as ctx
from plantlens.plans.oracle import NULLABLE, lower, on_clean, on_imputed, quartiles_sql, upper, with_plant, \
    imputed_sql, clean_sql
from plantlens.plans.registry import query, rnd, union
from plantlens.schema import ALL_NUMERIC, BOX15, CLIP14, NUMERIC16

LOG_COLS = "* EXCLUDE (true_state)"


@query("impute_mean", rnd(on_imputed(f"SELECT {LOG_COLS} FROM imputed"), *NULLABLE))
def impute_mean(spark, sf):
    """The log with NULL sensors replaced by the column mean."""
    return ctx.imputed(spark, sf)


def _iqr_oracle() -> str:
    sel = [f"""SELECT '{c}' AS "column", CAST(q1_{c} AS DOUBLE) AS q1, CAST(q3_{c} AS DOUBLE) AS q3,
  CAST(q3_{c} - q1_{c} AS DOUBLE) AS iqr, CAST({lower(c)} AS DOUBLE) AS lower_bound,
  CAST({upper(c)} AS DOUBLE) AS upper_bound,
  CAST(count(*) FILTER (WHERE {c} < {lower(c)} OR {c} > {upper(c)}) AS BIGINT) AS n_outliers
FROM imputed CROSS JOIN qa GROUP BY q1_{c}, q3_{c}""" for c in ALL_NUMERIC]
    return rnd(with_plant(imputed_sql(), quartiles_sql("imputed", ALL_NUMERIC, "qa")) + "\n" + union(*sel),
               "q1", "q3", "iqr", "lower_bound", "upper_bound")


@query("iqr_outliers", _iqr_oracle())
def iqr_outliers(spark, sf):
    """Per numeric column the IQR fences and the rows strictly outside them
    (after imputation, before clipping)."""
    df, known = ctx.imputed(spark, sf), ctx.bounds(spark, sf)
    return C.iqr_outliers(df, ALL_NUMERIC, {**known, **C.iqr_bounds(df, [c for c in ALL_NUMERIC if c not in known])})


def _outlier_rows_oracle() -> str:
    sel = [f"""SELECT '{c}' AS "column", imputed.{LOG_COLS} FROM imputed CROSS JOIN qa
WHERE {c} < {lower(c)} OR {c} > {upper(c)}""" for c in ALL_NUMERIC]
    return rnd(with_plant(imputed_sql(), quartiles_sql("imputed", ALL_NUMERIC, "qa")) + "\n" + union(*sel), *NULLABLE)


@query("outlier_rows", _outlier_rows_oracle())
def outlier_rows(spark, sf):
    """C3r: for each of the numeric columns, the rows that lie outside its IQR fences."""
    df, known = ctx.imputed(spark, sf), ctx.bounds(spark, sf)
    return C.all_outlier_rows(df, {**known, **C.iqr_bounds(df, [c for c in ALL_NUMERIC if c not in known])})


@query("winsorize", rnd(on_clean(f"SELECT {LOG_COLS} FROM clean"), *CLIP14))
def winsorize(spark, sf):
    """C4: the imputed log with 14 sensor columns clipped to their IQR fences."""
    return ctx.clean(spark, sf)


def _box_oracle(src_parts, src: str, cols) -> str:
    q = ", ".join(f"quantile_cont({c}, 0.25) AS q1_{c}, quantile_cont({c}, 0.5) AS q2_{c}, "
                  f"quantile_cont({c}, 0.75) AS q3_{c}" for c in cols)
    sel = [f"""SELECT '{c}' AS "column", CAST(q1_{c} AS DOUBLE) AS q1, CAST(q2_{c} AS DOUBLE) AS median,
  CAST(q3_{c} AS DOUBLE) AS q3,
  CAST(min({c}) FILTER (WHERE {c} >= {lower(c)} AND {c} <= {upper(c)}) AS DOUBLE) AS whisker_lo,
  CAST(max({c}) FILTER (WHERE {c} >= {lower(c)} AND {c} <= {upper(c)}) AS DOUBLE) AS whisker_hi,
  CAST(count(*) FILTER (WHERE {c} IS NOT NULL AND NOT ({c} >= {lower(c)} AND {c} <= {upper(c)})) AS BIGINT)
    AS n_fliers
FROM {src} CROSS JOIN bq GROUP BY q1_{c}, q2_{c}, q3_{c}""" for c in cols]
    return rnd(with_plant(*src_parts, f",\nbq AS (SELECT {q} FROM {src})") + "\n" + union(*sel),
               "q1", "median", "q3", "whisker_lo", "whisker_hi")


@query("box_stats_raw", _box_oracle([imputed_sql()], "imputed", BOX15))
def box_stats_raw(spark, sf):
    """Box-plot statistics of 15 columns before clipping."""
    return C.box_stats(ctx.imputed(spark, sf), BOX15, ctx.bounds(spark, sf))


@query("box_stats_clipped", _box_oracle([clean_sql()], "clean", NUMERIC16))
def box_stats_clipped(spark, sf):
    """Box-plot statistics of 16 columns after clipping."""
    return C.box_stats(ctx.clean(spark, sf), NUMERIC16)


def _clean_summary_oracle() -> str:
    sel = []
    for c in CLIP14:
        mean = f"(SELECT m_{c} FROM means)" if c in NULLABLE else "CAST(NULL AS DOUBLE)"
        sel.append(f"""SELECT '{c}' AS "column",
  (SELECT CAST(count(*) FILTER (WHERE {c} IS NULL) AS BIGINT) FROM plant) AS n_null,
  CAST({mean} AS DOUBLE) AS fill_value,
  CAST({lower(c)} AS DOUBLE) AS lower_bound, CAST({upper(c)} AS DOUBLE) AS upper_bound,
  CAST(count(*) FILTER (WHERE {c} < {lower(c)}) AS BIGINT) AS n_clipped_low,
  CAST(count(*) FILTER (WHERE {c} > {upper(c)}) AS BIGINT) AS n_clipped_high
FROM imputed CROSS JOIN fences GROUP BY q1_{c}, q3_{c}""")
    return rnd(with_plant(imputed_sql(), quartiles_sql("imputed", CLIP14, "fences")) + "\n" + union(*sel),
               "fill_value", "lower_bound", "upper_bound")


@query("clean_summary", _clean_summary_oracle())
def clean_summary(spark, sf):
    """The audit trail of the clean chain per clipped column: NULLs filled
    (and the fill value), the fences, rows clipped low and high."""
    cl = ctx.cleaned(spark, sf)
    return C.clean_summary(cl, CLIP14)


_BOX_BY = ["temperature", "vibration_level", "power_consumption", "noise_level_db"]


def _box_by_oracle(src_parts, src: str, cols, by: str) -> str:
    q = ", ".join(f"quantile_cont({c}, 0.25) AS q1_{c}, quantile_cont({c}, 0.5) AS q2_{c}, "
                  f"quantile_cont({c}, 0.75) AS q3_{c}" for c in cols)
    sel = [f"""SELECT s.{by}, '{c}' AS "column", CAST(q1_{c} AS DOUBLE) AS q1, CAST(q2_{c} AS DOUBLE) AS median,
  CAST(q3_{c} AS DOUBLE) AS q3,
  CAST(min({c}) FILTER (WHERE {c} >= {lower(c)} AND {c} <= {upper(c)}) AS DOUBLE) AS whisker_lo,
  CAST(max({c}) FILTER (WHERE {c} >= {lower(c)} AND {c} <= {upper(c)}) AS DOUBLE) AS whisker_hi,
  CAST(count(*) FILTER (WHERE {c} IS NOT NULL AND NOT ({c} >= {lower(c)} AND {c} <= {upper(c)})) AS BIGINT)
    AS n_fliers
FROM {src} s JOIN gq ON gq.{by} = s.{by} GROUP BY s.{by}, q1_{c}, q2_{c}, q3_{c}""" for c in cols]
    return rnd(with_plant(*src_parts, f",\ngq AS (SELECT {by}, {q} FROM {src} WHERE {by} IS NOT NULL GROUP BY {by})")
               + "\n" + union(*sel), "q1", "median", "q3", "whisker_lo", "whisker_hi")


@query("box_stats_by_machine_type", _box_by_oracle([imputed_sql()], "imputed", _BOX_BY, "machine_type"))
def box_stats_by_machine_type(spark, sf):
    """C5 grouped: box-plot statistics of four sensors per machine type (before clipping)."""
    v = ctx.version(spark, sf)
    stages = iter(range(100))
    return C.box_stats_by(ctx.imputed(spark, sf), _BOX_BY, "machine_type", lambda df: v.table(f"box-by-{next(stages)}", lambda: df))
