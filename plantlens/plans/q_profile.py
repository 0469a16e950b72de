"""Registered queries B1-B12 (profiling)."""

from __future__ import annotations

from pyspark.sql import functions as F

from plantlens.operators import profile as B
from plantlens.operators.shift import with_shift_instance
from plantlens.plans import context as ctx
from plantlens.plans.oracle import NULLABLE, on_clean, on_imputed, on_plant
from plantlens.plans.registry import query, rnd, union
from plantlens.schema import ALL_NUMERIC, LOG_SCHEMA, PROFILE8

LOG = [f.name for f in LOG_SCHEMA.fields]
ORDER = ", ".join(f'"{c}" ASC NULLS LAST' for c in LOG)


@query("preview_top20", rnd(on_plant(f"SELECT * EXCLUDE (true_state) FROM plant ORDER BY {ORDER} LIMIT 20"),
                            *NULLABLE))
def preview_top20(spark, sf):
    """B1: the first 20 rows of the log in (timestamp, ids, measures) order."""
    return B.preview(ctx.plant(spark, sf), 20)


@query("stringify", rnd(on_plant(f"""SELECT * EXCLUDE (true_state) REPLACE
  (strftime("timestamp", '%Y-%m-%d %H:%M:%S') AS "timestamp") FROM plant"""), *NULLABLE))
def stringify(spark, sf):
    """The whole log with the timestamp rendered as text."""
    return B.stringify(ctx.plant(spark, sf))


def _describe_oracle() -> str:
    sel = [f"""SELECT '{c}' AS "column", count({c}) AS "count", avg({c}) AS mean, stddev_samp({c}) AS std,
  CAST(min({c}) AS DOUBLE) AS "min", CAST(quantile_cont({c}, 0.25) AS DOUBLE) AS q25,
  CAST(quantile_cont({c}, 0.5) AS DOUBLE) AS q50, CAST(quantile_cont({c}, 0.75) AS DOUBLE) AS q75,
  CAST(max({c}) AS DOUBLE) AS "max" FROM plant""" for c in ALL_NUMERIC]
    return rnd(on_plant(union(*sel)), "mean", "std", '"min"', "q25", "q50", "q75", '"max"')


@query("describe_long", _describe_oracle())
def describe_long(spark, sf):
    """B2: describe() of every numeric column of the raw log, one row per column."""
    return B.describe(ctx.plant(spark, sf), ALL_NUMERIC)


@query("column_info", on_plant(union(*[
    f"""SELECT '{c}' AS "column", typeof(any_value("{c}")) AS dtype, count("{c}") AS non_null,
  count(*) FILTER (WHERE "{c}" IS NULL) AS "null", count(DISTINCT "{c}") AS n_unique FROM plant""" for c in LOG])))
def column_info(spark, sf):
    """Dtype, non-null, null and distinct counts of every column."""
    return B.column_info(ctx.plant(spark, sf))


@query("null_counts", on_plant(union(*[
    f"""SELECT '{c}' AS "column", count(*) FILTER (WHERE "{c}" IS NULL) AS n_null FROM plant""" for c in LOG])))
def null_counts(spark, sf):
    """NULLs per column before imputation."""
    return B.null_counts(ctx.plant(spark, sf))


@query("dup_rows", on_imputed("""SELECT count(*) - (SELECT count(*) FROM
  (SELECT DISTINCT * EXCLUDE (true_state) FROM imputed) AS d) AS dup_rows FROM imputed"""))
def dup_rows(spark, sf):
    """Duplicate rows over all columns after imputation."""
    return B.dup_rows(ctx.imputed(spark, sf))


@query("value_counts", on_plant(union(*[
    f"""SELECT '{c}' AS "column", CAST({c} AS VARCHAR) AS "value", count(*) AS "count"
FROM plant WHERE {c} IS NOT NULL GROUP BY {c}""" for c in PROFILE8])))
def value_counts(spark, sf):
    """Value counts of the seven id columns and defect_count, one scan."""
    return B.value_counts(ctx.plant(spark, sf), PROFILE8)


_SHIFT_ID = """CAST(CAST("timestamp" AS DATE) AS VARCHAR) || '_' || shift"""


@query("top_shift_instances", on_plant(f"""SELECT shift_instance_id, count(*) AS "count"
FROM (SELECT {_SHIFT_ID} AS shift_instance_id FROM plant) AS s WHERE shift_instance_id IS NOT NULL
GROUP BY shift_instance_id ORDER BY "count" DESC, shift_instance_id ASC LIMIT 23"""))
def top_shift_instances(spark, sf):
    """The 23 most frequent shift instances (top-n is the feature)."""
    return B.value_counts_top(with_shift_instance(ctx.plant(spark, sf)), "shift_instance_id", 23)


@query("n_shift_instances", on_plant(f"SELECT count(DISTINCT {_SHIFT_ID}) AS n_unique FROM plant"))
def n_shift_instances(spark, sf):
    """Number of distinct shift instances."""
    return B.n_unique(with_shift_instance(ctx.plant(spark, sf)), "shift_instance_id")


@query("time_span", on_plant("""SELECT strftime(min("timestamp"), '%Y-%m-%d %H:%M:%S') AS first_ts,
  strftime(max("timestamp"), '%Y-%m-%d %H:%M:%S') AS last_ts,
  date_diff('second', min("timestamp"), max("timestamp")) / 3600.0E0 AS hours FROM plant"""))
def time_span(spark, sf):
    """first/last timestamp and the covered hours."""
    return B.time_span(ctx.plant(spark, sf))


@query("downtime_rows", on_clean("SELECT count(*) FILTER (WHERE downtime > 0) AS \"rows\" FROM clean"))
def downtime_rows(spark, sf):
    """Rows with downtime > 0."""
    return B.count_where(ctx.clean(spark, sf), F.col("downtime") > 0)


@query("shape", on_clean("SELECT count(*) AS n_rows, 27 AS n_columns FROM clean"))
def shape(spark, sf):
    """Rows x columns of the cleaned log."""
    return B.shape(ctx.clean(spark, sf))
