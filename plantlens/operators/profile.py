"""Profiling reports (head, describe, info, nulls, duplicates, value counts...).

Wide statistics are computed in one aggregate per report (never one job per
column) and then turned long with ``inline`` of a literal-tagged struct array.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plantlens.functions.stats import column_stats, quantiles
from plantlens.operators.clean import numeric_columns


def preview(df: DataFrame, n: int = 20, order_by: Sequence[str] | None = None) -> DataFrame:
    """B1: first ``n`` rows in a stated order (Spark has no file order).
    ``orderBy().limit()`` runs as a per-partition top-n (TakeOrderedAndProject)."""
    keys = list(order_by) if order_by else df.columns
    return df.orderBy(*[F.col(c).asc_nulls_last() for c in keys]).limit(n)


SQL_TYPE = {T.DoubleType: "DOUBLE", T.FloatType: "FLOAT", T.IntegerType: "INTEGER",
            T.LongType: "BIGINT", T.StringType: "VARCHAR", T.TimestampNTZType: "TIMESTAMP",
            T.TimestampType: "TIMESTAMP WITH TIME ZONE", T.DateType: "DATE", T.BooleanType: "BOOLEAN",
            T.ShortType: "SMALLINT", T.ByteType: "TINYINT"}


def sql_type(dt: T.DataType) -> str:
    return SQL_TYPE.get(type(dt), dt.simpleString().upper())


def _long(agg_df: DataFrame, rows: list[Column]) -> DataFrame:
    return agg_df.select(F.inline(F.array(*rows)))


def describe(df: DataFrame, cols: Sequence[str] | None = None, method: str = "exact") -> DataFrame:
    """B2: count, mean, std (ddof 1), min, quartiles, max per numeric column;
    one row per column (the dashboard's transposed form)."""
    cols = list(cols) if cols is not None else numeric_columns(df)
    v = F.col("v")
    st = column_stats(df, cols, {"n": F.count(v), "m": F.avg(v), "s": F.stddev_samp(v),
                                 "lo": F.min(v), "hi": F.max(v)})
    qs = quantiles(df, cols, [0.25, 0.5, 0.75], method=method)
    rows = []
    for c in cols:
        r = st.get(c)
        rows.append((c, r["n"] if r else 0, r["m"] if r else None, r["s"] if r else None,
                     r["lo"] if r else None, qs[c][0], qs[c][1], qs[c][2], r["hi"] if r else None))
    return df.sparkSession.createDataFrame(
        rows, "column string, count long, mean double, std double, min double, q25 double, q50 double, "
              "q75 double, max double")


def column_info(df: DataFrame) -> DataFrame:
    """Column, SQL type, non-null, null and distinct counts.

    Long form: every row gives one (column number, value as text) pair per
    column; pairs are counted by value (combined per task, two fields per row,
    spread over all tasks by value), then by column.  Values print differently
    exactly when they differ (-0.0 as 0.0)."""
    fields = df.schema.fields
    texts = []
    for f in fields:
        x = F.col(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            x = x + F.lit(0.0)
        texts.append(x.cast("string"))
    pairs = df.select(F.posexplode(F.array(*texts)).alias("i", "v"))
    values = pairs.groupBy("i", "v").agg(F.count(F.lit(1)).alias("n"))
    known = F.col("v").isNotNull()
    per = values.groupBy("i").agg(
        F.coalesce(F.sum(F.when(known, F.col("n"))), F.lit(0)).alias("non_null"),
        F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("null"), F.count("v").alias("n_unique"))
    got = {r["i"]: r for r in per.collect()}  # one row per column
    return df.sparkSession.createDataFrame(
        [(f.name, sql_type(f.dataType), *((got[i]["non_null"], got[i]["null"], got[i]["n_unique"]) if i in got else (0, 0, 0)))
         for i, f in enumerate(fields)], "column string, dtype string, non_null long, null long, n_unique long")


def null_counts(df: DataFrame) -> DataFrame:
    """NULL count per column."""
    return _long(df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]),
                 [F.struct(F.lit(c).alias("column"), F.col(c).cast("long").alias("n_null"))
                  for c in df.columns])


def dup_rows(df: DataFrame) -> DataFrame:
    """Rows that repeat an earlier row over all columns (NULL equals NULL).

    Two steps so the full rows are not shuffled: (1) group by a 64-bit hash
    of the row (8 bytes per row cross the network; partial aggregation folds
    a hot group of copies per task) and keep hashes seen more than once;
    (2) only rows whose hash is such a candidate (left-semi join) are grouped
    by their exact values, so hash collisions cannot change the count."""
    cols = df.columns
    hashed = df.withColumn("_h", F.xxhash64(*[F.col(c) for c in cols]))
    cand = hashed.groupBy("_h").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1).select("_h")
    sub = hashed.join(cand, "_h", "left_semi").drop("_h")
    g = sub.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))
    return g.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("dup_rows"))


def stack_values(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, value-as-text) pairs of several columns, NULL values dropped."""
    return (df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols])))
        .filter(F.col("value").isNotNull()))


def value_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Value counts of several columns in one scan and one shuffle."""
    return stack_values(df, cols).groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))


def value_counts_top(df: DataFrame, col: str, n: int) -> DataFrame:
    """The ``n`` most frequent values (ties broken by value)."""
    return (df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.col("count").desc(), F.col(col).asc()).limit(n))


def n_unique(df: DataFrame, col: str, exact: bool = True) -> DataFrame:
    """Distinct non-NULL values of a column."""
    f = F.countDistinct if exact else F.approx_count_distinct
    return df.agg(f(F.col(col)).cast("long").alias("n_unique"))


def time_span(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """First and last timestamp and the hours between them."""
    lo, hi = F.min(ts), F.max(ts)
    return df.agg(F.date_format(lo, "yyyy-MM-dd HH:mm:ss").alias("first_ts"),
                  F.date_format(hi, "yyyy-MM-dd HH:mm:ss").alias("last_ts"),
                  (F.timestamp_diff("SECOND", lo, hi) / 3600.0).alias("hours"))


def count_where(df: DataFrame, cond: Column, name: str = "rows") -> DataFrame:
    """Number of rows meeting a condition."""
    return df.agg(F.count_if(cond).cast("long").alias(name))


def shape(df: DataFrame) -> DataFrame:
    """Rows x columns."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.lit(len(df.columns)).alias("n_columns"))


def stringify(df: DataFrame) -> DataFrame:
    """timestamp/date columns rendered as text (for display sinks)."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            out.append(F.date_format(F.col(f.name), "yyyy-MM-dd HH:mm:ss").alias(f.name))
        elif isinstance(f.dataType, T.DateType):
            out.append(F.col(f.name).cast("string").alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def transpose_long(df: DataFrame, key: str, value_cols: Sequence[str] | None = None) -> DataFrame:
    """A small summary turned sideways: one row per measure, one column per
    key value, however many the summary has."""
    value_cols = list(value_cols) if value_cols else [c for c in df.columns if c != key]
    long = df.unpivot([key], value_cols, "measure", "value")
    keys = sorted(r[0] for r in df.select(key).distinct().collect())  # each becomes a column
    return (long.groupBy("measure").pivot(key, keys).agg(F.first("value"))
            .withColumnsRenamed({str(k): f"{key}_{k}" for k in keys}))
