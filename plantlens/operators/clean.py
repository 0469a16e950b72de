"""Mean imputation, IQR outlier report, winsorising, box-plot statistics.

Scalars (column means, quartiles) are computed in one distributed pass each
and inlined as literals, so the cleaned table is a narrow projection of the
source: scan -> project, no join, no shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plantlens.functions.stats import grouped_quantiles, quantiles
from plantlens.schema import ALL_NUMERIC, CLIP14

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
                 T.DoubleType, T.DecimalType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC_TYPES)]


def col_means(df: DataFrame, cols: Sequence[str] | None = None) -> dict[str, tuple[float | None, int]]:
    """Mean (NULLs skipped) and null count of each column, in one pass."""
    cols = list(cols) if cols is not None else numeric_columns(df)
    row = df.agg(*[F.avg(c).alias(f"m_{c}") for c in cols],
                 *[F.count_if(F.col(c).isNull()).alias(f"z_{c}") for c in cols]).first()
    return {c: (row[f"m_{c}"], row[f"z_{c}"]) for c in cols}


def impute_mean(df: DataFrame, cols: Sequence[str] | None = None,
                means: dict | None = None) -> DataFrame:
    """NULL <- column mean.  Columns without NULLs keep their type
    (pandas ``fillna(df.mean())`` only upcasts columns that had NaN)."""
    means = means if means is not None else col_means(df, cols)
    fill = {c: F.coalesce(F.col(c), F.lit(m)) for c, (m, nulls) in means.items()
            if nulls and m is not None}
    return df.withColumns(fill) if fill else df


@dataclass
class Bounds:
    q1: float | None
    q3: float | None
    k: float = 1.5

    @property
    def iqr(self):
        return None if self.q1 is None else self.q3 - self.q1

    @property
    def lower(self):
        return None if self.q1 is None else self.q1 - self.k * (self.q3 - self.q1)

    @property
    def upper(self):
        return None if self.q1 is None else self.q3 + self.k * (self.q3 - self.q1)


def iqr_bounds(df: DataFrame, cols: Sequence[str], k: float = 1.5,
               method: str = "exact") -> dict[str, Bounds]:
    qs = quantiles(df, cols, [0.25, 0.75], method=method)
    return {c: Bounds(qs[c][0], qs[c][1], k) for c in cols}


def iqr_outliers(df: DataFrame, cols: Sequence[str] | None = None,
                 bounds: dict[str, Bounds] | None = None) -> DataFrame:
    """Per column Q1, Q3, IQR, bounds and the number of rows strictly outside."""
    cols = list(cols) if cols is not None else numeric_columns(df)
    bounds = bounds or iqr_bounds(df, cols)
    def lit_d(v):
        return F.lit(v).cast("double")
    return df.agg(*[
        F.count_if((F.col(c) < F.lit(bounds[c].lower)) | (F.col(c) > F.lit(bounds[c].upper))).alias(c)
        for c in cols]).select(F.inline(F.array(*[
            F.struct(F.lit(c).alias("column"), lit_d(bounds[c].q1).alias("q1"),
                     lit_d(bounds[c].q3).alias("q3"), lit_d(bounds[c].iqr).alias("iqr"),
                     lit_d(bounds[c].lower).alias("lower_bound"),
                     lit_d(bounds[c].upper).alias("upper_bound"),
                     F.col(c).cast("long").alias("n_outliers"))
            for c in cols])))


def outlier_rows(df: DataFrame, col: str, bound: Bounds | None = None) -> DataFrame:
    """C3r: the rows outside one column's IQR fences."""
    b = bound or iqr_bounds(df, [col])[col]
    return df.filter((F.col(col) < F.lit(b.lower)) | (F.col(col) > F.lit(b.upper)))


def all_outlier_rows(df: DataFrame, bounds: dict[str, Bounds]) -> DataFrame:
    """C3r for several columns in one scan: a row comes once for each column whose fences it
    lies outside, with that column's name in front."""
    out = [F.when((F.col(c) < F.lit(b.lower)) | (F.col(c) > F.lit(b.upper)), F.lit(c))
           for c, b in bounds.items() if b.q1 is not None]
    return df.select(F.explode(F.array_compact(F.array(*out))).alias("column"), *df.columns)


def winsorize(df: DataFrame, cols: Sequence[str] = CLIP14,
              bounds: dict[str, Bounds] | None = None) -> DataFrame:
    """C4: clip each column to its IQR fences; NULL stays NULL."""
    cols = list(cols)
    bounds = bounds or iqr_bounds(df, cols)
    fix = {}
    for c in cols:
        b = bounds[c]
        if b.q1 is None:
            continue
        x = F.col(c)
        fix[c] = F.when(x.isNull(), x).otherwise(
            F.least(F.greatest(x, F.lit(b.lower)), F.lit(b.upper)))
    return df.withColumns(fix)


def box_stats(df: DataFrame, cols: Sequence[str], bounds: dict[str, Bounds] | None = None,
              method: str = "exact") -> DataFrame:
    """Box-plot numbers: quartiles, median, whiskers (extreme data inside
    the 1.5 IQR fences) and the count of fliers, one pass after the quartiles.
    ``bounds`` of some columns, when a build has them, save finding those
    columns' quartiles again."""
    cols = list(cols)
    bounds = dict(bounds or {})
    known, new = [c for c in cols if c in bounds], [c for c in cols if c not in bounds]
    qs = quantiles(df, new, [0.25, 0.5, 0.75], method=method)
    medians = quantiles(df, known, [0.5], method=method)
    qs.update({c: [bounds[c].q1, medians[c][0], bounds[c].q3] for c in known})
    bounds.update({c: Bounds(qs[c][0], qs[c][2]) for c in new})
    aggs = []
    for c in cols:
        b, x = bounds[c], F.col(c)
        inside = (x >= F.lit(b.lower)) & (x <= F.lit(b.upper))
        aggs += [F.min(F.when(inside, x)).cast("double").alias(f"wl_{c}"),
                 F.max(F.when(inside, x)).cast("double").alias(f"wh_{c}"),
                 F.count_if(x.isNotNull() & ~inside).alias(f"nf_{c}")]
    return df.agg(*aggs).select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(qs[c][0]).cast("double").alias("q1"),
                 F.lit(qs[c][1]).cast("double").alias("median"),
                 F.lit(qs[c][2]).cast("double").alias("q3"),
                 F.col(f"wl_{c}").alias("whisker_lo"), F.col(f"wh_{c}").alias("whisker_hi"),
                 F.col(f"nf_{c}").cast("long").alias("n_fliers"))
        for c in cols])))


@dataclass
class Cleaned:
    """C6 result: the cleaned log plus the statistics used to clean it."""
    df: DataFrame
    imputed: DataFrame
    means: dict
    bounds: dict = field(default_factory=dict)


def clean(df: DataFrame, impute_cols: Sequence[str] | None = None,
          clip_cols: Sequence[str] = CLIP14, method: str = "exact") -> Cleaned:
    """Impute -> quartiles on the imputed data -> clip.  Two scalar passes
    (means, then quartiles) and a lazy projection."""
    impute_cols = list(impute_cols) if impute_cols is not None else \
        [c for c in ALL_NUMERIC if c in df.columns] or numeric_columns(df)
    means = col_means(df, impute_cols)
    imputed = impute_mean(df, means=means)
    bounds = iqr_bounds(imputed, clip_cols, method=method)
    return Cleaned(winsorize(imputed, clip_cols, bounds), imputed, means, bounds)


def clean_summary(cl: Cleaned, cols: Sequence[str] = CLIP14) -> DataFrame:
    """C6 audit: per clipped column the NULLs filled and the fill value, the
    fences and how many imputed values fell below / above them (one pass)."""
    cols = list(cols)
    aggs = []
    for c in cols:
        b, x = cl.bounds[c], F.col(c)
        aggs += [F.count_if(x < F.lit(b.lower)).alias(f"lo_{c}"),
                 F.count_if(x > F.lit(b.upper)).alias(f"hi_{c}")]

    def dbl(v):
        return F.lit(v).cast("double")
    rows = []
    for c in cols:
        mean, nulls = cl.means.get(c, (None, 0))
        b = cl.bounds[c]
        rows.append(F.struct(F.lit(c).alias("column"), F.lit(int(nulls or 0)).cast("long").alias("n_null"),
                             dbl(mean if nulls else None).alias("fill_value"),
                             dbl(b.lower).alias("lower_bound"), dbl(b.upper).alias("upper_bound"),
                             F.col(f"lo_{c}").cast("long").alias("n_clipped_low"),
                             F.col(f"hi_{c}").cast("long").alias("n_clipped_high")))
    return cl.imputed.agg(*aggs).select(F.inline(F.array(*rows)))


def box_stats_by(df: DataFrame, cols: Sequence[str], by: str, store) -> DataFrame:
    """C5 grouped: box-plot statistics per (group, column), for any number of groups.

    Long rows (group, column, value); exact quantiles per key (``grouped_quantiles``), then
    one aggregation against each key's fences.  ``store`` writes a frame to the shared folder
    and reads it back.  A (group, column) without values has no row."""
    cols = list(cols)
    rows = df.filter(F.col(by).isNotNull()).select(by, F.posexplode(F.array(*[F.col(c).cast("double") for c in cols])).alias("col_idx", "v"))
    rows = rows.withColumn("v", F.nanvl("v", F.lit(None).cast("double"))).filter(F.col("v").isNotNull())
    q = store(grouped_quantiles(rows, [by, "col_idx"], [0.25, 0.5, 0.75], store))
    fence = 1.5 * (F.col("q2") - F.col("q0"))
    inside = (F.col("v") >= F.col("q0") - fence) & (F.col("v") <= F.col("q2") + fence)
    out = rows.join(q, [by, "col_idx"]).groupBy(by, "col_idx").agg(
        F.first("q0").alias("q1"), F.first("q1").alias("median"), F.first("q2").alias("q3"),
        F.min(F.when(inside, F.col("v"))).alias("whisker_lo"), F.max(F.when(inside, F.col("v"))).alias("whisker_hi"),
        F.count_if(~inside).alias("n_fliers"))
    names = F.array(*[F.lit(c) for c in cols])
    return out.select(by, names[F.col("col_idx")].alias("column"), "q1", "median", "q3", "whisker_lo", "whisker_hi",
                      F.col("n_fliers").cast("long").alias("n_fliers"))
