"""H1-H7: bottleneck reports.

The per-line summary is one group-by with four aggregates (the analysis
aligned four separate Series).  The ranking runs every dimension through one
grouping-sets aggregation, then ranks inside each dimension with windows
over the aggregated rows only (partitioned by dimension, a handful of rows).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plantlens.operators.kpi import down_flag, group_kpi, kpi_by


def line_summary(df: DataFrame, key: str = "line_id") -> DataFrame:
    """H1-H5: total downtime, downtime frequency, mean error and total units."""
    return group_kpi(df, [key], {
        "total_downtime": F.sum("downtime"),
        "downtime_freq": F.count_if(down_flag()).cast("long"),
        "avg_error_rate": F.avg("error_rate"),
        "total_units": F.sum("units_produced").cast("long"),
    })


def rank_bottlenecks(df: DataFrame, dims: Sequence[str] = ("machine_id", "line_id", "shift")) -> DataFrame:
    """H6: inside each dimension rank members by downtime, downtime frequency
    and error (largest first) and by units (smallest first); the member with
    the smallest rank sum is the bottleneck (``score_rank`` 1)."""
    agg = kpi_by(df, [[d] for d in dims], {
        "total_downtime": F.sum("downtime"),
        "downtime_freq": F.count_if(down_flag()).cast("long"),
        "avg_error_rate": F.avg("error_rate"),
        "total_units": F.sum("units_produced").cast("long")})
    w = Window.partitionBy("dim")
    ranked = agg.withColumns({
        "r_downtime": F.rank().over(w.orderBy(F.col("total_downtime").desc())),
        "r_freq": F.rank().over(w.orderBy(F.col("downtime_freq").desc())),
        "r_error": F.rank().over(w.orderBy(F.col("avg_error_rate").desc())),
        "r_units": F.rank().over(w.orderBy(F.col("total_units").asc())),
    })
    ranked = ranked.withColumn("rank_sum", F.col("r_downtime") + F.col("r_freq") + F.col("r_error")
                               + F.col("r_units"))
    return ranked.withColumn("score_rank", F.rank().over(w.orderBy(F.col("rank_sum").asc())))


def machine_shift_cube(df: DataFrame, dims: Sequence[str] = ("machine_id", "shift")) -> DataFrame:
    """H7: machine x shift comparison with every subtotal (CUBE).  A row whose key is
    NULL is left out of the groupings over that key, and counted in the others."""
    known = F.lit(True)
    for d in dims:
        known = known & ((F.col(f"_g_{d}") == 1) | F.col(d).isNotNull())
    return (df.cube(*dims).agg(
        F.grouping_id().alias("grouping_id"), *[F.grouping(d).alias(f"_g_{d}") for d in dims],
        F.count(F.lit(1)).alias("rows"),
        F.sum("units_produced").cast("long").alias("total_units"),
        F.sum("downtime").alias("total_downtime"),
        F.count_if(down_flag()).cast("long").alias("downtime_freq"),
        F.avg("error_rate").alias("avg_error_rate"),
        F.avg("cycle_time").alias("avg_cycle_time")).filter(known).drop(*[f"_g_{d}" for d in dims]))
