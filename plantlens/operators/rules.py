"""The data dictionary's rules as checks over the log.

Norms and ranges are a handful of literals, so they are inlined as CASE /
map expressions (no join at all), and every audit is one aggregation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantlens.functions.rules import calendar, lubrication_band, shift_of
from plantlens.schema import NOISE_NORMS, SENSOR_RANGES


def band_counts(df: DataFrame) -> DataFrame:
    """Rows per lubrication band derived from oil_level."""
    return (df.select(lubrication_band("oil_level").alias("band")).filter(F.col("band").isNotNull())
            .groupBy("band").agg(F.count(F.lit(1)).alias("rows")))


def band_mismatch(df: DataFrame) -> DataFrame:
    """Stored lubrication_status versus the band derived from oil_level."""
    derived = lubrication_band("oil_level")
    return df.agg(F.count(F.lit(1)).alias("rows"),
                  F.count_if(derived.eqNullSafe(F.col("lubrication_status"))).alias("matching"),
                  F.count_if(~derived.eqNullSafe(F.col("lubrication_status"))).alias("mismatching"))


def shift_check(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """R2: per hour of day the shift derived from the clock and how many rows
    carry that shift."""
    derived = shift_of(ts)
    return (df.groupBy(F.hour(ts).alias("hour"))
            .agg(F.first(derived).alias("derived_shift"),
                 F.count(F.lit(1)).alias("rows"),
                 F.count_if(derived == F.col("shift")).alias("matching")))


def calendar_check(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Hour, day of week (Monday = 0) and weekend flag derived from the
    timestamp, per (day, hour), with the rows whose stored values agree."""
    cal = calendar(ts)
    agree = ((cal["hour"] == F.col("hour")) & (cal["day_of_week"] == F.col("day_of_week"))
             & (cal["is_weekend"] == F.col("is_weekend")))
    return (df.groupBy(cal["day_of_week"].alias("day_of_week"), cal["hour"].alias("hour"))
            .agg(F.max(cal["is_weekend"]).alias("is_weekend"), F.count(F.lit(1)).alias("rows"),
                 F.count_if(agree).alias("matching")))


def range_audit(df: DataFrame, ranges: dict[str, tuple[float, float]] = SENSOR_RANGES) -> DataFrame:
    """Per sensor the stated range and the rows below / above it."""
    cols = [c for c in ranges if c in df.columns]
    aggs = []
    for c in cols:
        lo, hi = ranges[c]
        aggs += [F.count_if(F.col(c) < lo).alias(f"lo_{c}"), F.count_if(F.col(c) > hi).alias(f"hi_{c}"),
                 F.min(F.col(c).cast("double")).alias(f"mn_{c}"), F.max(F.col(c).cast("double")).alias(f"mx_{c}")]
    return df.agg(*aggs).select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(float(ranges[c][0])).alias("stated_min"),
                 F.lit(float(ranges[c][1])).alias("stated_max"), F.col(f"mn_{c}").alias("observed_min"),
                 F.col(f"mx_{c}").alias("observed_max"), F.col(f"lo_{c}").cast("long").alias("n_below"),
                 F.col(f"hi_{c}").cast("long").alias("n_above")) for c in cols])))


def noise_deviation(df: DataFrame, norms: dict[str, float] = NOISE_NORMS) -> DataFrame:
    """Noise against the typical dB of the machine type: mean and mean
    absolute deviation per type (types without a norm are left out)."""
    norm = F.create_map(*[v for k, n in norms.items() for v in (F.lit(k), F.lit(float(n)))])
    dev = F.col("noise_level_db") - norm[F.col("machine_type")]
    return (df.filter(norm[F.col("machine_type")].isNotNull())
            .groupBy("machine_type")
            .agg(F.first(norm[F.col("machine_type")]).alias("norm_db"),
                 F.avg("noise_level_db").alias("avg_noise_db"),
                 F.avg(dev).alias("avg_deviation"), F.avg(F.abs(dev)).alias("avg_abs_deviation"),
                 F.count(F.lit(1)).alias("rows")))
