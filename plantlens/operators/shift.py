"""Shift instances, shift aggregates, efficiency scores, label join-back.

The unit of the shift study is (shift instance x machine x line): one
``groupBy`` shrinks the log to a table whose size grows with calendar days x
machines x lines, not with observations.  Labels go back to the log with a
left equi-join on the three keys; Spark picks broadcast only when its size
estimate of the label table is under the broadcast threshold, so the join
stays correct (shuffle hash/sort-merge) when the label table is large.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantlens.schema import SHIFT_KEYS


def with_shift_instance(df: DataFrame, ts: str = "timestamp", shift: str = "shift",
                        business_day: bool = False) -> DataFrame:
    """``date`` and ``shift_instance_id = date || '_' || shift``.

    With the calendar date the night shift 22-06 splits at midnight, as in the
    analysis; ``business_day=True`` dates each row by ts - 6 h instead."""
    t = F.col(ts)
    if business_day:
        t = F.timestamp_add("HOUR", F.lit(-6), t)
    d = F.to_date(t)
    return df.withColumns({"date": d,
                           "shift_instance_id": F.concat(d.cast("string"), F.lit("_"), F.col(shift))})


def shift_agg(df: DataFrame, keys: Sequence[str] = SHIFT_KEYS) -> DataFrame:
    """Per (instance, machine, line): total units and downtime, mean error
    and cycle time.  NULL keys are dropped (pandas group-by)."""
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).isNotNull()
    return df.filter(cond).groupBy(*keys).agg(
        F.sum("units_produced").cast("long").alias("units_produced"),
        F.sum("downtime").alias("downtime"),
        F.avg("error_rate").alias("error_rate"),
        F.avg("cycle_time").alias("cycle_time"))


def efficiency(agg: DataFrame) -> DataFrame:
    """Efficiency scores: 1 - error, 1/(1 + downtime), 1/(1 + cycle), units."""
    return agg.withColumns({
        "efficiency_error_rate": F.lit(1.0) - F.col("error_rate"),
        "efficiency_downtime": F.lit(1.0) / (F.lit(1.0) + F.col("downtime")),
        "efficiency_cycle_time": F.lit(1.0) / (F.lit(1.0) + F.col("cycle_time")),
        "efficiency_units_produced": F.col("units_produced").cast("double"),
    })


def attach(df: DataFrame, labels: DataFrame, keys: Sequence[str] = SHIFT_KEYS,
           label: str = "shift_efficiency_cluster") -> DataFrame:
    """Left equi-join of labels back to the log (many-to-one; the row
    count of ``df`` is unchanged because ``labels`` is unique on ``keys``).

    ``labels`` is a written table, so Spark knows its size and broadcasts it
    only below its own threshold; else it is a shuffle join, in which AQE
    splits the partition of a hot key."""
    return df.join(labels.select(*keys, label), list(keys), "left")


def label_mix(df: DataFrame, label: str, dim: str) -> DataFrame:
    """Observations per (label, dim value), e.g. the shift mix of each cluster."""
    return (df.filter(F.col(label).isNotNull() & F.col(dim).isNotNull())
            .groupBy(label, dim).agg(F.count(F.lit(1)).alias("count")))


def shift_efficiency_table(df: DataFrame, keys: Sequence[str] = SHIFT_KEYS) -> DataFrame:
    """G1-G4 in one: the shift-level table with raw metrics and efficiency scores."""
    return efficiency(shift_agg(with_shift_instance(df), keys))

