"""Temperature quartile scenarios.

Scenario membership is a set of conditions, not a partition: when Q1 = Q3 a
row is both "low" and "high", exactly as the analysis' three filters.  All
scenario means come from one conditional aggregation (one pass, no union,
no explode); an empty scenario reports NULL means.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantlens.functions.stats import quantiles
from plantlens.schema import TEMP_METRICS4


def thresholds(df: DataFrame, col: str = "temperature", method: str = "exact") -> tuple[float, float]:
    """Q1 and Q3 (linear interpolation)."""
    q = quantiles(df, [col], [0.25, 0.75], method=method)[col]
    return q[0], q[1]


def scenario_conditions(col: str, q1: float, q3: float) -> list[tuple[str, object]]:
    """Low <= Q1 < normal < Q3 <= high."""
    x = F.col(col)
    return [("low", x <= F.lit(q1)), ("normal", (x > F.lit(q1)) & (x < F.lit(q3))),
            ("high", x >= F.lit(q3))]


def scenario_means(df: DataFrame, col: str = "temperature", metrics: Sequence[str] = TEMP_METRICS4,
                   q: tuple[float, float] | None = None) -> DataFrame:
    """Mean of each metric in each scenario, one pass."""
    q1, q3 = q or thresholds(df, col)
    conds = scenario_conditions(col, q1, q3)
    aggs = []
    for s, cond in conds:
        aggs.append(F.count_if(cond).alias(f"{s}__rows"))
        aggs += [F.avg(F.when(cond, F.col(m))).alias(f"{s}__{m}") for m in metrics]
    return df.agg(*aggs).select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("ord"), F.lit(s).alias("scenario"), F.lit(q1).alias("q1"), F.lit(q3).alias("q3"),
                 F.col(f"{s}__rows").cast("long").alias("rows"),
                 *[F.col(f"{s}__{m}").alias(m) for m in metrics])
        for i, (s, _) in enumerate(conds)])))
