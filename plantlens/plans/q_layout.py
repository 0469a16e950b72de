"""Registered query on the bucketed layout of the log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantlens.operators import layout as Y
from plantlens.operators import shift as G
from plantlens.plans import context as ctx
from plantlens.plans.context import SHIFT_LABEL as LBL
from plantlens.plans.oracle import on_clean
from plantlens.plans.q_shift import _LOGK, _SK
from plantlens.plans.registry import query, rnd
from plantlens.schema import SHIFT_KEYS


def bucketed(spark, sf) -> tuple[DataFrame, DataFrame]:
    """The cleaned log with its shift instance, and the labelled shifts, in buckets of the shift
    keys; written once per version."""
    v = ctx.version(spark, sf)

    def build(name: str, make) -> DataFrame:
        def write(path: str) -> None:
            df = make()
            v.fits[f"{name}-table"] = Y.write_bucketed(df, path, SHIFT_KEYS, v.fit("buckets", lambda: Y.buckets_for(ctx.clean(spark, sf).count())))
        v.path(name, write)
        return spark.table(v.fits[f"{name}-table"])
    return (build("log-bucketed", lambda: G.with_shift_instance(ctx.clean(spark, sf))),
            build("shifts-bucketed", lambda: ctx.shift_labels(spark, sf)[0].select(*SHIFT_KEYS, LBL)))


def joined(spark, sf) -> DataFrame:
    """Labels joined back to the log, then totals by shift instance, machine, line and cluster."""
    log, labels = bucketed(spark, sf)
    return G.attach(log, labels, SHIFT_KEYS, LBL).groupBy(*SHIFT_KEYS).agg(
        F.max(LBL).alias(LBL), F.count(F.lit(1)).alias("rows"), F.sum("defect_count").cast("long").alias("defects"), F.sum("downtime").alias("downtime"))


@query("shift_totals_bucketed", rnd(on_clean(f"""SELECT shift_instance_id_ AS shift_instance_id, machine_id, line_id, {LBL}, count(*) AS "rows",
  CAST(sum(defect_count) AS BIGINT) AS defects, sum(downtime) AS downtime FROM logk GROUP BY ALL""", _SK, _LOGK), "downtime"))
def shift_totals_bucketed(spark, sf):
    """Shift labels joined back to the bucketed log and totalled by the shift keys: no
    row of the log is shuffled."""
    return joined(spark, sf)
