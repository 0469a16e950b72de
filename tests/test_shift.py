"""Shift instances and label join-back."""
import datetime as dt

from pyspark.sql import functions as F

from plantlens.operators import shift as G
from plantlens.plans import context as ctx


def test_night_shift_split_at_midnight(spark):
    rows = [(dt.datetime(2024, 1, 1, 23, 0), "Shift_3_Malam"), (dt.datetime(2024, 1, 2, 1, 0), "Shift_3_Malam"),
            (dt.datetime(2024, 1, 2, 6, 0), "Shift_1_Pagi")]
    df = spark.createDataFrame(rows, "timestamp timestamp_ntz, shift string")
    cal = [r["shift_instance_id"] for r in G.with_shift_instance(df).orderBy("timestamp").collect()]
    assert cal[0] != cal[1]
    biz = [r["shift_instance_id"] for r in G.with_shift_instance(df, business_day=True).orderBy("timestamp").collect()]
    assert biz[0] == biz[1] and biz[2] == "2024-01-02_Shift_1_Pagi"


def test_join_back_keeps_row_count(spark, sf):
    lab, _ = ctx.shift_labels(spark, sf)
    log = G.with_shift_instance(ctx.clean(spark, sf))
    out = G.attach(log, lab)
    assert out.count() == log.count()
    assert out.filter(F.col("shift_efficiency_cluster").isNull()).count() == 0


def test_efficiency_scores(spark):
    df = spark.createDataFrame([(2, 0.0, 0.2, 99.0)], "units_produced long, downtime double, error_rate double, "
                                                       "cycle_time double")
    r = G.efficiency(df).first()
    assert r["efficiency_error_rate"] == 0.8 and r["efficiency_downtime"] == 1.0
    assert r["efficiency_cycle_time"] == 0.01 and r["efficiency_units_produced"] == 2.0
