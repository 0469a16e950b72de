"""Results do not depend on the number of partitions (1 vs 8)."""
import random

import pytest
from pyspark.sql import functions as F

from plantlens.functions.stats import quantiles
from plantlens.operators import cluster as K
from plantlens.operators import kpi as KP
from plantlens.operators import scenario as T
from plantlens.plans import context as ctx


def test_quantiles_partition_invariant(spark):
    rnd = random.Random(8)
    df = spark.createDataFrame([(rnd.random() * 10,) for _ in range(500)], "x double")
    a = quantiles(df.repartition(1), ["x"], [0.1, 0.25, 0.5, 0.9])
    b = quantiles(df.repartition(8), ["x"], [0.1, 0.25, 0.5, 0.9])
    assert a == b


def test_reports_partition_invariant(spark, sf):
    cl = ctx.clean(spark, sf)
    one, many = cl.repartition(1), cl.repartition(8)

    def rows(df):
        return sorted((r["machine_id"], r["total_units"], round(r["oee_norm"], 9)) for r in KP.oee(df, ["machine_id"]).collect())
    assert rows(one) == rows(many)
    m1 = K.lloyd(one, ["error_rate", "oil_level"], 3, init_col="error_rate").centers
    m8 = K.lloyd(many, ["error_rate", "oil_level"], 3, init_col="error_rate").centers
    assert [[round(v, 9) for v in c] for c in m1] == [[round(v, 9) for v in c] for c in m8]


def test_scenarios_overlap_when_q1_equals_q3(spark):
    rows = [(75.0, 1.0, 0.5, 0.0, 1)] * 10 + [(80.0, 2.0, 0.6, 1.0, 0)]
    df = spark.createDataFrame(rows, "temperature double, power_consumption double, error_rate double, "
                                     "downtime double, units_produced int")
    out = {r["scenario"]: r for r in T.scenario_means(df).collect()}
    assert out["low"]["q1"] == out["low"]["q3"] == 75.0
    assert out["low"]["rows"] == 10 and out["high"]["rows"] == 11   # the Q1=Q3 rows are in both
    assert out["normal"]["rows"] == 0 and out["normal"]["power_consumption"] is None
