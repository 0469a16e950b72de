"""KPI / OEE semantics and grouping-set equivalence."""
import pytest
from pyspark.sql import functions as F

from plantlens.operators import kpi as K
from plantlens.plans import context as ctx


def log(spark):
    rows = [("M1", "S1", 2, 1, 0.0, 0.5), ("M1", "S2", 0, 0, 5.0, 0.7), ("M2", "S1", 0, 0, 0.0, 0.9),
            ("M2", "S2", 3, 0, 1.0, 0.6), (None, "S1", 1, 1, 0.0, 0.5)]
    return spark.createDataFrame(rows, "machine_id string, shift string, units_produced int, defect_count int, "
                                       "downtime double, error_rate double")


def test_grouping_sets_equal_single_groupbys(spark):
    df = log(spark)
    sets = K.kpi_by(df, [["machine_id"], ["shift"]], {"u": F.sum("units_produced")}).collect()
    got = {(r["dim"], r["key"]): r["u"] for r in sets}
    for key in ["machine_id", "shift"]:
        for r in df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.sum("units_produced").alias("u")).collect():
            assert got[(key, r[key])] == r["u"]
    assert ("machine_id", None) not in got  # NULL keys dropped as pandas does


def test_oee_rows_mode(spark):
    r = K.oee(log(spark)).first()
    assert r["availability"] == pytest.approx(3 / 5)
    assert r["performance_ref"] == pytest.approx(120 * 6 / 3)
    assert r["quality"] == pytest.approx(4 / 6)
    assert r["oee_norm"] == pytest.approx(0.6 * (240 / 60) * (4 / 6))


def test_defect_pct_zero_units(spark):
    df = spark.createDataFrame([("a", 0, 0), ("b", 0, 2), ("c", 4, 1)],
                               "operator_id string, units_produced int, defect_count int")
    got = {r["operator_id"]: r["defect_percentage"] for r in K.defect_pct_by(df, "operator_id").collect()}
    assert got == {"a": 0.0, "b": None, "c": 25.0}


def test_worst_ties_take_first_key(spark):
    df = spark.createDataFrame([("OP2", 0.9), ("OP1", 0.9), ("OP3", 0.1)], "operator_id string, error_rate double")
    assert K.worst(df, "operator_id", "error_rate").first()["operator_id"] == "OP1"


def test_shares_sum_to_one(spark, sf):
    s = K.defects_by(ctx.clean(spark, sf)).agg(F.sum("defect_share")).first()[0]
    assert s == pytest.approx(1.0)


def test_dup_rows_exact_with_nulls_and_hot_group(spark):
    from plantlens.operators.profile import dup_rows
    rows = [("a", None, 1.0)] * 30 + [(None, "a", 1.0)] * 2 + [("b", "c", 2.0), ("b", "c", 2.0), ("x", "y", 3.0)]
    df = spark.createDataFrame(rows, "p string, q string, v double")
    # 29 repeats of the hot group, 1 of the (NULL, a) pair, 1 of (b, c)
    assert dup_rows(df).first()["dup_rows"] == 31
