"""Cleaning: imputation, IQR fences, winsorising, box statistics, properties."""
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plantlens.operators import clean as C


def test_impute_keeps_mean_and_fills(spark):
    df = spark.createDataFrame([(1.0, 1), (None, 2), (3.0, 3), (None, 4)], "a double, b int")
    means = C.col_means(df, ["a", "b"])
    assert means["a"] == (2.0, 2) and means["b"][1] == 0
    out = C.impute_mean(df, means=means)
    assert out.filter(F.col("a").isNull()).count() == 0
    assert out.agg(F.avg("a")).first()[0] == pytest.approx(2.0)
    assert dict(out.dtypes)["b"] == "int"  # untouched: no NULLs


def test_all_null_column_stays_null(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 2.0)], "a double, b double")
    out = C.impute_mean(df)
    assert out.filter(F.col("a").isNull()).count() == 2


def test_winsorize_idempotent_and_inside(spark):
    vals = [float(v) for v in range(20)] + [500.0, -300.0, None]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    b = C.iqr_bounds(df, ["x"])
    once = C.winsorize(df, ["x"], b)
    twice = C.winsorize(once, ["x"], b)
    r = once.agg(F.min("x"), F.max("x"), F.count_if(F.col("x").isNull())).first()
    assert r[0] >= b["x"].lower and r[1] <= b["x"].upper and r[2] == 1
    assert sorted(once.collect(), key=str) == sorted(twice.collect(), key=str)
    # pandas clip agrees
    s = pd.Series(vals, dtype="float64")
    q1, q3 = s.quantile(0.25), s.quantile(0.75)
    exp = s.clip(q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))
    got = [r[0] for r in once.collect()]
    assert [x for x in got if x is not None] == pytest.approx([x for x in exp if x == x])


def test_outlier_report_counts(spark):
    df = spark.createDataFrame([(float(v),) for v in list(range(10)) + [100.0]], "x double")
    rep = C.iqr_outliers(df, ["x"]).first()
    assert rep["n_outliers"] == 1 and rep["lower_bound"] < 0


def test_constant_column_zero_iqr(spark):
    df = spark.createDataFrame([(5.0,)] * 6, "x double")
    rep = C.iqr_outliers(df, ["x"]).first()
    assert rep["iqr"] == 0 and rep["n_outliers"] == 0


def test_box_stats_whiskers(spark):
    vals = [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0, 50.0]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    r = C.box_stats(df, ["x"]).first()
    assert r["median"] == 5.0 and r["whisker_hi"] == 8.0 and r["whisker_lo"] == 1.0 and r["n_fliers"] == 1


def test_empty_frame(spark):
    df = spark.createDataFrame([], "x double")
    assert C.iqr_outliers(df, ["x"]).first()["n_outliers"] == 0


def test_box_stats_by_group_matches_pandas(spark):
    import random
    rnd = random.Random(4)
    rows = [(g, rnd.gauss(10 * (i + 1), 2) if rnd.random() > 0.02 else 200.0)
            for i, g in enumerate(["a", "b", "c"]) for _ in range(120)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r["g"]: r for r in C.box_stats_by(df, ["x"], "g", lambda d: d).collect()}
    pdf = pd.DataFrame(rows, columns=["g", "x"])
    for g, part in pdf.groupby("g"):
        q1, q2, q3 = part.x.quantile([0.25, 0.5, 0.75])
        lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        inside = part.x[(part.x >= lo) & (part.x <= hi)]
        r = got[g]
        assert (r["q1"], r["median"], r["q3"]) == pytest.approx((q1, q2, q3))
        assert r["whisker_lo"] == inside.min() and r["whisker_hi"] == inside.max()
        assert r["n_fliers"] == len(part) - len(inside)
