"""NULL keys, missing features and degenerate columns, as the survey's pins say."""
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plantlens.operators import bottleneck as H
from plantlens.operators import eda as D
from plantlens.operators import kpi as KP
from plantlens.operators import profile as B
from plantlens.operators import whatif as W
from plantlens.plans.q_whatif import FEATS, scenarios

LOG = "machine_id string, shift string, units_produced int, downtime double, error_rate double, cycle_time double, defect_count int"
ROWS = [("M1", "S1", 1, 0.0, 0.5, 100.0, 0), ("M1", None, 2, 1.0, 0.5, 110.0, 1), (None, "S1", 3, 0.0, 0.5, 120.0, 0), (None, None, 4, 0.0, 0.7, 90.0, 1)]


def test_cube_drops_null_keys_per_grouping(spark):
    got = {(r.machine_id, r["shift"], r.grouping_id): r.total_units for r in H.machine_shift_cube(spark.createDataFrame(ROWS, LOG)).collect()}
    assert got == {("M1", "S1", 0): 1, ("M1", None, 1): 3, (None, "S1", 2): 4, (None, None, 3): 10}


def test_shares_are_of_all_rows(spark):
    got = KP.defects_by(spark.createDataFrame(ROWS, LOG), "machine_id").first()
    assert (got.machine_id, got.total_defects, got.defect_pct_of_units, got.defect_share) == ("M1", 1, 10.0, 0.5)


def test_scenarios_of_null_keys(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["M1", None]), rng.choice(["S1", None]), *[rng.random() for _ in FEATS]) for _ in range(40)]
    df = spark.createDataFrame(rows, "machine_id string, shift string, " + ", ".join(f"{f} double" for f in FEATS))
    assert {r.scenario for r in scenarios(df).collect()} == {"M1|S1", "ALL"}


def test_missing_features_are_scored(spark):
    rng = random.Random(2)
    rows = [(*[rng.random() for _ in FEATS],) for _ in range(200)]
    df = spark.createDataFrame(rows, ", ".join(f"{f} double" for f in FEATS)).withColumn("level", (F.col(FEATS[0]) > 0.5).cast("int"))
    driver = W.fit_driver(df, FEATS, trees=5, depth=4)
    scen = spark.createDataFrame([("a", *[0.9] * len(FEATS)), ("b", *[None] * len(FEATS))], "scenario string, " + ", ".join(f"{f} double" for f in FEATS))
    assert W.score(driver, scen).count() == 2
    assert W.sensitivity(driver, scen).count() == 2 * len(FEATS)
    train, test = W.hash_split(df, FEATS)
    assert train.count() + test.count() == 200
    assert train.repartition(7).count() == W.hash_split(df.repartition(7), FEATS)[0].count()
    hits = W.score(driver, df).filter("predicted = level").count()
    assert hits / 200 > 0.9


def test_correlation_far_from_zero_and_constant(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(0, 1e-3, 400)
    pdf = pd.DataFrame({"a": 1e9 + a, "b": -1e9 + a + rng.normal(0, 1e-3, 400), "c": 7.0, "d": rng.normal(0, 1, 400)})
    got = {(r.x, r.y): r.r for r in D.corr_matrix(spark.createDataFrame(pdf), list("abcd")).collect()}
    want = (pdf - pd.Series({"a": 1e9, "b": -1e9, "c": 0.0, "d": 0.0})).corr()  # differences are exact
    for (x, y), r in got.items():
        if "c" in (x, y):
            assert r is None
        else:
            assert r == pytest.approx(want.loc[x, y], abs=1e-9)


def test_correlation_pairwise_complete(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame(rng.normal(0, 1, (300, 6)), columns=list("abcdef"))
    pdf["b"] += pdf["a"]
    gaps = pdf.mask(rng.random(pdf.shape) < 0.2)
    df = spark.createDataFrame([tuple(None if math.isnan(v) else v for v in r) for r in gaps.values.tolist()], ", ".join(f"{c} double" for c in gaps))
    got = {(r.x, r.y): r.r for r in D.corr_matrix(df, list("abcdef")).collect()}
    for (x, y), r in got.items():
        assert r == pytest.approx(gaps.corr().loc[x, y], abs=1e-12)
    pairs = D.corr_pairs(df, list("abcdef")).collect()
    assert len(pairs) == 15 and all(p.x < p.y for p in pairs)


def test_kde_of_many_values(spark):
    rng = random.Random(3)
    xs = [rng.gauss(0, 1) for _ in range(3000)]
    got = D.kde(spark.createDataFrame([(x,) for x in xs], "x double"), "x").collect()
    sd, n = float(np.std(xs, ddof=1)), len(xs)
    bw = sd * n ** -0.2
    for r in got[::20]:
        true = np.mean(np.exp(-0.5 * ((r.x - np.array(xs)) / bw) ** 2)) / (bw * math.sqrt(2 * math.pi))
        assert r.density == pytest.approx(true, rel=1e-6, abs=1e-9)


def test_dense_ranks(spark):
    rng = random.Random(4)
    vals = [float(rng.randint(0, 40)) for _ in range(200)] + [None]
    got = {r.value: r["rank"] for r in KP.dense_ranks(spark.createDataFrame([(v,) for v in vals], "value double"), "value").collect()}
    order = sorted({v for v in vals if v is not None}, reverse=True)
    assert got == {**{v: k + 1 for k, v in enumerate(order)}, None: len(order) + 1}


def test_transpose_of_many_keys(spark):
    wide = B.transpose_long(spark.createDataFrame([(k, float(k)) for k in range(1200)], "k int, v double"), "k").first()
    assert wide["k_1199"] == 1199.0


def test_column_info(spark):
    df = spark.createDataFrame([(1, "a", 0.0), (1, None, -0.0), (2, "b", None)], "i int, s string, d double")
    assert [tuple(r) for r in B.column_info(df).collect()] == [("i", "INTEGER", 3, 0, 2), ("s", "VARCHAR", 2, 1, 2), ("d", "DOUBLE", 2, 1, 1)]
