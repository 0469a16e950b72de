"""Histogram, cut, qcut and correlations against numpy / pandas."""
import math
import random

import numpy as np
import pandas as pd
import pytest

from plantlens.operators import eda as D
from plantlens.operators import whatif as W


def test_histogram_matches_numpy(spark):
    rnd = random.Random(3)
    xs = [round(rnd.uniform(100, 142.4), 1) for _ in range(400)] + [100.0, 142.4]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    h = sorted(D.histogram(df, "x", 30).collect(), key=lambda r: r["bin"])
    counts, edges = np.histogram(np.array(xs), bins=30)
    assert [r["count"] for r in h] == list(counts)
    assert [r["bin_lo"] for r in h] == pytest.approx(list(edges[:-1]))
    assert sum(r["count"] for r in h) == len(xs)


def test_cut_matches_pandas(spark):
    rnd = random.Random(5)
    xs = [100 + 0.8 * rnd.randint(1, 50) for _ in range(300)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    binned, edges = D.cut(df, "x", 5)
    got = [r["bin_idx"] for r in binned.select("bin_idx").collect()]
    cats = pd.cut(pd.Series(xs), bins=5)
    exp = list(cats.cat.codes + 1)
    assert got == exp
    assert edges == pytest.approx(list(pd.cut(pd.Series(xs), bins=5, retbins=True)[1]))


def test_bin_profile_keeps_empty_bins(spark):
    rows = [(1.0, 0, 0.5, 1), (1.1, 1, 0.6, 2), (10.0, 0, 0.7, 3)]
    df = spark.createDataFrame(rows, "x double, defect_count int, error_rate double, units_produced int")
    binned, edges = D.cut(df, "x", 5)
    prof = sorted(D.bin_profile(binned, edges).collect(), key=lambda r: r["bin_idx"])
    assert len(prof) == 5
    assert prof[2]["total_units_produced"] == 0 and prof[2]["avg_defect_count"] is None


def test_qcut_matches_pandas_and_raises(spark):
    rnd = random.Random(11)
    xs = [rnd.random() for _ in range(200)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    lvl, edges = W.qcut(df, "x", 3)
    got = [r["level"] for r in lvl.select("level").collect()]
    assert got == list(pd.qcut(pd.Series(xs), q=3, labels=[0, 1, 2]).astype(int))
    zeros = spark.createDataFrame([(0.0,)] * 70 + [(float(i),) for i in range(1, 31)], "x double")
    with pytest.raises(W.DuplicateEdges):
        W.qcut_edges(zeros, "x", 3, duplicates="raise")
    assert len(W.qcut_edges(zeros, "x", 3, duplicates="drop")) < 4


def test_corr_matches_pandas_pairwise(spark):
    rnd = random.Random(2)
    rows = []
    for i in range(200):
        a = rnd.gauss(0, 1)
        b = a * 0.5 + rnd.gauss(0, 1)
        c = None if i % 7 == 0 else b - a
        rows.append((a + 1e4, b, c, 3.0))
    df = spark.createDataFrame(rows, "a double, b double, c double, k double")
    m = {(r["x"], r["y"]): r["r"] for r in D.corr_matrix(df, ["a", "b", "c", "k"]).collect()}
    pdf = pd.DataFrame(rows, columns=["a", "b", "c", "k"]).astype(float)
    exp = pdf.corr()
    for x in "abc":
        for y in "abc":
            assert m[(x, y)] == pytest.approx(exp.loc[x, y], abs=1e-9)
    assert m[("a", "k")] is None and math.isnan(exp.loc["a", "k"])


def test_kde_integrates_to_one(spark):
    rnd = random.Random(9)
    xs = [rnd.gauss(120, 5) for _ in range(300)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    k = sorted(D.kde(df, "x").collect(), key=lambda r: r["i"])
    step = k[1]["x"] - k[0]["x"]
    assert sum(r["density"] for r in k) * step == pytest.approx(1.0, abs=0.02)
    # pre-binned path agrees with the exact one
    kb = sorted(D.kde(df, "x", bins=4096).collect(), key=lambda r: r["i"])
    assert [r["density"] for r in kb] == pytest.approx([r["density"] for r in k], abs=5e-5)
