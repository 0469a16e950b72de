"""Exact quantiles against DuckDB quantile_cont and numpy."""
import math
import random

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plantlens.functions import stats
from plantlens.functions.stats import grouped_quantiles, quantiles

PROBS = [0.0, 0.1, 0.25, 1 / 3, 0.5, 0.75, 0.9, 1.0]


def duck_q(xs, p):
    con = duckdb.connect()
    con.execute("CREATE TABLE t(x DOUBLE)")
    con.executemany("INSERT INTO t VALUES (?)", [(x,) for x in xs])
    return con.execute("SELECT quantile_cont(x, CAST(? AS DOUBLE)) FROM t", [p]).fetchone()[0]


def frame(spark, xs):
    return spark.createDataFrame([(x,) for x in xs], "x double")


@pytest.fixture(params=[None, 40])
def accuracy(request, monkeypatch):
    """The library's accuracy, and a coarse one, whose brackets leave rows inside."""
    if request.param:
        monkeypatch.setattr(stats, "ACCURACY", request.param)
    return request.param


def data(kind):
    rnd = random.Random(7)
    if kind == "ties":
        return [rnd.random() * 100 for _ in range(500)] + [50.0] * 400 + [0.0] * 900 + [None] * 5
    if kind == "decades":
        return [rnd.choice([-1, 1]) * 10.0 ** rnd.uniform(-150, 150) for _ in range(1500)]
    if kind == "infinite":
        return [rnd.random() for _ in range(900)] + [math.inf] * 3 + [-math.inf]
    if kind == "two values":
        return [1.0] * 700 + [2.0] * 701
    return [3.0] * 1000


@pytest.mark.parametrize("kind", ["ties", "decades", "infinite", "two values", "constant"])
def test_matches_duckdb_bitwise(spark, accuracy, kind):
    xs = data(kind)
    got = quantiles(frame(spark, xs), ["x"], PROBS)["x"]
    clean = [x for x in xs if x is not None]
    for p, g in zip(PROBS, got):
        assert g == duck_q(clean, p)


def test_several_columns_at_once(spark, accuracy):
    rnd = random.Random(3)
    rows = [(rnd.gauss(0, 1), float(rnd.randint(0, 3)), None if k % 3 else rnd.random()) for k in range(1200)]
    got = quantiles(spark.createDataFrame(rows, "a double, b double, c double"), ["a", "b", "c"], [0.25, 0.75])
    for i, c in enumerate("abc"):
        xs = [r[i] for r in rows if r[i] is not None]
        assert got[c] == [duck_q(xs, 0.25), duck_q(xs, 0.75)]


def test_grouped_matches_numpy(spark, accuracy):
    rnd = random.Random(5)
    rows = [(f"g{k % 30}" if k % 2 else "hot", k % 3, rnd.gauss(0, 1) * 10 ** (k % 5)) for k in range(6000)]
    got = grouped_quantiles(spark.createDataFrame(rows, "g string, i int, v double"), ["g", "i"], [0.25, 0.5, 0.9], lambda d: d).collect()
    assert len(got) == len({(g, i) for g, i, _ in rows})
    for r in got:
        xs = [v for g, i, v in rows if (g, i) == (r.g, r.i)]
        assert [r.q0, r.q1, r.q2] == pytest.approx(list(np.quantile(xs, [0.25, 0.5, 0.9])), rel=1e-12)
        assert r.n == len(xs)


def test_percentile_and_approx_methods(spark):
    xs = [float(i % 17) for i in range(300)]
    df = frame(spark, xs)
    ex = quantiles(df, ["x"], [0.25, 0.75])["x"]
    pc = quantiles(df, ["x"], [0.25, 0.75], method="percentile")["x"]
    assert ex == pytest.approx(pc)
    ap = quantiles(df, ["x"], [0.5], method="approx")["x"]
    assert ap[0] in set(xs)


def test_edge_frames(spark):
    df = spark.createDataFrame([(None,), (None,)], "x double")
    assert quantiles(df, ["x"], [0.5])["x"] == [None]
    const = frame(spark, [3.0] * 10)
    assert quantiles(const, ["x"], [0.25, 0.75])["x"] == [3.0, 3.0]
    one = frame(spark, [1.5])
    assert quantiles(one, ["x"], [0.0, 0.5, 1.0])["x"] == [1.5, 1.5, 1.5]
    nan = frame(spark, [1.0, math.nan, 2.0, None])
    assert quantiles(nan, ["x"], [0.5])["x"] == [1.5]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(-50, 50), min_size=1, max_size=60), st.floats(0, 1))
def test_property_vs_numpy(spark, ints, p):
    xs = [float(i) for i in ints]
    got = quantiles(frame(spark, xs), ["x"], [p])["x"][0]
    assert math.isclose(got, float(np.quantile(np.array(xs), p)), rel_tol=1e-12, abs_tol=1e-9)


def test_whole_columns_make_no_row_per_value(spark, monkeypatch):
    """Quantiles of columns are counted in scans of the rows, not over a row per column and row."""
    def long_values(*_):
        raise AssertionError("a row per value")
    monkeypatch.setattr(stats, "long_values", long_values)
    df = spark.createDataFrame([(float(k), float(k % 3)) for k in range(101)], "a double, b double")
    assert quantiles(df, ["a", "b"], [0.25, 0.5]) == {"a": [25.0, 50.0], "b": [0.0, 1.0]}


def test_ranges_are_split_down_to_the_last_bit(spark, monkeypatch):
    """Values that differ in their last bits, of both signs, beside heavy ties."""
    monkeypatch.setattr(stats, "FEW", 2)
    xs = [s * (100.0 + k * 2.0 ** -46) for k in range(40) for s in (1, -1)] + [0.0, -0.0] * 30 + [7.0] * 50
    got = quantiles(frame(spark, xs).repartition(3), ["x"], PROBS)["x"]
    assert got == [duck_q(xs, p) for p in PROBS]
