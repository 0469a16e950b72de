"""Stored summaries: quantiles of any range, distinct counts of any period, exact silhouettes."""
import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plantlens.operators import bitmaps as M
from plantlens.operators import quantile_store as Q
from plantlens.operators.silhouette import silhouettes
from plantlens.session import scratch_path

DAY0 = dt.date(2024, 1, 1)


def store(df):
    path = scratch_path(df.sparkSession, "test-ranges")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@pytest.fixture(scope="module")
def log(spark):
    """Three days, a hot line with two thirds of the rows, ties, NULLs, NaN and infinities."""
    rng = np.random.default_rng(2)
    rows = []
    for k in range(6000):
        x = [float(rng.normal()), float(round(rng.normal(), 1)), None, math.nan, math.inf][min(rng.integers(0, 60), 4) if k % 9 == 0 else k % 2]
        rows.append((DAY0 + dt.timedelta(days=int(k % 3)), "L1" if k % 3 < 2 else f"L{k % 5}", x, float(k % 7)))
    return spark.createDataFrame(rows, "day date, line_id string, x double, y double").repartition(4)


def interpolated(values, p):
    values = sorted(values)
    h = (len(values) - 1) * p
    k = int(h)
    hi = values[min(k + 1, len(values) - 1)]
    return values[k] if h == k or values[k] == hi else values[k] * (1 - (h - k)) + hi * (h - k)


def close(a, b):
    return a == b or a == pytest.approx(b, rel=1e-12)


@pytest.mark.parametrize("margin", [Q.MARGIN, 1e-9])
def test_quantiles_of_ranges(log, monkeypatch, margin):
    """The second margin is so small that brackets must be widened."""
    monkeypatch.setattr(Q, "MARGIN", margin)
    s = Q.Store(store(Q.sketches(log, ["x", "y"], F.col("day"))), store(Q.chunks(log, ["x", "y"], F.col("day"), size=64)), ["x", "y"])
    rows = log.collect()
    probs = [0.0, 0.1, 0.25, 0.5, 0.99, 1.0]
    for days, line in (([0, 1, 2], None), ([1], None), ([0, 2], "L1"), ([2], "L4")):
        dates = [DAY0 + dt.timedelta(days=d) for d in days]
        where = F.col("day").isin(dates)
        got = s.quantiles(probs, where if line is None else where & (F.col("line") == line))
        for c in ("x", "y"):
            values = [r[c] for r in rows if r["day"] in dates and line in (None, r["line_id"]) and r[c] is not None and not math.isnan(r[c])]
            if not values:
                assert c not in got
                continue
            assert got[c][0] == len(values)
            assert all(close(a, interpolated(values, p)) for a, p in zip(got[c][1], probs))
    assert s.quantiles([0.5], F.lit(False)) == {}


def test_only_overlapping_chunks_are_read(spark):
    log = spark.range(20_000).select(F.lit(DAY0).alias("day"), F.lit("L1").alias("line_id"), F.col("id").cast("double").alias("x"))
    s = Q.Store(store(Q.sketches(log, ["x"], F.col("day"))), store(Q.chunks(log, ["x"], F.col("day"), size=100)), ["x"])
    seen = []
    real = Q.Store._ranked
    Q.Store._ranked = lambda self, rows, spans: seen.append(spans) or real(self, rows, spans)
    try:
        assert s.quantiles([0.5])["x"] == (20_000, [9999.5])
    finally:
        Q.Store._ranked = real
    _, _, lo, hi, *_ = seen[-1][0]
    assert s.chunks.where((F.col("hi") >= lo) & (F.col("lo") <= hi)).agg(F.sum("n")).first()[0] < 2_000


def test_distinct_counts_of_periods(spark):
    rng = np.random.default_rng(3)
    rows = [(DAY0 + dt.timedelta(days=int(d)), None if k % 50 == 0 else f"m{k}", "same") for d, k in zip(rng.integers(0, 6, 4000), rng.integers(0, 40_000, 4000))]
    log = spark.createDataFrame(rows + [(None, "m1", "same")], "d date, m string, s string")
    days = store(M.daily(log, F.col("d"), ["m", "s"], lambda df, name: store(df)))
    spans = [(a, b) for a in range(6) for b in range(a, 6)] + [(20, 22)]
    periods = spark.createDataFrame([(DAY0 + dt.timedelta(days=a), DAY0 + dt.timedelta(days=b)) for a, b in spans], "first_day date, last_day date")
    got = {(r["first_day"], r["last_day"], r["dim"]): r["n_distinct"] for r in M.distinct_in(days, periods).collect()}
    want = {}
    for a, b in spans:
        first, last = DAY0 + dt.timedelta(days=a), DAY0 + dt.timedelta(days=b)
        inside = [r for r in rows if first <= r[0] <= last]
        if inside:
            want[first, last, "m"] = len({r[1] for r in inside} - {None})
            want[first, last, "s"] = 1
    assert got == want
    assert days.where("dim = 'm'").select("bucket").distinct().count() == 1


def brute_silhouette(x, lab):
    out = []
    for i in range(len(x)):
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        mine = lab == lab[i]
        if mine.sum() == 1:
            out.append(0.0)
            continue
        a = d[mine].sum() / (mine.sum() - 1)
        b = min(d[lab == c].mean() for c in set(lab.tolist()) if c != lab[i])
        out.append((b - a) / max(a, b) if max(a, b) else 0.0)
    return float(np.mean(out))


@pytest.mark.parametrize("tile", [7, 1024])
def test_exact_silhouette(spark, tile):
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(c, 0.7, size=(60, 3)) for c in (0, 2, 5)])
    labels = np.repeat([0, 1, 2], 60)
    rows = [(*map(float, p), int(a), int(a > 0), 4 if k else 9, 1) for k, (p, a) in enumerate(zip(x, labels))] + [(None, 0.0, 0.0, 0, 0, 4, 1), (1.0, 1.0, 1.0, None, 0, 4, 1)]
    df = spark.createDataFrame(rows, "a double, b double, c double, l3 int, l2 int, lone int, one int").repartition(3)
    got = silhouettes(df, ["a", "b", "c"], ["l3", "l2", "lone", "one"], store, tile)
    for name, lab in (("l3", labels), ("l2", labels > 0), ("lone", np.array([9] + [4] * 179))):
        assert got[name] == pytest.approx(brute_silhouette(x, np.asarray(lab).astype(int)), rel=1e-9)
    assert got["one"] is None


def test_silhouette_of_an_empty_table(spark):
    assert silhouettes(spark.createDataFrame([], "a double, l int"), ["a"], ["l"], store) == {"l": None}


@pytest.mark.parametrize("run", [1, 300, Q.RUN])
def test_chunks_of_runs_hold_every_value_once(log, run):
    """A row of the log is shuffled once with all its columns, not once for each of them."""
    made = Q.chunks(log, ["x", "y"], F.col("day"), size=64, run=run)
    assert "Generate" not in made._jdf.queryExecution().toString()
    got: dict = {}
    for r in made.collect():
        assert r["v"] == sorted(r["v"]) and len(r["v"]) == r["n"] <= 64 and (r["lo"], r["hi"]) == (r["v"][0], r["v"][-1])
        got.setdefault((r["day"], r["line"], r["col"]), []).extend(r["v"])
    want: dict = {}
    for r in log.collect():
        for k, v in enumerate((r["x"], r["y"])):
            if v is not None and not math.isnan(v):
                want.setdefault((r["day"], r["line_id"], k), []).append(v)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert {(r["day"], r["line"], r["col"]): r["n"] for r in Q.sketches(log, ["x", "y"], F.col("day")).collect()} == {k: len(v) for k, v in want.items()}


def test_rows_without_a_day_or_line_or_value(spark):
    rows = [(DAY0, "L1", None), (DAY0, None, 2.0), (None, "L1", 3.0), (None, None, 4.0), (DAY0, None, math.nan), (DAY0, "L1", None)]
    log = spark.createDataFrame(rows, "day date, line_id string, x double")
    want = [(DAY0, None, 1), (None, "L1", 1), (None, None, 1)]
    for made in (Q.sketches(log, ["x"], F.col("day")), Q.chunks(log, ["x"], F.col("day"))):
        assert sorted(((r["day"], r["line"], r["n"]) for r in made.collect()), key=str) == sorted(want, key=str)
    assert Q.chunks(log.limit(0), ["x"], F.col("day")).collect() == []
