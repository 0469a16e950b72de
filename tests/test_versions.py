"""What is built from the input files follows them: fits, tables and scratch."""
import os
import shutil
import tempfile

import pytest
from pyspark.sql import functions as F

from plantlens.plans import context as ctx
from plantlens.plans.registry import QUERIES, load_all

load_all()


@pytest.fixture
def own(sf):
    """A copy of the input tables that a test may change."""
    d = tempfile.mkdtemp(prefix="plantlens-in-")
    for t in ctx.INPUTS:
        shutil.copyfile(f"{sf}/{t}.parquet", f"{d}/{t}.parquet")
    return d


def _swap(spark, own):
    """Other lineitem rows under the same path."""
    rows = spark.read.parquet(f"{own}/lineitem.parquet").filter(F.col("l_orderkey") % 3 == 0)
    rows = rows.withColumn("l_extendedprice", F.col("l_extendedprice") * 2)
    one = tempfile.mkdtemp(prefix="plantlens-new-")
    rows.coalesce(1).write.mode("overwrite").parquet(one)
    part = next(f for f in os.listdir(one) if f.endswith(".parquet"))
    shutil.copyfile(f"{one}/{part}", f"{own}/lineitem.parquet")
    return rows.count()


def test_changed_inputs_are_fitted_anew(spark, own):
    QUERIES["zscore"](spark, own).count()
    QUERIES["kmeans_lloyd5"](spark, own).count()
    QUERIES["shift_mix"](spark, own).count()
    v = ctx.version(spark, own)
    v.fit("driver-units_produced", lambda: "a forest")
    old_paths, old_centers = {**v.paths, "bronze": v.bronze.parts[0].log}, ctx.condition_centers(spark, own)
    n = _swap(spark, own)
    z = QUERIES["zscore"](spark, own)
    stats = z.agg(*[F.avg(c).alias(f"m_{c}") for c in z.columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in z.columns]).first()
    for c in z.columns:
        assert stats[f"m_{c}"] == pytest.approx(0, abs=1e-5)
        assert stats[f"s_{c}"] == pytest.approx(1, abs=1e-5)
    assert z.count() <= n
    assert ctx.condition_centers(spark, own) != old_centers
    assert "driver-units_produced" not in ctx.version(spark, own).fits
    assert not any(os.path.exists(p.replace("file:", "")) for p in old_paths.values())  # scratch of the old version


def test_unchanged_inputs_are_not_rebuilt(spark, own):
    QUERIES["shape"](spark, own).count()
    paths = dict(ctx.version(spark, own).paths)
    QUERIES["enriched_log"](spark, own).count()
    QUERIES["enriched_log"](spark, own).count()
    now = ctx.version(spark, own).paths
    assert all(now[k] == p for k, p in paths.items())
    assert sum(k == "enriched" for k in now) == 1


def test_raw_queries_do_not_build_silver(spark, own):
    QUERIES["null_counts"](spark, own).count()
    assert not ctx.version(spark, own).paths and len(ctx.version(spark, own).bronze.parts) == 1


def test_an_appended_file_is_read_alone(spark, own, sf):
    """A folder of three files, a fourth one comes: one more generation, and all results are
    those of a rebuild."""
    folder = tempfile.mkdtemp(prefix="plantlens-folder-")
    rows = spark.read.parquet(f"{sf}/lineitem.parquet")
    early, late = rows.where("l_orderkey % 4 <> 1"), rows.where("l_orderkey % 4 = 1")
    early.repartition(3).write.mode("overwrite").parquet(folder)
    os.remove(f"{own}/lineitem.parquet")
    shutil.copytree(folder, f"{own}/lineitem.parquet")
    names = ["describe_long", "log_moments", "log_correlations", "iqr_outliers", "clean_summary", "oee_by_machine"]
    for n in names:
        QUERIES[n](spark, own).collect()
    bronze = ctx.version(spark, own).bronze
    first, read = bronze.parts[0], bronze.files_read
    assert read == 3
    late.coalesce(1).write.mode("append").parquet(f"{own}/lineitem.parquet")
    got = {n: QUERIES[n](spark, own).collect() for n in names}
    assert ctx.version(spark, own).bronze is bronze and bronze.parts[0] is first
    assert len(bronze.parts) == 2 and bronze.files_read == read + 1
    for n in names:  # ``sf`` is the same table, built at once
        assert _near(got[n], QUERIES[n](spark, sf).collect()), n
    # a file that goes takes its generation along; the others stay
    gone = next(iter(bronze.parts[1].files))[0].replace("file:", "")
    os.remove(gone)
    assert QUERIES["shape"](spark, own).first()["n_rows"] == ctx.plant(spark, own).count() < ctx.plant(spark, sf).count()
    assert bronze.parts == [first] and bronze.files_read == read + 1
    # another part table starts afresh
    shutil.copyfile(f"{sf}/part.parquet", f"{own}/part.parquet")
    os.utime(f"{own}/part.parquet", (1, 1))
    QUERIES["shape"](spark, own).collect()
    assert ctx.version(spark, own).bronze is not bronze and not os.path.exists(first.log.replace("file:", ""))


def _near(a, b):
    key = lambda rows: sorted((tuple(r) for r in rows), key=str)
    flat = lambda rows: [v for r in key(rows) for v in r]
    return len(a) == len(b) and all(x == y or isinstance(x, float) and x == pytest.approx(y, rel=1e-6, abs=2e-6) for x, y in zip(flat(a), flat(b)))


def test_tables_may_be_folders(spark, own, sf):
    folder = tempfile.mkdtemp(prefix="plantlens-folder-")
    spark.read.parquet(f"{own}/lineitem.parquet").repartition(3).write.mode("overwrite").parquet(folder)
    os.remove(f"{own}/lineitem.parquet")
    shutil.copytree(folder, f"{own}/lineitem.parquet")
    got = {tuple(r) for r in QUERIES["oee_by_machine"](spark, own).collect()}
    assert got == {tuple(r) for r in QUERIES["oee_by_machine"](spark, sf).collect()}


def test_pair_sums_do_not_multiply_rows(spark):
    """The co-moments take a scan of the rows, not a row per pair and row; NULL, NaN, infinite and
    huge values count in their own pairs only."""
    from plantlens.plans.generations import comoments
    nan, inf = float("nan"), float("inf")
    rows = [(1.0, 2.0, 3.0, None), (2.0, None, -1.0, None), (None, 5.0, 4.0, None), (4.0, 1.0, nan, None),
            (inf, None, 2.0, None), (3.0, 1e200, None, None), (0.5, 0.25, 8.0, None)] * 3
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    got = comoments(df, ["a", "b", "c", "d"], {"a": 1.0})
    assert "Generate" not in got._jdf.queryExecution().executedPlan().toString()
    want = {}
    for x, y in (("a", "b"), ("a", "c"), ("b", "c")):
        p, q = F.col(x) - F.lit(1.0 if x == "a" else 0.0), F.col(y)
        want[x, y] = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).agg(
            F.count(F.lit(1)), F.sum(p), F.sum(q), F.sum(p * p), F.sum(q * q), F.sum(p * q)).first()
    found = {(r["a"], r["b"]): tuple(r)[2:] for r in got.collect()}
    assert set(found) == set(want)  # no row has d
    for k in want:
        assert found[k] == pytest.approx(tuple(want[k]), nan_ok=True), k


def test_the_cleaned_log_is_not_written_again(spark, own):
    """A query of the cleaned log writes the raw log and its moments alone; pair sums come with
    the first correlation, once."""
    assert QUERIES["downtime_rows"](spark, own).count() == 1
    v = ctx.version(spark, own)
    stats = v.bronze.parts[0].stats.replace("file:", "")
    assert not v.paths and os.listdir(stats) == ["moments"]
    first = {tuple(r) for r in QUERIES["log_correlations"](spark, own).collect()}
    written = os.path.getmtime(f"{stats}/comoments/_SUCCESS")
    assert {tuple(r) for r in QUERIES["log_correlations"](spark, own).collect()} == first and len(first) == 120
    assert os.path.getmtime(f"{stats}/comoments/_SUCCESS") == written
