"""Clustering: Lloyd properties, silhouette/DB against references, planted truth."""
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from plantlens.operators import clean as C
from plantlens.operators import cluster as K
from plantlens.schema import MACHINE_FEATURES8
from plantlens.sources.plant import plant_log


def blobs(spark, n=60, seed=1):
    rng = np.random.default_rng(seed)
    pts = np.vstack([rng.normal(c, 0.4, size=(n, 2)) for c in [(0, 0), (4, 0), (0, 5)]])
    rows = [(float(a), float(b), float(a + 2 * b)) for a, b in pts]
    return spark.createDataFrame(rows, "x double, y double, s double"), pts


def inertia(df, cols, centers):
    live = [c for c in centers if c is not None]
    d = F.least(*[K.sq_dist(cols, c) for c in live]) if len(live) > 1 else K.sq_dist(cols, live[0])
    return df.agg(F.sum(d)).first()[0]


def test_lloyd_inertia_non_increasing(spark):
    df, _ = blobs(spark)
    m = K.lloyd(df, ["x", "y"], 3, init_col="s")
    vals = [inertia(df, ["x", "y"], c) for c in m.history]
    assert all(b <= a + 1e-9 for a, b in zip(vals, vals[1:]))


def test_silhouette_matches_evaluator(spark):
    from pyspark.ml.evaluation import ClusteringEvaluator
    df, _ = blobs(spark)
    lab = K.lloyd(df, ["x", "y"], 3, init_col="s").assign(df, "c")
    ours = K.silhouette_sq(lab, ["x", "y"], "c").first()[0]
    vec = K.assemble(lab, ["x", "y"])
    ev = ClusteringEvaluator(featuresCol="features", predictionCol="c", distanceMeasure="squaredEuclidean")
    assert ours == pytest.approx(ev.evaluate(vec.withColumn("c", F.col("c").cast("double"))), rel=1e-9)


def test_davies_bouldin_brute_force(spark):
    df, pts = blobs(spark, n=20)
    lab = K.lloyd(df, ["x", "y"], 3, init_col="s").assign(df, "c")
    rows = lab.collect()
    X = np.array([[r["x"], r["y"]] for r in rows])
    L = np.array([r["c"] for r in rows])
    ks = sorted(set(L))
    cent = {k: X[L == k].mean(0) for k in ks}
    S = {k: np.linalg.norm(X[L == k] - cent[k], axis=1).mean() for k in ks}
    db = np.mean([max((S[i] + S[j]) / np.linalg.norm(cent[i] - cent[j]) for j in ks if j != i) for i in ks])
    assert K.davies_bouldin(lab, ["x", "y"], "c").first()[0] == pytest.approx(db, rel=1e-9)


def test_planted_condition_recovered(spark, sf):
    raw = plant_log(spark, sf, keep_truth=True)
    cl = C.clean(raw).df
    z, _ = K.standardize(cl, MACHINE_FEATURES8, suffix="_z")
    zc = [f"{c}_z" for c in MACHINE_FEATURES8]
    lab = K.lloyd(z, zc, 3, init_col="error_rate").assign(z, "c")
    tab = {(r["c"], r["true_state"]): r["n"] for r in lab.groupBy("c", "true_state").agg(F.count("*").alias("n")).collect()}
    total = sum(tab.values())
    best = max(sum(tab.get((c, s), 0) for c, s in zip(perm, range(3))) for perm in itertools.permutations(range(3)))
    assert best / total > 0.9
    prof = K.centroid_profile(lab, "c", ["error_rate_z", "oil_level_z"]).collect()
    names = K.name_condition({r["c"]: {"error_rate": r["error_rate_z"], "oil_level": r["oil_level_z"]} for r in prof})
    crit = [c for c, n in names.items() if n == "Critical"][0]
    top = max(range(3), key=lambda s: tab.get((crit, s), 0))
    assert top == 0  # the planted critical state


def test_sizes_sum_to_rows(spark):
    df, pts = blobs(spark)
    lab = K.lloyd(df, ["x", "y"], 3, init_col="s").assign(df, "c")
    assert sum(r["rows"] for r in K.cluster_sizes(lab, "c").collect()) == len(pts)


def test_lloyd_runs_to_rest(spark, sf):
    """One more step changes no label, on the machine features of the cleaned log."""
    from plantlens.plans import context as ctx
    zdf, zcols = ctx.condition_z(spark, sf)
    m = K.lloyd(zdf, zcols, 3, init_col="error_rate")
    again = K._centroids(zdf, zcols, m.label(), 3, m.centers)[0]
    moved = zdf.filter(K.nearest(zcols, again) != K.nearest(zcols, m.centers)).count()
    assert moved == 0 and len(m.history) > 6
    assert again == [[pytest.approx(v, abs=1e-12) for v in c] for c in m.centers]


def test_nearest_prefers_the_lowest_index_and_skips_missing_centres(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (2.0,)], "x double")
    assert [r[0] for r in df.select(K.nearest(["x"], [[0.0], None, [2.0]])).collect()] == [0, 0, 2]


def test_constant_data(spark):
    df = spark.createDataFrame([(1.0, 2.0, i % 2) for i in range(6)], "x double, y double, c int")
    assert K.silhouette_sq(df, ["x", "y"], "c").first()[0] == 0.0
    m = K.lloyd(df, ["x", "y"], 3, init_col="x")
    assert m.centers[0] == [1.0, 2.0] and K.inertia(df, ["x", "y"], m.centers) == 0.0
    assert K.lloyd(df.limit(0), ["x", "y"], 2, init_col="x").assign(df.limit(0)).count() == 0


def test_ml_fit_is_at_rest(spark):
    df, _ = blobs(spark)
    vec = K.assemble(df, ["x", "y"])
    m = K.fit_kmeans(vec, 3, 42)
    centers = [c.tolist() for c in m.clusterCenters()]
    again = K._centroids(df, ["x", "y"], K.nearest(["x", "y"], centers), 3, centers)[0]
    assert again == [[pytest.approx(v, abs=1e-9) for v in c] for c in centers]
    assert m.summary.trainingCost == pytest.approx(K.inertia(df, ["x", "y"], centers))
