"""Forests on packed rows: equal to trees grown by brute force, whatever the scans are cut into."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from plantlens.operators import forest as T
from plantlens.operators import whatif as W


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    a, b, c = rng.normal(size=700), rng.integers(0, 9, 700).astype(float), rng.normal(size=700)
    level = (a > 0.2).astype(int) + ((b > 4) & (rng.random(700) < 0.8)).astype(int)
    return spark.createDataFrame([(float(x), float(y), float(z), int(v)) for x, y, z, v in zip(a, b, c, level)], "a double, b double, c double, level int").repartition(3).persist()


def _packed(rows, features, cuts, seed):
    stride = T.HEAD + len(features)
    x = np.concatenate([np.frombuffer(r[0], np.uint8).reshape(-1, stride) for r in T.packed(rows, features, "level", cuts, seed).collect()])
    return np.ascontiguousarray(x[:, :4]).view(np.uint32).ravel(), x[:, 4].astype(int), x[:, T.HEAD:].astype(int)


def _gini(y, w, classes):
    n = np.bincount(y, w, classes)
    return 1 - ((n / n.sum()) ** 2).sum()


def test_trees_of_one_feature_equal_brute_force(rows):
    forest = T.fit(rows, ["a"], "level", 700, trees=3, depth=4, seed=5)
    keys, y, x = _packed(rows, ["a"], forest.cuts, 5)
    assert len(keys) == 700 and len(forest.cuts[0]) in (30, 31)
    for t, seed in enumerate(np.random.default_rng(5).integers(0, 2 ** 32, 3)):
        at, times = T.in_bag(keys, int(seed))
        w = np.zeros(700)
        w[at] = times
        node = np.zeros(700, int)
        for level in range(4):
            for i in range(2 ** level - 1, 2 ** (level + 1) - 1):
                own = (node == i) & (w > 0)
                if not own.any():
                    continue
                assert forest.counts[t, i].tolist() == np.bincount(y[own], w[own], 3).tolist()
                gains = []
                for cut in range(31):
                    left, right = own & (x[:, 0] <= cut), own & (x[:, 0] > cut)
                    n = w[own].sum()
                    gains.append(-1 if not left.any() or not right.any() else _gini(y[own], w[own], 3)
                                 - w[left].sum() / n * _gini(y[left], w[left], 3) - w[right].sum() / n * _gini(y[right], w[right], 3))
                if forest.gain[t, i] > 0:  # not pruned
                    assert forest.gain[t, i] == pytest.approx(max(gains))
                    assert gains[forest.bound[t, i]] == pytest.approx(max(gains))
                    node[node == i] = np.where(x[node == i, 0] > forest.bound[t, i], 2 * i + 2, 2 * i + 1)


def test_cuts_of_the_scans_do_not_matter(rows, monkeypatch):
    whole = T.fit(rows, ["a", "b", "c"], "level", 700, trees=5, depth=5)
    monkeypatch.setattr(T, "PIECE", 3)
    parts = T.fit(rows, ["a", "b", "c"], "level", 700, trees=5, depth=5, cells=700)
    for own, other in ((whole.feature, parts.feature), (whole.bound, parts.bound), (whole.gain, parts.gain), (whole.counts, parts.counts)):
        assert np.array_equal(own, other)


def test_votes_and_importances(rows):
    forest = T.fit(rows, ["a", "b", "c"], "level", 700, trees=7, depth=5)
    got = forest.transform(rows).collect()
    assert len(got) == 700 and got[0].asDict().keys() == {"a", "b", "c", "level", "prediction"}
    for r in got[:60]:
        x, votes = [np.searchsorted(cut, r[f]) for f, cut in zip("abc", forest.cuts)], np.zeros(3)
        for t in range(7):
            i = 0
            while i < forest.gain.shape[1] and forest.gain[t, i] > 0:
                i = 2 * i + 1 + int(x[forest.feature[t, i]] > forest.bound[t, i])
            votes += forest.counts[t, i] / forest.counts[t, i].sum()
        assert r["prediction"] == votes.argmax()
    assert sum(r["prediction"] == r["level"] for r in got) > 590
    share = forest.importances()
    assert share.sum() == pytest.approx(1) and share[0] > share[2] < share[1]


def test_leaves_of_one_prediction_are_merged():
    counts = np.array([[[9, 5], [6, 2], [3, 3], [5, 0], [1, 2], [2, 1], [1, 2]]], float)
    forest = T.Forest(["a"], [np.array([0.5])], np.zeros((1, 3), np.uint8), np.zeros((1, 3), np.uint8), np.array([[0.1, 0.2, 0.3]]), counts)
    forest.prune()
    assert forest.gain.tolist() == [[0.1, 0.2, 0.3]]  # both lower nodes tell classes apart
    forest.counts[0, 4] = [2, 1]
    forest.prune()
    assert forest.gain.tolist() == [[0.1, 0.0, 0.3]] and forest.bound.tolist() == [[0, 255, 0]]
    assert forest.votes()[0, :2].tolist() == [[0.75, 0.25]] * 2


def test_draws_are_poisson():
    rows, times = T.in_bag(T.mixed(np.arange(200_000, dtype=np.uint32)), 77)
    assert len(rows) / 200_000 == pytest.approx(1 - np.exp(-1), abs=0.005)
    assert times.sum() / 200_000 == pytest.approx(1, abs=0.01) and (times == 2).sum() / 200_000 == pytest.approx(np.exp(-1) / 2, abs=0.005)
    other, _ = T.in_bag(T.mixed(np.arange(200_000, dtype=np.uint32)), 78)
    assert len(np.intersect1d(rows, other)) / 200_000 == pytest.approx((1 - np.exp(-1)) ** 2, abs=0.005)


def test_candidate_splits_are_those_of_spark(spark):
    assert T.split_points(np.array([1.0, 2.0, 4.0]), np.array([5, 1, 1])) == [1.5, 3.0]
    assert T.split_points(np.array([3.0]), np.array([7])) == []
    even = T.split_points(np.arange(64.0), np.ones(64))
    assert len(even) == 31 and even[0] == 1.5 and even[-1] == 61.5


def test_many_rows_are_not_kept_by_tree(spark, rows, monkeypatch):
    """Above ``ML_ROWS`` a row takes a few bytes, not a count and a node number of every tree, and nothing stays cached."""
    monkeypatch.setattr(W, "ML_ROWS", 600)
    kept, packed = [], T.packed
    monkeypatch.setattr(T, "packed", lambda *a: kept.append(packed(*a)) or kept[-1])
    gone = rows.withColumn("c", F.when(F.col("b") != 3, F.col("c"))).unionByName(rows.limit(5).withColumn("level", F.lit(None).cast("int")))
    driver = W.fit_driver(gone, ["a", "b", "c"], trees=5, depth=4)
    assert isinstance(driver.model, T.Forest) and kept[0].agg(F.sum(F.length("block"))).first()[0] == 700 * (T.HEAD + 3)
    assert W.score(driver, gone.where("level IS NOT NULL")).where("predicted = level").count() > 560
    assert sum(v for _, v in W.importance(driver)) == pytest.approx(1)
    assert not spark.sparkContext._jsc.getPersistentRDDs().size() > 1  # the fixture's rows alone
