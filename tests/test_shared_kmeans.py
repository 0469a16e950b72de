"""Fits that share their scans: equal to fits made alone, seeding by its definition, indices."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plantlens.operators import cluster as K
from plantlens.operators import shared_kmeans as S

COLS = ["x", "y"]


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(4)
    pts = np.vstack([rng.normal(c, 0.6, size=(70, 2)) for c in [(0, 0), (4, 0), (0, 5), (4, 4)]])
    rows = [(float(a), float(b), float(a + 2 * b), int(h)) for (a, b), h in zip(pts, rng.integers(0, S.P, len(pts)))]
    rows += [rows[0]] * 3
    return spark.createDataFrame(rows, "x double, y double, s double, h long").repartition(3)


def test_shared_fits_equal_single_fits(points):
    ks = [1, 2, 3, 4, 6]
    fits, rounds = S.lloyd_shared(points, COLS, S.band_starts(points, COLS, ks, "s"))
    assert set(rounds) == set(ks) and max(rounds.values()) > min(rounds.values())
    for k in ks:
        alone = K.lloyd(points, COLS, k, init_col="s").centers
        assert len(fits[k]) == k
        for a, b in zip(fits[k], alone):
            assert (a is None) == (b is None) and (a is None or a == pytest.approx(b, rel=1e-9))


def test_indices_equal_the_single_ones(points):
    fits, _ = S.lloyd_shared(points, COLS, S.band_starts(points, COLS, [1, 2, 4], "s"))
    got = S.indices(points, COLS, fits)
    assert got[1][1:] == (None, None)
    for k in (2, 4):
        lab = points.withColumn("c", K.nearest(COLS, fits[k]))
        assert got[k][0] == pytest.approx(K.inertia(points, COLS, fits[k]), rel=1e-9)
        assert got[k][1] == pytest.approx(K.silhouette_sq(lab, COLS, "c").first()[0], rel=1e-9)
        assert got[k][2] == pytest.approx(K.davies_bouldin(lab, COLS, "c").first()[0], rel=1e-9)
    assert S.costs(points, COLS, fits) == pytest.approx({k: got[k][0] for k in fits}, rel=1e-9)


def test_seeds_are_the_smallest_exponential_keys(points):
    rows = [tuple(r) for r in points.select("x", "y", "h").collect()]
    starts = S.seeded_starts(points, COLS, "h", 3, 4)
    for r, centers in starts.items():
        chosen = []
        for step in range(3):
            a, b = S.mixers(r, step)
            keys = []
            for x, y, h in rows:
                d2 = min(((x - p) ** 2 + (y - q) ** 2 for p, q in chosen), default=1.0)
                u = ((h * a + b) % S.P + 1) / (S.P + 1)
                keys.append((-math.log(u) / d2 if d2 else math.inf, x, y))
            chosen.append(min(keys)[1:])
        assert [tuple(c) for c in centers] == chosen
        assert len(set(map(tuple, centers))) == 3
    assert len({str(c) for c in starts.values()}) == 4


def test_best_restart_has_the_least_cost(points):
    starts = S.seeded_starts(points, COLS, "h", 4, 6)
    fits, _ = S.lloyd_shared(points, COLS, starts)
    costs = S.costs(points, COLS, fits)
    best = S.best_of(points, COLS, "h", 4, 6)
    assert S.costs(points, COLS, {0: best})[0] == pytest.approx(min(costs.values()), rel=1e-9)


def test_seeds_follow_squared_distances(spark):
    """Two far points among many near ones: a second centre is nearly always one of them."""
    rows = [(0.001 * k, 0.0, k * 7919 % S.P) for k in range(200)] + [(100.0, 0.0, 77), (0.0, 100.0, 78)]
    df = spark.createDataFrame(rows, "x double, y double, h long")
    starts = S.seeded_starts(df, COLS, "h", 3, 30)
    assert sum(max(c[0] for c in cs) == 100.0 and max(c[1] for c in cs) == 100.0 for cs in starts.values()) >= 28


def test_edge_tables(spark):
    schema = "x double, y double, s double, h long"
    empty = spark.createDataFrame([], schema)
    assert S.band_starts(empty, COLS, [2], "s") == {2: [None, None]}
    assert S.seeded_starts(empty, COLS, "h", 2, 2) == {0: [None, None], 1: [None, None]}
    fits, rounds = S.lloyd_shared(empty, COLS, {0: [None, None]})
    assert fits == {0: [None, None]} and rounds == {0: 0} and S.costs(empty, COLS, {0: [[0.0, 0.0]]}) == {0: 0.0}
    same = spark.createDataFrame([(1.0, 2.0, 0.0, 5)] * 4 + [(None, 2.0, 0.0, 5), (1.0, None, 1.0, 6)], schema)
    assert S.seeded_starts(same, COLS, "h", 2, 1) == {0: [[1.0, 2.0], None]}
    assert S.best_of(same, COLS, "h", 2, 3) == [[1.0, 2.0], None]
    assert S.indices(same, COLS, {2: [[1.0, 2.0], None]}) == {2: (0.0, None, None)}


def test_row_hash_is_portable(spark):
    import duckdb
    got = spark.sql("SELECT 'a' AS p, CAST(NULL AS STRING) AS q, 12L AS r").select(S.row_hash(F.col("p"), F.col("q"), F.col("r"))).first()[0]
    assert got == duckdb.sql(f"SELECT ('0x' || substr(md5('a||12'), 1, 13))::BIGINT % {S.P}").fetchall()[0][0]


def test_labels_by_product_are_those_by_differences():
    """Ties, near ties far from the origin, missing centres, NaN and infinite values: the same labels
    as by squared differences; without ties no squared difference is taken."""
    import math

    import numpy as np
    import plantlens.operators.shared_kmeans as SK
    rnd = np.random.default_rng(5)
    for centers in ([[0.0, 0.0], [2.0, 0.0], [0.0, 2.0]], [[1e6 + 0.5, 0.0], [1e6, 0.0], [1e6 + 1e-9, 0.0]],
                    [None, [1.0, 1.0], None, [1.0, 1.0], [3.0, 1.0]], [[4.0, 4.0]], [None, None]):
        x = np.concatenate([rnd.integers(-3, 4, (500, 2)) / 1.0, rnd.normal(0, 2, (500, 2)), 1e6 + rnd.normal(0, 1, (500, 2)),
                            [[math.nan, 0.0], [math.inf, 1.0], [-math.inf, math.nan], [1e200, 1.0]]])
        with np.errstate(all="ignore"):
            assert (SK.nearest_label(x, centers) == SK._sq_dists(x, centers).argmin(axis=1)).all()


def test_labels_take_one_product_a_fit(monkeypatch):
    import numpy as np
    import plantlens.operators.shared_kmeans as SK
    taken, real = [], SK._sq_dists
    monkeypatch.setattr(SK, "_sq_dists", lambda x, c: taken.append(len(x)) or real(x, c))
    SK.nearest_label(np.random.default_rng(1).normal(0, 1, (20_000, 8)), np.random.default_rng(2).normal(0, 1, (10, 8)).tolist())
    assert sum(taken) == 0


def test_a_round_labels_every_row_once(points, monkeypatch):
    """A round takes one matrix product for all fits; labels under two sets of centres are compared only
    where a round left all sizes as they were."""
    products, find, sums = [], S.nearest_labels, S._sums

    def scan(df, cols, label, n_more=0, blocks=None):
        taken = []
        monkeypatch.setattr(S, "nearest_labels", lambda x, fits: taken.append(len(fits)) or find(x, fits))
        label(np.zeros((1, len(cols))))
        monkeypatch.setattr(S, "nearest_labels", find)
        products.append(len(taken))
        return sums(df, cols, label, n_more, blocks)
    monkeypatch.setattr(S, "_sums", scan)
    _, rounds = S.lloyd_shared(points, COLS, {k: [[float(j), 0.0] for j in range(k)] for k in (2, 3, 4)})
    assert products.count(1) == max(rounds.values()) + 1 and 1 <= products.count(2) < products.count(1)


def test_swapped_rows_of_equal_sizes_are_not_rest(spark):
    """Clusters that trade as many rows as they get go on."""
    rows = [(0.0, 0.0), (0.0, 1.0), (3.0, 0.0), (3.0, 1.0), (1.4, 6.0), (1.6, -6.0)]
    df = spark.createDataFrame(rows, "x double, y double")
    start = [[0.0, -2.0], [3.0, 2.0]]
    fits, _ = S.lloyd_shared(df, COLS, {0: start})
    x, now = np.array(rows), np.array(start)
    lab = None
    while True:
        found = ((x[:, None] - now[None]) ** 2).sum(axis=2).argmin(axis=1)
        if lab is not None and (found == lab).all():
            break
        lab, now = found, np.array([x[found == j].mean(axis=0) for j in (0, 1)])
    assert np.array(fits[0]) == pytest.approx(now)


def test_packed_rows_are_all_rows(spark):
    """Blocks hold every complete row, whatever their number in a batch; rounds give what single rows give."""
    x = np.random.default_rng(8).normal(size=(20_011, 2))
    df = spark.createDataFrame([(float(a), float(b)) for a, b in x] + [(None, 1.0)], "x double, y double").repartition(3)
    label = lambda v: {0: ((v[:, 0] > 0).astype(np.int64), 2, [])}
    blocks = S.packed(df, COLS)
    plain, own = S._sums(df, COLS, label), S._sums(df, COLS, label, blocks=blocks)
    blocks.unpersist()
    assert plain.keys() == own.keys() and sum(v[0] for v in own.values()) == 20_011
    for k in plain:
        assert own[k] == pytest.approx(plain[k], rel=1e-9)


def test_rounds_keep_no_rows_in_executors(points, monkeypatch):
    """The packed rows lie in the shared folder in short blocks, and are removed after the rounds."""
    from plantlens import session
    held, sums = [], S._sums

    def scan(df, cols, label, n_more=0, blocks=None):
        if blocks is not None:
            held.append((df.sparkSession.sparkContext._jsc.getPersistentRDDs().size(), blocks.inputFiles(), blocks.agg(F.max(F.length("block"))).first()[0]))
        return sums(df, cols, label, n_more, blocks)
    before = points.sparkSession.sparkContext._jsc.getPersistentRDDs().size()
    starts = S.band_starts(points, COLS, [2, 3], "s")
    scratch = list(session._SCRATCH)
    monkeypatch.setattr(S, "_sums", scan)
    S.lloyd_shared(points, COLS, starts)
    assert held and all(n == before and files and size <= 8 * 8 * len(COLS) for n, files, size in held)
    assert session._SCRATCH == scratch


def test_sums_by_label_of_any_values():
    rng = np.random.default_rng(8)
    values = np.vstack([np.ones(300), rng.normal(size=(3, 300))])
    for k in (1, 3, S.FEW_LABELS, S.FEW_LABELS + 1, 200):
        lab = rng.integers(0, k, 300)
        got = S._by_label(lab, k, values)
        assert np.allclose(got, [values[:, lab == j].sum(axis=1) for j in range(k)], rtol=1e-12, atol=1e-12) and got[:, 0].sum() == 300
    values[2, 5] = math.inf
    got = S._by_label(np.arange(300) % 3, 3, values)
    assert np.isinf(got[2, 2]) and np.isfinite(np.delete(got, 2, axis=0)).all()


def test_labels_of_many_centres():
    rng = np.random.default_rng(9)
    x, centers = rng.normal(size=(500, 2)), rng.normal(size=(300, 2)).tolist()
    assert S.nearest_label(x, centers).tolist() == S._sq_dists(x, centers).argmin(axis=1).tolist()
