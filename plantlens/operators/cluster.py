"""Z-scores, K-Means (deterministic Lloyd and Spark ML), cluster
quality indices, PCA scores and canonical cluster names.

All per-row work is Spark SQL expressions over literal per-cluster
statistics (k x d numbers, bounded by k and d, never by rows): assignment is
an argmin over k distance expressions, so no join and no pair of rows is
ever formed.  Each Lloyd iteration is one scan with partial aggregation.
Fits iterate until the labels rest; there is no iteration cap.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Centroids = list[list[float]]


# ----------------------------------------------------------------- scaling

def standardize(df: DataFrame, cols: Sequence[str], ddof: int = 0, suffix: str = "") -> tuple[DataFrame, dict]:
    """z = (x - mean) / std with the population std (ddof 0, like the
    analysis' scaler); a constant column scales to 0.  One stats pass."""
    cols = list(cols)
    sd = F.stddev_pop if ddof == 0 else F.stddev_samp
    row = df.agg(*[F.avg(c).alias(f"m_{c}") for c in cols], *[sd(c).alias(f"s_{c}") for c in cols]).first()
    stats = {c: (row[f"m_{c}"], row[f"s_{c}"]) for c in cols}
    z = {}
    for c in cols:
        m, s = stats[c]
        z[c + suffix] = ((F.col(c) - F.lit(m)) / F.lit(s)) if s else F.lit(0.0)
    return df.withColumns(z), stats


# ------------------------------------------------------------ assignment

def sq_dist(cols: Sequence[str], center: Sequence[float]) -> Column:
    """Squared Euclidean distance to a literal centre, summed left to right."""
    out = None
    for c, v in zip(cols, center):
        d = F.col(c) - F.lit(float(v))
        out = d * d if out is None else out + d * d
    return out


def nearest(cols: Sequence[str], centers: Centroids) -> Column:
    """Index of the nearest centre (lowest index on ties); a missing (None)
    centre is never chosen.  Every distance is computed once: the least
    (distance, index) of an array of them."""
    return F.array_min(F.array(*[
        F.struct(sq_dist(cols, c).alias("d"), F.lit(j).alias("j")) for j, c in enumerate(centers) if c is not None]))["j"]


def _centroids(df: DataFrame, cols: Sequence[str], label: Column, k: int, prev: Centroids | None) -> tuple[Centroids, dict]:
    """Means per label (an empty cluster keeps its previous centre), and per label how many
    rows it has and the sum of their hashes: equal exactly when no row changed its label."""
    rows = {r["_l"]: r for r in df.groupBy(label.alias("_l")).agg(
        *[F.avg(c).alias(c) for c in cols], F.count(F.lit(1)).alias("_n"),
        F.bit_xor(F.xxhash64(*cols)).alias("_x"), F.sum(F.shiftright(F.xxhash64(*cols), 20)).alias("_h")).collect()}
    out = []
    for j in range(k):
        if j in rows:
            out.append([rows[j][c] for c in cols])
        else:
            out.append(prev[j] if prev else None)
    return out, {j: (r["_n"], r["_x"], r["_h"]) for j, r in rows.items()}


def band_init(df: DataFrame, cols: Sequence[str], k: int, init_col: str) -> Centroids:
    """Initial centres: means of k equal-width bands of ``init_col``."""
    r = df.agg(F.min(init_col).alias("lo"), F.max(init_col).alias("hi")).first()
    lo, hi = r["lo"], r["hi"]
    if hi == lo:
        band = F.lit(0)
    else:
        band = F.least(F.floor((F.col(init_col) - F.lit(lo)) / F.lit(hi - lo) * F.lit(float(k))),
                       F.lit(k - 1)).cast("int")
    return _centroids(df, cols, band, k, None)[0]


@dataclass
class Lloyd:
    cols: list[str]
    centers: Centroids
    history: list

    def label(self, name: str = "cluster") -> Column:
        return nearest(self.cols, self.centers).alias(name)

    def assign(self, df: DataFrame, name: str = "cluster") -> DataFrame:
        return df.withColumn(name, nearest(self.cols, self.centers))


def lloyd(df: DataFrame, cols: Sequence[str], k: int, init_col: str | None = None) -> Lloyd:
    """K8: deterministic Lloyd K-Means to rest: band initialisation, then rounds
    of (assign to the nearest literal centre -> mean per cluster) until no row
    changes its label.  An emptied cluster keeps its previous centre.  The
    returned centres are the means of the labels they give.

    Every round is one scan of ``df`` (a written table or cheap projection of
    one: a lost executor rereads it) with k rows to the driver."""
    cols = list(cols)
    init_col = init_col or cols[0]
    data = df.select(*dict.fromkeys(cols + [init_col]))
    centers = band_init(data, cols, k, init_col)
    if all(c is None for c in centers):  # no rows
        return Lloyd(cols, [[0.0] * len(cols)], [centers])
    hist, before = [centers], None
    while True:
        new, members = _centroids(data, cols, nearest(cols, centers), k, centers)
        if members == before:
            return Lloyd(cols, centers, hist)
        hist.append(new)
        centers, before = new, members


# ---------------------------------------------------------- cluster stats

def cluster_stats(df: DataFrame, cols: Sequence[str], label: str) -> dict[int, dict]:
    """Per cluster: n, sum vector, sum of squared norms (k rows to the driver)."""
    sq = None
    for c in cols:
        sq = F.col(c) * F.col(c) if sq is None else sq + F.col(c) * F.col(c)
    rows = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.sum(sq).alias("y"),
                                 *[F.sum(c).alias(f"s_{c}") for c in cols]).collect()
    return {r[label]: {"n": r["n"], "y": r["y"], "s": [r[f"s_{c}"] for c in cols]} for r in rows
            if r[label] is not None}


def silhouette_sq(df: DataFrame, cols: Sequence[str], label: str) -> DataFrame:
    """mean silhouette with squared Euclidean distance (the definition of
    Spark's ClusteringEvaluator), by the O(n k) closed form
    d(x, C) = |x|^2 + Y_C / n_C - 2 x . S_C / n_C (no pairs are formed)."""
    cols = list(cols)
    st = cluster_stats(df, cols, label)
    ids = sorted(st)
    if len(ids) < 2:
        return df.sparkSession.createDataFrame([(None,)], "silhouette double")
    sq = None
    for c in cols:
        sq = F.col(c) * F.col(c) if sq is None else sq + F.col(c) * F.col(c)
    d = {}
    for cid in ids:
        s = st[cid]
        dot = None
        for c, v in zip(cols, s["s"]):
            t = F.col(c) * F.lit(float(v))
            dot = t if dot is None else dot + t
        d[cid] = sq + F.lit(s["y"] / s["n"]) - F.lit(2.0) * dot / F.lit(float(s["n"]))
    lab = F.col(label)
    own_n = F.create_map(*[v for cid in ids for v in (F.lit(cid), F.lit(st[cid]["n"]))])[lab]
    # each distance stands once in a and once in b, however many clusters there are
    a = F.coalesce(*[F.when(lab == cid, d[cid]) for cid in ids])
    a = F.try_divide(a * own_n, own_n - 1)
    b = F.array_min(F.array(*[F.when(lab != cid, d[cid]) for cid in ids]))
    # coinciding points: both distances 0, silhouette 0
    s = F.when(own_n <= 1, F.lit(0.0)).otherwise(F.coalesce(F.try_divide(b - a, F.greatest(a, b)), F.lit(0.0)))
    return df.filter(lab.isNotNull()).agg(F.avg(s).alias("silhouette"))


def davies_bouldin(df: DataFrame, cols: Sequence[str], label: str) -> DataFrame:
    """Davies-Bouldin index: mean over clusters of max_j (S_i + S_j) / M_ij,
    S = mean distance to the centroid, M = distance between centroids."""
    cols = list(cols)
    st = cluster_stats(df, cols, label)
    ids = sorted(st)
    cent = {cid: [v / st[cid]["n"] for v in st[cid]["s"]] for cid in ids}
    lab = F.col(label)
    dist = None
    for cid in ids:
        e = F.sqrt(sq_dist(cols, cent[cid]))
        dist = F.when(lab == cid, e) if dist is None else dist.when(lab == cid, e)
    spread = {r[label]: r["s"] for r in df.filter(lab.isNotNull()).groupBy(label)
              .agg(F.avg(dist).alias("s")).collect()}
    if len(ids) < 2:
        return df.sparkSession.createDataFrame([(None,)], "davies_bouldin double")
    worst = []
    for i in ids:
        best = None
        for j in ids:
            if i == j:
                continue
            m = math.sqrt(sum((a - b) ** 2 for a, b in zip(cent[i], cent[j])))
            r = (spread[i] + spread[j]) / m if m > 0 else math.inf
            best = r if best is None else max(best, r)
        worst.append(best)
    return df.sparkSession.createDataFrame([(sum(worst) / len(worst),)], "davies_bouldin double")


def centroid_profile(df: DataFrame, label: str, cols: Sequence[str]) -> DataFrame:
    """Mean of each column per cluster, in original units."""
    return (df.filter(F.col(label).isNotNull()).groupBy(label)
            .agg(F.count(F.lit(1)).alias("rows"), *[F.avg(c).alias(c) for c in cols]))


def cluster_sizes(df: DataFrame, label: str) -> DataFrame:
    """Observations per cluster."""
    return df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("rows"))


# ------------------------------------------------------------ naming

def name_condition(profile_z: dict[int, dict], error: str = "error_rate", oil: str = "oil_level") -> dict[int, str]:
    """canonical condition names by centroid rank, not by label number:
    highest error -> Critical; of the rest, the lower oil level -> Degrading;
    every other cluster -> Healthy."""
    ids = sorted(profile_z)
    crit = max(ids, key=lambda c: (profile_z[c][error], -c))
    rest = [c for c in ids if c != crit]
    names = {crit: "Critical"}
    if rest:
        deg = min(rest, key=lambda c: (profile_z[c][oil], c))
        names[deg] = "Degrading"
        for c in rest:
            names.setdefault(c, "Healthy")
    return names


def name_shift_clusters(profile: dict[int, dict], units: str = "units_produced") -> dict[int, str]:
    """The cluster with the higher mean output is 'Higher Efficiency'."""
    ids = sorted(profile, key=lambda c: (-profile[c][units], c))
    return {c: ("Higher Efficiency" if i == 0 else "Lower Efficiency") for i, c in enumerate(ids)}


def names_frame(df: DataFrame, label: str, names: dict[int, str], name_col: str) -> DataFrame:
    m = F.create_map(*[v for k, n in sorted(names.items()) for v in (F.lit(k), F.lit(n))])
    return df.withColumn(name_col, m[F.col(label)])


# --------------------------------------------------------- Spark ML fits

def assemble(df: DataFrame, cols: Sequence[str], out: str = "features") -> DataFrame:
    from pyspark.ml.feature import VectorAssembler
    return VectorAssembler(inputCols=list(cols), outputCol=out, handleInvalid="error").transform(df)


#: Rounds a Spark ML fit may take; ``fit_kmeans`` raises when a fit still moves after them.
MAX_ROUNDS = 10_000


def fit_kmeans(vec: DataFrame, k: int, seed: int, features: str = "features"):
    """Spark ML K-Means until its centres rest (Spark's own default stops after 20 rounds)."""
    from pyspark.ml.clustering import KMeans
    model = KMeans(k=k, seed=int(seed), featuresCol=features, maxIter=MAX_ROUNDS, tol=1e-9).fit(vec)
    if model.summary.numIter >= MAX_ROUNDS:
        raise RuntimeError(f"K-Means (k={k}, seed={seed}) had not converged after {MAX_ROUNDS} rounds")
    return model


def inertia(df: DataFrame, cols: Sequence[str], centers: Centroids) -> float:
    """within-cluster sum of squares of the nearest-centre assignment."""
    least = F.array_min(F.array(*[sq_dist(cols, c) for c in centers if c is not None]))
    return df.agg(F.coalesce(F.sum(least), F.lit(0.0)).alias("s")).first()["s"]


def pca2(vec: DataFrame, features: str = "features", k: int = 2):
    """F8: PCA of (centred) z-scores with the sign of every component fixed so
    that its largest-magnitude loading is positive."""
    from pyspark.ml.feature import PCA
    model = PCA(k=k, inputCol=features, outputCol="_pca").fit(vec)
    pc = model.pc.toArray()
    signs = []
    for j in range(k):
        col = pc[:, j]
        i = int(abs(col).argmax())
        signs.append(1.0 if col[i] >= 0 else -1.0)
    return model, signs
