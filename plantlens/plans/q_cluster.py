"""Registered queries F1-F12, K8, Q8, B13 (machine-condition clustering)."""

from __future__ import annotations

from pyspark.sql import functions as F

from plantlens.operators import cluster as K
from plantlens.operators.profile import transpose_long
from plantlens.plans import context as ctx
from plantlens.plans.context import CONDITION_K, CONDITION_LABEL as LBL
from plantlens.plans.oracle import components_sql, inertia_sql, lloyd_sql, on_clean, restarts_sql, zscore_sql
from plantlens.plans.registry import query, rnd, union
from plantlens.schema import MACHINE_FEATURES8 as F8

Z8 = [f"{c}_z" for c in F8]
_CZ = zscore_sql("clean", F8, "cz")
_CK = _CZ + lloyd_sql("cz", Z8, CONDITION_K, "error_rate", "ck")


def on_ck(select: str, *extra: str) -> str:
    return on_clean(select, _CK, *extra)


@query("zscore", rnd(on_clean(f"SELECT {', '.join(Z8)} FROM cz", _CZ), *Z8))
def zscore(spark, sf):
    """F1/F2: population z-scores of the 8 machine features."""
    zdf, zcols = ctx.condition_z(spark, sf)
    return zdf.select(*zcols)


@query("kmeans_lloyd5", rnd(on_ck(f"""SELECT lbl AS {LBL}, count(*) AS "rows", {', '.join(f'avg({z}) AS {z}' for z in Z8)}
FROM ck GROUP BY lbl"""), *Z8))
def kmeans_lloyd5(spark, sf):
    """K8: deterministic Lloyd K-Means (k=3, run to rest) on the z-scores:
    cluster sizes and centroids in z units."""
    lab, zcols = ctx.condition_labels(spark, sf)
    return K.centroid_profile(lab, LBL, zcols)


@query("centroid_profile", rnd(on_ck(f"""SELECT lbl AS {LBL}, count(*) AS "rows", {', '.join(f'avg({c}) AS {c}' for c in F8)}
FROM ck GROUP BY lbl"""), *F8))
def centroid_profile(spark, sf):
    """mean of the 8 features per condition cluster (original units)."""
    lab, _ = ctx.condition_labels(spark, sf)
    return K.centroid_profile(lab, LBL, F8)


@query("cluster_sizes", on_ck(f'SELECT lbl AS {LBL}, count(*) AS "rows" FROM ck GROUP BY lbl'))
def cluster_sizes(spark, sf):
    """observations per condition cluster."""
    lab, _ = ctx.condition_labels(spark, sf)
    return K.cluster_sizes(lab, LBL)


@query("cluster_slice", rnd(on_ck(f"""SELECT strftime("timestamp", '%Y-%m-%d %H:%M:%S') AS "timestamp", machine_id,
  lbl AS {LBL}, {', '.join(F8)} FROM ck"""), *F8))
def cluster_slice(spark, sf):
    """the observations of every condition cluster."""
    lab, _ = ctx.condition_labels(spark, sf)
    return (lab.select(F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), "machine_id", LBL, *F8))


_NAMES = f"""SELECT {LBL}, CASE WHEN {LBL} = (SELECT lbl FROM p ORDER BY e DESC, lbl ASC LIMIT 1) THEN 'Critical'
  WHEN {LBL} = (SELECT lbl FROM p WHERE lbl <> (SELECT lbl FROM p ORDER BY e DESC, lbl ASC LIMIT 1)
                ORDER BY o ASC, lbl ASC LIMIT 1) THEN 'Degrading' ELSE 'Healthy' END AS condition,
  e AS error_rate_z, o AS oil_level_z
FROM (SELECT lbl AS {LBL}, e, o FROM p) AS q"""
_P = ",\np AS (SELECT lbl, avg(error_rate_z) AS e, avg(oil_level_z) AS o FROM ck GROUP BY lbl)"


def _condition_names(spark, sf):
    lab, zcols = ctx.condition_labels(spark, sf)
    prof = K.centroid_profile(lab, LBL, ["error_rate_z", "oil_level_z"])
    rows = {r[LBL]: {"error_rate": r["error_rate_z"], "oil_level": r["oil_level_z"]} for r in prof.collect()}
    return prof, K.name_condition(rows)


@query("condition_names", rnd(on_ck(_NAMES, _P), "error_rate_z", "oil_level_z"))
def condition_names(spark, sf):
    """canonical condition names by centroid rank (highest error ->
    Critical; lower oil of the rest -> Degrading; else Healthy)."""
    prof, names = _condition_names(spark, sf)
    return K.names_frame(prof, LBL, names, "condition").select(LBL, "condition", "error_rate_z", "oil_level_z")


@query("centroids_transposed", rnd(on_ck(union(*[
    f"""SELECT '{c}' AS measure, {', '.join(f'avg({c}) FILTER (WHERE lbl = {j}) AS {LBL}_{j}'
                                         for j in range(CONDITION_K))} FROM ck""" for c in F8])),
    *[f"{LBL}_{j}" for j in range(CONDITION_K)]))
def centroids_transposed(spark, sf):
    """The centroid profile turned sideways (one row per feature)."""
    lab, _ = ctx.condition_labels(spark, sf)
    prof = K.centroid_profile(lab, LBL, F8).drop("rows")
    return transpose_long(prof, LBL, F8)


@query("defect_rate_by_condition", rnd(on_ck(f"""SELECT lbl AS {LBL}, avg(defect_count) AS avg_defect_count,
  count(*) AS "rows" FROM ck WHERE lbl IS NOT NULL GROUP BY lbl"""), "avg_defect_count"))
def defect_rate_by_condition(spark, sf):
    """Q8: mean defect count per condition cluster."""
    lab, _ = ctx.condition_labels(spark, sf)
    return lab.filter(F.col(LBL).isNotNull()).groupBy(LBL).agg(F.avg("defect_count").alias("avg_defect_count"), F.count(F.lit(1)).alias("rows"))


def _silhouette_sql(src: str, zcols, k: int, p: str = "sil") -> str:
    sq = " + ".join(f"{z} * {z}" for z in zcols)
    stats = ", ".join(
        f"count(*) FILTER (WHERE lbl = {j}) AS n{j}, sum({sq}) FILTER (WHERE lbl = {j}) AS y{j}, "
        + ", ".join(f"sum({z}) FILTER (WHERE lbl = {j}) AS s{j}_{i}" for i, z in enumerate(zcols))
        for j in range(k))
    dists = ", ".join(
        f"({sq}) + y{j} / nullif(n{j}, 0) - 2.0E0 * ({' + '.join(f'{z} * s{j}_{i}' for i, z in enumerate(zcols))}) / nullif(n{j}, 0) AS d{j}"
        for j in range(k))
    a = "CASE " + " ".join(f"WHEN lbl = {j} THEN d{j} * n{j} / nullif(n{j} - 1, 0)" for j in range(k)) + " END"
    b = "list_min([" + ", ".join(f"CASE WHEN lbl <> {j} THEN d{j} END" for j in range(k)) + "])"
    own = "CASE " + " ".join(f"WHEN lbl = {j} THEN n{j}" for j in range(k)) + " END"
    return f""",
{p}_st AS (SELECT {stats} FROM {src}),
{p}_d AS (SELECT lbl, {dists}, {p}_st.* FROM {src} CROSS JOIN {p}_st),
{p}_ab AS (SELECT {a} AS a, {b} AS b, {own} AS n_own FROM {p}_d)"""


_SIL = "SELECT avg(CASE WHEN n_own <= 1 OR greatest(a, b) = 0 THEN 0.0E0 ELSE (b - a) / greatest(a, b) END) AS silhouette FROM sil_ab"


@query("silhouette_sq", rnd(on_ck(_SIL, _silhouette_sql("ck", Z8, CONDITION_K)), "silhouette"))
def silhouette_sq(spark, sf):
    """squared-Euclidean mean silhouette of the K8 condition clusters (O(n k))."""
    lab, zcols = ctx.condition_labels(spark, sf)
    return K.silhouette_sq(lab, zcols, LBL)


def _db_sql(src: str, zcols, k: int, p: str = "db") -> str:
    cents = ", ".join(f"avg({z}) AS m{i}" for i, z in enumerate(zcols))
    dist = " + ".join(f"({z} - c.m{i}) * ({z} - c.m{i})" for i, z in enumerate(zcols))
    mdist = " + ".join(f"(a.m{i} - b.m{i}) * (a.m{i} - b.m{i})" for i in range(len(zcols)))
    return f""",
{p}_c AS (SELECT lbl, {cents} FROM {src} GROUP BY lbl),
{p}_s AS (SELECT s.lbl, avg(sqrt({dist})) AS sp FROM {src} AS s JOIN {p}_c AS c ON c.lbl = s.lbl GROUP BY s.lbl),
{p}_r AS (SELECT a.lbl, max((sa.sp + sb.sp) / sqrt({mdist})) AS r FROM {p}_c a JOIN {p}_c b ON a.lbl <> b.lbl
         JOIN {p}_s sa ON sa.lbl = a.lbl JOIN {p}_s sb ON sb.lbl = b.lbl GROUP BY a.lbl)"""


def k_selection_sql(src: str, zcols, ks, init_col: str, indices, rounds: int) -> tuple[str, str]:
    """(CTEs, SELECT) of k, inertia, silhouette and Davies-Bouldin of the converged K8 fits."""
    ctes, rows = "", []
    for k in ks:
        n = f"k{k}"
        ctes += lloyd_sql(src, zcols, k, init_col, n, rounds)
        sil = db = "CAST(NULL AS DOUBLE)"
        if k in indices:
            ctes += _silhouette_sql(n, zcols, k, f"{n}_sil") + _db_sql(n, zcols, k, f"{n}_db")
            sil, db = f"({_SIL.replace('sil_ab', f'{n}_sil_ab')})", f"(SELECT avg(r) FROM {n}_db_r)"
        rows.append(f"SELECT CAST({k} AS INTEGER) AS k, {inertia_sql(f'{src}', zcols, k, f'{n}_c')} AS inertia, "
                    f"{sil} AS silhouette, {db} AS davies_bouldin")
    return ctes, union(*rows)


@query("davies_bouldin", rnd(on_ck("SELECT avg(r) AS davies_bouldin FROM db_r", _db_sql("ck", Z8, CONDITION_K)),
                             "davies_bouldin"))
def davies_bouldin(spark, sf):
    """Davies-Bouldin index of the K8 condition clusters."""
    lab, zcols = ctx.condition_labels(spark, sf)
    return K.davies_bouldin(lab, zcols, LBL)


# ------------------------------------------------------ number of clusters

@query("condition_inertia", rnd(on_ck(f"""SELECT CAST(1 AS INTEGER) AS k, sum({' + '.join(f'{z} * {z}' for z in Z8)}) AS inertia FROM cz
UNION ALL SELECT CAST({CONDITION_K} AS INTEGER), {inertia_sql('cz', Z8, CONDITION_K, 'ck_c')}"""), "inertia"))
def condition_inertia(spark, sf):
    """within-cluster sum of squares of one cluster (around the mean, 0 in z units) and
    of the K8 condition clusters."""
    zdf, zcols = ctx.condition_z(spark, sf)
    centers = ctx.condition_centers(spark, sf)
    rows = [(1, K.inertia(zdf, zcols, [[0.0] * len(zcols)])), (CONDITION_K, K.inertia(zdf, zcols, centers))]
    return spark.createDataFrame(rows, "k int, inertia double")


_PCA = on_clean(f"""SELECT {' + '.join(f'{z} * a{i}' for i, z in enumerate(Z8))} AS PCA1,
  {' + '.join(f'{z} * b{i}' for i, z in enumerate(Z8))} AS PCA2, lbl AS {LBL} FROM ck CROSS JOIN pc""",
                _CK, components_sql("cz", Z8, "pc"))


@query("pca_scores", rnd(_PCA, "PCA1", "PCA2"))
def pca_scores(spark, sf):
    """F8: first two principal components of the z-scores with the K8 label."""
    lab, zcols = ctx.condition_labels(spark, sf)
    vec = K.assemble(lab.select(*zcols, LBL), zcols)
    model, signs = K.pca2(vec)
    from pyspark.ml.functions import vector_to_array
    arr = vector_to_array(F.col("_pca"))
    return model.transform(vec).select((arr[0] * signs[0]).alias("PCA1"), (arr[1] * signs[1]).alias("PCA2"), LBL)


# --------------------------------------- fits that share their scans

#: Rounds of the oracle's fits; on the test tables all rest within 100.
ROUNDS = 100
_IDENT = """coalesce(strftime("timestamp", '%Y-%m-%d %H:%M:%S'), ''), coalesce(machine_id, ''), coalesce(operator_id, ''), coalesce(product_type, '')"""
_BEST = _CZ + restarts_sql("cz", Z8, _IDENT, CONDITION_K, ctx.RESTARTS, "mb")
_PROFILE = ", ".join(f"avg({c}) AS {c}" for c in F8)


@query("machine_condition", rnd(on_clean(f"""SELECT CASE WHEN lbl = (SELECT lbl FROM p ORDER BY e DESC, lbl LIMIT 1) THEN 'Critical'
  WHEN lbl = (SELECT lbl FROM p WHERE lbl <> (SELECT lbl FROM p ORDER BY e DESC, lbl LIMIT 1) ORDER BY o, lbl LIMIT 1) THEN 'Degrading'
  ELSE 'Healthy' END AS condition, "rows", {', '.join(F8)}, avg_defect_count FROM p""", _BEST, f""",
p AS (SELECT lbl, count(*) AS "rows", avg(error_rate_z) AS e, avg(oil_level_z) AS o, {_PROFILE}, avg(defect_count) AS avg_defect_count
      FROM mb GROUP BY lbl)"""), *F8, "avg_defect_count"))
def machine_condition(spark, sf):
    """K-Means k=3 run to rest, the best of 10 restarts seeded by squared distance (they
    share every scan), canonical names and the cluster profile in original units."""
    zdf, zcols = ctx.condition_z(spark, sf)
    lab = zdf.withColumn(LBL, K.nearest(zcols, ctx.condition_best(spark, sf)))
    prof = K.centroid_profile(lab, LBL, F8 + zcols + ["defect_count"])
    rows = {r[LBL]: {"error_rate": r["error_rate_z"], "oil_level": r["oil_level_z"]} for r in prof.collect()}
    out = K.names_frame(prof, LBL, K.name_condition(rows), "condition")
    return out.select("condition", "rows", *F8, F.col("defect_count").alias("avg_defect_count"))


_CURVE, _CURVE_ROWS = k_selection_sql("cz", Z8, range(1, 11), "error_rate", (), ROUNDS)
_PICK, _PICK_ROWS = k_selection_sql("cz", Z8, range(2, 10), "error_rate", range(2, 10), ROUNDS)


@query("inertia_curve", rnd(on_clean(f"SELECT k, inertia FROM ({_CURVE_ROWS}) AS q", _CZ, _CURVE), "inertia", digits=4), digits=4)
def inertia_curve(spark, sf):
    """elbow curve, K8 run to rest for k = 1..10 on the machine z-scores: one scan a round
    for all k, two scans for the cost."""
    found = ctx.k_indices(spark, sf, "condition", ctx.condition_points, range(1, 11), "error_rate")
    return spark.createDataFrame([(k, float(v[0])) for k, v in found.items()], "k int, inertia double")


@query("condition_k_selection", rnd(on_clean(_PICK_ROWS, _CZ, _PICK), "inertia", "silhouette", "davies_bouldin", digits=4), digits=4)
def condition_k_selection(spark, sf):
    """For k = 2..9, K8 run to rest on the machine z-scores with its inertia,
    squared-Euclidean silhouette and Davies-Bouldin index; all k share their scans."""
    found = ctx.k_indices(spark, sf, "condition", ctx.condition_points, range(1, 11), "error_rate")
    return spark.createDataFrame([(k, *map(float, found[k])) for k in range(2, 10)],
                                 "k int, inertia double, silhouette double, davies_bouldin double")
