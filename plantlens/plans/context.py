"""Inputs of the registered queries: the raw, imputed and cleaned log.

Layout (medallion style, all in the cluster's shared ``spark.checkpoint.dir``):

* bronze: the raw plant log derived from the driver's tables, written once
  as parquet (the three-way join runs once, not once per report);
* silver: the cleaned log (means imputed, 14 sensors clipped to their IQR
  fences), a projection of bronze with the scalars as literals: a query computes the columns
  that it reads, and no second copy of the log is written;
* the scalars of the clean step (column means, quartile fences), the model
  fits (z-score stats, cluster centres, forests) and derived tables (labelled
  shifts, the enriched log, drained streams).

All of these belong to one ``Version`` of the input tables, keyed by what the
input files are (path, size, modification time, on any file system).  When the
files change, the next query drops the version, with its fits and its scratch
tables; nothing of an old version can be mixed in.  Bronze outlives it where it can:
it is kept by generations of lineitem files (``generations``), so that appended files
alone are read and joined, and the column means come from merged statistics.

Reports read these tables (column-pruned parquet scans) and stay lazy.  A
written table also cuts lineage: a lost executor re-reads parquet instead of
recomputing joins.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plantlens.operators.clean import Cleaned, impute_mean, iqr_bounds, winsorize
from plantlens.plans.generations import Generations, files
from plantlens.schema import CLIP14, EFF4, MACHINE_FEATURES8
from plantlens.session import drop_scratch, scratch_path

CONDITION_K, SHIFT_K = 3, 2
CONDITION_LABEL, SHIFT_LABEL = "cluster_efficiency_machine", "shift_efficiency_cluster"
#: The tables that queries of this library read.
INPUTS = ("lineitem", "orders", "part", "events")


@dataclass
class Version:
    """What was built from one state of the input files."""

    spark: SparkSession
    sf: str
    signature: tuple
    paths: dict[str, str] = field(default_factory=dict)
    fits: dict[str, object] = field(default_factory=dict)
    bronze: Generations | None = None

    def fit(self, name: str, build: Callable[[], object]):
        """A fitted value, computed once per version."""
        if name not in self.fits:
            self.fits[name] = build()
        return self.fits[name]

    def path(self, name: str, build: Callable[[str], None]) -> str:
        """A scratch location that ``build(path)`` fills, once per version."""
        if name not in self.paths:
            path = scratch_path(self.spark, name)
            build(path)
            self.paths[name] = path
        return self.paths[name]

    def table(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """A derived table, written once per version and read from the shared folder."""
        return self.spark.read.parquet(self.path(name, lambda path: build().write.mode("overwrite").parquet(path)))

    def drop(self, *keep: str) -> None:
        """Forget the fits and remove the scratch tables, except the named ones."""
        self.fits = {k: v for k, v in self.fits.items() if k in keep}
        for name in [n for n in self.paths if n not in keep]:
            drop_scratch(self.spark, self.paths.pop(name))


_VERSIONS: dict[tuple, Version] = {}


def signature(spark: SparkSession, sf: str) -> tuple:
    """What the input files are now: one small listing job, on any file system."""
    found = []
    conf, path = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for t in INPUTS:
        p = path(f"{sf}/{t}.parquet")
        if not p.getFileSystem(conf).exists(p):
            continue
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(p.toString())
        found.append(files.select(F.lit(t).alias("t"), F.xxhash64("path", "length", "modificationTime").alias("h")))
    if not found:
        return ()
    rows = found[0]
    for f in found[1:]:
        rows = rows.unionAll(f)
    got = rows.groupBy("t").agg(F.count(F.lit(1)).alias("n"), F.bit_xor("h").alias("h")).collect()
    return tuple(sorted((r["t"], r["n"], r["h"]) for r in got))


def refresh(spark: SparkSession, sf: str) -> Version:
    """The version of the input files as they are now; an outdated one is removed."""
    key = (spark.sparkContext.applicationId, sf.rstrip("/"))
    now = signature(spark, key[1])
    old = _VERSIONS.get(key)
    if old is None or old.signature != now:
        fresh = Version(spark, key[1], now)
        if old is not None:
            old.drop()
            if old.bronze is not None:
                if old.bronze.keep == _others(now):
                    fresh.bronze = old.bronze
                else:
                    old.bronze.drop()
        _VERSIONS[key] = fresh
    return _VERSIONS[key]


def _others(signature: tuple) -> tuple:
    """What a signature says of the tables that every generation of the log is joined with."""
    return tuple(s for s in signature if s[0] in ("orders", "part"))


def version(spark: SparkSession, sf: str) -> Version:
    """The version a running query works on (``refresh`` at its start checks the files)."""
    return _VERSIONS.get((spark.sparkContext.applicationId, sf.rstrip("/"))) or refresh(spark, sf)


#: What ``clear_models`` keeps: the raw log and the scalars of the clean step.
_BUILD = ("bronze", "means", "bounds")


def clear_models() -> None:
    """Forget fits and derived tables; keep the raw and the cleaned log."""
    for v in _VERSIONS.values():
        v.drop(*_BUILD)


def clear_memo() -> None:
    """Forget everything, and remove the tables."""
    for v in _VERSIONS.values():
        v.drop()
        if v.bronze is not None:
            v.bronze.drop()
    _VERSIONS.clear()


def generations(spark: SparkSession, sf: str) -> Generations:
    """The raw log's generations, brought up to date once per version."""
    v = version(spark, sf)
    if v.bronze is None:
        v.bronze = Generations(spark, v.sf, _others(v.signature))
    v.fit("bronze", lambda: v.bronze.refresh(files(spark, f"{v.sf}/lineitem.parquet")) or True)
    return v.bronze


def plant(spark: SparkSession, sf: str) -> DataFrame:
    """The raw log (bronze)."""
    return generations(spark, sf).log()


def means(spark: SparkSession, sf: str) -> dict:
    """Mean and NULL count of every numeric column of the raw log, merged from its generations."""
    return version(spark, sf).fit("means", lambda: generations(spark, sf).means())


def imputed(spark: SparkSession, sf: str) -> DataFrame:
    """The raw log with NULL sensors mean-filled (a projection of bronze)."""
    return impute_mean(plant(spark, sf), means=means(spark, sf))


def bounds(spark: SparkSession, sf: str) -> dict:
    """The IQR fences of the clipped columns, after imputation."""
    return version(spark, sf).fit("bounds", lambda: iqr_bounds(imputed(spark, sf), CLIP14))


def clean(spark: SparkSession, sf: str) -> DataFrame:
    """The cleaned log (silver; a projection of bronze)."""
    return winsorize(imputed(spark, sf), CLIP14, bounds(spark, sf))


def cleaned(spark: SparkSession, sf: str) -> Cleaned:
    return Cleaned(clean(spark, sf), imputed(spark, sf), means(spark, sf), bounds(spark, sf))


# ------------------------------------------------------------- clusterings

def _z(stats: dict) -> dict:
    return {f"{c}_z": ((F.col(c) - F.lit(m)) / F.lit(s)) if s else F.lit(0.0) for c, (m, s) in stats.items()}


def condition_stats(spark: SparkSession, sf: str) -> dict:
    """Mean and population std of the 8 machine features."""
    from plantlens.operators.cluster import standardize
    return version(spark, sf).fit("condition-z", lambda: standardize(clean(spark, sf), MACHINE_FEATURES8)[1])


def condition_z(spark: SparkSession, sf: str):
    """The cleaned log with z-scores (suffix _z) of the 8 machine features."""
    stats = condition_stats(spark, sf)
    return clean(spark, sf).withColumns(_z(stats)), [f"{c}_z" for c in MACHINE_FEATURES8]


def condition_points(spark: SparkSession, sf: str):
    """What fits on the machine features scan: their z-scores, ``error_rate`` (K8 starts from its
    bands) and a hash of the row (``row_hash``; restarts draw by it).  Written once."""
    from plantlens.operators.shared_kmeans import row_hash
    zdf, zcols = condition_z(spark, sf)
    ident = [F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"), *map(F.col, ("machine_id", "operator_id", "product_type"))]
    return version(spark, sf).table("condition-points", lambda: zdf.select(
        *zcols, "error_rate", row_hash(*ident).alias("row_hash"))), zcols


def condition_centers(spark: SparkSession, sf: str) -> list:
    """Centres of K8, run to rest on the machine features."""
    return condition_curve(spark, sf, [CONDITION_K])[CONDITION_K]


def condition_curve(spark: SparkSession, sf: str, ks) -> dict[int, list]:
    """Centres of K8 for several k; those not fitted yet share their scans."""
    return _curve(spark, sf, "condition", condition_points, ks, "error_rate")


def _curve(spark: SparkSession, sf: str, name: str, points, ks, init_col: str) -> dict[int, list]:
    from plantlens.operators.shared_kmeans import band_starts, lloyd_shared
    v = version(spark, sf)
    new = [k for k in ks if f"{name}-k{k}" not in v.fits]
    if new:
        rows, zcols = points(spark, sf)
        for k, centers in lloyd_shared(rows, zcols, band_starts(rows, zcols, new, init_col))[0].items():
            v.fits[f"{name}-k{k}"] = centers
    return {k: v.fits[f"{name}-k{k}"] for k in ks}


def k_indices(spark: SparkSession, sf: str, name: str, points, ks, init_col: str) -> dict[int, tuple]:
    """(inertia, silhouette, Davies-Bouldin) of K8 for every k of ``ks``."""
    from plantlens.operators.shared_kmeans import indices
    fits = _curve(spark, sf, name, points, ks, init_col)
    return version(spark, sf).fit(f"{name}-indices-{sorted(fits)}", lambda: indices(*points(spark, sf), fits))


#: Restarts of the seeded K-Means fits.
RESTARTS = 10


def condition_best(spark: SparkSession, sf: str) -> list:
    """the best of ``RESTARTS`` seeded fits on the machine features."""
    from plantlens.operators.shared_kmeans import best_of
    return version(spark, sf).fit("condition-best", lambda: best_of(*condition_points(spark, sf), "row_hash", CONDITION_K, RESTARTS))


def shift_best(spark: SparkSession, sf: str) -> list:
    """The best of ``RESTARTS`` seeded fits on the shift table."""
    from plantlens.operators.shared_kmeans import best_of
    return version(spark, sf).fit("shift-best", lambda: best_of(*shift_points(spark, sf), "row_hash", SHIFT_K, RESTARTS))


def condition_labels(spark: SparkSession, sf: str):
    """K8 on the machine features: the cleaned log with ``cluster_efficiency_machine``."""
    from plantlens.operators.cluster import nearest
    zdf, zcols = condition_z(spark, sf)
    return zdf.withColumn(CONDITION_LABEL, nearest(zcols, condition_centers(spark, sf))), zcols


def shift_table(spark: SparkSession, sf: str) -> DataFrame:
    """The shift-level table (G1-G4), written once: its size grows with days, not observations."""
    from plantlens.operators.shift import shift_efficiency_table
    return version(spark, sf).table("shifts", lambda: shift_efficiency_table(clean(spark, sf)))


def shift_stats(spark: SparkSession, sf: str) -> dict:
    from plantlens.operators.cluster import standardize
    return version(spark, sf).fit("shift-z", lambda: standardize(shift_table(spark, sf), EFF4)[1])


def shift_z(spark: SparkSession, sf: str):
    """The shift-level table with z-scored efficiency columns."""
    return shift_table(spark, sf).withColumns(_z(shift_stats(spark, sf))), [f"{c}_z" for c in EFF4]


def shift_points(spark: SparkSession, sf: str):
    """What fits on the shift table scan, like ``condition_points``."""
    from plantlens.operators.shared_kmeans import row_hash
    from plantlens.schema import SHIFT_KEYS
    zdf, zcols = shift_z(spark, sf)
    return version(spark, sf).table("shift-points", lambda: zdf.select(
        *zcols, "units_produced", row_hash(*map(F.col, SHIFT_KEYS)).alias("row_hash"))), zcols


def shift_curve(spark: SparkSession, sf: str, ks) -> dict[int, list]:
    """Centres of K8 on the shift table for several k."""
    return _curve(spark, sf, "shift", shift_points, ks, "units_produced")


def shift_labels(spark: SparkSession, sf: str):
    """K8 on the shift table, run to rest: shift rows with ``shift_efficiency_cluster``.

    The labelled table is written once after the fit, like any fitted output;
    every consumer (join-back, profile, sizes, names, mix) then reads it."""
    from plantlens.operators.cluster import nearest
    zdf, zcols = shift_z(spark, sf)

    def build() -> DataFrame:
        return zdf.withColumn(SHIFT_LABEL, nearest(zcols, shift_curve(spark, sf, [SHIFT_K])[SHIFT_K]))
    return version(spark, sf).table("shift-labels", build), zcols
