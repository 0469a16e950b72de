"""A4: the raw log kept by generations of input files, with mergeable statistics.

The lineitem files that were new at one refresh are a generation.  Its log rows are
derived and written once, and so are its statistics: per numeric column the rows,
NULLs, sum, sum of squares, least and largest value, and, from the first correlation on, for each
pair of the sensors the sums that it needs.  When files are appended, only they are read and
joined, as one more generation; means, deviations and correlations of the whole log are
merged from the small statistics tables, without a scan of the log.  When a file
changes or goes, the generations that hold it are derived again from what is left of
their files.  Another orders or part table starts afresh.

Squares and products are summed around a fixed origin (the first generation's
column means), so merging does not cancel digits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plantlens.schema import ALL_NUMERIC, LOG_SCHEMA, NUMERIC16
from plantlens.session import drop_scratch, scratch_path
from plantlens.sources.plant import plant_from_tables

#: Rows whose pair products are taken at a time.
ROWS = 8192

#: (path, length, modification time) of a file.
File = tuple[str, int, str]


def files(spark: SparkSession, path: str) -> frozenset[File]:
    """The data files of a table, as the input is now."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return frozenset()
    rows = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
            .select("path", "length", F.col("modificationTime").cast("string").alias("at")).where("length > 0").collect())
    return frozenset((r["path"], r["length"], r["at"]) for r in rows if not r["path"].rsplit("/", 1)[-1].startswith(("_", ".")))


def _pairs(cols: Sequence[str]) -> list[tuple[str, str]]:
    return [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]


def moments(df: DataFrame, cols: Sequence[str], origin: dict[str, float]) -> DataFrame:
    """One row per column: col, rows, n, s (sum of x - origin), q (sum of squares), lo, hi."""
    from plantlens.functions.stats import long_values
    cols = list(cols)
    base = F.array(*[F.lit(float(origin.get(c) or 0.0)) for c in cols])
    d = F.col("v") - base[F.col("col_idx")]
    found = long_values(df, cols).groupBy("col_idx").agg(
        F.count(F.lit(1)).alias("rows"), F.count("v").alias("n"), F.sum(d).alias("s"), F.sum(d * d).alias("q"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    names = F.array(*[F.lit(c) for c in cols])
    return found.select(names[F.col("col_idx")].alias("col"), "rows", "n", "s", "q", "lo", "hi")


def _pair_products(x: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The sums of every ordered pair of columns, (6, d, d): rows that have both, and over them the sums of
    the first and the second, of their squares and of their products.  ``m``: where ``x`` has a
    value.  Values whose square is not a plain number count in their own pairs only."""
    wild = (m & ~(np.abs(x) < 1e150)).any(axis=1)
    v, w = np.where(m, x, 0.0)[~wild], m[~wild].astype(np.float64)
    n, s, q, p = w.T @ w, v.T @ w, (v * v).T @ w, v.T @ v
    out = np.stack([n, s, s.T, q, q.T, p])
    if wild.any():
        v, w = x[wild], m[wild]
        with np.errstate(all="ignore"):
            for a in range(x.shape[1]):
                both = w & w[:, a, None]
                y, z = np.where(both, v[:, a, None], 0.0), np.where(both, v, 0.0)
                out[:, a] += np.stack([both.sum(axis=0), y.sum(axis=0), z.sum(axis=0), (y * y).sum(axis=0), (z * z).sum(axis=0), (y * z).sum(axis=0)])
    return out


def comoments(df: DataFrame, cols: Sequence[str], origin: dict[str, float]) -> DataFrame:
    """One row per pair of columns, over rows that have both: a, b, n, sa, sb, qa, qb, ab.

    The sums of all pairs are matrix products of a batch's values and of where they are not NULL:
    a scan of the rows, and one row per pair and task to the shuffle (not a row per pair and
    row, which is 120 rows of each)."""
    cols = list(cols)
    pairs, d = _pairs(cols), len(cols)
    at = tuple(np.array([cols.index(p[s]) for p in pairs], np.int64) for s in (0, 1))
    values = df.select(*[(F.col(c).cast("double") - F.lit(float(origin.get(c) or 0.0))).alias(c) for c in cols])
    names = ["sa", "sb", "qa", "qb", "ab"]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((6, d, d))
        for batch in batches:
            for part in (batch.slice(i, ROWS) for i in range(0, batch.num_rows, ROWS)):
                m = np.stack([c.is_valid().to_numpy(zero_copy_only=False) for c in part.columns], axis=1)
                total += _pair_products(np.stack([c.to_numpy(zero_copy_only=False) for c in part.columns], axis=1).astype(np.float64, copy=False), m)
        n, *sums = total[:, at[0], at[1]]
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(n[some].astype(np.int64))] + [pa.array(v[some]) for v in sums], names=["k", "n", *names])

    sums = (values.mapInArrow(partial, ", ".join(["k int", "n long", *[f"{c} double" for c in names]]))
            .groupBy("k").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in names]))
    first, second = (F.array(*[F.lit(p[s]) for p in pairs]) for s in (0, 1))
    return sums.select(first[F.col("k")].alias("a"), second[F.col("k")].alias("b"), "n", *names)


@dataclass
class Generation:
    files: frozenset[File]
    log: str
    stats: str
    #: The co-moments are written.
    paired: bool = False


@dataclass
class Generations:
    """The written generations of one input directory; ``keep`` says what the other tables are."""

    spark: SparkSession
    sf: str
    keep: tuple
    parts: list[Generation] = field(default_factory=list)
    origin: dict[str, float] = field(default_factory=dict)
    #: Files read by refreshes so far (for tests and reports).
    files_read: int = 0

    def refresh(self, now: frozenset[File]) -> None:
        """Derive the generations of new files, and anew those that lost a file."""
        new = set(now).difference(*(g.files for g in self.parts))
        for g in [g for g in self.parts if not g.files <= now]:
            new |= g.files & now
            self._remove(g)
        if new or not self.parts:
            self._append(frozenset(new))

    def _append(self, new: frozenset[File]) -> None:
        read = self.spark.read
        lineitem = read.parquet(*sorted(f[0] for f in new)) if new else read.parquet(f"{self.sf}/lineitem.parquet")
        log, stats = (scratch_path(self.spark, f"log-{kind}") for kind in ("rows", "stats"))
        plant_from_tables(lineitem, read.parquet(f"{self.sf}/orders.parquet"), read.parquet(f"{self.sf}/part.parquet")).write.parquet(log)
        rows = self._log([log])
        if not self.origin:
            first = {r["col"]: r for r in moments(rows, ALL_NUMERIC, {}).collect()}
            self.origin = {c: r["s"] / r["n"] for c, r in first.items() if r["n"] and math.isfinite(r["s"])}
        moments(rows, ALL_NUMERIC, self.origin).write.parquet(f"{stats}/moments")
        self.parts.append(Generation(new, log, stats))
        self.files_read += len(new)

    def _remove(self, g: Generation) -> None:
        self.parts.remove(g)
        for path in (g.log, g.stats):
            drop_scratch(self.spark, path)

    def drop(self) -> None:
        for g in list(self.parts):
            self._remove(g)

    def _log(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(LOG_SCHEMA).parquet(*paths)

    def log(self) -> DataFrame:
        """The raw log: all generations' rows."""
        return self._log([g.log for g in self.parts])

    def _merged(self, kind: str, keys: list[str], least: Sequence[str] = (), most: Sequence[str] = ()) -> DataFrame:
        df = self.spark.read.parquet(*[f"{g.stats}/{kind}" for g in self.parts])
        sums = [c for c in df.columns if c not in (*keys, *least, *most)]
        return df.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums], *[F.min(c).alias(c) for c in least], *[F.max(c).alias(c) for c in most])

    def column_moments(self) -> DataFrame:
        """Per numeric column of the log: rows, n, mean, std (sample), least, most; from the
        generations' statistics alone."""
        base = F.create_map(*[x for c in ALL_NUMERIC for x in (F.lit(c), F.lit(float(self.origin.get(c, 0.0))))])
        s, q, n = F.col("s"), F.col("q"), F.col("n")
        var = F.greatest(q - F.try_divide(s * s, n), F.lit(0.0))
        return self._merged("moments", ["col"], ["lo"], ["hi"]).select(
            "col", "rows", "n", (base[F.col("col")] + F.try_divide(s, F.nullif(n, F.lit(0)))).alias("mean"),
            F.when(n > 1, F.sqrt(F.try_divide(var, n - 1))).alias("std"), F.col("lo").alias("least"), F.col("hi").alias("most"))

    def correlations(self) -> DataFrame:
        """Pearson correlation of every pair of sensors: a, b, n, r; from the statistics alone, once
        the co-moments of every generation are written (no other query needs them)."""
        for g in self.parts:
            if not g.paired:
                comoments(self._log([g.log]), NUMERIC16, self.origin).write.mode("overwrite").parquet(f"{g.stats}/comoments")
                g.paired = True
        n = F.col("n")
        cov = F.col("ab") - F.try_divide(F.col("sa") * F.col("sb"), n)
        va, vb = (F.greatest(F.col(f"q{c}") - F.try_divide(F.col(f"s{c}") * F.col(f"s{c}"), n), F.lit(0.0)) for c in "ab")
        return self._merged("comoments", ["a", "b"]).select("a", "b", "n", F.try_divide(cov, F.nullif(F.sqrt(va) * F.sqrt(vb), F.lit(0.0))).alias("r"))

    def means(self) -> dict[str, tuple]:
        """Mean and NULL count of every numeric column."""
        got = {r["col"]: r for r in self.column_moments().collect()}
        return {c: (got[c]["mean"], got[c]["rows"] - got[c]["n"]) if c in got else (None, 0) for c in ALL_NUMERIC}
