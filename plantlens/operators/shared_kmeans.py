"""Many K-Means fits of one table that share every scan.

Fits for several numbers of clusters, or several restarts of one, differ only in a
few literal centres.  So all that still move take their round together: one scan
labels each row under every fit and adds up, per (fit, label), the rows and their sums.
A round costs one scan however many fits there are, and the rows that reach the
driver are as many as there are centres.  A fit whose clusters keep their numbers of rows may be at
rest: one more scan counts the rows that changed their label under it.

* ``band_starts``: the deterministic start of K8 for several k, one scan.
* ``seeded_starts``: restarts with squared-distance seeding in as many scans as
  there are centres.  Each row has an exponential key -ln(u) / D^2 per restart, u hashed from
  the row and the restart; the row with the smallest key is a draw with weight
  D^2.  All restarts draw in the same scan, without a cost pass before it.
* ``lloyd_shared``: rounds until no fit's labels change; fits at rest drop out.
* ``indices``: inertia, silhouette and Davies-Bouldin of all fits in two scans.

The arithmetic of a scan is numpy on Arrow batches: labels under all fits are one
matrix product (``nearest_labels``), and new centres every round are data, not new code to
compile.  Sums of a partition leave it as one row per (fit, label).  Rows with a
NULL in the columns are left out.  For the rounds, rows are packed once (``packed``): their values are
written in blocks to the shared folder, and a scan moves blocks, not single values.  Executors keep no
rows in memory between the rounds.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Hashable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantlens.operators.cluster import Centroids
from plantlens.session import drop_scratch, scratch_path

#: Rounding of a squared distance that comes from a matrix product, as a share of the squared norms
#: (a hundred times the bound for ten columns); nearer centres are told apart by their differences.
SLACK = 1e-12

#: A prime: row hashes are spread over 1 .. P - 1, and P * P fits a long.
P = 2147483647

#: Rows of a block of ``packed``, and rows that are labelled at a time.  Spark sends 10,000 blocks to a
#: task's Python at a time, and holds them in several places: 5 MB of eight columns.
BLOCK, ROWS = 8, 8192
#: Bytes of a row group of blocks: a reader holds it, on the heap and beside it.
GROUP = 8 << 20
#: Labels up to which sums by label are a matrix product.
FEW_LABELS = 32

Fits = dict[Hashable, Centroids]


def _complete(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.dropna("any", subset=list(cols))


def _matrix(batch: pa.RecordBatch, d: int) -> np.ndarray:
    return np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(d)], axis=1).astype(np.float64, copy=False)


def packed(df: DataFrame, cols: Sequence[str], path: str | None = None) -> DataFrame:
    """The complete rows' values, ``BLOCK`` rows to a binary value; written once, and read by every scan."""
    cols = list(cols)
    d = len(cols)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch, d)
            yield pa.RecordBatch.from_arrays([pa.array([x[i:i + BLOCK].tobytes() for i in range(0, len(x), BLOCK)], pa.binary())], names=["block"])
    path = path or scratch_path(df.sparkSession, "kmeans-blocks")
    _complete(df.select(*cols), cols).mapInArrow(pack, "block binary").write.option("parquet.block.size", GROUP).parquet(path)
    return df.sparkSession.read.schema("block binary").parquet(path)


def _unpacked(batch: pa.RecordBatch, d: int) -> Iterator[np.ndarray]:
    """The rows of a batch of blocks, ``ROWS`` at a time: the blocks lie one after the other in it."""
    blocks = batch.column(0)
    _, offsets, values = blocks.buffers()
    at = np.frombuffer(offsets, np.int32)[blocks.offset:blocks.offset + len(blocks) + 1] if len(blocks) else (0, 0)
    if at[-1] > at[0]:
        x = np.frombuffer(values, np.float64, (int(at[-1]) - int(at[0])) // 8, int(at[0])).reshape(-1, d)
        yield from (x[i:i + ROWS] for i in range(0, len(x), ROWS))


def _sq_dists(x: np.ndarray, centers: Centroids) -> np.ndarray:
    """Squared distances (rows by centres), summed left to right over the columns; infinite
    to a missing centre."""
    out = np.zeros((len(x), len(centers)))
    for c in range(x.shape[1]):
        d = x[:, c, None] - np.array([math.inf if m is None else m[c] for m in centers])[None, :]
        out += d * d
    return out


def nearest_labels(x: np.ndarray, fits: Sequence[Centroids]) -> list[np.ndarray]:
    """Per fit the index of the nearest centre, the lowest of equals: by |c|^2 - 2 x.c, one matrix
    product for the centres of all fits; rows whose two least are too close for its rounding, by
    their squared distances."""
    known = [np.array([j for j, m in enumerate(centers) if m is not None], np.int64) for centers in fits]
    if not any(map(len, known)):
        return [np.zeros(len(x), np.int64) for _ in fits]
    c = np.array([centers[j] for centers, own in zip(fits, known) for j in own], np.float64)
    norm, found, at = (c * c).sum(axis=1), [], 0
    with np.errstate(invalid="ignore", over="ignore"):
        g = np.hstack([-2.0 * c, norm[:, None]]) @ np.vstack([x.T, np.ones(len(x))])
        square, other = np.einsum("ij,ij->i", x, x), np.empty(len(x))
        for centers, own in zip(fits, known):
            if not len(own):
                found.append(np.zeros(len(x), np.int64))
                continue
            h, most = g[at:at + len(own)], norm[at:at + len(own)].max()
            at += len(own)
            best, second, least = h[0].copy(), np.full(len(x), math.inf), np.zeros(len(x), np.int8 if len(own) < 128 else np.int64)
            for j in range(1, len(own)):
                np.maximum(least, np.multiply(h[j] < best, j, dtype=least.dtype), out=least)  # the last that was less
                np.minimum(second, np.maximum(best, h[j], out=other), out=second)
                np.minimum(best, h[j], out=best)
            close = ~(second - best > SLACK * (square + most))
            lab = own.take(least.astype(np.int64, copy=False))
            if close.any():
                lab[close] = _sq_dists(x[close], centers).argmin(axis=1)
            found.append(lab)
    return found


def nearest_label(x: np.ndarray, centers: Centroids) -> np.ndarray:
    """``nearest_labels`` of one fit."""
    return nearest_labels(x, [centers])[0]


def _by_label(lab: np.ndarray, k: int, values: np.ndarray) -> np.ndarray:
    """Per label the sums of the rows of ``values``: a matrix product for few labels and plain numbers."""
    if k <= FEW_LABELS and np.isfinite(values).all():
        return (np.arange(k, dtype=np.int8)[:, None] == lab.astype(np.int8)).astype(np.float64) @ values.T
    return np.stack([np.bincount(lab, v, k) for v in values], axis=1)


def _sums(df: DataFrame, cols: Sequence[str], label: Callable[[np.ndarray], dict[int, tuple[np.ndarray, int, list]]],
          n_more: int = 0, blocks: DataFrame | None = None) -> dict[tuple[int, int], tuple]:
    """One scan (of ``blocks``, if the rows are packed): per (fit, label) the rows, the column sums, and ``n_more`` further sums.  ``label``
    gives, per fit of a batch: labels, how many there can be, and the values of the further sums."""
    cols = list(cols)
    d, rows_of = len(cols), _unpacked if blocks is not None else lambda batch, d: [_matrix(batch, d)]
    names = ["fit", "label", "n", *[f"s{k}" for k in range(d + n_more)]]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for x in (x for batch in batches for x in rows_of(batch, d)):
            columns = np.vstack([np.ones(len(x)), x.T])
            for fit, (lab, k, more) in label(x).items():
                part = _by_label(lab, k, np.vstack([columns, *more]) if more else columns)
                total[fit] = total[fit] + part if fit in total else part
        rows = [(fit, j, int(r[0]), *r[1:].tolist()) for fit, t in total.items() for j, r in enumerate(t) if r[0]]
        types = [pa.int32(), pa.int32(), pa.int64()] + [pa.float64()] * (d + n_more)
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)

    schema = ", ".join(f"{n} {t}" for n, t in zip(names, ["int", "int", "long"] + ["double"] * (d + n_more)))
    got = ((_complete(df.select(*cols), cols) if blocks is None else blocks).mapInArrow(partial, schema).groupBy("fit", "label")
           .agg(*[F.sum(c).alias(c) for c in names[2:]]).collect())
    return {(r["fit"], r["label"]): tuple(r)[2:] for r in got}


# ------------------------------------------------------------------ starts

def band_starts(df: DataFrame, cols: Sequence[str], ks: Sequence[int], init_col: str) -> Fits:
    """Per k the means of k equal-width bands of ``init_col`` (one scan for all k; a band
    without rows has no centre)."""
    cols, ks = list(cols), list(ks)
    r = df.agg(F.min(init_col).alias("lo"), F.max(init_col).alias("hi")).first()
    lo, hi = r["lo"], r["hi"]
    if lo is None:
        return {k: [None] * k for k in ks}
    own = cols.index(init_col) if init_col in cols else len(cols)
    rows = df.select(*cols, F.col(init_col).cast("double").alias("_init"))

    def label(x: np.ndarray):
        v = x[:, own if own < len(cols) else -1]
        return {f: (np.zeros(len(v), np.int64) if hi == lo else
                    np.minimum(np.floor((v - lo) / (hi - lo) * float(k)), k - 1).astype(np.int64), k, []) for f, k in enumerate(ks)}

    found = _sums(rows, [*cols, "_init"], label)
    return {k: [[s / found[f, j][0] for s in found[f, j][1:1 + len(cols)]] if (f, j) in found else None for j in range(k)]
            for f, k in enumerate(ks)}


def row_hash(*key: Column) -> Column:
    """A number from 0 to P - 1 of a row's identity, the same in any engine with MD5."""
    text = F.concat_ws("|", *[F.coalesce(k.cast("string"), F.lit("")) for k in key])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") % P


def mixers(restart: int, step: int) -> tuple[int, int]:
    """Multiplier and shift that give a row's u in one draw of one restart."""
    n = 1 + 101 * restart + step
    return 1 + (n * 48271 * 40014 + 12345) % (P - 1), (n * 69621 * 16807 + 54321) % P


def seeded_starts(df: DataFrame, cols: Sequence[str], hash_col: str, k: int, restarts: int) -> Fits:
    """Per restart k rows, each drawn with a weight of its squared distance to those before it
    (the first one evenly): the smallest exponential key of one scan per draw."""
    cols = list(cols)
    d = len(cols)
    starts: Fits = {r: [] for r in range(restarts)}
    schema = ", ".join(["fit int", "key double", *[f"c{i} double" for i in range(d)]])
    for step in range(k):
        def drawn(batches: Iterator[pa.RecordBatch], step=step) -> Iterator[pa.RecordBatch]:
            best: dict[int, tuple] = {}
            for batch in batches:
                if not batch.num_rows:
                    continue
                x, h = _matrix(batch, d), batch.column(d).to_numpy(zero_copy_only=False)
                for r, centers in starts.items():
                    a, b = mixers(r, step)
                    key = -np.log(((h * a + b) % P + 1) / (P + 1))
                    if step:
                        with np.errstate(divide="ignore"):
                            key = key / _sq_dists(x, centers).min(axis=1)
                    least = np.flatnonzero(key == key.min())
                    row = min((float(key[i]), *x[i].tolist()) for i in least.tolist())
                    if math.isfinite(row[0]) and (r not in best or row < best[r]):
                        best[r] = row
            rows = [(r, *v) for r, v in best.items()]
            yield pa.RecordBatch.from_arrays([pa.array([v[0] for v in rows], pa.int32())] + [pa.array([v[i] for v in rows], pa.float64()) for i in range(1, d + 2)],
                                             names=[c.split()[0] for c in schema.split(", ")])

        least = F.min(F.struct("key", *[f"c{i}" for i in range(d)])).alias("row")
        got = {r["fit"]: list(r["row"])[1:] for r in _complete(df.select(*cols, hash_col), cols).mapInArrow(drawn, schema).groupBy("fit").agg(least).collect()}
        for r in starts:
            starts[r] = [*starts[r], got.get(r)]  # None: no row is left away from the centres
    return starts


# ------------------------------------------------------------------ rounds

def _changed(df: DataFrame, cols: Sequence[str], fits: dict[int, tuple[Centroids, Centroids]], blocks: DataFrame) -> dict[int, int]:
    """One scan: per fit the rows whose labels under its two sets of centres differ."""
    def label(x: np.ndarray):
        before, now = (nearest_labels(x, [f[s] for f in fits.values()]) for s in (0, 1))
        return {f: ((a != b).astype(np.int64), 2, []) for f, a, b in zip(fits, before, now)}
    found = _sums(df, cols, label, blocks=blocks)
    return {f: found[f, 1][0] if (f, 1) in found else 0 for f in fits}


def lloyd_shared(df: DataFrame, cols: Sequence[str], starts: Fits) -> tuple[Fits, dict[Hashable, int]]:
    """Every fit's centres at rest (each the mean of the rows that it is nearest to; an emptied
    cluster keeps its centre), and the rounds that it took.  No cap on rounds.  Rows that
    change their label are counted only where a round leaves all clusters their numbers of rows: other
    numbers are changed labels."""
    cols, names = list(cols), list(starts)
    now: dict[int, Centroids] = dict(enumerate(starts.values()))
    rounds = {f: 0 for f in now}
    moving = {f: (None, None, c) for f, c in now.items() if any(m is not None for m in c)}
    path = scratch_path(df.sparkSession, "kmeans-blocks")
    try:
        blocks = packed(df, cols, path)
        while moving:
            def label(x: np.ndarray, moving=moving):
                labels = nearest_labels(x, [c for _, _, c in moving.values()])
                return {f: (lab, len(c), []) for (f, (_, _, c)), lab in zip(moving.items(), labels)}

            found = _sums(df, cols, label, blocks=blocks)
            sizes = {f: [found[f, j][0] if (f, j) in found else 0 for j in range(len(c))] for f, (_, _, c) in moving.items()}
            same = {f: (before, c) for f, (n, before, c) in moving.items() if n == sizes[f]}
            changed = _changed(df, cols, same, blocks) if same else {}
            following = {}
            for f, (_, _, centers) in moving.items():
                if not any(sizes[f]) or not changed.get(f, 1):
                    continue  # no row changed its label: the centres are the means of their rows
                rounds[f] += 1
                now[f] = [[s / n for s in found[f, j][1:]] if n else centers[j] for j, n in enumerate(sizes[f])]
                following[f] = (sizes[f], centers, now[f])
            moving = following
    finally:
        drop_scratch(df.sparkSession, path)
    return {names[f]: c for f, c in now.items()}, {names[f]: n for f, n in rounds.items()}


# ----------------------------------------------------------------- indices

def costs(df: DataFrame, cols: Sequence[str], fits: Fits) -> dict[Hashable, float]:
    """Every fit's within-cluster sum of squares, in one scan."""
    order = list(fits)

    def label(x: np.ndarray):
        return {f: (np.zeros(len(x), np.int64), 1, [_sq_dists(x, fits[name]).min(axis=1)]) for f, name in enumerate(order)}
    found = _sums(df, cols, label, 1)
    return {name: found[f, 0][-1] if (f, 0) in found else 0.0 for f, name in enumerate(order)}


def indices(df: DataFrame, cols: Sequence[str], fits: Fits) -> dict[Hashable, tuple]:
    """Per fit (inertia, squared-Euclidean silhouette, Davies-Bouldin); the indices are None
    with fewer than two clusters that have rows.  Two scans for all fits."""
    cols, order = list(cols), list(fits)
    d = len(cols)

    def by_label(x: np.ndarray):
        norm = (x * x).sum(axis=1)
        return {f: (lab, len(fits[order[f]]), [norm]) for f, lab in enumerate(nearest_labels(x, [fits[name] for name in order]))}
    first = _sums(df, cols, by_label, 1)
    stats = {f: {j: (first[f, j][0], np.array(first[f, j][1:1 + d]), first[f, j][-1]) for j in range(len(fits[name])) if (f, j) in first}
             for f, name in enumerate(order)}

    def quality(x: np.ndarray):
        norm, out = (x * x).sum(axis=1), {}
        for f, name in enumerate(order):
            least = _sq_dists(x, fits[name])
            lab = least.argmin(axis=1)
            st = stats[f]
            mean_d = np.full((len(x), len(fits[name])), math.inf)  # mean squared distance to a cluster's rows
            for j, (n, s, y) in st.items():
                mean_d[:, j] = norm + y / n - 2.0 * (x @ s) / n
            at = np.arange(len(x))
            own = np.array([st[j][0] if j in st else 0 for j in range(len(fits[name]))])[lab]
            a = mean_d[at, lab] * own / np.maximum(own - 1, 1)
            mean_d[at, lab] = math.inf
            b = mean_d.min(axis=1)
            most = np.maximum(a, b)
            with np.errstate(invalid="ignore", divide="ignore"):
                sil = np.where((own <= 1) | (most == 0) | ~np.isfinite(b), 0.0, (b - a) / most)
            center = np.array([st[j][1] / st[j][0] if j in st else np.zeros(d) for j in range(len(fits[name]))])
            out[f] = lab, len(fits[name]), [least.min(axis=1), sil, np.sqrt(((x - center[lab]) ** 2).sum(axis=1))]
        return out

    second = _sums(df, cols, quality, 3)
    out = {}
    for f, name in enumerate(order):
        st, rows = stats[f], {j: second[f, j] for j in stats[f]}
        cost = math.fsum(r[-3] for r in rows.values())
        if len(st) < 2:
            out[name] = (cost, None, None)
            continue
        n = sum(r[0] for r in rows.values())
        center, spread = {j: s / m for j, (m, s, _) in st.items()}, {j: r[-1] / r[0] for j, r in rows.items()}

        def overlap(i: int, j: int) -> float:
            gap = float(np.sqrt(((center[i] - center[j]) ** 2).sum()))
            return (spread[i] + spread[j]) / gap if gap > 0 else math.inf
        out[name] = (cost, math.fsum(r[-2] for r in rows.values()) / n,
                     sum(max(overlap(i, j) for j in st if j != i) for i in st) / len(st))
    return out


def best_of(df: DataFrame, cols: Sequence[str], hash_col: str, k: int, restarts: int) -> Centroids:
    """Of ``restarts`` seeded fits run to rest, the one of least cost (the first of equals)."""
    fits, _ = lloyd_shared(df, cols, seeded_starts(df, cols, hash_col, k, restarts))
    cost = costs(df, cols, fits)
    return fits[min(fits, key=lambda r: (cost[r], r))]
