"""The exact Euclidean silhouette, by sums of distances between tiles of rows.

Every row needs its distance to every other row; no pair becomes a row.  Rows are packed
in tiles of at most ``TILE`` (a matrix and the labels under all fits).  Tiles are dealt
to a grid: a group of the grid holds a few tiles as rows and a few as columns, a task
multiplies them out in numpy and keeps, per row and cluster, one sum of distances.  All fits
share the distances.  A task's memory is a group of tiles; the work is quadratic, as
the index is, so this is for aggregated tables (shifts), and ``silhouette_sq`` for the log.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TILE = 1024
#: Tiles of a group on each side.
GROUP = 8


def silhouettes(df: DataFrame, cols: Sequence[str], labels: Sequence[str], store: Callable[[DataFrame], DataFrame],
                tile: int = TILE) -> dict[str, float | None]:
    """Mean Euclidean silhouette under each label column; None with fewer than two clusters.
    A row alone in its cluster counts 0.  Rows with a NULL in a column or label are left out.
    ``store`` writes a frame to the shared folder and reads it back."""
    cols, labels = list(cols), list(labels)
    d, f = len(cols), len(labels)
    rows = df.select(*cols, *[F.col(x).cast("int").alias(f"_l{k}") for k, x in enumerate(labels)]).dropna()
    ids = [sorted(r[0] for r in rows.select(f"_l{k}").distinct().collect()) for k in range(f)]  # the clusters
    starts = np.cumsum([0, *map(len, ids)])
    width = int(starts[-1])
    if not width:
        return {x: None for x in labels}

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            x = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(d)], axis=1).astype("<f8")
            lab = np.stack([np.searchsorted(ids[k], batch.column(d + k).to_numpy(zero_copy_only=False)) + starts[k] for k in range(f)], axis=1).astype("<i4")
            for lo in range(0, len(x), tile):
                yield pa.RecordBatch.from_pylist([{"id": part << 32 | n, "x": x[lo:lo + tile].tobytes(), "lab": lab[lo:lo + tile].tobytes()}],
                                                 pa.schema([("id", pa.int64()), ("x", pa.binary()), ("lab", pa.binary())]))
                n += 1

    tiles = store(rows.mapInArrow(pack, "id long, x binary, lab binary"))
    n_groups = max(1, -(-tiles.count() // GROUP))
    own = F.pmod(F.xxhash64("id"), F.lit(n_groups)).cast("int")
    across = F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1)))
    sides = tiles.select("id", "x", "lab", own.alias("i"), across.alias("j"), F.lit(1).alias("side")).unionByName(
        tiles.select("id", "x", "lab", across.alias("i"), own.alias("j"), F.lit(0).alias("side")))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, columns = None, []
        for batch in batches:
            for i, j, side, ident, x, lab in zip(*(batch.column(k).to_pylist() for k in range(6))):
                if (i, j) != cell:
                    cell, columns = (i, j), []
                points, lab = np.frombuffer(x, "<f8").reshape(-1, d), np.frombuffer(lab, "<i4").reshape(-1, f)
                if side == 0:  # a tile's columns come first: the clusters' indicator
                    member = np.zeros((len(points), width))
                    for k in range(f):
                        member[np.arange(len(points)), lab[:, k]] = 1.0
                    columns.append((points, member))
                    continue
                total = np.zeros((len(points), width))
                for other, member in columns:
                    sq = np.zeros((len(points), len(other)))
                    for c in range(d):
                        diff = points[:, c, None] - other[None, :, c]
                        sq += diff * diff
                    total += np.sqrt(sq) @ member
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(points), ident)), pa.array(np.arange(len(points), dtype=np.int32)), pa.array([r.tolist() for r in lab], pa.list_(pa.int32())),
                     *[pa.array(np.ascontiguousarray(total[:, c])) for c in range(width)]], names=["id", "at", "lab", *[f"s{c}" for c in range(width)]])

    parts = (sides.select("i", "j", "side", "id", "x", "lab").repartition("i", "j").sortWithinPartitions("i", "j", "side", "id")
             .mapInArrow(sums, "id long, at int, lab array<int>, " + ", ".join(f"s{c} double" for c in range(width))))
    whole = parts.groupBy("id", "at").agg(F.first("lab").alias("lab"), *[F.sum(f"s{c}").alias(f"s{c}") for c in range(width)])
    sizes = {}
    for k in range(f):
        sizes.update({int(starts[k]) + ids[k].index(r[0]): r[1] for r in rows.groupBy(f"_l{k}").count().collect()})
    scores = []
    for k in range(f):
        mine = range(int(starts[k]), int(starts[k + 1]))
        lab = F.col("lab")[k]
        if len(mine) < 2:
            scores.append(F.lit(None).cast("double").alias(f"f{k}"))
            continue
        n = F.create_map(*[v for c in mine for v in (F.lit(c), F.lit(sizes[c]))])[lab]
        a = F.try_divide(F.coalesce(*[F.when(lab == c, F.col(f"s{c}")) for c in mine]), n - 1)
        b = F.array_min(F.array(*[F.when(lab != c, F.col(f"s{c}") / sizes[c]) for c in mine]))
        s = F.when(n <= 1, F.lit(0.0)).otherwise(F.coalesce(F.try_divide(b - a, F.nullif(F.greatest(a, b), F.lit(0.0))), F.lit(0.0)))
        scores.append(F.avg(s).alias(f"f{k}"))
    r = whole.agg(*scores).first()
    return {x: r[f"f{k}"] for k, x in enumerate(labels)}
