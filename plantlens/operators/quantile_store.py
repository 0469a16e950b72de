"""B2/C3/C5 over date ranges: exact quantiles from stored sketches and sorted chunks.

The store has two tables, built once from the log:

* ``sketches``: per (day, line, column) the number of values and a mergeable KLL sketch;
* ``chunks``: the values of each (day, line, column) sorted, in runs of ``RUN`` rows where there are more, and cut
  into chunks of at most ``CHUNK``, each with its least and largest value and its size beside the array.

A query of any days and lines merges the few sketches of its range to a bracket around
each wanted rank.  Chunks wholly below a bracket are counted by their size: the arrays are
read only of chunks that overlap a bracket, a small share whatever the range.  The ranks
inside are exact.  If a sketch was off and a rank lies outside its bracket, the
bracket is widened and the step repeated.  NULL and NaN are no values.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plantlens.functions.stats import _interpolated, _target_ranks

CHUNK = 1024
#: Rows that are sorted at a time.
RUN = 1 << 18
#: Size of a sketch, and the rank error (share of the rows) that its brackets allow for.
SKETCH_K, MARGIN = 2048, 0.004

_CHUNKS = "day date, line string, col int, lo double, hi double, n long, v array<double>"


def _values(log: DataFrame, cols: Sequence[str], day: Column, line: str) -> DataFrame:
    """(day, line, v0, v1, ...): the columns as doubles, NaN as NULL."""
    return log.select(day.alias("day"), F.col(line).alias("line"),
                      *[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(f"v{k}") for k, c in enumerate(cols)])


def sketches(log: DataFrame, cols: Sequence[str], day: Column, line: str = "line_id") -> DataFrame:
    """(day, line, col, n, sketch).  All columns are aggregated in a row of their day and line: a row and
    group for every column would be more groups than Spark aggregates without sorting the rows."""
    found = _values(log, cols, day, line).groupBy("day", "line").agg(
        *[x for k in range(len(cols)) for x in (F.count(f"v{k}").alias(f"n{k}"), F.kll_sketch_agg_double(f"v{k}", SKETCH_K).alias(f"s{k}"))])
    each = F.array(*[F.struct(F.lit(k).alias("col"), F.col(f"n{k}").alias("n"), F.col(f"s{k}").alias("sketch")) for k in range(len(cols))])
    return found.select("day", "line", F.inline(each)).where("n > 0")


def _cut(key: tuple, parts: list[list[np.ndarray]], size: int) -> Iterator[pa.RecordBatch]:
    """The chunks of every column of rows of one day and line."""
    for col, values in enumerate(zip(*parts)):
        v = np.concatenate(values)
        v = np.sort(v[~np.isnan(v)])
        if not len(v):
            continue
        first = np.arange(0, len(v), size)
        last = np.minimum(first + size, len(v))
        many = len(first)
        yield pa.RecordBatch.from_arrays(
            [pa.array([key[0]] * many, pa.date32()), pa.array([key[1]] * many, pa.string()), pa.array([col] * many, pa.int32()), pa.array(v[first]),
             pa.array(v[last - 1]), pa.array(last - first), pa.ListArray.from_arrays(pa.array([*first, len(v)], pa.int32()), pa.array(v))],
            names=["day", "line", "col", "lo", "hi", "n", "v"])


def chunks(log: DataFrame, cols: Sequence[str], day: Column, line: str = "line_id", size: int = CHUNK, run: int = RUN) -> DataFrame:
    """The sorted values in chunks.  The rows, with all columns, are dealt by day and line (a hot one lies in many
    partitions) and come to a task's numpy in that order; it sorts about ``run`` rows at a time by
    every column, so the chunks of a run lie close, and runs of one day and line overlap."""
    keys = ["day", "line"]
    values = _values(log, cols, day, line)
    rows = values.repartitionByRange(*keys, F.xxhash64(*values.columns[2:])).sortWithinPartitions(*keys)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, n = None, [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            days = batch.column(0).cast(pa.int32()).fill_null(-2 ** 31).to_numpy()
            lines = batch.column(1).dictionary_encode(null_encoding="encode").indices.to_numpy()
            x = [c.to_numpy(zero_copy_only=False).astype(np.float64, copy=False) for c in batch.columns[2:]]
            ends = [0, *(np.flatnonzero((np.diff(days) != 0) | (np.diff(lines) != 0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(ends, ends[1:]):
                now = batch.column(0)[a].as_py(), batch.column(1)[a].as_py()
                if held and (now != key or n >= run):
                    yield from _cut(key, held, size)
                    held, n = [], 0
                key = now
                held.append([c[a:b] for c in x])
                n += b - a
        if held:
            yield from _cut(key, held, size)

    return rows.mapInArrow(cut, _CHUNKS)


@dataclass
class Store:
    """The written tables, and the columns by number."""

    sketches: DataFrame
    chunks: DataFrame
    cols: list[str]

    def quantiles(self, probs: Sequence[float], where: Column | None = None) -> dict[str, tuple[int, list[float]]]:
        """Per column with values: (n, quantiles) of the days and lines that ``where`` (a
        condition on day and line) selects."""
        probs, margin = [float(p) for p in probs], MARGIN
        where = F.lit(True) if where is None else where
        merged = self.sketches.where(where).groupBy("col").agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("s"))
        rows = self.chunks.where(where)
        while True:
            ends = [F.kll_sketch_get_quantile_double("s", F.lit(min(max(p + side * margin, 0.0), 1.0))).alias(f"{e}{j}")
                    for j, p in enumerate(probs) for e, side in (("lo", -1), ("hi", 1))]
            brackets = merged.select("col", "n", *ends).collect()  # a row per column
            if not brackets:
                return {}
            spans = []
            for r in brackets:
                for j, p in enumerate(probs):
                    lo = float("-inf") if p - margin <= 0 else r[f"lo{j}"]
                    hi = float("inf") if p + margin >= 1 else r[f"hi{j}"]
                    spans.append((r["col"], j, lo, hi, *_target_ranks(r["n"], p)))
            found, missed = self._ranked(rows, spans)
            if missed:
                margin = min(1.0, margin * 8)
                continue
            out = {}
            for r in brackets:
                values = [[found[r["col"], j, k] for k in _target_ranks(r["n"], p)] for j, p in enumerate(probs)]
                out[self.cols[r["col"]]] = (r["n"], [_interpolated(r["n"], p, *v) for p, v in zip(probs, values)])
            return out

    def _ranked(self, rows: DataFrame, spans: list[tuple]) -> tuple[dict, bool]:
        """The values at the wanted ranks of each span (col, bracket, lo, hi, rank, rank), and
        whether one lies outside."""
        span = F.array(*[F.struct(F.lit(c).alias("c"), F.lit(j).alias("j"), F.lit(lo).cast("double").alias("least"), F.lit(hi).cast("double").alias("most"))
                         for c, j, lo, hi, _, _ in spans])
        placed = rows.withColumn("span", F.explode(F.filter(span, lambda s: s["c"] == F.col("col")))).select("col", "span.j", "span.least", "span.most", "lo", "hi", "n", "v")
        below = {(r["col"], r["j"]): r["n"] for r in placed.where("hi < least").groupBy("col", "j").agg(F.sum("n").alias("n")).collect()}
        read = placed.where("hi >= least AND lo <= most").select("col", "j", "least", "most", F.explode("v").alias("v")).where("v <= most")
        counts = read.groupBy("col", "j", F.when(F.col("v") >= F.col("least"), F.col("v")).alias("v")).agg(F.count(F.lit(1)).alias("c"))
        under = F.col("v").isNull()  # in a chunk that overlaps, but below the bracket
        w = Window.partitionBy("col", "j").orderBy(F.col("v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
        ranked = counts.withColumn("upto", F.sum("c").over(w)).withColumn("first", F.col("upto") - F.col("c"))
        hit = F.lit(False)
        for c, j, _, _, *ranks in spans:
            for k in ranks:
                at = k - below.get((c, j), 0)
                hit = hit | ((F.col("col") == c) & (F.col("j") == j) & (F.col("first") <= at) & (F.col("upto") > at))
        got: dict = {}
        for r in ranked.where(hit & ~under).collect():
            got.setdefault((r["col"], r["j"]), []).append((r["first"], r["upto"], r["v"]))
        found, missed = {}, False
        for c, j, _, _, *ranks in spans:
            for k in ranks:
                at = k - below.get((c, j), 0)
                v = next((v for first, upto, v in got.get((c, j), ()) if first <= at < upto), None)
                missed |= v is None
                found[c, j, k] = v
        return found, missed
