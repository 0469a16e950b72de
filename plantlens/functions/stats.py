"""Statistical building blocks shared by the operators.

* ``safe_ratio``: ANSI-safe division (no DIVIDE_BY_ZERO).
* ``quantiles``: exact linear-interpolation quantiles (pandas/DuckDB
  ``quantile_cont`` semantics) in a few scans, whatever the values.
* ``present``: presentation rounding of every double column.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def col_(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_ratio(num: Column, den: Column) -> Column:
    """num / den, NULL when den is 0 or NULL (ANSI mode raises on x/0)."""
    return F.try_divide(num, F.nullif(den, F.lit(0)))


def present(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every DOUBLE column to ``digits`` decimals (presentation only).

    Rounds the binary product ``x * 10^digits`` to an integer (half away from
    zero) and scales back, so the result does not depend on how a value's
    decimal text ends; ``+ 0.0`` turns a negative zero into zero."""
    out = []
    scale = float(10 ** digits)
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            x = F.col(f.name).cast("double")
            out.append((F.round(x * scale, 0) / scale + F.lit(0.0)).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


# ---------------------------------------------------------------------------
# Exact quantiles.
#
# Spark's ``percentile`` is exact but keeps a value->count map of every
# distinct value and merges it in one task per group; on continuous sensor
# data at 100 TB that map is the whole column.  ``percentile_approx`` is
# bounded but returns a datum, not the interpolated value.
#
# Of whole columns (``quantiles``): a value's bits give a 64-bit key of the same order.
# One scan counts every column's values by the first bits of their keys, which says in
# which range of keys each wanted rank lies; the next scan counts the values of these
# ranges alone, by more bits, or value by value where a range holds few; a range that holds
# one value over and over is settled at once.  Counts are numpy on Arrow batches, added up
# and ranked by Spark.  Neither spread nor ties change the number of scans (five at most).
#
# Per group (``grouped_quantiles``), three passes:
#   1. one bounded sketch brackets every wanted rank between two data values;
#   2. one aggregation counts the rows below, on, and strictly between the
#      bracket values, which settles ranks that fall on a bracket value;
#   3. the few values strictly between (a fixed small share of the ranks) are
#      counted by value, sorted and ranked, distributed by column and bracket.
# Infinities are values like others.  NaN counts as NULL.
# ---------------------------------------------------------------------------

#: Rank error of the sketch is 1/ACCURACY of the rows; brackets take four times that on either side.
ACCURACY = 20000


def _target_ranks(n: int, p: float) -> tuple[int, int]:
    """The 0-based ranks whose values a quantile interpolates between."""
    k = int(math.floor((n - 1) * p))
    return k, min(k + 1, n - 1)


def _interpolated(n: int, p: float, lo: float, hi: float) -> float:
    """lo*(1-d) + hi*d with one rounding of the first product, the same float
    result as DuckDB's ``quantile_cont``."""
    k, k1 = _target_ranks(n, p)
    h = (n - 1) * p
    if lo == hi or h == k or k1 == k:
        return lo
    return math.fma(lo, (k1 - h), hi * (h - k))


def _brackets(long: DataFrame, keys: list[str], probs: list[float], margin: float) -> DataFrame:
    """Per key: n, and the bracket values lo{j}, hi{j} of every probability."""
    ps = [q for p in probs for q in (max(p - margin, 0.0), min(p + margin, 1.0))]
    agg = long.groupBy(*keys).agg(
        F.count("v").alias("n"), F.min("v").alias("_least"), F.max("v").alias("_most"),
        F.percentile_approx("v", F.array(*[F.lit(q) for q in ps]), ACCURACY).alias("_q"))
    few = F.col("n") <= ACCURACY  # the sketch's rank error is below one row: the bracket is everything
    out = []
    for j, p in enumerate(probs):
        out.append((F.col("_least") if p - margin <= 0 else F.when(few, F.col("_least")).otherwise(F.col("_q")[2 * j])).alias(f"lo{j}"))
        out.append((F.col("_most") if p + margin >= 1 else F.when(few, F.col("_most")).otherwise(F.col("_q")[2 * j + 1])).alias(f"hi{j}"))
    return agg.filter(F.col("n") > 0).select(*keys, "n", *out)


def _counts(rows: DataFrame, keys: list[str], probs: list[float]) -> DataFrame:
    """Per key and probability j: rows below lo (b{j}), on lo (l{j}), strictly inside (i{j})."""
    v, aggs = F.col("v"), []
    for j in range(len(probs)):
        lo, hi = F.col(f"lo{j}"), F.col(f"hi{j}")
        aggs += [F.count_if(v < lo).alias(f"b{j}"), F.count_if(v == lo).alias(f"l{j}"),
                 F.count_if((v > lo) & (v < hi)).alias(f"i{j}")]
    return rows.groupBy(*keys).agg(*aggs)


def _inside(rows: DataFrame, keys: list[str], probs: list[float]) -> DataFrame:
    """(keys, j, v, first, last): the distinct values strictly inside bracket j with the ranks
    they hold there.  Only that small share of the rows is shuffled and sorted."""
    v = F.col("v")
    tags = F.array(*[F.when((v > F.col(f"lo{j}")) & (v < F.col(f"hi{j}")), F.lit(j)) for j in range(len(probs))])
    hits = (rows.select(*keys, "v", F.explode(tags).alias("j")).filter(F.col("j").isNotNull())
            .groupBy(*keys, "j", "v").agg(F.count(F.lit(1)).alias("c")))
    w = Window.partitionBy(*keys, "j").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.sum("c").over(w)
    return hits.select(*keys, "j", "v", (upto - F.col("c")).alias("first"), (upto - 1).alias("last"))


#: Bits of a key that the first scan of ``column_quantiles`` tells apart, and each further one.
FIRST_BITS, MORE_BITS = 16, 12
#: A range of keys with at most so many values is counted value by value.
FEW = 50_000
_SIGN = 1 << 63


def _keys(v: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit keys in the order of the values (-0.0 is 0.0)."""
    bits = (v + 0.0).view(np.uint64)
    return bits ^ np.where(bits >> np.uint64(63) == 0, np.uint64(_SIGN), ~np.uint64(0))


def _value(signed: int) -> float:
    """The value of a key that was shifted to the range of a signed number."""
    key = signed + _SIGN
    return struct.unpack("<d", struct.pack("<Q", key ^ _SIGN if key & _SIGN else key ^ (2 * _SIGN - 1)))[0]


def _tally(values: DataFrame, ranges: list[tuple[int, int, bool]], bits: int, width: int) -> DataFrame:
    """One scan: (i, part, n, least, most) of the ranges (column, first ``bits`` bits of its keys, whether
    every key is a part): rows and extreme keys per part, else by the next ``width`` bits.  Keys are
    shifted to signed numbers; the first scan gives a part's bounds as its extremes."""
    names = ["i", "part", "n", "least", "most"]
    signed = lambda keys: (keys ^ np.uint64(_SIGN)).view(np.int64)
    rest = np.uint64(64 - bits - width)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, big = 1 << width, np.iinfo(np.int64)
        n = {i: np.zeros(size, np.int64) for i, r in enumerate(ranges) if not r[2]}
        extremes = {i: (np.full(size, big.max), np.full(size, big.min)) for i in n} if bits else {}
        whole: dict[int, list] = {i: [] for i, r in enumerate(ranges) if r[2]}
        for batch in batches:
            own: dict[int, tuple] = {}
            for i, (c, prefix, _) in enumerate(ranges):
                if c not in own:
                    v = batch.column(c).drop_null().to_numpy(zero_copy_only=False)
                    keys = _keys(v[~np.isnan(v)])
                    own[c] = keys, keys >> np.uint64(64 - bits) if bits else None
                keys, top = own[c]
                if bits:
                    keys = keys[top == np.uint64(prefix)]
                if not len(keys):
                    continue
                if i in whole:
                    whole[i].append(np.unique(signed(keys), return_counts=True))
                    continue
                part = ((keys >> rest) & np.uint64(size - 1)).view(np.int64)
                low = int(part.min())
                found = np.bincount(part - low)
                n[i][low:low + len(found)] += found
                if bits:
                    np.minimum.at(extremes[i][0], part, signed(keys))
                    np.maximum.at(extremes[i][1], part, signed(keys))
        out = []
        for i, found in n.items():
            part = np.flatnonzero(found)
            if bits:
                least, most = (e[part] for e in extremes[i])
            else:
                least = signed(part.astype(np.uint64) << rest)
                most = signed((part.astype(np.uint64) << rest) | np.uint64((1 << int(rest)) - 1))
            out.append((i, part, found[part], least, most))
        for i, found in whole.items():
            if found:
                keys, at = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
                out.append((i, keys, np.bincount(at, np.concatenate([f[1] for f in found])).astype(np.int64), keys, keys))
        for i, *columns in out:
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(columns[0]), i, np.int32))] + [pa.array(x, pa.int64()) for x in columns], names=names)

    return (values.mapInArrow(partial, "i int, part long, n long, least long, most long").groupBy("i", "part")
            .agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most")))


def column_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> dict[str, list[float]]:
    """Exact quantiles of whole columns; a column without values is missing."""
    cols, probs = list(cols), [float(p) for p in probs]
    values = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    ranges, bits, width = [(i, 0, False) for i in range(len(cols))], 0, FIRST_BITS
    total = F.sum("n").over(Window.partitionBy("i"))
    ranks = F.array(*[x for p in probs for k in [F.floor((F.col("total") - 1) * F.lit(p)).cast("long")] for x in (k, F.least(k + 1, F.col("total") - 1))])
    counts: dict[int, int] = {}
    todo: dict[tuple[int, int], tuple[int, int]] = {}  # (column, rank) -> (range, rank in it)
    found: dict[tuple[int, int], float] = {}
    while ranges:
        upto = F.sum("n").over(Window.partitionBy("i").orderBy("part").rowsBetween(Window.unboundedPreceding, 0))
        parts = _tally(values, ranges, bits, width).withColumns({"total": total, "first": upto - F.col("n")})
        if bits:
            at = [sorted({k for j, k in todo.values() if j == i}) for i in range(len(ranges))]
            ranks = F.array(*[F.array(*[F.lit(k).cast("long") for k in a]) for a in at])[F.col("i")]
        here = parts.where(F.exists(ranks, lambda k: (k >= F.col("first")) & (k < F.col("first") + F.col("n")))).collect()
        if not bits:
            counts = {r["i"]: r["total"] for r in here}
            todo = {(i, k): (i, k) for i, n in counts.items() for p in probs for k in _target_ranks(n, p)}
        following: dict[tuple[int, int, bool], int] = {}
        left = {}
        for (c, rank), (i, k) in todo.items():
            r = next(r for r in here if r["i"] == i and r["first"] <= k < r["first"] + r["n"])
            if r["least"] == r["most"]:
                found[c, rank] = _value(r["least"])
            else:
                part = (c, ranges[i][1] << width | r["part"], r["n"] <= FEW)
                left[c, rank] = following.setdefault(part, len(following)), k - r["first"]
        bits, width, ranges, todo = bits + width, MORE_BITS, list(following), left
    return {cols[i]: [_interpolated(n, p, *(found[i, k] for k in _target_ranks(n, p))) for p in probs] for i, n in counts.items()}


def grouped_quantiles(long: DataFrame, keys: Sequence[str], probs: Sequence[float], store) -> DataFrame:
    """Exact quantiles of rows (keys, v) per key, for any number of keys: (keys, n, q0, q1, ...).
    Nothing is collected; ``store`` writes a frame to the shared folder and reads it back, so
    that the join with the brackets knows their size."""
    keys, probs = list(keys), [float(p) for p in probs]
    brackets = store(_brackets(long, keys, probs, 4.0 / ACCURACY))
    rows = long.join(brackets, keys)
    counts = store(_counts(rows, keys, probs).join(brackets, keys))
    at, values = [], []
    for j, p in enumerate(probs):
        h = (F.col("n") - 1) * F.lit(p)
        k = F.floor(h).cast("long")
        for e, rank in (("a", k), ("z", F.least(k + 1, F.col("n") - 1))):
            at.append((rank - F.col(f"b{j}") - F.col(f"l{j}")).alias(f"{e}{j}"))
        at.append((h - k).alias(f"d{j}"))
    plan = counts.select(*keys, "n", *[f"{e}{j}" for j in range(len(probs)) for e in ("lo", "hi", "i")], *at)
    inside = _inside(rows, keys, probs).join(plan, keys)
    for j in range(len(probs)):
        for e in ("a", "z"):
            hit = (F.col("j") == j) & (F.col("first") <= F.col(f"{e}{j}")) & (F.col("last") >= F.col(f"{e}{j}"))
            values.append(F.max(F.when(hit, F.col("v"))).alias(f"v{e}{j}"))
    inner = inside.groupBy(*keys).agg(*values)
    out = plan.join(inner, keys, "left")
    final = []
    for j in range(len(probs)):
        a, z = (F.when(F.col(f"{e}{j}") < 0, F.col(f"lo{j}")).when(F.col(f"{e}{j}") >= F.col(f"i{j}"), F.col(f"hi{j}"))
                .otherwise(F.col(f"v{e}{j}")) for e in ("a", "z"))
        d = F.col(f"d{j}")
        final.append(F.when((a == z) | (d == 0), a).otherwise(a * (1 - d) + z * d).alias(f"q{j}"))
    return out.select(*keys, "n", *final)


def quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float],
              method: str = "exact", accuracy: int = 100000) -> dict[str, list[float | None]]:
    """Linear-interpolation quantiles of each column (NULLs and NaN skipped).

    method: ``exact`` (keys counted by ranges; default), ``percentile``
    (Spark's exact aggregate; fine for low-cardinality data), ``approx``
    (``percentile_approx``: one pass, returns a datum)."""
    cols, probs = list(cols), [float(p) for p in probs]
    if not cols:
        return {}
    if method in ("percentile", "approx"):
        ps = F.array(*[F.lit(p) for p in probs])
        row = df.agg(*[(F.percentile(F.col(c), ps) if method == "percentile"
                        else F.percentile_approx(F.col(c), ps, accuracy)).alias(c) for c in cols]).first()
        return {c: (list(row[c]) if row[c] is not None else [None] * len(probs)) for c in cols}
    if method != "exact":
        raise ValueError(method)
    got = column_quantiles(df, cols, probs)
    return {c: got.get(c, [None] * len(probs)) for c in cols}


def long_values(df: DataFrame, cols: Sequence[str], idx: str = "col_idx", val: str = "v") -> DataFrame:
    """(column index, value as double) rows, one per column per input row.

    Per-column statistics of many columns are computed as a group-by on the
    column index over this long form: each group carries a handful of
    aggregates, so the plan stays in whole-stage codegen however many columns
    there are (one wide 1-row aggregate of 5 x d functions exceeds
    ``spark.sql.codegen.maxFields``).  Partial aggregation ships d rows per
    task."""
    arr = F.array(*[F.col(c).cast("double") for c in cols])
    return df.select(F.posexplode(arr).alias(idx, val))


def column_stats(df: DataFrame, cols: Sequence[str], aggs: dict[str, Column], idx: str = "col_idx") -> dict:
    """Run ``aggs`` (over column ``v``) per column via ``long_values``;
    returns {column: Row}."""
    cols = list(cols)
    rows = long_values(df, cols, idx).groupBy(idx).agg(*[a.alias(n) for n, a in aggs.items()]).collect()
    return {cols[r[idx]]: r for r in rows}
