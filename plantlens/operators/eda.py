"""Correlations, histogram, KDE, equal-width cut and bin profiles.

Bins are assigned by comparing against literal edges built like numpy's
``linspace`` (``k * step + lo``; last edge = max), so a value on an edge
lands where numpy/pandas put it; the comparisons stay inside codegen.  Every
report is one scan after the min/max pass; empty bins are kept by
conditional aggregation (no spine join).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



# ------------------------------------------------------------ correlations

TILE = 4  # columns of a tile's side: 16 products stay in one compiled method


def _pair_sums(df: DataFrame, pairs: list[tuple[int, int]], u: dict[int, Column], complete: bool) -> dict:
    """Sums of every column pair: (n, sum a, sum b, sum aa, sum bb, sum ab).

    Pairs are cut into tiles of a few columns by a few columns; a tile is one
    narrow aggregate that stays in generated code (one aggregate over all d*d/2
    products would not), reading only its own columns."""
    side = TILE if complete else TILE // 2
    tiles: dict[tuple[int, int], list] = {}
    for a, b in pairs:
        tiles.setdefault((a // side, b // side), []).append((a, b))
    parts = []
    for t, members in enumerate(tiles.values()):
        sums = []
        for a, b in members:
            both = u[a].isNotNull() & u[b].isNotNull()
            x, y = (u[a], u[b]) if complete else (F.when(both, u[a]), F.when(both, u[b]))
            sums.append(F.array(F.count(x).cast("double"), F.sum(x), F.sum(y), F.sum(x * x), F.sum(y * y), F.sum(x * y)))
        parts.append(df.agg(F.array(*sums).alias("s")).select(F.lit(t).alias("t"), "s"))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionAll(p)
    got = {r["t"]: r["s"] for r in rows.collect()}
    return {pair: got[t][k] for t, members in enumerate(tiles.values()) for k, pair in enumerate(members)}


def pearson_pairs(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Pearson r of column pairs (each unordered pair is computed once).

    Pass 1: per column mean, min, max and NULL count; pass 2: moment sums of
    u = x - mean, so no digits are lost to a mean that is large against the
    spread.  r is NULL when either side is constant (min = max; pandas: NaN),
    also where the other side is NULL."""
    pairs = list(pairs)
    cols = sorted({c for p in pairs for c in p})
    x = [F.col(c).cast("double") for c in cols]
    st = df.agg(*[e.alias(f"{n}_{i}") for i, c in enumerate(x) for n, e in (
        ("m", F.avg(c)), ("lo", F.min(c)), ("hi", F.max(c)), ("z", F.count_if(c.isNull())))]).first()
    idx = {c: i for i, c in enumerate(cols)}
    u = {i: c - F.lit(st[f"m_{i}"]) for i, c in enumerate(x) if st[f"m_{i}"] is not None}
    constant = {i for i in idx.values() if st[f"lo_{i}"] == st[f"hi_{i}"]}
    complete = all(st[f"z_{i}"] == 0 for i in idx.values())
    wanted = sorted({tuple(sorted((idx[a], idx[b]))) for a, b in pairs if not {idx[a], idx[b]} & constant})
    sums = _pair_sums(df, wanted, u, complete) if wanted else {}
    rows = []
    for a, b in pairs:
        r = None
        n, sa, sb, qa, qb, p = sums.get(tuple(sorted((idx[a], idx[b]))), (0,) * 6)
        if n:
            va, vb = qa - sa * sa / n, qb - sb * sb / n
            if va > 0 and vb > 0:
                r = 1.0 if a == b else (p - sa * sb / n) / math.sqrt(va * vb)
        rows.append((a, b, r))
    return df.sparkSession.createDataFrame(rows, "x string, y string, r double")


def corr_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson matrix in long form (x, y, r) over every ordered pair,
    pairwise-complete, NULL where a column is constant."""
    cols = list(cols)
    return pearson_pairs(df, [(a, b) for a in cols for b in cols])


def corr_with(df: DataFrame, target: str, cols: Sequence[str]) -> DataFrame:
    """Correlation of ``target`` with every other column."""
    others = [c for c in cols if c != target]
    return (pearson_pairs(df, [(target, c) for c in others])
            .select(F.col("y").alias("feature"), "r"))


def strength(r: Column, strong: float = 0.5, moderate: float = 0.2) -> Column:
    a = F.abs(r)
    return (F.when(r.isNull(), F.lit("undefined")).when(a >= strong, "strong")
            .when(a >= moderate, "moderate").otherwise("weak"))


def corr_pairs(df: DataFrame, cols: Sequence[str], strong: float = 0.5, moderate: float = 0.2) -> DataFrame:
    """D2r: every distinct pair with its band (strong / moderate / weak)."""
    cols = list(cols)
    m = pearson_pairs(df, [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]])
    return m.withColumn("strength", strength(F.col("r"), strong, moderate))


# --------------------------------------------------------------- binning

def linspace_edges(lo: float, hi: float, n: int) -> list[float]:
    """numpy.linspace(lo, hi, n + 1): k * step + lo, last edge exactly hi."""
    step = (hi - lo) / n
    return [k * step + lo for k in range(n)] + [hi]


def _min_max(df: DataFrame, col: str) -> tuple[float | None, float | None, int]:
    r = df.agg(F.min(F.col(col).cast("double")).alias("lo"), F.max(F.col(col).cast("double")).alias("hi"),
               F.count(col).alias("n")).first()
    return r["lo"], r["hi"], r["n"]


def _count_above(x: Column, edges: Sequence[float], strict: bool) -> Column:
    terms = [F.when((x > F.lit(e)) if strict else (x >= F.lit(e)), 1).otherwise(0) for e in edges]
    out = terms[0] if terms else F.lit(0)
    for t in terms[1:]:
        out = out + t
    return out


def histogram(df: DataFrame, col: str, bins: int = 30) -> DataFrame:
    """D3: equal-width histogram over [min, max] (numpy.histogram): bins are
    left-closed, the last one closed; empty bins kept with count 0."""
    lo, hi, n = _min_max(df, col)
    if lo is None:
        return df.sparkSession.createDataFrame([], "bin int, bin_lo double, bin_hi double, count long")
    if lo == hi:  # numpy widens a zero range to [lo - 0.5, hi + 0.5]
        lo, hi = lo - 0.5, hi + 0.5
    edges = linspace_edges(lo, hi, bins)
    x = F.col(col)
    b = _count_above(x, edges[1:-1], strict=False)
    agg = df.filter(x.isNotNull()).agg(*[F.count_if(b == k).alias(f"c{k}") for k in range(bins)])
    return agg.select(F.inline(F.array(*[
        F.struct(F.lit(k).alias("bin"), F.lit(edges[k]).alias("bin_lo"), F.lit(edges[k + 1]).alias("bin_hi"),
                 F.col(f"c{k}").cast("long").alias("count")) for k in range(bins)])))


def cut_edges(lo: float, hi: float, bins: int) -> list[float]:
    """pandas.cut(bins=n) edges: linspace(min, max, n+1) with the first edge
    lowered by 0.1 % of the range (right-closed bins include the minimum)."""
    if lo == hi:  # pandas widens a zero range by 0.1 % on each side
        adj = abs(lo) * 0.001 if lo != 0 else 0.001
        return linspace_edges(lo - adj, hi + adj, bins)
    e = linspace_edges(lo, hi, bins)
    e[0] -= (hi - lo) * 0.001
    return e


def cut(df: DataFrame, col: str, bins: int = 5, name: str = "bin") -> tuple[DataFrame, list[float]]:
    """Right-closed equal-width bins (a, b]; adds ``{name}_idx`` (1..n),
    ``{name}_lo`` and ``{name}_hi``.  Not ``Bucketizer`` (left-closed)."""
    lo, hi, _ = _min_max(df, col)
    if lo is None:
        return df.withColumns({f"{name}_idx": F.lit(None).cast("int"), f"{name}_lo": F.lit(None).cast("double"),
                               f"{name}_hi": F.lit(None).cast("double")}), []
    edges = cut_edges(lo, hi, bins)
    x = F.col(col)
    idx = F.when(x.isNotNull(), _count_above(x, edges[1:-1], strict=True) + 1)
    lo_map = F.create_map(*[v for k in range(bins) for v in (F.lit(k + 1), F.lit(edges[k]))])
    hi_map = F.create_map(*[v for k in range(bins) for v in (F.lit(k + 1), F.lit(edges[k + 1]))])
    out = df.withColumn(f"{name}_idx", idx.cast("int"))
    return out.withColumns({f"{name}_lo": lo_map[F.col(f"{name}_idx")],
                            f"{name}_hi": hi_map[F.col(f"{name}_idx")]}), edges


def bin_profile(binned: DataFrame, edges: Sequence[float], name: str = "bin") -> DataFrame:
    """Per bin mean defect count, mean error rate and total units; empty
    bins kept (means NULL, sum 0) by conditional aggregation in one pass."""
    n = len(edges) - 1
    b = F.col(f"{name}_idx")
    aggs = []
    for k in range(1, n + 1):
        aggs += [F.avg(F.when(b == k, F.col("defect_count"))).alias(f"d{k}"),
                 F.avg(F.when(b == k, F.col("error_rate"))).alias(f"e{k}"),
                 F.coalesce(F.sum(F.when(b == k, F.col("units_produced"))), F.lit(0)).cast("long").alias(f"u{k}"),
                 F.count_if(b == k).alias(f"n{k}")]
    return binned.agg(*aggs).select(F.inline(F.array(*[
        F.struct(F.lit(k).alias("bin_idx"), F.lit(edges[k - 1]).alias("bin_lo"), F.lit(edges[k]).alias("bin_hi"),
                 F.col(f"d{k}").alias("avg_defect_count"), F.col(f"e{k}").alias("avg_error_rate"),
                 F.col(f"u{k}").alias("total_units_produced"), F.col(f"n{k}").cast("long").alias("rows"))
        for k in range(1, n + 1)])))


def best_bin(profile: DataFrame, metric: str = "total_units_produced") -> DataFrame:
    """The bin with the most units (lowest bin on ties); top-1 is the feature."""
    return profile.orderBy(F.col(metric).desc(), F.col("bin_idx").asc()).limit(1)


# ------------------------------------------------------------------- KDE

#: Equal-width bins that a KDE's rows are first reduced to.
KDE_BINS = 1 << 16


def kde(df: DataFrame, col: str, gridsize: int = 200, cut_bw: float = 3.0, bins: int = KDE_BINS) -> DataFrame:
    """Gaussian KDE with Scott's bandwidth (sd * n^-1/5) on ``gridsize``
    points from min - 3 bw to max + 3 bw.

    At every size, rows are first reduced to (mean, count) of ``bins`` bins over
    the range (partial aggregation), and each bin that has rows is spread over
    the grid.  Bins with one distinct value are exact; else the error is of the
    order (bin width / bandwidth)^2, some 1e-8."""
    x = F.col(col).cast("double")
    st = df.agg(F.count(x).alias("n"), F.stddev_samp(x).alias("sd"), F.min(x).alias("lo"), F.max(x).alias("hi")).first()
    n, sd, lo, hi = st["n"], st["sd"], st["lo"], st["hi"]
    if not n or sd is None or sd == 0:
        return df.sparkSession.createDataFrame([], "i int, x double, density double")
    bw = sd * n ** (-1.0 / 5.0)
    g0, g1 = lo - cut_bw * bw, hi + cut_bw * bw
    step = (g1 - g0) / (gridsize - 1)
    b = F.least(F.floor((x - F.lit(lo)) / F.lit((hi - lo) / bins)), F.lit(bins - 1)).alias("b")
    vals = df.filter(x.isNotNull()).groupBy(b).agg(
        F.count(F.lit(1)).alias("w"), F.when(F.min(x) == F.max(x), F.min(x)).otherwise(F.avg(x)).alias("v"))
    norm = 1.0 / (n * bw * math.sqrt(2.0 * math.pi))
    spread = vals.select("v", "w", F.explode(F.sequence(F.lit(0), F.lit(gridsize - 1))).alias("i"))
    g = F.lit(g0) + F.col("i") * F.lit(step)
    u = (g - F.col("v")) / F.lit(bw)
    return (spread.groupBy("i").agg(F.sum(F.col("w") * F.exp(F.lit(-0.5) * u * u)).alias("s"))
            .select(F.col("i").cast("int").alias("i"), (F.lit(g0) + F.col("i") * F.lit(step)).alias("x"),
                    (F.col("s") * F.lit(norm)).alias("density")))
