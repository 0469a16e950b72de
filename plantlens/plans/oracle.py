"""Independent DuckDB restatements of the operators (the correctness oracle).

Each oracle is one SQL statement over the driver's views ``lineitem``,
``orders``, ``part`` (and ``events``): the `plant` mapping, then the
operator's semantics written directly in SQL (``quantile_cont``, ``avg``,
``CASE``...), not generated from the Spark plan.
"""

from __future__ import annotations

from plantlens.schema import CLIP14
from plantlens.sources.plant import PLANT_SQL

# plant columns that can be NULL (the only ones mean-imputation changes)
NULLABLE = ["temperature", "vibration_level", "power_consumption"]


def imputed_sql() -> str:
    means = ", ".join(f"avg({c}) AS m_{c}" for c in NULLABLE)
    repl = ", ".join(f"coalesce({c}, m_{c}) AS {c}" for c in NULLABLE)
    return f""",
means AS (SELECT {means} FROM plant),
imputed AS (SELECT plant.* REPLACE ({repl}) FROM plant CROSS JOIN means)"""


def quartiles_sql(src: str, cols, name: str) -> str:
    qs = ", ".join(f"quantile_cont({c}, 0.25) AS q1_{c}, quantile_cont({c}, 0.75) AS q3_{c}"
                   for c in cols)
    return f",\n{name} AS (SELECT {qs} FROM {src})"


def lower(c: str) -> str:
    return f"(q1_{c} - 1.5E0 * (q3_{c} - q1_{c}))"


def upper(c: str) -> str:
    return f"(q3_{c} + 1.5E0 * (q3_{c} - q1_{c}))"


def clean_sql() -> str:
    repl = ", ".join(f"least(greatest({c}, {lower(c)}), {upper(c)}) AS {c}" for c in CLIP14)
    return (imputed_sql() + quartiles_sql("imputed", CLIP14, "fences")
            + f""",
clean AS (SELECT imputed.* REPLACE ({repl}) FROM imputed CROSS JOIN fences)""")


def with_plant(*parts: str) -> str:
    return "WITH RECURSIVE " + PLANT_SQL.strip() + "".join(parts)


def on_plant(select: str) -> str:
    return with_plant() + "\n" + select


def on_imputed(select: str) -> str:
    return with_plant(imputed_sql()) + "\n" + select


def on_clean(select: str, *extra: str) -> str:
    return with_plant(clean_sql(), *extra) + "\n" + select



def zscore_sql(src: str, cols, name: str, suffix: str = "_z") -> str:
    """CTE ``{name}``: ``src`` plus population z-scores of ``cols``."""
    st = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in cols)
    zs = ", ".join(f"CASE WHEN s_{c} = 0 OR s_{c} IS NULL THEN 0.0E0 ELSE ({c} - m_{c}) / s_{c} END AS {c}{suffix}"
                   for c in cols)
    return f""",
{name}_st AS (SELECT {st} FROM {src}),
{name} AS (SELECT {src}.*, {zs} FROM {src} CROSS JOIN {name}_st)"""


def _dist(cols, cref: str, j: int) -> str:
    return " + ".join(f"({c} - {cref}.c{j}_{i}) * ({c} - {cref}.c{j}_{i})" for i, c in enumerate(cols))


def _argmin(k: int) -> str:
    if k == 1:
        return "0"
    parts = []
    for j in range(k - 1):
        cond = " AND ".join(f"d{j} <= d{j2}" for j2 in range(j + 1, k))
        parts.append(f"WHEN {cond} THEN {j}")
    return "CASE " + " ".join(parts) + f" ELSE {k - 1} END"


def lloyd_sql(src: str, cols, k: int, init_col: str, name: str, rounds: int = 60) -> str:
    """CTEs for deterministic Lloyd K-Means run well past rest (at a fixed point further
    rounds change nothing); ``{name}`` = src + ``lbl``.  The centres are one row per round
    of a recursive CTE."""
    cs = [f"c{j}_{i}" for j in range(k) for i in range(len(cols))]
    band = (f"CASE WHEN hi = lo THEN 0 ELSE CAST(least(floor(({init_col} - lo) / (hi - lo) * {float(k)}E0), {k - 1}) AS INTEGER) END")
    first = ", ".join(f"avg({c}) FILTER (WHERE lbl = {j}) AS c{j}_{i}" for j in range(k) for i, c in enumerate(cols))
    # a band without rows has no centre: its distance is infinite
    far = "CAST('infinity' AS DOUBLE)"
    dists = ", ".join(f"coalesce({_dist(cols, 'c', j)}, {far}) AS d{j}" for j in range(k))
    step = ", ".join(f"coalesce(avg({c}) FILTER (WHERE lbl = {j}), any_value(c{j}_{i})) AS c{j}_{i}"
                     for j in range(k) for i, c in enumerate(cols))
    keep = ", ".join(dict.fromkeys([*cols, init_col]))
    return f""",
{name}_x AS MATERIALIZED (SELECT {keep} FROM {src}),
{name}_b AS (SELECT min({init_col}) AS lo, max({init_col}) AS hi FROM {name}_x),
{name}_r AS (
  SELECT 0 AS t, {first} FROM (SELECT x.*, {band} AS lbl FROM {name}_x AS x CROSS JOIN {name}_b) AS q
  UNION ALL
  SELECT t + 1, {step} FROM (SELECT *, {_argmin(k)} AS lbl FROM
    (SELECT x.*, c.*, {dists} FROM {name}_x AS x CROSS JOIN {name}_r AS c WHERE c.t < {rounds}) AS d) AS q
  GROUP BY t),
{name}_c AS MATERIALIZED (SELECT {', '.join(cs)} FROM {name}_r WHERE t = {rounds}),
{name} AS (SELECT * EXCLUDE ({', '.join(f'd{j}' for j in range(k))}), {_argmin(k)} AS lbl
  FROM (SELECT s.*, {dists} FROM {src} AS s CROSS JOIN {name}_c AS c) AS q)"""


def restarts_sql(src: str, cols, key: str, k: int, restarts: int, name: str, rounds: int = 60) -> str:
    """CTEs for K-Means seeded by squared distance (a row's key is -ln(u) / D^2, the smallest
    is drawn), ``restarts`` times, run well past rest; ``{name}`` = src + ``lbl`` under the centres of
    least cost.  ``key``: a list of the columns that tell rows apart."""
    p = 2147483647
    d = range(len(cols))

    def u(step: int) -> str:
        n = f"(1 + 101 * r + {step})"
        return (f"((h * (1 + ({n} * 48271 * 40014 + 12345) % {p - 1}) + ({n} * 69621 * 16807 + 54321) % {p}) % {p} + 1) / {p + 1}.0E0")

    out = f""",
{name}_x AS MATERIALIZED (SELECT {', '.join(cols)}, ('0x' || substr(md5(concat_ws('|', {key})), 1, 13))::BIGINT % {p} AS h FROM {src}),
{name}_s0 AS (SELECT r, arg_min([{', '.join(cols)}], -ln({u(0)})) AS c0 FROM {name}_x CROSS JOIN range({restarts}) AS q(r) GROUP BY r)"""
    for step in range(1, k):
        dists = [" + ".join(f"({c} - c{j}[{i + 1}]) * ({c} - c{j}[{i + 1}])" for i, c in enumerate(cols)) for j in range(step)]
        least = dists[0] if step == 1 else f"least({', '.join(dists)})"
        olds = ", ".join(f"any_value(c{j}) AS c{j}" for j in range(step))
        out += f""",
{name}_s{step} AS (SELECT r, {olds}, arg_min([{', '.join(cols)}], -ln(u) / dd) FILTER (WHERE dd > 0) AS c{step}
  FROM (SELECT *, {u(step)} AS u, {least} AS dd FROM {name}_x CROSS JOIN {name}_s{step - 1}) AS q GROUP BY r)"""
    cs = [f"c{j}_{i}" for j in range(k) for i in d]
    dists = ", ".join(f"coalesce({_dist(cols, 'c', j)}, CAST('infinity' AS DOUBLE)) AS d{j}" for j in range(k))
    step = ", ".join(f"coalesce(avg({c}) FILTER (WHERE lbl = {j}), any_value(c{j}_{i})) AS c{j}_{i}" for j in range(k) for i, c in enumerate(cols))
    least = "least(" + ", ".join(f"d{j}" for j in range(k)) + ")"
    return out + f""",
{name}_r AS (
  SELECT 0 AS t, r, {', '.join(f'c{j}[{i + 1}] AS c{j}_{i}' for j in range(k) for i in d)} FROM {name}_s{k - 1}
  UNION ALL
  SELECT t + 1, r, {step} FROM (SELECT *, {_argmin(k)} AS lbl FROM
    (SELECT x.*, c.*, {dists} FROM {name}_x AS x CROSS JOIN {name}_r AS c WHERE c.t < {rounds}) AS d) AS q
  GROUP BY t, r),
{name}_f AS MATERIALIZED (SELECT * FROM {name}_r WHERE t = {rounds}),
{name}_c AS MATERIALIZED (SELECT {', '.join(cs)} FROM {name}_f WHERE r = (
  SELECT r FROM (SELECT r, sum({least}) AS cost FROM (SELECT c.r, {dists} FROM {name}_x CROSS JOIN {name}_f AS c) AS q GROUP BY r)
  ORDER BY cost, r LIMIT 1)),
{name} AS (SELECT * EXCLUDE ({', '.join(f'd{j}' for j in range(k))}), {_argmin(k)} AS lbl
  FROM (SELECT s.*, {dists} FROM {src} AS s CROSS JOIN {name}_c AS c) AS q)"""


def inertia_sql(src: str, cols, k: int, cref: str) -> str:
    """Scalar subquery: within-cluster sum of squares of ``src`` around the centres ``cref``."""
    dists = [f"coalesce({_dist(cols, 'c', j)}, CAST('infinity' AS DOUBLE))" for j in range(k)]
    least = dists[0] if k == 1 else f"least({', '.join(dists)})"
    return f"(SELECT sum({least}) FROM {src} CROSS JOIN {cref} AS c)"


def components_sql(src: str, cols, name: str, rounds: int = 3000) -> str:
    """CTE ``{name}``: loadings a0.. and b0.. of the first two principal components of the
    centred columns, by power iteration and deflation; each component's largest loading
    (by magnitude, first on ties) is positive."""
    d = range(len(cols))
    m = ", ".join(f"avg({cols[i]} * {cols[j]}) AS m{i}_{j}" for i in d for j in d)

    def power(out: str, mat: str, v: str) -> str:
        w = ", ".join("(" + " + ".join(f"m{i}_{j} * {v}{j}" for j in d) + f") AS w{i}" for i in d)
        norm = "sqrt(" + " + ".join(f"w{i} * w{i}" for i in d) + ")"
        start = ", ".join(f"CAST({1 / (i + 1)} AS DOUBLE) AS {v}{i}" for i in d)
        sign = f"(CASE WHEN list_max([{', '.join(f'{v}{i}' for i in d)}]) >= -list_min([{', '.join(f'{v}{i}' for i in d)}]) THEN 1 ELSE -1 END)"
        return f""",
{out}_r AS (SELECT 0 AS t, {start}
  UNION ALL SELECT t + 1, {', '.join(f'w{i} / {norm} AS {v}{i}' for i in d)}
  FROM (SELECT t, {w} FROM {out}_r CROSS JOIN {mat} WHERE t < {rounds}) AS q),
{out} AS MATERIALIZED (SELECT {', '.join(f'{sign} * {v}{i} AS {v}{i}' for i in d)} FROM {out}_r WHERE t = {rounds})"""

    lam = " + ".join(f"a{i} * m{i}_{j} * a{j}" for i in d for j in d)
    deflated = ", ".join(f"m{i}_{j} - lam * a{i} * a{j} AS m{i}_{j}" for i in d for j in d)
    return (f",\n{name}_m AS MATERIALIZED (SELECT {m} FROM {src})" + power(f"{name}_1", f"{name}_m", "a")
            + f""",
{name}_d AS MATERIALIZED (SELECT {deflated} FROM (SELECT *, {lam} AS lam FROM {name}_m CROSS JOIN {name}_1) AS q)"""
            + power(f"{name}_2", f"{name}_d", "b") + f",\n{name} AS (SELECT * FROM {name}_1 CROSS JOIN {name}_2)")
