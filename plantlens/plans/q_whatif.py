"""Registered queries W1-W8 (driver model and what-if) on the cleaned log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantlens.operators import whatif as W
from plantlens.operators.shared_kmeans import row_hash
from plantlens.plans import context as ctx
from plantlens.plans.oracle import on_clean
from plantlens.plans.registry import query, rnd, union
from plantlens.schema import RF_FEATURES11 as FEATS, RF_TARGETS3 as TARGETS

TARGET = "units_produced"
SCEN_KEYS = ["machine_id", "shift"]


def scenarios(df: DataFrame, keys=SCEN_KEYS) -> DataFrame:
    """Scenario rows derived from the data: mean feature vector per
    (machine, shift) and overall (the simulator's default sliders), one
    grouping-sets pass.  Rows without a key are in the overall scenario only."""
    keys = list(keys)
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    g = df.groupingSets([[F.col(k) for k in keys], []], *keys).agg(
        F.grouping_id().alias("_gid"), *[F.avg(f).alias(f) for f in FEATS])
    g = g.filter((F.col("_gid") != 0) | known)
    return g.select(F.when(F.col("_gid") == 0, F.concat_ws("|", *keys)).otherwise(F.lit("ALL")).alias("scenario"),
                    *FEATS)


#: Of 1,000 hashed rows so many train the model whose held-out accuracy is measured.
TRAIN = 800


def driver_rows(spark, sf) -> DataFrame:
    """The eleven features, the level of every target, and whether a row trains; written once
    per version: every fit scans this narrow table.  Rows of one time, machine, operator and
    product are on the same side of the split, on any engine."""
    ident = [F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"), *map(F.col, ("machine_id", "operator_id", "product_type"))]
    v = ctx.version(spark, sf)

    def build() -> DataFrame:
        rows, edges = ctx.clean(spark, sf), {}
        for t in TARGETS:
            rows, edges[t] = W.qcut(rows, t, 3, "drop", f"level_{t}")
        v.fits["driver-edges"] = edges
        return rows.select(*FEATS, *[f"level_{t}" for t in TARGETS], (row_hash(*ident) % 1000 < TRAIN).alias("train"))
    return v.table("driver-rows", build)


def _leveled(spark, sf, target: str) -> DataFrame:
    return driver_rows(spark, sf).select(*FEATS, F.col(f"level_{target}").alias("level"), "train")


def _model(spark, sf, target: str) -> W.Driver:
    """The forest of a target, fitted on every row, once per version of the tables."""
    return ctx.version(spark, sf).fit(f"driver-{target}", lambda: W.fit_driver(_leveled(spark, sf, target).drop("train"), FEATS))


def _per_target(make) -> DataFrame:
    """The union of ``make(target)`` over the three targets, with the target in front."""
    parts = [make(t) for t in TARGETS]
    out = parts[0].select(F.lit(TARGETS[0]).alias("target"), "*")
    for t, p in zip(TARGETS[1:], parts[1:]):
        out = out.unionByName(p.select(F.lit(t).alias("target"), "*"))
    return out


def _qcut_cte(target: str) -> str:
    return f""",
qe AS (SELECT min({target}) AS e0, quantile_cont({target}, 1.0E0 / 3.0E0) AS e1,
              quantile_cont({target}, 2.0E0 / 3.0E0) AS e2, max({target}) AS e3 FROM clean),
qu AS (SELECT DISTINCT e FROM (SELECT unnest([e0, e1, e2, e3]) AS e FROM qe) AS u),
qi AS (SELECT list(e ORDER BY e) AS edges FROM qu)"""


def _qcut_oracle(target: str) -> str:
    return on_clean(f"""SELECT {target}, CAST(lvl AS INTEGER) AS level,
  CASE lvl WHEN 0 THEN 'Low' WHEN 1 THEN 'Medium' WHEN 2 THEN 'High' END AS level_name, count(*) AS "rows"
FROM (SELECT {target}, (SELECT count(*) FROM (SELECT unnest(edges[2:len(edges) - 1]) AS e FROM qi) AS ie
                       WHERE {target} > ie.e) AS lvl FROM clean) AS l
GROUP BY {target}, lvl""", _qcut_cte(target))


def _qcut_query(spark, sf, target):
    lvl, _ = W.qcut(ctx.clean(spark, sf), target, 3, "drop")
    return lvl.groupBy(target, "level").agg(F.count(F.lit(1)).alias("rows")).select(
        target, "level", W.level_name(F.col("level")).alias("level_name"), "rows")


@query("qcut_units", _qcut_oracle(TARGET))
def qcut_units(spark, sf):
    """Units produced cut into tertile levels (right-closed, repeated
    edges dropped), with the level names."""
    return _qcut_query(spark, sf, TARGET)


@query("qcut_downtime", rnd(_qcut_oracle("downtime"), "downtime"))
def qcut_downtime(spark, sf):
    """W1 on downtime (mostly zeros): the repeated lower edges are dropped,
    leaving fewer levels (pandas' default would raise)."""
    return _qcut_query(spark, sf, "downtime")


@query("qcut_defects", _qcut_oracle("defect_count"))
def qcut_defects(spark, sf):
    """W1 on defect_count (0/1): repeated edges dropped."""
    return _qcut_query(spark, sf, "defect_count")


@query("feature_ranges", rnd(on_clean(union(*[
    f"""SELECT '{c}' AS feature, CAST(min({c}) AS DOUBLE) AS "min", CAST(max({c}) AS DOUBLE) AS "max",
  avg({c}) AS mean FROM clean""" for c in FEATS])), '"min"', '"max"', "mean"))
def feature_ranges(spark, sf):
    """Min, max and mean of the 11 model features."""
    return W.feature_ranges(ctx.clean(spark, sf), FEATS)


_SCEN_SQL = f""",
scen AS (SELECT machine_id || '|' || shift AS scenario, {', '.join(f'avg({f}) AS {f}' for f in FEATS)}
         FROM clean WHERE machine_id IS NOT NULL AND shift IS NOT NULL GROUP BY machine_id, shift
         UNION ALL SELECT 'ALL', {', '.join(f'avg({f})' for f in FEATS)} FROM clean),
vars AS (SELECT * FROM (VALUES {', '.join(f"('{f}')" for f in FEATS)}) AS v(variable))"""
_PICK = "CASE variable " + " ".join(f"WHEN '{f}' THEN {f}" for f in FEATS) + " END"


@query("scenario_bumps", rnd(on_clean(f"""SELECT scenario, variable, {_PICK} AS original,
  ({_PICK}) * 1.1E0 AS bumped FROM scen CROSS JOIN vars""", _SCEN_SQL), "original", "bumped"))
def scenario_bumps(spark, sf):
    """W6 input: every scenario with each feature raised by 10 % alone."""
    return W.bumps(scenarios(ctx.clean(spark, sf)), FEATS).select("scenario", "variable", "original", "bumped")


def _split_sql(target: str) -> str:
    return f"""SELECT '{target}' AS target, lvl AS level, CAST(count(*) FILTER (WHERE h < {TRAIN}) AS BIGINT) AS train_rows,
  CAST(count(*) FILTER (WHERE h >= {TRAIN}) AS BIGINT) AS test_rows FROM (
  SELECT CAST((SELECT count(*) FROM (SELECT unnest(edges[2:len(edges) - 1]) AS e FROM qi_{target}) AS ie WHERE {target} > ie.e) AS INTEGER) AS lvl, h
  FROM driver) AS q GROUP BY lvl"""


_SPLIT = "".join(_qcut_cte(t).replace("qe AS", f"qe_{t} AS").replace("FROM qe)", f"FROM qe_{t})").replace("qu AS", f"qu_{t} AS")
                 .replace("FROM qu)", f"FROM qu_{t})").replace("qi AS", f"qi_{t} AS") for t in TARGETS) + f""",
driver AS (SELECT {', '.join(TARGETS)}, ('0x' || substr(md5(concat_ws('|', coalesce(strftime("timestamp", '%Y-%m-%d %H:%M:%S'), ''),
  coalesce(machine_id, ''), coalesce(operator_id, ''), coalesce(product_type, ''))), 1, 13))::BIGINT % 2147483647 % 1000 AS h FROM clean)"""


@query("driver_split", on_clean(union(*map(_split_sql, TARGETS)), _SPLIT))
def driver_split(spark, sf):
    """Training and held-out rows of every level of every target."""
    return _per_target(lambda t: _leveled(spark, sf, t).groupBy("level").agg(
        F.count_if("train").alias("train_rows"), F.count_if(~F.col("train")).alias("test_rows")))


def _metrics(spark, sf, target: str) -> tuple:
    """(levels, training rows, test rows, accuracy, majority's accuracy); fitted once per version."""
    def build():
        rows = _leveled(spark, sf, target)
        model = W.fit_driver(rows.where("train").drop("train"), FEATS)
        hits = W.score(model, rows.where("NOT train")).groupBy("level").agg(
            F.count(F.lit(1)).alias("n"), F.count_if(F.col("predicted") == F.col("level")).alias("hit")).collect()
        n = sum(r["n"] for r in hits)
        levels = len(ctx.version(spark, sf).fits["driver-edges"][target]) - 1
        return (levels, rows.where("train").count(), n, sum(r["hit"] for r in hits) / n if n else None, max(r["n"] for r in hits) / n if n else None)
    driver_rows(spark, sf)
    return ctx.version(spark, sf).fit(f"driver-metrics-{target}", build)


@query("driver_model_metrics", kind="P")
def driver_model_metrics(spark, sf):
    """Held-out accuracy of the random forest per target (80/20 split by row hash), beside
    the accuracy of always guessing the most frequent level."""
    return spark.createDataFrame([(t, *_metrics(spark, sf, t)) for t in TARGETS],
                                 "target string, levels int, train_rows long, test_rows long, accuracy double, majority double")


@query("driver_importance", kind="P")
def driver_importance(spark, sf):
    """Feature importances of the forests fitted on every row."""
    return _per_target(lambda t: spark.createDataFrame(W.importance(_model(spark, sf, t)), "feature string, importance double"))


@query("scenario_scores", kind="P")
def scenario_scores(spark, sf):
    """Predicted level of every scenario row, per target."""
    scen = scenarios(ctx.clean(spark, sf))
    return _per_target(lambda t: W.score(_model(spark, sf, t), scen).select("scenario", "predicted", "predicted_level"))


def _sens(spark, sf, target: str) -> DataFrame:
    return W.sensitivity(_model(spark, sf, target), scenarios(ctx.clean(spark, sf)))


@query("sensitivity_10pct", kind="P")
def sensitivity_10pct(spark, sf):
    """Level before and after +10 % on each feature, per target and scenario."""
    return _per_target(lambda t: _sens(spark, sf, t).select("scenario", "variable", "original_level", "after_level", "changed"))


@query("sensitivity_flip_rate", kind="P")
def sensitivity_flip_rate(spark, sf):
    """Per target and variable the share of scenarios whose level flips."""
    return _per_target(lambda t: W.flip_rate(_sens(spark, sf, t)))
