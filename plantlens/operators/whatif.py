"""Quantile levels, the driver model, feature ranges and what-if
sensitivity over scenario tables.

The interactive simulator of the analysis scored one slider row; here a
scenario is any DataFrame of feature rows (derived from the data), scored in
one ``transform``.  The +10 % sensitivity fans each scenario row out over the
feature list with ``explode`` (a constant fan-out of len(features)), so one
model pass scores every bump of every scenario.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantlens.functions.stats import quantiles
from plantlens.operators import forest

# Class -> level name of the what-if page.
LEVELS = {0: "Low", 1: "Medium", 2: "High"}


class DuplicateEdges(ValueError):
    """qcut edges repeat (pandas: 'Bin edges must be unique')."""


def qcut_edges(df: DataFrame, col: str, q: int = 3, duplicates: str = "drop") -> list[float]:
    """W1 edges: exact quantiles at 0, 1/q, ..., 1 (linear interpolation).
    Repeated edges raise (``duplicates='raise'``, pandas' default) or are
    dropped, leaving fewer bins."""
    probs = [i / q for i in range(q + 1)]
    edges = quantiles(df, [col], probs)[col]
    if any(e is None for e in edges):
        return []
    uniq = sorted(set(edges))
    if len(uniq) < len(edges):
        if duplicates == "raise":
            raise DuplicateEdges(f"Bin edges must be unique: {edges}")
        edges = uniq
    return edges


def level_of(x: Column, edges: Sequence[float]) -> Column:
    """Right-closed bins over ``edges`` with the lowest edge included: the
    number of interior edges strictly below x (0-based level)."""
    out = F.lit(0)
    for e in edges[1:-1]:
        out = out + F.when(x > F.lit(e), 1).otherwise(0)
    return F.when(x.isNotNull() & (x >= F.lit(edges[0])) & (x <= F.lit(edges[-1])), out)


def level_name(level: Column) -> Column:
    """{0, 1, 2} -> Low / Medium / High."""
    return F.create_map(*[v for k, n in LEVELS.items() for v in (F.lit(k), F.lit(n))])[level]


def qcut(df: DataFrame, col: str, q: int = 3, duplicates: str = "drop", name: str = "level") -> tuple[DataFrame, list]:
    edges = qcut_edges(df, col, q, duplicates)
    if not edges:
        return df.withColumn(name, F.lit(None).cast("int")), edges
    return df.withColumn(name, level_of(F.col(col), edges).cast("int")), edges


def feature_ranges(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Min, max and mean of every feature (the slider ranges), one pass."""
    cols = list(cols)
    agg = df.agg(*[x for c in cols for x in (F.min(F.col(c).cast("double")).alias(f"lo_{c}"),
                                              F.max(F.col(c).cast("double")).alias(f"hi_{c}"),
                                              F.avg(c).alias(f"m_{c}"))])
    return agg.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"lo_{c}").alias("min"), F.col(f"hi_{c}").alias("max"),
                 F.col(f"m_{c}").alias("mean")) for c in cols])))


@dataclass
class Driver:
    """A fitted driver model, and the feature means that stand in for missing values."""

    model: object
    features: list[str]
    means: dict[str, float]

    def filled(self, df: DataFrame) -> DataFrame:
        return df.withColumns({f: F.coalesce(F.col(f).cast("double"), F.lit(self.means[f])) for f in self.features})


#: Training rows up to which Spark ML grows the trees: it keeps about 1,000 bytes a row, in memory or on
#: disk.  More rows are packed to some 16 bytes (``forest``).
ML_ROWS = 1_000_000
#: Training rows that stay in the tasks they are in: one core has done with them soon.
FEW_ROWS = 100_000
#: Training rows of a task: fewer are not worth a task's own statistics of every node, more would
#: be a large cached block (a row is kept with its count in, and its node of, every tree).
LEAST_ROWS, MOST_ROWS = 25_000, 500_000


def spread(train: DataFrame, few: int = FEW_ROWS, least: int = LEAST_ROWS, most: int = MOST_ROWS) -> DataFrame:
    """The rows in equal shares over all cores, as a narrow table is a few files, often one with one
    row group, that is, one task; the passes of a forest are bound by the processor."""
    rows, cores = train.count(), train.sparkSession.sparkContext.defaultParallelism
    if rows <= few:
        return train
    tasks = min(cores, math.ceil(rows / least)) if rows <= cores * most else cores * math.ceil(rows / (cores * most))
    return train.repartition(tasks)


def fit_driver(train: DataFrame, features: Sequence[str], label: str = "level", trees: int = 100,
               depth: int = 12, seed: int = 42) -> Driver:
    """Random forest on the feature columns -> level (Spark ML).

    ``depth`` is a model parameter (sklearn grows trees without a limit, Spark
    to 30 at most).  A missing feature counts as the feature's mean, in
    training and in scoring.  More than ``ML_ROWS`` rows are packed and scanned level by level
    (``forest.fit``).  Fewer are spread over all cores and cached for the fit; a task
    holds 512 MB of node statistics at most, as all cores of an executor hold some at once."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    features = list(features)
    train = train.filter(F.col(label).isNotNull())
    row = train.agg(F.count(F.lit(1)).alias("_rows"), *[F.avg(f).alias(f) for f in features]).first()
    driver = Driver(None, features, {f: 0.0 if row[f] is None else float(row[f]) for f in features})
    if row["_rows"] > ML_ROWS:
        driver.model = forest.fit(driver.filled(train), features, label, row["_rows"], trees, depth, seed)
        return driver
    known = spread(train).persist()
    pipe = Pipeline(stages=[
        VectorAssembler(inputCols=features, outputCol="features", handleInvalid="error"),
        RandomForestClassifier(featuresCol="features", labelCol=label, numTrees=trees, maxDepth=depth,
                               seed=seed, cacheNodeIds=True, maxMemoryInMB=512)])
    try:
        driver.model = pipe.fit(driver.filled(known))
    finally:
        known.unpersist()
    return driver


def importance(driver: Driver) -> list[tuple[str, float]]:
    """Feature importances, largest first."""
    own = isinstance(driver.model, forest.Forest)
    imp = driver.model.importances() if own else driver.model.stages[-1].featureImportances.toArray()
    return sorted(zip(driver.features, (float(v) for v in imp)), key=lambda t: (-t[1], t[0]))


def score(driver: Driver, scenarios: DataFrame, out: str = "predicted") -> DataFrame:
    """Predicted level (and its name) of every scenario row."""
    s = driver.model.transform(driver.filled(scenarios))
    return (s.withColumn(out, F.col("prediction").cast("int"))
            .withColumn(out + "_level", level_name(F.col(out)))
            .drop("features", "rawPrediction", "probability", "prediction"))


def hash_split(df: DataFrame, cols: Sequence[str], train: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """A split by the rows' values: the same whatever the partitioning; equal rows stay together."""
    inside = F.pmod(F.xxhash64(*cols), F.lit(1000)) < int(train * 1000)
    return df.filter(inside), df.filter(~inside)


def bumps(scenarios: DataFrame, features: Sequence[str], pct: float = 0.10, key: str = "scenario") -> DataFrame:
    """The bump table: every scenario x every feature, that feature x (1 + pct).
    Columns: key, variable, original, bumped, then the (bumped) features."""
    features = list(features)
    fan = scenarios.withColumn("variable", F.explode(F.array(*[F.lit(f) for f in features])))
    pick = None
    for f in features:
        pick = F.when(F.col("variable") == f, F.col(f)) if pick is None else pick.when(F.col("variable") == f, F.col(f))
    fan = fan.withColumn("original", pick).withColumn("bumped", F.col("original") * F.lit(1.0 + pct))
    return fan.withColumns({f: F.when(F.col("variable") == f, F.col("bumped")).otherwise(F.col(f))
                            for f in features})


def sensitivity(driver: Driver, scenarios: DataFrame, pct: float = 0.10, key: str = "scenario") -> DataFrame:
    """Level before and after raising each feature alone by ``pct``;
    two model passes (base, bumped) over scenarios and scenarios x features."""
    base = score(driver, scenarios).select(key, F.col("predicted").alias("original_level_id"),
                                          F.col("predicted_level").alias("original_level"))
    after = score(driver, bumps(driver.filled(scenarios), driver.features, pct, key)).select(
        key, "variable", F.col("predicted").alias("after_level_id"), F.col("predicted_level").alias("after_level"))
    return after.join(base, key).withColumn("changed", F.col("after_level_id") != F.col("original_level_id"))


def flip_rate(sens: DataFrame) -> DataFrame:
    """Per variable the share of scenarios whose level changes."""
    return sens.groupBy("variable").agg(F.count(F.lit(1)).alias("scenarios"),
                                        F.count_if("changed").alias("flipped"),
                                        F.avg(F.col("changed").cast("double")).alias("flip_rate"))
