"""The driver forest's training rows: every core has its share of them."""
from pyspark.sql import functions as F

from plantlens.operators import whatif as W


def test_training_rows_are_spread_over_all_cores(spark):
    cores = spark.sparkContext.defaultParallelism
    one = spark.range(120_000).coalesce(1)
    got = W.spread(one)
    assert got.rdd.getNumPartitions() == min(cores, 5)
    assert max(got.rdd.glom().map(len).collect()) < 1.2 * 120_000 / min(cores, 5)
    assert got.exceptAll(one).count() == one.exceptAll(got).count() == 0
    assert W.spread(one, few=100, least=10, most=10_000).rdd.getNumPartitions() == cores * -(-12 // cores)
    assert W.spread(spark.range(100).coalesce(1)).rdd.getNumPartitions() == 1
    assert W.spread(spark.range(0)).count() == 0


def test_a_forest_is_fitted_on_all_cores(spark, monkeypatch):
    monkeypatch.setattr(W.spread, "__defaults__", (100, 50, 1_000))
    rows = spark.range(400).coalesce(1).select((F.col("id") % 20).cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("b"))
    rows = rows.withColumn("level", F.when(F.col("a") < 3, None).otherwise((F.col("a") > 10).cast("int")))
    seen, spread = [], W.spread
    monkeypatch.setattr(W, "spread", lambda df: seen.append(spread(df)) or seen[-1])
    driver = W.fit_driver(rows, ["a", "b"], trees=5, depth=3)
    assert seen[0].rdd.getNumPartitions() == min(spark.sparkContext.defaultParallelism, 7) and seen[0].count() == 340
    assert seen[0].storageLevel.useMemory is False  # the cache ends with the fit
    assert W.score(driver, rows.where("level IS NOT NULL")).where("predicted = level").count() > 330
