"""Late readings kept and counted, and live windows that survive a restart.

``split_late`` drains a stream batch by batch with an explicit watermark: a batch's
watermark is the largest event time of the batches before it less the delay.
Readings older than it go to a side table with the batch and the watermark that they missed; the
others are reduced to partial results as in a replay.  Every batch owns a folder of each
table, so a batch that runs again after a failure rewrites its own rows, and the
watermark, which is read from the written marks of earlier batches, is the same again.

``run_live`` runs a live append query over what is there and stops; called again with
the same folder it resumes from its checkpoint.  ``open_windows`` reads the windows that
such a query still holds, from its state store.

``by_arrival`` replays a stored log as such a stream, in steps of arrival.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plantlens.session import scratch_path

#: A late reading: when and where it was taken, and the watermark that it missed.
LATE = "machine_id string, event_time timestamp, batch long, watermark timestamp"


def _read(spark: SparkSession, path: str, schema) -> DataFrame:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def split_late(spark: SparkSession, sdf: DataFrame, base: str, delay_s: int,
               reduce: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Run everything available: (partial results of the readings in time, late readings).
    Readings without an event time are in neither."""
    def keep(df: DataFrame, batch: int) -> None:
        earlier = _read(spark, f"{base}/marks", "latest timestamp, batch long").where(F.col("batch") < batch)
        latest = earlier.agg(F.max("latest").alias("m")).first()["m"]  # one row per batch
        mark = F.lit(None).cast("timestamp") if latest is None else F.timestamp_seconds(F.unix_seconds(F.lit(latest)) - delay_s)
        timed = df.where(F.col("event_time").isNotNull()).withColumn("_mark", mark)
        in_time = F.col("_mark").isNull() | (F.col("event_time") >= F.col("_mark"))
        reduce(timed.where(in_time).drop("_mark")).write.mode("overwrite").parquet(f"{base}/parts/batch={batch}")
        (timed.where(~in_time).select("machine_id", "event_time", F.col("_mark").alias("watermark"))
         .write.mode("overwrite").parquet(f"{base}/late/batch={batch}"))
        timed.agg(F.max("event_time").alias("latest")).where("latest IS NOT NULL").write.mode("overwrite").parquet(f"{base}/marks/batch={batch}")

    q = sdf.writeStream.foreachBatch(keep).option("checkpointLocation", f"{base}/ckpt").trigger(availableNow=True).start()
    try:
        q.awaitTermination()
    finally:
        if q.isActive:
            q.stop()
    return split_results(spark, base, sdf, reduce)


def split_results(spark: SparkSession, base: str, rows: DataFrame, reduce: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """What ``split_late`` has written to ``base`` so far; ``rows`` has the stream's columns."""
    parts = reduce(spark.createDataFrame([], rows.schema))
    return _read(spark, f"{base}/parts", parts.schema).select(*parts.columns), _read(spark, f"{base}/late", LATE)


def late_counts(late: DataFrame) -> DataFrame:
    """Late readings per machine: how many, and the most minutes behind the watermark."""
    behind = (F.unix_seconds("watermark") - F.unix_seconds("event_time")) / F.lit(60)
    return late.groupBy("machine_id").agg(F.count(F.lit(1)).alias("n_late"), F.max(behind).alias("most_minutes_late"))


def run_live(spark: SparkSession, sdf: DataFrame, base: str) -> DataFrame:
    """Run a live append query over the available files and stop; what it has emitted so far.
    Another call goes on from the checkpoint."""
    q = (sdf.writeStream.format("parquet").outputMode("append").option("path", f"{base}/out")
         .option("checkpointLocation", f"{base}/ckpt").trigger(availableNow=True).start())
    try:
        q.awaitTermination()
    finally:
        if q.isActive:
            q.stop()
    return spark.read.schema(sdf.schema).parquet(f"{base}/out")


def open_windows(spark: SparkSession, base: str, key: str = "machine_id") -> DataFrame:
    """The windows that a stopped live query (one window per key) holds in its state: key,
    start and end of the window."""
    state = spark.read.format("statestore").load(f"{base}/ckpt")
    return state.select(F.col(f"key.{key}").alias(key), F.col("key.window.start").alias("start"), F.col("key.window.end").alias("end"))


def arrivals(log: DataFrame, n_files: int) -> DataFrame:
    """The log with the file (0..n_files - 1) in which each reading arrives: in the order of
    event time, but every seventh machine-minute ten hours after it was taken."""
    minute = F.floor(F.unix_seconds("event_time") / F.lit(60))
    arrives = minute + F.when(minute % 7 == 0, 600).otherwise(0)
    lo, hi = log.agg(F.min(minute), F.max(minute)).first()
    if lo is None:
        return log.withColumn("file", F.lit(0))
    return log.withColumn("file", F.least(F.floor((arrives - lo) * n_files / F.lit(hi - lo + 1)), F.lit(n_files - 1)).cast("int"))


def by_arrival(log: DataFrame, n_steps: int, run: Callable[[DataFrame], object]) -> list:
    """Let the log arrive in steps in a folder, and after each step ``run`` the stream over the
    folder: one micro-batch per step, each run resumed from the checkpoint of the one before.
    Returns what ``run`` returned."""
    spark, path = log.sparkSession, scratch_path(log.sparkSession, "arrivals")
    placed, out = arrivals(log, n_steps), []
    for k in range(n_steps):
        placed.where(F.col("file") == k).drop("file").write.mode("append").parquet(path)
        out.append(run(spark.readStream.schema(log.schema).parquet(path)))
    return out
