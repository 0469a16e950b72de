"""The plant measures on an event stream (Structured Streaming).

Two ways to run them, for two situations:

* live: ``stream_kpi``, ``stream_alarm``, ... on a stream whose disorder is
  bounded.  Watermarked windows in append mode: a window is emitted once the
  watermark (max event time - delay) passes its end, so state stays bounded,
  and rows later than the delay are dropped by the watermark.
* replay: ``drain`` over stored files in any time order.  Every micro-batch is
  reduced to additive partial results (window sums, distinct readings) and
  written under its batch id, which makes a repeated batch harmless; the
  ``*_total`` functions merge the partials of all batches.  There is no
  watermark, so no row is late, no window is withheld at the end, and the
  answer does not depend on how the files are split or ordered.

The reductions are map-side combined, so a hot machine is a few rows per task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plantlens.operators.cluster import nearest
from plantlens.sources.plant import plant_from_tables

EPOCH_NTZ = "1970-01-01 00:00:00"


def ntz_to_instant(c: Column) -> Column:
    """TIMESTAMP_NTZ wall clock -> TIMESTAMP instant read as UTC (watermarks
    need TIMESTAMP; epoch arithmetic keeps window alignment independent of
    the session time zone)."""
    secs = F.timestamp_diff("MICROSECOND", F.lit(EPOCH_NTZ).cast("timestamp_ntz"), c)
    return F.timestamp_micros(secs)


def instant_text(c: Column) -> Column:
    """TIMESTAMP instant -> 'yyyy-MM-dd HH:mm:ss' of its UTC wall clock."""
    ntz = F.timestamp_add("SECOND", F.unix_seconds(c), F.lit(EPOCH_NTZ).cast("timestamp_ntz"))
    return F.date_format(ntz, "yyyy-MM-dd HH:mm:ss")


def file_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """A Parquet table (one file or a folder of part files) as a stream."""
    rs = spark.readStream.schema(spark.read.parquet(path).schema)
    if max_files:
        rs = rs.option("maxFilesPerTrigger", max_files)
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isFile():
        # a stream's source is a folder: the file's, and of it just this file
        return rs.option("pathGlobFilter", p.getName()).parquet(p.getParent().toString())
    return rs.parquet(path)


def plant_stream(spark: SparkSession, sf_dir: str, max_files: int | None = None) -> DataFrame:
    """The factory log as a stream: new lineitem files flow in and are joined
    (stream-static, stateless) to orders and part.  Adds ``event_time``
    (TIMESTAMP) for watermarking."""
    return log_stream(file_stream(spark, f"{sf_dir}/lineitem.parquet", max_files),
                      spark.read.parquet(f"{sf_dir}/orders.parquet"), spark.read.parquet(f"{sf_dir}/part.parquet"))


def log_stream(lineitem_stream: DataFrame, orders: DataFrame, part: DataFrame) -> DataFrame:
    log = plant_from_tables(lineitem_stream, orders, part)
    return log.withColumn("event_time", ntz_to_instant(F.col("timestamp")))


def _window_cols(w: str = "window") -> list[Column]:
    return [instant_text(F.col(f"{w}.start")).alias("window_start"),
            instant_text(F.col(f"{w}.end")).alias("window_end")]


def stream_kpi(sdf: DataFrame, every: str = "1 hour", watermark: str = "10 minutes",
               key: str = "machine_id") -> DataFrame:
    """Tumbling-window KPIs per machine: rows, units, defects, downtime,
    downtime frequency, availability (rows mode) and quality."""
    down = F.col("downtime") > 0
    n, u, d = F.count(F.lit(1)), F.sum("units_produced").cast("long"), F.sum("defect_count").cast("long")
    agg = (sdf.withWatermark("event_time", watermark)
           .groupBy(F.window("event_time", every), key)
           .agg(n.alias("rows"), u.alias("total_units"), d.alias("total_defects"),
                F.sum("downtime").alias("total_downtime"), F.count_if(down).alias("downtime_freq")))
    return agg.select(key, *_window_cols(), "rows", "total_units", "total_defects", "total_downtime",
                      "downtime_freq",
                      ((F.col("rows") - F.col("downtime_freq")) / F.col("rows")).alias("availability"),
                      F.try_divide((F.col("total_units") - F.col("total_defects")).cast("double"),
                                   F.nullif(F.col("total_units"), F.lit(0))).alias("quality"))


def stream_alarm(sdf: DataFrame, size: str = "1 hour", slide: str = "15 minutes", watermark: str = "10 minutes",
                 threshold: float = 0.4, key: str = "machine_id") -> DataFrame:
    """Sliding-window share of rows with downtime per machine, flagged
    when above ``threshold``."""
    down = F.col("downtime") > 0
    agg = (sdf.withWatermark("event_time", watermark)
           .groupBy(F.window("event_time", size, slide), key)
           .agg(F.count(F.lit(1)).alias("rows"), F.count_if(down).alias("down_rows")))
    share = F.col("down_rows") / F.col("rows")
    return agg.select(key, *_window_cols(), "rows", "down_rows", share.alias("down_share"),
                      (share > F.lit(threshold)).alias("alarm"))


def stream_episodes(sdf: DataFrame, gap: str = "10 minutes", watermark: str = "10 minutes",
                    key: str = "machine_id") -> DataFrame:
    """S3: downtime episodes per machine: readings with downtime > 0 at most
    ``gap`` apart belong to one session window (a session [t, t + gap) merges
    with a reading at its end); an episode ends ``gap`` after its last reading.
    The watermark tracks the downtime readings (Spark pushes the filter below
    the watermark anyway, so it is written in that order).  On a live stream
    with hot machines, set
    ``spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition``."""
    s = sdf.filter(F.col("downtime") > 0).withWatermark("event_time", watermark)
    agg = s.groupBy(F.session_window("event_time", gap).alias("session"), key).agg(
        F.count(F.lit(1)).alias("rows"), F.sum("downtime").alias("total_downtime"))
    return agg.select(key, instant_text(F.col("session.start")).alias("episode_start"),
                      instant_text(F.col("session.end")).alias("episode_end"), "rows", "total_downtime")


def stream_tag(sdf: DataFrame, means: dict, bounds: dict, zstats: dict, centers, features: Sequence[str],
               label: str = "cluster_efficiency_machine") -> DataFrame:
    """Live clean and condition tag, stateless: NULL -> frozen mean,
    clip to frozen fences, z-score with frozen stats, nearest frozen centre."""
    fill = {c: F.coalesce(F.col(c), F.lit(m)) for c, (m, nulls) in means.items() if nulls and m is not None}
    x = sdf.withColumns(fill) if fill else sdf
    clip = {c: F.when(F.col(c).isNull(), F.col(c)).otherwise(
        F.least(F.greatest(F.col(c), F.lit(b.lower)), F.lit(b.upper))) for c, b in bounds.items()}
    x = x.withColumns(clip)
    zc = [f"{c}_z" for c in features]
    x = x.withColumns({f"{c}_z": ((F.col(c) - F.lit(zstats[c][0])) / F.lit(zstats[c][1])) if zstats[c][1]
                       else F.lit(0.0) for c in features})
    return x.select(F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), "machine_id",
                    "line_id", nearest(zc, centers).alias(label))


def stream_dedup(sdf: DataFrame, keys: Sequence[str] = ("machine_id", "event_time"),
                 watermark: str = "10 minutes") -> DataFrame:
    """Drop repeated readings (same keys) while the watermark holds them;
    readings later than the watermark are dropped by the watermark itself."""
    d = sdf.withWatermark("event_time", watermark).dropDuplicatesWithinWatermark(list(keys))
    return d.select("machine_id", instant_text(F.col("event_time")).alias("timestamp"))


def stream_shift(sdf: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """Shift-instance totals per machine and line within daily windows."""
    d = F.to_date(F.col("timestamp"))
    s = sdf.withColumn("shift_instance_id", F.concat(d.cast("string"), F.lit("_"), F.col("shift")))
    agg = (s.withWatermark("event_time", watermark)
           .groupBy(F.window("event_time", "1 day"), "shift_instance_id", "machine_id", "line_id")
           .agg(F.sum("units_produced").cast("long").alias("units_produced"), F.sum("downtime").alias("downtime"),
                F.avg("error_rate").alias("error_rate"), F.avg("cycle_time").alias("cycle_time"),
                F.count(F.lit(1)).alias("rows")))
    return agg.select("shift_instance_id", "machine_id", "line_id", *_window_cols(), "units_produced", "downtime",
                      "error_rate", "cycle_time", "rows")


# ------------------------------------------------------------------ replay

def drain(spark: SparkSession, sdf: DataFrame, base: str, reduce: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Run everything available (``availableNow``) through ``reduce``, batch by batch, into
    ``base`` in the shared folder, and return the partial results of all batches.  Batch n
    owns the folder batch=n: a batch that runs again after a failure overwrites its own."""
    def keep(df: DataFrame, batch: int) -> None:
        reduce(df).write.mode("overwrite").parquet(f"{base}/parts/batch={batch}")

    q = (sdf.writeStream.foreachBatch(keep).option("checkpointLocation", f"{base}/ckpt")
         .trigger(availableNow=True).start())
    try:
        q.awaitTermination()
    finally:
        if q.isActive:
            q.stop()
    static = reduce(spark.createDataFrame([], sdf.schema))
    try:
        return spark.read.schema(static.schema).parquet(f"{base}/parts").select(*static.columns)
    except Exception as e:  # a stream without files writes no batch
        if "PATH_NOT_FOUND" in str(e):
            return static
        raise


def _sums(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Additive totals of rows: count, units, defects, downtime, error and cycle sums."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum("units_produced").cast("long").alias("units"),
        F.sum("defect_count").cast("long").alias("defects"), F.sum("downtime").alias("down"),
        F.count_if(F.col("downtime") > 0).alias("down_rows"), F.sum("error_rate").alias("error"),
        F.count("error_rate").alias("error_n"), F.sum("cycle_time").alias("cycle"), F.count("cycle_time").alias("cycle_n"))


def _merged(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    values = [c for c in parts.columns if c not in keys]
    return parts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in values])


def _bounds(start: str, seconds: int) -> list[Column]:
    return [instant_text(F.col(start)).alias("window_start"),
            instant_text(F.timestamp_seconds(F.unix_seconds(F.col(start)) + seconds)).alias("window_end")]


def _aligned(seconds: int) -> Column:
    """Start of the tumbling window of an event."""
    t = F.unix_seconds("event_time")
    return F.timestamp_seconds(t - F.pmod(t, F.lit(seconds)))


def kpi_parts(df: DataFrame, seconds: int = 3600, key: str = "machine_id") -> DataFrame:
    return _sums(df.withColumn("start", _aligned(seconds)), [key, "start"])


def kpi_total(parts: DataFrame, seconds: int = 3600, key: str = "machine_id") -> DataFrame:
    """S1 over all batches: tumbling-window KPIs per machine."""
    m = _merged(parts, [key, "start"])
    return m.select(key, *_bounds("start", seconds), F.col("n").alias("rows"), F.col("units").alias("total_units"),
                    F.col("defects").alias("total_defects"), F.col("down").alias("total_downtime"),
                    F.col("down_rows").alias("downtime_freq"), ((F.col("n") - F.col("down_rows")) / F.col("n")).alias("availability"),
                    F.try_divide((F.col("units") - F.col("defects")).cast("double"), F.nullif(F.col("units"), F.lit(0))).alias("quality"))


def alarm_parts(df: DataFrame, slide: int = 900, key: str = "machine_id") -> DataFrame:
    """Totals per slide step; a sliding window is a sum of steps, so rows are not copied."""
    return kpi_parts(df, slide, key).select(key, "start", "n", "down_rows")


def alarm_total(parts: DataFrame, size: int = 3600, slide: int = 900, threshold: float = 0.4, key: str = "machine_id") -> DataFrame:
    """S2 over all batches: sliding-window downtime share per machine, with its alarm."""
    m = _merged(parts, [key, "start"])
    back = F.explode(F.sequence(F.lit(0), F.lit(size - slide), F.lit(slide)))
    w = m.withColumn("back", back).withColumn("start", F.timestamp_seconds(F.unix_seconds("start") - F.col("back"))).drop("back")
    w = _merged(w, [key, "start"])
    share = F.col("down_rows") / F.col("n")
    return w.select(key, *_bounds("start", size), F.col("n").alias("rows"), "down_rows", share.alias("down_share"),
                    (share > F.lit(threshold)).alias("alarm"))


def episode_parts(df: DataFrame, key: str = "machine_id") -> DataFrame:
    """Downtime per machine and instant: copies and simultaneous readings are one row."""
    return df.filter((F.col("downtime") > 0) & F.col("event_time").isNotNull()).groupBy(key, "event_time").agg(
        F.count(F.lit(1)).alias("n"), F.sum("downtime").alias("down"))


def _sessions(df: DataFrame, part: Sequence[str], gap: int, order: str) -> DataFrame:
    """Merge spans (first, last, n, down) whose distance is at most ``gap`` within ``part``."""
    w = Window.partitionBy(*part).orderBy(order)
    fresh = F.coalesce((F.unix_seconds(F.col("first")) - F.unix_seconds(F.lag("last").over(w)) > gap).cast("int"), F.lit(1))
    numbered = df.withColumn("fresh", fresh).withColumn("sid", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*part, "sid").agg(F.min("first").alias("first"), F.max("last").alias("last"),
                                              F.sum("n").alias("n"), F.sum("down").alias("down")).drop("sid")


def episodes_total(parts: DataFrame, gap: int = 600, key: str = "machine_id") -> DataFrame:
    """S3 over all batches: episodes first within (machine, day), which spreads a hot machine
    over its days, then episodes that touch across midnight are merged per machine."""
    m = _merged(parts, [key, "event_time"]).select(
        key, F.col("event_time").alias("first"), F.col("event_time").alias("last"), "n", "down",
        F.floor(F.unix_seconds("event_time") / F.lit(86400)).alias("day"))
    days = _sessions(m, [key, "day"], gap, "first").drop("day")
    out = _sessions(days, [key], gap, "first")
    end = F.timestamp_seconds(F.unix_seconds(F.col("last")) + gap)
    return out.select(key, instant_text(F.col("first")).alias("episode_start"), instant_text(end).alias("episode_end"),
                      F.col("n").alias("rows"), F.col("down").alias("total_downtime"))


def dedup_parts(df: DataFrame, keys: Sequence[str] = ("machine_id", "event_time")) -> DataFrame:
    return df.select(*keys).distinct()


def dedup_total(parts: DataFrame) -> DataFrame:
    """S5 over all batches: distinct readings (combined per task before the shuffle)."""
    return parts.distinct().select("machine_id", instant_text(F.col("event_time")).alias("timestamp"))


def shift_parts(df: DataFrame) -> DataFrame:
    d = F.to_date(F.col("timestamp"))
    return _sums(df.withColumn("start", _aligned(86400)).withColumn(
        "shift_instance_id", F.concat(d.cast("string"), F.lit("_"), F.col("shift"))),
        ["shift_instance_id", "machine_id", "line_id", "start"])


def shift_total(parts: DataFrame) -> DataFrame:
    """S6 over all batches: shift-instance totals per machine and line in daily windows."""
    m = _merged(parts, ["shift_instance_id", "machine_id", "line_id", "start"])
    return m.select("shift_instance_id", "machine_id", "line_id", *_bounds("start", 86400), F.col("units").alias("units_produced"),
                    F.col("down").alias("downtime"), F.try_divide("error", "error_n").alias("error_rate"),
                    F.try_divide("cycle", "cycle_n").alias("cycle_time"), F.col("n").alias("rows"))
