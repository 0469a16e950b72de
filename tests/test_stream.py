"""Streaming: late readings dropped by the watermark, dedup across batches."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from plantlens.session import scratch_path
from plantlens.streaming import stream as S

SCHEMA = "machine_id string, event_time timestamp, units_produced int, defect_count int, downtime double"


def _write(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def _drain(spark, src, build):
    """A live query in append mode, one file per micro-batch."""
    sdf = build(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src))
    base = scratch_path(spark, "live")
    q = (sdf.writeStream.format("parquet").outputMode("append").option("path", f"{base}/out")
         .option("checkpointLocation", f"{base}/ckpt").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(sdf.schema).parquet(f"{base}/out")


def t(h, m=0):
    return dt.datetime(2024, 1, 1, h, m, tzinfo=dt.timezone.utc)


def test_late_reading_dropped(spark):
    # Spark judges lateness against the previous batch's watermark, so the late
    # reading arrives in the third micro-batch (one file per batch).
    src = scratch_path(spark, "late-src")
    _write(spark, src, [("M1", t(9, 5), 1, 0, 0.0), ("M1", t(10, 30), 1, 0, 2.0)])
    _write(spark, src, [("M1", t(12, 0), 1, 0, 0.0)])
    _write(spark, src, [("M1", t(9, 10), 5, 0, 0.0)])           # late: watermark is 10:20
    out = _drain(spark, src, S.stream_kpi)
    rows = {r["window_start"]: r for r in out.collect()}
    assert rows["2024-01-01 09:00:00"]["total_units"] == 1   # the 09:10 reading never counted
    assert rows["2024-01-01 10:00:00"]["downtime_freq"] == 1
    assert "2024-01-01 12:00:00" not in rows                  # still open


def test_dedup_across_batches(spark):
    src = scratch_path(spark, "dedup-src")
    _write(spark, src, [("M1", t(8), 1, 0, 0.0), ("M1", t(8), 1, 0, 0.0), ("M2", t(8), 1, 0, 0.0)])
    _write(spark, src, [("M1", t(8), 1, 0, 0.0), ("M1", t(8, 1), 1, 0, 0.0)])
    out = _drain(spark, src, S.stream_dedup)
    assert sorted((r["machine_id"], r["timestamp"]) for r in out.collect()) == [
        ("M1", "2024-01-01 08:00:00"), ("M1", "2024-01-01 08:01:00"), ("M2", "2024-01-01 08:00:00")]


def test_episode_gap_rule(spark):
    src = scratch_path(spark, "epi-src")
    _write(spark, src, [("M1", t(8, 0), 0, 0, 1.0), ("M1", t(8, 10), 0, 0, 1.0), ("M1", t(8, 21), 0, 0, 1.0),
                        ("M1", t(8, 22), 0, 0, 0.0), ("M1", t(12, 0), 0, 0, 3.0)])
    out = _drain(spark, src, S.stream_episodes)
    eps = sorted((r["episode_start"], r["rows"]) for r in out.collect())
    assert eps == [("2024-01-01 08:00:00", 2), ("2024-01-01 08:21:00", 1)]


REPLAYS = {"stream_kpi": (S.kpi_parts, S.kpi_total), "stream_alarm": (S.alarm_parts, S.alarm_total),
           "stream_episodes": (S.episode_parts, S.episodes_total), "stream_dedup": (S.dedup_parts, S.dedup_total),
           "stream_shift": (S.shift_parts, S.shift_total)}


def _rounded(df):
    return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.collect())


@pytest.mark.parametrize("name", sorted(REPLAYS))
def test_replay_does_not_depend_on_files_or_order(spark, sf, name):
    """One file, and a folder of several files in shuffled time order read one per batch,
    both give the batch answer over all rows."""
    parts, total = REPLAYS[name]
    batch = S.log_stream(*(spark.read.parquet(f"{sf}/{t}.parquet") for t in ("lineitem", "orders", "part")))
    expect = _rounded(total(parts(batch)))
    folder = scratch_path(spark, "lineitem-folder")
    spark.read.parquet(f"{sf}/lineitem.parquet").repartition(4, F.rand(3)).write.parquet(folder)
    orders, part = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("orders", "part"))
    for sdf in (S.plant_stream(spark, sf), S.log_stream(S.file_stream(spark, folder, max_files=1), orders, part)):
        base = scratch_path(spark, "replay")
        assert _rounded(total(S.drain(spark, sdf, base, parts))) == expect
        again = S.drain(spark, sdf, base, parts)  # nothing new: nothing counted twice
        assert _rounded(total(again)) == expect


def test_replay_equals_live_windows(spark, sf):
    """Windows that a live query emits agree with the replay's."""
    base = scratch_path(spark, "replay-live")
    live = spark.createDataFrame([("M1", t(9, 5), 1, 0, 0.0), ("M1", t(9, 20), 2, 1, 2.0), ("M1", t(11, 30), 1, 0, 2.0)], SCHEMA)
    src = scratch_path(spark, "live-src")
    live.coalesce(1).write.parquet(src)
    got = {r["window_start"]: r for r in _drain(spark, src, S.stream_kpi).collect()}
    full = live.withColumns({"error_rate": F.lit(0.5), "cycle_time": F.lit(1.0)})
    for r in S.kpi_total(S.kpi_parts(full)).collect():
        if r["window_start"] in got:
            assert r == got[r["window_start"]]
    assert "2024-01-01 09:00:00" in got


def test_episodes_merge_across_midnight_and_batches(spark):
    import datetime
    day2 = datetime.datetime(2024, 1, 2, 0, 4, tzinfo=datetime.timezone.utc)
    rows = [("M1", t(23, 55), 0, 0, 1.0), ("M1", day2, 0, 0, 2.0), ("M1", t(8), 0, 0, 1.0), ("M2", t(8), 0, 0, 0.0)]
    a, b = (S.episode_parts(spark.createDataFrame(rows[k::2], SCHEMA)) for k in (0, 1))
    got = sorted((r["episode_start"], r["episode_end"], r["rows"], r["total_downtime"]) for r in S.episodes_total(a.unionAll(b)).collect())
    assert got == [("2024-01-01 08:00:00", "2024-01-01 08:10:00", 1, 1.0), ("2024-01-01 23:55:00", "2024-01-02 00:14:00", 2, 3.0)]


def test_a_stream_without_files(spark):
    src = scratch_path(spark, "empty-src")
    spark.createDataFrame([], SCHEMA).write.parquet(src)
    got = S.drain(spark, spark.readStream.schema(SCHEMA).parquet(src), scratch_path(spark, "empty"), S.dedup_parts)
    assert S.dedup_total(got).count() == 0
