"""Late readings in a side table, live queries that are stopped and resumed."""
import datetime as dt

from plantlens.session import scratch_path
from plantlens.streaming import late as L
from plantlens.streaming import stream as S

SCHEMA = ("machine_id string, event_time timestamp, units_produced int, defect_count int, downtime double, error_rate double, cycle_time double")


def t(h, m=0):
    return dt.datetime(2024, 1, 1, h, m, tzinfo=dt.timezone.utc)


def reading(machine, at, units=1, down=0.0):
    return (machine, at, units, 0, down, 0.5, 100.0)


#: What arrives in each step; the watermark is an hour behind the latest reading before.
STEPS = [[reading("M1", t(9, 5)), reading("M1", t(10, 30), 1, 2.0), reading("M2", None)],
         [reading("M1", t(12)), reading("M2", t(9, 40), 7)],           # 09:40 is in time: the mark is 09:30
         [reading("M1", t(9, 10), 5), reading("M2", t(10, 59), 3), reading("M2", t(11), 2)],  # mark 11:00
         [reading("M1", t(15))],
         [reading("M1", t(11, 30), 4), reading("M1", t(9, 10), 5)]]     # mark 14:00


def arrive(spark, steps, run):
    src = scratch_path(spark, "late-src")
    out = []
    for rows in steps:
        spark.createDataFrame(rows, SCHEMA).write.mode("append").parquet(src)
        out.append(run(spark.readStream.schema(SCHEMA).parquet(src)))
    return src, out


def seen(late):
    return sorted((r["machine_id"], r["event_time"].strftime("%H:%M"), r["watermark"].strftime("%H:%M")) for r in late.collect())


def test_late_readings_are_kept_and_counted(spark):
    base = scratch_path(spark, "split")
    src, results = arrive(spark, STEPS, lambda sdf: L.split_late(spark, sdf, base, 3600, S.kpi_parts))
    parts, late = results[-1]
    assert [x[:2] for x in seen(late)] == [("M1", "09:10"), ("M1", "09:10"), ("M1", "11:30"), ("M2", "10:59")]
    assert {x[1]: x[2] for x in seen(late) if x[0] == "M2"} == {"10:59": "11:00"}
    counts = {r["machine_id"]: (r["n_late"], r["most_minutes_late"]) for r in L.late_counts(late).collect()}
    assert counts == {"M1": (3, 290.0), "M2": (1, 1.0)}
    total = {(r["machine_id"], r["window_start"][11:13]): r["total_units"] for r in S.kpi_total(parts).collect()}
    assert total == {("M1", "09"): 1, ("M1", "10"): 1, ("M1", "12"): 1, ("M2", "09"): 7, ("M2", "11"): 2, ("M1", "15"): 1}
    # nothing new: a further run counts nothing twice
    again = L.split_late(spark, spark.readStream.schema(SCHEMA).parquet(src), base, 3600, S.kpi_parts)
    assert seen(again[1]) == seen(late) and again[0].count() == parts.count()


def test_a_batch_that_runs_again_rewrites_its_own_rows(spark):
    """The last batch fails after its late rows are written; the restart repeats it."""
    base, fail = scratch_path(spark, "split-again"), []

    def reduce(df):
        return S.kpi_parts(df)

    def run(sdf):
        return L.split_late(spark, sdf, base, 3600, reduce)
    src, _ = arrive(spark, STEPS[:4], run)
    before = seen(run(spark.readStream.schema(SCHEMA).parquet(src))[1])
    spark.createDataFrame(STEPS[4], SCHEMA).write.mode("append").parquet(src)
    real = L.F.max

    def broken(c):
        if c == "event_time" and not fail:
            fail.append(1)
            raise RuntimeError("lost")
        return real(c)
    L.F.max = broken
    try:
        try:
            run(spark.readStream.schema(SCHEMA).parquet(src))
        except Exception as e:
            assert "lost" in str(e)
    finally:
        L.F.max = real
    assert fail
    after = seen(run(spark.readStream.schema(SCHEMA).parquet(src))[1])
    assert len(after) == len(before) + 2


def test_live_windows_survive_a_restart(spark):
    """Stopped after each step and resumed, the query emits each closed window once, and the
    windows not closed are in its state."""
    base = scratch_path(spark, "live")
    arrive(spark, STEPS, lambda sdf: L.run_live(spark, S.stream_kpi(sdf, watermark="1 hour"), base))
    out = spark.read.parquet(f"{base}/out")
    got = {(r["machine_id"], r["window_start"][11:13]): r["total_units"] for r in out.collect()}
    assert out.count() == len(got)
    # 09:10 is dropped at mark 11:00 (its window ended at 10:00); the window of 10:59 ended at 11:00
    assert got == {("M1", "09"): 1, ("M1", "10"): 1, ("M2", "09"): 7, ("M1", "12"): 1, ("M2", "11"): 2}
    held = {(r["machine_id"], r["start"].strftime("%H")) for r in L.open_windows(spark, base).collect()}
    assert held == {("M1", "15")}


def test_arrivals_of_an_empty_log(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert L.arrivals(empty, 3).count() == 0
    base = scratch_path(spark, "none")
    parts, late = L.split_late(spark, spark.readStream.schema(SCHEMA).parquet(arrive(spark, [[]], lambda s: None)[0]), base, 60, S.kpi_parts)
    assert parts.count() == late.count() == 0
