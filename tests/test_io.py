"""Sources and sinks: CSV round trip with an explicit schema, bad timestamps."""
from pyspark.sql import functions as F

from plantlens.plans import context as ctx
from plantlens.schema import LOG_SCHEMA
from plantlens.session import scratch_path
from plantlens.sources.log_io import parse_ts, read_log, write_log


def test_csv_round_trip(spark, sf):
    df = ctx.plant(spark, sf).orderBy("timestamp", "machine_id", "operator_id", "cycle_time").limit(50)
    path = scratch_path(spark, "csv")
    write_log(df, path, fmt="csv")
    back = read_log(spark, path, "csv")
    assert back.schema == LOG_SCHEMA
    a = sorted(map(tuple, df.collect()), key=str)
    b = sorted(map(tuple, back.collect()), key=str)
    assert a == b


def test_parquet_round_trip_partitioned(spark, sf):
    df = ctx.plant(spark, sf)
    path = scratch_path(spark, "pq")
    write_log(df, path, partition_by=["line_id"])
    assert spark.read.parquet(path).count() == df.count()


def test_parse_ts_rejects(spark):
    df = spark.createDataFrame([("2024-01-01 10:00:00",), ("garbage",), (None,)], "timestamp string")
    out = parse_ts(df)
    assert out.filter(F.col("timestamp").isNull()).count() == 2
    assert dict(out.dtypes)["timestamp"] == "timestamp_ntz"


def test_csv_malformed_rows_kept(spark):
    import os
    path = scratch_path(spark, "badcsv").replace("file:", "")
    os.makedirs(path, exist_ok=True)
    header = ",".join(f.name for f in LOG_SCHEMA.fields)
    good = ",".join(["2024-01-01 00:01:00", "M001", "CNC", "L1", "Shift_3_Malam", "OP001", "SMALL", "0", "0", "0"]
                    + ["1.5"] * 10 + ["Good", "2", "0.0", "20.0", "50.0", "80.0", "0"])
    bad = good.replace(",2,0.0,", ",two,0.0,")
    with open(os.path.join(path, "log.csv"), "w") as f:
        f.write("\n".join([header, good, bad]) + "\n")
    df = read_log(spark, path, keep_corrupt=True)
    rows = df.collect()
    assert len(rows) == 2
    assert sum(r["_corrupt_record"] is not None for r in rows) == 1


def test_nan_normalised_to_null(spark):
    import os
    from plantlens.operators.clean import col_means
    path = scratch_path(spark, "nancsv").replace("file:", "")
    os.makedirs(path, exist_ok=True)
    header = ",".join(f.name for f in LOG_SCHEMA.fields)
    base = ["2024-01-01 00:01:00", "M001", "CNC", "L1", "Shift_3_Malam", "OP001", "SMALL", "0", "0", "0"]
    tail = ["1.5"] * 9 + ["Good", "2", "0.0", "20.0", "50.0", "80.0", "0"]
    lines = [header] + [",".join(base + [t] + tail) for t in ("70.0", "NaN", "", "80.0")]
    with open(os.path.join(path, "log.csv"), "w") as f:
        f.write("\n".join(lines) + "\n")
    df = read_log(spark, path)
    assert df.filter(F.col("temperature").isNull()).count() == 2
    assert col_means(df, ["temperature"])["temperature"] == (75.0, 2)


def test_partitioned_sink_writes_few_files(spark, sf):
    import os
    df = ctx.plant(spark, sf).repartition(12)     # 12 input tasks
    path = scratch_path(spark, "pqfiles").replace("file:", "")
    write_log(df, path, partition_by=["line_id"])
    files = [f for _, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")]
    # rebalanced by the partition column: not 12 tasks x 3 directories
    assert len(files) <= 3 + 3
    assert spark.read.parquet(path).count() == df.count()
