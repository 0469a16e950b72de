"""A1-A3: read and write the factory log; parse its timestamp."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plantlens.schema import LOG_SCHEMA, TS


CORRUPT = "_corrupt_record"


def read_log(spark: SparkSession, path: str, fmt: str = "csv",
             schema: T.StructType | None = None, keep_corrupt: bool = False) -> DataFrame:
    """Scan the log with an explicit schema (no inference pass over the data).

    CSV: header row, blank -> NULL, malformed rows kept with NULLs
    (PERMISSIVE); with ``keep_corrupt`` their raw text is kept in
    ``_corrupt_record`` so they can be counted or quarantined.  ``timestamp``
    is read as text and parsed by ``parse_ts`` so a bad value is counted
    rather than failing the job.
    """
    schema = schema or LOG_SCHEMA
    if fmt == "csv":
        fields = [T.StructField(f.name, T.StringType() if f.name == TS else f.dataType, True)
                  for f in schema.fields]
        if keep_corrupt:
            fields.append(T.StructField(CORRUPT, T.StringType(), True))
        df = (spark.read.schema(T.StructType(fields)).option("header", True)
              .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).csv(path))
        return nan_to_null(parse_ts(df, TS))
    return nan_to_null(spark.read.schema(schema).format(fmt).load(path))


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN -> NULL in floating columns at ingest: pandas skips NaN in every
    statistic, Spark aggregates only skip NULL (avg over a NaN is NaN)."""
    fix = {f.name: F.nanvl(F.col(f.name), F.lit(None).cast(f.dataType))
           for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.withColumns(fix) if fix else df


def parse_ts(df: DataFrame, col: str = TS, fmt: str | None = None) -> DataFrame:
    """Parse a text timestamp column to TIMESTAMP_NTZ; unparsable text -> NULL.

    Use ``count_bad_ts`` before for the reference's raise-on-bad behaviour.
    """
    if isinstance(df.schema[col].dataType, (T.TimestampType, T.TimestampNTZType)):
        return df
    c = F.col(col)
    parsed = (F.try_to_timestamp(c, F.lit(fmt)) if fmt else F.try_to_timestamp(c))
    return df.withColumn(col, parsed.cast("timestamp_ntz"))


def write_log(df: DataFrame, path: str, fmt: str = "parquet",
              partition_by: list[str] | None = None, mode: str = "overwrite") -> None:
    """Sink the (enriched) log; CSV keeps a header and every column (no index).

    With ``partition_by`` the rows are rebalanced on the partition columns: one
    shuffle that AQE sizes at run time, so that each task writes few
    directories, small partition values share a task, and a hot one (a third of
    the rows on one day) is split over several."""
    if partition_by:
        df = df.hint("rebalance", *[F.col(c) for c in partition_by])
    w = df.write.mode(mode)
    if fmt == "csv":
        w.option("header", True).csv(path)
        return
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.format(fmt).save(path)
