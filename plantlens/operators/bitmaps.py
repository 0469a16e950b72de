"""B6/B8 over any period: exact distinct counts from stored daily bitmaps.

A dimension's values are numbered once (a written dictionary, ranks of a range
partitioning).  Per day, the numbers seen are a bitmap of as many words as the
dictionary has buckets of 32,768 values.  A period's distinct count is the bitwise or of
its days: it reads a few rows per day, not the log, and is exact, unlike a sum of daily counts.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantlens.operators.kpi import dense_ranks


def dictionary(df: DataFrame, col: str) -> DataFrame:
    """(value, id): the distinct non-NULL values of a column, numbered from 1."""
    values = df.select(F.col(col).cast("string").alias("value")).where(F.col("value").isNotNull())
    return dense_ranks(values, "value").select("value", F.col("rank").cast("long").alias("id"))


def daily(df: DataFrame, day: Column, cols: Sequence[str], store: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """(day, dim, bucket, bits): which values of each column a day has.  Values are made
    distinct per day before they meet the dictionary."""
    out = None
    for c in cols:
        ids = store(dictionary(df, c), f"dictionary-{c}")
        seen = df.select(day.alias("day"), F.col(c).cast("string").alias("value")).where("day IS NOT NULL AND value IS NOT NULL").distinct().join(ids, "value")
        bits = seen.groupBy("day", F.bitmap_bucket_number("id").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("bits"))
        part = bits.select("day", F.lit(c).alias("dim"), "bucket", "bits")
        out = part if out is None else out.unionByName(part)
    return out


def distinct_in(days: DataFrame, periods: DataFrame) -> DataFrame:
    """(first_day, last_day, dim, n_distinct) of each period (first_day, last_day: dates), from
    the daily table."""
    span = periods.select("first_day", "last_day", F.explode(F.sequence("first_day", "last_day")).alias("day"))
    merged = days.join(span, "day").groupBy("first_day", "last_day", "dim", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    return merged.groupBy("first_day", "last_day", "dim").agg(F.sum(F.bitmap_count("bits")).alias("n_distinct"))
