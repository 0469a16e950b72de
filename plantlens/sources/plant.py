"""The `plant` log over the driver's star-schema tables.

The factory log of the analysis has one row per machine observation.  The
test tables are a TPC-H-like star schema, so the log is derived from
``lineitem JOIN orders JOIN part`` with fixed column rules (documented in
FIXTURES.md section 3).  Both joins are inner equi-joins on keys; Catalyst
prunes every column a query does not use and picks the join strategy from
table statistics (orders is large, so it stays a shuffle join at scale;
AQE turns the part side into a broadcast at runtime when it is small).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BASE_TS = "2024-01-01 00:00:00"  # a Monday
WEEK_MINUTES = 10080


def _pick(key: Column, values: list) -> Column:
    """CASE key WHEN 0 THEN v0 WHEN 1 THEN v1 ... (keys are 0..n-1)."""
    expr = F.when(key == 0, F.lit(values[0]))
    for i, v in enumerate(values[1:], start=1):
        expr = expr.when(key == i, F.lit(v))
    return expr


def plant_from_tables(lineitem: DataFrame, orders: DataFrame, part: DataFrame,
                      keep_truth: bool = False) -> DataFrame:
    o = orders.select("o_orderkey", "o_custkey", "o_totalprice")
    p = part.select("p_partkey", "p_type", "p_size", "p_retailprice")
    j = (lineitem.join(o, lineitem["l_orderkey"] == o["o_orderkey"])
         .join(p, lineitem["l_partkey"] == p["p_partkey"]))

    j = j.withColumns({
        "_idx": (F.col("l_orderkey") * 13 + F.col("l_partkey") * 7 + F.col("l_linenumber")) % WEEK_MINUTES,
        "_st": F.when(F.col("l_partkey") % 5 == 0, 0).when(F.col("p_size") <= 25, 1).otherwise(2),
        "_m": F.col("l_suppkey") % 4,
    })
    qty, ext, disc, tax = (F.col(c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax"))
    idx, st, m = F.col("_idx"), F.col("_st"), F.col("_m")
    crit = st == 0
    mod = idx % 1440

    oil = _pick(st, [55.0, 38.0, 70.0]) + F.lit(0.4) * F.col("p_size")
    cols = {
        "timestamp": F.timestamp_add("MINUTE", idx, F.lit(BASE_TS).cast("timestamp_ntz")),
        "machine_id": _pick(m, ["M001", "M002", "M003", "M004"]),
        "machine_type": _pick(m, ["CNC", "Drill", "Welder", "Conveyor"]),
        "line_id": (F.when(F.col("l_returnflag") == "A", "L1")
                    .when(F.col("l_returnflag") == "N", "L2")
                    .when(F.col("l_returnflag") == "R", "L3")),
        "shift": (F.when((mod >= 360) & (mod < 840), "Shift_1_Pagi")
                  .when((mod >= 840) & (mod < 1320), "Shift_2_Sore")
                  .otherwise("Shift_3_Malam")),
        "operator_id": F.concat(F.lit("OP"), F.lpad((F.col("l_partkey") % 12 + 1).cast("string"), 3, "0")),
        "product_type": F.col("p_type"),
        "hour": F.floor(mod / F.lit(60.0)).cast("int"),
        "day_of_week": F.floor(idx / F.lit(1440.0)).cast("int"),
        "is_weekend": F.when(idx >= 7200, 1).otherwise(0),
        "temperature": F.when(F.col("l_partkey") % 53 == 0, F.lit(None).cast("double"))
                        .otherwise(F.lit(70.0) + ext / 10000.0 + F.when(crit, 9.0).otherwise(0.0)),
        "vibration_level": F.when(F.col("l_partkey") % 41 == 0, F.lit(None).cast("double"))
                            .when((F.col("l_linenumber") == 7) & (qty > 45), F.lit(9.0))
                            .otherwise(F.lit(1.5) + ext / 100000.0 + F.when(crit, 2.2).otherwise(0.0)),
        "power_consumption": F.when(F.col("l_partkey") % 31 == 0, F.lit(None).cast("double"))
                              .otherwise(F.lit(15.0) + F.lit(0.1) * qty + F.when(crit, 6.0).otherwise(0.0)),
        "pressure": F.lit(3.5) + (F.col("l_partkey") % 50) / 16.0,
        "material_flow_rate": F.lit(15.0) + (F.col("p_retailprice") - 900.0) / 10.0,
        "cycle_time": F.lit(100.0) + F.lit(0.8) * qty,
        "error_rate": F.lit(0.6) + F.lit(2.0) * disc + F.when(crit, 0.2).otherwise(0.0),
        "machine_age_hours": _pick(st, [9000.0, 6100.0, 12000.0]) + F.lit(60.0) * F.col("p_size"),
        "last_maintenance_hours": F.lit(20.0) * tax,
        "oil_level": oil,
        "lubrication_status": F.when(oil >= 70.0, "Good").when(oil >= 40.0, "Low").otherwise("Critical"),
        "units_produced": (F.col("l_linenumber") % 4).cast("int"),
        "downtime": (F.when(tax < 0.055, F.lit(0.0))
                     .when(m == 0, qty * 1.2).otherwise(qty)),
        "ambient_temperature": F.lit(18.3) + F.col("o_totalprice") / 30000.0,
        "humidity": F.lit(46.8) + (F.col("o_custkey") % 45),
        "noise_level_db": _pick(m, [82.0, 88.0, 95.0, 75.0]) + F.lit(100.0) * disc,
        "defect_count": F.when((disc > 0.075) & (F.col("l_linenumber") % 4 > 0), 1).otherwise(0),
    }
    out = j.select(*[c.alias(n) for n, c in cols.items()],
                   *([st.alias("true_state")] if keep_truth else []))
    return out


def plant_log(spark: SparkSession, sf_dir: str, keep_truth: bool = False) -> DataFrame:
    """The factory log for one test-data directory (lazy; column-pruned per query)."""
    r = spark.read
    return plant_from_tables(r.parquet(f"{sf_dir}/lineitem.parquet"),
                             r.parquet(f"{sf_dir}/orders.parquet"),
                             r.parquet(f"{sf_dir}/part.parquet"), keep_truth)


# DuckDB/ANSI text of the same mapping, used only by the oracles.
PLANT_SQL = """
plant_base AS (
  SELECT l.*, o.o_custkey, o.o_totalprice, p.p_type, p.p_size, p.p_retailprice,
         (l.l_orderkey * 13 + l.l_partkey * 7 + l.l_linenumber) % 10080 AS idx,
         CASE WHEN l.l_partkey % 5 = 0 THEN 0 WHEN p.p_size <= 25 THEN 1 ELSE 2 END AS st,
         l.l_suppkey % 4 AS m
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
                  JOIN part p ON l.l_partkey = p.p_partkey
),
plant_oil AS (
  SELECT *, (CASE st WHEN 0 THEN 55.0E0 WHEN 1 THEN 38.0E0 ELSE 70.0E0 END) + 0.4E0 * p_size AS oil
  FROM plant_base
),
plant AS (
  SELECT
    CAST('2024-01-01 00:00:00' AS TIMESTAMP) + INTERVAL '1' MINUTE * idx AS "timestamp",
    CASE m WHEN 0 THEN 'M001' WHEN 1 THEN 'M002' WHEN 2 THEN 'M003' ELSE 'M004' END AS machine_id,
    CASE m WHEN 0 THEN 'CNC' WHEN 1 THEN 'Drill' WHEN 2 THEN 'Welder' ELSE 'Conveyor' END AS machine_type,
    CASE l_returnflag WHEN 'A' THEN 'L1' WHEN 'N' THEN 'L2' WHEN 'R' THEN 'L3' END AS line_id,
    CASE WHEN idx % 1440 >= 360 AND idx % 1440 < 840 THEN 'Shift_1_Pagi'
         WHEN idx % 1440 >= 840 AND idx % 1440 < 1320 THEN 'Shift_2_Sore'
         ELSE 'Shift_3_Malam' END AS shift,
    'OP' || lpad(CAST(l_partkey % 12 + 1 AS VARCHAR), 3, '0') AS operator_id,
    p_type AS product_type,
    CAST(floor((idx % 1440) / 60.0E0) AS INTEGER) AS hour,
    CAST(floor(idx / 1440.0E0) AS INTEGER) AS day_of_week,
    CASE WHEN idx >= 7200 THEN 1 ELSE 0 END AS is_weekend,
    CASE WHEN l_partkey % 53 = 0 THEN NULL
         ELSE 70.0E0 + l_extendedprice / 10000.0E0 + CASE WHEN st = 0 THEN 9.0E0 ELSE 0.0E0 END END AS temperature,
    CASE WHEN l_partkey % 41 = 0 THEN NULL
         WHEN l_linenumber = 7 AND l_quantity > 45 THEN 9.0E0
         ELSE 1.5E0 + l_extendedprice / 100000.0E0 + CASE WHEN st = 0 THEN 2.2E0 ELSE 0.0E0 END END AS vibration_level,
    CASE WHEN l_partkey % 31 = 0 THEN NULL
         ELSE 15.0E0 + 0.1E0 * l_quantity + CASE WHEN st = 0 THEN 6.0E0 ELSE 0.0E0 END END AS power_consumption,
    3.5E0 + (l_partkey % 50) / 16.0E0 AS pressure,
    15.0E0 + (p_retailprice - 900.0E0) / 10.0E0 AS material_flow_rate,
    100.0E0 + 0.8E0 * l_quantity AS cycle_time,
    0.6E0 + 2.0E0 * l_discount + CASE WHEN st = 0 THEN 0.2E0 ELSE 0.0E0 END AS error_rate,
    (CASE st WHEN 0 THEN 9000.0E0 WHEN 1 THEN 6100.0E0 ELSE 12000.0E0 END) + 60.0E0 * p_size AS machine_age_hours,
    20.0E0 * l_tax AS last_maintenance_hours,
    oil AS oil_level,
    CASE WHEN oil >= 70.0E0 THEN 'Good' WHEN oil >= 40.0E0 THEN 'Low' ELSE 'Critical' END AS lubrication_status,
    CAST(l_linenumber % 4 AS INTEGER) AS units_produced,
    CASE WHEN l_tax < 0.055E0 THEN 0.0E0 WHEN m = 0 THEN l_quantity * 1.2E0 ELSE l_quantity END AS downtime,
    18.3E0 + o_totalprice / 30000.0E0 AS ambient_temperature,
    46.8E0 + (o_custkey % 45) AS humidity,
    (CASE m WHEN 0 THEN 82.0E0 WHEN 1 THEN 88.0E0 WHEN 2 THEN 95.0E0 ELSE 75.0E0 END) + 100.0E0 * l_discount AS noise_level_db,
    CASE WHEN l_discount > 0.075E0 AND l_linenumber % 4 > 0 THEN 1 ELSE 0 END AS defect_count,
    st AS true_state
  FROM plant_oil
)"""
