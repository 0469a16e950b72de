"""The factory-log schema and the column groups the analyses reuse."""

from __future__ import annotations

from pyspark.sql import types as T

LOG_SCHEMA = T.StructType([
    T.StructField("timestamp", T.TimestampNTZType(), True),
    T.StructField("machine_id", T.StringType(), True),
    T.StructField("machine_type", T.StringType(), True),
    T.StructField("line_id", T.StringType(), True),
    T.StructField("shift", T.StringType(), True),
    T.StructField("operator_id", T.StringType(), True),
    T.StructField("product_type", T.StringType(), True),
    T.StructField("hour", T.IntegerType(), True),
    T.StructField("day_of_week", T.IntegerType(), True),
    T.StructField("is_weekend", T.IntegerType(), True),
    T.StructField("temperature", T.DoubleType(), True),
    T.StructField("vibration_level", T.DoubleType(), True),
    T.StructField("power_consumption", T.DoubleType(), True),
    T.StructField("pressure", T.DoubleType(), True),
    T.StructField("material_flow_rate", T.DoubleType(), True),
    T.StructField("cycle_time", T.DoubleType(), True),
    T.StructField("error_rate", T.DoubleType(), True),
    T.StructField("machine_age_hours", T.DoubleType(), True),
    T.StructField("last_maintenance_hours", T.DoubleType(), True),
    T.StructField("oil_level", T.DoubleType(), True),
    T.StructField("lubrication_status", T.StringType(), True),
    T.StructField("units_produced", T.IntegerType(), True),
    T.StructField("downtime", T.DoubleType(), True),
    T.StructField("ambient_temperature", T.DoubleType(), True),
    T.StructField("humidity", T.DoubleType(), True),
    T.StructField("noise_level_db", T.DoubleType(), True),
    T.StructField("defect_count", T.IntegerType(), True),
])

TS = "timestamp"

# The analyses' column lists, in the order the analyses use them.
NUMERIC16 = [
    "temperature", "vibration_level", "power_consumption", "pressure",
    "material_flow_rate", "cycle_time", "error_rate", "machine_age_hours",
    "last_maintenance_hours", "oil_level", "units_produced", "downtime",
    "ambient_temperature", "humidity", "noise_level_db", "defect_count",
]
# winsorised columns: the two count columns are skipped
CLIP14 = [c for c in NUMERIC16 if c not in ("units_produced", "defect_count")]
# box plots before clipping
BOX15 = [c for c in NUMERIC16 if c != "defect_count"]
# every numeric column of the log (calendar ints included): imputation and IQR report
ALL_NUMERIC = ["hour", "day_of_week", "is_weekend"] + NUMERIC16
PROFILE8 = ["machine_type", "line_id", "shift", "operator_id", "product_type",
            "machine_id", "lubrication_status", "defect_count"]
MACHINE_FEATURES8 = ["temperature", "vibration_level", "power_consumption", "pressure",
                     "oil_level", "machine_age_hours", "error_rate", "noise_level_db"]
SHIFT_KEYS = ["shift_instance_id", "machine_id", "line_id"]
EFF4 = ["efficiency_error_rate", "efficiency_downtime", "efficiency_cycle_time",
        "efficiency_units_produced"]
TEMP_METRICS4 = ["power_consumption", "error_rate", "downtime", "units_produced"]
TEMP_CORR5 = ["temperature", "power_consumption", "error_rate", "downtime", "units_produced"]
RF_FEATURES11 = ["temperature", "vibration_level", "power_consumption", "pressure",
                 "material_flow_rate", "cycle_time", "error_rate", "machine_age_hours",
                 "oil_level", "humidity", "noise_level_db"]
RF_TARGETS3 = ["units_produced", "defect_count", "downtime"]

# The dictionary's stated sensor ranges (min, max).
SENSOR_RANGES = {
    "temperature": (61.75, 100.0),
    "vibration_level": (1.0, 9.49),
    "power_consumption": (10.0, 34.37),
    "pressure": (3.43, 6.66),
    "material_flow_rate": (15.0, 25.14),
    "cycle_time": (100.0, 142.4),
    "error_rate": (0.5, 1.0),
    "machine_age_hours": (6100.0, 15241.0),
    "last_maintenance_hours": (0.0, 1.85),
    "oil_level": (19.85, 97.8),
    "units_produced": (0.0, 3.0),
    "downtime": (0.0, 50.0),
    "ambient_temperature": (18.3, 36.6),
    "humidity": (46.8, 91.5),
    "noise_level_db": (65.1, 112.2),
}

# Typical noise (dB) per machine type, from the data dictionary.
NOISE_NORMS = {"Welder": 95.0, "Drill": 88.0, "CNC": 82.0, "Conveyor": 75.0}

# Shift names and their hours (06-14, 14-22, 22-06).
SHIFTS = [("Shift_1_Pagi", 6, 14), ("Shift_2_Sore", 14, 22), ("Shift_3_Malam", 22, 6)]

# Lubrication bands on oil_level (Good >= 70, Low 40-70, Critical < 40).
LUBRICATION_BANDS = [("Good", 70.0), ("Low", 40.0), ("Critical", None)]

# OEE constants of the analysis (ideal cycle seconds, world-class OEE target).
IDEAL_CYCLE_SEC = 120.0
OEE_TARGET = 0.85
