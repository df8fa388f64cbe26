"""Table schemas and fixed values.

Cubes are long tables: one row per (variable, time, level, lat, lon).  Stored
cubes are Parquet, partitioned by ``variable``, ``year`` and ``month`` so that
variable, year and season filters prune directories instead of reading rows.
"""

from __future__ import annotations

from pyspark.sql import types as T

FIELD = T.StructType([
    T.StructField("variable", T.StringType(), False),
    T.StructField("time", T.TimestampNTZType(), False),
    T.StructField("level", T.DoubleType(), True),
    T.StructField("lat", T.DoubleType(), False),
    T.StructField("lon", T.DoubleType(), False),
    T.StructField("value", T.DoubleType(), True),
])

MASK = T.StructType([
    T.StructField("algo", T.StringType(), False),
    T.StructField("time", T.TimestampNTZType(), False),
    T.StructField("lat", T.DoubleType(), False),
    T.StructField("lon", T.DoubleType(), False),
    T.StructField("tag", T.DoubleType(), True),
])

CLIMATOLOGY = T.StructType([
    T.StructField("variable", T.StringType(), False),
    T.StructField("mon", T.IntegerType(), True),
    T.StructField("level", T.DoubleType(), True),
    T.StructField("lat", T.DoubleType(), False),
    T.StructField("lon", T.DoubleType(), False),
    T.StructField("bnds", T.IntegerType(), True),
    T.StructField("value", T.DoubleType(), True),
])

LOCATION = T.StructType([
    T.StructField("loc_id", T.LongType(), False),
    T.StructField("lat", T.DoubleType(), False),
    T.StructField("lon", T.DoubleType(), False),
])

EVENT = T.StructType([
    T.StructField("algo", T.StringType(), False),
    T.StructField("loc_id", T.LongType(), False),
    T.StructField("time", T.TimestampNTZType(), False),
])

EVENT_POINT = T.StructType([
    T.StructField("time", T.TimestampNTZType(), False),
    T.StructField("lon", T.DoubleType(), False),
    T.StructField("lat", T.DoubleType(), False),
])

#: Key columns that hold no NULL in any table.  Joins on these use plain
#: equality, which keeps bucketing, partition pruning and runtime filters usable;
#: every other key (a level, a cluster) is compared so that NULL meets NULL.
NEVER_NULL = {"variable", "time", "lat", "lon", "algo", "loc_id", "matched_time", "event_time"}

LABEL = T.StructType([
    T.StructField("event_id", T.LongType(), False),
    T.StructField("cluster", T.IntegerType(), False),
])

# ---------------------------------------------------------------------------
# Fixed values.  These have to be exactly these for results to agree.
# ---------------------------------------------------------------------------
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun",
          "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]

COMPOSITE_LEVELS = [850.0, 700.0, 500.0, 300.0, 250.0]
AVERAGE_LEVELS = [925.0, 850.0, 700.0, 500.0, 300.0, 250.0]

SPECIFIC_HEAT = 1004.0        # J / (kg K)
GRAVITY = 9.8                 # m / s2
LATENT_HEAT = 2.5e6           # J / kg
REFERENCE_PRESSURE = 1000.0   # hPa

TITLES = {
    "cascade_bard_v1": "TECA BARD v1",
    "SCAFET": "SCAFET",
    "guan_waliser": "Guan & Waliser",
    "connect500": "Connect 500",
    "mundhenk_v3": "Mundhenk v3",
    "reid250": "Reid 250",
    "gershunov": "Gershunov",
    "lora_v2": "Lora v2",
}

# grid family, what the key names, key, collection, longitude name, latitude name
COLLECTIONS = [
    ("quarter_degree", "kind", "surface", "e5.oper.an.sfc", "longitude", "latitude"),
    ("quarter_degree", "kind", "levels", "e5.oper.an.pl", "longitude", "latitude"),
    ("quarter_degree", "kind", "pot", "potential_temperature", "longitude", "latitude"),
    ("quarter_degree", "kind", "ivt", "ivt", "longitude", "latitude"),
    ("native", "variable", "slp", "inst1_2d_asm_Nx", "lon", "lat"),
    ("native", "variable", "epv", "inst3_3d_asm_Np", "lon", "lat"),
    ("native", "variable", "qv", "inst3_3d_asm_Np", "lon", "lat"),
    ("native", "variable", "h", "inst3_3d_asm_Np", "lon", "lat"),
    ("native", "variable", "omega", "inst3_3d_asm_Np", "lon", "lat"),
    ("native", "variable", "tqv", "tavg1_2d_slv_Nx", "longitude", "latitude"),
    ("native", "kind", "pot", "potential_temperature", "longitude", "latitude"),
    ("native", "kind", "ivt", "native_1hour", "lon", "lat"),
    ("native", "kind", "precip", "merged_precipitation", "longitude", "latitude"),
]
