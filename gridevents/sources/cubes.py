"""Reading cubes from Parquet, and cubes made from an axis."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from gridevents.functions.scaling import cell_normal, missing_to_null
from gridevents.operators.climate import monthly_anomaly
from gridevents.operators.filters import select_algorithms, select_levels
from gridevents.schema import CLIMATOLOGY, COLLECTIONS, FIELD

# Coordinate names met in collections, and the one used here.
COORDINATE_NAMES = {"latitude": "lat", "longitude": "lon", "lev": "level"}


def canonical_columns(df: DataFrame) -> DataFrame:
    """Coordinates under one set of names."""
    return df.withColumnsRenamed({k: v for k, v in COORDINATE_NAMES.items() if k in df.columns})


def clean(df: DataFrame, columns: Sequence[str] = ("value",)) -> DataFrame:
    """NaN to NULL, so that averages skip missing cells."""
    return df.withColumns({c: missing_to_null(F.col(c)) for c in columns if c in df.columns})


def scan_cube(df: DataFrame, variables: Sequence[str] | None = None, algorithms: Sequence[str] | None = None,
              levels: Sequence[float] | None = None, years: Sequence[int] | None = None,
              region: str | None = None) -> DataFrame:
    """The wanted part of a cube table.

    All conditions are plain predicates on stored columns: on partition columns
    they prune directories, on others they are pushed into the Parquet scan.
    """
    out = canonical_columns(df)
    if variables is not None:
        out = out.where(F.col("variable").isin(list(variables)))
    if algorithms is not None:
        out = select_algorithms(out, algorithms)
    if region is not None:
        out = out.where(F.col("region") == region)
    if levels is not None:
        out = select_levels(out, levels)
    if years is not None:
        year = F.col("year") if "year" in out.columns else F.year("time")
        out = out.where(year.isin([int(y) for y in years]))
    return clean(out)


def read_cube(spark: SparkSession, path: str, schema: T.StructType | None = None, **wanted) -> DataFrame:
    """Scan a stored cube; partition columns are found in its directory names."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return scan_cube(reader.parquet(path), **wanted)


def read_single(spark: SparkSession, path: str, levels: Sequence[float] | None = None,
                base: DataFrame | None = None, mode: str = "match") -> DataFrame:
    """One stored cube, optionally on some levels and as departure from a base cube."""
    field = read_cube(spark, path, FIELD, levels=levels)
    return field if base is None else monthly_anomaly(field, base, mode)


def read_climatology(spark: SparkSession, path: str, variables: Sequence[str] | None = None) -> DataFrame:
    return scan_cube(spark.read.schema(CLIMATOLOGY).parquet(path), variables)


def in_file_order(df: DataFrame) -> DataFrame:
    """Add ``source_rank``, the file a row came from: duplicates keep the first file's row.

    The path is a column of the scan, so later filters still reach it.
    """
    return df.withColumn("source_rank", F.col("_metadata.file_path"))


def collections(spark: SparkSession) -> DataFrame:
    """The table of collections (a fixed handful of rows)."""
    names = ["family", "key_kind", "key", "collection", "lon_name", "lat_name"]
    return spark.createDataFrame(COLLECTIONS, names)


def route(spark: SparkSession, requests: DataFrame) -> DataFrame:
    """Collection and coordinate names for each request (family, variable, kind).

    A variable of its own wins over its kind.  The collection table is a
    constant of this module, so broadcasting it is bounded by its source text.
    """
    table = F.broadcast(collections(spark))
    by_variable = requests.join(
        table.where("key_kind = 'variable'").select("family", F.col("key").alias("variable"),
                                                    *[F.col(c).alias(f"v_{c}") for c in _ROUTE]),
        ["family", "variable"], "left")
    both = by_variable.join(
        table.where("key_kind = 'kind'").select("family", F.col("key").alias("kind"),
                                                *[F.col(c).alias(f"k_{c}") for c in _ROUTE]),
        ["family", "kind"], "left")
    return both.select(*requests.columns, *[F.coalesce(f"v_{c}", f"k_{c}").alias(c) for c in _ROUTE])


_ROUTE = ["collection", "lon_name", "lat_name"]


def synthetic_cube(axis: DataFrame, n_lat: int = 73, n_lon: int = 144, scale: float = 0.1,
                   seed: int = 0) -> DataFrame:
    """Normal noise on a global grid, one frame per stamp of ``axis``.

    Latitudes run evenly from -90 to 90 and longitudes from 0 to 360.  The noise
    is a function of stamp and cell, so lost tasks recreate the same values.
    """
    cells = (axis.select("time").distinct()
             .withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n_lat - 1))))
             .withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(n_lon - 1)))))
    return cells.select(
        F.lit("PV").alias("variable"), "time", F.lit(None).cast("double").alias("level"),
        (F.lit(-90.0) + F.col("i") * (180.0 / (n_lat - 1))).alias("lat"),
        (F.col("j") * (360.0 / (n_lon - 1))).alias("lon"),
        (cell_normal(seed, F.col("time"), F.col("i"), F.col("j")) * scale).alias("value"))


