"""Means over time, and departures from a climatology."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from gridevents.operators.axes import reduce_dims
from gridevents.operators.filters import select_region, select_season
from gridevents.operators.joins import equi_join, fits
from gridevents.session import written

CELL = ["variable", "level", "lat", "lon"]
#: Parts of a degree to which coordinates of two cubes are compared: computed ones may differ in the last bits.
GRID_PARTS = 10_000
#: Rows that one task joins with one climatology value.
HOT_ROWS = 1_000_000
CLIMATOLOGY_DIMS = ["variable", "mon", "level", "lat", "lon", "bnds"]


def time_mean(field: DataFrame, keys: Sequence[str] = tuple(CELL), value: str = "value",
              name: str = "mean_value") -> DataFrame:
    """Mean over time per cell."""
    return field.groupBy(*keys).agg(F.avg(value).alias(name))


def monthly_mean(field: DataFrame) -> DataFrame:
    """Mean per calendar month and cell."""
    return (field.withColumn("mon", F.month("time")).groupBy("mon", *CELL)
            .agg(F.avg("value").alias("mean_value")))


def mean_climatology(climatology: DataFrame, over: Sequence[str] = ("bnds", "mon")) -> DataFrame:
    """Climatology reduced over the listed dimensions (bounds and months by default)."""
    return reduce_dims(climatology, over, CLIMATOLOGY_DIMS, F.avg("value").alias("clim_value"))


def subtract_climatology(field: DataFrame, clim: DataFrame, name: str = "anomaly", spread: Sequence[str] = (),
                         hot_rows: int = HOT_ROWS) -> DataFrame:
    """Departure from a climatology with the same cells; cells without one drop out.

    The climatology is as large as the grid, so it is shuffled, not broadcast, and has one
    row per cell.  A cube has one row per stamp and cell: the merge streams.  Windows of
    events have a row per window that covers the cell, which is without bound where events
    crowd; ``spread`` names columns that tell them apart.  Cells with more than ``hot_rows``
    rows are then counted, their rows dealt to parts, and only their climatology is repeated.
    """
    joined = _cell_join(field, clim.select(*CELL, "clim_value"), [], spread, hot_rows)
    return joined.withColumn(name, F.col("value") - F.col("clim_value")).drop("clim_value")


def _cell_join(field: DataFrame, means: DataFrame, more: Sequence[str], spread: Sequence[str] = (),
               hot_rows: int = HOT_ROWS) -> DataFrame:
    """Rows with the value of their cell (and ``more`` keys); cells meet by integer grid numbers."""
    def numbers(df: DataFrame) -> DataFrame:
        return df.withColumns({f"_{c}": F.round(F.col(c) * GRID_PARTS).cast("long") for c in ("lat", "lon")})
    keys = [*more, "variable", "level", "_lat", "_lon"]
    rows, cells = numbers(field), numbers(means).drop("lat", "lon")
    if not spread:
        return equi_join(rows, cells, keys).drop("_lat", "_lon")
    rows = written(rows, "windows")  # counted, then joined
    crowded = written(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_rows)
                      .select(*keys, F.ceil(F.col("_n") / hot_rows).alias("_parts")), "crowded")
    small = fits(crowded)
    dealt = equi_join(rows, crowded, keys, "left", hint=small).withColumn(
        "_part", F.pmod(F.xxhash64(*spread), F.coalesce("_parts", F.lit(1)))).drop("_parts")
    parts = F.sequence(F.lit(0).cast("long"), F.coalesce("_parts", F.lit(1)) - 1)
    repeated = equi_join(cells, crowded, keys, "left", hint=small).withColumn("_part", F.explode(parts)).drop("_parts")
    return equi_join(dealt, repeated, [*keys, "_part"]).drop("_lat", "_lon", "_part")


def base_period(base: DataFrame, season: Sequence[str] = ("Jan", "Feb", "Dec"),
                lat: tuple[float, float] = (10, 60), lon: tuple[float, float] = (-170, -30)) -> DataFrame:
    """The season and region a monthly anomaly is measured against."""
    return select_season(select_region(base, lat, lon), season)


def monthly_anomaly(field: DataFrame, base: DataFrame, mode: str = "match") -> DataFrame:
    """Departure from the monthly mean of ``base``.

    ``match`` subtracts the mean of the stamp's own month.  ``cross`` subtracts
    every month's mean from every stamp and keeps ``clim_month``.
    """
    means = monthly_mean(base).withColumnRenamed("mean_value", "clim_value")
    if mode == "match":
        joined = _cell_join(field.withColumn("mon", F.month("time")), means, ["mon"])
        out = joined.drop("mon")
    elif mode == "cross":
        out = _cell_join(field, means.withColumnRenamed("mon", "clim_month"), [])
    else:
        raise ValueError("mode must be 'match' or 'cross'")
    return out.withColumn("anomaly", F.col("value") - F.col("clim_value")).drop("clim_value")
