"""Bringing variables onto one row, or onto one axis."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

POINT = ["time", "level", "lat", "lon"]


def wide(field: DataFrame, variables: Sequence[str], keys: Sequence[str] = tuple(POINT),
         complete: bool = True) -> DataFrame:
    """One row per point with a column per variable.

    A single aggregate over the long table aligns any number of variables with
    one shuffle.  ``complete`` keeps points where all are present.
    """
    columns = [F.max(F.when(F.col("variable") == v, F.col("value"))).alias(v) for v in variables]
    out = field.where(F.col("variable").isin(list(variables))).groupBy(*keys).agg(*columns)
    return out.na.drop("any", subset=list(variables)) if complete else out


def stacked_variables(field: DataFrame, level_variable: str, level: float, surface_variable: str,
                      surface_level: float | None = None) -> DataFrame:
    """Two variables under each other, one cut to a level (an outer alignment in long form).

    One pass over the cube with a condition per variable.  Without ``surface_level``
    the surface variable is the one stored without level.
    """
    name = F.col("variable")
    upper = (name == level_variable) & (F.col("level") == float(level))
    on_surface = F.col("level").isNull() if surface_level is None else F.col("level") == float(surface_level)
    lower = (name == surface_variable) & on_surface
    return field.where(upper | lower).withColumn("variable", F.upper("variable"))
