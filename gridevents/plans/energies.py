"""Moist energies from humidity, height and temperature."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from gridevents.functions import physics
from gridevents.operators.align import wide
from gridevents.operators.filters import select_levels
from gridevents.schema import COMPOSITE_LEVELS


def moist_energies(field: DataFrame, levels: Sequence[float] = tuple(COMPOSITE_LEVELS),
                   years: Sequence[int] | None = None) -> DataFrame:
    """Static and dynamic energy (and equivalent temperature) at each point, all years and months at once."""
    cube = select_levels(field, levels)
    if years is not None:
        cube = cube.where(F.year("time").isin([int(y) for y in years]))
    t, q, z, level = F.col("T"), F.col("Q"), F.col("Z"), F.col("level")
    return wide(cube, ["Q", "Z", "T"]).select(
        "time", "level", "lat", "lon",
        physics.equivalent_temperature(t, q, level).alias("theta_e"),
        physics.static_energy(t, q, level).alias("mse"),
        physics.dynamic_energy(t, q, z).alias("mde"))
