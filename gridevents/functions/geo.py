"""Coordinate arithmetic on degree columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def wrap_longitude(lon: Column) -> Column:
    """Longitude in the -180..180 frame (floor-mod, so negatives wrap too)."""
    return F.pmod(lon + F.lit(180.0), F.lit(360.0)) - F.lit(180.0)


def tile(coord: Column, size: float) -> Column:
    """Integer tile number of a coordinate."""
    return F.floor(coord / F.lit(float(size)))


def tiles_covering(lo: Column, hi: Column, size: float) -> Column:
    """Array of the tile numbers an inclusive interval touches."""
    return F.sequence(tile(lo, size), tile(hi, size))


def grid_step(coord: Column, origin: Column, step: Column) -> Column:
    """Index of a coordinate on a regular axis."""
    return F.round((coord - origin) / step).cast("long")


def first_step_inside(lo: Column, origin: Column, step: Column) -> Column:
    """Index of the first axis value that is at or past ``lo`` (never before 0)."""
    return F.greatest(F.ceil((lo - origin) / step), F.lit(0)).cast("long")


def clamp(value: Column, lo: Column, hi: Column) -> Column:
    """``value`` held between two bounds; the lower bound is applied last."""
    return F.greatest(lo, F.least(value, hi))
