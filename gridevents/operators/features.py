"""Composites as feature vectors, one per event.

The window of a composite is a regular grid, so a cell's place in the vector is
arithmetic on its offsets: no list of features is built, joined or crossed.
Cells that an event lacks become 0 by padding the gaps between those it has.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class Window:
    """Half widths and steps of a composite window, in degrees."""

    half_lat: float
    half_lon: float
    step_lat: float
    step_lon: float

    @property
    def n_lat(self) -> int:
        return int(round(2 * self.half_lat / self.step_lat)) + 1

    @property
    def n_lon(self) -> int:
        return int(round(2 * self.half_lon / self.step_lon)) + 1

    def size(self, variables: int) -> int:
        return self.n_lat * self.n_lon * variables


def feature_index(window: Window, variables: Sequence[str]) -> Column:
    """Place of a cell in the vector: by longitude, then latitude, then variable."""
    i_lon = F.round((F.col("rel_lon") + window.half_lon) / window.step_lon)
    i_lat = F.round((F.col("rel_lat") + window.half_lat) / window.step_lat)
    names = F.array(*[F.lit(v) for v in variables])
    i_var = F.array_position(names, F.col("variable")) - 1
    return ((i_lon * window.n_lat + i_lat) * len(variables) + i_var).cast("int")


def padded(entries: Column, size: int) -> Column:
    """Dense array of ``size`` values from sorted (i, z) entries, 0 where there is none."""
    def piece(x: Column, n: Column) -> Column:
        before = F.when(n == 0, -1).otherwise(F.try_element_at(entries, n)["i"])
        return F.concat(F.array_repeat(F.lit(0.0), x["i"] - before - 1), F.array(x["z"]))

    last = F.coalesce(F.try_element_at(entries, F.lit(-1))["i"], F.lit(-1))
    tail = F.array_repeat(F.lit(0.0), F.lit(size - 1) - last)
    return F.concat(F.flatten(F.transform(entries, piece)), tail)


def feature_arrays(df: DataFrame, event: Sequence[str], window: Window, variables: Sequence[str],
                   z: str = "z") -> DataFrame:
    """One row per event with ``features``, an array of every cell and variable.

    An event's group is its window: ``window.size`` entries, whatever the data.  A cell
    outside the window, an unknown variable, and two values for one place are errors.
    """
    place = feature_index(window, variables)
    inside = F.coalesce(place.between(0, window.size(len(variables)) - 1) & F.col("variable").isin(list(variables)), F.lit(False))
    checked = F.when(inside, place).otherwise(F.raise_error(F.lit("a cell lies outside the window")).cast("int"))
    indexed = df.select(*event, checked.alias("i"), F.col(z).alias("z"))
    entries = F.array_sort(F.collect_list(F.struct("i", "z")))
    packed = indexed.groupBy(*event).agg(entries.alias("_entries"))
    once = F.size(F.array_distinct(F.col("_entries.i"))) == F.size("_entries")
    packed = packed.withColumn("_entries", F.when(once, F.col("_entries")).otherwise(
        F.raise_error(F.lit("two values for one place of a vector")).cast(packed.schema["_entries"].dataType)))
    return packed.select(*event, padded(F.col("_entries"), window.size(len(variables))).alias("features"))


def as_vectors(df: DataFrame, features: str = "features") -> DataFrame:
    """The array column as an ML vector."""
    return df.withColumn(features, array_to_vector(F.col(features)))
