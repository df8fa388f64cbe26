"""Facts about axes: frame, resolution, length, relative coordinates, order."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from gridevents.functions.geo import first_step_inside, grid_step, wrap_longitude
from gridevents.operators.ordering import coordinate_index

#: Degrees under which two distances are the same but for rounding.
SAME_DEGREES = 1e-4


def longitude_frame(df: DataFrame) -> DataFrame:
    """One row: the largest longitude and the frame it shows (360, 180 or unknown)."""
    return df.agg(F.max("lon").alias("max_lon")).withColumn(
        "frame", F.when(F.col("max_lon") >= 359, 360).when(F.col("max_lon") >= 179, 180))


def canonical_longitude(df: DataFrame, column: str = "lon") -> DataFrame:
    return df.withColumn(column, wrap_longitude(F.col(column)))


def _common_divisor(one: Column, two: Column) -> Column:
    """The distance of which both distances are multiples, up to rounding (``SAME_DEGREES``).

    Euclid with nearest remainders: each is at most half of the one before, so 32 steps are enough.
    """
    def step(state: Column, _: Column) -> Column:
        rest = F.abs(state["a"] - F.round(state["a"] / state["b"]) * state["b"])
        return F.when(state["b"] < SAME_DEGREES, state).otherwise(F.struct(state["b"].alias("a"), rest.alias("b")))
    start = F.struct(F.greatest(one, two).alias("a"), F.least(one, two).alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(32)), start, step)["a"]


def axis_facts(df: DataFrame, coord: str) -> DataFrame:
    """One row (origin, step, n_values, n_missing) on a regular axis, of which rows may be absent.

    The step is the common divisor of all gaps between the distinct values, so an absent grid
    row does not change it as long as the others still show it.  What is gathered is the axis,
    not the rows.  One value has step 0, an empty table NULL.
    """
    values = F.col("_values")
    gaps = F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(values) - 1),
                                        lambda i: F.round(F.get(values, i) - F.get(values, i - 1), 6)))
    listed = df.agg(F.sort_array(F.collect_set(coord)).alias("_values"))
    span = F.col("_last") - F.col("origin")
    base = F.aggregate(gaps, F.lit(0.0), _common_divisor)
    steps = F.round(span / F.col("_base"))
    return (listed.withColumn("_base", F.when(F.size(values) > 1, base))
                  .select(F.get(values, F.lit(0)).cast("double").alias("origin"), F.array_max(values).cast("double").alias("_last"),
                          F.size(values).cast("long").alias("n_values"), "_base")
                  .select("origin", F.when(F.col("_base").isNotNull(), span / steps).otherwise(span).alias("step"), "n_values",
                          (F.coalesce(steps.cast("long") + 1, F.col("n_values")) - F.col("n_values")).alias("n_missing")))


def axis_registry(df: DataFrame, coords: Sequence[str] = ("lat", "lon")) -> DataFrame:
    """(coord, origin, step, n_values, n_missing): the axes of a cube, to be stored with it."""
    parts = [axis_facts(df, c).select(F.lit(c).alias("coord"), "*") for c in coords]
    return reduce(DataFrame.unionByName, parts)


def axis_origin_and_step(df: DataFrame, coord: str) -> DataFrame:
    """One row (origin, step); ``df`` has the axis as a column, or is a registry of axes."""
    facts = df.where(F.col("coord") == coord) if "coord" in df.columns else axis_facts(df, coord)
    return facts.select("origin", "step")


def axis_length(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Number of distinct stamps, per group if asked."""
    return df.groupBy(*by).agg(F.count_distinct("time").alias("n_times"))


def time_range(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.min("time").alias("first_time"), F.max("time").alias("last_time"))


def relative_offsets(df: DataFrame, lat_shift: float = 0.0) -> DataFrame:
    """Coordinates as true offsets from the centre.

    ``lat_shift`` adds a constant to the latitude labels; one grid step there
    gives the labels of the quarter-degree composites (which sit one step high).
    """
    return (df.withColumn("rel_lat", F.col("lat") - F.col("centre_lat") + F.lit(float(lat_shift)))
              .withColumn("rel_lon", F.col("lon") - F.col("centre_lon")))


def relative_positions(df: DataFrame, axes: DataFrame, half_lat: float, half_lon: float) -> DataFrame:
    """Coordinates counted in grid steps from the lower edge of each box.

    The first grid value inside the box is labelled ``-half``, the next one
    ``-half + step`` and so on, whatever the centre is.  ``axes`` is any frame
    with the cube's full ``lat`` and ``lon``, or its stored ``axis_registry``: origin
    and step are read from it as scalar subqueries, and positions are arithmetic on the regular grid, so
    no per-event sort is needed.
    """
    out = df
    for coord, half in (("lat", half_lat), ("lon", half_lon)):
        facts = axis_origin_and_step(axes, coord).select(F.struct("origin", "step").alias("f")).scalar()
        out = out.withColumn("_axis", facts)
        origin, step = F.col("_axis.origin"), F.col("_axis.step")
        lowest = first_step_inside(F.col(f"centre_{coord}") - half, origin, step)
        steps = grid_step(F.col(coord), origin, step) - lowest
        out = out.withColumn(f"rel_{coord}", F.lit(-float(half)) + steps * step).drop("_axis")
    return out


def sorted_distinct(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct().orderBy(column)


def first_places(locations: DataFrame, n: int) -> DataFrame:
    """The first ``n`` places in list order (a top-k)."""
    return locations.orderBy("loc_id").limit(n)


def best_k(scores: DataFrame) -> DataFrame:
    """The k with the highest score; the smallest k on a tie."""
    return scores.orderBy(F.desc("score"), F.asc("k")).limit(1)


def dimension_order(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Columns in the given order; rows of a long table have no order to transpose."""
    rest = [c for c in df.columns if c not in order]
    return df.select(*order, *rest)


def at_positions(df: DataFrame, coord: str, positions: Sequence[int]) -> DataFrame:
    """Rows whose coordinate has one of the given 0-based positions on its axis."""
    chosen = coordinate_index(df, coord).where(F.col("pos").isin([int(p) for p in positions]))
    wanted = chosen.agg(F.collect_list(coord)).scalar()   # at most len(positions) values
    return df.where(F.array_contains(wanted, F.col(coord)))


def reduce_dims(df: DataFrame, over: Sequence[str], dims: Sequence[str], agg: Column) -> DataFrame:
    """Aggregate over the listed dimensions, keeping the others as keys."""
    keep = [d for d in dims if d not in over and d in df.columns]
    return df.groupBy(*keep).agg(agg)
