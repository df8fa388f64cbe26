"""Cutting a cube into blocks, numbering them, and thirds of a list."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from gridevents.functions.geo import grid_step
from gridevents.operators.axes import axis_origin_and_step
from gridevents.operators.joins import lookup_join, with_group_stats
from gridevents.operators.ordering import axis_positions, running_totals
from gridevents.operators.stats import block_of
from gridevents.session import written

#: Blocks of the first dimension that are numbered together.
BLOCK_RUN = 4096


def with_chunks(field: DataFrame, sizes: Mapping[str, int], registry: DataFrame | None = None) -> DataFrame:
    """Add ``chunk_<dim>``, the block number of each row along the chunked dimensions.

    ``sizes`` maps dimension to block length, e.g. ``{"time": 6, "level": 1}``.
    Stamps get their position by a join with the time axis.  Levels are few and
    uneven: their sorted list is one value.  Latitude and longitude are regular,
    so their position is arithmetic on the axis
    that the cube shows, or the one of a stored ``registry``.
    """
    out = field
    for dim, size in sizes.items():
        if dim == "time":
            # written: the field is read for its stamps once, not for every count of the axis
            axis = written(axis_positions(written(field.select("time").distinct(), "stamps")), "axis")
            out = lookup_join(out, axis, ["time"], [c for c in field.columns if c != "time"])
        elif dim == "level":
            listed = field.agg(F.sort_array(F.collect_set("level"))).scalar()
            out = out.withColumn("pos", F.array_position(listed, F.col("level")) - 1)
        else:
            facts = axis_origin_and_step(field if registry is None else registry, dim).select(F.struct("origin", "step").alias("f")).scalar()
            out = out.withColumn("_axis", facts)
            out = out.withColumn("pos", grid_step(F.col(dim), F.col("_axis.origin"), F.col("_axis.step"))).drop("_axis")
        out = out.withColumn(f"chunk_{dim}", F.floor(F.col("pos") / size).cast("long")).drop("pos")
    return out


def chunk_table(chunked: DataFrame, dims: list[str], counter: int = 0) -> DataFrame:
    """One row per block: its number, stamp count, leading stamp count and stamp range.

    Numbers continue from ``counter``.  Works on the block table, which has one
    row per block, not per cell.
    """
    keys = [f"chunk_{d}" for d in dims]
    blocks = chunked.groupBy(*keys).agg(
        F.count_distinct("time").cast("long").alias("n_times"),
        F.min("time").alias("first_time"), F.max("time").alias("last_time"))
    # Counted in levels, like every ordinal here: runs of blocks, then blocks.
    runs = blocks.withColumn("_run", F.floor(F.col(keys[0]) / BLOCK_RUN))
    totals = {"chunk_id": None, "offset": "n_times"}
    numbered = running_totals(runs, [], ["_run", keys[0]], keys[1:] or keys[:1], totals)
    return numbered.withColumn("chunk_id", F.col("chunk_id") + counter).drop("_run")


def with_group_size(df: DataFrame, keys: list[str], spread: list[str], name: str = "n_rows") -> DataFrame:
    return with_group_stats(df, keys, {name: F.count(F.lit(1))}, spread)


def with_third(df: DataFrame, pos: str = "pos", size: str = "n_rows") -> DataFrame:
    """Third (0, 1, 2) of a positioned list: n//3, n//3 and the rest."""
    return df.withColumn("third", block_of(pos, size, 3))
