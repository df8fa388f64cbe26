"""Test cubes derived from stored ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gridevents.functions.scaling import cell_noise
from gridevents.operators.events import replicated
from gridevents.operators.joins import lookup_join
from gridevents.operators.ordering import axis_positions


def planted_frames(frames: DataFrame, step: int = 12, copies: int = 20, scale: float = 1.0,
                   seed: int = 0) -> DataFrame:
    """Every ``step``-th frame of a cube, repeated, with one noise field added to every copy.

    Copy and frame give the new ordinal axis ``pos``; the frame is its planted group.
    """
    axis = axis_positions(frames)
    chosen = axis.where(F.col("pos") % step == 0)
    chosen = chosen.select("time", F.floor(F.col("pos") / step).cast("long").alias("frame"))
    n_frames = chosen.agg(F.count(F.lit(1))).scalar()
    # The chosen stamps are part of the time axis; the copies are a fixed number.
    copied = replicated(lookup_join(frames, chosen, ["time"], ["lat", "lon"]), copies)
    noise = cell_noise(seed, F.col("variable"), F.col("lat"), F.col("lon"))
    return (copied.withColumn("value", F.col("value") / scale + noise)
                  .withColumn("pos", (F.col("replicate") * n_frames + F.col("frame")).cast("long")))
