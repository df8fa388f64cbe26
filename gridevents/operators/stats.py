"""Standardising and normalising."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from gridevents.functions.scaling import min_max, z_score
from gridevents.operators.joins import with_group_stats, with_total_stats


def total_mean_std(df: DataFrame, value: str = "value") -> DataFrame:
    """Mean and population standard deviation of all present values."""
    return df.agg(F.avg(value).alias("mean_value"), F.stddev_pop(value).alias("std_value"))


def eof_standardise(field: DataFrame, levels: Sequence[float] | None = None, weighted: bool = False,
                    by: Sequence[str] = ()) -> DataFrame:
    """Global z-score, optionally divided by the number of levels, gaps filled with its mean.

    The mean of a z-score is 0, so gaps become 0 without another pass; where there is
    no deviation there is no score, and gaps stay NULL.
    With ``by`` each group (e.g. each algorithm's cube) is standardised alone.
    """
    weight = float(len(levels)) if weighted and levels else 1.0
    source = field.where(F.col("level").isin([float(v) for v in levels])) if levels else field
    aggs = {"_mean": F.avg("value"), "_std": F.stddev_pop("value")}
    spread = ["time", "lat", "lon"]
    stats = with_group_stats(source, by, aggs, spread) if by else with_total_stats(source, aggs)
    score = z_score(F.col("value"), F.col("_mean"), F.col("_std"), weight)
    gap = F.when(F.col("value").isNull() & (F.col("_std") > 0), 0.0)
    return stats.withColumn("z", F.coalesce(score, gap)).drop("_mean", "_std")


def with_extremes(df: DataFrame, keys: Sequence[str], value: str, spread: Sequence[str]) -> DataFrame:
    """Add ``lo`` and ``hi`` of each group."""
    return with_group_stats(df, keys, {"lo": F.min(value), "hi": F.max(value)}, spread)


def normalise(df: DataFrame, keys: Sequence[str], value: str = "value", name: str = "norm",
              spread: Sequence[str] = ("lat", "lon")) -> DataFrame:
    """Scale each group to -1..1.

    Put ``level`` among the keys for level variables; a surface variable has a
    NULL level, which forms one group of its own, so the same call does both.
    """
    out = with_extremes(df, keys, value, spread)
    return out.withColumn(name, min_max(F.col(value), F.col("lo"), F.col("hi"))).drop("lo", "hi")


def block_of(pos: str, size: str, parts: int) -> Column:
    """Block number of a position when ``size`` rows are cut into ``parts`` blocks.

    Blocks have ``size div parts`` rows; the last takes the remainder.  With
    fewer rows than blocks everything falls into the last one.
    """
    per_block = F.floor(F.col(size) / F.lit(parts))
    return F.coalesce(F.least(F.floor(F.col(pos) / F.nullif(per_block, F.lit(0))), F.lit(parts - 1)),
                      F.lit(parts - 1)).cast("int")


def batched_z_score(df: DataFrame, feature: Sequence[str], splits: int, group: Sequence[str] = (),
                    value: str = "value", pos: str = "pos", size: str = "n_rows") -> DataFrame:
    """z-score per feature inside consecutive blocks of events; gaps become 0.

    ``pos`` is the event's position in its group and ``size`` the group's number
    of events.  Groups smaller than ``splits`` are an error, as blocks would be
    empty.  Block statistics are aggregated and joined back; an event has each
    feature once, so features share the rows evenly.
    """
    enough = F.when(F.col(size) >= splits, F.col(size)).otherwise(
        F.raise_error(F.lit("fewer events than blocks")).cast("long"))
    blocked = df.withColumn(size, enough).withColumn("block", block_of(pos, size, splits))
    aggs = {"_mean": F.avg(value), "_std": F.stddev_pop(value)}
    scored = with_group_stats(blocked, [*group, *feature, "block"], aggs, () if feature else [pos])
    z = F.coalesce(z_score(F.col(value), F.col("_mean"), F.col("_std")), F.lit(0.0))
    return scored.withColumn("z", z).drop("_mean", "_std")


def whole_z_score(df: DataFrame, feature: Sequence[str], group: Sequence[str] = (), value: str = "value",
                  pos: str = "pos", size: str = "n_rows") -> DataFrame:
    """The z-score over all events at once."""
    return batched_z_score(df, feature, 1, group, value, pos, size)


def time_deviation(field: DataFrame, cell: Sequence[str] = ("variable", "level", "lat", "lon"),
                   name: str = "deviation") -> DataFrame:
    """Departure of each value from its cell's mean over time."""
    out = with_group_stats(field, cell, {"_mean": F.avg("value")})
    return out.withColumn(name, F.col("value") - F.col("_mean")).drop("_mean")
