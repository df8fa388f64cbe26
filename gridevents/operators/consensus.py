"""Stamps on which algorithms agree, and the cubes on and off them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from gridevents.operators.joins import equi_join, fits, lookup_join, salted_join


def consensus_times(events: DataFrame, n_algorithms: int, keys: Sequence[str] = ("time",)) -> DataFrame:
    """Keys (stamps, or stamps and places) reported by ``n_algorithms`` algorithms."""
    return (events.groupBy(*keys).agg(F.count_distinct("algo").alias("_n"))
            .where(F.col("_n") == n_algorithms).drop("_n"))


def shared_events(a: DataFrame, b: DataFrame) -> DataFrame:
    """Events (stamp, lon, lat) that are in both sets."""
    return a.select("time", "lon", "lat").intersect(b.select("time", "lon", "lat"))


def marked(df: DataFrame, days: DataFrame, name: str = "consensus") -> DataFrame:
    """All rows, with a flag that tells whether their stamp is in ``days``.

    Gives both subsets in one pass over the cube.
    """
    wanted = days.select("time").distinct().withColumn("_listed", F.lit(True))
    joined = lookup_join(df, wanted, ["time"], [c for c in df.columns if c != "time"], "left")
    return joined.withColumn(name, F.col("_listed").isNotNull()).drop("_listed")


def on_consensus(df: DataFrame, days: DataFrame, invert: bool = False) -> DataFrame:
    """Rows whose stamp is (or, inverted, is not) in ``days``."""
    how = "left_anti" if invert else "left_semi"
    wanted = days.select("time").distinct()
    if fits(wanted):
        return equi_join(df, wanted, ["time"], how, hint=True)
    return salted_join(df, wanted, ["time"], [c for c in df.columns if c != "time"], how, shuffled=True)
