"""Event lists: counts, ordinals, synthetic stamps, cluster tags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from gridevents.functions.times import hours_after, year_start
from gridevents.operators.joins import salted_join, with_group_stats


def per_year(locations: DataFrame, first: int, last: int) -> DataFrame:
    """Each place once per year."""
    return locations.withColumn("year", F.explode(F.sequence(F.lit(first), F.lit(last))))


def yearly_counts(events: DataFrame) -> DataFrame:
    return (events.withColumn("year", F.year("time")).groupBy("algo", "loc_id", "year")
            .agg(F.count(F.lit(1)).alias("n_events")))


def yearly_counts_with_zeros(events: DataFrame, locations: DataFrame, algorithms: Sequence[str],
                             first: int, last: int) -> DataFrame:
    """Event count per algorithm, place and year; years without events count 0."""
    algo = F.explode(F.array(*[F.lit(a) for a in algorithms]))
    frame = per_year(locations.select("loc_id"), first, last).withColumn("algo", algo)
    joined = frame.join(yearly_counts(events), ["algo", "loc_id", "year"], "left")
    return joined.withColumn("n_events", F.coalesce("n_events", F.lit(0)))


def yearly_totals(counts: DataFrame) -> DataFrame:
    """Counts summed over places: per algorithm and year, per algorithm, and overall."""
    return counts.rollup("algo", "year").agg(F.sum("n_events").alias("n_events"))


def yearly_lists(events: DataFrame, name: str = "stamps") -> DataFrame:
    """Sorted list of distinct stamps per algorithm, place and year.

    A list holds at most one year's stamps of one place.
    """
    stamps = events.select("algo", "loc_id", F.year("time").alias("year"), "time").distinct()
    return stamps.groupBy("algo", "loc_id", "year").agg(F.sort_array(F.collect_list("time")).alias(name))


def synthetic_stamp(year: Column, ordinal: Column) -> Column:
    """An hourly stamp per ordinal, counted from the start of the year."""
    return hours_after(year_start(year), ordinal)


def with_labels(events: DataFrame, labels: DataFrame, key: Sequence[str] = ("event_id",)) -> DataFrame:
    """Events with their cluster, matched by key."""
    return salted_join(events, labels, list(key), list(events.columns), shuffled=True)


def majority_tags(events: DataFrame) -> DataFrame:
    """Tag 10 for an algorithm's larger cluster and 20 for its smaller one.

    For two clusters, 0 and 1.  Equal sizes leave the labels as they are.
    """
    ones = F.sum(F.when(F.col("cluster") == 1, 1).otherwise(0))
    zeros = F.sum(F.when(F.col("cluster") == 0, 1).otherwise(0))
    spread = [c for c in events.columns if c != "algo"]
    sized = with_group_stats(events, ["algo"], {"_ones": ones, "_zeros": zeros}, spread)
    own = F.when(F.col("cluster") == 1, F.col("_ones")).otherwise(F.col("_zeros"))
    other = F.when(F.col("cluster") == 1, F.col("_zeros")).otherwise(F.col("_ones"))
    tag = F.when(own > other, 10).when(own < other, 20).otherwise(F.col("cluster"))
    return sized.withColumn("tag", tag).drop("_ones", "_zeros")


def cluster_sizes(events: DataFrame) -> DataFrame:
    return events.groupBy("algo", "cluster").agg(F.count(F.lit(1)).alias("n_events"))


def lagged(events: DataFrame, lags: Sequence[int]) -> DataFrame:
    """Each event once per lag."""
    return events.withColumn("lag", F.explode(F.array(*[F.lit(int(v)) for v in lags])))


def replicated(df: DataFrame, copies: int) -> DataFrame:
    """Each row ``copies`` times, numbered ``replicate``."""
    return df.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))


def timeline(events: DataFrame, algorithms: Sequence[str]) -> DataFrame:
    """Cluster per place and stamp, one column per algorithm."""
    return events.groupBy("loc_id", "time").pivot("algo", list(algorithms)).agg(F.max("cluster"))


def timeline_axis(events: DataFrame) -> DataFrame:
    """Distinct stamps over all algorithms."""
    return events.select("time").distinct()


def lookup_map(df: DataFrame, key: Column, value: Column, by: Sequence[str], name: str = "entries") -> DataFrame:
    """A map per group, for handing results out; groups are one place and year at most."""
    return df.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, value)))).alias(name))
