"""How detection algorithms differ: counts, totals, tags and timelines."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridevents.functions.times import hour_key
from gridevents.operators.events import (majority_tags, timeline, yearly_counts_with_zeros, yearly_totals)
from gridevents.operators.filters import keep_last
from gridevents.schema import TITLES


class Discrepancy(NamedTuple):
    counts: DataFrame
    totals: DataFrame
    tags: DataFrame
    timeline: DataFrame


def titles(spark: SparkSession, names: dict[str, str] = TITLES) -> DataFrame:
    """Display titles with the row number of each algorithm (from 1)."""
    rows = [(i, algo, title) for i, (algo, title) in enumerate(names.items(), start=1)]
    return spark.createDataFrame(rows, "ordinal int, algo string, title string")


def with_titles(events: DataFrame, names: dict[str, str]) -> DataFrame:
    """Events with title and row number of their algorithm.

    The lookup is written out in the caller's argument, so it becomes a literal
    map: no join.  Unknown algorithms are dropped, as by an inner join.
    """
    entries = [F.lit(x) for i, (algo, title) in enumerate(names.items(), start=1)
               for x in (algo, f"{i}|{title}")]
    found = F.try_element_at(F.create_map(*entries), F.col("algo"))
    return (events.withColumn("_entry", found).where(F.col("_entry").isNotNull())
            .withColumn("ordinal", F.substring_index("_entry", "|", 1).cast("int"))
            .withColumn("title", F.expr("substring(_entry, instr(_entry, '|') + 1)")).drop("_entry"))


def tagged_events(events: DataFrame) -> DataFrame:
    """Events with majority tags; of repeated events the highest label counts as the last."""
    unique = keep_last(events.select("algo", "loc_id", "time", "cluster"), ["algo", "loc_id", "time"], "cluster")
    return majority_tags(unique)


def discrepancy(events: DataFrame, locations: DataFrame, algorithms: Sequence[str], first_year: int,
                last_year: int) -> Discrepancy:
    """All comparison tables of a labelled event set."""
    counts = yearly_counts_with_zeros(events, locations, algorithms, first_year, last_year)
    tags = tagged_events(events)
    hours = tags.withColumn("time", hour_key(F.col("time"))).withColumn("cluster", F.col("tag"))
    return Discrepancy(counts, yearly_totals(counts), tags, timeline(hours, algorithms))
