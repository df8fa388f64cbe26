"""Text sinks: event lists and place lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gridevents.functions.text import bracket_list
from gridevents.functions.times import stamp_text
from gridevents.operators.events import yearly_lists


def yearly_list_lines(events: DataFrame) -> DataFrame:
    """One bracketed line of stamps per algorithm, place and year."""
    texts = F.transform("stamps", stamp_text)
    return yearly_lists(events).select("algo", "loc_id", "year", bracket_list(texts).alias("value"))


def write_yearly_lists(events: DataFrame, path: str) -> None:
    lines = yearly_list_lines(events)
    lines.hint("rebalance", "algo", "loc_id", "year").write.partitionBy("algo", "loc_id", "year").text(path)


def write_event_lists(events: DataFrame, path: str) -> None:
    """One stamp per line, a folder per algorithm and place; a large place has several files."""
    lines = events.select("algo", "loc_id", stamp_text(F.col("time")).alias("value"))
    (lines.hint("rebalance", "algo", "loc_id").sortWithinPartitions("algo", "loc_id", "value")
     .write.partitionBy("algo", "loc_id").text(path))


def write_packed_lists(events: DataFrame, path: str) -> None:
    """Yearly lists of all places together: ``path/lists/algo=/year=`` holds lines ``place<TAB>[stamps]``.

    Folders do not grow with the places.  Files hold disjoint ranges of places, and
    ``path/index`` says which: (algo, year, file, first_place, last_place, n_lines).
    """
    lines = yearly_list_lines(events).select("algo", "year", "loc_id", F.concat_ws("\t", F.col("loc_id").cast("string"), "value").alias("value"))
    (lines.repartitionByRange("algo", "year", "loc_id").sortWithinPartitions("algo", "year", "loc_id").drop("loc_id")
          .write.partitionBy("algo", "year").text(f"{path}/lists"))
    place = F.substring_index("value", "\t", 1).cast("long")
    stored = events.sparkSession.read.text(f"{path}/lists").select("algo", "year", F.col("_metadata.file_path").alias("file"), place.alias("place"))
    (stored.groupBy("algo", "year", "file")
           .agg(F.min("place").alias("first_place"), F.max("place").alias("last_place"), F.count(F.lit(1)).alias("n_lines"))
           .coalesce(1).write.parquet(f"{path}/index"))


def place_lines(locations: DataFrame) -> DataFrame:
    return locations.select(F.format_string("(%s, %s)", "lat", "lon").alias("value"))


def write_places(locations: DataFrame, path: str) -> None:
    """``(lat, lon)`` lines in list order; one line per place."""
    ordered = locations.orderBy("loc_id")
    place_lines(ordered).write.text(path)
