"""Text lists: places, event stamps, cluster labels.

The parsers take a frame of lines (as ``spark.read.text`` gives), so a folder of
any number of files is one distributed read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from gridevents.functions.text import before_colon, first_digit, inner_tokens, pair_part, stamps_in
from gridevents.functions.times import parse_stamp
from gridevents.operators.filters import well_formed_stamps
from gridevents.operators.ordering import running_position, strided
from gridevents.schema import EVENT_POINT


def parse_places(lines: DataFrame, order: str, lon_first: bool = False) -> DataFrame:
    """Places from ``(a, b)`` lines, numbered ``loc_id`` by the column ``order``.

    ``lon_first`` says which of the two numbers comes first.  A place list is at
    most one row per grid cell, which bounds the numbering window.
    """
    first, second = pair_part(F.col("value"), 1), pair_part(F.col("value"), 2)
    lat, lon = (second, first) if lon_first else (first, second)
    places = (lines.select(F.col(order).alias("_rank"), lat.alias("lat"), lon.alias("lon"))
              .where(F.col("lat").isNotNull() & F.col("lon").isNotNull()))
    number = F.row_number().over(W.orderBy("_rank", "lat", "lon")) - 1
    return places.select(number.cast("long").alias("loc_id"), "lat", "lon")


def every_nth_place(places: DataFrame, step: int = 6) -> DataFrame:
    """Every ``step``-th place of a list."""
    return strided(places, step, "loc_id")


def read_places(spark: SparkSession, path: str, lon_first: bool = False) -> DataFrame:
    """Places of a text list, in the order of its files, their splits and lines."""
    lines = spark.read.text(path)
    at = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id())
    return parse_places(lines.withColumn("_order", at), "_order", lon_first)


def parse_stamp_lists(lines: DataFrame) -> DataFrame:
    """One row per stamp in list lines; other columns are kept.

    Serves both shapes of list file (one bracketed list, or a stamp per line):
    stamps are found by their form.  An empty list gives no row.
    """
    keep = [c for c in lines.columns if c != "value"]
    found = lines.select(*keep, F.explode(stamps_in(F.col("value"))).alias("stamp"))
    return well_formed_stamps(found).drop("stamp")


def parse_event_lines(lines: DataFrame) -> DataFrame:
    """One row per line that is a stamp (text before the first comma); blanks are dropped."""
    stamps = lines.withColumn("stamp", F.substring_index("value", ",", 1)).drop("value")
    return well_formed_stamps(stamps).drop("stamp")


def parse_hour_keys(lines: DataFrame) -> DataFrame:
    """Distinct hour keys of bracketed lines, without each line's first two and last entries."""
    tokens = lines.select(F.explode(inner_tokens(F.col("value"))).alias("token"))
    return tokens.select(before_colon(F.col("token")).alias("hour")).distinct().orderBy("hour")


def read_event_lists(spark: SparkSession, path: str) -> DataFrame:
    """Event list folders ``algo=…/loc_id=…[/year=…]``: directory names become columns."""
    return parse_stamp_lists(spark.read.text(path)).drop("year")


def read_packed_lists(spark: SparkSession, path: str, place: int | None = None) -> DataFrame:
    """(algo, loc_id, time) of packed lists; for one ``place`` only the files that may hold it are opened."""
    lines = spark.read.text(f"{path}/lists")
    if place is not None:
        index = spark.read.parquet(f"{path}/index").where(F.lit(place).between(F.col("first_place"), F.col("last_place")))
        files = [r["file"] for r in index.select("file").collect()]  # one an algorithm and year
        if not files:
            lines = lines.limit(0)
        else:
            lines = spark.read.option("basePath", f"{path}/lists").text(files)
    parts = lines.select("algo", F.substring_index("value", "\t", 1).cast("long").alias("loc_id"),
                         F.substring_index("value", "\t", -1).alias("value"))
    return parse_stamp_lists(parts if place is None else parts.where(F.col("loc_id") == place))


def read_labels(spark: SparkSession, path: str, first_character_only: bool = False) -> DataFrame:
    """Cluster labels of text files, a label a line, numbered ``pos`` in the order of files, their splits and lines.

    Positions are counted in levels: lines of a split, then splits (``running_position``).
    """
    part = F.struct("_metadata.file_path", "_metadata.file_block_start")
    lines = spark.read.text(path).withColumn("_part", part).withColumn("_line", F.monotonically_increasing_id())
    return parse_labels(running_position(lines, [], ["_part"], ["_line"], "pos"), first_character_only).select("pos", "cluster")


def read_event_points(spark: SparkSession, path: str) -> DataFrame:
    """``time,lon,lat`` lines; each event has its own centre."""
    return spark.read.csv(path, schema=EVENT_POINT)


def parse_event_points(lines: DataFrame) -> DataFrame:
    """The same from a frame of lines."""
    parts = F.split("value", ",")
    return lines.select(parse_stamp(parts[0]).alias("time"), parts[1].try_cast("double").alias("lon"),
                        parts[2].try_cast("double").alias("lat"))


def parse_labels(lines: DataFrame, first_character_only: bool = False) -> DataFrame:
    """Cluster labels from lines; the short form reads the first character only."""
    text = F.trim("value")
    label = first_digit(text) if first_character_only else text.try_cast("int")
    keep = [c for c in lines.columns if c != "value"]
    return lines.select(*keep, label.alias("cluster"))
