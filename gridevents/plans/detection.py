"""From a binary mask to event lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from gridevents.operators.axes import canonical_longitude
from gridevents.operators.boxjoin import join_boxes
from gridevents.operators.filters import at_least, select_season
from gridevents.sources.listings import parse_stamp_lists


def landing_boxes(locations: DataFrame, width: float = 1.0, height: float = 1.0) -> DataFrame:
    """The box east and north of each place."""
    return canonical_longitude(locations).select(
        "loc_id",
        F.col("lat").alias("lat_lo"), (F.col("lat") + height).alias("lat_hi"),
        F.col("lon").alias("lon_lo"), (F.col("lon") + width).alias("lon_hi"))


def box_means(mask: DataFrame, locations: DataFrame, season: Sequence[str] | None = None,
              width: float = 1.0, height: float = 1.0, area_weighted: bool = False) -> DataFrame:
    """Mean of the mask in each place's box, per algorithm and stamp.

    One job for all algorithms, years and places; the mean is pre-aggregated on
    the map side, so only (algorithm, place, stamp) sums are shuffled.
    """
    cells = select_season(mask, season) if season else mask
    inside = join_boxes(canonical_longitude(cells), landing_boxes(locations, width, height))
    if area_weighted:
        weight = F.when(F.col("tag").isNotNull(), F.cos(F.radians("lat")))
        mean = F.sum(F.col("tag") * weight) / F.nullif(F.sum(weight), F.lit(0.0))
    else:
        mean = F.avg("tag")
    return inside.groupBy("algo", "loc_id", "time").agg(mean.alias("box_mean"))


def landfall_events(mask: DataFrame, locations: DataFrame, season: Sequence[str] = ("Dec", "Jan", "Feb"),
                    threshold: float = 0.8, width: float = 1.0, height: float = 1.0,
                    area_weighted: bool = False) -> DataFrame:
    """Stamps at which a place's box mean reaches the threshold in the season."""
    means = box_means(mask, locations, season, width, height, area_weighted)
    return means.where(at_least("box_mean", threshold))


def concat_event_lists(lines: DataFrame) -> DataFrame:
    """All stamps of the yearly list files of each algorithm and place, as one event table."""
    return parse_stamp_lists(lines).select("algo", "loc_id", "time")
