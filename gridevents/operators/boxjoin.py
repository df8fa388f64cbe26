"""Band joins of grid cells with boxes: equal tiles first, then the exact box.

A band join alone compares every cell with every box.  Cells and boxes are put
on coarse tiles instead, which makes an equi-join that a hash join can run, and
the box test drops what the tile lets through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gridevents.functions.geo import tile, tiles_covering
from gridevents.operators.joins import BROADCAST_ROWS, equi_join, fits, lookup_join, salted_join
from gridevents.session import written

#: Boxes on one (time, tile) that one task serves before the tile is split.
BOXES_PER_TASK = 10_000
#: Stamps at which boxes and cells are counted.
COUNTED_STAMPS = 32


def box_tiles(boxes: DataFrame, size: tuple[float, float]) -> DataFrame:
    """One row per box and tile it touches.  Boxes have lat_lo, lat_hi, lon_lo, lon_hi."""
    return (boxes
            .withColumn("_ti", F.explode(tiles_covering(F.col("lat_lo"), F.col("lat_hi"), size[0])))
            .withColumn("_tj", F.explode(tiles_covering(F.col("lon_lo"), F.col("lon_hi"), size[1]))))


def cell_tiles(cells: DataFrame, size: tuple[float, float]) -> DataFrame:
    return cells.withColumn("_ti", tile(F.col("lat"), size[0])).withColumn("_tj", tile(F.col("lon"), size[1]))


def _inside() -> Column:
    return F.col("lat").between(F.col("lat_lo"), F.col("lat_hi")) & \
        F.col("lon").between(F.col("lon_lo"), F.col("lon_hi"))


_HELPERS = ("lat_lo", "lat_hi", "lon_lo", "lon_hi", "_ti", "_tj")


def join_boxes(cells: DataFrame, boxes: DataFrame, size: tuple[float, float] = (1.0, 1.0), spread: tuple[str, ...] = ("time",),
               max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Cells with every fixed box they lie in (edges included).

    The boxes are broadcast when they were counted to be few; otherwise both
    sides are shuffled by tile, and a tile's cells are salted by ``spread``.
    """
    tiled = box_tiles(boxes, size)
    joined = lookup_join(cell_tiles(cells, size), tiled, ["_ti", "_tj"], spread, max_rows=max_rows)
    return joined.where(_inside()).drop(*_HELPERS)


def centred_boxes(events: DataFrame, half_lat: float, half_lon: float,
                  lat: str = "centre_lat", lon: str = "centre_lon") -> DataFrame:
    """Add the edges of a box around each event's centre."""
    return (events.withColumn("lat_lo", F.col(lat) - half_lat).withColumn("lat_hi", F.col(lat) + half_lat)
                  .withColumn("lon_lo", F.col(lon) - half_lon).withColumn("lon_hi", F.col(lon) + half_lon))


def tile_size(half_lat: float, half_lon: float) -> tuple[float, float]:
    """Tiles of half a box per axis: a box touches nine at most, a little over twice its area."""
    return float(half_lat), float(half_lon)


#: Tiles that one box can touch with tiles of half its size.
TILES_PER_BOX = 9


def few_boxes(events: DataFrame, per_event: int = 1, max_rows: int = BROADCAST_ROWS) -> bool:
    """True when the boxes of ``events`` surely fit the broadcast bound.

    Counts the bare events, before any time join; ``per_event`` is the number of
    boxes each of them becomes (its lags).
    """
    return fits(events, max_rows // (per_event * TILES_PER_BOX))


def join_event_boxes(field: DataFrame, events: DataFrame, half_lat: float, half_lon: float,
                     few: bool | None = None, max_rows: int = BROADCAST_ROWS, stored: bool = False,
                     plain: DataFrame | None = None) -> DataFrame:
    """Field cells at each event's ``matched_time`` inside the box around its centre.

    ``events`` carries ``matched_time``, ``centre_lat``, ``centre_lon``.  The
    time equality comes first, so only the stamps of events are looked at.
    ``few`` is a size check already made (see ``few_boxes``); without it the
    events are counted here.

    * Few events (counted): their tiles are broadcast and the field is not
      shuffled at all.
    * Many events: they are written out once, as they are read several times (not
      again if they are ``stored``).  Either each box is put on the tiles it touches,
      or, where boxes outnumber cells, on the tile of its centre only, and each cell
      on the tiles of the centres it can belong to: the side with fewer rows is
      repeated, as all that is shuffled stays on disk until the query ends.
      ``plain`` may name a plainer frame of the same cells, to be counted.
      The field is cut to the (time, tile) pairs in use.  A pair that many boxes
      ask for is split: its boxes are dealt out to parts and its cells are
      repeated per part, so that no task serves a hot stamp alone.  All other
      pairs stay as they are.

    Of a stored cube with ``year`` and ``month`` directories only those of events
    are opened.
    """
    size = tile_size(half_lat, half_lon)
    key = ["_t", "_ti", "_tj"]
    cells = months_in_use(field, events).withColumnRenamed("time", "_t")
    if few if few is not None else few_boxes(events, max_rows=max_rows):
        joined = equi_join(cell_tiles(cells, size), _event_tiles(events, half_lat, half_lon, size), key, hint=True)
    else:
        events = events if stored else written(events, "matched")
        crowded = boxes_outnumber(field if plain is None else plain, events)
        if crowded:
            cells = _reached_tiles(cells, half_lat, half_lon, size)
            boxes = events.withColumnRenamed("matched_time", "_t").withColumns(
                {"_ti": tile(F.col("centre_lat"), size[0]), "_tj": tile(F.col("centre_lon"), size[1])})
        else:
            cells, boxes = cell_tiles(cells, size), _event_tiles(events, half_lat, half_lon, size)
        joined = _join_many(cells, boxes, key, max_rows, boxes_first=crowded)
    return centred_boxes(joined, half_lat, half_lon).where(_inside()).withColumnRenamed("_t", "matched_time").drop(*_HELPERS)


def months_in_use(field: DataFrame, events: DataFrame) -> DataFrame:
    """A stored cube cut to the directories of months that have events.

    The list of months is one scalar subquery of at most twelve numbers a year,
    evaluated before the scan, which then opens only those directories.
    """
    if not {"year", "month"} <= set(field.columns):
        return field
    asked = F.year("matched_time") * 100 + F.month("matched_time")
    months = events.select(asked.alias("_m")).distinct().agg(F.collect_list("_m")).scalar()
    return field.where(F.array_contains(months, F.col("year") * 100 + F.col("month"))).drop("year", "month")


def _event_tiles(events: DataFrame, half_lat: float, half_lon: float, size: tuple[float, float]) -> DataFrame:
    """One row per event and tile its box touches; the edges are left out, as the centre gives them."""
    tiled = box_tiles(centred_boxes(events, half_lat, half_lon), size).drop("lat_lo", "lat_hi", "lon_lo", "lon_hi")
    return tiled.withColumnRenamed("matched_time", "_t")


def _reached_tiles(cells: DataFrame, half_lat: float, half_lon: float, size: tuple[float, float]) -> DataFrame:
    """One row per cell and tile in which the centre of a box that holds it can lie."""
    edge = 1e-9  # the box test rounds differently; the exact test follows
    return (cells
            .withColumn("_ti", F.explode(tiles_covering(F.col("lat") - (half_lat + edge), F.col("lat") + (half_lat + edge), size[0])))
            .withColumn("_tj", F.explode(tiles_covering(F.col("lon") - (half_lon + edge), F.col("lon") + (half_lon + edge), size[1]))))


def boxes_outnumber(field: DataFrame, events: DataFrame, stamps: int = COUNTED_STAMPS) -> bool:
    """True when events have more boxes than the field has cells, counted at some of their stamps.

    It chooses the side that is repeated for tiles; the rows of the join are the same either way.
    Of a stored cube only the directories of these stamps' months are opened.
    """
    some = events.select("matched_time").distinct().orderBy(F.xxhash64("matched_time"), "matched_time").limit(stamps)
    some = some.agg(F.collect_list("matched_time")).scalar()
    at_some = events.where(F.array_contains(some, F.col("matched_time")))
    return at_some.count() > months_in_use(field, at_some).where(F.array_contains(some, F.col("time"))).count()


def _join_many(cells: DataFrame, boxes: DataFrame, key: list[str], max_rows: int, boxes_first: bool) -> DataFrame:
    """Shuffled join of cells and boxes on (time, tile), splitting pairs with very many boxes.

    Boxes are exploded rows of a small file: left to its estimate the planner would broadcast them all.
    Cells are cut to the pairs in use where these fit a broadcast; a shuffle for that would move them twice.
    A merge join holds the rows of a pair from its second side: that is to be the one with fewer.
    """
    columns = [*cells.columns, *[c for c in boxes.columns if c not in key]]

    def met(by: list[str]) -> DataFrame:
        sides = (boxes, cells) if boxes_first else (cells, boxes)
        return equi_join(*sides, by, shuffled=True).select(*columns)

    parts = F.ceil(F.count(F.lit(1)) / F.lit(BOXES_PER_TASK)).cast("long")
    asked = boxes.groupBy(*key).agg(parts.alias("_parts"))
    n_keys, n_split = asked.agg(F.count(F.lit(1)), F.count_if(F.col("_parts") > 1)).first()
    if n_keys <= max_rows:
        cells = equi_join(cells, asked.select(*key), key, hint=True)
    if not n_split:
        return met(key)
    split = asked.where("_parts > 1")

    def counted(df: DataFrame, spread: list[str]) -> DataFrame:
        found = (equi_join(df, split, key, "left", hint=True) if n_split <= max_rows
                 else salted_join(df, split, key, spread, "left", shuffled=True))
        return found.withColumn("_parts", F.coalesce("_parts", F.lit(1)))

    cells = counted(cells, [c for c in cells.columns if c not in key])
    cells = cells.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1))).drop("_parts")
    row = [c for c in boxes.columns if c not in key]
    boxes = counted(boxes, row).withColumn("_part", F.pmod(F.xxhash64(*row), F.col("_parts"))).drop("_parts")
    return met([*key, "_part"])
