"""Event-centred composites: the window of a cube around each event.

Order of work, chosen for a cube much larger than the event list: events get
their stamp and centre first, the box join then reads only the stamps in use,
and a climatology is subtracted from the composite rather than from the cube
(the other way round where events are so many that windows outgrow the cube).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from gridevents.functions.geo import wrap_longitude
from gridevents.operators import climate
from gridevents.operators.axes import canonical_longitude, relative_offsets, relative_positions
from gridevents.operators.boxjoin import few_boxes, join_event_boxes, months_in_use
from gridevents.operators.events import synthetic_stamp
from gridevents.operators.filters import keep_first, select_levels, select_region, select_variable
from gridevents.operators.joins import lookup_join
from gridevents.operators.ordering import event_ordinals
from gridevents.operators.timejoin import asof_lagged, asof_nearest
from gridevents.session import written

QUARTER_DEGREE = 0.25


def prepare_field(field: DataFrame, variable: str | None = None,
                  levels: Sequence[float] | None = None) -> DataFrame:
    """One variable on some levels, longitudes in one frame.

    A cube read with ``source_rank`` may hold a stamp in several files: the first
    file's row is kept.
    """
    out = select_variable(field, variable) if variable else field
    out = select_levels(out, levels) if levels else out
    if "source_rank" in out.columns:
        # the calendar columns are keys too, so that a cut to months goes below the aggregate, to the directories
        calendar = [c for c in ("year", "month") if c in out.columns]
        out = keep_first(out, ["variable", "time", "level", "lat", "lon", *calendar], "source_rank").drop("source_rank")
    return canonical_longitude(out)


def with_centres(events: DataFrame, locations: DataFrame) -> DataFrame:
    """Events with the centre of their place."""
    centres = locations.select("loc_id", F.col("lat").alias("centre_lat"),
                               wrap_longitude(F.col("lon")).alias("centre_lon"))
    return lookup_join(events, centres, ["loc_id"], [c for c in events.columns if c != "loc_id"])


def numbered_events(events: DataFrame, unique: bool = False) -> DataFrame:
    """Events with their ordinal per algorithm and year and its synthetic hourly stamp."""
    numbered = event_ordinals(events, unique=unique)
    return numbered.withColumn("synthetic_time", synthetic_stamp(F.col("year"), F.col("ordinal")))


def _labelled(window: DataFrame, field: DataFrame, labels: str, half_lat: float, half_lon: float,
              resolution: float) -> DataFrame:
    if labels == "offset":
        return relative_offsets(window)
    if labels == "reference":
        return relative_offsets(window, lat_shift=resolution)
    if labels == "positional":
        return relative_positions(window, field.select("lat", "lon"), half_lat, half_lon)
    raise ValueError("labels must be 'offset', 'reference' or 'positional'")


def composite_windows(field: DataFrame, matched: DataFrame, half_lat: float, half_lon: float,
                      labels: str = "offset", resolution: float = QUARTER_DEGREE,
                      climatology: DataFrame | None = None, few: bool | None = None) -> DataFrame:
    """The window of ``field`` around every matched event, with relative coordinates.

    ``matched`` has ``matched_time``, ``centre_lat``, ``centre_lon``; its other
    columns are carried through (the event stamp as ``event_time``).  It is a written
    table, as it is read several times.

    A climatology is subtracted from the windows of few events.  Many events share cells, and
    their windows hold far more rows than the cube: there it is subtracted from the cells of the
    months in use, which have one row per stamp, before the windows are cut.
    """
    events = matched.withColumnRenamed("time", "event_time")
    few = few_boxes(events) if few is None else few
    if climatology is None:
        window = join_event_boxes(field, events, half_lat, half_lon, few=few, stored=True)
    elif few:
        window = _departures(join_event_boxes(field, events, half_lat, half_lon, few=True), climatology)
    else:
        window = join_event_boxes(_departures(field, climatology), events, half_lat, half_lon, few=False, stored=True, plain=field)
    return _labelled(window, field, labels, half_lat, half_lon, resolution)


def _departures(rows: DataFrame, climatology: DataFrame) -> DataFrame:
    """Rows whose ``value`` is the departure from the climatology of their cell."""
    return climate.subtract_climatology(rows, climatology).withColumn("value", F.col("anomaly")).drop("anomaly")


def composite_raw(field: DataFrame, events: DataFrame, locations: DataFrame, half_lat: float = 15.0,
                  half_lon: float = 25.0, variable: str | None = None, levels: Sequence[float] | None = None,
                  labels: str = "offset", axis: DataFrame | None = None, axis_scope: str = "year",
                  tolerance: str | None = None, climatology: DataFrame | None = None,
                  unique_events: bool = False) -> DataFrame:
    """Composite at the stamp nearest to each event (see ``event_ordinals`` for ``unique_events``)."""
    cube = prepare_field(field, variable, levels)
    stamps = axis if axis is not None else cube
    matched = asof_nearest(numbered_events(events, unique_events), stamps, axis_scope, tolerance, asked=events)
    matched = written(with_centres(matched, locations), "matched")  # counted, listed by month and joined
    return composite_windows(cube, matched, half_lat, half_lon, labels, climatology=climatology, few=few_boxes(matched))


def composite_anomaly(field: DataFrame, events: DataFrame, locations: DataFrame, climatology: DataFrame,
                      **options) -> DataFrame:
    """Composite of departures from a climatology (``clim_value`` per variable, level and cell)."""
    clim = canonical_longitude(climatology)
    if options.get("variable"):
        clim = select_variable(clim, options["variable"])
    return composite_raw(field, events, locations, climatology=clim, **options)


def composite_native(field: DataFrame, events: DataFrame, locations: DataFrame, **options) -> DataFrame:
    """Composite labelled by grid position; the resolution is read from the cube."""
    return composite_raw(field, events, locations, labels="positional", **options)


def composite_lagged(field: DataFrame, events: DataFrame, locations: DataFrame, lags: Sequence[int] = (2, 4),
                     half_lat: float = 15.0, half_lon: float = 25.0, variable: str | None = None,
                     levels: Sequence[float] | None = None, axis: DataFrame | None = None,
                     axis_scope: str = "year", lag_unit: str = "steps", unique_events: bool = False) -> DataFrame:
    """Positional composites at several lags and for all algorithms, in one pass over the cube."""
    cube = prepare_field(field, variable, levels)
    stamps = axis if axis is not None else cube
    matched = asof_lagged(numbered_events(events, unique_events), stamps, lags, axis_scope, lag_unit, asked=events)
    matched = written(with_centres(matched, locations), "matched")
    return composite_windows(cube, matched, half_lat, half_lon, "positional", few=few_boxes(matched))


def composite_lagged_points(field: DataFrame, points: DataFrame, climatology: DataFrame,
                            lags: Sequence[int] = (4,), half_lat: float = 10.0, half_lon: float = 20.0,
                            variable: str | None = None, levels: Sequence[float] | None = None,
                            labels: str = "offset", axis: DataFrame | None = None,
                            axis_scope: str = "year") -> DataFrame:
    """Lagged composite of departures for events that have their own centre."""
    cube = prepare_field(field, variable, levels)
    clim = canonical_longitude(climatology)
    if variable:
        clim = select_variable(clim, variable)
    centred = (points.withColumnRenamed("lat", "centre_lat")
               .withColumn("centre_lon", wrap_longitude(F.col("lon"))).drop("lon"))
    stamps = axis if axis is not None else cube
    matched = written(asof_lagged(centred, stamps, lags, axis_scope), "matched")
    return composite_windows(cube, matched, half_lat, half_lon, labels, climatology=clim, few=few_boxes(matched))


def lagged_region_extract(field: DataFrame, events: DataFrame, lags: Sequence[int], lat: tuple[float, float],
                          lon: tuple[float, float], axis: DataFrame | None = None,
                          axis_scope: str = "year") -> DataFrame:
    """A fixed region of the cube at each event's lagged stamp, once per event and lag."""
    stamps = axis if axis is not None else field
    matched = written(asof_lagged(events, stamps, lags, axis_scope).withColumnRenamed("time", "event_time"), "matched")
    region = months_in_use(select_region(field, lat, lon), matched).withColumnRenamed("time", "matched_time")
    return lookup_join(region, matched, ["matched_time"], ["lat", "lon"])
