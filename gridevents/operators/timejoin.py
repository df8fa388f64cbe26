"""As-of joins of events with a time axis: nearest stamp, and lagged stamp.

Both work on distinct stamps.  Axis and event stamps are laid side by side in ranges
of time that hold about as many stamps each (quantiles, wherever in the calendar the
stamps crowd); inside a range a running window finds the neighbours, and a table of
range edges supplies the neighbour where it lies in another range.  The result is a
mapping from event stamp to axis stamp, joined back to the events, which keeps
their multiplicity.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from gridevents.functions.geo import clamp
from gridevents.operators.joins import equi_join, lookup_join, salted_join
from gridevents.operators.ordering import axis_positions
from gridevents.session import written

#: Stamps of one range, about; a task looks for neighbours in one.
RANGE_STAMPS = 250_000


def _scope_of(df: DataFrame, axis_scope: str, by: str = "time") -> DataFrame:
    """The axis an event belongs to: the calendar year of ``by``, or the one global axis."""
    if axis_scope == "year":
        return df.withColumn("_scope", F.year(by))
    if axis_scope == "global":
        return df.withColumn("_scope", F.lit(0))
    raise ValueError("axis_scope must be 'year' or 'global'")


def neighbours(stamps: DataFrame, axis: DataFrame) -> DataFrame:
    """For each (``_scope``, ``time``): the axis entries at or before and at or after it.

    ``axis`` has ``_scope``, ``time`` and whatever else is to be carried (such
    as ``pos``).  Adds structs ``_prev`` and ``_next`` of an axis row, NULL past
    the ends of the axis.
    """
    carried = ["time", *[c for c in axis.columns if c not in ("_scope", "time")]]
    entry = F.struct(*carried)
    marks = axis.select("_scope", "time", entry.alias("_entry"), F.lit(False).alias("_asked"))
    asked = stamps.select("_scope", "time").distinct().select(
        "_scope", "time", F.lit(None).cast(marks.schema["_entry"].dataType).alias("_entry"), F.lit(True).alias("_asked"))
    both = marks.unionByName(asked)
    ranges = -(-(stamps.count() + axis.count()) // RANGE_STAMPS)  # of written tables: their footers are read
    if ranges > 1:  # written, so that a lost task finds the same ranges
        both = written(both.repartitionByRange(ranges, "_scope", "time").withColumn("_range", F.spark_partition_id()), "ranges")
    keys = ["_scope", "_range"] if ranges > 1 else ["_scope"]
    inside = W.partitionBy(*keys)
    upto = inside.orderBy("time").rangeBetween(W.unboundedPreceding, 0)
    onward = inside.orderBy(F.desc("time")).rangeBetween(W.unboundedPreceding, 0)
    local = (both.withColumn("_before", F.last("_entry", ignorenulls=True).over(upto))
                 .withColumn("_after", F.last("_entry", ignorenulls=True).over(onward))
                 .where("_asked"))
    if ranges == 1:
        return local.select("_scope", "time", F.col("_before").alias("_prev"), F.col("_after").alias("_next"))

    # One row per scope and range: these windows run over edges, not over stamps.
    edges = both.groupBy(*keys).agg(F.max("_entry").alias("_hi"), F.min("_entry").alias("_lo"))
    earlier = W.partitionBy("_scope").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    later = W.partitionBy("_scope").orderBy(F.desc("_range")).rowsBetween(W.unboundedPreceding, -1)
    edges = edges.select(*keys,
                         F.last("_hi", ignorenulls=True).over(earlier).alias("_carry_before"),
                         F.last("_lo", ignorenulls=True).over(later).alias("_carry_after"))
    return (equi_join(local, edges, keys)
            .select("_scope", "time",
                    F.coalesce("_before", "_carry_before").alias("_prev"),
                    F.coalesce("_after", "_carry_after").alias("_next")))


def nearest_stamps(stamps: DataFrame, axis: DataFrame, tolerance: str | None = None) -> DataFrame:
    """Mapping (``_scope``, ``time``) -> ``matched_time``: the nearest axis stamp.

    Half-way stamps take the later one.  Without a ``tolerance`` (an interval
    text such as ``'6 hours'``) any distance matches; beyond it there is none.
    A stamp whose scope has no axis at all has no match and no row.
    """
    near = neighbours(stamps, axis)
    behind = F.col("time") - F.col("_prev.time")
    ahead = F.col("_next.time") - F.col("time")
    take_next = F.col("_prev").isNull() | (ahead <= behind)
    best = F.when(take_next & F.col("_next").isNotNull(), F.col("_next.time")).otherwise(F.col("_prev.time"))
    out = near.select("_scope", "time", best.alias("matched_time")).where("matched_time IS NOT NULL")
    if tolerance:
        limit = F.expr(f"INTERVAL '{tolerance}'") if not tolerance[0].isdigit() else F.expr(f"INTERVAL {tolerance}")
        gap = F.greatest(F.col("matched_time") - F.col("time"), F.col("time") - F.col("matched_time"))
        out = out.where(gap <= limit)
    return out


def insertion_points(stamps: DataFrame, axis: DataFrame) -> DataFrame:
    """Left insertion point of each stamp: how many axis stamps are before it.

    Adds ``idx`` and the axis length ``_size``.
    """
    sizes = axis.groupBy("_scope").agg(F.count(F.lit(1)).alias("_size"))
    near = neighbours(stamps, axis)
    # `sizes` has one row per axis; the stamp mapping spreads by stamp.
    return (salted_join(near, sizes, ["_scope"], ["time"])
            .select("_scope", "time", F.coalesce(F.col("_next.pos"), F.col("_size")).alias("idx"), "_size"))


def lagged_stamps(stamps: DataFrame, axis: DataFrame, lags: Sequence[int]) -> DataFrame:
    """Mapping (``_scope``, ``time``) -> ``lag``, ``matched_time``, ``lag`` axis steps earlier.

    The step is clamped to the axis: at least 0, at most its length minus the
    lag (lag 0 stops at the last stamp).
    """
    asked = F.explode(F.array(*[F.lit(int(lag)) for lag in lags]))
    points = insertion_points(stamps, axis).withColumn("lag", asked)
    pos = clamp(F.col("idx") - F.col("lag"), F.lit(0), F.col("_size") - F.greatest(F.col("lag"), F.lit(1)))
    points = points.select("_scope", "time", "lag", pos.cast("long").alias("pos"))
    at = axis.select("_scope", "pos", F.col("time").alias("matched_time"))
    return salted_join(points, at, ["_scope", "pos"], ["time"], shuffled=True).drop("pos")


def _stamps(df: DataFrame, axis_scope: str) -> DataFrame:
    """The distinct stamps with their scope, written once: a mapping reads them several times."""
    return written(_scope_of(df.select("time").distinct(), axis_scope), "axis")


def _mapped(events: DataFrame, mapping: DataFrame) -> DataFrame:
    """Events with what the mapping says of their (scope, stamp).

    The mapping has a row per stamp (and lag).  It is written once, as it is counted and
    joined: few stamps are broadcast, many are joined with salts.
    """
    mapping = written(mapping, "stamps")
    spread = [c for c in events.columns if c != "_scope"]
    return lookup_join(events, mapping, ["_scope", "time"], spread).drop("_scope")


def _scoped_axis(axis: DataFrame, axis_scope: str) -> DataFrame:
    return written(axis_positions(_scope_of(axis.select("time"), axis_scope), ["_scope"]), "axis")


def asof_nearest(events: DataFrame, axis: DataFrame, axis_scope: str = "year",
                 tolerance: str | None = None, asked: DataFrame | None = None) -> DataFrame:
    """Each event with ``matched_time``, the axis stamp nearest to its ``time``.

    Events of a year without axis drop out, here as in :func:`asof_lagged`.
    ``asked`` may name a plainer frame with the same stamps (the events before
    they were numbered), so that the costlier one is read once.
    """
    wanted = _stamps(asked if asked is not None else events, axis_scope)
    return _mapped(_scope_of(events, axis_scope), nearest_stamps(wanted, _stamps(axis, axis_scope), tolerance))


def asof_lagged(events: DataFrame, axis: DataFrame, lags: Sequence[int], axis_scope: str = "year",
                lag_unit: str = "steps", asked: DataFrame | None = None) -> DataFrame:
    """Each event once per lag, with ``lag`` and the earlier ``matched_time``.

    ``lag_unit='steps'`` counts axis positions from the left insertion point;
    ``'hours'`` takes the stamp nearest to the event time minus that many hours.
    ``asked`` is as for :func:`asof_nearest`.
    """
    if lag_unit == "steps":
        scoped = _scope_of(events, axis_scope)
        wanted = _stamps(asked if asked is not None else events, axis_scope)
        return _mapped(scoped, lagged_stamps(wanted, _scoped_axis(axis, axis_scope), lags))
    if lag_unit != "hours":
        raise ValueError("lag_unit must be 'steps' or 'hours'")
    each = F.explode(F.array(*[F.lit(int(lag)) for lag in lags]))

    def shifted(df: DataFrame) -> DataFrame:
        """The axis is that of the event, also where the earlier stamp lies in another year."""
        return (_scope_of(df, axis_scope).withColumn("lag", each).withColumnRenamed("time", "_event_time")
                .withColumn("time", F.timestamp_add("HOUR", -F.col("lag"), F.col("_event_time"))))

    wanted = written(shifted((asked if asked is not None else events).select("time").distinct()).select("_scope", "time"), "asked")
    mapping = nearest_stamps(wanted, _stamps(axis, axis_scope))
    return _mapped(shifted(events), mapping).drop("time").withColumnRenamed("_event_time", "time")
