"""Positions on an axis and ordinals in a list, without one-task windows.

A plain ``row_number`` over a whole axis or list puts all of it in one task.
Positions are counted in levels instead: rows per bucket first (a small table),
prefix sums over the bucket table, then a rank inside each bucket.  Buckets are
calendar days and places, so both the bucket table and a bucket are bounded by
the calendar and the grid, not by the amount of data.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gridevents.operators.joins import equi_join

#: Copies of one row that one task writes out.
COPY_BLOCK = 100_000


def _size(weight: str | None) -> Column:
    return F.lit(1) if weight is None else F.col(weight)


def bucket_offsets(df: DataFrame, group: Sequence[str], levels: Sequence[str],
                   totals: Mapping[str, str | None]) -> DataFrame:
    """What precedes each bucket: one row per (group, levels), a column ``_ahead_<name>`` per total."""
    names = list(totals)
    buckets = df.groupBy(*group, *levels).agg(*[F.sum(_size(w)).cast("long").alias(f"_n_{n}") for n, w in totals.items()])
    out = buckets
    for depth in range(len(levels), 0, -1):
        keys = [*group, *levels[:depth]]
        before = (W.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(W.unboundedPreceding, -1))
        innermost = depth == len(levels)
        sizes = buckets if innermost else buckets.groupBy(*keys).agg(*[F.sum(f"_n_{n}").alias(f"_n_{n}") for n in names])
        ahead = sizes.select(*keys, *[F.coalesce(F.sum(f"_n_{n}").over(before), F.lit(0)).alias(f"_b{depth}_{n}")
                                      for n in names])
        out = ahead if innermost else equi_join(out, ahead, keys)
    summed = [sum((F.col(f"_b{d}_{n}") for d in range(1, len(levels) + 1)), F.lit(0)).cast("long").alias(f"_ahead_{n}")
              for n in names]
    return out.select(*group, *levels, *summed)


def running_totals(df: DataFrame, group: Sequence[str], levels: Sequence[str], fine: Sequence[str],
                   totals: Mapping[str, str | None]) -> DataFrame:
    """Running totals before each row of its group, ordered by ``levels`` then ``fine``.

    ``totals`` maps a new column to the column it sums (None counts rows).
    """
    offsets = bucket_offsets(df, group, levels, totals)
    before = W.partitionBy(*group, *levels).orderBy(*fine).rowsBetween(W.unboundedPreceding, -1)
    joined = equi_join(df, offsets, [*group, *levels])
    sums = {n: (F.col(f"_ahead_{n}") + F.coalesce(F.sum(_size(w)).over(before), F.lit(0))).cast("long")
            for n, w in totals.items()}
    return joined.select(*df.columns, *[c.alias(n) for n, c in sums.items()])


def running_position(df: DataFrame, group: Sequence[str], levels: Sequence[str],
                     fine: Sequence[str], name: str = "pos", weight: str | None = None) -> DataFrame:
    """0-based position of each row in its group, ordered by ``levels`` then ``fine``.

    With ``weight`` a row stands for that many copies and gets the position of
    its first copy.
    """
    return running_totals(df, group, levels, fine, {name: weight})


def with_copies(df: DataFrame, keys: Sequence[str], name: str = "_copies") -> DataFrame:
    """Equal rows folded into one row with their number (a partial aggregate)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def expand_copies(df: DataFrame, position: str = "pos", name: str = "_copies") -> DataFrame:
    """Undo :func:`with_copies`; copies take consecutive positions.

    Long runs are cut into blocks that are spread over the cluster first.
    """
    first = F.sequence(F.lit(0).cast("long"), F.col(name) - 1, F.lit(COPY_BLOCK).cast("long"))
    blocks = df.withColumn("_from", F.explode(first)).hint("rebalance")
    last = F.least(F.col("_from") + COPY_BLOCK, F.col(name)) - 1
    return (blocks.withColumn("_copy", F.explode(F.sequence("_from", last)))
            .withColumn(position, F.col(position) + F.col("_copy"))
            .drop("_from", "_copy", name))


def axis_positions(times: DataFrame, scope: Sequence[str] = (), name: str = "pos") -> DataFrame:
    """The distinct stamps of an axis with their 0-based position, per scope.

    ``scope`` is empty for one global axis, or e.g. the year for yearly axes.
    """
    stamps = times.select(*scope, "time").distinct().withColumn("_day", F.to_date("time"))
    return running_position(stamps, list(scope), ["_day"], ["time"], name).drop("_day")


def event_ordinals(events: DataFrame, group: Sequence[str] = ("algo", "year"),
                   order: Sequence[str] = ("loc_id",), name: str = "ordinal", unique: bool = False) -> DataFrame:
    """Running event number per group: place by place, in time order inside a place.

    Needs ``time``; ``year`` is derived from it.  Repeated events keep their
    multiplicity and take consecutive numbers.  ``unique`` says that no event is
    repeated (detection gives each once), which saves folding and unfolding them.
    """
    base = events.columns
    prepared = events if unique else with_copies(events, base).withColumn("_day", F.to_date("time"))
    if "year" not in base:
        prepared = prepared.withColumn("year", F.year("time"))
    fine = ["time", *[c for c in base if c not in {*group, *order, "time"}]]
    if unique:   # a place holds at most one year's stamps: no need for days
        return running_position(prepared, list(group), list(order), fine, name)
    numbered = running_position(prepared, list(group), [*order, "_day"], fine, name, "_copies")
    return expand_copies(numbered, name).drop("_day")


def strided(axis: DataFrame, step: int, name: str = "pos") -> DataFrame:
    """Every ``step``-th entry of a positioned axis."""
    return axis.where(F.col(name) % step == 0)


def coordinate_index(df: DataFrame, coord: str, name: str = "pos") -> DataFrame:
    """The distinct values of a spatial axis with their index.

    The window runs over the distinct coordinate values only; their number is
    set by the grid (a few thousand), not by the rows.
    """
    return df.select(coord).distinct().withColumn(
        name, (F.row_number().over(W.orderBy(coord)) - 1).cast("long"))
