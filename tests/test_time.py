import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import values
from gridevents.operators import timejoin
from gridevents.operators.ordering import (axis_positions, event_ordinals, expand_copies, running_position, strided)


def stamps(df, *columns):
    return [tuple(str(x) if isinstance(x, dt.datetime) else x for x in row) for row in values(df, *columns)]


def test_half_way_takes_the_later_stamp(rows):
    axis = rows("time timestamp_ntz", [("2000-01-01 00:00",), ("2000-01-01 02:00",)])
    events = rows("algo string, time timestamp_ntz", [("a", "2000-01-01 01:00"), ("a", "2000-01-01 00:59")])
    got = stamps(timejoin.asof_nearest(events, axis), "time", "matched_time")
    assert got == [("2000-01-01 00:59:00", "2000-01-01 00:00:00"), ("2000-01-01 01:00:00", "2000-01-01 02:00:00")]


def test_nearest_keeps_multiplicity_and_has_no_tolerance(rows):
    axis = rows("time timestamp_ntz", [("2000-06-01",)])
    events = rows("algo string, time timestamp_ntz", [("a", "2000-01-01"), ("a", "2000-01-01"), ("b", "2000-12-31 23:00")])
    assert timejoin.asof_nearest(events, axis).where("matched_time = '2000-06-01'").count() == 3
    assert timejoin.asof_nearest(events, axis, tolerance="6 hours").count() == 0


def test_yearly_and_global_axes(rows):
    axis = rows("time timestamp_ntz", [("1999-12-31 23:00",), ("2000-01-02",)])
    events = rows("algo string, time timestamp_ntz", [("a", "2000-01-01 00:00")])
    assert stamps(timejoin.asof_nearest(events, axis), "matched_time") == [("2000-01-02 00:00:00",)]
    assert stamps(timejoin.asof_nearest(events, axis, "global"), "matched_time") == [("1999-12-31 23:00:00",)]


def test_lag_is_clamped_to_the_axis(rows):
    axis = rows("time timestamp_ntz", [(f"2000-01-01 {h:02d}:00",) for h in range(10)])
    events = rows("event_id int, time timestamp_ntz", [
        (1, "2000-01-01 02:00"), (2, "2000-01-01 12:00"), (3, "2000-01-01 06:30"), (4, "2000-01-01 09:00")])
    got = stamps(timejoin.asof_lagged(events, axis, [4]), "event_id", "matched_time")
    assert got == [(1, "2000-01-01 00:00:00"), (2, "2000-01-01 06:00:00"), (3, "2000-01-01 03:00:00"), (4, "2000-01-01 05:00:00")]


def brute(axis, event, lag):
    idx = int(np.searchsorted(axis, event))
    return axis[max(0, min(idx - lag, len(axis) - max(lag, 1)))]


def test_time_joins_against_brute_force(spark):
    random.seed(5)
    base = np.datetime64("2001-01-01T00:00:00")
    axis = np.unique([base + np.timedelta64(random.randrange(0, 60 * 24 * 40), "m") for _ in range(300)])
    events = [base + np.timedelta64(random.randrange(-60 * 24 * 0, 60 * 24 * 60), "m") for _ in range(400)]
    a = spark.createDataFrame(pd.DataFrame({"t": [str(x) for x in axis]})).selectExpr("cast(t as timestamp_ntz) as time")
    e = spark.createDataFrame(pd.DataFrame({"id": range(400), "t": [str(x) for x in events]})).selectExpr(
        "id", "cast(t as timestamp_ntz) as time")
    near = {r["id"]: np.datetime64(r["matched_time"]) for r in timejoin.asof_nearest(e, a).collect()}
    lagged = {(r["id"], r["lag"]): np.datetime64(r["matched_time"]) for r in timejoin.asof_lagged(e, a, [0, 2, 7]).collect()}
    assert len(near) == 400 and len(lagged) == 1200
    for i, t in enumerate(events):
        gaps = np.abs(axis - t)
        best = max(x for x, g in zip(axis, gaps) if g == gaps.min())
        assert near[i] == best
        for lag in (0, 2, 7):
            assert lagged[(i, lag)] == brute(axis, t, lag)


def test_positions_match_a_plain_ranking(spark):
    df = spark.range(5000).select(F.timestamp_add("MINUTE", (F.pmod(F.xxhash64("id"), F.lit(200000))).cast("int"),
                                                  F.expr("timestamp_ntz'2003-01-01'")).alias("time"))
    got = [str(r[0]) for r in axis_positions(df).orderBy("pos").collect()]
    assert got == sorted({str(r[0]) for r in df.collect()})
    assert [r["pos"] for r in strided(axis_positions(df), 100).orderBy("pos").collect()] == list(range(0, len(got), 100))


def test_event_ordinals_with_a_dominant_place_and_copies(spark):
    hot = spark.range(3000).select(F.lit("a").alias("algo"), F.lit(7).alias("loc_id"),
                                   F.timestamp_add("HOUR", (F.col("id") % 500).cast("int"), F.expr("timestamp_ntz'2000-01-01'")).alias("time"))
    cold = spark.range(300).select(F.lit("a").alias("algo"), (F.col("id") % 5).cast("int").alias("loc_id"),
                                   F.timestamp_add("HOUR", F.col("id").cast("int"), F.expr("timestamp_ntz'2000-02-01'")).alias("time"))
    got = event_ordinals(hot.unionByName(cold)).orderBy("ordinal").collect()
    assert [r["ordinal"] for r in got] == list(range(3300))
    keys = [(r["loc_id"], str(r["time"])) for r in got]
    assert keys == sorted(keys)


def test_expand_copies_over_several_blocks(spark, monkeypatch):
    from gridevents.operators import ordering
    monkeypatch.setattr(ordering, "COPY_BLOCK", 10)
    df = spark.createDataFrame([(0, 37), (37, 1)], "pos long, _copies long")
    assert [r["pos"] for r in expand_copies(df).orderBy("pos").collect()] == list(range(38))


def test_running_position_nulls_form_their_own_group(rows):
    df = rows("g string, a int, b int", [(None, 1, 1), (None, 1, 2), ("x", 1, 1), (None, 0, 9)])
    got = values(running_position(df, ["g"], ["a"], ["b"]), "g", "a", "b", "pos")
    assert sorted(got, key=str) == sorted([("x", 1, 1, 0), (None, 0, 9, 0), (None, 1, 1, 1), (None, 1, 2, 2)], key=str)


def test_bad_options_are_refused(rows):
    axis = rows("time timestamp_ntz", [("2000-06-01",)])
    with pytest.raises(ValueError):
        timejoin.asof_nearest(axis, axis, "month")
    with pytest.raises(ValueError):
        timejoin.asof_lagged(axis, axis, [1], lag_unit="days")


def test_events_of_a_year_without_axis_drop_out(rows):
    event = rows("algo string, time timestamp_ntz", [("a", "2005-06-01"), ("b", "2001-06-01")])
    axis = rows("time timestamp_ntz", [("2000-06-01",), ("2001-06-03",)])
    assert values(timejoin.asof_nearest(event, axis), "algo") == [("b",)]
    assert values(timejoin.asof_lagged(event, axis, [1]), "algo") == [("b",)]


def test_hours_back_stay_on_the_axis_of_the_event(rows):
    event = rows("time timestamp_ntz", [("2000-01-01",)])
    axis = rows("time timestamp_ntz", [("1999-12-30",), ("2000-01-02",), ("2000-01-05",)])
    got = timejoin.asof_lagged(event, axis, [36], "year", "hours").collect()
    assert [str(r["matched_time"]) for r in got] == ["2000-01-02 00:00:00"]
    got = timejoin.asof_lagged(event, axis, [36], "global", "hours", asked=event).collect()
    assert [str(r["matched_time"]) for r in got] == ["1999-12-30 00:00:00"]


@pytest.mark.parametrize("scope", ["year", "global"])
def test_stamps_of_one_day_are_spread_over_ranges(spark, monkeypatch, scope):
    """All stamps lie on one calendar day: several ranges, none much larger than asked, same mapping as in one."""
    def stamps(n, step, shift):
        return spark.range(n).select(F.expr(f"timestamp_ntz'2000-05-05' + make_dt_interval(0, 0, 0, id * {step} + {shift})").alias("time"))
    axis, events = stamps(1500, 7, 3), stamps(900, 11, 0)
    whole = values(timejoin.asof_nearest(events, axis, scope)), values(timejoin.asof_lagged(events, axis, [0, 3], scope))
    monkeypatch.setattr(timejoin, "RANGE_STAMPS", 100)
    sizes = []
    plain = timejoin.written

    def seen(df, name):
        out = plain(df, name)
        if name == "ranges":
            sizes.extend(r["count"] for r in out.groupBy("_range").count().collect())
        return out
    monkeypatch.setattr(timejoin, "written", seen)
    assert (values(timejoin.asof_nearest(events, axis, scope)), values(timejoin.asof_lagged(events, axis, [0, 3], scope))) == whole
    assert len(sizes) >= 40 and max(sizes) < 300


def test_ranges_without_an_axis_entry_carry_edges(spark, monkeypatch):
    """Long stretches of asked stamps between two axis entries, and beyond both ends."""
    monkeypatch.setattr(timejoin, "RANGE_STAMPS", 20)
    at = lambda c: F.expr(f"timestamp_ntz'2000-01-01' + make_dt_interval(0, 0, {c}, 0)")
    axis = spark.createDataFrame([(300,), (700,)], "m int").select(at("m").alias("time"))
    events = spark.range(1000).select("id", at("cast(id as int)").alias("time"))
    got = {r["id"]: r["matched_time"] for r in timejoin.asof_nearest(events, axis, "global").collect()}
    first, last = sorted(r["time"] for r in axis.collect())
    assert all(got[i] == (first if i < 500 else last) for i in range(1000))
