import pytest
from pyspark.sql import functions as F

from conftest import plan, values
from gridevents import catalog
from gridevents.catalog.analyses import _native_windows
from gridevents.catalog.views import Views
from gridevents.operators import axes, boxjoin, filters
from gridevents.operators.joins import lookup_join, salted_join, with_group_stats, with_total_stats
from gridevents.plans.clustering import positioned_events
from gridevents.plans.composites import composite_native, composite_raw, composite_windows
from gridevents.plans.detection import landfall_events
from gridevents.session import written


@pytest.fixture
def field(spark):
    """Regular 0.5 degree cube with six stamps."""
    grid = spark.range(6).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(20)))).withColumn(
        "j", F.explode(F.sequence(F.lit(0), F.lit(30))))
    return grid.select(F.lit("T").alias("variable"),
                       F.timestamp_add("HOUR", F.col("id").cast("int"), F.expr("timestamp_ntz'2000-01-01'")).alias("time"),
                       F.lit(500.0).alias("level"), (30 + F.col("i") * 0.5).alias("lat"), (230 + F.col("j") * 0.5).alias("lon"),
                       (F.col("id") * 1000 + F.col("i") * 31 + F.col("j")).cast("double").alias("value"))


@pytest.fixture
def places(spark):
    return spark.createDataFrame([(0, 34.0, 238.0), (1, 35.25, 240.1)], "loc_id long, lat double, lon double")


@pytest.fixture
def events(rows):
    return rows("algo string, loc_id long, time timestamp_ntz",
                [("a", 0, "2000-01-01 02:10"), ("a", 1, "2000-01-01 04:00"), ("b", 0, "2000-01-01 02:10")])


def test_broadcast_and_salted_joins_agree(spark):
    big = spark.range(2000).select("id", F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 50).alias("k"))
    small = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for how in ("inner", "left", "left_semi", "left_anti"):
        a = lookup_join(big, small, ["k"], ["id"], how)
        b = salted_join(big, small, ["k"], ["id"], how)
        assert values(a) == values(b)
    assert values(lookup_join(big, small, ["k"], ["id"], max_rows=5)) == values(big.join(small, "k").select("id", "k", "v"))


def test_null_keys_meet(rows):
    a = rows("k double, v int", [(None, 1), (2.0, 2)])
    b = rows("k double, w int", [(None, 10), (3.0, 30)])
    assert values(salted_join(a, b, ["k"], ["v"])) == [(None, 1, 10)]


def test_group_stats_with_null_keys_and_missing_values(rows):
    df = rows("g string, t int, v double", [("x", 1, 1.0), ("x", 2, None), ("x", 3, 3.0), (None, 4, 7.0)])
    got = with_group_stats(df, ["g"], {"m": F.avg("v")}, ["t"])
    assert sorted(values(got, "t", "m")) == [(1, 2.0), (2, 2.0), (3, 2.0), (4, 7.0)]
    assert with_total_stats(df, {"n": F.count("v")}).select("n").distinct().collect()[0][0] == 3


def test_box_join_paths_agree(field, places, events, monkeypatch):
    matched = events.join(places, "loc_id").select("algo", "loc_id", F.date_trunc("hour", "time").cast("timestamp_ntz").alias("matched_time"),
                                                  F.col("lat").alias("centre_lat"), F.col("lon").alias("centre_lon"))
    cols = ["algo", "loc_id", "matched_time", "lat", "lon", "value"]
    few = boxjoin.join_event_boxes(field, matched, 2, 3, few=True)
    many = boxjoin.join_event_boxes(field, matched, 2, 3, few=False)
    monkeypatch.setattr(boxjoin, "BOXES_PER_TASK", 1)
    split = boxjoin.join_event_boxes(field, matched, 2, 3, few=False, max_rows=1)
    assert values(few, *cols) == values(many, *cols) == values(split, *cols)
    brute = field.withColumnRenamed("time", "matched_time").join(matched, "matched_time").where(
        "abs(lat - centre_lat) <= 2 and abs(lon - centre_lon) <= 3")
    assert values(few, *cols) == values(brute, *cols)


def test_many_boxes_are_never_broadcast(spark, field, places, events):
    """Tiles of boxes are exploded from a small file: its size must not decide."""
    matched = events.join(places, "loc_id").select("algo", "loc_id", F.date_trunc("hour", "time").cast("timestamp_ntz").alias("matched_time"),
                                                  F.col("lat").alias("centre_lat"), F.col("lon").alias("centre_lon"))
    many = plan(boxjoin.join_event_boxes(field, matched, 2, 3, few=False), "simple")
    assert many.count("SortMergeJoin") == 1 and many.count("BroadcastHashJoin") <= 1  # the cut to pairs in use
    past = plan(lookup_join(spark.range(40), spark.range(10).withColumn("v", F.lit(1)), ["id"], ["id"], max_rows=5), "simple")
    assert "SortMergeJoin" in past and "Broadcast" not in past


def test_boxes_that_outnumber_cells_are_shuffled_once(spark, monkeypatch):
    """Cells are repeated for the tiles, boxes are not; edges are hit exactly, up to rounding."""
    stamp = F.timestamp_add("HOUR", (F.col("id") % 3).cast("int"), F.expr("timestamp_ntz'2000-01-01'"))
    cells = spark.range(120).select(stamp.alias("time"), (F.col("id") % 10 * 0.1 - 0.5).alias("lat"), (F.col("id") % 12 * 0.1 - 0.6).alias("lon"),
                                    F.col("id").cast("double").alias("value"))
    boxes = spark.range(900).select("id", stamp.alias("matched_time"), (F.col("id") * 7 % 23 * 0.1 - 1.1).alias("centre_lat"),
                                    (F.col("id") * 5 % 29 * 0.1 - 1.4).alias("centre_lon"))
    cols = ["id", "matched_time", "lat", "lon", "value"]
    brute = cells.withColumnRenamed("time", "matched_time").join(boxes, "matched_time").where(
        "lat BETWEEN centre_lat - 0.3D AND centre_lat + 0.3D AND lon BETWEEN centre_lon - 0.6D AND centre_lon + 0.6D")
    wanted = values(brute, *cols)
    assert boxjoin.boxes_outnumber(cells, boxes) and not boxjoin.boxes_outnumber(cells, boxes.where("id < 60"))
    dated = cells.withColumns({"year": F.year("time"), "month": F.month("time")})
    assert boxjoin.boxes_outnumber(dated, boxes) and values(boxjoin.join_event_boxes(dated, boxes, 0.3, 0.6, few=False), *cols) == wanted
    many = boxjoin.join_event_boxes(cells, boxes, 0.3, 0.6, few=False)
    first, second = plan(many, "simple").split("SortMergeJoin")[1].split("\n      +- ")
    assert "explode" not in first and "explode" in second  # the merge holds rows of the second side
    assert values(many, *cols) == wanted != []
    monkeypatch.setattr(boxjoin, "BOXES_PER_TASK", 3)
    for most in (1, 100, 10_000):
        assert values(boxjoin.join_event_boxes(cells, boxes, 0.3, 0.6, few=False, max_rows=most), *cols) == wanted
    monkeypatch.setattr(boxjoin, "boxes_outnumber", lambda *_: False)
    for most in (1, 100, 10_000):
        assert values(boxjoin.join_event_boxes(cells, boxes, 0.3, 0.6, few=False, max_rows=most), *cols) == wanted


def test_many_windows_take_departures_from_the_cube(field, places, events):
    """Windows of many events outnumber the cells: the climatology meets the cells, not the windows."""
    matched = events.join(places, "loc_id").select("algo", "loc_id", "time", F.date_trunc("hour", "time").cast("timestamp_ntz").alias("matched_time"),
                                                  F.col("lat").alias("centre_lat"), F.col("lon").alias("centre_lon"))
    means = field.groupBy("variable", "level", "lat", "lon").agg(F.avg("value").alias("clim_value")).where("lat > 21")
    few, many = (composite_windows(field, matched, 2, 3, climatology=means, few=choice) for choice in (True, False))
    cols = ["algo", "loc_id", "event_time", "matched_time", "rel_lat", "rel_lon", "value"]
    assert values(few, *cols) == values(many, *cols) != []
    last = next(line for line in plan(many, "simple").splitlines() if "Join" in line)
    assert "_ti" in last


def test_composite_labels(field, places, events):
    raw = composite_raw(field, events, places, 2, 3)
    assert raw.where("loc_id = 0").agg(F.max("rel_lat"), F.min("rel_lat"), F.max("rel_lon")).first()[:] == (2.0, -2.0, 3.0)
    shifted = composite_raw(field, events, places, 2, 3, labels="reference")
    assert shifted.where("loc_id = 0").agg(F.max("rel_lat")).first()[0] == 2.25
    native = composite_native(field, events, places, half_lat=2, half_lon=3)
    # an off-grid centre is snapped: its first row is labelled with the lower edge
    assert native.where("loc_id = 1").agg(F.min("rel_lat"), F.min("rel_lon")).first()[:] == (-2.0, -3.0)
    assert native.where("loc_id = 1").select("lat").distinct().count() == 8
    assert values(raw.select("algo", "loc_id", "ordinal").distinct()) == [("a", 0, 0), ("a", 1, 1), ("b", 0, 0)]


def test_top_row_of_a_quarter_degree_window(spark, rows):
    field = spark.range(200).select(F.lit("T").alias("variable"), F.expr("timestamp_ntz'2000-01-01'").alias("time"),
                                    F.lit(None).cast("double").alias("level"), (20 + F.col("id") * 0.25).alias("lat"),
                                    F.lit(-100.0).alias("lon"), F.lit(1.0).alias("value"))
    place = spark.createDataFrame([(0, 40.0, 260.0)], "loc_id long, lat double, lon double")
    event = rows("algo string, loc_id long, time timestamp_ntz", [("a", 0, "2000-01-01")])
    def top(labels):
        return composite_raw(field, event, place, labels=labels).agg(F.max("rel_lat"), F.min("rel_lat"), F.count("*")).first()[:]
    assert top("offset") == (15.0, -15.0, 121)
    assert top("reference") == (15.25, -14.75, 121)


def test_landfall_threshold_and_edges(rows):
    mask = rows("algo string, time timestamp_ntz, lat double, lon double, tag double", [
        ("a", "2000-01-01", 40.0, 236.0, 1.0), ("a", "2000-01-01", 41.0, 237.0, 1.0), ("a", "2000-01-01", 41.5, 236.0, 0.0),
        ("a", "2000-01-02", 40.0, 236.0, 1.0), ("a", "2000-01-02", 40.5, 236.5, 0.0),
        ("a", "2000-07-01", 40.0, 236.0, 1.0), ("a", "2000-01-03", 40.5, 236.5, None), ("a", "2000-01-03", 40.0, 236.5, 1.0)])
    place = rows("loc_id long, lat double, lon double", [(5, 40.0, 236.0)])
    got = landfall_events(mask, place, threshold=0.8)
    assert [(r["loc_id"], str(r["time"])[:10]) for r in got.orderBy("time").collect()] == [(5, "2000-01-01"), (5, "2000-01-03")]
    assert landfall_events(mask, place, threshold=0.5).count() == 3


def test_levels_strict(field):
    assert filters.select_levels(field, [500], strict=True).count() == field.count()
    with pytest.raises(Exception, match="level is missing"):
        filters.select_levels(field, [500, 850], strict=True).count()


def test_keep_first_follows_rank(rows):
    df = rows("k int, r int, v string", [(1, 2, "b"), (1, 1, "a"), (2, 5, "c")])
    assert values(filters.keep_first(df, ["k"], "r"), "k", "r", "v") == [(1, 1, "a"), (2, 5, "c")]
    assert values(filters.keep_last(df, ["k"], "r"), "k", "r", "v") == [(1, 2, "b"), (2, 5, "c")]


def test_an_absent_grid_row_does_not_move_the_axis(spark, rows):
    df = rows("lat double, lon double", [(lat, lon) for lat in (30.0, 31.0, 31.5, 33.0) for lon in (0.0, 1 / 3, 5 / 3, 2.0)])
    assert axes.axis_facts(df, "lat").first()[:] == (30.0, 0.5, 4, 3)
    origin, step, n, missing = axes.axis_facts(df, "lon").first()
    assert (origin, n, missing) == (0.0, 4, 3) and abs(step - 1 / 3) < 1e-9
    one = axes.axis_registry(df.where("lat = 30")).orderBy("coord").collect()
    assert one[0][:] == ("lat", 30.0, 0.0, 1, 0) and one[1]["n_missing"] == 3
    assert axes.axis_facts(df.limit(0), "lat").first()[:] == (None, None, 0, 0)
    # a window without the row of 32 degrees has the labels of the full grid
    window = df.where("lon = 0").withColumn("centre_lat", F.lit(31.5)).withColumn("centre_lon", F.lit(1.0))
    for known in (df, axes.axis_registry(df)):
        got = axes.relative_positions(window, known, 1.5, 1.0).orderBy("lat").collect()
        assert [r["rel_lat"] for r in got] == [-1.5, -0.5, 0.0, 1.5]


def test_axis_facts(field):
    assert axes.axis_origin_and_step(field, "lon").first()[:] == (230.0, 0.5)
    assert axes.longitude_frame(field).first()[:] == (245.0, 180)
    assert axes.axis_length(field).first()[0] == 6
    assert axes.at_positions(field, "lat", [0, 2]).select("lat").distinct().count() == 2


def test_clustering_windows_read_the_cells_once(spark):
    """Windows and grid axes come from stored cells and events, not from the large tables again."""
    v = Views(spark, "/root/testdata/sf0.001")
    events = written(positioned_events(v.event_daily, unique=True).withColumnRenamed("time", "event_time"), "positioned")
    text = plan(_native_windows(v, events))
    assert "lineitem" not in text and "orders" not in text


def test_box_queries_read_the_cells_once(spark, field, places, events, monkeypatch):
    """Cells are built and written before they are counted, averaged and joined; matched events are not written again."""
    for name in ("x07_composite_lagged_points", "j03_box_join"):
        assert "lineitem" not in plan(catalog.queries()[name](spark, "/root/testdata/sf0.001"))
    matched = events.join(places, "loc_id").select("algo", "loc_id", "time", F.date_trunc("hour", "time").cast("timestamp_ntz").alias("matched_time"),
                                                  F.col("lat").alias("centre_lat"), F.col("lon").alias("centre_lon"))
    monkeypatch.setattr(boxjoin, "written", None)
    assert composite_windows(field, matched, 2, 3, few=False).count() == composite_windows(field, matched, 2, 3, few=True).count()
