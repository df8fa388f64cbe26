from pyspark.sql import functions as F

from conftest import plan, values
from gridevents.operators.consensus import consensus_times, shared_events
from gridevents.schema import MONTHS, TITLES
from gridevents.session import fresh_path, shared_dir
from gridevents.sinks import listings as text_sinks, tables
from gridevents.sources import cubes, listings


def events(rows):
    return rows("algo string, loc_id long, time timestamp_ntz", [
        ("a", 0, "1999-12-31 21:00"), ("a", 0, "2000-01-01 03:00"), ("a", 1, "2000-02-01"), ("b", 0, "2000-01-01 03:00")])


def test_list_round_trip(spark, rows):
    ev = events(rows)
    for write in (text_sinks.write_yearly_lists, text_sinks.write_event_lists):
        path = fresh_path(spark, "t")
        write(ev, path)
        back = listings.read_event_lists(spark, path).select("algo", F.col("loc_id").cast("long"), "time")
        assert values(back) == values(ev)


def test_packed_lists_open_only_the_files_of_a_place(spark):
    ev = spark.range(400).selectExpr("'a' AS algo", "id % 40 AS loc_id", "timestampadd(DAY, cast(id as int), timestamp_ntz'2000-01-01') AS time")
    path = fresh_path(spark, "t")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")    # several files, as a large table has
    try:
        text_sinks.write_packed_lists(ev, path)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert values(listings.read_packed_lists(spark, path)) == values(ev)
    folders = {r["file"].rsplit("/", 1)[0] for r in spark.read.parquet(f"{path}/index").collect()}
    assert len(folders) == 2     # a folder per algorithm and year, whatever the places
    one = listings.read_packed_lists(spark, path, place=7)
    assert values(one) == values(ev.where("loc_id = 7"))
    assert len(one.inputFiles()) < len(listings.read_packed_lists(spark, path).inputFiles())
    assert listings.read_packed_lists(spark, path, place=99).count() == 0


def test_label_files_keep_their_order(spark):
    path = fresh_path(spark, "t")
    spark.range(50).repartitionByRange(4, "id").sortWithinPartitions("id").selectExpr("cast(id * 3 as string) AS value").write.text(path)
    assert values(listings.read_labels(spark, path), "pos", "cluster") == [(i, 3 * i) for i in range(50)]


def test_place_round_trip_and_stride(spark):
    places = spark.range(20).select(F.col("id").alias("loc_id"), (30 + F.col("id") * 0.5).alias("lat"), (-120 - F.col("id") * 1.25).alias("lon"))
    path = fresh_path(spark, "t")
    text_sinks.write_places(places, path)
    back = listings.read_places(spark, path)
    assert values(back) == values(places)
    assert [r["loc_id"] for r in listings.every_nth_place(back).orderBy("loc_id").collect()] == [0, 6, 12, 18]
    swapped = listings.read_places(spark, path, lon_first=True).orderBy("loc_id").first()
    assert (swapped["lat"], swapped["lon"]) == (-120.0, 30.0)


def test_event_points_csv(spark):
    path = fresh_path(spark, "t")
    spark.createDataFrame([("2000-06-01T03:00:00,-10.5,12.25",)], "value string").write.text(path)
    assert [(str(r["time"]), r["lon"], r["lat"]) for r in listings.read_event_points(spark, path).collect()] == [
        ("2000-06-01 03:00:00", -10.5, 12.25)]


def test_cube_layout_prunes(spark, rows):
    df = rows("variable string, time timestamp_ntz, level double, lat double, lon double, value double", [
        ("T", "2000-01-05", 500.0, 1.0, 1.0, 2.0), ("T", "2001-07-05", 850.0, 1.0, 1.0, float("nan")), ("Q", "2000-02-05", 500.0, 1.0, 1.0, 10.0)])
    path = fresh_path(spark, "t")
    tables.write_cube(df, path)
    got = cubes.read_cube(spark, path, variables=["T"], levels=[850], years=[2001])
    assert [r["value"] for r in got.collect()] == [None]
    text = plan(got)
    assert "PartitionFilters" in text and "variable" in text.split("PartitionFilters")[1].split("\n")[0]
    assert "PushedFilters: [In(level" in text or "EqualTo(level,850.0)" in text


def test_chunk_numbers_continue(spark):
    df = spark.range(10).select(F.expr("timestampadd(HOUR, cast(id as int), timestamp_ntz'2000-01-01')").alias("time"),
                                F.lit(1.0).alias("lat"), F.lit(2.0).alias("lon"), F.col("id").alias("value"))
    path = fresh_path(spark, "t")
    tables.write_chunks(df, path, {"time": 4})
    assert tables.next_chunk(spark, path) == 3
    tables.write_chunks(df, path, {"time": 4}, counter=tables.next_chunk(spark, path))
    assert spark.read.parquet(path).select("chunk_id").distinct().count() == 6
    assert spark.read.parquet(path).count() == 20


def test_labels(rows):
    lines = rows("event_id int, value string", [(0, "3"), (1, "12")])
    assert values(listings.parse_labels(lines), "event_id", "cluster") == [(0, 3), (1, 12)]
    assert values(listings.parse_labels(lines, True), "event_id", "cluster") == [(0, 3), (1, 1)]


def test_consensus_and_intersection(rows):
    assert values(consensus_times(events(rows), 2).select(F.col("time").cast("string"))) == [("2000-01-01 03:00:00",)]
    a = rows("time timestamp_ntz, lon double, lat double", [("2000-01-01", 1.0, 2.0), ("2000-01-02", 1.0, 2.0)])
    b = rows("lat double, lon double, time timestamp_ntz", [(2.0, 1.0, "2000-01-02")])
    assert shared_events(a, b).count() == 1


def test_router_prefers_the_variable(spark):
    req = spark.createDataFrame([("native", "slp", "x"), ("native", "ivt", "ivt"), ("quarter_degree", "v", "levels")],
                                "family string, variable string, kind string")
    got = {r["variable"]: r["collection"] for r in cubes.route(spark, req).collect()}
    assert got == {"slp": "inst1_2d_asm_Nx", "ivt": "native_1hour", "v": "e5.oper.an.pl"}


def test_fixed_tables():
    assert len(MONTHS) == 12 and len(TITLES) == 8


def test_scratch_folder_comes_from_the_session(spark):
    assert fresh_path(spark, "x").startswith(shared_dir(spark))


def test_composite_of_a_stored_cube_prunes_directories(spark, rows):
    from gridevents.plans.composites import composite_raw
    df = rows("variable string, time timestamp_ntz, level double, lat double, lon double, value double", [
        ("T", f"200{y}-0{m}-05", 500.0, 30.0, 240.0, float(y * 10 + m)) for y in range(4) for m in range(1, 7)])
    path = fresh_path(spark, "t")
    tables.write_cube(df, path)
    cube = cubes.read_cube(spark, path)
    place = rows("loc_id long, lat double, lon double", [(0, 30.0, 240.0)])
    event = rows("algo string, loc_id long, time timestamp_ntz", [("a", 0, "2002-03-05")])
    out = composite_raw(cube, event, place, 2, 2, axis=df)
    assert [r["value"] for r in out.collect()] == [23.0]
    scan = plan(out).split("PartitionFilters: [")[1].split("\n")[0]
    assert "array_contains(Subquery" in scan.replace("ReusedSubquery ", "") or "ubquery" in scan
    assert out.select("year").first()[0] == 2002     # the event's year, not a stored column


def test_first_file_wins(spark, rows):
    from gridevents.plans.composites import prepare_field
    df = rows("variable string, time timestamp_ntz, level double, lat double, lon double, value double, source_rank string", [
        ("T", "2000-01-05", None, 30.0, 240.0, 2.0, "b.nc"), ("T", "2000-01-05", None, 30.0, 240.0, 1.0, "a.nc")])
    assert values(prepare_field(df, "T"), "value", "lon") == [(1.0, -120.0)]


def test_a_derived_cube_is_built_once_for_its_blocks(spark, rows, tmp_path):
    """Axis, manifest and blocks are read from one copy of the cube."""
    built = spark.sparkContext.accumulator(0)

    @F.udf("boolean")
    def seen(_):
        built.add(1)
        return True

    df = rows("variable string, time timestamp_ntz, level double, lat double, lon double, value double",
              [("T", f"2000-01-0{d} 00:00", 500.0, 0.0, 1.0, float(d)) for d in range(1, 9)])
    path = str(tmp_path / "once")
    manifest = tables.write_chunks(df.where(seen("value")), path, {"time": 3}, counter=2)
    assert values(manifest, "chunk_id", "n_times", "offset") == [(2, 3, 0), (3, 3, 3), (4, 2, 6)]
    assert values(spark.read.parquet(path), "chunk_id", "value") == [(2 + (d - 1) // 3, float(d)) for d in range(1, 9)]
    assert built.value == 8
