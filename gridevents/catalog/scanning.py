"""Sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridevents.catalog.registry import query, r6, s6
from gridevents.functions.times import stamp_text
from gridevents.operators.filters import select_levels
from gridevents.plans.composites import prepare_field
from gridevents.session import fresh_path
from gridevents.sinks.listings import write_places, yearly_list_lines
from gridevents.sinks.tables import write_cube, write_partitioned
from gridevents.sources import cubes, listings, overlap
from gridevents.sources.selftest import planted_frames


@query("s01_grid_scan", f"""
SELECT variable, level, CAST(count(*) AS BIGINT) AS n_rows, {s6('avg(value)')} AS mean_value, min(time) AS first_time
FROM field WHERE variable IN ('T','Q') GROUP BY variable, level""")
def grid_scan(v):
    # some stamps are in other files again: the first file's row counts, and only these stamps are grouped
    late = v.field.where("year(time) = 1996 OR month(time) = 12").withColumn("value", F.col("value") + 1)
    path = fresh_path(v.spark, "late")
    write_cube(late, path)
    cube = overlap.read_first(v.spark, [v.stored, path], variables=["T", "Q"])
    return cube.groupBy("variable", "level").agg(
        F.count(F.lit(1)).alias("n_rows"), r6(F.avg("value"), "mean_value"), F.min("time").alias("first_time"))


@query("s01_shared_ranges", """
WITH filed AS (
  SELECT o_orderstatus AS variable, 'q' || CAST(year(o_orderdate)*4+quarter(o_orderdate) AS VARCHAR) AS file, o_orderdate AS time FROM orders
  UNION ALL SELECT o_orderstatus, 'm' || CAST(year(o_orderdate)*12+month(o_orderdate) AS VARCHAR), o_orderdate FROM orders
  WHERE o_orderstatus='F' AND month(o_orderdate)%4=0),
ranges AS (SELECT variable, file, min(time) AS lo, max(time) AS hi FROM filed GROUP BY 1, 2),
dates AS (SELECT DISTINCT variable, time FROM filed),
depth AS (SELECT d.variable, d.time, count(*) AS n FROM dates d JOIN ranges r ON r.variable=d.variable AND d.time BETWEEN r.lo AND r.hi GROUP BY 1, 2)
SELECT variable, time FROM depth WHERE n >= 2""")
def shared_ranges(v):
    """Stamps in ranges that two files hold; quarters are disjoint, some months are there again."""
    stamps = v.table("orders").select(F.col("o_orderstatus").alias("variable"), F.col("o_orderdate").alias("time"))
    quarter = F.concat(F.lit("q"), (F.year("time") * 4 + F.quarter("time")).cast("string"))
    month = F.concat(F.lit("m"), (F.year("time") * 12 + F.month("time")).cast("string"))
    again = stamps.where((F.col("variable") == "F") & (F.month("time") % 4 == 0))
    filed = stamps.withColumn("source_rank", quarter).unionByName(again.withColumn("source_rank", month))
    ranges = filed.groupBy("variable", "source_rank").agg(
        F.min("time").alias("first"), F.max("time").alias("last"), F.lit(False).alias("repeats"))
    shared = overlap.shared_ranges(ranges)
    days = shared.select("variable", F.explode(F.sequence("first", "last", F.expr("INTERVAL 1 DAY"))).alias("time"))
    return days.join(stamps.distinct(), ["variable", "time"], "left_semi")


@query("s02_single_scan", f"""
SELECT f.variable, f.time, f.level, f.lat, f.lon, {s6('f.value - m.mv')} AS anomaly
FROM field f JOIN (SELECT variable, month(time) AS mon, level, lat, lon, avg(value) AS mv FROM field
  GROUP BY variable, month(time), level, lat, lon) m
ON f.variable=m.variable AND month(f.time)=m.mon AND f.level=m.level AND f.lat=m.lat AND f.lon=m.lon
WHERE f.level IN (850, 500) AND f.variable IN ('T','Q')""")
def single_scan(v):
    out = cubes.read_single(v.spark, v.stored, levels=[850, 500], base=v.field).where(F.col("variable").isin("T", "Q"))
    return out.select("variable", "time", "level", "lat", "lon", r6("anomaly"))


@query("s03_region_scan", """
SELECT algo, time, lat, lon, tag FROM mask WHERE algo='loose' AND lon < 235""")
def region_scan(v):
    parted = v.mask.withColumn("region", F.when(F.col("lon") < 235, "west").otherwise("east"))
    path = fresh_path(v.spark, "mask")
    write_partitioned(parted, path, ["region", "algo"])
    return cubes.read_cube(v.spark, path, algorithms=["/loose/"], region="west").select("algo", "time", "lat", "lon", "tag")


@query("s04_collection_router", """
SELECT family, variable, kind, CASE WHEN family='native' THEN 'inst3_3d_asm_Np' ELSE 'e5.oper.an.pl' END AS collection,
  CASE WHEN family='native' THEN 'lon' ELSE 'longitude' END AS lon_name,
  CASE WHEN family='native' THEN 'lat' ELSE 'latitude' END AS lat_name, CAST(n_rows AS BIGINT) AS n_rows
FROM (SELECT CASE WHEN variable='Q' THEN 'native' WHEN variable='Z' THEN 'native' ELSE 'quarter_degree' END AS family,
  CASE WHEN variable='Q' THEN 'qv' WHEN variable='Z' THEN 'h' ELSE 't' END AS variable,
  'levels' AS kind, count(*) AS n_rows FROM field GROUP BY 1, 2, 3) r""")
def collection_router(v):
    name = F.col("variable")
    requests = v.field.select(
        F.when(name.isin("Q", "Z"), "native").otherwise("quarter_degree").alias("family"),
        F.when(name == "Q", "qv").when(name == "Z", "h").otherwise("t").alias("variable"),
        F.lit("levels").alias("kind")).groupBy("family", "variable", "kind").agg(F.count(F.lit(1)).alias("n_rows"))
    return cubes.route(v.spark, requests)


@query("s05_year_scan", f"""
SELECT CAST(year(time) AS INTEGER) AS yr, variable, CAST(count(*) AS BIGINT) AS n_rows, {s6('max(value)')} AS hi
FROM field WHERE year(time) IN (1996, 1998) GROUP BY 1, 2""")
def year_scan(v):
    cube = cubes.in_file_order(cubes.read_cube(v.spark, v.stored, years=[1996, 1998]))
    cube = prepare_field(cube)
    return cube.groupBy(F.year("time").alias("yr"), "variable").agg(
        F.count(F.lit(1)).alias("n_rows"), r6(F.max("value"), "hi"))


@query("s06_place_list", """
SELECT CAST(row_number() OVER (ORDER BY loc_id) - 1 AS BIGINT) AS loc_id, lat, lon FROM location""")
def place_list(v):
    path = fresh_path(v.spark, "places")
    write_places(v.location, path)
    return listings.read_places(v.spark, path)


@query("s07_event_times", """
SELECT algo, loc_id, time FROM event_hourly""")
def event_times(v):
    stamps = v.event_hourly.select("algo", "loc_id", stamp_text(F.col("time")).alias("value"))
    blanks = v.event_hourly.select("algo", "loc_id", F.explode(F.array(F.lit(""), F.lit("[]"))).alias("value"))
    path = fresh_path(v.spark, "stamps")
    stamps.unionByName(blanks).hint("rebalance", "algo", "loc_id").write.partitionBy("algo", "loc_id").text(path)
    read = listings.parse_event_lines(v.spark.read.text(path))
    return read.select("algo", F.col("loc_id").cast("long").alias("loc_id"), "time")


@query("s08_event_points", """
SELECT time, lon, lat FROM event_pt""")
def event_points(v):
    lines = v.event_pt.select(F.concat_ws(",", stamp_text(F.col("time")), "lon", "lat").alias("value"))
    path = fresh_path(v.spark, "points")
    lines.write.text(path)
    return listings.read_event_points(v.spark, path)


@query("s09_hour_keys", """
SELECT DISTINCT strftime(time, '%Y-%m-%dT%H') AS hour FROM (
  SELECT time, row_number() OVER (PARTITION BY algo, loc_id, year(time) ORDER BY time) AS rn,
    count(*) OVER (PARTITION BY algo, loc_id, year(time)) AS n FROM event_hourly) q
WHERE rn > 2 AND rn < n""")
def hour_keys(v):
    return listings.parse_hour_keys(yearly_list_lines(v.event_hourly).select("value"))


@query("s10_list_parse", """
SELECT algo, loc_id, time FROM event_daily""")
def list_parse(v):
    return listings.parse_stamp_lists(yearly_list_lines(v.event_daily)).select("algo", "loc_id", "time")


@query("s11_label_lines", """
SELECT algo, loc_id, time, cluster, cluster AS short_cluster FROM event_daily""")
def label_lines(v):
    lines = v.event_daily.select("algo", "loc_id", "time", F.col("cluster").cast("string").alias("value"))
    full = listings.parse_labels(lines)
    short = listings.parse_labels(lines, first_character_only=True).withColumnRenamed("cluster", "short_cluster")
    return full.join(short, ["algo", "loc_id", "time"])


@query("s11_label_files", """
SELECT CAST(row_number() OVER (ORDER BY algo, time, loc_id, cluster) - 1 AS BIGINT) AS pos, cluster FROM event_daily""")
def label_files(v):
    """Labels as they are stored: text files with a label a line, which only their place ties to an event."""
    path = fresh_path(v.spark, "labels")
    v.event_daily.orderBy("algo", "time", "loc_id", "cluster").select(F.col("cluster").cast("string").alias("value")).write.text(path)
    return listings.read_labels(v.spark, path)


@query("s12_climatology_scan", f"""
SELECT variable, CAST(mon AS INTEGER) AS mon, level, CAST(count(*) AS BIGINT) AS n_rows, {s6('avg(value)')} AS mean_value
FROM climatology WHERE variable='T' GROUP BY variable, mon, level""")
def climatology_scan(v):
    path = fresh_path(v.spark, "climatology")
    write_partitioned(v.climatology, path, ["variable"])
    clim = cubes.read_climatology(v.spark, path, ["T"])
    return clim.groupBy("variable", "mon", "level").agg(
        F.count(F.lit(1)).alias("n_rows"), r6(F.avg("value"), "mean_value"))


@query("s13_synthetic_cube")
def synthetic_cube(v):
    cube = cubes.synthetic_cube(v.axis, 19, 36)
    return cube.groupBy("lat", "lon").agg(
        F.count(F.lit(1)).alias("n_rows"), F.avg("value").alias("mean_value"), F.stddev_pop("value").alias("std_value"))


@query("s13_cube_bounds", """
SELECT CAST(684 AS BIGINT) AS n_cells, CAST(684 * count(*) AS BIGINT) AS n_rows, CAST(count(*) AS BIGINT) AS n_stamps, CAST(-90 AS DOUBLE) AS south,
  CAST(90 AS DOUBLE) AS north, CAST(0 AS DOUBLE) AS west, CAST(360 AS DOUBLE) AS east, true AS scaled, true AS no_stamp_alike FROM axis""")
def cube_bounds(v):
    """What must hold of the noise: a value for every stamp and cell, its scale, and no two frames alike."""
    cube = cubes.synthetic_cube(v.axis, 19, 36)
    frames = cube.groupBy("time").agg(F.sum("value").alias("total"))
    alike = frames.agg(F.count_distinct("total") == F.count(F.lit(1))).scalar()
    scale = F.stddev_pop("value").between(0.095, 0.105) & (F.abs(F.avg("value")) < 0.005) & (F.max(F.abs("value")) < 1.0)
    return cube.agg(
        F.count_distinct("lat", "lon").alias("n_cells"), F.count(F.lit(1)).alias("n_rows"), F.count_distinct("time").alias("n_stamps"),
        F.min("lat").alias("south"), F.max("lat").alias("north"), F.min("lon").alias("west"), F.max("lon").alias("east"),
        scale.alias("scaled")).withColumn("no_stamp_alike", alike)


@query("s14_selftest_frames", """
SELECT CAST(r.range*n.n + f.frame AS BIGINT) AS pos, CAST(f.frame AS BIGINT) AS frame, CAST(f.n_cells AS BIGINT) AS n_cells,
  CAST(0 AS DOUBLE) AS lowest_noise
FROM (SELECT a.pos // 12 AS frame, count(*) AS n_cells FROM field c JOIN axis a ON a.time=c.time
  WHERE a.pos % 12 = 0 AND c.variable='T' AND c.level=500 GROUP BY 1) f
CROSS JOIN range(20) r
CROSS JOIN (SELECT count(*) AS n FROM axis x WHERE x.pos % 12 = 0
  AND x.time IN (SELECT time FROM axis)) n""")
def selftest_frames(v):
    frames = select_levels(v.field.where("variable = 'T'"), [500])
    # positions are those of the whole time axis, so that every 12th stamp counts
    full = v.field.where("variable = 'T'")
    planted = planted_frames(full).where("level = 500")
    clean = frames.select("variable", "time", "level", "lat", "lon", F.col("value").alias("before"))
    noisy = planted.join(clean, ["variable", "time", "level", "lat", "lon"])
    noise = F.col("value") - F.col("before")
    return noisy.groupBy("pos", "frame").agg(
        F.count(F.lit(1)).alias("n_cells"), F.min(F.when((noise >= 0) & (noise < 1), 0.0).otherwise(noise)).alias("lowest_noise"))
