"""Sinks: each query writes to a new folder of the shared scratch space and reads it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridevents.catalog.registry import query, r6, s6
from gridevents.operators import blocks, consensus
from gridevents.plans import clustering, composites, energies
from gridevents.session import fresh_path
from gridevents.sinks import listings as text_sinks, tables
from gridevents.sources import listings


def _path(v, name):
    return fresh_path(v.spark, name)


@query("k01_cube_table", """
SELECT variable, CAST(year(time) AS INTEGER) AS yr, CAST(month(time) AS INTEGER) AS mon, time, level, lat, lon, value FROM field""")
def cube_table(v):
    path = _path(v, "cube")
    tables.write_cube(v.field, path)
    return v.spark.read.parquet(path).select("variable", F.col("year").alias("yr"), F.col("month").alias("mon"),
                                             "time", "level", "lat", "lon", "value")


@query("k02_chunked_blocks", """
SELECT CAST(floor(a.pos/365) + 3 AS INTEGER) AS chunk_id, CAST(count(*) AS BIGINT) AS n_rows, CAST(count(DISTINCT f.time) AS BIGINT) AS n_times
FROM field f JOIN axis a ON a.time=f.time GROUP BY 1""")
def chunked_blocks(v):
    path = _path(v, "chunks")
    tables.write_chunks(v.field, path, {"time": 365}, counter=3)
    return v.spark.read.parquet(path).groupBy("chunk_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("time").alias("n_times"))


@query("k03_range_names", """
SELECT CAST(floor(pos/365) AS BIGINT) AS chunk_id,
  'cube_' || strftime(min(time), '%Y-%m-%dT%H:%M') || '_' || strftime(max(time), '%Y-%m-%dT%H:%M') AS name FROM axis GROUP BY 1""")
def range_names(v):
    manifest = blocks.chunk_table(blocks.with_chunks(v.field, {"time": 365}), ["time"])
    return tables.chunk_names(manifest, "cube").select("chunk_id", "name")


@query("k04_yearly_lists", """
SELECT algo, loc_id, CAST(year(time) AS INTEGER) AS yr,
  '[' || string_agg(chr(39) || strftime(time, '%Y-%m-%dT%H:%M:%S') || chr(39), ', ' ORDER BY time) || ']' AS value
FROM event_daily GROUP BY 1,2,3""")
def yearly_lists(v):
    path = _path(v, "lists")
    text_sinks.write_yearly_lists(v.event_daily, path)
    back = v.spark.read.text(path)
    return back.select("algo", F.col("loc_id").cast("long").alias("loc_id"), F.col("year").cast("int").alias("yr"), "value")


@query("k05_event_lists", "SELECT algo, loc_id, time FROM event_daily")
def event_lists(v):
    path = _path(v, "events")
    text_sinks.write_event_lists(v.event_daily, path)
    back = listings.read_event_lists(v.spark, path)
    return back.select("algo", F.col("loc_id").cast("long").alias("loc_id"), "time")


@query("k05_packed_lists", "SELECT algo, CAST(loc_id AS BIGINT) AS loc_id, time FROM event_daily")
def packed_lists(v):
    path = _path(v, "packed")
    text_sinks.write_packed_lists(v.event_daily, path)
    return listings.read_packed_lists(v.spark, path)


@query("k06_place_list", "SELECT CAST(loc_id AS BIGINT) AS loc_id, lat, lon FROM location")
def place_list(v):
    path = _path(v, "places")
    text_sinks.write_places(v.location, path)
    return listings.read_places(v.spark, path)


@query("k07_cluster_labels", "SELECT algo, loc_id, time, cluster FROM event_daily")
def cluster_labels(v):
    path = _path(v, "labels")
    tables.write_labels(v.event_daily, path)
    return v.spark.read.parquet(path).select("algo", "loc_id", "time", "cluster")


@query("k08_monthly_output", f"""
SELECT CAST(year(time) AS INTEGER) AS yr, CAST(month(time) AS INTEGER) AS mon, CAST(count(*) AS BIGINT) AS n_rows,
  {s6('max(2.5e6*(disc/10)+1004.0*(220+qty)+9.8*price)')} AS max_mde FROM cell WHERE level IN (850,700,500,300,250) GROUP BY 1,2""")
def monthly_output(v):
    path = _path(v, "monthly")
    tables.write_monthly(energies.moist_energies(v.field), path)
    back = v.spark.read.parquet(path)
    return back.groupBy(F.col("year").alias("yr"), F.col("month").alias("mon")).agg(
        F.count(F.lit(1)).alias("n_rows"), r6(F.max("mde"), "max_mde"))


_DAYS = "SELECT time FROM event_daily GROUP BY time HAVING count(DISTINCT algo) = 5"


@query("k09_consensus_subsets", f"SELECT algo, time, lat, lon, tag, time IN ({_DAYS}) AS consensus FROM mask")
def consensus_subsets(v):
    path = _path(v, "consensus")
    tables.write_consensus(v.mask, consensus.consensus_times(v.event_daily, 5), path)
    return v.spark.read.parquet(path).select("algo", "time", "lat", "lon", "tag",
                                             F.col("consensus").cast("boolean").alias("consensus"))


@query("k10_cluster_averages", f"""
SELECT algo, cluster, variable, level, rel_lat, rel_lon, {s6('mv')} AS mean_value,
  {s6('2*(mv-min(mv) OVER w)/nullif(max(mv) OVER w-min(mv) OVER w,0)-1')} AS norm_value FROM (
 SELECT e.algo, e.cluster, f.variable, f.level, f.lat-c.centre_lat AS rel_lat, f.lon-c.centre_lon AS rel_lon, avg(f.value) AS mv
 FROM numbered e JOIN nearmap m ON m.time=e.time JOIN centre c ON c.loc_id=e.loc_id JOIN wfield f ON f.time=m.matched_time
  AND f.lat BETWEEN c.centre_lat-2 AND c.centre_lat+2 AND f.lon BETWEEN c.centre_lon-4 AND c.centre_lon+4 AND f.variable='T'
 GROUP BY 1,2,3,4,5,6) q WINDOW w AS (PARTITION BY algo, cluster, variable, level)""")
def cluster_averages(v):
    path = _path(v, "averages")
    comp = composites.composite_raw(v.field, v.event_daily, v.location, 2, 4, "T", axis=v.axis)
    tables.write_cluster_averages(clustering.cluster_averages(comp), path)
    return v.spark.read.parquet(path).select("algo", "cluster", "variable", "level", "rel_lat", "rel_lon",
                                             r6("mean_value"), r6("norm_value"))
