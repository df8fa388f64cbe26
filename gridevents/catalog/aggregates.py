"""Aggregations."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from gridevents.catalog.registry import query, r6, s6
from gridevents.functions.times import stamp_text
from gridevents.operators import axes, blocks, climate, cluster, events, moments, stats
from gridevents.operators.boxjoin import join_event_boxes
from gridevents.plans.composites import prepare_field, with_centres
from gridevents.plans.detection import box_means
from gridevents.session import fresh_path
from gridevents.sinks import tables

ALGOS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
_BOXES = """mask m JOIN location l ON m.lon BETWEEN l.lon AND l.lon+1 AND m.lat BETWEEN l.lat AND l.lat+1"""


@query("a01_box_mean", f"""
SELECT m.algo, l.loc_id, m.time, {s6('avg(m.tag)')} AS box_mean FROM {_BOXES} GROUP BY m.algo, l.loc_id, m.time""")
def box_mean(v):
    return box_means(v.mask, v.location).select("algo", "loc_id", "time", r6("box_mean"))


@query("a01_box_mean_weighted", f"""
SELECT m.algo, l.loc_id, m.time, {s6('sum(m.tag*cos(radians(m.lat)))/sum(cos(radians(m.lat)))')} AS box_mean
FROM {_BOXES} GROUP BY m.algo, l.loc_id, m.time""")
def box_mean_weighted(v):
    return box_means(v.mask, v.location, area_weighted=True).select("algo", "loc_id", "time", r6("box_mean"))


@query("a02_time_mean", f"""
SELECT variable, level, lat, lon, {s6('avg(value)')} AS mean_value FROM field GROUP BY 1,2,3,4""")
def time_mean(v):
    return climate.time_mean(v.field).withColumn("mean_value", r6("mean_value"))


@query("a03_monthly_mean", f"""
SELECT CAST(month(time) AS INTEGER) AS mon, variable, level, lat, lon, {s6('avg(value)')} AS mean_value FROM field GROUP BY 1,2,3,4,5""")
def monthly_mean(v):
    return climate.monthly_mean(v.field).withColumn("mean_value", r6("mean_value"))


@query("a04_reduce_dims", f"""
SELECT variable, level, lat, lon, {s6('avg(value)')} AS clim_value FROM climatology GROUP BY 1,2,3,4""")
def reduce_dims(v):
    return climate.mean_climatology(v.climatology).withColumn("clim_value", r6("clim_value"))


@query("a04_reduce_one_dim", f"""
SELECT variable, level, lat, lon, CAST(bnds AS INTEGER) AS bnds, {s6('avg(value)')} AS clim_value FROM climatology
WHERE variable='Q' GROUP BY 1,2,3,4,5""")
def reduce_one_dim(v):
    out = climate.mean_climatology(v.climatology.where("variable = 'Q'"), ["mon"])
    return out.withColumn("clim_value", r6("clim_value"))


@query("a05_total_mean_std", f"""
SELECT {s6('avg(value)')} AS mean_value, {s6('stddev_pop(value)')} AS std_value FROM field WHERE variable='T'""")
def total_mean_std(v):
    out = stats.total_mean_std(v.field.where("variable = 'T'"))
    return out.select(r6("mean_value"), r6("std_value"))


@query("a05_stored_moments", f"""
SELECT variable, level, lat, lon, CAST(count(value) AS BIGINT) AS n, {s6('avg(value)')} AS mean_value, {s6('stddev_pop(value)')} AS std_value
FROM field GROUP BY 1,2,3,4""")
def stored_moments(v):
    """The last year is added to what is stored of the others."""
    path, cell = fresh_path(v.spark, "moments"), ["variable", "level", "lat", "lon"]
    last = v.field.agg(F.year(F.max("time"))).scalar()
    tables.write_moments(v.field.where(F.year("time") < last), path, cell)
    tables.write_moments(v.field.where(F.year("time") == last), path, cell)
    whole = moments.merged(v.spark.read.parquet(path), cell)
    return moments.mean_and_std(whole.withColumn("_n", F.col("n"))).select(
        *cell, F.col("_n").alias("n"), r6("mean_value"), r6("std_value"))


@query("a06_level_extremes", """
SELECT variable, time, level, lat, lon, min(value) OVER (PARTITION BY variable, level) AS lo,
  max(value) OVER (PARTITION BY variable, level) AS hi FROM field""")
def level_extremes(v):
    out = stats.with_extremes(v.field, ["variable", "level"], "value", ["time", "lat", "lon"])
    return out.select("variable", "time", "level", "lat", "lon", "lo", "hi")


@query("a07_cluster_mean", f"""
SELECT e.algo, e.cluster, f.variable, f.level, f.lat-c.centre_lat AS rel_lat, f.lon-c.centre_lon AS rel_lon,
  {s6('avg(f.value)')} AS mean_value
FROM event_daily e JOIN centre c ON c.loc_id=e.loc_id JOIN wfield f ON f.time=e.time AND f.variable='T'
  AND f.lat BETWEEN c.centre_lat-2 AND c.centre_lat+2 AND f.lon BETWEEN c.centre_lon-4 AND c.centre_lon+4
GROUP BY 1,2,3,4,5,6""")
def cluster_mean(v):
    matched = with_centres(v.event_daily.withColumnRenamed("time", "matched_time"), v.location)
    windows = axes.relative_offsets(join_event_boxes(prepare_field(v.field, "T"), matched, 2, 4))
    return windows.groupBy("algo", "cluster", "variable", "level", "rel_lat", "rel_lon").agg(
        r6(F.avg("value"), "mean_value"))


@query("a08_yearly_counts", """
SELECT algo, loc_id, CAST(year(time) AS INTEGER) AS yr, CAST(count(*) AS BIGINT) AS n_events FROM event_daily GROUP BY 1,2,3""")
def yearly_counts(v):
    return events.yearly_counts(v.event_daily).withColumnRenamed("year", "yr")


@query("a09_yearly_totals", """
SELECT algo, CAST(yr AS INTEGER) AS yr, CAST(sum(n) AS BIGINT) AS n_events FROM
 (SELECT algo, loc_id, year(time) AS yr, count(*) AS n FROM event_daily GROUP BY 1,2,3) c GROUP BY ROLLUP (algo, yr)""")
def yearly_totals(v):
    return events.yearly_totals(events.yearly_counts(v.event_daily)).withColumnRenamed("year", "yr")


@query("a10_event_lists", """
SELECT algo, loc_id, CAST(year(time) AS INTEGER) AS yr, string_agg(strftime(time, '%Y-%m-%dT%H:%M:%S'), ',' ORDER BY time) AS stamps
FROM event_daily GROUP BY 1,2,3""")
def event_lists(v):
    lists = events.yearly_lists(v.event_daily).withColumnRenamed("year", "yr")
    return lists.withColumn("stamps", F.array_join(F.transform("stamps", stamp_text), ","))


@query("a11_cluster_sizes", """
SELECT algo, cluster, CAST(count(*) AS BIGINT) AS n_events,
  CAST(rank() OVER (PARTITION BY algo ORDER BY count(*) DESC) AS INTEGER) AS size_rank FROM event_daily GROUP BY 1,2""")
def cluster_sizes(v):
    # the ranked table has one row per algorithm and cluster
    return events.cluster_sizes(v.event_daily).withColumn(
        "size_rank", F.rank().over(W.partitionBy("algo").orderBy(F.desc("n_events"))))


@query("a12_distinct_clusters", "SELECT DISTINCT cluster FROM event_daily")
def distinct_clusters(v):
    return v.event_daily.select("cluster").distinct()


@query("a13_axis_length", """
SELECT variable, CAST(count(DISTINCT time) AS BIGINT) AS n_times FROM field GROUP BY variable""")
def axis_length(v):
    return axes.axis_length(v.field, ["variable"])


@query("a14_longitude_frame", """
SELECT max(lon) AS max_lon, CAST(CASE WHEN max(lon)>=359 THEN 360 WHEN max(lon)>=179 THEN 180 END AS INTEGER) AS frame FROM field""")
def longitude_frame(v):
    return axes.longitude_frame(v.field)


@query("a15_resolution", """
SELECT 'lat' AS coord, min(lat) AS origin, (SELECT min(lat) FROM field WHERE lat > (SELECT min(lat) FROM field)) - min(lat) AS step FROM field
UNION ALL SELECT 'lon', min(lon), (SELECT min(lon) FROM field WHERE lon > (SELECT min(lon) FROM field)) - min(lon) FROM field""")
def resolution(v):
    parts = [axes.axis_origin_and_step(v.field, c).withColumn("coord", F.lit(c)) for c in ("lat", "lon")]
    return parts[0].unionByName(parts[1]).select("coord", "origin", "step")


@query("a15_axis_registry", """
WITH v AS (SELECT DISTINCT 'lat' AS coord, lat AS x FROM field UNION ALL SELECT DISTINCT 'lon', lon FROM field),
g AS (SELECT coord, x, CAST(round(1e6*(x - lag(x) OVER (PARTITION BY coord ORDER BY x))) AS BIGINT) AS gap FROM v),
d AS (SELECT coord, min(x) AS origin, max(x) AS top, count(*) AS n, list_reduce(list(gap) FILTER (gap IS NOT NULL), lambda a, b: gcd(a, b)) / 1e6 AS step
  FROM g GROUP BY coord)
SELECT coord, origin, step, CAST(n AS BIGINT) AS n_values, CAST(round((top-origin)/step) + 1 - n AS BIGINT) AS n_missing FROM d""")
def axis_registry(v):
    path = fresh_path(v.spark, "axes")
    tables.write_axes(v.field, path)
    return v.spark.read.parquet(path)


@query("a16_chunk_range", """
SELECT CAST(floor(a.pos/100) AS BIGINT) AS chunk_time, min(c.time) AS first_time, max(c.time) AS last_time
FROM field c JOIN axis a ON a.time=c.time GROUP BY 1""")
def chunk_range(v):
    return axes.time_range(blocks.with_chunks(v.field, {"time": 100}), ["chunk_time"])


_PAIRS = """SELECT a.vec_id, a.label AS own, b.label AS other, count(*) AS n,
  sum(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: power(CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE), 2)))) AS total
FROM embeddings a CROSS JOIN embeddings b GROUP BY 1,2,3"""


@query("a17_mean_silhouette", f"""
WITH pairs AS ({_PAIRS}),
near AS (SELECT vec_id, max(CASE WHEN own=other THEN n END) AS n,
    max(CASE WHEN own=other AND n>1 THEN total/(n-1) END) AS a, min(CASE WHEN own<>other THEN total/n END) AS b
  FROM pairs GROUP BY vec_id)
SELECT {s6('avg(CASE WHEN n=1 THEN 0 ELSE (b-a)/greatest(a,b) END)')} AS silhouette FROM near""")
def mean_silhouette(v):
    out = cluster.squared_silhouette(v.vectors.withColumnRenamed("label", "cluster"))
    return out.select(r6("silhouette"))
