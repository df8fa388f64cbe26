"""Projections, filters and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridevents.catalog.registry import query, r6, s6
from gridevents.functions.text import bare_name, place_year_key
from gridevents.functions.times import stamp_text
from gridevents.operators import axes, filters, grid
from gridevents.operators.boxjoin import join_boxes
from gridevents.operators.climate import base_period
from gridevents.operators.joins import lookup_join
from gridevents.operators.ordering import strided
from gridevents.plans.composites import with_centres
from gridevents.plans.detection import box_means, landing_boxes
from gridevents.sources.listings import every_nth_place


@query("p01_variable", f"""
SELECT upper(lower(variable)) AS variable, level, CAST(count(*) AS BIGINT) AS n_rows, {s6('avg(value)')} AS mean_value
FROM field WHERE variable='T' GROUP BY 1, 2""")
def variable(v):
    lower = v.field.withColumn("variable", F.lower("variable"))
    return filters.select_variable(lower, "t").groupBy("variable", "level").agg(
        F.count(F.lit(1)).alias("n_rows"), r6(F.avg("value"), "mean_value"))


@query("p02_levels", """
SELECT variable, time, level, lat, lon, value FROM field WHERE variable='Q' AND level IN (850,700,500,300,250)""")
def levels(v):
    return filters.select_levels(v.field.where("variable = 'Q'"), [850, 700, 500, 300, 250], strict=True)


@query("p03_season", """
SELECT algo, CAST(month(time) AS INTEGER) AS mon, CAST(count(*) AS BIGINT) AS n_rows, CAST(sum(tag) AS BIGINT) AS n_tagged
FROM mask WHERE month(time) IN (12,1,2) GROUP BY 1, 2""")
def season(v):
    return filters.select_season(v.mask, ["Dec", "Jan", "Feb"]).groupBy("algo", F.month("time").alias("mon")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("tag").cast("long").alias("n_tagged"))


@query("p04_single_months", f"""
SELECT variable, CAST(month(time) AS INTEGER) AS mon, CAST(count(*) AS BIGINT) AS n_rows, {s6('avg(value)')} AS mean_value
FROM field GROUP BY 1, 2""")
def single_months(v):
    return v.field.groupBy("variable", F.month("time").alias("mon")).agg(
        F.count(F.lit(1)).alias("n_rows"), r6(F.avg("value"), "mean_value"))


@query("p05_region", """
SELECT variable, time, level, lat, (lon+180)%360-180 AS lon, value FROM field
WHERE variable='T' AND lat BETWEEN 22 AND 26 AND (lon+180)%360-180 BETWEEN -130 AND -122""")
def region(v):
    return filters.select_region(v.field.where("variable = 'T'"), (26, 22), (-130, -122))


@query("p06_landing_box", """
SELECT m.algo, l.loc_id, m.time, m.lat, (m.lon+180)%360-180 AS lon, m.tag FROM mask m JOIN location l
ON m.lon BETWEEN l.lon AND l.lon+1 AND m.lat BETWEEN l.lat AND l.lat+1""")
def landing_box(v):
    cells = axes.canonical_longitude(v.mask)
    return join_boxes(cells, landing_boxes(v.location)).select("algo", "loc_id", "time", "lat", "lon", "tag")


@query("p07_centred_window", """
SELECT l.loc_id, c.time, c.level, c.lat, c.lon, c.value FROM wfield c JOIN centre l
ON c.lat BETWEEN l.centre_lat-1 AND l.centre_lat+1 AND c.lon BETWEEN l.centre_lon-2 AND l.centre_lon+2
WHERE c.variable='T'""")
def centred_window(v):
    cells = axes.canonical_longitude(v.field.where("variable = 'T'"))
    places = with_centres(v.location.select("loc_id"), v.location)
    boxes = places.select("loc_id", (F.col("centre_lat") - 1).alias("lat_lo"), (F.col("centre_lat") + 1).alias("lat_hi"),
                          (F.col("centre_lon") - 2).alias("lon_lo"), (F.col("centre_lon") + 2).alias("lon_hi"))
    return join_boxes(cells, boxes).select("loc_id", "time", "level", "lat", "lon", "value")


@query("p08_threshold", f"""
SELECT m.algo, l.loc_id, m.time, {s6('avg(m.tag)')} AS box_mean FROM mask m JOIN location l
ON m.lon BETWEEN l.lon AND l.lon+1 AND m.lat BETWEEN l.lat AND l.lat+1
GROUP BY m.algo, l.loc_id, m.time HAVING avg(m.tag) >= 0.5""")
def threshold(v):
    return box_means(v.mask, v.location).where(filters.at_least("box_mean", 0.5)).select(
        "algo", "loc_id", "time", r6("box_mean"))


@query("p09_event_years", """
SELECT algo, loc_id, time, cluster FROM event_daily WHERE year(time) BETWEEN 1996 AND 1997""")
def event_years(v):
    return filters.select_years(v.event_daily, 1996, 1997)


@query("p10_well_formed", """
SELECT algo, loc_id, time FROM event_hourly WHERE cluster = 1""")
def well_formed(v):
    text = F.when(F.col("cluster") == 1, stamp_text(F.col("time"))).when(F.col("loc_id") % 2 == 0, "[]").otherwise("not a stamp")
    lines = v.event_hourly.select("algo", "loc_id", text.alias("stamp"))
    return filters.well_formed_stamps(lines).drop("stamp")


@query("p11_single_level", """
SELECT variable, time, level, lat, lon, value FROM field WHERE variable='Z' AND level=500""")
def single_level(v):
    return filters.select_level(v.field.where("variable = 'Z'"), 500)


@query("p12_positional", """
SELECT variable, time, level, lat, lon, value FROM field
WHERE variable='T' AND lat IN (SELECT lat FROM (SELECT lat, row_number() OVER (ORDER BY lat)-1 AS p
  FROM (SELECT DISTINCT lat FROM field) d) q WHERE p IN (0, 3))""")
def positional(v):
    return axes.at_positions(v.field.where("variable = 'T'"), "lat", [0, 3])


@query("p13_strided", """
SELECT 'stamp' AS kind, pos, time FROM axis WHERE pos % 20 = 0
UNION ALL SELECT 'place', CAST(loc_id AS BIGINT), NULL FROM location WHERE loc_id % 6 = 0""")
def strided_sample(v):
    stamps = strided(v.axis, 20).select(F.lit("stamp").alias("kind"), "pos", "time")
    places = every_nth_place(v.location).select(
        F.lit("place").alias("kind"), F.col("loc_id").alias("pos"), F.lit(None).cast("timestamp_ntz").alias("time"))
    return stamps.unionByName(places)


@query("p14_empty_groups", """
SELECT e.algo, e.loc_id, CAST(count(*) AS BIGINT) AS n_events, l.lat FROM event_hourly e JOIN location l ON l.loc_id=e.loc_id
WHERE e.cluster=1 AND hour(e.time)=7 GROUP BY e.algo, e.loc_id, l.lat""")
def empty_groups(v):
    kept = v.event_hourly.where((F.col("cluster") == 1) & (F.hour("time") == 7))
    counts = kept.groupBy("algo", "loc_id").agg(F.count(F.lit(1)).alias("n_events"))
    return lookup_join(counts, v.location.select("loc_id", "lat"), ["loc_id"], ["algo"])


@query("p15_key_match", """
SELECT e.algo, CAST(l.lon AS VARCHAR) || 'E_' || CAST(l.lat AS VARCHAR) || 'N_' || CAST(year(e.time) AS VARCHAR) AS place_year,
  CAST(count(*) AS BIGINT) AS n_events
FROM event_daily e JOIN location l ON l.loc_id=e.loc_id WHERE year(e.time)=1997 GROUP BY 1, 2""")
def key_match(v):
    placed = lookup_join(v.event_daily, v.location, ["loc_id"], ["algo", "time"])
    keyed = placed.withColumn("place_year", place_year_key(F.col("lat"), F.col("lon"), F.year("time")))
    return filters.matching_key(keyed, "place_year", "_1997").groupBy("algo", "place_year").agg(
        F.count(F.lit(1)).alias("n_events"))


@query("p16_cell_mask", f"""
SELECT time, level, lat, lon, CASE WHEN abs(g) > 5 AND abs(value - m) > 10 THEN 1 ELSE 0 END AS wave FROM (
  SELECT time, level, lat, lon, value, avg(value) OVER (PARTITION BY level, lat, lon) AS m,
    CASE WHEN lag(value) OVER w IS NULL THEN lead(value) OVER w - value
      WHEN lead(value) OVER w IS NULL THEN value - lag(value) OVER w
      ELSE (lead(value) OVER w - lag(value) OVER w)/2 END AS g
  FROM field WHERE variable='T' WINDOW w AS (PARTITION BY time, level, lon ORDER BY lat)) q""")
def cell_mask(v):
    marked = grid.wave_mask(v.field.where("variable = 'T'"), 5, 10)
    return marked.select("time", "level", "lat", "lon", "wave")


@query("p17_bare_names", """
SELECT algo, CAST(count(*) AS BIGINT) AS n_events FROM event_daily GROUP BY algo""")
def bare_names(v):
    slashed = v.event_daily.withColumn(
        "algo", F.when(F.col("loc_id") % 2 == 0, F.concat(F.lit("/"), "algo", F.lit("/"))).otherwise(F.col("algo")))
    return slashed.groupBy(bare_name(F.col("algo")).alias("algo")).agg(F.count(F.lit(1)).alias("n_events"))


@query("p18_algorithm_list", """
SELECT algo, loc_id, time, cluster FROM event_daily WHERE algo IN ('1-URGENT','2-HIGH')""")
def algorithm_list(v):
    return filters.select_algorithms(v.event_daily, "1-URGENT,/2-HIGH/")


@query("p19_base_period", f"""
SELECT variable, CAST(month(time) AS INTEGER) AS mon, CAST(count(*) AS BIGINT) AS n_rows, {s6('avg(value)')} AS mean_value
FROM field WHERE month(time) IN (1,2,12) AND lat BETWEEN 10 AND 60 AND (lon+180)%360-180 BETWEEN -170 AND -30
GROUP BY 1, 2""")
def base(v):
    return base_period(v.field).groupBy("variable", F.month("time").alias("mon")).agg(
        F.count(F.lit(1)).alias("n_rows"), r6(F.avg("value"), "mean_value"))
