"""Joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridevents.catalog.registry import query, r6, s6
from gridevents.operators import align, climate, consensus, events
from gridevents.operators.axes import canonical_longitude
from gridevents.operators.boxjoin import join_boxes, join_event_boxes
from gridevents.operators.ordering import running_position
from gridevents.operators.timejoin import asof_lagged, asof_nearest
from gridevents.plans.comparison import with_titles
from gridevents.plans.detection import landing_boxes

TITLES = {"1-URGENT": "Urgent", "2-HIGH": "High", "3-MEDIUM": "Medium", "4-NOT SPECIFIED": "Unset", "5-LOW": "Low"}


@query("j01_asof_nearest", """
SELECT e.algo, e.loc_id, e.time, m.matched_time FROM event_daily e JOIN nearmap4 m ON m.time=e.time""")
def nearest(v):
    return asof_nearest(v.event_daily, v.axis4).select("algo", "loc_id", "time", "matched_time")


@query("j01_asof_nearest_global", """
SELECT e.algo, e.loc_id, e.time, CASE WHEN p IS NULL THEN n WHEN n IS NULL THEN p WHEN n-e.time <= e.time-p THEN n ELSE p END AS matched_time
FROM event_hourly e JOIN (SELECT e.time, max(CASE WHEN a.time<=e.time THEN a.time END) AS p, min(CASE WHEN a.time>=e.time THEN a.time END) AS n
  FROM (SELECT DISTINCT time FROM event_hourly) e CROSS JOIN axis4 a GROUP BY e.time) m ON m.time=e.time""")
def nearest_global(v):
    return asof_nearest(v.event_hourly, v.axis4, "global").select("algo", "loc_id", "time", "matched_time")


@query("j01_asof_tolerance", """
SELECT e.algo, e.loc_id, e.time, m.matched_time FROM event_daily e JOIN nearmap4 m ON m.time=e.time
WHERE CASE WHEN m.matched_time > e.time THEN m.matched_time - e.time ELSE e.time - m.matched_time END <= INTERVAL 1 DAY""")
def nearest_within(v):
    return asof_nearest(v.event_daily, v.axis4, tolerance="1 day").select("algo", "loc_id", "time", "matched_time")


_GAP = """(SELECT time FROM axis WHERE year(time) <> 1995)"""


@query("j01_year_gap", f"""
SELECT e.algo, e.loc_id, e.time, CASE WHEN p IS NULL THEN n WHEN n IS NULL THEN p WHEN n-e.time <= e.time-p THEN n ELSE p END AS matched_time
FROM event_daily e JOIN (SELECT e.time, max(CASE WHEN a.time<=e.time THEN a.time END) AS p, min(CASE WHEN a.time>=e.time THEN a.time END) AS n
  FROM (SELECT DISTINCT time FROM event_daily) e JOIN {_GAP} a ON year(a.time)=year(e.time) GROUP BY e.time) m ON m.time=e.time""")
def asof_year_gap(v):
    axis = v.axis.where(F.year("time") != 1995)
    return asof_nearest(v.event_daily, axis).select("algo", "loc_id", "time", "matched_time")


@query("j02_hours_in_year", """
SELECT e.algo, e.loc_id, e.time, CAST(36 AS INTEGER) AS lag,
  CASE WHEN p IS NULL THEN n WHEN n IS NULL THEN p WHEN n-(e.time-INTERVAL 36 HOUR) <= (e.time-INTERVAL 36 HOUR)-p THEN n ELSE p END AS matched_time
FROM event_daily e JOIN (SELECT e.time, max(CASE WHEN a.time<=e.time-INTERVAL 36 HOUR THEN a.time END) AS p,
    min(CASE WHEN a.time>=e.time-INTERVAL 36 HOUR THEN a.time END) AS n
  FROM (SELECT DISTINCT time FROM event_daily) e JOIN axis a ON year(a.time)=year(e.time) GROUP BY e.time) m ON m.time=e.time""")
def lagged_hours_in_year(v):
    out = asof_lagged(v.event_daily, v.axis, [36], axis_scope="year", lag_unit="hours")
    return out.select("algo", "loc_id", "time", "lag", "matched_time")


@query("j02_asof_lagged", """
SELECT e.algo, e.loc_id, e.time, CAST(m.lag AS INTEGER) AS lag, m.matched_time FROM event_daily e JOIN lagmap m ON m.time=e.time""")
def lagged(v):
    return asof_lagged(v.event_daily, v.axis, [2, 4]).select("algo", "loc_id", "time", "lag", "matched_time")


@query("j02_asof_lagged_hours", """
SELECT e.algo, e.loc_id, e.time, CAST(36 AS INTEGER) AS lag,
  CASE WHEN p IS NULL THEN n WHEN n IS NULL THEN p WHEN n-m.shifted <= m.shifted-p THEN n ELSE p END AS matched_time
FROM event_daily e JOIN (SELECT e.time, e.shifted, max(CASE WHEN a.time<=e.shifted THEN a.time END) AS p,
  min(CASE WHEN a.time>=e.shifted THEN a.time END) AS n
  FROM (SELECT DISTINCT time, time - INTERVAL 36 HOUR AS shifted FROM event_daily) e CROSS JOIN axis a GROUP BY 1, 2) m
ON m.time=e.time""")
def lagged_hours(v):
    return asof_lagged(v.event_daily, v.axis, [36], "global", "hours").select(
        "algo", "loc_id", "time", "lag", "matched_time")


@query("j03_box_join", """
SELECT e.event_id, f.variable, f.level, f.lat, f.lon, f.value FROM event_pt e JOIN wfield f ON f.time=e.time
WHERE f.variable='T' AND f.lat BETWEEN e.lat-2 AND e.lat+2
  AND f.lon BETWEEN (e.lon+180)%360-180-4 AND (e.lon+180)%360-180+4""")
def box_join(v):
    v = v.built()  # for the count of cells and the join
    field = canonical_longitude(v.field.where("variable = 'T'"))
    points = canonical_longitude(v.event_pt).select(
        "event_id", F.col("time").alias("matched_time"), F.col("lat").alias("centre_lat"), F.col("lon").alias("centre_lon"))
    return join_event_boxes(field, points, 2, 4).select("event_id", "variable", "level", "lat", "lon", "value")


@query("j04_landing_join", """
SELECT m.algo, l.loc_id, CAST(count(*) AS BIGINT) AS n_cells, CAST(sum(m.tag) AS BIGINT) AS n_tagged
FROM mask m JOIN location l ON m.lon BETWEEN l.lon AND l.lon+1 AND m.lat BETWEEN l.lat AND l.lat+1
GROUP BY m.algo, l.loc_id""")
def landing_join(v):
    inside = join_boxes(canonical_longitude(v.mask), landing_boxes(v.location))
    return inside.groupBy("algo", "loc_id").agg(F.count(F.lit(1)).alias("n_cells"),
                                                F.sum("tag").cast("long").alias("n_tagged"))


@query("j05_climatology_anomaly", f"""
SELECT f.variable, f.time, f.level, f.lat, f.lon, {s6('f.value - c.cv')} AS anomaly FROM field f
JOIN (SELECT variable, level, lat, lon, avg(value) AS cv FROM climatology GROUP BY 1,2,3,4) c
ON f.variable=c.variable AND f.level=c.level AND f.lat=c.lat AND f.lon=c.lon""")
def climatology_anomaly(v):
    out = climate.subtract_climatology(v.field, climate.mean_climatology(v.climatology))
    return out.select("variable", "time", "level", "lat", "lon", r6("anomaly"))


_BASE = """(SELECT variable, month(time) AS mon, level, lat, lon, avg(value) AS mv FROM field
  WHERE month(time) IN (1,2,12) GROUP BY 1,2,3,4,5)"""


_CROWD = """SELECT o_orderkey AS event_id, 'T' AS variable, CAST(500 AS DOUBLE) AS level,
  CAST(20 AS DOUBLE)+CAST(0.5 AS DOUBLE)*(CASE WHEN o_orderkey%2=0 THEN 3 ELSE o_custkey%20 END) AS lat,
  CAST(225 AS DOUBLE)+CAST(0.625 AS DOUBLE)*(CASE WHEN o_orderkey%2=0 THEN 5 ELSE o_custkey%32 END) AS lon, o_totalprice AS value FROM orders"""


@query("j05_crowded_cells", f"""
SELECT w.event_id, w.lat, w.lon, {s6('w.value-c.clim_value')} AS anomaly FROM ({_CROWD}) w
JOIN (SELECT variable, level, lat, lon, avg(value) AS clim_value FROM climatology GROUP BY 1,2,3,4) c USING (variable, level, lat, lon)""")
def crowded_cells(v):
    """Windows of which half lie on one cell: its rows are dealt to parts."""
    even = F.col("o_orderkey") % 2 == 0
    windows = v.table("orders").select(
        F.col("o_orderkey").alias("event_id"), F.lit("T").alias("variable"), F.lit(500.0).alias("level"),
        (F.lit(20.0) + F.lit(0.5) * F.when(even, 3).otherwise(F.col("o_custkey") % 20)).alias("lat"),
        (F.lit(225.0) + F.lit(0.625) * F.when(even, 5).otherwise(F.col("o_custkey") % 32)).alias("lon"), F.col("o_totalprice").alias("value"))
    out = climate.subtract_climatology(windows, climate.mean_climatology(v.climatology), spread=["event_id"], hot_rows=1000)
    return out.select("event_id", "lat", "lon", r6("anomaly"))


@query("j06_monthly_anomaly_match", f"""
SELECT f.variable, f.time, f.level, f.lat, f.lon, {s6('f.value - m.mv')} AS anomaly FROM field f JOIN {_BASE} m
ON f.variable=m.variable AND month(f.time)=m.mon AND f.level=m.level AND f.lat=m.lat AND f.lon=m.lon""")
def anomaly_match(v):
    base = climate.select_season(v.field, ["Jan", "Feb", "Dec"])
    return climate.monthly_anomaly(v.field, base).select("variable", "time", "level", "lat", "lon", r6("anomaly"))


@query("j06_monthly_anomaly_cross", f"""
SELECT f.variable, f.time, f.level, f.lat, f.lon, CAST(m.mon AS INTEGER) AS clim_month, {s6('f.value - m.mv')} AS anomaly
FROM field f JOIN {_BASE} m ON f.variable=m.variable AND f.level=m.level AND f.lat=m.lat AND f.lon=m.lon
WHERE f.variable='T'""")
def anomaly_cross(v):
    t = v.field.where("variable = 'T'")
    out = climate.monthly_anomaly(t, climate.select_season(t, ["Jan", "Feb", "Dec"]), "cross")
    return out.select("variable", "time", "level", "lat", "lon", "clim_month", r6("anomaly"))


@query("j07_three_way", """
SELECT time, level, lat, lon, max(CASE WHEN variable='Q' THEN value END) AS q, max(CASE WHEN variable='Z' THEN value END) AS z,
  max(CASE WHEN variable='T' THEN value END) AS t
FROM field GROUP BY time, level, lat, lon HAVING count(DISTINCT variable) = 3""")
def three_way(v):
    return align.wide(v.field, ["Q", "Z", "T"]).withColumnsRenamed({"Q": "q", "Z": "z", "T": "t"})


@query("j08_outer_alignment", """
SELECT time, lat, lon, max(CASE WHEN variable='T' THEN value END) AS upper_value, max(CASE WHEN variable='Q' THEN value END) AS lower_value
FROM field WHERE (variable='T' AND level=500) OR (variable='Q' AND level=850) GROUP BY time, lat, lon""")
def outer_alignment(v):
    stacked = align.stacked_variables(v.field, "T", 500, "Q", 850)
    return align.wide(stacked, ["T", "Q"], ["time", "lat", "lon"], complete=False).withColumnsRenamed(
        {"T": "upper_value", "Q": "lower_value"})


_DAYS = "SELECT time FROM event_daily GROUP BY time HAVING count(DISTINCT algo) = 5"


@query("j09_semi", f"SELECT algo, time, lat, lon, tag FROM mask WHERE time IN ({_DAYS})")
def semi(v):
    days = consensus.consensus_times(v.event_daily, 5)
    return consensus.on_consensus(v.mask, days).select("algo", "time", "lat", "lon", "tag")


@query("j09_anti", f"SELECT algo, time, lat, lon, tag FROM mask WHERE time NOT IN ({_DAYS})")
def anti(v):
    days = consensus.consensus_times(v.event_daily, 5)
    return consensus.on_consensus(v.mask, days, invert=True).select("algo", "time", "lat", "lon", "tag")


@query("j10_labels_by_key", """
SELECT algo, loc_id, time, cluster FROM event_daily""")
def labels_by_key(v):
    labels = v.event_daily
    return events.with_labels(v.event_daily.drop("cluster"), labels, ["algo", "loc_id", "time"])


@query("j10_labels_by_position", """
SELECT a.algo, a.time, a.loc_id, b.cluster FROM
 (SELECT *, row_number() OVER (PARTITION BY algo ORDER BY loc_id, time)-1 AS p FROM event_daily) a
JOIN (SELECT *, row_number() OVER (PARTITION BY algo ORDER BY year(time), loc_id, time)-1 AS p FROM event_daily) b
ON a.algo=b.algo AND a.p=b.p""")
def labels_by_position(v):
    dated = v.event_daily.withColumn("_day", F.to_date("time")).withColumn("year", F.year("time"))
    listed = running_position(dated, ["algo"], ["loc_id", "_day"], ["time"]).select("algo", "loc_id", "time", "pos")
    labels = running_position(dated, ["algo"], ["year", "loc_id", "_day"], ["time"]).select("algo", "pos", "cluster")
    return events.with_labels(listed, labels, ["algo", "pos"]).select("algo", "time", "loc_id", "cluster")


_COUNTS = """(SELECT a.algo, l.loc_id, y.range AS yr, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT algo FROM event_daily) a
 CROSS JOIN location l CROSS JOIN range(1994, 2003) y
 LEFT JOIN (SELECT algo, loc_id, year(time) AS yr, count(*) AS n FROM event_daily GROUP BY 1,2,3) c
 ON c.algo=a.algo AND c.loc_id=l.loc_id AND c.yr=y.range)"""


@query("j11_zero_counts", f"""
SELECT algo, loc_id, CAST(yr AS INTEGER) AS yr, CAST(n AS BIGINT) AS n_events FROM {_COUNTS} q""")
def zero_counts(v):
    algos = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    return events.yearly_counts_with_zeros(v.event_daily, v.location, algos, 1994, 2002).withColumnRenamed("year", "yr")


@query("j12_lag_expansion", """
SELECT e.algo, e.loc_id, e.time, CAST(l.lag AS INTEGER) AS lag FROM event_daily e
CROSS JOIN (SELECT 2 AS lag UNION ALL SELECT 4 UNION ALL SELECT 12 UNION ALL SELECT 18) l""")
def lag_expansion(v):
    return events.lagged(v.event_daily, [2, 4, 12, 18]).select("algo", "loc_id", "time", "lag")


@query("j13_replicates", """
SELECT a.pos, a.time, CAST(r.range AS INTEGER) AS replicate FROM axis a CROSS JOIN range(20) r""")
def replicates(v):
    return events.replicated(v.axis, 20)


@query("j14_titles", """
SELECT e.algo, t.title, CAST(t.ordinal AS INTEGER) AS ordinal, CAST(count(*) AS BIGINT) AS n_events FROM event_daily e
JOIN (SELECT '1-URGENT' AS algo, 'Urgent' AS title, 1 AS ordinal UNION ALL SELECT '2-HIGH', 'High', 2
 UNION ALL SELECT '3-MEDIUM', 'Medium', 3 UNION ALL SELECT '4-NOT SPECIFIED', 'Unset', 4 UNION ALL SELECT '5-LOW', 'Low', 5) t ON t.algo=e.algo
GROUP BY 1, 2, 3""")
def titles(v):
    return with_titles(v.event_daily, TITLES).groupBy("algo", "title", "ordinal").agg(
        F.count(F.lit(1)).alias("n_events"))
