"""Set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridevents.catalog.registry import query, r6, s6
from gridevents.functions import physics
from gridevents.functions.text import stamps_in
from gridevents.functions.times import parse_stamp
from gridevents.operators import consensus, events
from gridevents.operators.align import wide
from gridevents.operators.joins import lookup_join
from gridevents.plans.clustering import positioned_events
from gridevents.operators.stats import batched_z_score
from gridevents.sinks.listings import yearly_list_lines


@query("u01_concat_time", """
SELECT algo, loc_id, time, cluster FROM event_daily UNION ALL SELECT algo, loc_id, time, cluster FROM event_hourly""")
def concat_time(v):
    return v.event_daily.unionByName(v.event_hourly)


@query("u02_concat_level", f"""
SELECT level, CAST(count(*) AS BIGINT) AS n_rows, {s6('avg(value*power(1000/level, 2.0/7.0))')} AS mean_theta FROM field
WHERE variable='T' GROUP BY level""")
def concat_level(v):
    theta = physics.potential_temperature(F.col("T"), F.col("level"))
    return wide(v.field, ["T"]).groupBy("level").agg(F.count(F.lit(1)).alias("n_rows"), r6(F.avg(theta), "mean_theta"))


@query("u03_pooled_scaling", f"""
SELECT algo, loc_id, time, {s6('coalesce((cluster-m)/nullif(s,0),0)')} AS z FROM (
 SELECT *, avg(cluster) OVER w AS m, stddev_pop(cluster) OVER w AS s FROM (
  SELECT *, least(floor(p/(n//5)), 4) AS block FROM (
   SELECT *, row_number() OVER (PARTITION BY algo ORDER BY year(time), loc_id, time)-1 AS p, count(*) OVER (PARTITION BY algo) AS n
   FROM event_daily) a) b WINDOW w AS (PARTITION BY algo, block)) c""")
def pooled_scaling(v):
    placed = positioned_events(v.event_daily).withColumn("value", F.col("cluster").cast("double"))
    return batched_z_score(placed, [], 5, ["algo"]).select("algo", "loc_id", "time", r6("z"))


@query("u04_timeline_axis", "SELECT DISTINCT time FROM event_daily")
def timeline_axis(v):
    return events.timeline_axis(v.event_daily)


@query("u05_flatten", """
SELECT algo, time FROM event_daily""")
def flatten(v):
    lists = yearly_list_lines(v.event_daily).select("algo", F.explode(stamps_in(F.col("value"))).alias("stamp"))
    return lists.select("algo", parse_stamp(F.col("stamp")).alias("time"))


@query("u06_shared_events", """
SELECT time, lon, lat FROM event_pt INTERSECT
SELECT e.time, l.lon, l.lat FROM event_daily e JOIN location l ON l.loc_id=e.loc_id""")
def shared(v):
    placed = lookup_join(v.event_daily, v.location, ["loc_id"], ["algo", "time"])
    return consensus.shared_events(v.event_pt, placed)


@query("u06_consensus_times", """
SELECT loc_id, time FROM event_daily GROUP BY 1, 2 HAVING count(DISTINCT algo) >= 3 AND count(DISTINCT algo) < 4""")
def consensus_times(v):
    return consensus.consensus_times(v.event_daily, 3, ["loc_id", "time"])
