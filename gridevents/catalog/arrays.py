"""Arrays, maps and pivots."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridevents.catalog.registry import query, r6, s6
from gridevents.operators import events
from gridevents.operators.boxjoin import join_event_boxes
from gridevents.operators.axes import relative_positions
from gridevents.operators.features import Window, feature_arrays
from gridevents.plans.composites import prepare_field, with_centres

WINDOW = Window(2, 3.75, 0.5, 0.625)
ALGOS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def windows_at_500(v):
    """T and Q at 500 around every event, labelled by grid position."""
    field = prepare_field(v.field.where(F.col("variable").isin("T", "Q")), levels=[500])
    matched = with_centres(v.event_daily.withColumnRenamed("time", "matched_time"), v.location)
    boxes = join_event_boxes(field, matched, WINDOW.half_lat, WINDOW.half_lon)
    return relative_positions(boxes, field.select("lat", "lon"), WINDOW.half_lat, WINDOW.half_lon)


FEATURES_SQL = """(SELECT e.algo, e.loc_id, e.time AS matched_time,
 ((x.pos - (SELECT min(pos) FROM loncoord q WHERE q.lon >= c.centre_lon-3.75))*9
  + (y.pos - (SELECT min(pos) FROM latcoord q WHERE q.lat >= c.centre_lat-2)))*2
  + CASE WHEN f.variable='T' THEN 0 ELSE 1 END AS i, f.value
FROM event_daily e JOIN centre c ON c.loc_id=e.loc_id JOIN wfield f ON f.time=e.time AND f.variable IN ('T','Q') AND f.level=500
  AND f.lat BETWEEN c.centre_lat-2 AND c.centre_lat+2 AND f.lon BETWEEN c.centre_lon-3.75 AND c.centre_lon+3.75
JOIN loncoord x ON x.lon=f.lon JOIN latcoord y ON y.lat=f.lat)"""


@query("r01_feature_vectors", f"""
SELECT algo, loc_id, matched_time, CAST(234 AS INTEGER) AS n_features, CAST(count(CASE WHEN value<>0 THEN 1 END) AS INTEGER) AS n_nonzero,
  {s6('sum(value*(i+1))')} AS checksum FROM {FEATURES_SQL} q GROUP BY 1,2,3""")
def feature_vectors(v):
    arrays = feature_arrays(windows_at_500(v), ["algo", "loc_id", "matched_time"], WINDOW, ["T", "Q"], "value")
    weighted = F.transform("features", lambda x, i: x * (i + 1))
    return arrays.select("algo", "loc_id", "matched_time", F.size("features").alias("n_features"),
                         F.size(F.filter("features", lambda x: x != 0)).alias("n_nonzero"),
                         r6(F.aggregate(weighted, F.lit(0.0), lambda a, x: a + x), "checksum"))


@query("r02_row_concat", """
SELECT 'daily' AS source, algo, time FROM event_daily UNION ALL SELECT 'hourly', algo, time FROM event_hourly""")
def row_concat(v):
    return v.event_daily.select(F.lit("daily").alias("source"), "algo", "time").unionByName(
        v.event_hourly.select(F.lit("hourly").alias("source"), "algo", "time"))


@query("r03_lookup_maps", """
SELECT algo, loc_id, CAST(count(*) AS INTEGER) AS n_years,
  CAST(max(CASE WHEN yr=1998 THEN n END) AS BIGINT) AS n_1998 FROM (
 SELECT algo, loc_id, year(time) AS yr, count(*) AS n FROM event_daily GROUP BY 1,2,3) q GROUP BY 1,2""")
def lookup_maps(v):
    maps = events.lookup_map(events.yearly_counts(v.event_daily), F.col("year"), F.col("n_events"), ["algo", "loc_id"])
    return maps.select("algo", "loc_id", F.size("entries").alias("n_years"),
                       F.try_element_at("entries", F.lit(1998)).alias("n_1998"))


@query("r04_timeline", """
SELECT loc_id, time, max(CASE WHEN algo='1-URGENT' THEN cluster END) AS urgent, max(CASE WHEN algo='2-HIGH' THEN cluster END) AS high,
  max(CASE WHEN algo='3-MEDIUM' THEN cluster END) AS medium, max(CASE WHEN algo='4-NOT SPECIFIED' THEN cluster END) AS unset,
  max(CASE WHEN algo='5-LOW' THEN cluster END) AS low FROM event_daily GROUP BY loc_id, time""")
def timeline(v):
    return events.timeline(v.event_daily, ALGOS).withColumnsRenamed(
        dict(zip(ALGOS, ["urgent", "high", "medium", "unset", "low"])))
