"""Sorts, limits and top-k."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridevents.catalog.registry import query, r6, s6
from gridevents.operators import axes, filters
from gridevents.operators.ordering import coordinate_index, running_position


@query("o01_longitude_order", """
SELECT (lon+180)%360-180 AS lon, CAST(row_number() OVER (ORDER BY (lon+180)%360-180)-1 AS BIGINT) AS pos
FROM (SELECT DISTINCT lon FROM field) d""")
def longitude_order(v):
    return coordinate_index(axes.canonical_longitude(v.field), "lon")


@query("o02_time_order", """
SELECT algo, loc_id, time, CAST(row_number() OVER (PARTITION BY algo ORDER BY time, loc_id)-1 AS BIGINT) AS pos FROM event_hourly""")
def time_order(v):
    dated = v.event_hourly.withColumn("_day", F.to_date("time"))
    return running_position(dated, ["algo"], ["_day"], ["time", "loc_id"]).select("algo", "loc_id", "time", "pos")


@query("o03_sorted_distinct", "SELECT DISTINCT time FROM event_hourly ORDER BY time")
def sorted_distinct(v):
    return axes.sorted_distinct(v.event_hourly, "time")


@query("o04_best_k", f"""
SELECT CAST(l_linenumber AS INTEGER) AS k, {s6('avg(l_quantity)')} AS score FROM lineitem GROUP BY 1 ORDER BY avg(l_quantity) DESC, 1 LIMIT 1""")
def best_k(v):
    scores = v.table("lineitem").groupBy(F.col("l_linenumber").alias("k")).agg(F.avg("l_quantity").alias("score"))
    return axes.best_k(scores).select("k", r6("score"))


@query("o05_first_places", "SELECT loc_id, lat, lon FROM location ORDER BY loc_id LIMIT 3")
def first_places(v):
    return axes.first_places(v.location, 3)


@query("o06_dimension_order", """
SELECT time, level, lat, lon, variable, value FROM field WHERE variable='T'""")
def dimension_order(v):
    return axes.dimension_order(v.field.where("variable = 'T'"), ["time", "level", "lat", "lon"])


@query("o07_source_order", """
SELECT loc_id, time, min(src) AS source_rank, min_by(price, src) AS price FROM (
 SELECT o_custkey%12 AS loc_id, o_orderdate AS time, o_orderpriority AS src, min(o_totalprice) AS price FROM orders GROUP BY 1,2,3) q
GROUP BY loc_id, time""")
def source_order(v):
    per_source = v.table("orders").groupBy(
        (F.col("o_custkey") % 12).alias("loc_id"), F.col("o_orderdate").alias("time"),
        F.col("o_orderpriority").alias("source_rank")).agg(F.min("o_totalprice").alias("price"))
    return filters.keep_first(per_source, ["loc_id", "time"], "source_rank")
