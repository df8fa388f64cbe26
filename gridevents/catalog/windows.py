"""Window-type operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridevents.catalog.registry import query, r6, s6
from gridevents.operators import axes, blocks, events, filters, grid, stats
from gridevents.operators.boxjoin import join_event_boxes
from gridevents.operators.joins import lookup_join
from gridevents.operators.ordering import axis_positions, event_ordinals
from gridevents.plans.composites import prepare_field, with_centres


@query("w01_keep_first", """
SELECT time, level, lat, lon, qty, rflag FROM cell""")
def keep_first(v):
    return v.cell.select("time", "level", "lat", "lon", "qty", "rflag")


@query("w02_axis_positions", """
SELECT CAST(year(time) AS INTEGER) AS yr, time, CAST(row_number() OVER (PARTITION BY year(time) ORDER BY time)-1 AS BIGINT) AS pos FROM axis""")
def positions(v):
    times = v.table("lineitem").select(F.year("l_shipdate").alias("yr"), F.col("l_shipdate").alias("time"))
    return axis_positions(times, ["yr"])


@query("w03_event_ordinals", """
SELECT algo, loc_id, time, cluster, ordinal FROM numbered""")
def ordinals(v):
    return event_ordinals(v.event_daily).select("algo", "loc_id", "time", "cluster", "ordinal")


@query("w03_ordinals_with_copies", """
SELECT CAST(row_number() OVER (PARTITION BY o_orderpriority, year(o_orderdate) ORDER BY o_custkey%12, o_orderdate)-1 AS BIGINT) AS ordinal,
  o_orderpriority AS algo, o_custkey%12 AS loc_id, o_orderdate AS time FROM orders""")
def ordinals_with_copies(v):
    listed = v.table("orders").select(F.col("o_orderpriority").alias("algo"), (F.col("o_custkey") % 12).alias("loc_id"),
                                      F.col("o_orderdate").alias("time"))
    return event_ordinals(listed).select("ordinal", "algo", "loc_id", "time")


@query("w04_synthetic_stamps", """
SELECT algo, loc_id, time, make_timestamp(year(time),1,1,0,0,0) + to_hours(ordinal) AS synthetic_time FROM numbered""")
def synthetic(v):
    numbered = event_ordinals(v.event_daily)
    return numbered.select("algo", "loc_id", "time",
                           events.synthetic_stamp(F.col("year"), F.col("ordinal")).alias("synthetic_time"))


_AT = """numbered e JOIN centre c ON c.loc_id=e.loc_id JOIN wfield f ON f.time=e.time AND f.variable='T'
  AND f.lat BETWEEN c.centre_lat-2 AND c.centre_lat+2 AND f.lon BETWEEN c.centre_lon-4 AND c.centre_lon+4"""


def _windows(v):
    matched = with_centres(v.event_daily.withColumnRenamed("time", "matched_time"), v.location)
    return join_event_boxes(prepare_field(v.field, "T"), matched, 2, 4)


@query("w05_relative_offsets", f"""
SELECT e.algo, e.loc_id, e.time AS matched_time, f.level, f.lat - c.centre_lat + 0.5 AS rel_lat, f.lon - c.centre_lon AS rel_lon,
  f.value FROM {_AT}""")
def offsets(v):
    out = axes.relative_offsets(_windows(v), lat_shift=0.5)
    return out.select("algo", "loc_id", "matched_time", "level", "rel_lat", "rel_lon", "value")


@query("w05_relative_positions", f"""
SELECT e.algo, e.loc_id, e.time AS matched_time, f.level,
  -2.0 + 0.5*(y.pos - (SELECT min(pos) FROM latcoord q WHERE q.lat >= c.centre_lat-2)) AS rel_lat,
  -4.0 + 0.625*(x.pos - (SELECT min(pos) FROM loncoord q WHERE q.lon >= c.centre_lon-4)) AS rel_lon, f.value
FROM {_AT} JOIN loncoord x ON x.lon=f.lon JOIN latcoord y ON y.lat=f.lat""")
def rel_positions(v):
    field = prepare_field(v.field, "T")
    out = axes.relative_positions(_windows(v), field.select("lat", "lon"), 2, 4)
    return out.select("algo", "loc_id", "matched_time", "level", "rel_lat", "rel_lon", "value")


_Z = """SELECT variable, time, level, lat, lon, {z} AS z FROM (
  SELECT f.*, avg(value) OVER w AS m, stddev_pop(value) OVER w AS s FROM (
    SELECT f.*, least(floor(a.pos/(n.n//{k})), {k}-1) AS block FROM field f JOIN axis a ON a.time=f.time
    CROSS JOIN (SELECT count(*) AS n FROM axis) n) f
  WINDOW w AS (PARTITION BY variable, level, lat, lon, block)) q"""


def _positioned(v):
    sized = v.axis.withColumn("n_rows", v.axis.agg(F.count(F.lit(1))).scalar())
    return lookup_join(v.field, sized, ["time"], ["lat", "lon"])


_SCORE = s6("coalesce((value-m)/nullif(s,0),0)")


@query("w06_batched_zscore", _Z.format(z=_SCORE, k=55))
def batched(v):
    out = stats.batched_z_score(_positioned(v), ["variable", "level", "lat", "lon"], 55)
    return out.select("variable", "time", "level", "lat", "lon", r6("z"))


@query("w07_whole_zscore", _Z.format(z=_SCORE, k=1))
def whole(v):
    out = stats.whole_z_score(_positioned(v), ["variable", "level", "lat", "lon"])
    return out.select("variable", "time", "level", "lat", "lon", r6("z"))


def _slope(order, line):
    return f"""SELECT variable, time, level, lat, lon, {s6('g')} AS gradient FROM (
 SELECT *, CASE WHEN lag(value) OVER w IS NULL THEN lead(value) OVER w - value
   WHEN lead(value) OVER w IS NULL THEN value - lag(value) OVER w
   ELSE (lead(value) OVER w - lag(value) OVER w)/2 END AS g
 FROM field WINDOW w AS (PARTITION BY variable, time, level, {line} ORDER BY {order})) q"""


@query("w08_gradient_lat", _slope("lat", "lon"))
def gradient_lat(v):
    out = grid.gradient(v.field, "lat", ["variable", "time", "level", "lon"])
    return out.select("variable", "time", "level", "lat", "lon", r6("gradient"))


@query("w08_gradient_lon", _slope("lon", "lat"))
def gradient_lon(v):
    out = grid.gradient(v.field, "lon", ["variable", "time", "level", "lat"])
    return out.select("variable", "time", "level", "lat", "lon", r6("gradient"))


@query("w09_time_deviation", f"""
SELECT variable, time, level, lat, lon, {s6('value - avg(value) OVER (PARTITION BY variable, level, lat, lon)')} AS deviation FROM field""")
def deviation(v):
    return stats.time_deviation(v.field).select("variable", "time", "level", "lat", "lon", r6("deviation"))


_CHUNKS = """(SELECT f.*, floor(a.pos/6) AS ct, floor(l.pos/2) AS cl FROM field f JOIN axis a ON a.time=f.time
 JOIN (SELECT level, row_number() OVER (ORDER BY level)-1 AS pos FROM (SELECT DISTINCT level FROM field) d) l ON l.level=f.level)"""


@query("w10_chunks", f"""
SELECT variable, time, level, lat, lon, CAST(ct AS BIGINT) AS chunk_time, CAST(cl AS BIGINT) AS chunk_level FROM {_CHUNKS} q
WHERE variable='T'""")
def chunks(v):
    out = blocks.with_chunks(v.field, {"time": 6, "level": 2}).where("variable = 'T'")
    return out.select("variable", "time", "level", "lat", "lon", "chunk_time", "chunk_level")


@query("w10_chunk_table", f"""
SELECT CAST(ct AS BIGINT) AS chunk_time, CAST(cl AS BIGINT) AS chunk_level, CAST(n AS BIGINT) AS n_times, first_time, last_time,
  CAST(row_number() OVER o - 1 + 7 AS BIGINT) AS chunk_id,
  CAST(coalesce(sum(n) OVER (ORDER BY ct, cl ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset"
FROM (SELECT ct, cl, count(DISTINCT time) AS n, min(time) AS first_time, max(time) AS last_time FROM {_CHUNKS} q GROUP BY 1,2) b
WINDOW o AS (ORDER BY ct, cl)""")
def chunk_table(v):
    out = blocks.with_chunks(v.field, {"time": 6, "level": 2})
    return blocks.chunk_table(out, ["time", "level"], counter=7)


@query("w11_majority_tags", """
SELECT algo, loc_id, time, cluster, CAST(CASE WHEN ones=zeros THEN cluster
  WHEN (ones>zeros) = (cluster=1) THEN 10 ELSE 20 END AS INTEGER) AS tag
FROM (SELECT *, sum(CASE WHEN cluster=1 THEN 1 ELSE 0 END) OVER (PARTITION BY algo) AS ones,
  sum(CASE WHEN cluster=0 THEN 1 ELSE 0 END) OVER (PARTITION BY algo) AS zeros FROM event_daily) q""")
def majority(v):
    return events.majority_tags(v.event_daily)


@query("w12_thirds", """
SELECT algo, loc_id, time, CAST(CASE WHEN n//3=0 THEN 2 ELSE least(floor(p/(n//3)), 2) END AS INTEGER) AS third FROM (
 SELECT *, row_number() OVER (PARTITION BY algo, year(time) ORDER BY loc_id, time)-1 AS p,
   count(*) OVER (PARTITION BY algo, year(time)) AS n FROM event_daily) q""")
def thirds(v):
    numbered = event_ordinals(v.event_daily, name="pos")
    sized = blocks.with_group_size(numbered, ["algo", "year"], ["loc_id", "time"])
    return blocks.with_third(sized).select("algo", "loc_id", "time", "third")


@query("w13_last_wins", """
SELECT o_custkey%12 AS loc_id, o_orderdate AS time, max_by(o_orderstatus, o_orderkey) AS status, max(o_orderkey) AS o_orderkey
FROM orders GROUP BY 1, 2""")
def last_wins(v):
    rows = v.table("orders").select((F.col("o_custkey") % 12).alias("loc_id"), F.col("o_orderdate").alias("time"),
                                    F.col("o_orderstatus").alias("status"), "o_orderkey")
    return filters.keep_last(rows, ["loc_id", "time"], "o_orderkey")


@query("w14_file_counter", """
SELECT CAST(floor(pos/365) AS BIGINT) AS chunk_time, CAST(floor(pos/365) + 41 AS BIGINT) AS file_number, CAST(count(*) AS BIGINT) AS n_times
FROM axis GROUP BY 1, 2""")
def file_counter(v):
    table = blocks.chunk_table(blocks.with_chunks(v.field, {"time": 365}), ["time"], counter=41)
    return table.select("chunk_time", F.col("chunk_id").alias("file_number"), "n_times")
