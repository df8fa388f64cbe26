"""The sample tables seen as cubes, masks, places and events.

``Views`` gives them as DataFrames; ``SQL`` states the same views for the check.
The DataFrame side is not a rendering of the SQL: duplicates are folded by a
partial aggregate and variables come from one pass over the cells.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridevents.functions.times import hour_key
from gridevents.operators.filters import keep_first
from gridevents.operators.ordering import axis_positions, strided
from gridevents.session import fresh_path, written
from gridevents.sinks.tables import write_cube


class Views:
    """Lazily built views of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def built(self) -> Views:
        """The same views over cells that are built once and written, for queries that read the cube several times."""
        views = Views(self.spark, self.folder)
        views.cell = written(self.cell, "cells")
        return views

    @cached_property
    def cell(self) -> DataFrame:
        levels = F.array(*[F.lit(v) for v in (250.0, 300.0, 500.0, 700.0, 850.0, 925.0)])
        rank = ["l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_partkey", "l_suppkey"]
        rows = self.table("lineitem").select(
            F.col("l_shipdate").alias("time"),
            levels[(F.col("l_linenumber") - 1) % 6].alias("level"),
            (F.lit(20.0) + F.lit(0.5) * (F.col("l_suppkey") % 20)).alias("lat"),
            (F.lit(225.0) + F.lit(0.625) * (F.col("l_partkey") % 32)).alias("lon"),
            *rank, "l_discount", "l_returnflag")
        first = keep_first(rows, ["time", "level", "lat", "lon"], rank)
        return first.select("time", "level", "lat", "lon", F.col("l_quantity").alias("qty"),
                            F.col("l_discount").alias("disc"), F.col("l_extendedprice").alias("price"),
                            F.col("l_returnflag").alias("rflag"))

    @cached_property
    def field(self) -> DataFrame:
        def entry(name, value):
            return F.struct(F.lit(name).alias("variable"), value.alias("value"))

        entries = F.array(entry("T", F.lit(220.0) + F.col("qty")), entry("Q", F.col("disc") / 10),
                          entry("Z", F.col("price")))
        return self.cell.select("time", "level", "lat", "lon", F.inline(entries)).select(
            "variable", "time", "level", "lat", "lon", "value")

    @cached_property
    def surface(self) -> DataFrame:
        """A variable without levels."""
        cells = self.table("orders").groupBy(
            F.col("o_orderdate").alias("time"), (F.lit(20.0) + F.lit(0.5) * (F.col("o_custkey") % 20)).alias("lat"),
            (F.lit(225.0) + F.lit(0.625) * (F.col("o_custkey") % 32)).alias("lon")).agg(F.min("o_totalprice").alias("value"))
        return cells.select(F.lit("SLP").alias("variable"), "time", F.lit(None).cast("double").alias("level"), "lat", "lon", "value")

    @cached_property
    def stored(self) -> str:
        """The cube as stored files, by variable, year and month."""
        path = fresh_path(self.spark, "cube")
        write_cube(self.field, path)
        return path

    @cached_property
    def mask(self) -> DataFrame:
        def tag(*flags):
            return F.max(F.when(F.col("rflag").isin(*flags), 1.0).otherwise(0.0))

        both = self.cell.groupBy("time", "lat", "lon").agg(tag("R", "A").alias("loose"), tag("R").alias("strict"))
        entries = F.array(*[F.struct(F.lit(a).alias("algo"), F.col(a).alias("tag")) for a in ("loose", "strict")])
        return both.select("time", "lat", "lon", F.inline(entries)).select("algo", "time", "lat", "lon", "tag")

    @cached_property
    def location(self) -> DataFrame:
        place = F.col("o_custkey") % 12
        return self.table("orders").select(place.alias("loc_id")).distinct().select(
            "loc_id", (F.lit(21.0) + F.lit(0.5) * F.col("loc_id")).alias("lat"),
            (F.lit(227.5) + F.lit(1.25) * F.col("loc_id")).alias("lon"))

    @cached_property
    def event_daily(self) -> DataFrame:
        done = F.when(F.col("o_orderstatus") == "F", 0).otherwise(1)
        return self.table("orders").groupBy(
            F.col("o_orderpriority").alias("algo"), (F.col("o_custkey") % 12).alias("loc_id"),
            F.col("o_orderdate").alias("time")).agg(F.max(done).alias("cluster"))

    @cached_property
    def event_hourly(self) -> DataFrame:
        high = F.when(F.col("value") > 50, 1).otherwise(0)
        return self.table("events").groupBy(
            F.col("event_type").alias("algo"), (F.col("user_id") % 12).alias("loc_id"),
            hour_key(F.col("ts")).alias("time")).agg(F.max(high).alias("cluster"))

    @cached_property
    def axis(self) -> DataFrame:
        return axis_positions(self.table("lineitem").select(F.col("l_shipdate").alias("time")))

    @cached_property
    def axis4(self) -> DataFrame:
        return strided(self.axis, 4).withColumn("pos", F.floor(F.col("pos") / 4).cast("long"))

    @cached_property
    def event_pt(self) -> DataFrame:
        return self.table("orders").select(
            F.col("o_orderkey").alias("event_id"), F.col("o_orderdate").alias("time"),
            (F.lit(227.5) + F.lit(1.25) * (F.col("o_custkey") % 12)).alias("lon"),
            (F.lit(21.0) + F.lit(0.5) * (F.col("o_custkey") % 16)).alias("lat"))

    @cached_property
    def climatology(self) -> DataFrame:
        means = self.field.groupBy("variable", F.month("time").alias("mon"), "level", "lat", "lon").agg(
            F.avg("value").alias("value"))
        return means.withColumn("bnds", F.explode(F.array(F.lit(0), F.lit(1))))

    @cached_property
    def vectors(self) -> DataFrame:
        doubles = F.transform("embedding", lambda x: x.cast("double"))
        return self.table("embeddings").select("vec_id", "label", doubles.alias("features"))


SQL = {
    "cell": """SELECT time, level, lat, lon, qty, disc, price, rflag FROM (
  SELECT l_shipdate AS time,
    CASE (l_linenumber-1)%6 WHEN 0 THEN CAST(250 AS DOUBLE) WHEN 1 THEN CAST(300 AS DOUBLE)
      WHEN 2 THEN CAST(500 AS DOUBLE) WHEN 3 THEN CAST(700 AS DOUBLE) WHEN 4 THEN CAST(850 AS DOUBLE)
      ELSE CAST(925 AS DOUBLE) END AS level,
    CAST(20 AS DOUBLE) + CAST(0.5 AS DOUBLE)*(l_suppkey%20) AS lat,
    CAST(225 AS DOUBLE) + CAST(0.625 AS DOUBLE)*(l_partkey%32) AS lon,
    l_quantity AS qty, l_discount AS disc, l_extendedprice AS price, l_returnflag AS rflag,
    row_number() OVER (PARTITION BY l_shipdate, l_suppkey%20, l_partkey%32, (l_linenumber-1)%6
      ORDER BY l_orderkey, l_linenumber, l_extendedprice, l_quantity, l_partkey, l_suppkey) AS rn
  FROM lineitem) q WHERE rn = 1""",
    "field": """SELECT 'T' AS variable, time, level, lat, lon, CAST(220 AS DOUBLE)+qty AS value FROM cell
UNION ALL SELECT 'Q', time, level, lat, lon, disc/10 FROM cell
UNION ALL SELECT 'Z', time, level, lat, lon, price FROM cell""",
    "surface": """SELECT 'SLP' AS variable, time, CAST(NULL AS DOUBLE) AS level, lat, (lon+180)%360-180 AS lon, value FROM (
  SELECT o_orderdate AS time, CAST(20 AS DOUBLE)+CAST(0.5 AS DOUBLE)*(o_custkey%20) AS lat,
    CAST(225 AS DOUBLE)+CAST(0.625 AS DOUBLE)*(o_custkey%32) AS lon, min(o_totalprice) AS value FROM orders GROUP BY 1, 2, 3) q""",
    "mask": """SELECT 'loose' AS algo, time, lat, lon,
  max(CASE WHEN rflag IN ('R','A') THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS tag
FROM cell GROUP BY time, lat, lon
UNION ALL SELECT 'strict', time, lat, lon,
  max(CASE WHEN rflag = 'R' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) FROM cell GROUP BY time, lat, lon""",
    "location": """SELECT DISTINCT o_custkey%12 AS loc_id, CAST(21 AS DOUBLE)+CAST(0.5 AS DOUBLE)*(o_custkey%12) AS lat,
  CAST(227.5 AS DOUBLE)+CAST(1.25 AS DOUBLE)*(o_custkey%12) AS lon FROM orders""",
    "event_daily": """SELECT o_orderpriority AS algo, o_custkey%12 AS loc_id, o_orderdate AS time,
  max(CASE WHEN o_orderstatus='F' THEN 0 ELSE 1 END) AS cluster
FROM orders GROUP BY o_orderpriority, o_custkey%12, o_orderdate""",
    "event_hourly": """SELECT event_type AS algo, user_id%12 AS loc_id, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS time,
  max(CASE WHEN value>50 THEN 1 ELSE 0 END) AS cluster
FROM events GROUP BY event_type, user_id%12, date_trunc('hour', ts)""",
    "axis": """SELECT time, CAST(row_number() OVER (ORDER BY time) - 1 AS BIGINT) AS pos
FROM (SELECT DISTINCT time FROM cell) d""",
    "axis4": """SELECT time, CAST(row_number() OVER (ORDER BY time) - 1 AS BIGINT) AS pos FROM axis WHERE pos % 4 = 0""",
    "event_pt": """SELECT CAST(o_orderkey AS BIGINT) AS event_id, o_orderdate AS time,
  CAST(227.5 AS DOUBLE)+CAST(1.25 AS DOUBLE)*(o_custkey%12) AS lon,
  CAST(21 AS DOUBLE)+CAST(0.5 AS DOUBLE)*(o_custkey%16) AS lat FROM orders""",
    "climatology": """SELECT variable, month(time) AS mon, level, lat, lon, b.bnds, avg(value) AS value
FROM field CROSS JOIN (SELECT 0 AS bnds UNION ALL SELECT 1) b
GROUP BY variable, month(time), level, lat, lon, b.bnds""",
    # steps that several checks share
    "wfield": """SELECT variable, time, level, lat, (lon+180)%360-180 AS lon, value FROM field""",
    "centre": """SELECT loc_id, lat AS centre_lat, (lon+180)%360-180 AS centre_lon FROM location""",
    "numbered": """SELECT *, CAST(row_number() OVER (PARTITION BY algo, year(time) ORDER BY loc_id, time) - 1 AS BIGINT) AS ordinal
FROM event_daily""",
    "nearmap": """SELECT time, CASE WHEN p IS NULL THEN n WHEN n IS NULL THEN p WHEN n-time <= time-p THEN n ELSE p END AS matched_time
FROM (SELECT e.time, max(CASE WHEN a.time<=e.time THEN a.time END) AS p, min(CASE WHEN a.time>=e.time THEN a.time END) AS n
  FROM (SELECT DISTINCT time FROM event_daily) e JOIN axis a ON year(a.time)=year(e.time) GROUP BY e.time) q""",
    "nearmap4": """SELECT time, CASE WHEN p IS NULL THEN n WHEN n IS NULL THEN p WHEN n-time <= time-p THEN n ELSE p END AS matched_time
FROM (SELECT e.time, max(CASE WHEN a.time<=e.time THEN a.time END) AS p, min(CASE WHEN a.time>=e.time THEN a.time END) AS n
  FROM (SELECT DISTINCT time FROM event_daily) e JOIN axis4 a ON year(a.time)=year(e.time) GROUP BY e.time) q""",
    "yaxis": """SELECT time, year(time) AS y, row_number() OVER (PARTITION BY year(time) ORDER BY time)-1 AS pos,
  count(*) OVER (PARTITION BY year(time)) AS n FROM axis""",
    "lagmap": """SELECT p.time, p.lag, a.time AS matched_time FROM (
  SELECT e.time, l.lag, count(CASE WHEN a.time < e.time THEN 1 END) AS idx, max(a.n) AS n
  FROM (SELECT DISTINCT o_orderdate AS time FROM orders) e JOIN yaxis a ON a.y=year(e.time)
  CROSS JOIN (SELECT 2 AS lag UNION ALL SELECT 4) l GROUP BY e.time, l.lag) p
JOIN yaxis a ON a.y=year(p.time) AND a.pos = greatest(0, least(p.idx-p.lag, p.n-p.lag))""",
    "loncoord": """SELECT lon, row_number() OVER (ORDER BY lon)-1 AS pos FROM (SELECT DISTINCT lon FROM wfield) d""",
    "latcoord": """SELECT lat, row_number() OVER (ORDER BY lat)-1 AS pos FROM (SELECT DISTINCT lat FROM wfield) d""",
}

_ORDER = list(SQL)


def _needed(text: str) -> set[str]:
    words = set(re.findall(r"[a-z_0-9]+", text))
    found: set[str] = set()
    for name in _ORDER:
        if name in words:
            found |= {name} | _needed_before(name)
    return found


def _needed_before(name: str) -> set[str]:
    earlier = _ORDER[:_ORDER.index(name)]
    words = set(re.findall(r"[a-z_0-9]+", SQL[name]))
    found: set[str] = set()
    for other in earlier:
        if other in words:
            found |= {other} | _needed_before(other)
    return found


def with_views(body: str) -> str:
    """``body`` preceded by the views it names."""
    text = body.strip()
    views = ", ".join(f"{n} AS MATERIALIZED ({SQL[n]})" for n in _ORDER if n in _needed(text))
    if not views:
        return text
    return f"WITH {views}, {text[5:]}" if text.upper().startswith("WITH ") else f"WITH {views} {text}"
