"""Whole analyses."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridevents.catalog.arrays import ALGOS, WINDOW
from gridevents.catalog.joining import _COUNTS
from gridevents.catalog.registry import query, r6, s6
from gridevents.operators import climate, consensus, grid, stats
from gridevents.plans import clustering, comparison, composites, detection, energies
from gridevents.session import written
from gridevents.sinks.listings import yearly_list_lines


@query("x01_landfall_events", f"""
SELECT m.algo, l.loc_id, m.time, {s6('avg(m.tag)')} AS box_mean FROM mask m JOIN location l
ON m.lon BETWEEN l.lon AND l.lon+1 AND m.lat BETWEEN l.lat AND l.lat+1 WHERE month(m.time) IN (12,1,2)
GROUP BY m.algo, l.loc_id, m.time HAVING avg(m.tag) >= 0.8""")
def landfall(v):
    return detection.landfall_events(v.mask, v.location).select("algo", "loc_id", "time", r6("box_mean"))


@query("x02_concat_lists", "SELECT algo, loc_id, time FROM event_daily")
def concat_lists(v):
    return detection.concat_event_lists(yearly_list_lines(v.event_daily))


_BOX = """AND f.lat BETWEEN c.centre_lat-2 AND c.centre_lat+2 AND f.lon BETWEEN c.centre_lon-4 AND c.centre_lon+4"""
_COMP = f"""numbered e JOIN nearmap m ON m.time=e.time JOIN centre c ON c.loc_id=e.loc_id
 JOIN wfield f ON f.time=m.matched_time {_BOX}"""


@query("x03_composite_raw", f"""
SELECT e.algo, e.loc_id, e.time AS event_time, m.matched_time, e.ordinal, make_timestamp(year(e.time),1,1,0,0,0) + to_hours(e.ordinal) AS synthetic_time,
  f.variable, f.level, f.lat-c.centre_lat AS rel_lat, f.lon-c.centre_lon AS rel_lon, f.value
FROM {_COMP} AND f.variable='T' AND f.level IN (850,700,500,300,250)""")
def composite_raw(v):
    out = composites.composite_raw(v.field, v.event_daily, v.location, 2, 4, "T", [850, 700, 500, 300, 250], axis=v.axis, unique_events=True)
    return out.select("algo", "loc_id", "event_time", "matched_time", "ordinal", "synthetic_time", "variable", "level",
                      "rel_lat", "rel_lon", "value")


@query("x04_composite_anomaly", f"""
SELECT e.algo, e.loc_id, e.time AS event_time, f.variable, f.level, f.lat-c.centre_lat AS rel_lat, f.lon-c.centre_lon AS rel_lon,
  {s6('f.value-k.cv')} AS value FROM {_COMP} AND f.variable='T'
JOIN (SELECT variable, level, lat, (lon+180)%360-180 AS lon, avg(value) AS cv FROM climatology GROUP BY 1,2,3,4) k
 ON k.variable=f.variable AND k.level=f.level AND k.lat=f.lat AND k.lon=f.lon""")
def composite_anomaly(v):
    clim = climate.mean_climatology(v.climatology)
    out = composites.composite_anomaly(v.field, v.event_daily, v.location, clim, half_lat=2, half_lon=4, variable="T", axis=v.axis, unique_events=True)
    return out.select("algo", "loc_id", "event_time", "variable", "level", "rel_lat", "rel_lon", r6("value"))


_POS = """-2.0 + 0.5*(y.pos - (SELECT min(pos) FROM latcoord q WHERE q.lat >= c.centre_lat-2)) AS rel_lat,
  -4.0 + 0.625*(x.pos - (SELECT min(pos) FROM loncoord q WHERE q.lon >= c.centre_lon-4)) AS rel_lon"""
_COORDS = "JOIN loncoord x ON x.lon=f.lon JOIN latcoord y ON y.lat=f.lat"


@query("x05_composite_native", f"""
SELECT e.algo, e.loc_id, e.time AS event_time, e.ordinal, f.variable, f.level, {_POS}, f.value FROM {_COMP} AND f.variable='Q' {_COORDS}""")
def composite_native(v):
    out = composites.composite_native(v.field, v.event_daily, v.location, half_lat=2, half_lon=4, variable="Q", axis=v.axis, unique_events=True)
    return out.select("algo", "loc_id", "event_time", "ordinal", "variable", "level", "rel_lat", "rel_lon", "value")


@query("x06_composite_lagged", f"""
SELECT e.algo, e.loc_id, e.time AS event_time, CAST(m.lag AS INTEGER) AS lag, m.matched_time, f.variable, f.level, {_POS}, f.value
FROM numbered e JOIN lagmap m ON m.time=e.time JOIN centre c ON c.loc_id=e.loc_id
 JOIN wfield f ON f.time=m.matched_time {_BOX} AND f.variable='Z' {_COORDS}""")
def composite_lagged(v):
    out = composites.composite_lagged(v.field, v.event_daily, v.location, [2, 4], 2, 4, "Z", axis=v.axis, unique_events=True)
    return out.select("algo", "loc_id", "event_time", "lag", "matched_time", "variable", "level", "rel_lat", "rel_lon", "value")


@query("x07_composite_lagged_points", f"""
SELECT e.event_id, CAST(m.lag AS INTEGER) AS lag, f.variable, f.level, f.lat-e.lat AS rel_lat, f.lon-((e.lon+180)%360-180) AS rel_lon,
  {s6('f.value-k.cv')} AS value
FROM event_pt e JOIN lagmap m ON m.time=e.time AND m.lag=4
 JOIN wfield f ON f.time=m.matched_time AND f.variable='T' AND f.lat BETWEEN e.lat-2 AND e.lat+2
  AND f.lon BETWEEN (e.lon+180)%360-180-4 AND (e.lon+180)%360-180+4
 JOIN (SELECT variable, level, lat, (lon+180)%360-180 AS lon, avg(value) AS cv FROM climatology GROUP BY 1,2,3,4) k
 ON k.variable=f.variable AND k.level=f.level AND k.lat=f.lat AND k.lon=f.lon""")
def composite_points(v):
    v = v.built()  # for the climatology, the count of cells and the windows
    clim = climate.mean_climatology(v.climatology)
    out = composites.composite_lagged_points(v.field, v.event_pt, clim, [4], 2, 4, "T", axis=v.axis)
    return out.select("event_id", "lag", "variable", "level", "rel_lat", "rel_lon", r6("value"))


@query("x08_lagged_region", """
SELECT e.algo, e.loc_id, e.time AS event_time, CAST(m.lag AS INTEGER) AS lag, m.matched_time, f.level, f.lat, f.lon, f.value
FROM event_daily e JOIN lagmap m ON m.time=e.time JOIN wfield f ON f.time=m.matched_time
WHERE f.variable='T' AND f.lat BETWEEN 22 AND 25 AND f.lon BETWEEN -130 AND -125""")
def lagged_region(v):
    out = composites.lagged_region_extract(v.field.where("variable = 'T'"), v.event_daily, [2, 4], (25, 22), (-130, -125), v.axis)
    return out.select("algo", "loc_id", "event_time", "lag", "matched_time", "level", "lat", "lon", "value")


def _native_windows(v, events):
    """Positional windows of T and Q at 500 around the positioned events.

    The sample cube is sparse (about one cell per window), so the clustering
    queries scale in few blocks: small blocks would hold single values.
    Its cells at 500 are built once: the windows and both axes of the grid are read from them.
    """
    field = written(composites.prepare_field(v.field.where(F.col("variable").isin("T", "Q")), levels=[500]), "cells")
    matched = composites.with_centres(events, v.location).withColumn("time", F.col("event_time"))
    matched = written(composites.asof_nearest(matched, v.axis).drop("time"), "matched")
    few = composites.few_boxes(events)
    boxes = composites.join_event_boxes(field, matched, WINDOW.half_lat, WINDOW.half_lon, few=few)
    return composites.relative_positions(boxes, field.select("lat", "lon"), WINDOW.half_lat, WINDOW.half_lon)


def _labelled_events(v, algorithm, splits):
    positioned = clustering.positioned_events(written(v.event_daily, "events"), unique=True)
    events = written(positioned.withColumnRenamed("time", "event_time"), "positioned")  # mapped, joined, and asked for at the end
    return clustering.cluster_events(_native_windows(v, events), algorithm, WINDOW, splits, "T", 500, "Q", 500, events=events)


@query("x09_cluster_events")
def cluster_events(v):
    return _labelled_events(v, "1-URGENT", 2)


@query("x09_one_label_per_event", """
SELECT CAST(count(*) AS BIGINT) AS n_events, CAST(count(*) AS BIGINT) AS n_rows, true AS k_in_range FROM event_daily WHERE algo='1-URGENT'""")
def one_label_per_event(v):
    labels = _labelled_events(v, "1-URGENT", 2)
    inside = F.col("k").between(2, 9) & F.col("cluster").between(0, F.col("k") - 1)
    return labels.agg(F.count_distinct("loc_id", "event_time").alias("n_events"), F.count(F.lit(1)).alias("n_rows"),
                      F.bool_and(inside).alias("k_in_range"))


@query("x10_cluster_pooled")
def cluster_pooled(v):
    return _labelled_events(v, None, 5)


@query("x10_one_label_per_event", """
SELECT CAST(count(*) AS BIGINT) AS n_events, CAST(count(*) AS BIGINT) AS n_rows, CAST(count(DISTINCT algo) AS BIGINT) AS n_algos,
  CAST(1 AS BIGINT) AS n_k, true AS k_in_range FROM event_daily""")
def one_pooled_label_per_event(v):
    """The pooled clustering labels every event of every algorithm once, with one k for all."""
    labels = _labelled_events(v, None, 5)
    inside = F.col("k").between(2, 9) & F.col("cluster").between(0, F.col("k") - 1)
    return labels.agg(F.count_distinct("algo", "loc_id", "event_time").alias("n_events"), F.count(F.lit(1)).alias("n_rows"),
                      F.count_distinct("algo").alias("n_algos"), F.count_distinct("k").alias("n_k"), F.bool_and(inside).alias("k_in_range"))


@query("x11_cluster_averages", f"""
SELECT algo, cluster, variable, level, rel_lat, rel_lon, {s6('mv')} AS mean_value,
  {s6('2*(mv-min(mv) OVER w)/nullif(max(mv) OVER w-min(mv) OVER w,0)-1')} AS norm_value FROM (
 SELECT e.algo, e.cluster, f.variable, f.level, f.lat-c.centre_lat AS rel_lat, f.lon-c.centre_lon AS rel_lon, avg(f.value) AS mv
 FROM {_COMP} AND f.level IN (925,850,700,500,300,250) GROUP BY 1,2,3,4,5,6) q
WINDOW w AS (PARTITION BY algo, cluster, variable, level)""")
def cluster_averages(v):
    comp = composites.composite_raw(v.field, v.event_daily, v.location, 2, 4, axis=v.axis, unique_events=True)
    out = clustering.cluster_averages(comp, [925, 850, 700, 500, 300, 250])
    return out.select("algo", "cluster", "variable", "level", "rel_lat", "rel_lon", r6("mean_value"), r6("norm_value"))


_SURFACE = f"""numbered e JOIN nearmap m ON m.time=e.time JOIN centre c ON c.loc_id=e.loc_id
 JOIN surface f ON f.time=m.matched_time {_BOX}"""


def _surface_windows(v):
    return composites.composite_raw(v.surface, v.event_daily, v.location, 2, 4, axis=v.axis, unique_events=True)


@query("x03_surface", f"""
SELECT e.algo, e.loc_id, e.time AS event_time, m.matched_time, e.ordinal, f.variable, f.level, f.lat-c.centre_lat AS rel_lat,
  f.lon-c.centre_lon AS rel_lon, f.value FROM {_SURFACE}""")
def composite_surface(v):
    return _surface_windows(v).select("algo", "loc_id", "event_time", "matched_time", "ordinal", "variable", "level",
                                      "rel_lat", "rel_lon", "value")


@query("x04_surface", f"""
SELECT e.algo, e.loc_id, e.time AS event_time, f.level, f.lat-c.centre_lat AS rel_lat, f.lon-c.centre_lon AS rel_lon,
  {s6('f.value-k.cv')} AS value FROM {_SURFACE}
JOIN (SELECT lat, lon, avg(value) AS cv FROM surface GROUP BY 1, 2) k ON k.lat=f.lat AND k.lon=f.lon""")
def anomaly_surface(v):
    clim = climate.time_mean(v.surface, name="clim_value")
    out = composites.composite_anomaly(v.surface, v.event_daily, v.location, clim, half_lat=2, half_lon=4, axis=v.axis, unique_events=True)
    return out.select("algo", "loc_id", "event_time", "level", "rel_lat", "rel_lon", r6("value"))


@query("x11_surface", f"""
SELECT algo, cluster, variable, level, rel_lat, rel_lon, {s6('mv')} AS mean_value,
  {s6('2*(mv-min(mv) OVER w)/nullif(max(mv) OVER w-min(mv) OVER w,0)-1')} AS norm_value FROM (
 SELECT e.algo, e.cluster, f.variable, f.level, f.lat-c.centre_lat AS rel_lat, f.lon-c.centre_lon AS rel_lon, avg(f.value) AS mv
 FROM {_SURFACE} GROUP BY 1,2,3,4,5,6) q WINDOW w AS (PARTITION BY algo, cluster, variable)""")
def averages_surface(v):
    out = clustering.cluster_averages(_surface_windows(v), [850])
    return out.select("algo", "cluster", "variable", "level", "rel_lat", "rel_lon", r6("mean_value"), r6("norm_value"))


@query("x19_chain", f"""
WITH det AS (SELECT m.algo, l.loc_id, m.time FROM mask m JOIN location l
  ON m.lon BETWEEN l.lon AND l.lon+1 AND m.lat BETWEEN l.lat AND l.lat+1 WHERE month(m.time) IN (12,1,2)
  GROUP BY 1, 2, 3 HAVING avg(m.tag) >= 0.8)
SELECT e.algo, f.variable, f.level, f.lat-c.centre_lat AS rel_lat, f.lon-c.centre_lon AS rel_lon, CAST(count(*) AS BIGINT) AS n_cells,
  {s6('avg(f.value)')} AS mean_value
FROM det e JOIN centre c ON c.loc_id=e.loc_id JOIN wfield f ON f.time=e.time {_BOX} AND f.level IN (850, 500) GROUP BY 1,2,3,4,5""")
def chain(v):
    """Mask, events, composite and averages in one plan."""
    found = detection.landfall_events(v.mask, v.location).select("algo", "loc_id", "time")
    windows = composites.composite_raw(v.field, found, v.location, 2, 4, levels=[850, 500], axis=v.axis, unique_events=True)
    return windows.groupBy("algo", "variable", "level", "rel_lat", "rel_lon").agg(
        F.count(F.lit(1)).alias("n_cells"), r6(F.avg("value"), "mean_value"))


def _discrepancy(v):
    return comparison.discrepancy(v.event_daily, v.location, ALGOS, 1994, 2002)


_TAGS = """(SELECT algo, loc_id, time, CAST(CASE WHEN ones=zeros THEN cluster WHEN (ones>zeros)=(cluster=1) THEN 10 ELSE 20 END AS INTEGER) AS tag
FROM (SELECT *, sum(CASE WHEN cluster=1 THEN 1 ELSE 0 END) OVER (PARTITION BY algo) AS ones,
  sum(CASE WHEN cluster=0 THEN 1 ELSE 0 END) OVER (PARTITION BY algo) AS zeros FROM event_daily) q)"""


@query("x12_discrepancy_counts", f"""
SELECT algo, loc_id, CAST(yr AS INTEGER) AS yr, CAST(n AS BIGINT) AS n_events FROM {_COUNTS} q""")
def discrepancy_counts(v):
    return _discrepancy(v).counts.withColumnRenamed("year", "yr")


@query("x12_discrepancy_totals", f"""
SELECT algo, CAST(yr AS INTEGER) AS yr, CAST(sum(n) AS BIGINT) AS n_events FROM {_COUNTS} q GROUP BY ROLLUP (algo, yr)""")
def discrepancy_totals(v):
    return _discrepancy(v).totals.withColumnRenamed("year", "yr")


@query("x12_discrepancy_tags", f"SELECT algo, loc_id, time, tag FROM {_TAGS} q")
def discrepancy_tags(v):
    return _discrepancy(v).tags.select("algo", "loc_id", "time", "tag")


@query("x12_discrepancy_timeline", f"""
SELECT loc_id, CAST(date_trunc('hour', time) AS TIMESTAMP) AS time, max(CASE WHEN algo='1-URGENT' THEN tag END) AS urgent,
  max(CASE WHEN algo='2-HIGH' THEN tag END) AS high, max(CASE WHEN algo='3-MEDIUM' THEN tag END) AS medium,
  max(CASE WHEN algo='4-NOT SPECIFIED' THEN tag END) AS unset, max(CASE WHEN algo='5-LOW' THEN tag END) AS low
FROM {_TAGS} q GROUP BY 1, 2""")
def discrepancy_timeline(v):
    return _discrepancy(v).timeline.withColumnsRenamed(dict(zip(ALGOS, ["urgent", "high", "medium", "unset", "low"])))


@query("x13_moist_energies", f"""
SELECT time, level, lat, lon, {s6('(220+qty)*power(1000/level,2.0/7.0)*exp(2.5e6*(disc/10)/(1004.0*(220+qty)))')} AS theta_e,
  {s6('2.5e6*(disc/10)+1004.0*(220+qty)+(220+qty)*power(1000/level,2.0/7.0)*exp(2.5e6*(disc/10)/(1004.0*(220+qty)))')} AS mse,
  {s6('2.5e6*(disc/10)+1004.0*(220+qty)+9.8*price')} AS mde FROM cell WHERE level IN (850,700,500,300,250)""")
def moist_energies(v):
    out = energies.moist_energies(v.field)
    return out.select("time", "level", "lat", "lon", r6("theta_e"), r6("mse"), r6("mde"))


@query("x14_wave_mask", f"""
SELECT variable, time, level, lat, lon, {s6('g')} AS gradient, {s6('value-m')} AS deviation,
  CASE WHEN abs(g) > 0.05 AND abs(value-m) > 0.2 THEN 1 ELSE 0 END AS wave FROM (
  SELECT variable, time, level, lat, lon, value, avg(value) OVER (PARTITION BY variable, level, lat, lon) AS m,
    CASE WHEN lag(value) OVER w IS NULL THEN lead(value) OVER w - value
      WHEN lead(value) OVER w IS NULL THEN value - lag(value) OVER w
      ELSE (lead(value) OVER w - lag(value) OVER w)/2 END AS g
  FROM field WINDOW w AS (PARTITION BY variable, time, level, lon ORDER BY lat)) q""")
def wave_mask(v):
    out = grid.wave_mask(v.field)
    return out.select("variable", "time", "level", "lat", "lon", r6("gradient"), r6("deviation"), "wave")


@query("x15_eof_standardise", f"""
SELECT variable, time, level, lat, lon, {s6('(value-avg(value) OVER w)/(stddev_pop(value) OVER w*5)')} AS z
FROM field WHERE level IN (850,700,500,300,250) WINDOW w AS (PARTITION BY variable)""")
def eof_standardise(v):
    out = stats.eof_standardise(v.field, [850, 700, 500, 300, 250], weighted=True, by=["variable"])
    return out.select("variable", "time", "level", "lat", "lon", r6("z"))


_DAYS = "SELECT time FROM event_daily GROUP BY time HAVING count(DISTINCT algo) = 5"


@query("x16_consensus_filter", f"""
SELECT algo, time, lat, lon, tag, time IN ({_DAYS}) AS consensus FROM mask""")
def consensus_filter(v):
    days = consensus.consensus_times(v.event_daily, 5)
    return consensus.marked(v.mask, days).select("algo", "time", "lat", "lon", "tag", "consensus")


@query("x17_monthly_anomaly", f"""
SELECT f.variable, f.time, f.level, f.lat, f.lon, {s6('f.value-m.mv')} AS anomaly FROM wfield f JOIN (
 SELECT variable, month(time) AS mon, level, lat, lon, avg(value) AS mv FROM wfield WHERE month(time) IN (1,2,12) GROUP BY 1,2,3,4,5) m
ON f.variable=m.variable AND month(f.time)=m.mon AND f.level=m.level AND f.lat=m.lat AND f.lon=m.lon""")
def monthly_anomaly(v):
    field = composites.prepare_field(v.field)
    out = climate.monthly_anomaly(field, climate.base_period(v.field))
    return out.select("variable", "time", "level", "lat", "lon", r6("anomaly"))


@query("x18_mask_frequency", f"""
SELECT algo, lat, lon, {s6('avg(tag)')} AS frequency FROM mask GROUP BY 1,2,3""")
def mask_frequency(v):
    out = climate.time_mean(v.mask, ["algo", "lat", "lon"], "tag", "frequency")
    return out.withColumn("frequency", r6("frequency"))
