"""Scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridevents.catalog.registry import query, r6, s6
from gridevents.functions import geo, physics, scaling, text, times
from gridevents.operators import stats
from gridevents.operators.align import wide
from gridevents.operators.consensus import on_consensus
from gridevents.operators.joins import lookup_join, with_group_stats, with_total_stats
from gridevents.plans.comparison import with_titles
from gridevents.catalog.joining import TITLES


@query("f01_wrap_longitude", """
SELECT DISTINCT lon, (lon+180)%360-180 AS wrapped, ((lon-500+180)%360+360)%360-180 AS wrapped_negative FROM field""")
def wrap(v):
    return v.field.select("lon").distinct().select(
        "lon", geo.wrap_longitude(F.col("lon")).alias("wrapped"), geo.wrap_longitude(F.col("lon") - 500).alias("wrapped_negative"))


@query("f02_min_max", f"""
SELECT variable, time, level, lat, lon,
  {s6('2*(value-min(value) OVER w)/nullif(max(value) OVER w-min(value) OVER w,0)-1')} AS norm
FROM field WINDOW w AS (PARTITION BY variable, level)""")
def min_max(v):
    out = stats.normalise(v.field, ["variable", "level"], spread=["time", "lat", "lon"])
    return out.select("variable", "time", "level", "lat", "lon", r6("norm"))


@query("f03_weighted_zscore", f"""
SELECT f.time, f.level, f.lat, f.lon, {s6('(value-m)/(s*5)')} AS z FROM field f
CROSS JOIN (SELECT avg(value) AS m, stddev_pop(value) AS s FROM field WHERE variable='T') t WHERE f.variable='T'""")
def weighted(v):
    out = with_total_stats(v.field.where("variable = 'T'"), {"m": F.avg("value"), "s": F.stddev_pop("value")})
    z = scaling.z_score(F.col("value"), F.col("m"), F.col("s"), 5)
    return out.select("time", "level", "lat", "lon", r6(z, "z"))


_GAPPY = """(SELECT time, level, lat, lon, CASE WHEN rflag='R' THEN NULL ELSE qty END AS value FROM cell)"""


@query("f04_fill_missing", f"""
SELECT f.time, f.level, f.lat, f.lon, {s6('coalesce((value-m)/s, zm)')} AS z FROM {_GAPPY} f
CROSS JOIN (SELECT avg(value) AS m, stddev_pop(value) AS s FROM {_GAPPY} g) t
CROSS JOIN (SELECT avg((value-m)/s) AS zm FROM {_GAPPY} g CROSS JOIN (SELECT avg(value) AS m, stddev_pop(value) AS s FROM {_GAPPY} h) u) w""")
def fill(v):
    gappy = v.cell.select("time", "level", "lat", "lon", F.when(F.col("rflag") == "R", float("nan")).otherwise(F.col("qty")).alias("value"))
    clean = gappy.withColumn("value", scaling.missing_to_null(F.col("value")))
    return stats.eof_standardise(clean).select("time", "level", "lat", "lon", r6("z"))


_TQZ = """(SELECT time, level, lat, lon, 220+qty AS t, disc/10 AS q, price AS z FROM cell)"""


def _tqz(v):
    return wide(v.field, ["T", "Q", "Z"])


@query("f05_potential_temperature", f"""
SELECT time, level, lat, lon, {s6('t*power(1000/level,2.0/7.0)')} AS theta FROM {_TQZ} c""")
def theta(v):
    return _tqz(v).select("time", "level", "lat", "lon",
                          r6(physics.potential_temperature(F.col("T"), F.col("level")), "theta"))


@query("f06_equivalent_temperature", f"""
SELECT time, level, lat, lon, {s6('t*power(1000/level,2.0/7.0)*exp(2.5e6*q/(1004.0*t))')} AS theta_e FROM {_TQZ} c""")
def theta_e(v):
    return _tqz(v).select("time", "level", "lat", "lon",
                          r6(physics.equivalent_temperature(F.col("T"), F.col("Q"), F.col("level")), "theta_e"))


@query("f07_power_form", f"""
SELECT time, level, lat, lon, {s6('power(t*power(1000/level,2.0/7.0), 2.5e6*q/(1004.0*t))')} AS theta_p FROM {_TQZ} c""")
def theta_power(v):
    return _tqz(v).select("time", "level", "lat", "lon",
                          r6(physics.equivalent_temperature_power(F.col("T"), F.col("Q"), F.col("level")), "theta_p"))


@query("f08_static_energy", f"""
SELECT time, level, lat, lon, {s6('2.5e6*q+1004.0*t+t*power(1000/level,2.0/7.0)*exp(2.5e6*q/(1004.0*t))')} AS mse FROM {_TQZ} c""")
def mse(v):
    return _tqz(v).select("time", "level", "lat", "lon",
                          r6(physics.static_energy(F.col("T"), F.col("Q"), F.col("level")), "mse"))


@query("f09_dynamic_energy", f"""
SELECT time, level, lat, lon, {s6('2.5e6*q+1004.0*t+9.8*z')} AS mde FROM {_TQZ} c""")
def mde(v):
    return _tqz(v).select("time", "level", "lat", "lon",
                          r6(physics.dynamic_energy(F.col("T"), F.col("Q"), F.col("Z")), "mde"))


@query("f10_difference", f"""
SELECT variable, time, level, lat, lon, {s6('value - avg(value) OVER (PARTITION BY variable, month(time), level, lat, lon)')} AS diff FROM field""")
def difference(v):
    dated = v.field.withColumn("mon", F.month("time"))
    out = with_group_stats(dated, ["variable", "mon", "level", "lat", "lon"], {"m": F.avg("value")})
    return out.select("variable", "time", "level", "lat", "lon", r6(F.col("value") - F.col("m"), "diff"))


@query("f11_scale_and_noise", f"""
SELECT time, level, lat, lon, {s6('disc/10/1e-3')} AS scaled, TRUE AS noise_in_range FROM cell""")
def scale_noise(v):
    noise = scaling.cell_noise(0, F.col("lat"), F.col("lon"))
    return v.field.where("variable = 'Q'").select("time", "level", "lat", "lon", r6(F.col("value") / 1e-3, "scaled"),
                                                  ((noise >= 0) & (noise < 1)).alias("noise_in_range"))


@query("f12_clamp", """
SELECT time, pos, CAST(greatest(0, least(pos-4, n-4)) AS BIGINT) AS lag4, CAST(greatest(0, least(pos+9, n-4)) AS BIGINT) AS ahead
FROM axis CROSS JOIN (SELECT count(*) AS n FROM axis x) q""")
def clamp(v):
    sized = with_total_stats(v.axis, {"n": F.count(F.lit(1))})
    zero, top = F.lit(0), F.col("n") - 4
    return sized.select("time", "pos", geo.clamp(F.col("pos") - 4, zero, top).alias("lag4"),
                        geo.clamp(F.col("pos") + 9, zero, top).alias("ahead"))


@query("f13_integer_arithmetic", """
SELECT time, level, lat, lon, CAST(floor(qty/7) AS BIGINT) AS q7, abs(lon-235) AS distance, round(disc/10, 3)+0.0 AS rounded FROM cell""")
def arithmetic(v):
    return v.cell.select("time", "level", "lat", "lon", F.floor(F.col("qty") / 7).alias("q7"),
                         F.abs(F.col("lon") - 235).alias("distance"),
                         (F.round(F.col("disc") / 10, 3) + F.lit(0.0)).alias("rounded"))


@query("f14_membership", """
SELECT 'in' AS side, algo, CAST(count(*) AS BIGINT) AS n FROM event_daily WHERE time IN (SELECT time FROM axis4) GROUP BY algo
UNION ALL SELECT 'out', algo, CAST(count(*) AS BIGINT) FROM event_daily WHERE time NOT IN (SELECT time FROM axis4) GROUP BY algo""")
def membership(v):
    def side(name, invert):
        return on_consensus(v.event_daily, v.axis4, invert).groupBy("algo").agg(
            F.count(F.lit(1)).alias("n")).withColumn("side", F.lit(name))
    return side("in", False).unionByName(side("out", True)).select("side", "algo", "n")


@query("f15_month_names", """
SELECT strftime(time, '%b') AS name, CAST(month(time) AS INTEGER) AS mon, CAST(count(*) AS BIGINT) AS n FROM axis GROUP BY 1, 2""")
def month_names(v):
    named = v.axis.withColumn("name", F.date_format("time", "MMM"))
    return named.groupBy("name", times.month_number_of(F.col("name")).alias("mon")).agg(F.count(F.lit(1)).alias("n"))


@query("f16_month_year", """
SELECT CAST(year(time) AS INTEGER) AS yr, CAST(month(time) AS INTEGER) AS mon, CAST(count(*) AS BIGINT) AS n FROM field GROUP BY 1, 2""")
def month_year(v):
    return v.field.groupBy(F.year("time").alias("yr"), F.month("time").alias("mon")).agg(F.count(F.lit(1)).alias("n"))


@query("f17_stamp_text", """
SELECT DISTINCT time, strftime(time, '%Y-%m-%dT%H:%M:%S') AS stamp, time AS parsed FROM event_hourly""")
def stamp(v):
    texts = v.event_hourly.select("time", times.stamp_text(F.col("time")).alias("stamp")).distinct()
    return texts.withColumn("parsed", times.parse_stamp(F.col("stamp")))


@query("f18_hour_key", """
SELECT event_id, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS hour, strftime(ts, '%Y-%m-%dT%H') AS hour_text FROM events""")
def hour_key(v):
    return v.table("events").select("event_id", times.hour_key(F.col("ts")).alias("hour"),
                                    text.before_colon(times.stamp_text(F.col("ts"))).alias("hour_text"))


@query("f19_slicing", """
SELECT event_id, substr(props, 2, 4) AS part, split_part(props, ':', 1) AS head, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k,
  trim(' ' || event_type || ' ') AS stripped FROM events""")
def slicing(v):
    return v.table("events").select(
        "event_id", F.substring("props", 2, 4).alias("part"), F.split("props", ":")[0].alias("head"),
        F.regexp_extract("props", "([0-9]+)", 1).cast("int").alias("k"),
        F.trim(F.concat(F.lit(" "), "event_type", F.lit(" "))).alias("stripped"))


@query("f20_keys", """
SELECT e.algo, e.time, CAST(l.lat AS VARCHAR) || CAST(l.lon AS VARCHAR) || '_' || strftime(e.time, '%Y-%m-%dT%H:%M:%S') AS place_key,
  CAST(l.lon AS VARCHAR) || 'E_' || CAST(l.lat AS VARCHAR) || 'N_' || CAST(year(e.time) AS VARCHAR) AS year_key
FROM event_daily e JOIN location l ON l.loc_id=e.loc_id""")
def keys(v):
    placed = lookup_join(v.event_daily, v.location, ["loc_id"], ["algo", "time"])
    lat, lon = F.col("lat"), F.col("lon")
    return placed.select("algo", "time", text.place_key(lat, lon, times.stamp_text(F.col("time"))).alias("place_key"),
                         text.place_year_key(lat, lon, F.year("time")).alias("year_key"))


@query("f21_text_tests", """
SELECT event_id, upper(event_type) AS up, starts_with(event_type, 'c') AS starts, suffix(event_type, 'k') AS ends,
  lpad(CAST(month(ts) AS VARCHAR), 2, '0') AS mm FROM events""")
def text_tests(v):
    kind = F.col("event_type")
    return v.table("events").select("event_id", F.upper(kind).alias("up"), kind.startswith("c").alias("starts"),
                                    kind.endswith("k").alias("ends"), text.two_digits(F.month("ts")).alias("mm"))


@query("f22_category", """
SELECT algo, loc_id, time, CASE WHEN cluster=0 THEN 'blue' ELSE 'red' END AS colour,
  CASE WHEN (cluster+1)*10=20 THEN 'blue' ELSE 'orange' END AS tag_colour FROM event_daily""")
def category(v):
    return v.event_daily.select("algo", "loc_id", "time", text.category(F.col("cluster"), 0, "blue", "red").alias("colour"),
                                text.category((F.col("cluster") + 1) * 10, 20, "blue", "orange").alias("tag_colour"))


@query("f23_tuple_parse", """
SELECT o_orderkey, CAST(21+0.5*(o_custkey%16) AS DOUBLE) AS lat, CAST(-117.5-1.25*(o_custkey%12) AS DOUBLE) AS lon FROM orders""")
def tuple_parse(v):
    lat = F.lit(21.0) + F.lit(0.5) * (F.col("o_custkey") % 16)
    lon = F.lit(-117.5) - F.lit(1.25) * (F.col("o_custkey") % 12)
    lines = v.table("orders").select("o_orderkey", F.format_string("(%s, %s)", lat, lon).alias("value"))
    return lines.select("o_orderkey", text.pair_part(F.col("value"), 1).alias("lat"),
                        text.pair_part(F.col("value"), 2).alias("lon"))


@query("f24_first_digit", """
SELECT o_orderkey, CAST(substr(o_orderpriority,1,1) AS INTEGER) AS digit FROM orders""")
def first_digit(v):
    return v.table("orders").select("o_orderkey", text.first_digit(F.col("o_orderpriority")).alias("digit"))


@query("f25_comma_list", """
SELECT event_id, trim(u.item) AS item FROM (SELECT event_id, unnest(string_split(event_type || ', ' || 'x,y', ',')) AS item FROM events) u""")
def comma_list(v):
    joined = F.concat("event_type", F.lit(", "), F.lit("x,y"))
    return v.table("events").select("event_id", F.explode(text.comma_list(joined)).alias("item"))


@query("f26_plot_codes", """
SELECT e.algo, CAST(t.ordinal AS INTEGER) AS ordinal, CAST((e.cluster+1)*15 AS INTEGER) AS size_code, CAST(count(*) AS BIGINT) AS n FROM event_daily e
JOIN (SELECT '1-URGENT' AS algo, 1 AS ordinal UNION ALL SELECT '2-HIGH', 2 UNION ALL SELECT '3-MEDIUM', 3
 UNION ALL SELECT '4-NOT SPECIFIED', 4 UNION ALL SELECT '5-LOW', 5) t ON t.algo=e.algo GROUP BY 1, 2, 3""")
def plot_codes(v):
    coded = with_titles(v.event_daily, TITLES).withColumn("size_code", (F.col("cluster") + 1) * 15)
    return coded.groupBy("algo", "ordinal", "size_code").agg(F.count(F.lit(1)).alias("n"))
