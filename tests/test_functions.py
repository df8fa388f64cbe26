import math

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from gridevents.functions import geo, physics, scaling, text, times


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_wrap_longitude_fixed_cases(spark):
    got = one(spark, *[geo.wrap_longitude(F.lit(float(x))) for x in (243, 180, -200, 0, 359.5)])
    assert got == (-117.0, -180.0, 160.0, 0.0, -0.5)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-2000, 2000), min_size=1, max_size=50))
def test_wrap_longitude_range(spark, degrees):
    wrapped = spark.createDataFrame([(x,) for x in degrees], "x double").select("x", geo.wrap_longitude(F.col("x")))
    for x, y in wrapped.collect():
        assert -180.0 <= y <= 180.0
        assert math.isclose(math.cos(math.radians(x)), math.cos(math.radians(y)), abs_tol=1e-9)


def test_hour_key_ignores_session_zone(rows):
    # 02:30 does not exist on this day in the session's time zone
    df = rows("t timestamp_ntz", [("2024-03-10 02:30:15.5",)])
    assert str(df.select(times.hour_key(F.col("t"))).first()[0]) == "2024-03-10 02:00:00"


def test_nanosecond_stamps_parse(spark):
    got = one(spark, times.parse_stamp(F.lit("1980-01-01T03:00:00.000000000")), times.parse_stamp(F.lit("[]")))
    assert str(got[0]) == "1980-01-01 03:00:00" and got[1] is None


def test_synthetic_stamp_crosses_days(spark):
    got = one(spark, times.hours_after(times.year_start(F.lit(2001)), F.lit(49)))
    assert str(got[0]) == "2001-01-03 01:00:00"


def test_month_numbers(spark):
    assert [times.month_number(m) for m in ("Dec", "Jan", "Feb")] == [12, 1, 2]
    assert one(spark, times.month_number_of(F.lit("Sep")), times.month_number_of(F.lit("Foo"))) == (9, None)
    with pytest.raises(ValueError):
        times.month_number("Foo")


def test_stamps_of_list_lines(spark):
    line = "['1980-01-01T00:00:00.000000000', '1980-01-01T03:00:00.000000000']"
    assert len(one(spark, text.stamps_in(F.lit(line)))[0]) == 2
    assert one(spark, text.stamps_in(F.lit("[]")))[0] == []


def test_inner_tokens_drop_two_and_last(spark):
    line = "['2000-01-01T00:00', '2000-01-01T01:00', '2000-01-01T02:00', '2000-01-01T03:00']"
    tokens = one(spark, F.transform(text.inner_tokens(F.lit(line)), text.before_colon))[0]
    assert tokens == ["2000-01-01T02"]
    assert one(spark, text.inner_tokens(F.lit("['a']")))[0] == []


def test_pairs_names_and_lists(spark):
    assert one(spark, text.pair_part(F.lit("(-120.5, 38.25)"), 1), text.pair_part(F.lit("(-120.5, 38.25)"), 2)) == (-120.5, 38.25)
    assert one(spark, text.bare_name(F.lit("/abc/")), text.bare_name(F.lit("abc"))) == ("abc", "abc")
    assert one(spark, text.comma_list(F.lit("a, b ,c")))[0] == ["a", "b", "c"]
    assert one(spark, text.bracket_list(F.array(F.lit("x"), F.lit("y"))))[0] == "['x', 'y']"


def test_min_max_and_zero_range(spark):
    got = one(spark, *[scaling.min_max(F.lit(float(v)), F.lit(2.0), F.lit(6.0)) for v in (2, 4, 6)],
              scaling.min_max(F.lit(3.0), F.lit(3.0), F.lit(3.0)))
    assert got == (-1.0, 0.0, 1.0, None)


def test_noise_is_per_cell_and_uniform(spark):
    df = spark.range(4000).select((F.col("id") % 2000).alias("cell"))
    noise = df.select("cell", scaling.cell_noise(3, F.col("cell")).alias("u"), scaling.cell_normal(3, F.col("cell")).alias("n"))
    assert noise.groupBy("cell").agg(F.count_distinct("u").alias("d")).where("d <> 1").count() == 0
    u, n, s = noise.agg(F.avg("u"), F.avg("n"), F.stddev_pop("n")).first()
    assert abs(u - 0.5) < 0.03 and abs(n) < 0.08 and abs(s - 1) < 0.08


def test_energies(spark):
    t, q, z, p = 280.0, 0.005, 1500.0, 850.0
    theta = t * (1000 / p) ** (2 / 7)
    theta_e = theta * math.exp(2.5e6 * q / (1004 * t))
    cols = [F.lit(v) for v in (t, q, z, p)]
    got = one(spark, physics.potential_temperature(cols[0], cols[3]), physics.equivalent_temperature(cols[0], cols[1], cols[3]),
              physics.static_energy(cols[0], cols[1], cols[3]), physics.dynamic_energy(*cols[:3]),
              physics.equivalent_temperature_power(cols[0], cols[1], cols[3]))
    want = (theta, theta_e, 2.5e6 * q + 1004 * t + theta_e, 2.5e6 * q + 1004 * t + 9.8 * z, theta ** (2.5e6 * q / (1004 * t)))
    assert got == pytest.approx(want)
