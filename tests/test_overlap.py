import random

import pytest
from pyspark.sql import functions as F

from conftest import plan, values
from gridevents.session import fresh_path
from gridevents.sinks.tables import write_cube
from gridevents.sources import overlap

SCHEMA = "variable string, time timestamp_ntz, level double, lat double, lon double, value double"


def cube(rows, days, variable="T", value=0.0):
    return rows(SCHEMA, [(variable, f"2000-{1 + d // 28:02d}-{1 + d % 28:02d}", None if d % 2 else 500.0, float(c), 1.0, value + d) for d in days for c in range(3)])


def exchanges(df):
    return plan(df, "simple").count("Exchange")


def brute(ranges):
    held = sorted(ranges)
    points = sorted({x for r in held for x in r})
    depth = {p: sum(a <= p <= b for a, b in held) for p in points}
    between = [(p, q, sum(a <= p and q <= b for a, b in held)) for p, q in zip(points, points[1:])]
    return depth, between


def test_sweep_matches_brute_force(spark):
    R = random.Random(1)
    for _ in range(4):
        held = [(a, a + R.choice([0, 0, 1, 5, 20])) for a in (R.randint(0, 80) for _ in range(25))]
        frame = spark.createDataFrame([("T", f"f{i}", a, b, False) for i, (a, b) in enumerate(held)],
                                      "variable string, source_rank string, first int, last int, repeats boolean")
        got = [(r["first"], r["last"]) for r in overlap.shared_ranges(frame).collect()]
        depth, between = brute(held)
        inside = lambda x, y: any(a <= x and y <= b for a, b in got)
        assert all(inside(p, p) == (n >= 2) for p, n in depth.items())
        assert all(inside(p, q) == (n >= 2) for p, q, n in between if n >= 2 or (depth[p] < 2 and depth[q] < 2))


def test_disjoint_files_are_not_shuffled(spark, rows):
    path = fresh_path(spark, "t")
    write_cube(cube(rows, range(84)), path, by_time=True)
    got = overlap.read_first(spark, path)
    assert exchanges(got) == 0 and got.count() == 84 * 3


def test_only_shared_stamps_are_grouped(spark, rows):
    first, late = fresh_path(spark, "t"), fresh_path(spark, "t")
    write_cube(cube(rows, range(0, 60)), first, by_time=True)
    write_cube(cube(rows, range(50, 90), value=1000.0), late, by_time=True)
    got = overlap.read_first(spark, [first, late])
    assert exchanges(got) == 1
    text = plan(got)
    assert "LessThanOrEqual(time" in text or "LessThan(time" in text  # the ranges reach the scan
    want = [(d + (0.0 if d < 60 else 1000.0),) for d in range(90) for _ in range(3)]
    assert values(got, "value") == sorted(want)
    assert set(got.columns) == {*SCHEMA.replace(",", "").split()[::2], "year", "month"}


@pytest.mark.parametrize("stated, broadcast", [(64, True), (0, True), (0, False)])
def test_all_three_ways_agree(spark, rows, monkeypatch, stated, broadcast):
    monkeypatch.setattr(overlap, "STATED_RANGES", stated)
    monkeypatch.setattr(overlap, "fits", lambda df: broadcast)
    both = cube(rows, range(30)).withColumn("source_rank", F.lit("a")).unionByName(
        cube(rows, range(20, 40), value=500.0).withColumn("source_rank", F.lit("b"))).unionByName(
        cube(rows, range(10), "Q").withColumn("source_rank", F.lit("b")))
    got = overlap.first_of_files(both, overlap.shared_ranges(overlap.file_ranges(both)))
    assert values(got, "variable", "value") == sorted([("T", d + (0.0 if d < 30 else 500.0)) for d in range(40) for _ in range(3)]
                                                      + [("Q", float(d)) for d in range(10) for _ in range(3)])


def test_repeats_inside_one_file_count(spark, rows):
    df = cube(rows, [3, 4]).unionByName(cube(rows, [4], value=0.0)).withColumn("source_rank", F.lit("a"))
    ranges = overlap.file_ranges(df)
    assert [r["repeats"] for r in ranges.collect()] == [True]
    assert overlap.first_of_files(df, overlap.shared_ranges(ranges)).count() == 6


def test_the_index_follows_the_files(spark, rows):
    path = fresh_path(spark, "t")
    write_cube(cube(rows, range(10)), path, by_time=True)
    before = overlap.range_index(spark, path).count()
    assert overlap.read_first(spark, path).count() == 30
    cube(rows, range(5, 12), value=100.0).withColumns({"year": F.year("time"), "month": F.month("time")}) \
        .write.mode("append").partitionBy("variable", "year", "month").parquet(path)
    assert overlap.range_index(spark, path).count() > before
    assert overlap.read_first(spark, path).count() == 12 * 3


def test_empty_cube(spark, rows):
    empty = rows(SCHEMA, []).withColumn("source_rank", F.lit("a"))
    assert overlap.first_of_files(empty, overlap.shared_ranges(overlap.file_ranges(empty))).count() == 0
