"""Every query against its SQL on the smallest sample, and what the plans look like."""

import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from conftest import plan
from gridevents import catalog
from gridevents.catalog.views import Views

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))
from check import canonical  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
ORACLES = catalog.oracles()


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for path in Path(FOLDER).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, con, name):
    got = canonical(catalog.queries()[name](spark, FOLDER).toPandas())
    want = canonical(con.execute(ORACLES[name]).df())
    assert list(got.columns) == list(want.columns)
    assert len(got) == len(want)
    assert [c for c in got.columns if not got[c].equals(want[c])] == []


def test_no_python_workers_and_no_products():
    """Text of the package: no per-row Python, no cross joins, no local checkpoints."""
    for path in (Path(__file__).resolve().parents[1] / "gridevents").rglob("*.py"):
        text = path.read_text().replace("CROSS JOIN", "")
        for word in ("crossJoin", "pandas_udf", "applyInPandas", "mapInPandas", ".rdd", "localCheckpoint", ".collect()", "toPandas"):
            assert word not in text, f"{word} in {path}"


@pytest.mark.parametrize("name", ["x03_composite_raw", "x06_composite_lagged", "w06_batched_zscore", "x01_landfall_events"])
def test_plans_have_no_products_or_python(spark, name):
    text = plan(catalog.queries()[name](spark, FOLDER))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text and "Python" not in text


def test_filters_of_the_package_reach_the_scan(spark, rows):
    from gridevents.operators.filters import select_algorithms, select_region, select_season
    from gridevents.plans.composites import composite_raw
    from gridevents.session import fresh_path
    from gridevents.sinks.tables import write_cube, write_partitioned
    from gridevents.sources import cubes
    field = rows("variable string, time timestamp_ntz, level double, lat double, lon double, value double", [
        ("T", f"200{y}-0{m}-05", 500.0, 30.0, 240.0, float(y * 10 + m)) for y in range(4) for m in range(1, 7)])
    path = fresh_path(spark, "t")
    write_cube(field, path)
    cube = cubes.in_file_order(cubes.read_cube(spark, path))
    text = plan(select_season(select_region(cube, (20, 40), (-130, -110)), ["Feb"]))
    assert "month#" in text.split("PartitionFilters: [")[1].split("\n")[0]
    pushed = text.split("PushedFilters: [")[1].split("\n")[0]
    assert "GreaterThanOrEqual(lat,20.0)" in pushed and "lon" in pushed
    event = rows("algo string, loc_id long, time timestamp_ntz", [("a", 0, "2002-03-05")])
    place = rows("loc_id long, lat double, lon double", [(0, 30.0, 240.0)])
    out = composite_raw(cube, event, place, 2, 2, variable="T", axis=field)
    assert [r["value"] for r in out.collect()] == [23.0]
    filters = plan(out).split("PartitionFilters: [")[1].split("\n")[0]
    assert "variable#" in filters and "year#" in filters and "month#" in filters
    mask = rows("algo string, time timestamp_ntz, lat double, lon double, tag double", [("/x/", "2000-01-01", 1.0, 2.0, 1.0), ("y", "2000-01-01", 1.0, 2.0, 1.0)])
    stored = fresh_path(spark, "m")
    mask.write.parquet(stored)
    kept = select_algorithms(spark.read.parquet(stored), "x, z")
    assert kept.count() == 1 and "In(algo" in plan(kept)


def test_group_statistics_do_not_shuffle_the_cube(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        text = plan(catalog.queries()["x15_eof_standardise"](spark, FOLDER))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "_salt" not in text and text.count("(scan)") + text.count("Scan parquet") <= 8


def test_detection_pre_aggregates_before_its_shuffle(spark):
    text = plan(catalog.queries()["x01_landfall_events"](spark, FOLDER))
    assert "partial_avg" in text and "BroadcastHashJoin" in text
