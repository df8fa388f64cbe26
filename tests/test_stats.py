import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import values
from gridevents.functions.geo import wrap_longitude
from gridevents.operators import blocks, climate, cluster, consensus, events, grid, moments, stats
from gridevents.operators.features import Window, as_vectors, feature_arrays
from gridevents.plans.clustering import cluster_vectors
from gridevents.sources.cubes import clean, synthetic_cube
from gridevents.sources.selftest import planted_frames


def line(spark, numbers):
    return spark.createDataFrame([(float(i), float(v)) for i, v in enumerate(numbers)], "lat double, value double")


def test_gradient_like_numpy(spark):
    got = [r["gradient"] for r in grid.gradient(line(spark, [1, 4, 9, 16]), "lat", []).orderBy("lat").collect()]
    assert got == [3.0, 4.0, 6.0, 7.0] == list(np.gradient([1.0, 4.0, 9.0, 16.0]))


def test_wave_mask_against_numpy(spark):
    rng = np.random.default_rng(1)
    cube = rng.standard_normal((5, 6, 7)) * 0.1
    data = [("P", f"2000-01-0{t + 1}", None, float(y), float(x), float(cube[t, y, x]))
            for t in range(5) for y in range(6) for x in range(7)]
    df = spark.createDataFrame(data, "variable string, time string, level double, lat double, lon double, value double")
    got = {(r["time"], r["lat"], r["lon"]): r["wave"] for r in
           grid.wave_mask(df.withColumn("time", F.col("time").cast("timestamp_ntz")), 0.05, 0.1)
           .withColumn("time", F.dayofmonth("time")).collect()}
    want = (np.abs(np.gradient(cube, axis=1)) > 0.05) & (np.abs(cube - cube.mean(axis=0)) > 0.1)
    assert all(got[(t + 1, float(y), float(x))] == int(want[t, y, x]) for t in range(5) for y in range(6) for x in range(7))


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (2.0,), (6.0,)], "value double")
    assert clean(df).agg(F.avg("value")).first()[0] == 3.0


def positioned(spark, numbers):
    return spark.createDataFrame([(i, len(numbers), None if v is None else float(v)) for i, v in enumerate(numbers)],
                                 "pos long, n_rows long, value double")


def test_batched_z_score_blocks(spark):
    numbers = [1, 2, 3, 4, 5, 5, 7, 8, 9, None, 12]
    out = stats.batched_z_score(positioned(spark, numbers), [], 5)
    got = {r["pos"]: (r["block"], r["z"]) for r in out.collect()}
    assert [sum(1 for b, _ in got.values() if b == k) for k in range(5)] == [2, 2, 2, 2, 3]
    assert got[4][1] == 0.0 and got[5][1] == 0.0          # constant block
    assert got[9][1] == 0.0                                # missing value
    assert got[0][1] == pytest.approx(-1.0)
    sums = out.where("value is not null").groupBy("block").agg(F.sum("z").alias("s"))
    assert all(abs(r["s"]) < 1e-9 for r in sums.collect())
    with pytest.raises(Exception, match="fewer events than blocks"):
        stats.batched_z_score(positioned(spark, [1, 2, 3]), [], 5).collect()


def test_thirds_are_not_ntile(spark):
    got = blocks.with_third(positioned(spark, [0] * 5)).orderBy("pos").collect()
    assert [r["third"] for r in got] == [0, 1, 2, 2, 2]
    assert [r["third"] for r in blocks.with_third(positioned(spark, [0, 0])).collect()] == [2, 2]


def test_normalise_levels_and_surface(rows):
    df = rows("level double, lat double, lon double, value double", [
        (500.0, 1.0, 1.0, 3.0), (500.0, 1.0, 2.0, 5.0), (None, 1.0, 1.0, 10.0), (None, 1.0, 2.0, 30.0), (None, 1.0, 3.0, 20.0),
        (850.0, 1.0, 1.0, 4.0)])
    got = values(stats.normalise(df, ["level"]), "value", "norm")
    assert got == [(3.0, -1.0), (4.0, None), (5.0, 1.0), (10.0, -1.0), (20.0, 0.0), (30.0, 1.0)]


def test_eof_fill_and_weight(rows):
    df = rows("time int, lat double, lon double, level double, value double",
              [(1, 0.0, 0.0, 500.0, 2.0), (2, 0.0, 0.0, 850.0, 4.0), (3, 0.0, 0.0, 500.0, None)])
    got = values(stats.eof_standardise(df, [500, 850], weighted=True), "time", "z")
    assert got == [(1, -0.5), (2, 0.5), (3, 0.0)]


def test_anomaly_modes(rows):
    base = rows("variable string, time timestamp_ntz, level double, lat double, lon double, value double", [
        ("T", "2000-01-05", None, 1.0, 1.0, 2.0), ("T", "2001-01-05", None, 1.0, 1.0, 4.0), ("T", "2000-02-05", None, 1.0, 1.0, 10.0)])
    one = base.limit(1)
    assert values(climate.monthly_anomaly(one, base), "anomaly") == [(-1.0,)]
    assert values(climate.monthly_anomaly(one, base, "cross"), "clim_month", "anomaly") == [(1, -1.0), (2, -8.0)]
    with pytest.raises(ValueError):
        climate.monthly_anomaly(one, base, "other")


def test_majority_tags_and_tie(rows):
    df = rows("algo string, loc_id int, cluster int", [("a", 1, 0), ("a", 2, 0), ("a", 3, 0), ("a", 4, 1), ("t", 1, 0), ("t", 2, 1)])
    assert values(events.majority_tags(df), "algo", "loc_id", "tag") == [
        ("a", 1, 10), ("a", 2, 10), ("a", 3, 10), ("a", 4, 20), ("t", 1, 0), ("t", 2, 1)]


def test_semi_and_anti_make_the_whole(rows, spark):
    df = spark.range(500).select("id", F.expr("timestampadd(DAY, cast(id % 40 as int), timestamp_ntz'2000-01-01')").alias("time"))
    days = df.where("id % 40 < 13").select("time")
    on, off = consensus.on_consensus(df, days), consensus.on_consensus(df, days, invert=True)
    assert on.count() + off.count() == 500 and on.join(off, "id").count() == 0


def test_chunk_sizes_sum_to_the_axis(spark):
    df = spark.range(50).select(F.expr("timestampadd(HOUR, cast(id as int), timestamp_ntz'2000-01-01')").alias("time"),
                                F.explode(F.array(F.lit(500.0), F.lit(850.0))).alias("level"),
                                F.lit(1.0).alias("lat"), F.lit(2.0).alias("lon"))
    table = blocks.chunk_table(blocks.with_chunks(df, {"time": 6, "level": 1}), ["time", "level"], counter=10).orderBy("chunk_id").collect()
    assert [r["chunk_id"] for r in table] == list(range(10, 28))
    assert sum(r["n_times"] for r in table) == 100
    assert [r["offset"] for r in table[:4]] == [0, 6, 12, 18]


def test_lat_lon_chunks(spark):
    df = spark.range(8).select(F.expr("timestamp_ntz'2000-01-01'").alias("time"), F.lit(1.0).alias("level"),
                               (20 + F.col("id") * 0.25).alias("lat"), F.lit(2.0).alias("lon"))
    assert [r["chunk_lat"] for r in blocks.with_chunks(df, {"lat": 3}).orderBy("lat").collect()] == [0, 0, 0, 1, 1, 1, 2, 2]


def test_features_are_dense_and_ordered(rows):
    w = Window(0.5, 1.0, 0.5, 1.0)
    df = rows("e int, variable string, rel_lat double, rel_lon double, z double", [
        (1, "A", -0.5, -1.0, 1.0), (1, "B", 0.5, 1.0, 2.0), (1, "A", 0.0, 0.0, 3.0), (2, "B", -0.5, -1.0, 4.0)])
    got = {r["e"]: r["features"] for r in feature_arrays(df, ["e"], w, ["A", "B"]).collect()}
    assert (w.n_lat, w.n_lon, w.size(2)) == (3, 3, 18)
    want = [0.0] * 18
    want[0], want[17], want[8] = 1.0, 2.0, 3.0
    assert got[1] == want
    assert got[2] == [0.0, 4.0] + [0.0] * 16


def brute_silhouette(points, labels):
    points, labels = np.array(points), np.array(labels)
    d = ((points[:, None, :] - points[None, :, :]) ** 2).sum(-1)
    scores = []
    for i, own in enumerate(labels):
        same = (labels == own)
        if same.sum() == 1:
            scores.append(0.0)
            continue
        a = d[i][same].sum() / (same.sum() - 1)
        b = min(d[i][labels == o].mean() for o in set(labels) if o != own)
        scores.append((b - a) / max(a, b))
    return float(np.mean(scores))


def test_silhouette_against_brute_force(spark):
    rng = np.random.default_rng(2)
    points = rng.standard_normal((60, 4)).tolist()
    labels = [i % 3 for i in range(59)] + [3]
    df = spark.createDataFrame(list(zip(points, labels)), "features array<double>, cluster int")
    got = cluster.squared_silhouette(df).first()[0]
    assert got == pytest.approx(brute_silhouette(points, labels))
    assert cluster.silhouette_score(as_vectors(df)) == pytest.approx(got)


def test_assign_nearest_takes_the_smallest_on_a_tie(spark):
    df = spark.createDataFrame([([0.0, 0.0],), ([3.0, 0.0],)], "features array<double>")
    centres = spark.createDataFrame([(5, [1.0, 0.0]), (2, [-1.0, 0.0])], "cluster int, centroid array<double>")
    assert sorted(r["cluster"] for r in cluster.assign_nearest(df, centres).collect()) == [2, 5]


def test_planted_groups_are_found(spark):
    """Five far-apart frames, twenty copies each, one noise field: k = 5 and pure groups."""
    frames = spark.range(60).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(7)))).select(
        F.lit("P").alias("variable"), F.expr("timestampadd(HOUR, cast(id as int), timestamp_ntz'2000-01-01')").alias("time"),
        F.lit(None).cast("double").alias("level"), F.col("i").cast("double").alias("lat"), F.lit(0.0).alias("lon"),
        F.when(F.col("i") == F.floor(F.col("id") / 12), 50.0).otherwise(0.0).alias("value"))
    planted = planted_frames(frames)
    assert planted.select("pos").distinct().count() == 100
    vectors = planted.groupBy("pos", "frame").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("lat", "value"))), lambda x: x["value"]).alias("features"))
    labelled = cluster_vectors(as_vectors(vectors), ks=range(2, 10))
    assert labelled.select("k").distinct().collect()[0][0] == 5
    groups = labelled.groupBy("frame").agg(F.count_distinct("cluster").alias("d"), F.count("*").alias("n")).collect()
    assert all(r["d"] == 1 and r["n"] == 20 for r in groups)


def test_equal_vectors_cannot_be_clustered(spark):
    df = as_vectors(spark.createDataFrame([([1.0],)] * 5, "features array<double>"))
    with pytest.raises(ValueError, match="all alike"):
        cluster.choose_k(cluster.sweep(df, [2, 3]))


def test_synthetic_cube_is_repeatable(spark):
    axis = spark.createDataFrame([("2000-01-01",), ("2000-01-02",)], "t string").select(F.col("t").cast("timestamp_ntz").alias("time"))
    cube = synthetic_cube(axis)
    assert cube.count() == 2 * 73 * 144
    assert cube.agg(F.min("lat"), F.max("lat"), F.min("lon"), F.max("lon")).first()[:] == (-90.0, 90.0, 0.0, 360.0)
    assert cube.exceptAll(synthetic_cube(axis)).count() == 0
    assert abs(cube.agg(F.stddev_pop("value")).first()[0] - 0.1) < 0.005


def test_computed_coordinates_meet_their_cells(spark):
    """0.1 degree longitudes wrapped from 0..360 differ from stored ones in the last bits."""
    lon = (F.col("id") / 10).alias("lon")
    field = spark.range(3600).select(F.lit("T").alias("variable"), F.lit(None).cast("double").alias("level"), F.lit(10.1).alias("lat"),
                                     wrap_longitude(lon).alias("lon"), F.lit(3.0).alias("value"))
    clim = spark.range(3600).select(F.lit("T").alias("variable"), F.lit(None).cast("double").alias("level"), F.lit(10.1).alias("lat"),
                                    ((F.col("id") - 1800) / 10).alias("lon"), F.lit(1.0).alias("clim_value"))
    out = climate.subtract_climatology(field, clim)
    assert out.count() == 3600 and {r["anomaly"] for r in out.select("anomaly").distinct().collect()} == {2.0}


@pytest.mark.parametrize("broadcast", [True, False])
def test_a_crowded_cell_is_dealt_to_parts(spark, monkeypatch, broadcast):
    """One cell holds half of all windows; results are those of the plain join, and no part is larger than asked."""
    monkeypatch.setattr(climate, "fits", lambda df: broadcast)
    n = 4000
    lat = F.when(F.col("id") % 2 == 0, 10.0).otherwise(10 + (F.col("id") % 40) * 0.5)
    windows = spark.range(n).select("id", F.lit("T").alias("variable"), F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(500.0).cast("double").alias("level"),
                                    lat.alias("lat"), F.lit(-3.0).alias("lon"), F.col("id").cast("double").alias("value"))
    clim = spark.range(30).select(F.lit("T").alias("variable"), F.explode(F.array(F.lit(500.0), F.lit(None).cast("double"))).alias("level"),
                                  (10 + F.col("id") * 0.5).alias("lat"), F.lit(-3.0).alias("lon"), (F.col("id") * 7).cast("double").alias("clim_value"))
    plain = values(climate.subtract_climatology(windows, clim), "id", "anomaly")
    dealt = climate.subtract_climatology(windows, clim, spread=["id"], hot_rows=100)
    assert values(dealt, "id", "anomaly") == plain and plain
    sizes = climate._cell_join(windows, clim, [], ["id"], 100)
    assert "_part" not in sizes.columns and sizes.count() == len(plain)


def test_wrong_vectors_are_errors(rows):
    window = Window(1, 1, 1, 1)
    schema = "event long, variable string, rel_lat double, rel_lon double, z double"
    for bad in ([(1, "T", 0.0, 0.0, 1.0), (1, "T", 0.0, 0.0, 2.0)], [(1, "T", 5.0, 0.0, 1.0)], [(1, "X", 0.0, 0.0, 1.0)]):
        with pytest.raises(Exception, match="two values|outside the window"):
            feature_arrays(rows(schema, bad), ["event"], window, ["T"]).collect()


def test_all_frames_are_planted(spark):
    frames = spark.range(100).select(F.lit("PV").alias("variable"), F.timestamp_add("DAY", F.col("id").cast("int"), F.expr("timestamp_ntz'2000-01-01'")).alias("time"),
                                     F.lit(None).cast("double").alias("level"), F.lit(0.0).alias("lat"), F.lit(0.0).alias("lon"), F.lit(1.0).alias("value"))
    assert planted_frames(frames, copies=2).select("frame").distinct().count() == 9


def test_sweep_has_a_row_per_k(spark):
    table = as_vectors(spark.createDataFrame([([float(i % 3), 0.0],) for i in range(12)], "features array<double>"))
    got = {r["k"]: r["score"] for r in cluster.sweep(table, (2, 3, 4)).collect()}
    assert set(got) == {2, 3, 4} and got[4] is None and got[3] is not None


def test_many_groups_take_the_salted_way(spark, monkeypatch):
    from gridevents.operators import joins
    df = spark.range(500).select((F.col("id") % 7).alias("g"), F.col("id").cast("double").alias("value"))
    want = values(joins.with_group_stats(df, ["g"], {"m": F.avg("value")}, ["value"]))
    monkeypatch.setattr(joins, "fits", lambda df: False)
    monkeypatch.setattr(joins, "ROWS_PER_SALT", 2)
    assert values(joins.with_group_stats(df, ["g"], {"m": F.avg("value")}, ["value"])) == want


def test_merged_moments_are_those_of_the_whole(spark, rows):
    df = spark.range(3000).select((F.col("id") % 3).alias("cell"), (F.col("id") % 7).alias("part"),
                                  (F.lit(1e9) + F.rand(1)).alias("value")).withColumn("value", F.when(F.col("cell") < 2, F.col("value")))
    got = moments.mean_and_std(moments.merged(moments.moments(df, ["part", "cell"]), ["cell"]))
    want = df.groupBy("cell").agg(F.avg("value").alias("a"), F.stddev_pop("value").alias("s"))
    for r in got.join(want, "cell").collect():
        if r["cell"] == 2:
            assert r["mean_value"] is None and r["std_value"] is None
        else:  # small deviations of large values survive the merge
            assert abs(r["mean_value"] - r["a"]) < 1e-6 and abs(r["std_value"] - r["s"]) < 1e-6 and r["std_value"] > 0.2


def test_a_stored_year_is_replaced_and_others_stay(spark, rows):
    from gridevents.session import fresh_path
    from gridevents.sinks.tables import write_moments
    field = rows("time timestamp_ntz, lat double, value double", [
        ("2000-01-01", 1.0, 2.0), ("2000-02-01", 1.0, 4.0), ("2001-01-01", 1.0, 9.0), ("2001-01-01", 2.0, None)])
    path = fresh_path(spark, "t")
    for year in (2000, 2001, 2001):
        write_moments(field.where(F.year("time") == year), path, ["lat"])
    got = moments.merged(spark.read.parquet(path), ["lat"]).orderBy("lat").collect()
    assert [tuple(r) for r in got] == [(1.0, 3, 5.0, 26.0), (2.0, 0, None, None)]
