"""Centroid clustering with an incremental matrix of exact dot products.

Every kept vector is stored with its integer dot product with each centroid.  A round
compares squared distances |c|^2 - 2 v.c (|v|^2 is the same for all centroids), sums the
vectors of every cluster, and takes the floored means as new centroids.  The products are
then moved along the components in which a centroid changed, and only those:
v.c' = v.c + sum over changed j of v_j (c'_j - c_j).  Centroids that stand still cost
nothing.  Vectors never move: a round is one map over the stored table, and what is
shuffled are sums per task, cluster and component.

Integers are exact at every size.  Components below 2^27 in magnitude keep all products
and distances within 64 bits; a table with larger ones is stored as decimal digits and
worked with Python's integers, with the same results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gridevents.session import written

#: Fixed by the task: components, clusters, rounds, seed of the first centroids, scale.
WIDTH, CLUSTERS, ROUNDS, SEED, SCALE = 64, 40, 5, 2, 256.0
#: Components below this have products and distances of 64 bits.
NARROW = 1 << 27
#: Vectors handled at once.
SLICE = 1 << 14
#: Bits of a limb: sums travel as numbers of this size.
LIMB = 32


def integers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(components of the kept vectors, whether each vector is kept)."""
    column = column.cast(pa.list_(pa.float64()))
    fit = np.asarray(column.is_valid()) & (column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False) == WIDTH)
    flat = np.asarray(column.filter(pa.array(fit)).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, WIDTH)
    whole = np.isfinite(flat).all(axis=1)
    keep = np.flatnonzero(fit)[whole]
    kept = np.zeros(len(column), bool)
    kept[keep] = True
    return flat[whole], kept


def scaled(values: np.ndarray, wide: bool) -> np.ndarray:
    """Exact floor(SCALE x): int64, or Python integers (SCALE is a power of two, so large values lose no bit)."""
    if not wide:
        return np.floor(SCALE * values).astype(np.int64)
    top = np.frompyfunc(lambda x: int(SCALE) * int(x) if abs(x) >= 2.0 ** 60 else int(np.floor(SCALE * x)), 1, 1)
    return top(values)


def column(matrix: np.ndarray) -> pa.Array:
    """Rows of a matrix as an Arrow list column: numbers, or digits of Python's integers."""
    bounds = pa.array(np.arange(len(matrix) + 1) * matrix.shape[1], pa.int32())
    flat = matrix.reshape(-1)
    return pa.ListArray.from_arrays(bounds, pa.array(flat) if matrix.dtype != object else pa.array([str(x) for x in flat], pa.string()))


def matrix(lists: pa.Array, width: int) -> np.ndarray:
    flat = lists.flatten()
    if pa.types.is_string(flat.type):
        out = np.empty(len(flat), object)
        out[:] = [int(x) for x in flat.to_pylist()]
        return out.reshape(-1, width)
    return flat.to_numpy().astype(np.int64, copy=False).reshape(-1, width)


def nearest(dots: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """The centroid of least squared distance, ties to the smaller number."""
    gap = norms - 2 * dots
    return gap.argmin(axis=1).astype(np.int32) if len(gap) else np.zeros(0, np.int32)


def moved(dots: np.ndarray, vectors: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Dot products after the centroids changed by ``step``; components that did not change are not read."""
    dots = dots.copy()
    for k in np.flatnonzero((step != 0).any(axis=1)):
        part = np.flatnonzero(step[k])
        dots[:, k] += vectors[:, part] @ step[k, part]
    return dots


def _norms(matrix: np.ndarray) -> np.ndarray:
    return (matrix * matrix).sum(axis=1)


def _first(ids: DataFrame, count: int) -> list[list[int]]:
    """Components of the rows whose id hashes smallest; ties by components.  What comes to the driver is ``count`` rows."""
    key = F.sha2(F.concat(F.lit(f"{SEED}:"), F.col("vec_id").cast("string")), 256)
    rows = ids.where("vec_id IS NOT NULL").withColumn("_key", key).orderBy("_key", "floors").limit(count).select("v").collect()
    return [[int(x) for x in r[0]] for r in rows]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, SLICE):
            yield batch.slice(a, SLICE)


def _means(table: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Floored means of the clusters; an empty cluster keeps its centroid.

    A task adds up its vectors and sends the sums as limbs, which are summed as 64-bit numbers.
    """
    def run(batches):
        total, count = {}, {}
        for part in _slices(batches):
            v, own = matrix(part["v"], WIDTH), part["cluster"].to_numpy()
            for k in np.unique(own).tolist():
                rows = own == k
                total[k] = total.get(k, np.zeros(WIDTH, object)) + v[rows].sum(axis=0).astype(object)
                count[k] = count.get(k, 0) + int(rows.sum())
        out = [(k, j, limb, part) for k in total for j, x in enumerate([*total[k], count[k]]) for limb, part in limbs(int(x))]
        yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*out)] if out else [pa.array([], pa.int64())] * 4, ["k", "j", "limb", "value"])

    sums = table.select("v", "cluster").mapInArrow(run, "k long, j long, limb long, value long") \
        .groupBy("k", "j", "limb").agg(F.sum("value").alias("value")).collect()  # clusters x components, whatever the table
    total = np.zeros((len(centroids), WIDTH + 1), object)
    for k, j, limb, value in sums:
        total[k, j] += value << (LIMB * limb)
    out = centroids.copy()
    for k in np.flatnonzero(total[:, WIDTH]):
        out[k] = [x // total[k, WIDTH] for x in total[k, :WIDTH]]
    return out


def limbs(x: int) -> list[tuple[int, int]]:
    """(place, part) with x = sum of part * 2^(LIMB place); all parts but the last are not negative."""
    out, place = [], 0
    while not -(1 << LIMB) <= x < 1 << LIMB:
        out.append((place, x & ((1 << LIMB) - 1)))
        x >>= LIMB
        place += 1
    return [*out, (place, x)]


def _long(values: np.ndarray) -> pa.Array:
    """64-bit numbers; what does not fit is null."""
    if values.dtype != object:
        return pa.array(values)
    return pa.array([x if x < 1 << 63 else None for x in values.tolist()], pa.int64())


def clusters(vectors: DataFrame, count: int = CLUSTERS, rounds: int = ROUNDS, key: str = "vec_id",
             vector: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256): one row per kept vector.

    Kept are vectors of exactly ``WIDTH`` components, none null, NaN or infinite, as integers
    floor(256 x).  The first centroids are those of the ``count`` rows with the smallest
    sha256 of ``2:<vec_id>`` (fewer rows: fewer clusters); rows without id start none but
    are clustered, unless nothing could start.  Repeated rows count as often as they stand.
    Distances and their sums are null where they leave 64 bits.  An empty table gives no row.
    """
    spark = vectors.sparkSession
    base = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("x")).where("x IS NOT NULL")

    def largest(batches):
        for part in _slices(batches):
            value, _ = integers(part["x"])
            if len(value):
                yield pa.record_batch([pa.array([float(np.abs(value).max()) * SCALE])], ["top"])

    top = base.mapInArrow(largest, "top double").agg(F.max("top")).first()[0]
    empty = spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    if top is None:
        return empty
    wide = top + 1 >= NARROW
    kind, small = ("string", "string") if wide else ("long", "smallint" if top + 1 < 1 << 15 else "int")
    number = {"smallint": np.int16, "int": np.int32, "string": object}[small]

    def prepare(batches):
        for part in _slices(batches):
            value, kept = integers(part["x"])
            with np.errstate(over="ignore"):
                floors = np.floor(SCALE * value)
            yield pa.record_batch([part["vec_id"].filter(pa.array(kept)), column(scaled(value, wide).astype(number)), column(floors)],
                                  ["vec_id", "v", "floors"])

    kept = base.mapInArrow(prepare, f"vec_id long, v array<{small}>, floors array<double>")
    first = _first(kept, count)
    if not first:
        return empty
    centroids = np.array(first, dtype=object)
    exact = object if wide else np.int64

    def assigned(centroids: np.ndarray, step: np.ndarray | None):
        """A map that brings the products to ``centroids`` and assigns; ``step`` None: from nothing."""
        target, norms = centroids.astype(exact), _norms(centroids.astype(exact))
        change = target if step is None else step.astype(exact)

        def run(batches):
            for part in _slices(batches):
                v = matrix(part["v"], WIDTH)
                dots = np.zeros((len(v), len(target)), exact) if step is None else matrix(part["dots"], len(target))
                dots = moved(dots, v, change)
                yield pa.record_batch([part["vec_id"], part["v"], column(dots), pa.array(nearest(dots, norms))],
                                      ["vec_id", "v", "dots", "cluster"])
        return run

    schema = f"vec_id long, v array<{small}>, dots array<{kind}>, cluster int"
    table = written(kept.mapInArrow(assigned(centroids, None), schema), "dots")
    for number_of_round in range(1, rounds + 1):
        new = _means(table, centroids)
        step, centroids = new - centroids, new
        if number_of_round < rounds:
            table = written(table.mapInArrow(assigned(centroids, step), schema), "dots")

    target = centroids.astype(exact)
    norms, change = _norms(target), (step if rounds else np.zeros_like(centroids)).astype(exact)

    def last(batches):
        for part in _slices(batches):
            v = matrix(part["v"], WIDTH)
            dots = moved(matrix(part["dots"], len(target)), v, change)
            own = nearest(dots, norms)
            distance = _norms(v) + norms[own] - 2 * dots[np.arange(len(v)), own]
            yield pa.record_batch([part["vec_id"], pa.array(own), _long(distance)], ["vec_id", "cluster", "distance"])

    final = written(table.mapInArrow(last, "vec_id long, cluster int, distance long"), "clusters")
    whole = F.when(F.count(F.lit(1)) == F.count("distance"), F.sum(F.col("distance").cast("decimal(38,0)")))
    sums = {r[0]: r[1] for r in final.groupBy("cluster").agg(whole).collect()}
    fits = lambda x: int(x) if x is not None and x < 1 << 63 else None
    inertia = fits(sum(sums.values())) if None not in sums.values() else None
    digest = [hashlib.sha256(",".join(str(x) for x in row).encode()).hexdigest() for row in centroids]
    facts = spark.createDataFrame([(k, fits(x), inertia, digest[k]) for k, x in sums.items()],
                                  "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return final.join(F.broadcast(facts), "cluster").select(*empty.columns)  # one row per cluster
