"""Silhouettes of several clusterings of one table, in two passes, with certified bounds.

The Euclidean silhouette of a point needs its mean distance to every cluster.  Pairs of
points are never formed.  A cluster is cut into cells around pivots (some of its own
points); a cell keeps its size, the sums of its points' offsets and squared offsets from
the pivot, and the least and largest distance r to it.  For a point at distance D from
the pivot

* the sum S of squared distances to the cell's n points is exact;
* every single distance lies in [lo, hi] = [max(D - r_max, r_min - D, 0), D + r_max]
  (triangle inequality);
* hence (S + n lo hi) / (lo + hi) <= sum of distances <= sqrt(n S): the chord below the
  root, and Cauchy-Schwarz.

The gap is of second order in the cell's radius and is 0 for a cell of equal points, so
more pivots give bounds as close as wanted.  Bounds of the mean distances give bounds of
every point's score and of the mean score.  Work is points x cells.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window as W, functions as F

#: Pivots of a cluster at first and at most; every refinement takes four times as many.
FIRST_PIVOTS, MOST_PIVOTS = 4, 64
#: Numbers in all pivots together at most (64 MB): they go to every task.
CELL_NUMBERS = 1 << 23
#: Relative room for rounding in the bounds.
ROUNDING = 1e-9
#: Points handled at once, as numbers in a points x cells matrix.
MATRIX = 1 << 18


@dataclass
class Cells:
    """The cells of one clustering: pivots, and the statistics of the points around each."""
    pivot: np.ndarray
    cluster: np.ndarray
    n: np.ndarray | None = None
    offset: np.ndarray | None = None
    squares: np.ndarray | None = None
    near: np.ndarray | None = None
    far: np.ndarray | None = None


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distance of every row of ``x`` to every row of ``y``."""
    middle = y.mean(axis=0)  # small numbers cancel less
    x, y = x - middle, y - middle
    square = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1) - 2.0 * (x @ y.T)
    # what is left of a cancelled sum says nothing about close points: these are measured directly
    close = np.argwhere(square < 1e-6 * ((x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)))
    if len(close):
        gap = x[close[:, 0]] - y[close[:, 1]]
        square[close[:, 0], close[:, 1]] = (gap * gap).sum(axis=1)
    return np.sqrt(np.maximum(square, 0.0))


def _points(batch: pa.RecordBatch, width: int, cells: int) -> Iterator[tuple[np.ndarray, pa.RecordBatch]]:
    step = max(1, MATRIX // max(cells, width))
    for a in range(0, batch.num_rows, step):
        part = batch.slice(a, step)
        yield part["x"].flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1), part


def _plain(labelled: DataFrame, labels: Mapping[int, str], features: str) -> DataFrame:
    kind = dict(labelled.dtypes)[features]
    x = F.col(features) if kind.startswith("array") else vector_to_array(features)
    return labelled.select(x.cast("array<double>").alias("x"), *[F.col(c).cast("long").alias(f"_{k}") for k, c in labels.items()])


def pivots(points: DataFrame, ks: Sequence[int], count: int) -> dict[int, Cells]:
    """Up to ``count`` different points of every cluster of every clustering, by hash.

    Only hashes are ranked; then the chosen points alone are fetched, clusters x ``count``.
    """
    hashed = points.withColumn("_hash", F.xxhash64("x"))
    entries = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"_{k}").alias("cluster")) for k in ks])
    each = hashed.select("_hash", F.inline(entries)).distinct()
    place = F.row_number().over(W.partitionBy("k", "cluster").orderBy("_hash"))
    chosen = each.withColumn("_place", place).where(F.col("_place") <= count).select("_hash", "k", "cluster").collect()
    wanted = sorted({r["_hash"] for r in chosen})
    picked = hashed.where(F.col("_hash").isin(wanted)).groupBy("_hash").agg(F.min("x").alias("x"))
    vectors = {r["_hash"]: np.array(r["x"]) for r in picked.collect()}
    out = {}
    for k in ks:
        own = sorted((r["cluster"], r["_hash"]) for r in chosen if r["k"] == k)
        out[k] = Cells(np.array([vectors[h] for _, h in own]), np.array([c for c, _ in own]))
    return out


def with_statistics(points: DataFrame, cells: dict[int, Cells]) -> dict[int, Cells]:
    """The cells with sizes, sums and radii: one pass, one row per task and cell is shuffled."""
    width, most = next(iter(cells.values())).pivot.shape[1], max(len(c.pivot) for c in cells.values())
    names = ["k", "cell", "n", "squares", "near", "far", "offset"]

    def run(batches):
        held = {k: (np.zeros(len(c.pivot), np.int64), np.zeros_like(c.pivot), np.zeros(len(c.pivot)),
                    np.full(len(c.pivot), np.inf), np.zeros(len(c.pivot))) for k, c in cells.items()}
        for batch in batches:
            for x, part in _points(batch, width, most):
                for k, c in cells.items():
                    n, offset, squares, near, far = held[k]
                    away = distances(x, c.pivot)
                    own = np.where(c.cluster == part[f"_{k}"].to_numpy()[:, None], away, np.inf).argmin(axis=1)
                    order = np.argsort(own, kind="stable")
                    at, start = np.unique(own[order], return_index=True)
                    gap, r = (x - c.pivot[own])[order], away[order, own[order]]
                    n[at] += np.diff(np.append(start, len(x)))
                    offset[at] += np.add.reduceat(gap, start, axis=0)
                    squares[at] += np.add.reduceat((gap * gap).sum(axis=1), start)
                    near[at] = np.minimum(near[at], np.minimum.reduceat(r, start))
                    far[at] = np.maximum(far[at], np.maximum.reduceat(r, start))
        for k, (n, offset, squares, near, far) in held.items():
            at = np.flatnonzero(n)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * width, pa.int32()), pa.array(offset[at].reshape(-1)))
            yield pa.record_batch([pa.array(np.full(len(at), k), pa.int32()), pa.array(at, pa.int32()), pa.array(n[at]), pa.array(squares[at]),
                                   pa.array(near[at]), pa.array(far[at]), lists], names)

    sums = (points.mapInArrow(run, "k int, cell int, n long, squares double, near double, far double, offset array<double>")
            .groupBy("k", "cell").agg(F.sum("n").alias("n"), F.sum("squares").alias("squares"), F.min("near").alias("near"), F.max("far").alias("far"),
                                      vector_to_array(Summarizer.sum(array_to_vector("offset"))).alias("offset")).collect())
    out = {}
    for k, c in cells.items():
        rows = sorted((r for r in sums if r["k"] == k), key=lambda r: r["cell"])
        at = [r["cell"] for r in rows]
        columns = {name: np.array([r[name] for r in rows]) for name in ("n", "squares", "near", "far", "offset")}
        out[k] = Cells(c.pivot[at], c.cluster[at], **columns)
    return out


def score(own: np.ndarray, other: np.ndarray) -> np.ndarray:
    most = np.maximum(own, other)
    return np.divide(other - own, most, out=np.zeros_like(most), where=most > 0)


def point_bounds(x: np.ndarray, own: np.ndarray, cells: Cells) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(squared silhouette, lower and upper bound of the Euclidean one) of every point."""
    names, start = np.unique(cells.cluster, return_index=True)
    size = np.add.reduceat(cells.n, start)
    away = distances(x, cells.pivot)
    inner = x @ cells.offset.T - (cells.pivot * cells.offset).sum(axis=1)
    squares = np.maximum(cells.n * away ** 2 - 2.0 * inner + cells.squares, 0.0)
    noise = ROUNDING * (cells.n * away ** 2 + cells.squares)
    low = np.maximum(0.0, np.maximum(away - cells.far, cells.near - away)) * (1 - ROUNDING)
    high = (away + cells.far) * (1 + ROUNDING)
    below = np.divide(np.maximum(squares - noise, 0.0) + cells.n * low * high, low + high, out=np.zeros_like(high), where=high > 0)
    above = np.minimum(np.sqrt(cells.n * (squares + noise)), cells.n * high)
    mine = np.searchsorted(names, own)
    rows = np.arange(len(x))

    def means(cell_sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(mean distance to the own cluster without the point, least mean distance to another one)."""
        sums = np.add.reduceat(cell_sums, start, axis=1)
        a = sums[rows, mine] / np.maximum(size[mine] - 1, 1)
        others = sums / size
        others[rows, mine] = np.inf
        return a, others.min(axis=1)

    alone = (size[mine] == 1) | (len(names) < 2)
    (sa, sb), (la, lb), (ha, hb) = means(squares), means(below), means(above)
    out = [np.where(alone, 0.0, score(np.where(alone, 0.0, a), np.where(alone, 0.0, b)))
           for a, b in ((sa, sb), (ha, lb), (la, hb))]
    return out[0], out[1], out[2]


def bounds(points: DataFrame, cells: dict[int, Cells]) -> dict[int, tuple[float, float, float]]:
    """(squared, low, high) mean silhouette per clustering, in one pass; a row per task and clustering is shuffled."""
    width, most = next(iter(cells.values())).pivot.shape[1], max(len(c.pivot) for c in cells.values())

    def run(batches):
        total = {k: np.zeros(4) for k in cells}
        for batch in batches:
            for x, part in _points(batch, width, most):
                for k, c in cells.items():
                    total[k] += [*(s.sum() for s in point_bounds(x, part[f"_{k}"].to_numpy(), c)), len(x)]
        rows = [(k, *t) for k, t in total.items()]
        yield pa.record_batch([pa.array(c) for c in zip(*rows)], ["k", "squared", "low", "high", "n"])

    sums = points.mapInArrow(run, "k long, squared double, low double, high double, n double").groupBy("k").agg(
        *[F.sum(c).alias(c) for c in ("squared", "low", "high", "n")]).collect()
    return {r["k"]: (r["squared"] / r["n"], r["low"] / r["n"], r["high"] / r["n"]) for r in sums}


def silhouettes(labelled: DataFrame, labels: Mapping[int, str], features: str = "features",
                first: int = FIRST_PIVOTS, most: int = MOST_PIVOTS, settle: bool = True) -> DataFrame:
    """(k, squared, low, high, pivots, best) of every clustering; ``labels`` maps k to its label column.

    ``low`` and ``high`` enclose the mean Euclidean silhouette.  With ``settle`` those
    clusterings whose bounds still meet the best one's are refined with four times the
    pivots, until one stands alone or ``most`` pivots, or ``CELL_NUMBERS``, are reached.  ``best`` marks the
    clustering whose lower bound is above all others' upper bounds (equal scores: the
    smallest k, when nothing is left to refine); if the bounds do not decide, no row has it.
    Points must not be null; an empty table gives no row.
    """
    spark = labelled.sparkSession
    schema = "k int, squared double, low double, high double, pivots int, best boolean"
    points = _plain(labelled, labels, features)
    if not labels or points.isEmpty():
        return spark.createDataFrame([], schema)
    found, asked, count = {}, list(labels), first
    while asked:
        cells = with_statistics(points, pivots(points, asked, count))
        for k, triple in bounds(points, cells).items():
            found[k] = (*triple, count, bool((cells[k].far == 0).all()))
        floor = max(low for _, low, _, _, _ in found.values())
        rivals = [k for k, (_, _, high, _, _) in found.items() if high >= floor]
        asked = [k for k in rivals if not found[k][4]]
        count *= 4
        size = 4 * sum(cells[k].pivot.size for k in asked if k in cells)
        if not settle or len(rivals) == 1 or count > most or size > CELL_NUMBERS:
            break
    exact = all(found[k][4] for k in rivals)
    winner = rivals[0] if len(rivals) == 1 else min(rivals, key=lambda k: (-round(found[k][1], 9), k)) if exact else None
    return spark.createDataFrame([(int(k), *map(float, v[:3]), int(v[3]), k == winner) for k, v in sorted(found.items())], schema)


def chosen(scores: DataFrame) -> int:
    """The certified k; where bounds do not decide, the k with the best middle of its bounds (the smaller on a tie)."""
    rows = scores.collect()  # one row per k
    if not rows:
        raise ValueError("the vectors are all alike or there are none: nothing to cluster")
    sure = [r["k"] for r in rows if r["best"]]
    return sure[0] if sure else min(rows, key=lambda r: (-(r["low"] + r["high"]), r["k"]))["k"]
