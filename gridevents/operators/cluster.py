"""k-means, silhouette and the choice of k, on vectors that stay distributed."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from multiprocessing.pool import ThreadPool

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.feature import StandardScaler
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

from gridevents.operators.axes import best_k
from gridevents.operators.silhouette import silhouettes
from gridevents.session import written

#: Range of k that is tried (2 to 9), and fits that run side by side.
K_RANGE = range(2, 10)
SIDE_BY_SIDE = 4


def squared_distance(a: Column, b: Column) -> Column:
    diff = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.aggregate(diff, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def centroids_of(df: DataFrame, cluster: str = "cluster", features: str = "features") -> DataFrame:
    """Mean vector per cluster, as an array: one partial aggregate of whole vectors."""
    mean = Summarizer.mean(array_to_vector(F.col(features)))
    return df.groupBy(F.col(cluster).alias("cluster")).agg(vector_to_array(mean).alias("centroid"))


def assign_nearest(df: DataFrame, centroids: DataFrame, features: str = "features") -> DataFrame:
    """Each vector with its nearest centroid (the smallest number on a tie).

    The k centroids are packed into one value and read as a scalar subquery;
    distances are expressions on the row, so nothing is joined or shuffled.
    """
    table = centroids.agg(F.collect_list(F.struct("cluster", "centroid"))).scalar()
    scored = F.transform(F.col("_table"), lambda c: F.struct(
        squared_distance(F.col(features), c["centroid"]).alias("d"), c["cluster"].alias("cluster")))
    return (df.withColumn("_table", table)
              .withColumn("_best", F.array_min(scored))
              .select(*df.columns, F.col("_best.cluster").alias("cluster"), F.col("_best.d").alias("distance")))


def fit_kmeans(df: DataFrame, k: int, seed: int = 0, features: str = "features") -> KMeansModel:
    return KMeans(k=k, seed=seed, featuresCol=features, predictionCol="cluster").fit(df)


def canonical_labels(df: DataFrame, model: KMeansModel) -> DataFrame:
    """Clusters numbered by size (largest first), ties by centroid.

    Sizes and centres are k entries of the fitted model, so the renumbering is a
    literal lookup.
    """
    sizes = model.summary.clusterSizes
    centres = [list(c) for c in model.clusterCenters()]
    order = sorted(range(len(centres)), key=lambda i: (-sizes[i], centres[i]))
    pairs = [F.lit(x) for new, old in enumerate(order) for x in (old, new)]
    return df.withColumn("cluster", F.create_map(*pairs)[F.col("cluster")])


def squared_silhouette(df: DataFrame, cluster: str = "cluster", features: str = "features") -> DataFrame:
    """One row: mean silhouette with squared Euclidean distance, over all points.

    The mean squared distance of a point to a cluster follows from the cluster's
    size, vector sum and sum of squared norms, so the cost is points x clusters,
    never points x points.  A point alone in its cluster scores 0.
    """
    points = df.select(F.col(cluster).alias("cluster"), F.col(features).alias("x"),
                       dot(F.col(features), F.col(features)).alias("norm"))
    total = vector_to_array(Summarizer.sum(array_to_vector(F.col("x"))))
    table = (points.groupBy("cluster")
             .agg(F.count(F.lit(1)).alias("n"), F.sum("norm").alias("norms"), total.alias("total"))
             .agg(F.collect_list(F.struct("cluster", "n", "norms", "total"))).scalar())
    x, norm, own = F.col("x"), F.col("norm"), F.col("cluster")
    scored = points.withColumn("_t", table)

    def distance_sum(c: Column) -> Column:
        return c["n"] * norm + c["norms"] - F.lit(2.0) * dot(x, c["total"])

    others = F.transform(F.filter("_t", lambda c: c["cluster"] != own), lambda c: distance_sum(c) / c["n"])
    mine = F.filter("_t", lambda c: c["cluster"] == own)[0]
    scored = scored.select(F.array_min(others).alias("b"), mine["n"].alias("n"), distance_sum(mine).alias("s"))
    a = F.col("s") / F.nullif(F.col("n") - 1, F.lit(0))
    score = F.coalesce((F.col("b") - a) / F.nullif(F.greatest(a, F.col("b")), F.lit(0.0)), F.lit(0.0))
    return scored.agg(F.avg(score).alias("silhouette"))


def silhouette_score(df: DataFrame, features: str = "features", cluster: str = "cluster") -> float:
    """Mean squared-Euclidean silhouette of a clustered vector table."""
    return ClusteringEvaluator(featuresCol=features, predictionCol=cluster, metricName="silhouette",
                               distanceMeasure="squaredEuclidean").evaluate(df)


def fit_all(df: DataFrame, ks: Sequence[int], seed: int = 0, features: str = "features") -> dict[int, KMeansModel]:
    """A fit per k.  Each is a chain of small jobs, so several run side by side over one stored copy."""
    table = df.select(features).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        with ThreadPool(SIDE_BY_SIDE) as pool:
            fit = inheritable_thread_target(df.sparkSession)(lambda k: (k, fit_kmeans(table, k, seed, features)))
            return dict(pool.map(fit, ks))
    finally:
        table.unpersist()


def labelled_by(df: DataFrame, models: Mapping[int, KMeansModel], features: str = "features") -> DataFrame:
    """``df`` with the label of every model, ``cluster_<k>``: one pass over the table."""
    out = df
    for k, model in models.items():
        out = model.copy({model.predictionCol: f"cluster_{k}", model.featuresCol: features}).transform(out)
    return out


def usable(df: DataFrame, ks: Sequence[int], features: str = "features") -> list[int]:
    """The k that the table has enough different vectors for."""
    different = df.select(F.xxhash64(vector_to_array(features))).distinct().count()
    return [int(k) for k in ks if k <= different]


def sweep_scores(df: DataFrame, ks: Sequence[int] = tuple(K_RANGE), seed: int = 0, features: str = "features",
                 settle: bool = True) -> tuple[dict[int, KMeansModel], DataFrame, DataFrame]:
    """(fitted models, table labelled by all of them, scores with bounds as in :func:`silhouettes`).

    All k share the passes: one labels, one sums the cells of all clusterings, one scores them.
    """
    models = fit_all(df, usable(df, ks, features), seed, features)
    labelled = written(labelled_by(df, models, features), "labelled")
    return models, labelled, silhouettes(labelled, {k: f"cluster_{k}" for k in models}, features, settle=settle)


def sweep(df: DataFrame, ks: Sequence[int] = tuple(K_RANGE), seed: int = 0,
          features: str = "features") -> DataFrame:
    """Squared silhouette of a fit per k, all k in one pass, with the bounds of the Euclidean one.

    Give a stored table (see ``written``), so that each job reads the same rows.
    One row per asked k: a k above the number of different vectors has no
    clustering, and its score is NULL.
    """
    _, _, found = sweep_scores(df, ks, seed, features, settle=False)
    asked = df.sparkSession.createDataFrame([(int(k),) for k in ks], "k int")
    return asked.join(F.broadcast(found), "k", "left").select("k", F.col("squared").alias("score"), "low", "high")


def choose_k(scores: DataFrame) -> int:
    best = best_k(scores.where("score IS NOT NULL")).first()
    if best is None:
        raise ValueError("the vectors are all alike: nothing to cluster")
    return best["k"]


def fit_predict(df: DataFrame, k: int, seed: int = 0, features: str = "features") -> DataFrame:
    """Final fit and canonical labels."""
    model = fit_kmeans(df, k, seed, features)
    return canonical_labels(model.transform(df), model)


def standard_scaled(df: DataFrame, features: str = "features", name: str = "scaled") -> DataFrame:
    """Whole-table standardising of vectors (centred, unit variance), as an option."""
    scaler = StandardScaler(inputCol=features, outputCol=name, withMean=True, withStd=True)
    return scaler.fit(df).transform(df)
