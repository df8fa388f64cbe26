"""Clustering operators.  Inputs are the stored vectors, or composites of the sample cube."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from gridevents.catalog.registry import query, r6, s6
from gridevents.operators import axes, cluster
from gridevents.operators.features import as_vectors
from gridevents.operators.silhouette import silhouettes
from gridevents.session import written


def _vectors(v):
    return as_vectors(v.vectors)


@query("m01_kmeans_sweep_fit")
def sweep_fit(v):
    table = written(_vectors(v), "vectors")
    model = cluster.fit_kmeans(table, 4)
    return model.transform(table).groupBy("cluster").agg(F.count(F.lit(1)).alias("n_points"))


@query("m02_kmeans_labels")
def labels(v):
    return cluster.fit_predict(written(_vectors(v), "vectors"), 5).select("vec_id", "cluster")


_SQUARED = "list_sum(list_transform(list_zip({a}, {b}), lambda p: power(CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE), 2)))"


@query("m03_squared_silhouette", f"""
WITH pairs AS (SELECT a.vec_id, a.label AS own, b.label AS other, count(*) AS n, sum({_SQUARED.format(a='a.embedding', b='b.embedding')}) AS total
  FROM embeddings a CROSS JOIN embeddings b GROUP BY 1,2,3),
near AS (SELECT vec_id, max(CASE WHEN own=other THEN n END) AS n, max(CASE WHEN own=other AND n>1 THEN total/(n-1) END) AS a,
  min(CASE WHEN own<>other THEN total/n END) AS b FROM pairs GROUP BY vec_id)
SELECT {s6('avg(CASE WHEN n=1 THEN 0 ELSE (b-a)/greatest(a,b) END)')} AS own_form,
  {s6('avg(CASE WHEN n=1 THEN 0 ELSE (b-a)/greatest(a,b) END)')} AS evaluator_form FROM near""")
def silhouette(v):
    own = cluster.squared_silhouette(v.vectors, "label")
    score = cluster.silhouette_score(_vectors(v).withColumnRenamed("label", "cluster"))
    return own.select(r6("silhouette", "own_form"), r6(F.lit(float(score)), "evaluator_form"))


@query("m04_k_sweep")
def sweep(v):
    return cluster.sweep(written(_vectors(v), "vectors")).select("k", "score")


def _separated(v, groups):
    """Vectors moved far apart by group: any sound clustering finds exactly these groups."""
    group = F.col("label") % groups
    return v.vectors.select("vec_id", group.alias("planted"), F.transform("features", lambda x, i: F.when(
        i == group, x + 100).otherwise(x)).alias("features"))


@query("m01_points_sum_to_table", """
SELECT CAST(count(*) AS BIGINT) AS n_points, CAST(4 AS BIGINT) AS n_clusters FROM embeddings""")
def sweep_fit_total(v):
    return sweep_fit(v).agg(F.sum("n_points").alias("n_points"), F.count(F.lit(1)).alias("n_clusters"))


@query("m02_planted_labels", """
SELECT CAST(label % 5 AS INTEGER) AS planted, CAST(count(*) AS BIGINT) AS n_points, CAST(1 AS BIGINT) AS n_clusters
FROM embeddings GROUP BY label % 5""")
def planted_labels(v):
    table = written(as_vectors(_separated(v, 5)), "vectors")
    return cluster.fit_predict(table, 5).groupBy("planted").agg(
        F.count(F.lit(1)).alias("n_points"), F.count_distinct("cluster").alias("n_clusters"))


@query("m04_planted_k", "SELECT CAST(4 AS INTEGER) AS k, CAST(4 AS BIGINT) AS n_scores, CAST(count(*) AS BIGINT) AS n_points FROM embeddings")
def planted_k(v):
    table = written(as_vectors(_separated(v, 4)), "vectors")
    scores = cluster.sweep(table, (2, 3, 4, 5))
    return axes.best_k(scores).select("k", F.lit(scores.count()).cast("long").alias("n_scores"),
                                      F.lit(table.count()).cast("long").alias("n_points"))


@query("m05_best_k", f"""
SELECT CAST(label AS INTEGER) AS k, {s6('avg(CAST(embedding[1] AS DOUBLE))')} AS score FROM embeddings GROUP BY label
ORDER BY avg(CAST(embedding[1] AS DOUBLE)) DESC, label LIMIT 1""")
def best_k(v):
    scores = v.vectors.groupBy(F.col("label").alias("k")).agg(F.avg(F.col("features")[0]).alias("score"))
    return axes.best_k(scores).select("k", r6("score"))


def _euclidean(labels: str) -> str:
    """Exact mean Euclidean silhouette per clustering, over all pairs; ``labels`` has k, vec_id, own."""
    return f"""
WITH e AS MATERIALIZED (SELECT vec_id, embedding FROM embeddings),
lab AS MATERIALIZED ({labels}),
d AS MATERIALIZED (SELECT a.vec_id AS p, b.vec_id AS q, sqrt({_SQUARED.format(a='a.embedding', b='b.embedding')}) AS d FROM e a CROSS JOIN e b),
sums AS (SELECT a.k, d.p, a.own, b.own AS other, count(*) AS n, sum(d.d) AS total
  FROM d JOIN lab a ON a.vec_id=d.p JOIN lab b ON b.vec_id=d.q AND b.k=a.k GROUP BY 1,2,3,4),
near AS (SELECT k, p, max(CASE WHEN own=other THEN n END) AS n, max(CASE WHEN own=other AND n>1 THEN total/(n-1) END) AS a,
  min(CASE WHEN own<>other THEN total/n END) AS b FROM sums GROUP BY k, p),
exact AS (SELECT k, avg(CASE WHEN n=1 OR b IS NULL THEN 0 ELSE (b-a)/greatest(a,b) END) AS score FROM near GROUP BY k)"""


_BY_LABEL = "SELECT CAST(ks.k AS INTEGER) AS k, vec_id, label % ks.k AS own FROM embeddings, (SELECT unnest([2,3,4,5]) AS k) ks"


def _labelings(v):
    """Four clusterings of the vectors that SQL can state: the label modulo k."""
    return written(v.vectors.select("vec_id", "features", *[(F.col("label") % k).alias(f"c{k}") for k in range(2, 6)]), "labelings")


@query("m05_certified_k", _euclidean(_BY_LABEL) + """
SELECT k, true AS best FROM exact ORDER BY score DESC, k LIMIT 1""")
def certified_k(v):
    """The clustering of best Euclidean silhouette, decided by bounds alone."""
    scores = silhouettes(_labelings(v), {k: f"c{k}" for k in range(2, 6)})
    return scores.where("best").select("k", "best")


@query("a17_euclidean_silhouette", _euclidean(_BY_LABEL) + f"""
SELECT k, {s6('score')} AS low, {s6('score')} AS high FROM exact""")
def euclidean_silhouette(v):
    """Bounds with a pivot for every point up to 4096 a cluster: on a table as small as the check's they meet."""
    scores = silhouettes(_labelings(v), {k: f"c{k}" for k in range(2, 6)}, first=4096, settle=False)
    return scores.select("k", r6("low"), r6("high"))


_CENTROIDS = """(SELECT label, list(m ORDER BY i) AS centroid FROM (
 SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(range(1, 65)) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) u
 GROUP BY 1,2) g GROUP BY label)"""


@query("m06_assign_nearest", f"""
SELECT vec_id, CAST(arg_min(label, d) AS INTEGER) AS cluster, {s6('min(d)')} AS distance FROM (
 SELECT e.vec_id, c.label, {_SQUARED.format(a='e.embedding', b='c.centroid')} AS d FROM embeddings e CROSS JOIN {_CENTROIDS} c) q GROUP BY vec_id""")
def assign(v):
    centroids = cluster.centroids_of(v.vectors, "label")
    out = cluster.assign_nearest(v.vectors.drop("label"), centroids)
    return out.select("vec_id", "cluster", r6("distance"))


@query("m06_centroid_update", f"""
SELECT CAST(label AS INTEGER) AS cluster, CAST(i-1 AS INTEGER) AS i, {s6('m')} AS x FROM (
 SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(range(1, 65)) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) u GROUP BY 1,2) g""")
def update(v):
    out = cluster.centroids_of(v.vectors, "label")
    return out.select("cluster", F.posexplode("centroid").alias("i", "x")).select("cluster", "i", r6("x"))


@query("m07_standard_scaler", f"""
SELECT vec_id, CAST(i-1 AS INTEGER) AS i, {s6('(x - avg(x) OVER w)/stddev_samp(x) OVER w')} AS x FROM (
 SELECT vec_id, unnest(range(1, 65)) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) u WINDOW w AS (PARTITION BY i)""")
def scaler(v):

    scaled = cluster.standard_scaled(_vectors(v))
    return scaled.select("vec_id", F.posexplode(vector_to_array("scaled")).alias("i", "x")).select("vec_id", "i", r6("x"))


@query("m08_planted_groups", """
SELECT label, CAST(count(*) AS BIGINT) AS n_points, CAST(1 AS BIGINT) AS n_clusters FROM embeddings GROUP BY label""")
def planted(v):
    """Vectors moved far apart by label: assignment to label centroids must return the label groups."""
    moved = v.vectors.withColumn("features", F.transform("features", lambda x, i: F.when(
        i == F.col("label"), x + 100).otherwise(x)))
    assigned = cluster.assign_nearest(moved, cluster.centroids_of(moved, "label"))
    return assigned.groupBy("label").agg(F.count(F.lit(1)).alias("n_points"),
                                         F.count_distinct("cluster").alias("n_clusters"))
