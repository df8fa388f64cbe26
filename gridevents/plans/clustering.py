"""From composites to clusters and their averages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from gridevents.operators.align import stacked_variables
from gridevents.operators.blocks import with_group_size
from gridevents.operators.cluster import K_RANGE, canonical_labels, sweep_scores
from gridevents.operators.features import Window, as_vectors, feature_arrays
from gridevents.operators.ordering import event_ordinals
from gridevents.operators.silhouette import chosen
from gridevents.operators.stats import batched_z_score, normalise
from gridevents.session import written

EVENT_KEY = ["algo", "loc_id", "event_time", "pos"]
FEATURE = ["variable", "rel_lat", "rel_lon"]


def positioned_events(events: DataFrame, unique: bool = False) -> DataFrame:
    """Events with their position and count per algorithm, ordered by year, place and stamp."""
    numbered = event_ordinals(events, ["algo"], ["year", "loc_id"], "pos", unique)
    return with_group_size(numbered, ["algo"], ["loc_id", "time"])


def scaled_composite(composite: DataFrame, splits: int, level_variable: str, level: float,
                     surface_variable: str, surface_level: float | None = None) -> DataFrame:
    """Two variables of a composite, scaled per feature inside blocks of events.

    The two variables are written out first: scaling reads them twice, and a
    composite is too costly to build twice.
    """
    stacked = stacked_variables(composite, level_variable, level, surface_variable, surface_level)
    return batched_z_score(written(stacked, "stacked"), FEATURE, splits, ["algo"])


def event_vectors(scaled: DataFrame, window: Window, variables: Sequence[str],
                  events: DataFrame | None = None) -> DataFrame:
    """A vector per event; with ``events`` (``EVENT_KEY``) also for those without a cell, all zeros."""
    arrays = feature_arrays(scaled, EVENT_KEY, window, variables)
    if events is not None:
        zeros = F.array_repeat(F.lit(0.0), window.size(len(variables)))
        arrays = events.select(*EVENT_KEY).join(arrays, EVENT_KEY, "left").withColumn("features", F.coalesce("features", zeros))
    return as_vectors(arrays)


def cluster_vectors(vectors: DataFrame, ks: Sequence[int] = tuple(K_RANGE), seed: int = 0) -> DataFrame:
    """Labels from the k with the best Euclidean silhouette; ``k`` is kept with them.

    The fit of the chosen k is the sweep's own (same rows and seed), so nothing is fitted twice.
    """
    models, labelled, scores = sweep_scores(written(vectors, "vectors"), ks, seed)
    k = chosen(scores)
    labels = labelled.withColumn("cluster", F.col(f"cluster_{k}")).drop(*[f"cluster_{j}" for j in models])
    return canonical_labels(labels, models[k]).withColumn("k", F.lit(k))


def cluster_events(composite: DataFrame, algorithm: str | None, window: Window, splits: int,
                   level_variable: str, level: float, surface_variable: str,
                   surface_level: float | None = None, ks: Sequence[int] = tuple(K_RANGE),
                   events: DataFrame | None = None) -> DataFrame:
    """Cluster label per event, of one algorithm, or pooled over all with ``algorithm=None``.

    Scaling is done per algorithm in both cases.  ``events`` are all events that a label
    is wanted for (see :func:`positioned_events`); those without any cell have a zero vector.
    """
    def of(df: DataFrame) -> DataFrame:
        return df if algorithm is None else df.where(F.col("algo") == algorithm)

    chosen = of(composite)
    scaled = scaled_composite(chosen, splits, level_variable, level, surface_variable, surface_level)
    variables = [level_variable.upper(), surface_variable.upper()]
    return cluster_vectors(event_vectors(scaled, window, variables, None if events is None else of(events)), ks).drop("features")


def cluster_averages(composite: DataFrame, levels: Sequence[float] | None = None) -> DataFrame:
    """Mean and normalised mean per algorithm, cluster, variable and cell.

    Level variables are normalised per level, surface variables over the window.
    """
    chosen = composite
    if levels is not None:
        chosen = composite.where(F.col("level").isNull() | F.col("level").isin([float(v) for v in levels]))
    group = ["algo", "cluster", "variable", "level"]
    means = chosen.groupBy(*group, "rel_lat", "rel_lon").agg(F.avg("value").alias("mean_value"))
    return normalise(means, group, "mean_value", "norm_value", ["rel_lat", "rel_lon"])
