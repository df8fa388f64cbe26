"""Gradients on the grid and the wave mask built from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from gridevents.operators.filters import both_exceed
from gridevents.operators.stats import time_deviation


def gradient(field: DataFrame, along: str, line: Sequence[str], value: str = "value",
             name: str = "gradient") -> DataFrame:
    """Discrete gradient with unit spacing along one axis.

    Central difference inside, one-sided at the ends, NULL on a line of one
    point.  A window holds one grid line at one stamp (``line`` are all other
    dimensions), which the grid bounds to a few thousand rows.
    """
    w = W.partitionBy(*line).orderBy(along)
    here, before, after = F.col(value), F.lag(value).over(w), F.lead(value).over(w)
    slope = (F.when(before.isNull(), after - here)
              .when(after.isNull(), here - before)
              .otherwise((after - before) / 2))
    return field.withColumn(name, slope)


def wave_mask(field: DataFrame, gradient_min: float = 0.05, deviation_min: float = 0.2) -> DataFrame:
    """1 where the meridional gradient and the departure from the time mean are both large."""
    sloped = gradient(field, "lat", ["variable", "time", "level", "lon"])
    marked = time_deviation(sloped)
    return marked.withColumn("wave", both_exceed(F.col("gradient"), gradient_min,
                                                 F.col("deviation"), deviation_min))
