"""Statistics that merge: count, mean and squared deviation of parts give those of the whole.

A cube that grows by a year needs only that year's rows read; what is stored of the others
is one row per key and year.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def moments(df: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """(*keys, n, mean, m2): count of present values, their mean and sum of squared deviations from it.

    A key without a present value has n = 0 and NULL for the others.
    """
    n = F.count(value)
    return df.groupBy(*keys).agg(n.alias("n"), F.avg(value).alias("mean"), (F.var_pop(value) * n).alias("m2"))


def _pair(one: Column, two: Column) -> Column:
    """Moments of two parts together; the distance of their means counts, so nothing cancels."""
    n = one["n"] + two["n"]
    apart = two["mean"] - one["mean"]
    both = F.struct(n.alias("n"), (one["mean"] + apart * two["n"] / n).alias("mean"),
                    (one["m2"] + two["m2"] + apart * apart * one["n"] * two["n"] / n).alias("m2"))
    return F.when(two["n"] == 0, one).when(one["n"] == 0, two).otherwise(both)


def merged(states: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Moments of all parts of a key; the parts of a key are the stored years, so few."""
    empty = F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("double").alias("mean"), F.lit(None).cast("double").alias("m2"))
    # sorted, so the same parts give the same last bit
    parts = F.sort_array(F.collect_list(F.struct("n", "mean", "m2")))
    total = states.groupBy(*keys).agg(F.aggregate(parts, empty, _pair).alias("_total"))
    return total.select(*keys, "_total.n", "_total.mean", "_total.m2")


def mean_and_std(states: DataFrame) -> DataFrame:
    """``mean_value`` and the population deviation ``std_value`` in place of the moments."""
    rest = [c for c in states.columns if c not in ("n", "mean", "m2")]
    return states.select(*rest, F.col("mean").alias("mean_value"), F.sqrt(F.col("m2") / F.nullif("n", F.lit(0))).alias("std_value"))
