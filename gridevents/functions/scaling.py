"""Scaling expressions.  Divisors of zero give NULL, not an error."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def missing_to_null(value: Column) -> Column:
    """NaN is a value to Spark's averages; NULL is skipped."""
    return F.when(~F.isnan(value), value)


def z_score(value: Column, mean: Column, std: Column, weight: float = 1.0) -> Column:
    return (value - mean) / F.nullif(std * F.lit(float(weight)), F.lit(0.0))


def min_max(value: Column, lo: Column, hi: Column) -> Column:
    """Scaled so that ``lo`` is -1 and ``hi`` is 1."""
    return F.lit(2.0) * (value - lo) / F.nullif(hi - lo, F.lit(0.0)) - F.lit(1.0)


def cell_noise(seed: int, *key: Column) -> Column:
    """Uniform noise in [0, 1) that depends on the key alone.

    Every copy of a cell gets the same noise without a join, and a re-run task
    repeats it exactly.
    """
    return F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(1 << 53)) / F.lit(float(1 << 53))


def cell_normal(seed: int, *key: Column) -> Column:
    """Standard normal noise that depends on the key alone."""
    radius = F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - cell_noise(seed, *key)))
    return radius * F.cos(F.lit(6.283185307179586) * cell_noise(seed + 1, *key))
