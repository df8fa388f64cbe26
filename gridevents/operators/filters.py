"""Row filters.  Each is a plain predicate, so it reaches the Parquet scan.

Where a stored cube has ``year`` and ``month`` partition columns the calendar
filters use them (pruning directories); otherwise they use the stamp.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from gridevents.functions.geo import wrap_longitude
from gridevents.functions.times import month_number, parse_stamp


def select_variable(field: DataFrame, name: str, upper: bool = True) -> DataFrame:
    """Rows of one variable; its name is upper-cased in the result if asked."""
    out = field.where(F.col("variable") == name)
    return out.withColumn("variable", F.upper("variable")) if upper else out


def select_levels(field: DataFrame, levels: Sequence[float], strict: bool = False) -> DataFrame:
    """Rows on the given levels.  ``strict`` fails when a level has no row."""
    wanted = [float(v) for v in levels]
    out = field.where(F.col("level").isin(wanted))
    if not strict:
        return out
    found = field.where(F.col("level").isin(wanted)).agg(F.count_distinct("level")).scalar()
    complete = F.when(found == len(set(wanted)), True).otherwise(F.raise_error(F.lit("a requested level is missing")))
    return out.where(complete.cast("boolean"))


def select_level(field: DataFrame, level: float) -> DataFrame:
    return field.where(F.col("level") == float(level))


def select_season(df: DataFrame, season: Sequence[str]) -> DataFrame:
    """Rows whose month is one of the abbreviations, e.g. ``['Dec', 'Jan', 'Feb']``."""
    months = [month_number(m) for m in season]
    month = F.col("month") if "month" in df.columns else F.month("time")
    return df.where(month.isin(months))


def select_years(df: DataFrame, first: int, last: int | None = None) -> DataFrame:
    """Rows of the years ``first`` to ``last`` (both included)."""
    year = F.col("year") if "year" in df.columns else F.year("time")
    return df.where(year.between(first, first if last is None else last))


def select_region(df: DataFrame, lat: tuple[float, float], lon: tuple[float, float], wrap: bool = True) -> DataFrame:
    """Rows in a fixed box, edges included; the bounds may come in any order.

    With ``wrap`` longitudes are compared (and returned) in the -180..180 frame.  The
    stored longitude is one of the two frames, so the box is also stated as a range in
    each of them; these ranges are plain predicates and reach the scan.
    """
    inside = F.col("lat").between(min(lat), max(lat))
    low, high = min(lon), max(lon)
    if not wrap:
        return df.where(inside & F.col("lon").between(low, high))
    edge = 1e-6  # wrapping may move the last bits; the exact test follows
    stored = F.col("lon").between(low - edge, high + edge)
    for turn in (-360.0, 360.0):
        stored = stored | F.col("lon").between(low + turn - edge, high + turn + edge)
    return (df.where(inside & stored).withColumn("lon", wrap_longitude(F.col("lon")))
              .where(F.col("lon").between(low, high)))


def select_algorithms(df: DataFrame, names: str | Sequence[str]) -> DataFrame:
    """Rows of the named algorithms, given as a list or as comma text; path-style names are accepted."""
    listed = names.split(",") if isinstance(names, str) else list(names)
    plain = [n.strip().strip("/") for n in listed]
    stored = [form.format(n) for n in plain for form in ("{}", "/{}", "{}/", "/{}/")]
    return df.where(F.col("algo").isin(stored))


def well_formed_stamps(df: DataFrame, column: str = "stamp") -> DataFrame:
    """Rows whose text is a usable stamp; adds ``time``."""
    text = F.trim(column)
    return df.where(F.length(text) > 3).withColumn("time", parse_stamp(text)).where(F.col("time").isNotNull())


def matching_key(df: DataFrame, key: str, part: str) -> DataFrame:
    """Rows whose text key contains ``part``."""
    return df.where(F.col(key).contains(part))


def at_least(column: str, threshold: float) -> Column:
    return F.col(column) >= F.lit(float(threshold))


def both_exceed(a: Column, a_min: float, b: Column, b_min: float) -> Column:
    """1 where both magnitudes exceed their thresholds, else 0."""
    return F.when((F.abs(a) > a_min) & (F.abs(b) > b_min), 1).otherwise(0)


def keep_first(df: DataFrame, keys: Sequence[str], rank: str | Sequence[str]) -> DataFrame:
    """The first row per key in ``rank`` order.

    A partial aggregate (the least row survives on the map side) instead of a
    ranked window, so a key with very many copies costs no more than others.
    """
    order = [rank] if isinstance(rank, str) else list(rank)
    values = [c for c in df.columns if c not in keys and c not in order]
    if len(order) == 1 and len(values) == 1:
        best = F.min_by(values[0], order[0]).alias(values[0])
        return df.groupBy(*keys).agg(best, F.min(order[0]).alias(order[0]))
    best = F.min(F.struct(*order, *values)).alias("_first")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_first.{c}").alias(c) for c in [*order, *values]])


def keep_last(df: DataFrame, keys: Sequence[str], rank: str) -> DataFrame:
    """The last row per key in ``rank`` order."""
    values = [c for c in df.columns if c not in keys and c != rank]
    best = F.max(F.struct(rank, *values)).alias("_last")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_last.{c}").alias(c) for c in [rank, *values]])
