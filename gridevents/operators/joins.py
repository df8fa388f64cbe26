"""Join and statistics shapes shared by the operators.

Three rules hold for all of them:

* a side is broadcast only after its rows were counted (``fits``); past the
  bound the same result comes from a salted equi-join;
* a salt spreads one hot key over many tasks, and is computed from columns
  that vary inside the key;
* group statistics are aggregated first (partial, then final) and joined back,
  so no task ever holds a whole group.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from gridevents.schema import NEVER_NULL
from gridevents.session import written

#: Rows a broadcast side may have.  Rows here are about a dozen numbers wide, so
#: this is some 150 MB at most, whatever the size of the other side.
BROADCAST_ROWS = 1_000_000

#: Parts a hot key is split into, at least, and rows of a group that one part may have.
SALTS, ROWS_PER_SALT = 16, 1_000_000


def fits(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """True when ``df`` has at most ``max_rows`` rows.

    A plain count: each task counts its own rows, and nothing but counts moves.
    (A limit before the count would send that many rows per task to one task.)
    """
    return df.count() <= max_rows


def same(left: DataFrame, right: DataFrame, on: Sequence[str], prefix: str) -> Column:
    """Equality over key columns (null-safe where NULL may occur); ``right`` carries the prefix."""
    cond = F.lit(True)
    for name in on:
        a, b = left[name], right[prefix + name]
        plain = name in NEVER_NULL or name.startswith("_")
        cond = cond & ((a == b) if plain else a.eqNullSafe(b))
    return cond


def equi_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner",
              hint: bool = False, shuffled: bool = False) -> DataFrame:
    """Join on keys (see ``NEVER_NULL`` for how NULL compares); the keys appear once.

    ``hint`` broadcasts the right side.  ``shuffled`` keeps the planner from broadcasting one
    by its own estimate, which is that of the stored file and knows nothing of exploded rows.
    """
    prefix = "_r_"
    renamed = right.select([F.col(c).alias(prefix + c) if c in on else F.col(c) for c in right.columns])
    other = F.broadcast(renamed) if hint else renamed.hint("merge") if shuffled else renamed
    joined = left.join(other, same(left, renamed, on, prefix), how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[prefix + c for c in on])


def salted_join(big: DataFrame, small: DataFrame, on: Sequence[str], spread: Sequence[str],
                how: str = "inner", salts: int = SALTS, shuffled: bool = False) -> DataFrame:
    """Equi-join whose hot keys are split into ``salts`` parts.

    ``spread`` names columns of ``big`` that vary inside a key; each row of
    ``small`` is repeated once per part, so every pair still meets exactly once.
    ``shuffled`` is for a ``small`` that was counted to be too large for a broadcast.
    """
    big_side = big.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)))
    parts = F.array(*[F.lit(i).cast("long") for i in range(salts)])
    small_side = small.withColumn("_salt", F.explode(parts))
    return equi_join(big_side, small_side, [*on, "_salt"], how, shuffled=shuffled).drop("_salt")


def lookup_join(big: DataFrame, small: DataFrame, on: Sequence[str], spread: Sequence[str],
                how: str = "inner", max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join with a side that is small as a rule: broadcast if counted so, else salted."""
    if fits(small, max_rows):
        return equi_join(big, small, on, how, hint=True)
    return salted_join(big, small, on, spread, how, shuffled=True)


def group_stats(df: DataFrame, keys: Sequence[str], aggs: Mapping[str, Column]) -> DataFrame:
    return df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()])


def with_group_stats(df: DataFrame, keys: Sequence[str], aggs: Mapping[str, Column],
                     spread: Sequence[str] = ()) -> DataFrame:
    """Every row with the aggregates of its group.

    A window would sort and hold each group in one task; here groups are
    pre-aggregated and joined back, row by row against one statistics row.

    Few large groups (an algorithm, a level) are named by ``spread``: their
    statistics are written once and counted, and broadcast when they fit, so the
    rows themselves are not shuffled.  More groups than that are joined with as
    many salts as the largest of them needs.  Groups that contain the grid cell
    hold one row per stamp at most; they are joined as they are, and adaptive
    execution still splits an uneven part.
    """
    if not spread:
        return equi_join(df, group_stats(df, keys, aggs), keys)
    sized = written(group_stats(df, keys, {**aggs, "_rows": F.count(F.lit(1))}), "stats")
    stats = sized.drop("_rows")
    if fits(stats):
        return equi_join(df, stats, keys, hint=True)
    most = sized.agg(F.max("_rows")).first()[0]
    return salted_join(df, stats, keys, spread, salts=max(SALTS, -(-most // ROWS_PER_SALT)), shuffled=True)


def with_total_stats(df: DataFrame, aggs: Mapping[str, Column]) -> DataFrame:
    """Every row with aggregates of the whole input, as one scalar subquery."""
    packed = F.struct(*[c.alias(n) for n, c in aggs.items()])
    stats = df.agg(packed.alias("_stats")).scalar()
    return (df.withColumn("_stats", stats)
              .select(*df.columns, *[F.col(f"_stats.{n}").alias(n) for n in aggs]))
