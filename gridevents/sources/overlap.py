"""Which stamps several files hold, from an index of stamp ranges per file.

Files of one cube seldom overlap, but where they do the first file's row counts.
The index has the first and last stamp of every file, so an interval sweep over it
finds the ranges that two files share.  Only rows in these ranges are grouped to drop
repeats; all others stream from the scan as they are, without an exchange.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from gridevents.operators.filters import keep_first
from gridevents.operators.joins import fits
from gridevents.sources.cubes import clean, in_file_order, scan_cube

CELL_KEY = ["variable", "time", "level", "lat", "lon"]
#: Shared ranges that are stated as predicates of the scan; more are joined by day.
STATED_RANGES = 64
#: Below the cube's folder; readers of the cube pass over names that begin so.
INDEX = "_ranges"


def file_ranges(cube: DataFrame, by: Sequence[str] = ("variable",), keys: Sequence[str] = tuple(CELL_KEY)) -> DataFrame:
    """(``by``, source_rank, first, last, repeats): the stamps of each file, and whether it holds a key twice.

    The ranges need a partial aggregate only; repeats inside a file are found once,
    when the index is made.
    """
    ranges = cube.groupBy(*by, "source_rank").agg(F.min("time").alias("first"), F.max("time").alias("last"))
    twice = (cube.groupBy("source_rank", *keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
             .select(*by, "source_rank").distinct().withColumn("repeats", F.lit(True)))
    return ranges.join(twice, [*by, "source_rank"], "left").withColumn("repeats", F.coalesce("repeats", F.lit(False)))


def range_index(spark: SparkSession, path: str) -> DataFrame:
    """The stored index of a cube's files; files without an entry are read and added, gone ones are left out."""
    cube = in_file_order(spark.read.parquet(path))
    present = cube.select("source_rank").distinct()
    try:
        stored = spark.read.parquet(f"{path}/{INDEX}")
    except AnalysisException:
        file_ranges(clean(cube)).write.parquet(f"{path}/{INDEX}")
        return spark.read.parquet(f"{path}/{INDEX}")
    missing = [r[0] for r in present.join(stored, "source_rank", "left_anti").collect()]  # names, as in Spark's own listing
    if missing:
        file_ranges(cube.where(F.col("source_rank").isin(missing))).write.mode("append").parquet(f"{path}/{INDEX}")
        stored = spark.read.parquet(f"{path}/{INDEX}")
    return stored.join(present, "source_rank", "left_semi")


def shared_ranges(ranges: DataFrame, by: Sequence[str] = ("variable",)) -> DataFrame:
    """(``by``, first, last): the stamp ranges held by two files or more, both ends included.

    A sweep over range ends counts the files open at each: a shared range begins where
    the count rises to two and ends where it falls to one.  The window has two rows per
    file.  A file with repeats counts twice.
    """
    held = ranges.select(*by, "first", "last").unionByName(ranges.where("repeats").select(*by, "first", "last"))
    ends = held.select(*by, F.col("first").alias("time"), F.lit(1).alias("step")).unionByName(
        held.select(*by, F.col("last").alias("time"), F.lit(-1).alias("step")))
    order = W.partitionBy(*by).orderBy("time", F.desc("step"))
    depth = F.sum("step").over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    turns = ends.withColumn("_open", depth).where("(step = 1 AND _open = 2) OR (step = -1 AND _open = 1)")
    return (turns.withColumn("last", F.lead("time").over(order)).where("step = 1")
                 .select(*by, F.col("time").alias("first"), "last"))


def first_of_files(cube: DataFrame, shared: DataFrame, by: Sequence[str] = ("variable",),
                   keys: Sequence[str] = tuple(CELL_KEY), rank: str = "source_rank") -> DataFrame:
    """Every key once, from the first file that holds it; ``rank`` is dropped.

    ``shared`` are the ranges of :func:`shared_ranges` (a wider cover is fine).  None: the
    cube as it is.  Few: both parts are plain predicates of the scan.  More: days in
    shared ranges are broadcast when counted small.  Else all rows are grouped.
    """
    alone = cube.drop(rank)
    found = shared.limit(STATED_RANGES + 1).collect()
    if not found:
        return alone
    if len(found) <= STATED_RANGES:
        kind = dict(cube.dtypes)["time"]  # as text: a Python stamp would go through the session time zone
        inside = reduce(Column.__or__, [reduce(Column.__and__, [F.col(c) == r[c] for c in by], F.col("time").between(
            F.lit(str(r["first"])).cast(kind), F.lit(str(r["last"])).cast(kind))) for r in found])
        return alone.where(~inside).unionByName(_grouped(cube.where(inside), keys, rank))
    day = F.explode(F.sequence(F.to_date("first"), F.to_date("last")))
    days = shared.select(*by, day.alias("_day")).distinct()
    if not fits(days):
        return _grouped(cube, keys, rank)
    dated = cube.withColumn("_day", F.to_date("time"))
    on = [*by, "_day"]
    return (dated.join(F.broadcast(days), on, "left_anti").drop("_day", rank)
                 .unionByName(_grouped(dated.join(F.broadcast(days), on, "left_semi").drop("_day"), keys, rank)))


def _grouped(cube: DataFrame, keys: Sequence[str], rank: str) -> DataFrame:
    return keep_first(cube, keys, rank).select(*[c for c in cube.columns if c != rank])


def read_first(spark: SparkSession, paths: str | Sequence[str], **wanted) -> DataFrame:
    """One cube from one or several stored ones: every key once, from the first path and file.

    ``wanted`` as in :func:`gridevents.sources.cubes.read_cube`.
    """
    listed = [paths] if isinstance(paths, str) else list(paths)

    def ranked(df: DataFrame, place: int) -> DataFrame:
        return df.withColumn("source_rank", F.concat_ws("|", F.format_string("%06d", F.lit(place)), "source_rank"))

    cubes = [ranked(scan_cube(in_file_order(spark.read.parquet(p)), **wanted), i) for i, p in enumerate(listed)]
    index = [ranked(range_index(spark, p), i) for i, p in enumerate(listed)]
    union = DataFrame.unionByName
    return first_of_files(reduce(union, cubes), shared_ranges(reduce(union, index)))
