"""Parquet sinks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridevents.functions.text import two_digits
from gridevents.operators.axes import axis_registry
from gridevents.operators.blocks import chunk_table, with_chunks
from gridevents.operators.consensus import marked
from gridevents.operators.joins import lookup_join
from gridevents.operators.moments import moments
from gridevents.session import written


def write_partitioned(df: DataFrame, path: str, by: Sequence[str], max_rows: int = 0) -> None:
    """Compressed table, one directory per value of ``by``; ``max_rows`` cuts large files."""
    writer = df.hint("rebalance", *by).write.option("compression", "zstd")
    if max_rows:
        writer = writer.option("maxRecordsPerFile", max_rows)
    writer.partitionBy(*by).parquet(path)


def write_cube(field: DataFrame, path: str, by_time: bool = False) -> None:
    """A cube by variable, year and month: the layout that later filters prune.

    With ``by_time`` the files of a month hold stamps one after another, so that their
    ranges are disjoint (see :mod:`gridevents.sources.overlap`).
    """
    dated = field.withColumn("year", F.year("time")).withColumn("month", F.month("time"))
    if by_time:
        dated.repartitionByRange("variable", "time").write.option("compression", "zstd") \
            .partitionBy("variable", "year", "month").parquet(path)
    else:
        write_partitioned(dated, path, ["variable", "year", "month"])


def write_axes(field: DataFrame, path: str) -> None:
    """The registry of a cube's axes, beside the cube; one row an axis."""
    axis_registry(field).coalesce(1).write.parquet(path)


def write_moments(field: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Moments per key and year; a year that is stored already is replaced, all others stay as they are."""
    states = moments(field.withColumn("year", F.year("time")), ["year", *keys])
    (states.hint("rebalance", "year").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
           .option("compression", "zstd").partitionBy("year").parquet(path))


def write_monthly(df: DataFrame, path: str) -> None:
    """Output per year and two-digit month."""
    dated = df.withColumn("year", F.year("time")).withColumn("month", two_digits(F.month("time")))
    write_partitioned(dated, path, ["year", "month"])


def next_chunk(spark: SparkSession, path: str) -> int:
    """One past the highest chunk number in an existing chunk table."""
    return int(spark.read.parquet(path).agg(F.coalesce(F.max("chunk_id") + 1, F.lit(0))).first()[0])


def write_chunks(field: DataFrame, path: str, sizes: Mapping[str, int], counter: int = 0) -> DataFrame:
    """A cube in numbered blocks; numbers continue from ``counter``.

    Returns the manifest: number, stamp count, offset and stamp range per block.
    The cube is read for its axes, the manifest and the blocks, so it is built once and
    written; so is the manifest, which is counted and joined.
    """
    dims = list(sizes)
    chunked = with_chunks(written(field, "cube"), sizes)
    manifest = written(chunk_table(chunked, dims, counter), "manifest")
    keys = [f"chunk_{d}" for d in dims]
    numbered = lookup_join(chunked, manifest.select(*keys, "chunk_id"), keys, ["lat", "lon"]).drop(*keys)
    numbered.hint("rebalance", "chunk_id").write.mode("append").option("compression", "zstd") \
        .partitionBy("chunk_id").parquet(path)
    return manifest


def chunk_names(manifest: DataFrame, prefix: str) -> DataFrame:
    """Names ``prefix_first_last`` from the stamp range of each block."""
    stamp = "yyyy-MM-dd'T'HH:mm"
    return manifest.withColumn("name", F.concat_ws(
        "_", F.lit(prefix), F.date_format("first_time", stamp), F.date_format("last_time", stamp)))


def write_labels(labels: DataFrame, path: str, by: Sequence[str] = ("algo",)) -> None:
    """Cluster labels per algorithm, or pooled with ``by=()``."""
    if by:
        write_partitioned(labels, path, by)
    else:
        labels.hint("rebalance").write.option("compression", "zstd").parquet(path)


def write_consensus(field: DataFrame, days: DataFrame, path: str) -> None:
    """Both subsets of an algorithm cube, under ``consensus=true`` and ``consensus=false``."""
    write_partitioned(marked(field, days), path, ["consensus", "algo"])


def write_cluster_averages(averages: DataFrame, path: str) -> None:
    write_partitioned(averages, path, ["algo", "cluster", "variable"])
