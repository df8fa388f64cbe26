"""Small helpers shared by the operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gridevents.llm.words import SLICE_BYTES, slices
from gridevents.operators.joins import fits
from gridevents.session import written


def texts(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the key (long) and the text (null: empty), whatever else the table holds."""
    return df.select(F.col(key).cast("long").alias("doc_id"),
                     F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


def named(base: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``base`` with one of the ids; only these texts are shuffled."""
    ids = written(ids.distinct().withColumnRenamed(ids.columns[0], "doc_id"), "ids")
    return base.join(F.broadcast(ids) if fits(ids) else ids, "doc_id", "left_semi")


def give_back() -> None:
    """Freed memory of this worker process returns to the system; workers outlive their stage."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


def map_slices(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema,
               column: str = "text", done: Callable[[], None] | None = None, size: int = SLICE_BYTES) -> DataFrame:
    """``fn`` over small slices of each Arrow batch, so temporaries follow the slice, not the batch.

    ``done`` is called at the end of a partition; then freed memory is given back.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column, size):
                yield fn(part)
        if done:
            done()
        give_back()
    return df.mapInArrow(run, schema)


def lists(values: np.ndarray, first: np.ndarray) -> pa.Array:
    """An Arrow list array from flat values and the bounds of each list."""
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(values))
