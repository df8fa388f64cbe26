"""Exact top-k inner products by MaxScore over shards of postings.

A dimension is a term, a vector's component its weight there.  A shard keeps the
postings by term.  For a query, each term's contribution lies between bounds known
per shard; terms are ordered by the width of these bounds.  Once ``k`` scores are
known, the narrow terms at the end are non-essential: a vector that stays at the
lower bound in all others cannot get among the best through them alone.  Essential
postings are added up for the whole shard; non-essential terms are then probed one
after another for those vectors only whose score so far plus the remaining upper
bounds still competes.  Shards give their ``k`` best, and these are merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

#: Vectors of a shard, queries that visit a shard together.
SHARD_ROWS, QUERY_ROWS = 8192, 1024
#: Vectors scored in full first, to have a bar for the others.
SEEDS = 256
#: Scaled components of this magnitude are no 64-bit integers; the run fails, as the check SQL does.
LARGEST = 2.0 ** 63


def integers(column: pa.Array, scale: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(floor(scale * x) of every component, bounds of the vectors, whether a vector takes part)."""
    column = column.cast(pa.list_(pa.float64()))
    lengths = np.asarray(column.value_lengths().fill_null(0), np.int64)
    first = np.concatenate([[0], np.cumsum(lengths)])
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64)  # null becomes NaN
    with np.errstate(invalid="ignore", over="ignore"):
        value = np.floor(scale * flat)
    wrong = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    part = (wrong[first[1:]] == wrong[first[:-1]]) & np.asarray(column.is_valid())
    value = np.where(np.repeat(part, lengths), value, 0)
    if not (np.abs(value) < LARGEST).all():
        raise OverflowError("a scaled component leaves 64 bits")
    return value, first, part


def _matrix(rows: pa.StructArray) -> tuple[np.ndarray, np.ndarray]:
    """Ids in order and the matrix terms x vectors; a shorter vector lacks the later terms."""
    ids, vectors = rows.field("id").to_numpy(), rows.field("terms")
    lengths = vectors.value_lengths().to_numpy()
    table = np.zeros((len(ids), 1 + lengths.max(initial=0)), np.int64)
    table[:, 0] = ids
    row = np.repeat(np.arange(len(ids)), lengths)
    table[row, 1 + np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = vectors.flatten().to_numpy()
    order = np.lexsort(table.T[::-1]) if len(np.unique(ids)) < len(ids) else np.argsort(ids)
    table = table[order]
    new = np.append(True, (table[1:] != table[:-1]).any(axis=1))  # repeated rows once
    return table[new, 0], np.ascontiguousarray(table[new, 1:].T)


def best(query_id: int, query: np.ndarray, ids: np.ndarray, terms: np.ndarray, low: np.ndarray, high: np.ndarray,
         k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the ``k`` best vectors of a shard, ties to smaller ids."""
    width = min(len(query), len(terms))
    query, terms, low, high = query[:width], terms[:width], low[:width], high[:width]
    bottom, top = np.minimum(query * low, query * high), np.maximum(query * low, query * high)
    order = np.argsort(-(top - bottom), kind="stable")
    rest = np.concatenate([np.cumsum(top[order][::-1])[::-1], np.zeros(1, top.dtype)])  # what terms from here on can add
    start = min(SEEDS, len(ids))
    seeds = query @ terms[:, :start]
    own = ids[:start] == query_id
    bar = np.partition(seeds[~own], -k)[-k] if (~own).sum() >= k else None
    essential = width
    if bar is not None:  # least prefix without which no score can reach the bar
        floor = np.concatenate([np.zeros(1, bottom.dtype), np.cumsum(bottom[order])])
        essential = int(np.argmax(floor + rest < bar)) if (floor + rest < bar).any() else width
    score = np.zeros(len(ids) - start, terms.dtype)
    for t in order[:essential]:
        if query[t]:
            score += query[t] * terms[t, start:]
    alive = np.arange(len(score))
    for n in range(essential, width + 1):
        if bar is not None:
            keep = score + rest[n] >= bar
            alive, score = alive[keep], score[keep]
        if n < width:
            score = score + query[order[n]] * terms[order[n], start + alive]
    ids, score = np.concatenate([ids[:start], ids[start + alive]]), np.concatenate([seeds, score])
    keep = ids != query_id
    ids, score = ids[keep], score[keep]
    first = np.lexsort((ids, -score))[:k]
    return ids[first], score[first]


def top_k(vectors: DataFrame, queries, k: int = 5, scale: float = 256.0, key: str = "vec_id",
          vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows of largest integer inner product for every query row.

    ``queries`` is a condition that picks the query rows; all other ids are candidates.
    Components are floor(scale * x) as integers.  Vectors that are null, hold null, NaN or
    infinity and rows without id take no part; scores must fit 64 bits.  Vectors of
    unequal length are compared over the terms they share; repeated rows count once; fewer
    candidates than ``k`` give fewer rows; ties go to the smaller id.
    """
    def prepare(batches):
        for batch in batches:
            value, first, part = integers(batch["vector"], scale)
            lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(value.astype(np.int64)))
            yield pa.record_batch([batch["id"], batch["query"], lists], ["id", "query", "terms"]).filter(pa.array(part))

    picked = vectors.select(F.col(key).cast("long").alias("id"), F.coalesce(queries, F.lit(False)).alias("query"),
                            F.col(vector).cast("array<double>").alias("vector")).where("id IS NOT NULL")
    rows = picked.mapInArrow(prepare, "id long, query boolean, terms array<long>")
    total, asked = picked.agg(F.count(F.lit(1)), F.count_if("query")).first()
    shards, blocks = max(1, -(-total // SHARD_ROWS)), max(1, -(-asked // QUERY_ROWS))

    def packed(name: str, number: int, frame: DataFrame) -> DataFrame:
        """One row per shard or block: its ids and vectors."""
        return (frame.withColumn(name, F.pmod(F.xxhash64("id", F.lit(name)), F.lit(number)))
                     .groupBy(name).agg(F.collect_list(F.struct("id", "terms")).alias(f"{name}_rows")))

    shard = packed("shard", shards, rows)
    block = packed("block", blocks, rows.where("query").select("id", "terms")).withColumn(
        "shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))

    def search(batches):
        for batch in batches:
            for own, asked_rows in zip(batch["shard_rows"], batch["block_rows"]):
                ids, terms = _matrix(own.values)
                asked_ids, asked_terms = _matrix(asked_rows.values)
                bound = float(np.abs(terms.astype(float)).max(initial=0)) * float(np.abs(asked_terms.astype(float)).max(initial=0)) * (len(terms) + 1)
                kind = np.float64 if bound < 2 ** 52 else object  # exact either way
                terms, asked_terms = terms.astype(kind), asked_terms.astype(kind)
                low, high = terms.min(axis=1), terms.max(axis=1)
                out = [(q, *best(int(q), v, ids, terms, low, high, k)) for q, v in zip(asked_ids, asked_terms.T)]
                yield pa.record_batch([pa.array(np.repeat([o[0] for o in out], [len(o[1]) for o in out]), pa.int64()),
                                       pa.array(np.concatenate([o[1] for o in out]), pa.int64()),
                                       pa.array([int(s) for o in out for s in o[2]], pa.int64())],
                                      ["query_id", "vec_id", "score"])

    # blocks are repeated for every shard: the planner's estimate knows nothing of it and would broadcast them through the driver
    found = (block.join(shard.hint("merge"), "shard").select("shard_rows", "block_rows")
                  .mapInArrow(search, "query_id long, vec_id long, score long").distinct())
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
                 .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
