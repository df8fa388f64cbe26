"""Near-duplicate classes of documents: DartMinHash signatures, a banded join, exact checks.

1. One pass over the texts gives a key of the exact text and the hashes of the
   signature's bands.  Copies of a text are folded to the smallest doc_id first.
2. Texts that share a band meet in a bucket.  A bucket of m texts is not expanded
   into its pairs: its texts are compared with two pivots, and links are merged into
   components.  What is left are texts of a bucket in different components.  Small
   buckets give these pairs; in large ones, texts outside the bucket's main component
   meet all its texts in cells of bounded size, and a cell gives only a forest of links.
3. A pair counts when its exact similarity, from both whole texts, reaches the threshold.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gridevents.llm.components import components
from gridevents.llm.dartminhash import bands, signatures
from gridevents.llm.frames import lists, map_slices, named, texts
from gridevents.llm.words import mix, shingles, words
from gridevents.session import written

#: Words of a shingle, similarity of a link.
SHINGLE, THRESHOLD = 5, 0.8
#: Coordinates, and coordinates of a band: at similarity 0.8, plain or weighted, one pair in 17,000 shares no band.
COORDINATES, ROWS = 192, 6
#: Buckets up to this many texts give pairs in the second round; others are cut into blocks.
FULL, BLOCK = 24, 256
#: Fixed values that give pivots of different buckets different places in the id order.
_ORDERS = (0, 0x5555555555555555, 0x3333333333333333, 0x0F0F0F0F0F0F0F0F)


def weighted_shingles(hashes: np.ndarray, first: np.ndarray, size: int):
    """Distinct shingles of each text with weight 1 + log2(count): (shingle, weight, bounds)."""
    sets = len(first) - 1
    value, at = shingles(hashes, first, size)
    owner = np.searchsorted(first, at, side="right") - 1
    key = (owner.astype(np.uint64) << np.uint64(44)) | (value >> np.uint64(20))
    order = np.argsort(key)
    key, value, owner = key[order], value[order], owner[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    start = np.flatnonzero(new)
    count = np.diff(np.append(start, len(key)))
    bounds = np.zeros(sets + 1, np.int64)
    np.cumsum(np.bincount(owner[start], minlength=sets), out=bounds[1:])
    return value[start], 1 + np.log2(count) if len(count) else np.zeros(0), bounds


def sign(df: DataFrame, size: int, k: int, rows: int) -> DataFrame:
    """(doc_id, text_key, bands) of every row, by weighted and by plain signature; a text without words has no bands."""
    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        found = words(part["text"])
        shingle, weight, bounds = weighted_shingles(found.hashes(), found.first, size)
        hashes = bands(signatures(shingle, weight, bounds, k), rows)
        some = np.diff(bounds) > 0
        keep = np.zeros((len(some), 2, hashes.shape[1]), bool)
        keep[some, 0] = True
        both = np.stack([hashes, hashes], axis=1)
        # texts that repeat shingles also sign with all weights 1; of others, that is the same signature
        again = np.maximum.reduceat(np.append(weight, 0.0), np.minimum(bounds[:-1], len(weight))) > 1 if len(some) else some
        again &= some
        inside = np.repeat(again, np.diff(bounds))
        plain = bands(signatures(shingle[inside], np.ones(int(inside.sum())),
                                 np.append(0, np.cumsum(np.diff(bounds)[again])), k), rows)
        both[again, 1] = plain
        keep[again, 1] = plain != hashes[again]
        first = np.zeros(len(some) + 1, np.int64)
        np.cumsum(keep.sum(axis=(1, 2)), out=first[1:])
        keys = [hashlib.blake2b(t.as_buffer(), digest_size=16).digest() for t in part["text"]]
        return pa.record_batch([part["doc_id"], pa.array(keys, pa.binary()),
                                lists(both[keep].view(np.int64), first)], ["doc_id", "text_key", "bands"])
    return map_slices(df, run, "doc_id long, text_key binary, bands array<long>")


def similarities(one: pa.Array, two: pa.Array, size: int = SHINGLE) -> np.ndarray:
    """The larger of plain and weighted Jaccard similarity of the shingles, pair by pair."""
    keys, weights, pairs = [], [], []
    for column in (one, two):
        found = words(column)
        shingle, weight, bounds = weighted_shingles(found.hashes(), found.first, size)
        pair = np.repeat(np.arange(len(column)), np.diff(bounds))
        keys.append(mix(shingle ^ mix(pair.astype(np.uint64))))
        weights.append(weight)
        pairs.append(pair)
    key, weight, pair = np.concatenate(keys), np.concatenate(weights), np.concatenate(pairs)
    order = np.argsort(key)
    key, weight, pair = key[order], weight[order], pair[order]
    both = np.flatnonzero(key[1:] == key[:-1])
    low = np.minimum(weight[both], weight[both + 1])
    n = len(one)
    common, shared = np.bincount(pair[both], minlength=n), np.bincount(pair[both], low, n)
    plain = common / np.maximum(np.bincount(pair, minlength=n) - common, 1)
    weighted = shared / np.maximum(np.bincount(pair, weight, n) - shared, 1e-9)
    return np.maximum(plain, weighted)


def verified(pairs: DataFrame, base: DataFrame, size: int, threshold: float) -> DataFrame:
    """The pairs (a, b) whose texts are similar enough."""
    some = named(base, pairs.select("a").unionAll(pairs.select("b")))
    left = some.select(F.col("doc_id").alias("a"), F.col("text").alias("text"))
    right = some.select(F.col("doc_id").alias("b"), F.col("text").alias("other"))

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        good = similarities(part["text"], part["other"], size) >= threshold
        return part.select(["a", "b"]).filter(pa.array(good))
    return map_slices(pairs.join(left, "a").join(right, "b"), run, "a long, b long").distinct()


def forest(column: pa.Array, left: np.ndarray, size: int, threshold: float) -> list[tuple[int, int]]:
    """Links between texts and ``left`` ones of them, as few as join all that are linked.

    A weight 1 + log2(c) is the sum over j = 1..c of the gains 1, log2(2/1), log2(3/2), ...,
    so the weight that two texts share is an inner product over (shingle, j), as is the
    number of shingles that they share.
    """
    found = words(column)
    shingle, weight, bounds = weighted_shingles(found.hashes(), found.first, size)
    owner = np.repeat(np.arange(len(column)), np.diff(bounds))
    count = np.rint(2 ** (weight - 1)).astype(np.int64)
    row = np.repeat(np.arange(len(count)), count)
    j = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + 1
    gain = np.where(j > 1, np.log2(j / np.maximum(j - 1, 1)), 1.0)
    _, element = np.unique(mix(shingle[row] + j.astype(np.uint64)), return_inverse=True)
    n = len(column)
    plain, shared = np.zeros((len(left), n)), np.zeros((len(left), n))
    number = np.bincount(owner[row[j == 1]], minlength=n)
    total = np.bincount(owner[row], gain, n)
    order = np.argsort(element, kind="stable")
    element, who, gain, j = element[order], owner[row][order], gain[order], j[order]
    width = 4096  # elements at a time
    place = np.full(n, -1)
    place[left] = np.arange(len(left))
    for low in range(0, int(element.max(initial=-1)) + 1, width):
        a, b = np.searchsorted(element, [low, low + width])
        table = np.zeros((n, width), np.float64)
        table[who[a:b], element[a:b] - low] = np.sqrt(gain[a:b])
        shared += table[left] @ table.T
        table[who[a:b], element[a:b] - low] = j[a:b] == 1
        plain += table[left] @ table.T
    close = ((plain >= threshold * (number[left][:, None] + number - plain) - 1e-9)
             | (shared >= threshold * (total[left][:, None] + total - shared) - 1e-9)) & (plain > 0)
    parent, links = list(range(n)), []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for i, k in zip(*(x.tolist() for x in np.nonzero(close))):
        one, two = root(int(left[i])), root(k)
        if one != two:
            parent[one] = two
            links.append((int(left[i]), k))
    return links


def compared(members: DataFrame, base: DataFrame, size: int, threshold: float) -> DataFrame:
    """Links (a, b) between different components of large buckets (bucket, id, component, weight).

    ``weight`` is the size of the component anywhere.  Texts outside the bucket's largest
    component, in blocks, meet all its texts, in blocks; a cell of two blocks is one group.
    """
    main = members.groupBy("bucket").agg(F.max_by("component", F.struct("weight", "component")).alias("main"),
                                         F.count(F.lit(1)).alias("n"))
    sided = members.join(main, "bucket").withColumn("outside", F.col("component") != F.col("main"))
    number = sided.where("outside").groupBy("bucket").agg(F.count(F.lit(1)).alias("k"))
    sided = sided.join(number, "bucket")
    blocks, left_blocks = F.ceil(F.col("n") / BLOCK), F.ceil(F.col("k") / BLOCK)
    steps = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    place = F.xxhash64("id")
    left = sided.where("outside").select("bucket", "id", F.lit(True).alias("left"), F.pmod(place, left_blocks).alias("l"),
                                         F.explode(steps(blocks)).alias("r"))
    right = sided.select("bucket", "id", F.lit(False).alias("left"), F.explode(steps(left_blocks)).alias("l"),
                         F.pmod(place, blocks).alias("r"))
    cells = written(left.unionByName(right).groupBy("bucket", "l", "r", "id").agg(F.max("left").alias("left")), "cells")
    full = cells.join(named(base, cells.select("id")), cells["id"] == F.col("doc_id")).drop("doc_id")

    def run(table):
        table = table.combine_chunks()
        ids = table["id"].to_pylist()
        found = forest(table["text"].chunk(0), np.flatnonzero(table["left"].to_numpy()), size, threshold)
        return pa.table([pa.array([min(ids[i], ids[k]) for i, k in found], pa.int64()),
                         pa.array([max(ids[i], ids[k]) for i, k in found], pa.int64())], ["a", "b"])
    return full.groupBy("bucket", "l", "r").applyInArrow(run, "a long, b long").distinct()


def _ordered(one, two):
    return F.least(one, two).alias("a"), F.greatest(one, two).alias("b")


def links(heads: DataFrame, base: DataFrame, size: int, threshold: float) -> DataFrame:
    """(id, component) of the texts that have a link; ``heads`` has (id, bands)."""
    rows = heads.select("id", F.explode("bands").alias("bucket"))
    order = F.get(F.array(*[F.lit(v) for v in _ORDERS]), F.pmod("bucket", F.lit(len(_ORDERS))).cast("int"))
    place = F.col("id").bitwiseXOR(order)
    tops = (rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("low"), F.max(place).alias("high"))
                .where("low < high"))
    met = written(rows.join(tops, "bucket").select("bucket", "id", "n", F.col("low").bitwiseXOR(order).alias("low"),
                                                   F.col("high").bitwiseXOR(order).alias("high")), "buckets")
    pairs = written(met.select("id", F.explode(F.array("low", "high")).alias("p")).where("id <> p")
                       .select(*_ordered(F.col("id"), F.col("p"))).distinct(), "pairs")
    labels = components(written(verified(pairs, base, size, threshold), "links"))
    # a bucket of two is done; in others, texts of different components are still to compare
    sizes = labels.groupBy("component").agg(F.count(F.lit(1)).alias("weight"))
    members = (met.where("n > 2").select("bucket", "id", "n").join(labels.join(sizes, "component"), "id", "left")
                  .select("bucket", "id", "n", F.coalesce("component", "id").alias("component"),
                          F.coalesce("weight", F.lit(1)).alias("weight")))
    split = members.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    still = written(members.join(split.select("bucket"), "bucket"), "open")
    small = still.where(F.col("n") <= FULL).select("bucket", "id", "component")
    other = small.select("bucket", F.col("id").alias("p"), F.col("component").alias("c"))
    fresh = written(small.join(other, "bucket").where("id < p and component <> c").select(F.col("id").alias("a"), F.col("p").alias("b"))
                         .distinct().join(pairs, ["a", "b"], "left_anti"), "pairs")
    more = verified(fresh, base, size, threshold).unionByName(
        compared(still.where(F.col("n") > FULL).drop("n"), base, size, threshold))
    known = labels.select(F.col("id").alias("a"), F.col("component").alias("b"))
    return components(known.unionByName(more))


def near_duplicates(docs: DataFrame, size: int = SHINGLE, threshold: float = THRESHOLD,
                    k: int = COORDINATES, rows: int = ROWS) -> DataFrame:
    """(doc_id, class_id, class_size, is_kept): classes of texts joined by links.

    Two texts are linked when the plain or the weighted (1 + log2 of the count) Jaccard
    similarity of their ``size``-word shingles is at least ``threshold``; a text shorter
    than a shingle is one shingle.  ``class_id`` is the smallest doc_id of a class, and
    the document of that id is the one kept.

    One row per doc_id that is not null (rows without one take no part).  A null text is
    empty; a text without words is similar to nothing and stays alone.  Repeated rows
    are one document; a doc_id with several texts takes the smallest of their classes.
    """
    base = texts(docs).where("doc_id IS NOT NULL")
    signed = written(sign(base, size, k, rows), "signed")
    some = signed.where(F.size("bands") > 0)
    reps = written(some.groupBy("text_key").agg(F.min("doc_id").alias("rep")), "texts")
    heads = some.join(reps.select(F.col("rep").alias("doc_id"), "text_key"), ["doc_id", "text_key"], "left_semi")
    labels = links(heads.select(F.col("doc_id").alias("id"), "bands"), base, size, threshold)
    classed = (signed.select("doc_id", "text_key").join(reps, "text_key", "left")
                     .join(labels, F.col("rep") == labels["id"], "left")
                     .groupBy("doc_id").agg(F.min(F.coalesce("component", "rep", "doc_id")).alias("class_id")))
    classed = written(classed, "classes")
    sizes = classed.groupBy("class_id").agg(F.count(F.lit(1)).alias("class_size"))
    return (classed.join(sizes, "class_id")
                   .select("doc_id", "class_id", "class_size", (F.col("doc_id") == F.col("class_id")).alias("is_kept")))
