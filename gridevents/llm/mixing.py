"""Mixing sources to target weights by fitting subset sums of exact lengths.

A source's target is met with whole documents.  All of its documents are taken as often
as their sum goes into the target; for the remaining budget documents are counted by
exact length, and a number to take is set per length:

* most of the budget is spread over the lengths in proportion to their words, so the
  mix keeps the lengths of the source;
* the last part, a window of it, is fitted by a bounded knapsack over what is left: the
  sums within reach are marked length by length until the budget itself is reached.  If
  no sum meets it, the window grows, up to ``WINDOW`` words; the nearest sum then counts.

Which documents of a length are taken is decided by a seeded hash of their ids.  Only
lengths and their counts (a source has about sqrt(2 words) distinct lengths at most) come
together in one task; documents are numbered inside small parts of their length.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gridevents.llm.frames import map_slices
from gridevents.llm.words import words
from gridevents.operators.joins import equi_join, fits, lookup_join
from gridevents.operators.ordering import expand_copies, running_position, running_totals
from gridevents.session import written

#: Fixed by the task: weights in turn over the sources, and how often a document may be taken.
WEIGHTS, MOST = (5, 2, 1), 3
#: Words of the window at most: bounds the knapsack's memory (about 40 MB).
WINDOW = 1 << 20
#: Documents of one length that are numbered together.
PART_ROWS = 512
SEED = 20240607


def knapsack(size: np.ndarray, count: np.ndarray, budget: int) -> tuple[np.ndarray, int]:
    """(documents to take of each length, their sum): the sum nearest to ``budget``, ties to the smaller.

    ``via`` names for every sum the item that reached it first; a sum minus its item was
    reached before that item was looked at, so following it uses each item once.
    """
    taken = np.zeros(len(size), np.int64)
    reach = 2 * budget
    via = np.full(reach + 1, -1, np.int32)
    met = np.zeros(reach + 1, bool)
    met[0] = True
    items: list[tuple[int, int]] = []  # (length, copies)
    for k in np.random.default_rng(SEED).permutation(len(size)).tolist():
        left, step = min(int(count[k]), reach // int(size[k]) if size[k] else 0), 1
        while left and not met[budget]:
            copies = min(step, left)
            weight = copies * int(size[k])
            new = np.flatnonzero(met[:reach + 1 - weight] & ~met[weight:]) + weight
            met[new] = True
            via[new] = len(items)
            items.append((k, copies))
            left, step = left - copies, 2 * step
        if met[budget]:
            break
    sums = np.flatnonzero(met)
    best = int(sums[np.abs(sums - budget).argmin()])
    at = best
    while at:
        k, copies = items[via[at]]
        taken[k] += copies
        at -= copies * int(size[k])
    return taken, best


def spread(size: np.ndarray, count: np.ndarray, budget: int) -> np.ndarray:
    """Documents to take of each length in proportion to its words, in sum ``budget`` or a little less."""
    taken = np.zeros(len(size), np.int64)
    total, carry = sum(int(s) * int(n) for s, n in zip(size, count)), 0
    for k in np.argsort(-size).tolist():
        s, n = int(size[k]), int(count[k])
        if s:  # shares are kept in units of 1 / total
            carry += s * n * budget
            taken[k] = min(n, carry // (s * total))
            carry -= int(taken[k]) * s * total
    left = budget - int((taken * size).sum())
    for k in np.argsort(-size).tolist():
        if size[k]:
            more = min(int(count[k] - taken[k]), left // int(size[k]))
            taken[k] += more
            left -= more * int(size[k])
    return taken


def fit(size: np.ndarray, count: np.ndarray, target: float, window: int = WINDOW) -> tuple[int, np.ndarray]:
    """(how often all documents are taken, how many of each length once more)."""
    total = sum(int(s) * int(n) for s, n in zip(size, count))
    goal = round(target)
    whole = min(MOST, goal // total) if total else 0
    rest = goal - whole * total
    none = np.zeros(len(size), np.int64)
    if whole == MOST or rest <= 0:
        return whole, none
    best, gap, part = none, rest, max(1, rest // 16)
    while True:
        part = min(part, window, rest)
        base = spread(size, count, rest - part)
        budget = rest - int((base * size).sum())
        free = count - base
        if budget > 4 * window:  # all that is left is far longer than the window: one document at most is near
            k = int(np.where((free > 0) & (size > 0), np.abs(size - budget), np.iinfo(np.int64).max).argmin())
            more, found = none.copy(), 0
            if free[k] > 0 and 0 < size[k] < 2 * budget:
                more[k], found = 1, int(size[k])
        else:
            more, found = knapsack(size, free, budget)
        if abs(budget - found) < gap:
            best, gap = base + more, abs(budget - found)
        if not gap or part >= min(window, rest):
            return whole, best
        part *= 4


def targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS) -> DataFrame:
    """(source, words, target) from (source, words): sources by code point, null last, share all words by weight.

    A source stops at ``MOST`` times its words; the level of the others rises round by
    round until none is above.  Sums are exact; a round is one small aggregate.
    """
    start = F.coalesce("source", F.lit(""))
    keyed = sources.withColumns({"_null": F.col("source").isNull(), "_near": F.substring(start, 1, 6), "_far": F.substring(start, 1, 20)})
    placed = running_position(keyed, [], ["_null", "_near", "_far"], ["source"], "_place")
    turn = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("_place") % len(weights) + 1).cast("int"))
    placed = written(placed.select("source", "words", turn.cast("decimal(38,0)").alias("weight")), "sources")
    wide = F.col("words").cast("decimal(20,0)")
    whole, shares = (int(x or 0) for x in placed.agg(F.sum(wide), F.sum("weight")).first())

    def above(left: int, share: int):
        return F.col("weight").cast("decimal(4,0)") * F.lit(Decimal(left)) > F.lit(Decimal(MOST * share)) * wide

    left, share = whole, shares
    while True:
        capped, weight = (int(x or 0) for x in placed.where(above(left, share)).agg(F.sum(wide), F.sum("weight")).first())
        new = whole - MOST * capped, shares - weight
        if new == (left, share) or not new[1]:
            break
        left, share = new
    level = F.col("weight").cast("double") * F.lit(left / share if share else 0.0)
    return placed.select("source", "words", F.when(above(left, share), F.lit(float(MOST)) * F.col("words")).otherwise(level).alias("target"))


def mixture(docs: DataFrame, weights: Sequence[int] = WEIGHTS, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken): one row per row of ``docs``.

    ``size`` is the number of words of the whole text (null: 0), ``taken`` the words that the
    mix takes of the document, a multiple of its size.  Repeated rows are documents of
    their own and interchangeable; rows without id hash alike and are told apart by length.
    Documents without a word, and sources of such, take 0.  The same rows give the same
    mix, however they are stored.  An empty table gives no row.
    """
    def count(part: pa.RecordBatch) -> pa.RecordBatch:
        return pa.record_batch([part["doc_id"], part["source"], pa.array(words(part["text"]).counts, pa.int64())], ["doc_id", "source", "size"])

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                       F.col("text").cast("string").alias("text"))
    rows = written(map_slices(base, count, "doc_id long, source string, size long").groupBy("doc_id", "source", "size")
                   .agg(F.count(F.lit(1)).alias("copies")), "sizes")
    lengths = written(rows.groupBy("source", "size").agg(F.sum("copies").alias("n")), "lengths")
    shares = written(targets(lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("words")), weights), "targets")

    def fitted(table):
        table = table.sort_by("size")
        size, n = (table[c].to_numpy() for c in ("size", "n"))
        whole, extra = fit(size, n, table["target"][0].as_py(), window)
        return table.append_column("whole", pa.array(np.full(len(size), whole, np.int64))).append_column("extra", pa.array(extra))

    plan = written(equi_join(lengths, shares, ["source"], hint=fits(shares)).select("source", "size", "n", "words", "target")
                   .groupBy("source").applyInArrow(fitted, "source string, size long, n long, words long, target double, whole long, extra long"), "fits")
    planned = lookup_join(rows, plan, ["source", "size"], ["doc_id"])
    open_group = (F.col("extra") > 0) & (F.col("extra") < F.col("n"))
    settled = planned.where(~open_group).withColumn("picked", F.when(F.col("extra") > 0, F.col("copies")).otherwise(0))
    place = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 31))
    parts = F.ceil(F.col("n") / PART_ROWS).cast("decimal(18,0)")
    split = planned.where(open_group).withColumn("_place", place).withColumn(
        "_part", F.floor(F.col("_place") * parts / (1 << 31)).cast("long"))
    ahead = running_totals(split, ["source", "size"], ["_part"], ["_place", "doc_id"], {"_ahead": "copies"})
    chosen = ahead.withColumn("picked", F.greatest(F.lit(0), F.least("copies", F.col("extra") - F.col("_ahead")))).select(*settled.columns)
    both = F.array(F.struct((F.col("whole") + 1).alias("times"), F.col("picked").alias("rows")),
                   F.struct(F.col("whole").alias("times"), (F.col("copies") - F.col("picked")).alias("rows")))
    out = (settled.unionByName(chosen).withColumn("_x", F.explode(both)).where("_x.rows > 0")
           .select("doc_id", "source", "size", F.col("words").alias("source_size"), "target",
                   (F.col("size") * F.col("_x.times")).alias("taken"), F.lit(0).cast("long").alias("pos"), F.col("_x.rows").alias("_copies")))
    out = written(out, "mixture")
    alone = out.where("_copies = 1").drop("_copies")
    return alone.unionByName(expand_copies(out.where("_copies > 1"))).drop("pos")
