"""Repeated passages: shared k-mer seeds, collinear chains, aligned regions.

1. Minimizers of every text (k words, window w) are the seeds: two texts that share
   ``k + w - 1`` words in a row share a seed, wherever these words stand.
2. A seed that several documents hold is anchored in the smallest doc_id holding it;
   every other occurrence is a match (place here, place there) with that document.
   Occurrences are matched with the anchor only, never with each other, so the
   matches are fewer than the seeds, however many documents share a passage.
   Neighbouring seeds are anchored as pairs too: where other texts of smaller doc_id hold
   single seeds of a passage by chance, its pairs still lead to its source.
3. Matches of a document with one anchor are chained: the best chain of increasing
   places on both sides, where the distance between neighbours costs.  A Fenwick
   tree of prefix maxima over the anchor's places finds each best predecessor.
   A chain of one match is left, as common words make it by chance, unless the words
   before or after it agree too (by a hash) or two neighbouring seeds match together: a run
   of ``k + w - 1`` common words always does one of these.  A chain that lies inside a
   longer one of its document waits: it is aligned only where no region of that one was
   accepted around it.
4. The regions of a chain are extended and aligned word by word; where the whole differs
   too much, its similar regions are taken.  Aligned regions that touch are joined, and a
   passage must have ``min_words`` words.

All places are numbers of words, and what is aligned are word hashes (32 bits of them, which
decide only what an anchored region holds); texts are read for the seeds, for the hashes of
documents with chains, and for the code points of what was found.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gridevents.llm.frames import lists, map_slices, named, texts
from gridevents.llm.words import code_points, mix, shingles, words
from gridevents.session import written

#: Words of a seed, and seeds of which the smallest is taken.
SEED, WINDOW = 5, 10
MIN_WORDS, THRESHOLD = 50, 0.8
#: A chain's part must have so many words before touching parts are joined.
PART_WORDS = 14
#: Matches of a chain that other chains inside it wait for.
MIN_SEEDS = 3
#: Words of distance (both sides together) that cost as much as one seed is worth,
#: and words without a seed at which a chain is cut.
GAP_COST, GAP_CUT = 64, 40
#: Bits of an alignment that are held for its way back.
TRACE_BITS = 1 << 28
#: Words beyond the outer seeds that an alignment may reach.
MARGIN = 80


def minimizers(value: np.ndarray, owner: np.ndarray, window: int) -> np.ndarray:
    """Indices of the smallest value in every window of consecutive entries of an owner.

    Owners with fewer entries than a window have one window.
    """
    n = len(value)
    if not n:
        return np.zeros(0, np.int64)
    start = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    length = np.diff(np.append(start, n))
    left = np.repeat(start + length, length) - np.arange(n)
    best = np.arange(n)
    low = value.copy()
    for i in range(1, min(window, n)):
        later = np.full(n, np.iinfo(np.uint64).max, np.uint64)
        later[:n - i] = value[i:]
        better = (later < low) & (left > i)
        low[better] = later[better]
        best[better] = np.flatnonzero(better) + i
    whole = left >= np.minimum(window, np.repeat(length, length))
    return np.unique(best[whole])


def seeds(df: DataFrame, k: int = SEED, window: int = WINDOW) -> DataFrame:
    """(seed, doc_id, place, near, first, first_near): minimizers with their place (number of a word), and the seed's first place in its text.

    ``near`` has a byte of the ``k`` words before the seed and one of those after it, 0 where the text ends.
    """
    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        found = words(part["text"])
        value, at = shingles(found.hashes(), found.first, k)
        owner = np.searchsorted(found.first, at, side="right") - 1
        pick = minimizers(value, owner, window)
        byte = (value % np.uint64(255)).astype(np.int64) + 1
        near = np.zeros(len(value), np.int64)
        beside = owner[k:] == owner[:-k]
        near[k:] += np.where(beside, byte[:-k], 0) << 8
        near[:-k] += np.where(beside, byte[k:], 0)
        value, at, owner, near = value[pick], at[pick], owner[pick], near[pick]
        place = at - found.first[owner]
        order = np.lexsort((value, owner))  # stable: places of equal seeds stay in order
        head = np.append(True, (value[order][1:] != value[order][:-1]) | (owner[order][1:] != owner[order][:-1])) \
            if len(order) else np.zeros(0, bool)
        first, first_near = np.empty((2, len(order)), np.int64)
        top = np.flatnonzero(head)[np.cumsum(head) - 1] if len(order) else order
        first[order], first_near[order] = place[order][top], near[order][top]
        return pa.record_batch([pa.array(value.view(np.int64)), part["doc_id"].take(pa.array(owner)),
                                *(pa.array(x.astype(np.int32)) for x in (place, near, first, first_near))],
                               ["seed", "doc_id", "place", "near", "first", "first_near"])
    return map_slices(df, run, "seed long, doc_id long, place int, near int, first int, first_near int")


def useful(anchor: np.ndarray, place: np.ndarray, there: np.ndarray, sure: np.ndarray) -> zip:
    """The matches of a document that are sure or may be chained with another one of their anchor."""
    _, which, count = np.unique(anchor, return_inverse=True, return_counts=True)
    keep = sure | (count[which] > 1)
    return zip(*(x[keep].tolist() for x in (anchor, place, there, sure)))


def seed_pairs(held: DataFrame, window: int) -> DataFrame:
    """(key, doc_id, place, first, anchor, anchor2): neighbouring shared seeds of every document, with both seeds' anchors."""
    def run(batches):
        for batch in batches:
            out = [np.zeros((6, 0), np.int64)]
            for doc, rows in zip(batch["doc_id"].to_pylist(), batch["matches"]):
                seed, place, anchor = (rows.values.field(c).to_numpy() for c in ("seed", "place", "anchor"))
                order = np.lexsort((seed, place))
                seed, place, anchor = seed[order], place[order], anchor[order]
                gap = np.diff(place)
                i = np.flatnonzero((gap > 0) & (gap <= window))
                if not len(i):
                    continue
                u = seed.view(np.uint64)
                key = mix(mix(u[i]) + u[i + 1] + gap[i].astype(np.uint64)).view(np.int64)
                _, head, which = np.unique(key, return_index=True, return_inverse=True)
                out.append(np.array([key, np.full(len(i), doc), place[i], place[i][head][which], anchor[i], anchor[i + 1]]))
            kinds = [pa.int64()] * 2 + [pa.int32()] * 2 + [pa.int64()] * 2
            yield pa.record_batch([pa.array(x).cast(t) for x, t in zip(np.concatenate(out, axis=1), kinds)],
                                  ["key", "doc_id", "place", "first", "anchor", "anchor2"])
    return held.mapInArrow(run, "key long, doc_id long, place int, first int, anchor long, anchor2 long")


def outermost(extents: list[tuple]) -> list[bool]:
    """Whether each chain (first place, last place, matches, ...) lies in no other chain of ``MIN_SEEDS``."""
    out, reach = [False] * len(extents), -1
    for n in sorted(range(len(extents)), key=lambda n: (extents[n][0], -extents[n][1], -extents[n][2], *extents[n][3:])):
        out[n] = extents[n][1] > reach
        if extents[n][2] >= MIN_SEEDS:
            reach = max(reach, extents[n][1])
    return out


class PrefixMax:
    """Fenwick tree: largest (score, index) stored at positions up to a given one."""

    def __init__(self, size: int):
        self.best = [(float("-inf"), -1)] * (size + 1)

    def put(self, at: int, item: tuple[float, int]) -> None:
        at += 1
        while at < len(self.best):
            if item > self.best[at]:
                self.best[at] = item
            at += at & -at

    def up_to(self, at: int) -> tuple[float, int]:
        top = (float("-inf"), -1)
        while at > 0:
            if self.best[at] > top:
                top = self.best[at]
            at -= at & -at
        return top


def chains(places: list[tuple[int, int]], gap_cost: float = GAP_COST, gap_cut: int = GAP_CUT) -> list[list[tuple[int, int]]]:
    """Disjoint collinear chains of matches (here, there), best first taken; cut at wide gaps.

    score(j) = 1 + max(0, score(i) - (distance here + distance there) / gap_cost) over i that
    precede j on both sides; the distances split into a part of i and a part of j, so the
    best i is a prefix maximum over ``there``.
    """
    places = sorted(set(places))
    ranks = sorted({y for _, y in places})
    tree, score, back = PrefixMax(len(ranks)), [0.0] * len(places), [-1] * len(places)
    waiting: list[tuple[int, int]] = []
    for j, (x, y) in enumerate(places):
        if j and places[j - 1][0] != x:
            for i, at in waiting:
                tree.put(at, (score[i] + sum(places[i]) / gap_cost, i))
            waiting = []
        at = bisect_left(ranks, y)
        top, i = tree.up_to(at)
        gain = top - (x + y) / gap_cost
        score[j], back[j] = (1 + gain, i) if gain > 0 else (1.0, -1)
        waiting.append((j, at))
    used, out = [False] * len(places), []
    for j in sorted(range(len(places)), key=lambda j: -score[j]):
        chain = []
        while j >= 0 and not used[j]:
            used[j] = True
            chain.append(places[j])
            j = back[j]
        chain.reverse()
        part: list[tuple[int, int]] = []
        for x, y in chain:
            if part and (x - part[-1][0] > gap_cut or y - part[-1][1] > gap_cut):
                out.append(part)
                part = []
            part.append((x, y))
        if part:
            out.append(part)
    return out


def common_words(one: list, two: list) -> int:
    """Length of the longest common subsequence, bit-parallel over ``one``."""
    masks: dict = {}
    for i, w in enumerate(one):
        masks[w] = masks.get(w, 0) | 1 << i
    full, row = (1 << len(one)) - 1, (1 << len(one)) - 1
    for w in two:
        hit = row & masks.get(w, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(one) - bin(row).count("1")


def _lcs_rows(one: list, two: list) -> list[int]:
    """After each word of ``two``: bit i is 0 where the first i + 1 words of ``one`` share one word more than the first i."""
    masks: dict = {}
    for i, w in enumerate(one):
        masks[w] = masks.get(w, 0) | 1 << i
    full = row = (1 << len(one)) - 1
    rows = []
    for w in two:
        hit = row & masks.get(w, 0)
        row = ((row + hit) | (row - hit)) & full
        rows.append(row)
    return rows


def _shared_before(one: list, two: list) -> np.ndarray:
    """Common words of ``two`` with the first 0, 1, ... words of ``one``."""
    row = (1 << len(one)) - 1
    masks: dict = {}
    for i, w in enumerate(one):
        masks[w] = masks.get(w, 0) | 1 << i
    full = row
    for w in two:
        hit = row & masks.get(w, 0)
        row = ((row + hit) | (row - hit)) & full
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(one) // 8 + 1, "little"), np.uint8), bitorder="little")[:len(one)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def common_pairs(one: list, two: list) -> list[tuple[int, int]]:
    """A longest common subsequence as pairs of places; large inputs are halved, so memory stays bounded."""
    if not one or not two:
        return []
    if len(one) * len(two) > TRACE_BITS and len(two) > 1:
        half = len(two) // 2
        left, right = _shared_before(one, two[:half]), _shared_before(one[::-1], two[half:][::-1])
        at = int(np.argmax(left + right[::-1]))
        return common_pairs(one[:at], two[:half]) + [(i + at, j + half) for i, j in common_pairs(one[at:], two[half:])]
    rows, out, i, j = _lcs_rows(one, two), [], len(one) - 1, len(two) - 1
    while i >= 0 and j >= 0:
        if rows[j] >> i & 1:
            i -= 1
        elif j and not rows[j - 1] >> i & 1:
            j -= 1
        else:
            out.append((i, j))
            i, j = i - 1, j - 1
    return out[::-1]


def pieces(one: list, two: list, threshold: float, min_words: int) -> list[tuple[int, int]]:
    """Bounds (first, last word of ``one``) of the regions that are similar enough inside two sides that are not.

    Along the alignment a common word counts ``2 - 2 * threshold`` and any other word
    ``-threshold``: a region is similar enough where its sum is not negative.  Regions no
    part of which has a larger sum come first; where these are shorter than ``min_words``,
    the longest similar regions between the long ones are taken.  So every run of common
    words of ``min_words`` is inside a region, and no region that is similar enough and has
    ``min_words`` is left without one.
    """
    pairs = common_pairs(one, two)
    if not pairs:
        return []
    low, high, total, before = [], [], 0.0, (pairs[0][0] - 1, pairs[0][1] - 1)
    stack: list[tuple[int, int]] = []
    for t, (i, j) in enumerate(pairs):
        total -= threshold * (i - before[0] + j - before[1] - 2)
        low.append(total)
        total += 2 - 2 * threshold
        high.append(total)
        before, first = (i, j), t
        while True:
            n = len(stack) - 1
            while n >= 0 and low[stack[n][0]] >= low[first]:
                n -= 1
            if n < 0 or high[stack[n][1]] >= total:
                stack.append((first, t))
                break
            first = stack[n][0]
            del stack[n:]

    def grown(a: int, b: int) -> tuple[int, int, int, int]:
        """The region from common word a to b with the equal words beside it, which may have been aligned elsewhere."""
        (i, j), (last, far) = pairs[a], pairs[b]
        while i and j and one[i - 1] == two[j - 1]:
            i, j = i - 1, j - 1
        while last + 1 < len(one) and far + 1 < len(two) and one[last + 1] == two[far + 1]:
            last, far = last + 1, far + 1
        return i, last, a, b

    parts = [grown(a, b) for a, b in stack]
    out = [p for p in parts if p[1] - p[0] + 1 >= min_words]
    bounds = [-1, *(x for p in out for x in p[2:]), len(pairs)]
    open_ranges = list(zip([-1, *bounds[2::2]], bounds[1::2]))
    while open_ranges:
        after, until = open_ranges.pop()
        starts: list[int] = []
        for a in range(after + 1, until):
            if not starts or low[a] < low[starts[-1]]:
                starts.append(a)
        longest = (-1, 0, 0)
        for b in range(until - 1, after, -1):
            while starts and (starts[-1] > b or high[b] - low[starts[-1]] >= -1e-9):
                a = starts.pop()
                if a <= b:
                    longest = max(longest, (pairs[b][0] - pairs[a][0], a, b))
        if longest[0] >= 0:
            found = grown(*longest[1:])
            if found[1] - found[0] + 1 >= min_words:
                out.append(found)
                open_ranges += [(after, longest[1]), (longest[2], until)]
    out += [p for p in parts if not any(q[2] <= p[2] and p[3] <= q[3] for q in out)]
    return [p[:2] for p in out]


def extend(one: list, two: list, i: int, j: int, step: int, drop: int = 6) -> tuple[int, int]:
    """Furthest ends in direction ``step`` from words i and j: a match gives 1, a mismatch takes 2."""
    best, score, reach = 0, 0, (i, j)
    while 0 <= i + step < len(one) and 0 <= j + step < len(two) and score > best - drop:
        i, j = i + step, j + step
        score += 1 if one[i] == two[j] else -2
        if score > best:
            best, reach = score, (i, j)
    return reach


def aligned(one: list, two: list, here: tuple[int, int], there: tuple[int, int], k: int,
            threshold: float, min_words: int) -> list[tuple[int, int]]:
    """(first, last word) of a chain in ``one``; if the sides differ too much, those of its similar regions.

    ``here`` and ``there`` are the first words of the first and the last seed.
    """
    (i, last), (j, far) = here, there
    if not (i < len(one) and j < len(two)):
        return []
    last, far = min(last + k, len(one)) - 1, min(far + k, len(two)) - 1
    i, j = extend(one, two, i, j, -1)
    last, far = extend(one, two, last, far, 1)
    if last - i + 1 < PART_WORDS:
        return []
    mine, other = one[i:last + 1], two[j:far + 1]
    if mine == other or 2 * common_words(mine, other) >= threshold * (len(mine) + len(other)):
        bounds = [(0, len(mine) - 1)]
    else:
        bounds = pieces(mine, other, threshold, min_words)
    return [(i + a, i + b) for a, b in bounds if b - a + 1 >= PART_WORDS]


def word_hashes(df: DataFrame) -> DataFrame:
    """(doc_id, words): 32 bits of the hash of every word."""
    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        found = words(part["text"])
        return pa.record_batch([part["doc_id"], lists(found.hashes().astype(np.uint32).view(np.int32), found.first)],
                               ["doc_id", "words"])
    return map_slices(df, run, "doc_id long, words array<int>")


def around(df: DataFrame, column: str, first: str, last: str, start: str, k: int) -> DataFrame:
    """The array ``column`` cut to the words from ``first`` to the ``k`` words at ``last`` and ``MARGIN`` words more on both
    sides; ``start`` is the number of the first word left."""
    return (df.withColumn(start, F.greatest(F.col(first) - MARGIN, F.lit(0)))
              .withColumn(column, F.slice(column, F.col(start) + 1, F.col(last) - F.col(start) + k + MARGIN)))


def located(spans: DataFrame, base: DataFrame) -> DataFrame:
    """(doc_id, start, end, n_words, source_doc_id) in code points of ``spans`` (doc_id, first, last, source_doc_id) in words."""
    held = spans.groupBy("doc_id").agg(F.collect_list(F.struct("first", "last", "source_doc_id")).alias("spans"))

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        found = words(part["text"])
        points = code_points(found.data)
        number = part["spans"].value_lengths().to_numpy()
        row = np.repeat(np.arange(len(number)), number)
        flat = part["spans"].flatten()
        first, last = (np.minimum(flat.field(c).to_numpy(), found.counts[row] - 1) + found.first[row] for c in ("first", "last"))
        origin = points[found.text[row]]
        out = pa.StructArray.from_arrays([pa.array(points[found.start[first]] - origin), pa.array(points[found.end[last]] - origin),
                                          pa.array(last - first + 1), flat.field("source_doc_id")],
                                         ["start", "end", "n_words", "source_doc_id"])
        places = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(number)]), pa.int32()), out)
        return pa.record_batch([part["doc_id"], places], ["doc_id", "places"])
    some = named(base.where(F.col("text").rlike(r"[^\x20\x09-\x0D]")), spans.select("doc_id"))
    placed = map_slices(held.join(some, "doc_id").select("doc_id", "text", "spans"), run,
                        "doc_id long, places array<struct<start: long, end: long, n_words: long, source_doc_id: long>>")
    # repeated rows give the same places; of several texts under one id the one that holds most of them is taken
    held_words = F.aggregate("places.n_words", F.lit(0).cast("long"), lambda total, n: total + n)
    return (placed.groupBy("doc_id").agg(F.max_by("places", F.struct(held_words, "places")).alias("places"))
                  .select("doc_id", F.inline("places")))


def passages(docs: DataFrame, min_words: int = MIN_WORDS, threshold: float = THRESHOLD,
             k: int = SEED, window: int = WINDOW) -> DataFrame:
    """(doc_id, start, end, n_words, source_doc_id): passages that a document of smaller id holds too.

    A passage has ``min_words`` words or more; it consists of one or more touching regions,
    each aligned with a region of a smaller doc_id with ``2 * common / (words here + words
    there) >= threshold``; ``source_doc_id`` is that of the longest.  Places are code points,
    the end exclusive, and the spans of a document do not overlap.  The smallest doc_id of a
    passage keeps it: cutting all spans leaves one copy of every passage.

    Repeats inside one document are no passages.  Rows with a null doc_id take no part; a
    null text is empty and has none, like every text under ``min_words`` words; repeated
    rows of a doc_id count once; of several texts under one doc_id a span holds for one.
    """
    base = texts(docs).where("doc_id IS NOT NULL")
    found = seeds(base, k, window)
    anchors = (found.groupBy("seed").agg(F.min("doc_id").alias("anchor"), F.max("doc_id").alias("last"),
                                         F.min_by("first", "doc_id").alias("there"), F.min_by("first_near", "doc_id").alias("there_near"))
                    .where("anchor < last").drop("last"))
    differ = F.col("near").bitwiseXOR(F.col("there_near"))
    sure = (((differ.bitwiseAND(0xFF) == 0) & (F.col("near").bitwiseAND(0xFF) != 0))
            | ((differ.bitwiseAND(0xFF00) == 0) & (F.col("near").bitwiseAND(0xFF00) != 0)))
    matches = found.join(anchors, "seed").select("doc_id", F.struct("seed", "anchor", "place", "there", sure.alias("sure")).alias("match"))
    # bounded by the seeds of one document
    held = written(matches.groupBy("doc_id").agg(F.collect_list("match").alias("matches")), "matches")
    pairs = written(seed_pairs(held, window), "seed-pairs")
    sources = (pairs.groupBy("key").agg(F.min("doc_id").alias("source"), F.max("doc_id").alias("last"),
                                        F.min_by("first", "doc_id").alias("there"))
                    .where("source < last").drop("last"))
    more = (pairs.join(sources, "key").where("doc_id > source AND NOT (anchor = source AND anchor2 = source)")
                 .groupBy("doc_id").agg(F.collect_list(F.struct(F.col("source").alias("anchor"), "place", "there")).alias("more")))
    grouped = held.join(more, "doc_id", "left")

    def chain(part: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for doc, found, more in zip(part["doc_id"].to_pylist(), part["matches"], part["more"]):
            own = [found.values.field(c).to_numpy(zero_copy_only=False) for c in ("anchor", "place", "there", "sure")]
            if more.is_valid:
                pair = [more.values.field(c).to_numpy() for c in ("anchor", "place", "there")]
                own = [np.concatenate(x) for x in zip(own, [*pair, np.ones(len(pair[0]), bool)])]
            own = [x[own[0] < doc] for x in own]
            by_anchor: dict[int, list[tuple[int, int]]] = {}
            certain = set()
            for anchor, place, there, sure in useful(*own):
                by_anchor.setdefault(anchor, []).append((place, there))
                if sure:
                    certain.add((anchor, place, there))
            extents = []
            for anchor, places in by_anchor.items():
                for one in chains(places):
                    if len(one) == 1 and (anchor, *one[0]) not in certain:
                        continue
                    (x0, y0), (x1, y1) = one[0], one[-1]
                    extents.append((x0, x1, len(one), anchor, y0, y1))
            rows += [(doc, anchor, x0, x1, y0, y1, outer)
                     for (x0, x1, _, anchor, y0, y1), outer in zip(extents, outermost(extents))]
        return pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in
                                enumerate([pa.int64()] * 2 + [pa.int32()] * 4 + [pa.bool_()])],
                               ["doc_id", "anchor", "x0", "x1", "y0", "y1", "outer"])

    def chain_batches(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                yield chain(batch.slice(at, 256))

    regions = written(grouped.mapInArrow(chain_batches, "doc_id long, anchor long, x0 int, x1 int, y0 int, y1 int, outer boolean"),
                      "chains")

    hashed = written(word_hashes(named(base, regions.select("doc_id").unionAll(regions.select("anchor")))), "word-hashes")

    def align(batches):
        for batch in batches:
            ids, anchors, *bounds = (batch[c].to_pylist() for c in ("doc_id", "anchor", "x0", "x1", "back", "y0", "y1", "shift"))
            rows = []
            for n, (x0, x1, back, y0, y1, shift) in enumerate(zip(*bounds)):
                one, two = (batch[c][n].values.to_numpy().tolist() for c in ("words", "other"))
                rows += [(ids[n], anchors[n], back + a, back + b) for a, b in aligned(
                    one, two, (x0 - back, x1 - back), (y0 - shift, y1 - shift), k, threshold, min_words)]
            yield pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in
                                   enumerate([pa.int64()] * 2 + [pa.int32()] * 2)], ["doc_id", "anchor", "first", "last"])

    def aligned_regions(regions: DataFrame, hashed: DataFrame) -> DataFrame:
        right = hashed.select(F.col("doc_id").alias("anchor"), F.col("words").alias("other"))
        # only the words around a chain travel on, however long the texts are
        sides = around(regions.join(right, "anchor"), "other", "y0", "y1", "shift", k).join(hashed, "doc_id")
        cut = around(sides, "words", "x0", "x1", "back", k)
        return cut.mapInArrow(align, "doc_id long, anchor long, first int, last int")

    def uncovered(batches):
        """Chains that lie in no accepted region of their document."""
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                reach, ends = -1, []
                starts = sorted((p["first"], p["last"]) for p in r["accepted"] or ())
                for _, end in starts:
                    reach = max(reach, end)
                    ends.append(reach)
                for c in r["inner"]:
                    n = bisect_right(starts, (c["x0"], 1 << 40))
                    if not n or ends[n - 1] < c["x1"]:
                        rows.append((r["doc_id"], *(c[x] for x in ("anchor", "x0", "x1", "y0", "y1"))))
            yield pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in
                                   enumerate([pa.int64()] * 2 + [pa.int32()] * 4)],
                                  ["doc_id", "anchor", "x0", "x1", "y0", "y1"])

    first = written(aligned_regions(regions.where("outer"), hashed), "aligned")
    # bounded by the chains of one document
    accepted = first.groupBy("doc_id").agg(F.collect_list(F.struct("first", "last")).alias("accepted"))
    inner = regions.where("not outer").groupBy("doc_id").agg(
        F.collect_list(F.struct("anchor", "x0", "x1", "y0", "y1")).alias("inner"))
    still = written(inner.join(accepted, "doc_id", "left").mapInArrow(
        uncovered, "doc_id long, anchor long, x0 int, x1 int, y0 int, y1 int"), "inner")
    parts = first.unionByName(aligned_regions(still, named(hashed, still.select("doc_id").unionAll(still.select("anchor")))))
    # bounded by the regions of one document
    joined = parts.distinct().groupBy("doc_id").agg(F.collect_list(F.struct("first", "last", "anchor")).alias("parts"))

    def merge(batches):
        for batch in batches:
            rows = []
            for doc, parts in zip(batch["doc_id"].to_pylist(), batch["parts"].to_pylist()):
                spans: list[list] = []
                for p in sorted(parts, key=lambda p: (p["first"], p["last"])):
                    rank = (p["last"] - p["first"], -p["anchor"])
                    if spans and p["first"] <= spans[-1][1] + 1:
                        spans[-1][1:] = max(spans[-1][1], p["last"]), max(spans[-1][2], rank)
                    else:
                        spans.append([p["first"], p["last"], rank])
                rows += [(doc, a, b, -rank[1]) for a, b, rank in spans if b - a + 1 >= min_words]
            yield pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in
                                   enumerate([pa.int64(), pa.int32(), pa.int32(), pa.int64()])],
                                  ["doc_id", "first", "last", "source_doc_id"])

    spans = joined.mapInArrow(merge, "doc_id long, first int, last int, source_doc_id long")
    return located(written(spans, "spans"), base)


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the spans (code points)."""
    out, at = [], 0
    for start, end in sorted(spans):
        out.append(text[at:start])
        at = max(at, end)
    return "".join([*out, text[at:]])


def without_passages(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` with the spans of ``passages`` cut from ``text``; ``n_chars`` follows, other columns stay.

    A document that loses text and has no word left goes.
    """
    spans = found.groupBy(F.col("doc_id").alias("_doc")).agg(F.collect_list(F.struct("start", "end")).alias("_spans"))
    cutting = F.udf(lambda text, spans: cut(text or "", [(s["start"], s["end"]) for s in spans]), "string")
    joined = docs.join(spans, docs["doc_id"] == spans["_doc"], "left")
    changed = (joined.where("_doc IS NOT NULL").withColumn("text", cutting("text", "_spans"))
                     .where(F.col("text").rlike(r"[^\x20\x09-\x0D]")))
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return joined.where("_doc IS NULL").select(*docs.columns).unionByName(changed.select(*docs.columns))
