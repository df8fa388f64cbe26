"""Language-model scoring from a log-frequency Bloom filter (after Talbot and Osborne, 2007).

Counting.  Every task counts the words and word pairs of its part of the corpus and
sends the counts, packed in arrays by hash range, to as many shards as the corpus
needs; a shard adds them up.  A count c is quantised to q = 1 + floor(log2 c), and the
pairs (n-gram, 1) ... (n-gram, q) enter the shard's part of the filter.

Scoring.  The filter goes to the workers.  The quantised count of an n-gram is found by
probing (n-gram, 1), (n-gram, 2), ... up to the first miss; a false count needs false
hits in a row.  With e(c) the middle of a quantised class, the model is

    p(w)     = (e(c(w)) + 0.1) / (N + 0.1 (V + 1))
    p(w | h) = (e(c(h w)) + MU p(w)) / (max(e(c(h)), e(c(h w))) + MU)

and the score of a text is the sum of log10 p over its words and its end.

The filter's size follows the corpus.  A worker holds ``segment_bits`` of it at most; a
larger filter is split by hash range and its segments are probed one after another, the
counts found so far going along in a written table.  The exact word counts of the base
score work the same at every size: the commonest words, ``head`` at most, are broadcast,
and all other words are joined by a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from gridevents.llm.frames import lists
from gridevents.llm.words import mix, slices, words
from gridevents.session import written

#: Bits of filter for each byte of text, bits that a worker holds at once, hash functions.
BITS_PER_BYTE, SEGMENT_BITS, HASHES = 0.75, 1 << 30, 3
#: Bytes of text for each shard of the counting, and tokens that a task counts before it sends.
SHARD_BYTES, FLUSH = 12 << 20, 2_000_000
#: Words with a broadcast count.
HEAD = 3_000_000
MU = 2.0

_U = np.uint64
END = _U(0x0E4D0E4D0E4D0E4D)
START = _U(0x57A2757A2757A275)
_PAIR, _LEVEL = _U(0xA24BAED4963EE407), 0x9FB21C651E98DF25


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words of every text and its end, bounds of the texts); A-Z are folded."""
    found = words(column)
    first = found.first + np.arange(len(found.first))
    out = np.full(first[-1], END, np.uint64)
    keep = np.ones(len(out), bool)
    keep[first[1:] - 1] = False
    out[keep] = found.hashes(lower=True)
    return out, first


def pairs(token: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every token with the one before it, the one before it)."""
    before = np.empty_like(token)
    before[1:] = token[:-1]
    before[first[:-1]] = START
    return mix(before * _PAIR + token), before


def shard_of(grams: np.ndarray, shards: int) -> np.ndarray:
    return ((grams >> _U(40)) * _U(shards) >> _U(24)).astype(np.int64)


def places(grams: np.ndarray, level: int, shards: int, bits: int) -> list[np.ndarray]:
    """Bits of (gram, level): in the gram's shard, ``bits`` wide."""
    h = mix(grams + _U(_LEVEL * level % 2 ** 64))
    base = shard_of(grams, shards).astype(np.uint64) * _U(bits)
    step = (h >> _U(32)) | _U(1)
    return [base + (h + _U(i) * step) % _U(bits) for i in range(HASHES)]


def quantised(count: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log2(np.maximum(count, 1))).astype(np.int64)


def expected(q: np.ndarray) -> np.ndarray:
    """The middle of the counts that are quantised to q; 0 for 0."""
    return np.where(q > 0, (3 * 2.0 ** (q - 1) - 1) / 2, 0.0)


def probe(grams: np.ndarray, filter_bytes: np.ndarray, offset: int, shards: int, bits: int) -> np.ndarray:
    """Quantised counts of sorted grams; ``filter_bytes`` starts at bit ``offset`` of the filter."""
    q, alive, level = np.zeros(len(grams), np.uint8), np.arange(len(grams)), 1
    while len(alive):
        hit = np.ones(len(alive), bool)
        for place in places(grams[alive], level, shards, bits):
            place = place - _U(offset)
            hit &= (filter_bytes[(place >> _U(3)).astype(np.int64)] >> (place & _U(7)).astype(np.uint8)) & 1 == 1
        alive = alive[hit]
        q[alive] = level
        level += 1
        if level > 60:
            break
    return q


def _counted(df: DataFrame, shards: int) -> DataFrame:
    """(shard, kind, grams, counts): packed partial counts of words (kind 1) and pairs (kind 2)."""
    def flush(kind: int, arrays: list[np.ndarray]) -> pa.RecordBatch:
        grams, counts = np.unique(np.concatenate(arrays), return_counts=True)
        bounds = np.searchsorted(shard_of(grams, shards), np.arange(shards + 1))
        return pa.record_batch([pa.array(np.arange(shards, dtype=np.int64)), pa.array([kind] * shards, pa.int32()),
                                lists(grams.view(np.int64), bounds), lists(counts.astype(np.int64), bounds)],
                               ["shard", "kind", "grams", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = {1: [], 2: []}, 0
        for batch in batches:
            for part in slices(batch, "text"):
                token, first = tokens(part["text"])
                held[1].append(token)
                held[2].append(pairs(token, first)[0])
                size += len(token)
                if size >= FLUSH:
                    yield from (flush(kind, held[kind]) for kind in held)
                    held, size = {1: [], 2: []}, 0
        if size:
            yield from (flush(kind, held[kind]) for kind in held)
    return df.mapInArrow(run, "shard long, kind int, grams array<long>, counts array<long>")


def _merged(counted: DataFrame, shards: int, bits: int) -> DataFrame:
    """Per shard: exact word counts and the shard's part of the filter."""
    def run(table):
        bitmap, rows = np.zeros(bits // 8, np.uint8), {}
        shard = table["shard"][0].as_py()
        for kind in (1, 2):
            part = table.filter(pc.equal(table["kind"], kind)).combine_chunks()
            grams = np.concatenate([x.values.to_numpy() for x in part["grams"]]) if part.num_rows else np.zeros(0, np.int64)
            counts = np.concatenate([x.values.to_numpy() for x in part["counts"]]) if part.num_rows else np.zeros(0, np.int64)
            order = np.argsort(grams.view(np.uint64))
            grams, counts = grams[order].view(np.uint64), counts[order]
            start = np.flatnonzero(np.append(True, grams[1:] != grams[:-1])) if len(grams) else np.zeros(0, np.int64)
            grams, counts = grams[start], np.add.reduceat(counts, start) if len(start) else counts
            rows[kind] = grams, counts
            q = quantised(counts)
            for level in range(1, int(q.max(initial=0)) + 1):
                for place in places(grams[q >= level], level, shards, bits):
                    place = place - _U(shard * bits)
                    np.bitwise_or.at(bitmap, (place >> _U(3)).astype(np.int64), np.left_shift(1, place & _U(7)).astype(np.uint8))
        grams, counts = rows[1]
        return pa.table([pa.array([shard]), pa.array([grams.view(np.int64)], pa.list_(pa.int64())),
                         pa.array([counts], pa.list_(pa.int64())), pa.array([bitmap.tobytes()], pa.binary())],
                        ["shard", "words", "counts", "bitmap"])
    return counted.groupBy("shard").applyInArrow(run, "shard long, words array<long>, counts array<long>, bitmap binary")


def _gathered(frame: DataFrame, column: str) -> np.ndarray:
    rows = [np.array(r[0], np.int64) for r in frame.select(column).toLocalIterator()]
    return np.concatenate(rows) if rows else np.zeros(0, np.int64)


def _head(model: DataFrame, distinct: int, head: int) -> tuple[np.ndarray, np.ndarray]:
    """Words (sorted) and counts of the words to broadcast: those of at least 2^p, the least p with room for all."""
    sizes = model.agg(*[F.sum(F.size(F.filter("counts", F.lit(1 << p).__le__))).alias(f"p{p}") for p in range(40)]).first()
    least = 1 << next(p for p in range(40) if (sizes[p] or 0) <= head or p == 39)
    picked = model.select(F.filter(F.arrays_zip("words", "counts"), lambda x: x["counts"] >= least).alias("x")) \
        .select(F.col("x.words").alias("words"), F.col("x.counts").alias("counts")) if least > 1 else model
    word, count = _gathered(picked, "words").view(np.uint64), _gathered(picked, "counts")
    order = np.argsort(word)
    return word[order], count[order]


def score(docs: DataFrame, head: int = HEAD, segment_bits: int = SEGMENT_BITS, bits_per_byte: float = BITS_PER_BYTE) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The model learns from the texts whose crc32(doc_id as text) mod 10 is not 0; a null
    doc_id counts as held out.  A null or empty text is its end alone.  Repeated rows are
    learnt and scored as often as they stand; with no text to learn from, N and V are 0
    and every known count is 0.  Texts are read whole.
    """
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 10 == 0, F.lit(True))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    spark = docs.sparkSession
    training = base.where("NOT held_out").select("text")
    size = training.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 1
    shards = max(1, -(-size // SHARD_BYTES))
    bits = max(1 << 12, int(size * bits_per_byte / shards) // 64 * 64)
    model = written(_merged(_counted(training, shards), shards, bits), "ngrams")
    end_place = (F.array_position("words", F.lit(int(END.view(np.int64)))) - 1).cast("int")
    total, distinct, ends = (int(x or 0) for x in model.agg(
        F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)), F.sum(F.size("words")),
        F.sum(F.get("counts", end_place))).first())  # as many texts began as ended
    log_whole = np.log10(total + 0.1 * (distinct + 1))
    known, counts = _head(model, distinct, head)
    tail = len(known) < distinct
    top = spark.sparkContext.broadcast((known, counts))
    per_segment = max(1, segment_bits // bits)
    ranges = [(low, min(low + per_segment, shards)) for low in range(0, shards, per_segment)]

    def scored(token, first, uni, bi, part):
        """Columns of a slice from the quantised counts."""
        known, counts = top.value
        unique, inverse = np.unique(token, return_inverse=True)
        at = np.minimum(np.searchsorted(known, unique), max(len(known) - 1, 0))
        hit = known[at] == unique if len(known) else np.zeros(len(unique), bool)
        count = np.where(hit, counts[at], 0) if len(known) else np.zeros(len(unique), np.int64)
        owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
        one = (np.log10(count + 0.1) - log_whole)[inverse]
        e1, e2 = expected(uni.astype(np.int64)), expected(bi.astype(np.int64))
        history = np.empty_like(e1)
        history[1:] = e1[:-1]
        history[first[:-1]] = ends
        p1 = (e1 + 0.1) / (total + 0.1 * (distinct + 1))
        p2 = (e2 + MU * p1) / (np.maximum(history, e2) + MU)
        n = len(first) - 1
        columns = [part["doc_id"], part["held_out"], pa.array(np.diff(first), pa.int64()),
                   pa.array(np.bincount(owner, hit[inverse], n).astype(np.int64)), pa.array(np.full(n, total, np.int64)),
                   pa.array(np.bincount(owner, one, n)), pa.array(np.bincount(owner, np.log10(p2), n))]
        if tail:
            rest = np.flatnonzero(~hit[inverse])
            bounds = np.searchsorted(owner[rest], np.arange(n + 1))
            columns.append(lists(token[rest].view(np.int64), bounds))
        return pa.record_batch(columns, names)

    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"] + ["rest"] * tail
    schema = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
              + ", rest array<long>" * tail)

    def run(number: int, low: int, high: int, bitmap, last: bool):
        def found(grams):
            unique, inverse = np.unique(grams, return_inverse=True)
            owner = shard_of(unique, shards)
            inside = (owner >= low) & (owner < high)
            q = np.zeros(len(unique), np.uint8)
            q[inside] = probe(unique[inside], bitmap.value, low * bits, shards, bits)
            return q[inverse]

        def each(batches):
            for batch in batches:
                for part in slices(batch, "text", 1 << 20):
                    token, first = tokens(part["text"])
                    uni, bi = found(token), found(pairs(token, first)[0])
                    if number:  # a gram lies in one segment: elsewhere its count is 0
                        uni = np.maximum(uni, np.frombuffer(b"".join(part["uni"].to_pylist()), np.uint8))
                        bi = np.maximum(bi, np.frombuffer(b"".join(part["bi"].to_pylist()), np.uint8))
                    if last:
                        yield scored(token, first, uni, bi, part)
                    else:
                        bounds = first.tolist()
                        split = [pa.array([x[a:b].tobytes() for a, b in zip(bounds, bounds[1:])], pa.binary()) for x in (uni, bi)]
                        yield pa.record_batch([part["doc_id"], part["held_out"], part["text"], *split],
                                              ["doc_id", "held_out", "text", "uni", "bi"])
        return each

    current = base
    for number, (low, high) in enumerate(ranges):
        rows = model.where(F.col("shard").between(low, high - 1)).select("shard", "bitmap").toLocalIterator()
        bitmap = np.zeros((high - low) * bits // 8, np.uint8)
        for shard, data in rows:
            bitmap[(shard - low) * bits // 8:][:bits // 8] = np.frombuffer(data, np.uint8)
        each = run(number, low, high, spark.sparkContext.broadcast(bitmap), high == shards)
        if high < shards:
            current = written(current.mapInArrow(each, "doc_id long, held_out boolean, text string, uni binary, bi binary"), "counts")
        else:
            current = current.mapInArrow(each, schema)
    if not tail:
        return current
    # words outside the head: their exact counts come by a join, in packed groups of equal words
    current = written(current.withColumn("_row", F.monotonically_increasing_id()), "partial")
    words_left = current.select("_row", F.explode("rest").alias("word"))
    exact = model.select(F.explode(F.arrays_zip("words", "counts")).alias("x")).select(F.col("x.words").alias("word"), F.col("x.counts").alias("count"))
    gain = F.log10(F.col("count") + F.lit(0.1)) - F.log10(F.lit(0.1))
    more = (words_left.join(exact, "word").groupBy("_row")
                      .agg(F.sum(gain).alias("gain"), F.count(F.lit(1)).alias("more")))
    return (current.join(more, "_row", "left")
                   .select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
                           "train_tokens", (F.col("base_score") + F.coalesce("gain", F.lit(0.0))).alias("base_score"), "score"))
