"""Phrase collocations by best-first branch and bound over prefixes.

A phrase grows word by word from its first word.  Cutting a phrase after a prefix p
scores at most floor(1000 n / f(p)), as no phrase is more frequent than its rest: the
count of the first word bounds every phrase that grows from it, and a prefix that is
too rare itself has no phrase below it.  So first words are expanded from the highest
bound down, in a few waves per language.  After each wave the best bound on the
frontier is known; phrases whose own bound beats it get their exact score, and a
language is settled when ``top`` surviving scores lie above its frontier (ties of the
last one could only be below).  Settled languages are not expanded further.

The corpus is coded once: hashes of words frequent enough to be in a phrase, 0 where
a piece ends or a rare word stands.  Every level of a wave is one pass over the code:
bit tables of the band's first words and of the frequent prefixes pick the places to
extend, tasks count what they extend, and the counts are summed by a shuffle.  A bit
table has a bounded size and may let through more than it holds; it only ever picks
whole n-grams, so their counts stay exact and strangers fall out of the next join.
Equal 64-bit hashes are taken for equal words and phrases.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window, functions as F

from gridevents.llm.frames import give_back, lists
from gridevents.llm.words import Words, mix, slices, words
from gridevents.session import written

#: Fixed by the task: words of a phrase, least count, rows per language, and the separators of pieces.
LONGEST, LEAST, TOP = 5, 100, 2000
PIECE_ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
#: Share of a language's coded words that the first waves expand together; one more wave takes the rest.
SHARES = (1 / 16, 1 / 4)
#: Bits of a bit table at most (32 MB); beyond, it lets more through.
TABLE_BITS = 1 << 28
#: Entries a task holds before it counts and sends them, tokens handled at once.
FLUSH, CHUNK = 1 << 20, 1 << 19

_U = np.uint64
_STEP = _U(0xD1342543DE82EF95)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[list(PIECE_ENDS)] = 0x20
_ENDS = np.zeros(256, bool)
_ENDS[list(PIECE_ENDS)] = True


def extend(prefix: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a phrase from the hashes of its prefix (a word's own, for one word) and its last word."""
    return mix(prefix * _STEP + word)


def split(column: pa.Array) -> tuple[Words, np.ndarray]:
    """Folded words of every text, and whether a piece begins with the word."""
    column = column.cast(pa.large_string()).fill_null("")
    bounds = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1 + column.offset)[column.offset:]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[bounds[0]:bounds[-1]]
    ends = np.concatenate([[0], np.cumsum(_ENDS[data])])
    found = words(pa.LargeStringArray.from_buffers(len(column), pa.py_buffer((bounds - bounds[0]).tobytes()),
                                                   pa.py_buffer(_FOLD[data].tobytes())))
    begins = np.ones(len(found.start), bool)
    begins[1:] = ends[found.start[1:]] > ends[found.start[:-1]]
    begins[found.first[:-1][found.first[:-1] < len(begins)]] = True
    return found, begins


def hashed(found: Words, langs: pa.Array) -> np.ndarray:
    """Hash of every word in its language, never 0."""
    coded = langs.dictionary_encode()
    salt = np.array([int.from_bytes(blake2b(x.encode(), digest_size=8).digest(), "little") for x in coded.dictionary.to_pylist()], _U)
    own = np.repeat(salt[coded.indices.to_numpy()], found.counts) if len(salt) else np.zeros(0, _U)
    return np.maximum(mix(found.hashes() + own), _U(1))


def inside(table: np.ndarray, grams: np.ndarray) -> np.ndarray:
    place = grams & _U(len(table) * 8 - 1)
    return (table[(place >> _U(3)).astype(np.int64)] >> (place & _U(7)).astype(np.uint8)) & 1 == 1


def bit_table(hashes: DataFrame) -> Broadcast:
    """A broadcast bit table of the column ``hash``: 64 bits an entry, ``TABLE_BITS`` at most."""
    bits = max(1 << 16, min(TABLE_BITS, 1 << (64 * hashes.count()).bit_length()))
    place = F.pmod("hash", F.lit(bits)) + 1
    parts = hashes.groupBy(F.bitmap_bucket_number(place).alias("part")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect()
    table = np.zeros(bits // 8, np.uint8)
    for part, data in parts:
        table[(part - 1) * 4096:part * 4096] = np.frombuffer(data, np.uint8)
    return hashes.sparkSession.sparkContext.broadcast(table)


def _flushed(batches: Iterator[pa.RecordBatch], read: Callable, send: Callable) -> Iterator[pa.RecordBatch]:
    """Arrays that ``read`` finds in the batches, held up to ``FLUSH`` entries and then sent."""
    held, size = [], 0
    for batch in batches:
        for arrays in read(batch):
            held.append(arrays)
            size += len(arrays[0])
            if size >= FLUSH:
                yield send([np.concatenate(x) for x in zip(*held)])
                held, size = [], 0
    if size:
        yield send([np.concatenate(x) for x in zip(*held)])
    held.clear()
    give_back()


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, int]]:
    """(tokens with one before and some after, places to look at) over the code of a batch."""
    flat = np.concatenate([np.zeros(1, np.int64), batch["code"].flatten().to_numpy(), np.zeros(LONGEST, np.int64)]).view(_U)
    for a in range(0, len(flat) - 1 - LONGEST, CHUNK):
        part = flat[a:a + 1 + CHUNK + LONGEST]
        yield part, len(part) - 1 - LONGEST


def vocabulary(base: DataFrame) -> DataFrame:
    """(lang, word, n): counts of all words in all texts; ``word`` null has the language's total."""
    def run(batches):
        held, size = {}, 0
        for batch in batches:
            for part in slices(batch, "text"):
                found, _ = split(part["text"])
                token = hashed(found, part["lang"])
                kept, at, count = np.unique(token, return_index=True, return_counts=True)
                length = (found.end - found.start)[at]
                begin = np.cumsum(length) - length
                letters = found.data[np.repeat(found.start[at] - begin, length) + np.arange(length.sum())]
                text = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(np.append(begin, length.sum()).astype(np.int64).tobytes()),
                                                        pa.py_buffer(letters.tobytes())).cast(pa.string())
                lang = part["lang"].take(pa.array(found.owner()[at]))
                for h, c, w, l in zip(kept.tolist(), count.tolist(), text.to_pylist(), lang.to_pylist()):
                    if h in held:
                        held[h][2] += c
                    else:
                        held[h] = [l, w, c]
                        size += 1
                if size >= FLUSH // 4:
                    yield send(held)
                    held, size = {}, 0
        if held:
            yield send(held)
        held.clear()
        give_back()

    def send(held):
        total = {}
        for lang, _, n in held.values():
            total[lang] = total.get(lang, 0) + n
        rows = [*held.values(), *([lang, None, n] for lang, n in total.items())]
        return pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows), (pa.string(), pa.string(), pa.int64()))], ["lang", "word", "n"])
    return base.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _with_hash(counted: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            for part in slices(batch, "word"):
                yield part.append_column("hash", pa.array(hashed(words(part["word"]), part["lang"]).view(np.int64)))
    return counted.mapInArrow(run, "lang string, word string, n long, hash long")


def coded(base: DataFrame, frequent: Broadcast) -> DataFrame:
    """One row per text with a frequent word: its word hashes, 0 at the ends of pieces and for rare words."""
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                found, begins = split(part["text"])
                token = hashed(found, part["lang"])
                token[~inside(frequent.value, token)] = 0
                out = np.zeros(2 * len(token), _U)  # a place before each word for the end of a piece
                out[1::2] = token
                out[2::2] = np.where(begins[1:], _U(0), _U(1))
                gap = out[0::2]
                keep = np.ones(len(out), bool)
                keep[0::2] = gap == 0
                owner = np.repeat(found.owner(), 2)[keep]
                out = out[keep]
                again = np.append(False, (out[1:] == 0) & (out[:-1] == 0) & (owner[1:] == owner[:-1]))
                out, owner = out[~again], owner[~again]
                alone = np.bincount(owner, out != 0, part.num_rows) == 0
                stay = ~alone[owner]
                bounds = np.concatenate([[0], np.cumsum(np.bincount(owner[stay], minlength=part.num_rows)[~alone])])
                yield pa.record_batch([lists(out[stay].view(np.int64), bounds)], ["code"])
    return base.mapInArrow(run, "code array<long>")


def extended(code: DataFrame, band: Broadcast, prefixes: Broadcast, size: int) -> DataFrame:
    """(prefix, last, n): how often each phrase of ``size`` words grows from a prefix in both bit tables."""
    def read(batch):
        for tokens, places in _chunks(batch):
            at = 1 + np.flatnonzero(inside(band.value, tokens[1:places + 1]) & (tokens[1:places + 1] != 0))
            gram = tokens[at]
            for step in range(1, size - 1):
                word = tokens[at + step]
                keep = word != 0
                at, gram = at[keep], extend(gram[keep], word[keep])
            last = tokens[at + size - 1]
            keep = (last != 0) & inside(prefixes.value, gram)
            yield gram[keep], last[keep]

    def send(arrays):
        prefix, last = arrays
        _, first, n = np.unique(extend(prefix, last), return_index=True, return_counts=True)
        return pa.record_batch([pa.array(prefix[first].view(np.int64)), pa.array(last[first].view(np.int64)), pa.array(n)], ["prefix", "last", "n"])

    counts = code.mapInArrow(lambda batches: _flushed(batches, read, send), "prefix long, last long, n long")
    return counts.groupBy("prefix", "last").agg(F.sum("n").alias("n"))


def _parts(nodes: DataFrame, column: str, before: int = 0) -> DataFrame:
    """(hash, k, ``column``): hash of what follows the first k words of every phrase (k = 0: all of it)."""
    def run(batches):
        for batch in batches:
            sizes = batch["words"].value_lengths().to_numpy()
            flat, first = batch["words"].flatten().to_numpy().view(_U), np.cumsum(sizes) - sizes
            own = batch["hash"].to_numpy()
            for k in range(before, LONGEST):
                row = np.flatnonzero(sizes > k)
                gram = flat[first[row] + k]
                for step in range(k + 1, LONGEST):
                    longer = sizes[row] > step
                    gram[longer] = extend(gram[longer], flat[first[row[longer]] + step])
                yield pa.record_batch([pa.array(own[row]), pa.array(np.full(len(row), k, np.int32)), pa.array(gram.view(np.int64))],
                                      ["hash", "k", column])
                if before == 0:
                    break
    return nodes.select("hash", "words").mapInArrow(run, f"hash long, k int, {column} long")


def occurrences(code: DataFrame, asked: Broadcast) -> DataFrame:
    """(hash, n, low, high): counts of the phrases in the bit table, least and greatest word before them (0: none)."""
    def read(batch):
        for tokens, places in _chunks(batch):
            at = 1 + np.flatnonzero(tokens[1:places + 1])
            gram = tokens[at]
            for step in range(1, LONGEST):
                word = tokens[at + step]
                keep = word != 0
                at, gram = at[keep], extend(gram[keep], word[keep])
                hit = inside(asked.value, gram)
                yield gram[hit], tokens[at[hit] - 1].view(np.int64)

    def send(arrays):
        gram, ahead = arrays
        order = np.argsort(gram)
        gram, ahead = gram[order], ahead[order]
        first = np.flatnonzero(np.append(True, gram[1:] != gram[:-1]))
        return pa.record_batch([pa.array(gram[first].view(np.int64)), pa.array(np.diff(np.append(first, len(gram)))),
                                pa.array(np.minimum.reduceat(ahead, first)), pa.array(np.maximum.reduceat(ahead, first))],
                               ["hash", "n", "low", "high"])

    found = code.mapInArrow(lambda batches: _flushed(batches, read, send), "hash long, n long, low long, high long")
    return found.groupBy("hash").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))


def _exact(a: Column, n: Column, l: Column, r: Column) -> Column:
    """floor(1000 a n / (l r)), in decimals of 38 digits."""
    a, n, l, r = (c.cast("decimal(18,0)") for c in (a, n, l, r))
    return F.call_function("div", F.lit(1000).cast("decimal(4,0)") * a * n, l * r)


def _bands(frequent: DataFrame) -> DataFrame:
    """Every frequent word with its wave: from rare (high bounds) to common, by shares of the language's words."""
    sized = frequent.withColumn("level", F.floor(F.log2("n") * 4))
    levels = sized.groupBy("lang", "level").agg(F.sum("n").alias("mass"))
    over = Window.partitionBy("lang")
    before = F.coalesce(F.sum("mass").over(over.orderBy("level").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    share = before / F.sum("mass").over(over)
    wave = reduce(lambda a, b: a + b, [(share >= s).cast("int") for s in SHARES])
    return sized.join(levels.select("lang", "level", wave.alias("wave")), ["lang", "level"]).drop("level")


def _grown(code: DataFrame, band: DataFrame, least: int, wave: int) -> list[DataFrame]:
    """The nodes of a wave, level by level: hash, prefix, lang, words, lefts (counts of all prefixes), n."""
    first = bit_table(band)
    level = band.select("lang", "hash", F.lit(None).cast("long").alias("prefix"), F.array("hash").alias("words"),
                        F.array().cast("array<long>").alias("lefts"), "n")
    table, levels = first, []
    for size in range(2, LONGEST + 1):
        counts = extended(code, first, table, size).where(F.col("n") >= least)
        parent = level.select(F.col("hash").alias("prefix"), "lang", "words", "lefts", F.col("n").alias("parent_n"))
        grown = (counts.join(parent, "prefix")
                       .select("lang", "prefix", F.concat("words", F.array("last")).alias("words"),
                               F.concat("lefts", F.array("parent_n")).alias("lefts"), "n"))
        level = written(grown.mapInArrow(_hash_of_words, "lang string, prefix long, words array<long>, lefts array<long>, n long, hash long")
                        .withColumn("wave", F.lit(wave)), "phrases")
        levels.append(level)
        if table is not first:
            table.unpersist()
        if level.isEmpty():
            break
        table = bit_table(level)
    first.unpersist()
    table.unpersist()
    return levels


def _hash_of_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = batch["words"].value_lengths().to_numpy()
        last = batch["words"].flatten().to_numpy().view(_U)[np.cumsum(sizes) - 1]
        yield batch.append_column("hash", pa.array(extend(batch["prefix"].to_numpy().view(_U), last).view(np.int64)))


def _scored(code: DataFrame, picked: DataFrame, frequent: DataFrame) -> DataFrame:
    """Exact scores of picked phrases; those always preceded by one and the same word are gone."""
    rest = written(_parts(picked, "rest", 1), "rests")
    asked = bit_table(picked.select("hash").unionByName(rest.select(F.col("rest").alias("hash"))))
    seen = written(occurrences(code, asked), "occurrences")
    asked.unpersist()
    right = frequent.select(F.col("hash").alias("rest"), F.col("n").alias("r")).unionByName(
        seen.select(F.col("hash").alias("rest"), F.col("n").alias("r")))
    cuts = rest.join(right, "rest").select("hash", "k", "r")
    fixed = seen.where("low = high AND low <> 0").select("hash", F.lit(True).alias("fixed"))
    kept = picked.join(fixed, "hash", "left").where((F.size("words") == LONGEST) | F.col("fixed").isNull()).drop("fixed")
    each = kept.join(cuts, "hash").withColumn("l", F.element_at("lefts", F.col("k")))
    cut = F.struct(_exact(F.col("n"), F.col("total"), F.col("l"), F.col("r")).alias("score"), "k", "l", "r")
    least = each.groupBy("hash").agg(F.min(cut).alias("cut"))
    return (kept.join(least, "hash")
                .select("lang", "hash", "words", F.col("n").alias("a"), F.col("cut.l").alias("l"), F.col("cut.r").alias("r"),
                        F.col("total").alias("n"), F.col("cut.score").alias("score")))


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` phrases of every language.

    A-Z are folded, texts are split at ``PIECE_ENDS`` into pieces and these at space and
    tab into words.  A phrase is 2 to 5 words of a piece that occur at least ``least``
    times in the language (null: ``und``).  Its score is that of its worst cut (ties: the
    shorter first part); phrases inside a longer one as frequent are left out.  Order:
    score and count descending, phrase in byte order.  Null or empty texts have no word,
    repeated rows count as often as they stand, an empty table gives no row.  Texts are
    read whole; counts beyond 10^18 are not provided for.
    """
    base = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    counted = written(vocabulary(base).where(F.col("word").isNull() | (F.col("n") >= least)), "vocabulary")
    totals = counted.where("word IS NULL").select("lang", F.col("n").alias("total"))
    frequent = written(_bands(_with_hash(counted.where("word IS NOT NULL"))), "bands")
    table = bit_table(frequent)
    code = written(coded(base, table), "code")
    table.unpersist()
    open_langs = written(totals.select("lang"), "open")
    levels: list[list[DataFrame]] = [[] for _ in range(LONGEST - 1)]
    scored: list[DataFrame] = []
    last_frontier = None
    for wave in range(len(SHARES) + 1):
        band = frequent.where(F.col("wave") == wave).join(open_langs, "lang", "left_semi").select("lang", "hash", "n")
        if not band.isEmpty():
            for found, level in zip(levels, _grown(code, band, least, wave)):
                found.append(level)
        # the best bound left to expand; -1 where nothing is left
        frontier = written(totals.join(open_langs, "lang", "left_semi").join(
            frequent.where(F.col("wave") > wave).groupBy("lang").agg(F.min("n").alias("next")), "lang", "left")
            .select("lang", "total", F.coalesce(F.expr("1000 * CAST(total AS DECIMAL(18, 0)) div next"), F.lit(-1)).alias("bar"),
                    F.col("next").isNull().alias("over")), "frontier")
        picked = _picked(levels, frequent, frontier, last_frontier, wave)
        if picked is not None:
            scored.append(written(_scored(code, written(picked, "picked"), frequent), "scores"))
        if not scored:
            above = totals.select("lang").limit(0)
        else:
            above = (_union(scored).join(frontier, "lang").where("score > bar").groupBy("lang")
                     .agg(F.count(F.lit(1)).alias("settled")).where(F.col("settled") >= top).select("lang"))
        open_langs = written(frontier.where("NOT over").join(above, "lang", "left_anti").select("lang"), "open")
        last_frontier = frontier
        if open_langs.isEmpty():
            break
    if not scored:
        return docs.sparkSession.createDataFrame([], "lang string, rank int, phrase string, a long, l long, r long, n long, score long")
    order = [F.desc("score"), F.desc("a")]
    near = (_union(scored).withColumn("place", F.rank().over(Window.partitionBy("lang").orderBy(*order)))
            .where(F.col("place") <= top).drop("place"))
    near = written(near, "near")
    spelled = (near.select("hash", F.posexplode("words").alias("pos", "word_hash"))
                   .join(frequent.select(F.col("hash").alias("word_hash"), "word"), "word_hash")
                   .groupBy("hash").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))),
                                                                lambda x: x["word"]), " ").alias("phrase")))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase"))
    return (near.join(spelled, "hash").withColumn("rank", place).where(F.col("rank") <= top)
                .select("lang", F.col("rank").cast("int").alias("rank"), "phrase", "a", "l", "r", "n", "score"))


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _picked(levels: list[list[DataFrame]], frequent: DataFrame, frontier: DataFrame, before: DataFrame | None,
            wave: int) -> DataFrame | None:
    """Phrases whose bound beats the frontier for the first time; one always followed by the same word is out."""
    parts = []
    last_n = frequent.select(F.col("hash").alias("last"), F.col("n").alias("last_n"))
    for depth, found in enumerate(levels):
        if not found:
            continue
        nodes = _union(found)
        if depth + 1 < len(levels) and levels[depth + 1]:
            follow = _union(levels[depth + 1]).groupBy(F.col("prefix").alias("hash")).agg(F.max("n").alias("most"))
            nodes = nodes.join(follow, "hash", "left").where("most IS NULL OR most < n").drop("most")
        nodes = nodes.withColumn("last", F.element_at("words", -1)).join(last_n, "last").join(frontier.drop("over"), "lang")
        bound = F.least(_exact(F.col("n"), F.col("total"), F.element_at("lefts", -1), F.col("last_n")),
                        F.expr("1000 * CAST(total AS DECIMAL(18, 0)) div lefts[0]"))
        nodes = nodes.withColumn("bound", bound).where("bound > bar")
        if before is not None:
            nodes = nodes.join(before.select("lang", F.col("bar").alias("old_bar")), "lang").where((F.col("wave") == wave) | (F.col("bound") <= F.col("old_bar")))
        parts.append(nodes.select("lang", "hash", "words", "lefts", "n", "total"))
    return _union(parts) if parts else None
