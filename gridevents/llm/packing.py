"""Packing of token sequences: first-fit decreasing over a tournament tree of bins.

1. Every text is tokenized and cut into pieces of at most ``capacity`` ids.
2. Pieces are dealt at random (a hash) into groups of about ``group_pieces``; a group
   is packed on its own, so no task holds more than a group and groups run in parallel.
3. In a group, pieces go longest first into the first bin with room.  The tree's leaves
   are the free room of the bins, an inner node the larger of its two children, so the
   first bin with room is found by one walk from the root.
"""

from __future__ import annotations

import os
import re
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gridevents.llm.frames import lists, map_slices, texts
from gridevents.session import written

#: Ids of a sequence, pieces of a group, words a worker remembers.
CAPACITY, GROUP_PIECES, KNOWN_WORDS = 4096, 2048, 600_000
#: Bytes of text that are tokenized together: new words are learnt in batches.
SLICE_BYTES = 1 << 22
#: Code points beyond which a word is not remembered for long.
LONG_WORD = 256
#: The id that ends a document.
END = 2


#: A-Z folded, other white space that cuts words as a space; bytes of longer code points stay.
FOLD = bytes(32 if b in b"\n\r\t" else b for b in bytes(range(256)).lower())


class Codes(dict):
    """Codes of words.  A word not known yet is noted in ``fresh`` and gets a negative number for the time being."""

    def __init__(self):
        self.fresh: dict[str, int] = {}

    def __missing__(self, word: str) -> int:
        return self.fresh.setdefault(word, -1 - len(self.fresh))


class WordIds:
    """Ids of whole texts through a bounded memory of words.

    The vocabulary splits at white space before its merges, and between a letter and a
    full stop or comma, so a text's ids are those of its words in order; A-Z is folded
    by the vocabulary itself.  Words are split at space, line feed, carriage return and tab only.
    Special tokens written out in a text are one id each, as the library has it: texts are
    cut at them first.  (A word begins with a space in ``codes`` only if it stands for one.)
    """

    def __init__(self, path: str, limit: int = KNOWN_WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.special = {token.content: number for number, token in self.tokenizer.get_added_tokens_decoder().items() if token.special}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.tokenizer.encode_special_tokens = True  # for words: what only looks special once it is folded is not
        self.limit = limit
        self.clear()

        # in this vocabulary the last token of every run of letters says so
        ends = [i for token, i in self.tokenizer.get_vocab().items() if token.endswith("</w>")]
        self.word_end = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        self.word_end[ends] = True

    def clear(self) -> None:
        self.codes = Codes()
        self.flat, self.used = np.zeros(1 << 20, np.int32), 0
        self.start, self.length, self.uses = (np.zeros(1 << 18, np.int64) for _ in range(3))
        self.letters = 0
        self._add([" " + token for token in self.special], np.array(list(self.special.values()), np.int32), np.ones(len(self.special), np.int64))

    def _add(self, words: list[str], flat: np.ndarray, length: np.ndarray) -> None:
        low, high = len(self.codes), len(self.codes) + len(words)
        while high > len(self.start):
            self.start, self.length, self.uses = (np.concatenate([x, np.zeros(len(x), x.dtype)])
                                                  for x in (self.start, self.length, self.uses))
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(len(self.flat), np.int32)])
        self.flat[self.used:self.used + len(flat)] = flat
        self.start[low:high], self.length[low:high] = self.used + np.cumsum(length) - length, length
        self.used += len(flat)
        self.codes.update(zip(words, range(low, high)))
        self.letters += sum(map(len, words))

    def _gather(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words one after another, and how many each has."""
        length = self.length[codes]
        before = np.cumsum(length) - length
        return self.flat[np.repeat(self.start[codes] - before, length) + np.arange(length.sum())], length

    def _forget(self) -> None:
        """Long words and those that came once only make room for others."""
        again = [(word, code) for word, code in self.codes.items() if self.uses[code] > 1 and len(word) <= LONG_WORD and word[:1] != " "]
        codes = np.array([code for _, code in again], np.int64)
        flat, length = self._gather(codes)
        self.clear()
        if len(again) < self.limit // 2:
            self._add([word for word, _ in again], flat, length)

    def _learn_alone(self, words: list[str]) -> None:
        for at in range(0, len(words), 4096):
            part = words[at:at + 4096]
            ids = [found.ids for found in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
            self._add(part, np.concatenate([np.array(x, np.int32) for x in ids]), np.array([len(x) for x in ids], np.int64))

    def _learn(self, words: set[str]) -> None:
        tails = [w for w in words if len(w) > 1 and w[-1] in ".," and w[-2].isascii() and w[-2].isalpha()]
        plain = words.difference(tails).union((w[:-1] for w in tails), ".,") - self.codes.keys()
        letters = [w for w in plain if w.isalpha()]  # a run of letters is one unit: many at once, told apart by their ends
        for at in range(0, len(letters), 4096):
            part = letters[at:at + 4096]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.int32)
            length = np.diff(np.flatnonzero(self.word_end[ids]), prepend=-1)
            if len(length) == len(part) and length.sum() == len(ids):
                self._add(part, ids, length)
            else:
                self._learn_alone(part)
        self._learn_alone(list(plain - self.codes.keys()))
        if tails:
            both = np.array([(self.codes[w[:-1]], self.codes[w[-1]]) for w in tails], np.int64)
            flat, length = self._gather(both.reshape(-1))
            self._add(tails, flat, length.reshape(-1, 2).sum(axis=1))

    def rest(self, keep: int) -> None:
        """Only words that came again are kept, ``keep`` at most."""
        if len(self.codes) > keep:
            self._forget()
            if len(self.codes) > keep:
                self.clear()

    def _words(self, text: str) -> list[str]:
        if any(token in text for token in self.special):
            return list(chain.from_iterable([" " + part] if part in self.special else self._words(part) for part in self.cut.split(text)))
        return text.encode("utf-8", "surrogatepass").translate(FOLD).decode("utf-8", "surrogatepass").split(" ")

    def encode(self, column: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each followed by ``END``; bounds of the texts)."""
        if len(self.codes) > self.limit or self.letters > self.limit * LONG_WORD // 8:
            self._forget()
        split = [self._words(t) for t in column]
        get = self.codes.__getitem__
        codes = np.fromiter(map(get, chain.from_iterable(split)), np.int64, sum(map(len, split)))
        if self.codes.fresh:  # each word is looked up once; only the places of new ones are filled in afterwards
            fresh, self.codes.fresh = self.codes.fresh, {}
            self._learn(set(fresh))
            learnt = np.array([self.codes[word] for word in fresh], np.int64)
            new = np.flatnonzero(codes < 0)
            codes[new] = learnt[-1 - codes[new]]
        self.uses += np.bincount(codes, minlength=len(self.uses))
        flat, length = self._gather(codes)
        # each text's ids, then the end id
        words = np.cumsum([0, *map(len, split)])
        first = np.concatenate([[0], np.cumsum(length)])[words] + np.arange(len(column) + 1)
        out = np.full(first[-1], END, np.int32)
        keep = np.ones(first[-1], bool)
        keep[first[1:] - 1] = False
        out[keep] = flat
        return out, first


_LOADED: dict[tuple[str, int], WordIds] = {}


def word_ids(path: str, limit: int) -> WordIds:
    """The memory of this worker process."""
    if (path, limit) not in _LOADED:
        _LOADED[path, limit] = WordIds(path, limit)
    return _LOADED[path, limit]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = True,
           known_words: int = KNOWN_WORDS, resting_words: int = KNOWN_WORDS,
           slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """(doc_id, start, length, doc_tokens, ids or ids_crc32): every text cut at multiples of ``capacity``.

    A worker remembers ``known_words`` while it works and ``resting_words`` after a partition;
    smaller ``slice_bytes`` take less memory and more time.

    ``ids_crc32`` is that of the little-endian unsigned 32-bit ids; it stands in for the ids
    where only a check of them is wanted.
    """
    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        ids, first = word_ids(tokenizer, known_words).encode(part["text"].to_pylist())
        total = np.diff(first)
        number = -(-total // capacity)
        owner = np.repeat(np.arange(len(total)), number)
        start = (np.arange(len(owner)) - np.repeat(np.cumsum(number) - number, number)) * capacity
        length = np.minimum(capacity, total[owner] - start)
        bounds = np.append(first[owner] + start, first[-1])
        if with_ids:
            content = lists(ids, bounds)
        else:
            data = memoryview(ids.astype("<u4").tobytes())
            content = pa.array([zlib.crc32(data[4 * a:4 * b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())], pa.int64())
        return pa.record_batch([part["doc_id"].take(pa.array(owner)), pa.array(start), pa.array(length),
                                pa.array(total[owner]), content], ["doc_id", "start", "length", "doc_tokens", "content"])
    kind, name = ("array<int>", "ids") if with_ids else ("long", "ids_crc32")
    return map_slices(texts(docs), run, f"doc_id long, start long, length long, doc_tokens long, content {kind}",
                      done=lambda: word_ids(tokenizer, known_words).rest(resting_words), size=slice_bytes).withColumnRenamed("content", name)


class Bins:
    """Open bins as a tournament tree over their free room."""

    def __init__(self, capacity: int):
        self.capacity, self.leaves, self.count = capacity, 1, 0
        self.room = [0, capacity]

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) of the first bin with room for ``length``."""
        if self.room[1] < length:  # every leaf is in use and too full
            old, self.leaves = self.room[self.leaves:], 2 * self.leaves
            self.room = [0] * self.leaves + old + [self.capacity] * (self.leaves - len(old))
            for node in range(self.leaves - 1, 0, -1):
                self.room[node] = max(self.room[2 * node], self.room[2 * node + 1])
        node = 1
        while node < self.leaves:
            node = 2 * node if self.room[2 * node] >= length else 2 * node + 1
        found, offset = node - self.leaves, self.capacity - self.room[node]
        self.room[node] -= length
        while node > 1:
            node //= 2
            self.room[node] = max(self.room[2 * node], self.room[2 * node + 1])
        self.count = max(self.count, found + 1)
        return found, offset


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every piece; equal lengths go in the given order."""
    bins, number, offset = Bins(capacity), np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable"):
        number[i], offset[i] = bins.place(int(lengths[i]))
    return number, offset


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES,
         with_ids: bool = True, known_words: int = KNOWN_WORDS, resting_words: int = KNOWN_WORDS,
         slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """The pieces of all texts with ``sequence_id`` and ``offset`` in their sequence.

    A sequence holds at most ``capacity`` ids, gapless from offset 0.  Every row of ``docs``
    is packed: a null text is empty and is one piece of the end id alone, a null doc_id stays
    null, repeated rows are packed as often as they stand.  Pieces are dealt by hash of doc_id,
    start and content, equal pieces also by their number in the written table, so that no group
    holds all copies of a row; an empty table has no sequence.
    """
    cut = written(pieces(docs, tokenizer, capacity, with_ids, known_words, resting_words, slice_bytes), "pieces")
    groups = max(1, round(cut.count() / group_pieces))
    content = "ids" if with_ids else "ids_crc32"
    # the number within a stored part, in blocks: copies of one row go to several groups
    block = F.shiftright(F.monotonically_increasing_id(), 9)
    grouped = cut.withColumn("group", F.pmod(F.xxhash64("doc_id", "start", content, block), F.lit(groups)))

    def run(key, table):
        order = [("length", "descending"), ("doc_id", "ascending"), ("start", "ascending")]
        table = table.sort_by(order)
        number, offset = first_fit_decreasing(table["length"].to_numpy(), capacity)
        table = table.append_column("sequence_id", pa.array((key[0].as_py() << 32) + number))
        return table.append_column("offset", pa.array(offset)).drop_columns(["group"])

    schema = ", ".join(f"{c} {t}" for c, t in cut.dtypes) + ", sequence_id long, offset long"
    return grouped.groupBy("group").applyInArrow(run, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the ids of every sequence in order (``capacity`` at most)."""
    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.flatten(F.col("parts.ids")).alias("ids"))
