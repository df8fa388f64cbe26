"""Quality rules: word and repetition counts, and bands of zstandard ratios.

A text that repeats itself compresses far below ordinary prose, and noise (keys,
base64, random letters) hardly compresses at all.  Both are judged by the ratio
``compressed bytes / bytes``, once over the whole text and once over fixed
chunks.  What is ordinary depends on the length, because a compressor has little
to refer back to in a short text; so every length class has its own band.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from gridevents.llm.frames import map_slices, texts
from gridevents.llm.words import code_points, shingles, words

#: (bytes up to and including, lowest ratio, highest ratio): shorter texts have no band.
BANDS = ((63, 0.0, 9.9), (255, 0.25, 1.10), (1023, 0.22, 0.86), (4095, 0.18, 0.76), (1 << 62, 0.12, 0.70))

#: Chunks have the band of their own length; a text goes if more than this share of its chunks is outside.
CHUNK_BYTES, CHUNK_SHARE = 2048, 0.5

LEVEL = 3

SCHEMA = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "whole_ratio double, chunks_outside long, n_chunks long, base_failed boolean, kept boolean")

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_BLANK = " \t\n\x0b\x0c\r"


def band(size: int, bands: Sequence[tuple[int, float, float]] = BANDS) -> tuple[float, float]:
    return next((low, high) for limit, low, high in bands if size <= limit)


def compression(data: bytes, compressor, bands=BANDS, chunk_bytes: int = CHUNK_BYTES) -> tuple[float, int, int, bool]:
    """Ratio of the whole text, chunks outside their band, chunks, and whether the text is inside."""
    if not data:
        return 1.0, 0, 0, True
    whole = len(compressor.compress(data)) / len(data)
    low, high = band(len(data), bands)
    inside = low <= whole <= high
    if len(data) < 2 * chunk_bytes:  # one chunk at most would be full: the whole ratio says the same
        return whole, 0, 0, inside
    outside = total = 0
    for at in range(0, len(data), chunk_bytes):
        chunk = data[at:at + chunk_bytes]
        low, high = band(len(chunk), bands)
        outside += not low <= len(compressor.compress(chunk)) / len(chunk) <= high
        total += 1
    return whole, outside, total, inside and outside <= CHUNK_SHARE * total


def repeated_words(hashes: np.ndarray, first: np.ndarray, size: int = 8) -> np.ndarray:
    """Per text, words lying in a window of ``size`` words that the text holds twice or more."""
    counts = np.diff(first)
    value, at = shingles(hashes, first, size)
    owner = np.repeat(np.arange(len(counts)), counts)
    full = counts[owner[at]] >= size
    value, at = value[full], at[full]
    order = np.lexsort((value, owner[at]))
    value, who = value[order], owner[at][order]
    same = np.zeros(len(order) + 1, bool)
    same[1:-1] = (value[1:] == value[:-1]) & (who[1:] == who[:-1])
    twice = at[order[same[1:] | same[:-1]]]
    cover = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + size, -1)
    inside = np.zeros(len(hashes) + 1, np.int64)
    np.cumsum(np.cumsum(cover[:-1]) > 0, out=inside[1:])
    return inside[first[1:]] - inside[first[:-1]]


def duplicate_lines(text: str) -> int:
    lines = [line for line in text.split("\n") if line.strip(_BLANK)]
    return len(lines) - len(set(lines))


def quality(docs: DataFrame, bands: Sequence[tuple[int, float, float]] = BANDS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text) with its counts and verdict.

    ``kept`` is false for fewer than 20 words, for more than 30 % of words inside
    repeated 8-word windows, for a whole-text ratio outside the band of its length,
    and when more than half of the 2048-byte chunks are outside theirs.

    A null text is an empty one (ratio 1, no chunk, rejected for its length); a null
    doc_id stays null; repeated rows give repeated rows; an empty table an empty one.
    Any text length is read whole: memory follows the longest single text.
    """
    return map_slices(texts(docs), lambda part: measured(part["doc_id"], part["text"], bands), SCHEMA)


def measured(ids: pa.Array, column: pa.Array, bands: Sequence[tuple[int, float, float]] = BANDS) -> pa.RecordBatch:
    """Counts and verdicts of a slice of texts."""
    found = words(column)
    compressor = zstandard.ZstdCompressor(level=LEVEL)
    hashes = found.hashes()
    points, marks = code_points(found.data), np.zeros(len(found.data) + 1, np.int64)
    np.cumsum(_SYMBOL[found.data], out=marks[1:])
    chars = np.zeros(len(found.start) + 1, np.int64)
    np.cumsum(points[found.end] - points[found.start], out=chars[1:])
    data, bounds = found.data.tobytes(), found.text.tolist()
    ratios = [compression(data[a:b], compressor, bands) for a, b in zip(bounds, bounds[1:])]
    repeats = repeated_words(hashes, found.first)
    failed = (found.counts < 20) | (100 * repeats > 30 * found.counts)
    columns = [ids, found.counts, np.diff(chars[found.first]), np.diff(marks[found.text]),
               [duplicate_lines(t) for t in column.to_pylist()], repeats,
               [r[0] for r in ratios], [r[1] for r in ratios], [r[2] for r in ratios],
               failed, ~failed & np.array([r[3] for r in ratios], bool)]
    kinds = [pa.int64()] * 6 + [pa.float64()] + [pa.int64()] * 2 + [pa.bool_()] * 2
    names = [x.split(" ")[0] for x in SCHEMA.split(", ")]
    return pa.record_batch([c if isinstance(c, pa.Array) else pa.array(c, k)
                            for c, k in zip(columns, kinds)], names)


def passing(docs: DataFrame, bands: Sequence[tuple[int, float, float]] = BANDS) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns; no row is shuffled."""
    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        column = part["text"].fill_null("")
        return part.filter(measured(pa.nulls(len(column), pa.int64()), column, bands)["kept"])
    return map_slices(docs, run, docs.schema)
