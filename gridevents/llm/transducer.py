"""Byte-level BPE as a lazily determinised transducer, and a streaming decoder.

Merging by rank has a local test: a sequence of tokens is the encoding of its bytes
exactly when every token encodes to itself and every two neighbours encode to
themselves together.  So the encoding of every prefix of a piece of text ends in one
token only, and the encodings of all prefixes are the paths of a tree.

A later token can only begin inside the longest suffix that begins some token, so
the lookahead is bounded by the longest token.  A state of the transducer is that
suffix with the paths to its places, less what all paths share, which is given out.
Reading a byte adds a place; the one token that ends there and gets on with the token
before it extends the path of the place where it begins.  States and arcs are made
when a text first needs them, and kept.

The decoder turns ids into text: an automaton over bytes tells complete characters
from pending and malformed ones, and is lifted to whole tokens the same lazy way.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from gridevents.llm.frames import lists, map_slices, texts

#: Pieces and states a worker keeps before it starts afresh.
KNOWN_PIECES, KNOWN_STATES = 500_000, 300_000
#: Pairs of tokens, and arcs of the decoder, that a worker remembers.
KNOWN_PAIRS = 1_000_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class Transducer:
    """Ids of pieces of text, byte by byte."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes = {rank: token for token, rank in ranks.items()}
        self.begins = {token[:i] for token in ranks for i in range(1, len(token) + 1)}
        self._own: dict[bytes, bool] = {}
        self._pair: dict[tuple[int, int], bool] = {}
        self.restart()

    def restart(self) -> None:
        """Only the first state: nothing given out, nothing pending."""
        self.states = [(-1, b"", ((),))]
        self.numbers = {self.states[0]: 0}
        self.arcs: dict[int, tuple[int, tuple[int, ...]]] = {}

    def bound(self) -> None:
        """Empties what is remembered of pairs when it has grown large."""
        if len(self._pair) > KNOWN_PAIRS:
            self._pair.clear()

    def merge(self, data: bytes) -> list[bytes]:
        """Merges by rank, for making arcs only: at most two tokens long."""
        get, never = self.ranks.get, 1 << 40
        parts = [data[i:i + 1] for i in range(len(data))]
        pairs = [get(a + b, never) for a, b in zip(parts, parts[1:])]
        while pairs and (rank := min(pairs)) < never:
            i = pairs.index(rank)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i < len(pairs):
                pairs[i] = get(parts[i] + parts[i + 1], never)
            if i:
                pairs[i - 1] = get(parts[i - 1] + parts[i], never)
        return parts

    def _fits(self, before: int, rank: int, token: bytes) -> bool:
        """Whether the token is its own encoding and stays apart from the token before it."""
        if token not in self._own:
            self._own[token] = self.merge(token) == [token]
        if before < 0 or not self._own[token]:
            return self._own[token]
        key = (before, rank)
        if key not in self._pair:
            one = self.bytes[before]
            self._pair[key] = self.merge(one + token) == [one, token]
        return self._pair[key]

    def _step(self, number: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """Next state and the ids given out.

        A state is (last id given out or -1, pending bytes, path to every place in them).
        """
        last, pending, paths = self.states[number]
        pending += bytes((byte,))
        for start in range(len(pending)):
            token = pending[start:]
            rank = self.ranks.get(token)
            if rank is not None and self._fits(paths[start][-1] if paths[start] else last, rank, token):
                paths += (paths[start] + (rank,),)
                break
        else:
            raise ValueError("no token ends here: the ranks lack a byte")
        live = 0
        while live < len(pending) and pending[live:] not in self.begins:
            live += 1
        pending, paths = pending[live:], paths[live:]
        shared = len(paths[0])
        for path in paths[1:]:
            keep = 0
            while keep < shared and keep < len(path) and path[keep] == paths[0][keep]:
                keep += 1
            shared = keep
        given = paths[0][:shared]
        if given:
            last, paths = given[-1], tuple(path[shared:] for path in paths)
        if all(paths):
            last = -1  # every path has a token of its own to go on from
        state = (last, pending, paths)
        following = self.numbers.get(state)
        if following is None:
            following = self.numbers[state] = len(self.states)
            self.states.append(state)
        arc = self.arcs[number << 8 | byte] = following, given
        return arc

    def encode(self, piece: bytes) -> list[int]:
        """Ids of one piece (a piece that is a token as a whole is that token)."""
        if piece in self.ranks:
            return [self.ranks[piece]]
        if len(self.arcs) > KNOWN_STATES:
            self.restart()
        state, out, arcs = 0, [], self.arcs
        for byte in piece:
            arc = arcs.get(state << 8 | byte) or self._step(state, byte)
            state, given = arc
            if given:
                out += given
        return out + list(self.states[state][2][-1])


class Encoder:
    """Ids of whole texts: pieces by pattern, each through the transducer, known pieces at once."""

    def __init__(self, path: str, pattern: str):
        self.transducer = Transducer(read_ranks(path))
        self.split = regex.compile(pattern).findall
        self.clear()

    def clear(self) -> None:
        self.codes: dict[str, int] = {}
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0
        self.start, self.length, self.uses = (np.zeros(1 << 16, np.int64) for _ in range(3))

    def _learn(self, piece: str, ids) -> None:
        code = self.codes[piece] = len(self.codes)
        if code >= len(self.start):
            self.start, self.length, self.uses = (np.concatenate([x, np.zeros(len(x), x.dtype)])
                                                  for x in (self.start, self.length, self.uses))
        if self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(len(self.flat) + len(ids), np.int32)])
        self.flat[self.used:self.used + len(ids)] = ids
        self.start[code], self.length[code] = self.used, len(ids)
        self.used += len(ids)

    def _forget(self) -> None:
        """Pieces that came once only make room for others."""
        codes, flat, start, length, uses = self.codes, self.flat, self.start, self.length, self.uses
        self.clear()
        again = [(piece, code) for piece, code in codes.items() if uses[code] > 1]
        for piece, code in again if len(again) < KNOWN_PIECES // 2 else ():
            self._learn(piece, flat[start[code]:start[code] + length[code]])

    def encode(self, column: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, bounds of the texts)."""
        if len(self.codes) > KNOWN_PIECES:
            self._forget()
        split = [self.split(t) for t in column]
        for piece in set().union(*split) - self.codes.keys():
            self._learn(piece, self.transducer.encode(piece.encode("utf-8")))
        get = self.codes.__getitem__
        codes = np.fromiter(map(get, chain.from_iterable(split)), np.int64, sum(map(len, split)))
        self.uses += np.bincount(codes, minlength=len(self.uses))
        size = self.length[codes]
        place = np.zeros(len(codes) + 1, np.int64)
        np.cumsum(size, out=place[1:])
        ids = self.flat[np.repeat(self.start[codes] - place[:-1], size) + np.arange(place[-1])]
        return ids, place[np.cumsum([0, *map(len, split)])]


class Utf8:
    """Automaton over bytes: state 0 between characters, otherwise (bytes still to come, lowest, highest next byte)."""

    START = (0, 0, 0)

    @staticmethod
    def step(state: tuple[int, int, int], byte: int) -> tuple[int, int, int] | None:
        """The next state, or None where the byte cannot stand there."""
        left, low, high = state
        if left:
            return ((left - 1, 0x80, 0xBF) if left > 1 else Utf8.START) if low <= byte <= high else None
        if byte < 0x80:
            return Utf8.START
        if 0xC2 <= byte <= 0xDF:
            return 1, 0x80, 0xBF
        if 0xE0 <= byte <= 0xEF:
            return 2, 0xA0 if byte == 0xE0 else 0x80, 0x9F if byte == 0xED else 0xBF
        if 0xF0 <= byte <= 0xF4:
            return 3, 0x90 if byte == 0xF0 else 0x80, 0x8F if byte == 0xF4 else 0xBF
        return None


class Decoder:
    """Text of a stream of ids; malformed bytes become U+FFFD, one for each broken character."""

    def __init__(self, tokens: dict[int, bytes]):
        self.tokens = tokens
        self.arcs: dict[tuple, tuple] = {}
        size = max(tokens) + 1
        self.whole = np.zeros(size, bool)  # tokens of complete characters: state 0 to state 0
        self.table: list[bytes] = [b""] * size
        for rank, token in tokens.items():
            state: tuple | None = Utf8.START
            for byte in token:
                state = Utf8.step(state, byte) if state else None
            self.whole[rank], self.table[rank] = state == Utf8.START, token

    def bound(self) -> None:
        """Empties the arcs when they have grown many."""
        if len(self.arcs) > KNOWN_PAIRS:
            self.arcs.clear()

    def _arc(self, state: tuple, token: int) -> tuple[tuple, bytes]:
        """A state is (automaton state, bytes of the character begun)."""
        at, begun = state
        out = b""
        for byte in self.table[token]:
            following = Utf8.step(at, byte)
            if following is None:
                out += "�".encode() if begun else b""
                begun, following = b"", Utf8.step(Utf8.START, byte)
                if following is None:
                    out, at = out + "�".encode(), Utf8.START
                    continue
            at, begun = following, begun + bytes([byte])
            if at == Utf8.START:
                out, begun = out + begun, b""
        return (at, begun), out

    def stream(self, ids: Iterable[int]) -> Iterator[bytes]:
        """Complete characters as soon as they are read."""
        state = (Utf8.START, b"")
        for token in ids:
            arc = self.arcs.get((state, token))
            if arc is None:
                arc = self.arcs[state, token] = self._arc(state, token)
            state, out = arc
            yield out
        if state[1]:
            yield "�".encode()

    def decode(self, ids: np.ndarray) -> bytes:
        if self.whole[ids].all():  # every token goes from state 0 to state 0
            return b"".join(map(self.table.__getitem__, ids.tolist()))
        return b"".join(self.stream(ids.tolist()))


_LOADED: dict[tuple[str, str], tuple[Encoder, Decoder]] = {}


def coder(path: str, pattern: str) -> tuple[Encoder, Decoder]:
    """Encoder and decoder of this worker process."""
    if (path, pattern) not in _LOADED:
        encoder = Encoder(path, pattern)
        _LOADED[path, pattern] = encoder, Decoder(encoder.transducer.bytes)
    return _LOADED[path, pattern]


def encode_decode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids, decoded) of every row of ``docs``: the ids of the text, and the text that they decode to.

    Ranks are read from ``path``; every match of ``pattern`` is encoded on its own and no
    special tokens are known.  A null text is empty and has no ids; a null doc_id stays null;
    repeated rows give repeated rows; texts are read whole, in memory that follows the
    longest single text.
    """
    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        encoder, decoder = coder(path, pattern)
        ids, first = encoder.encode(part["text"].to_pylist())
        decoded = [decoder.decode(ids[a:b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
        encoder.transducer.bound()
        decoder.bound()
        return pa.record_batch([part["doc_id"], lists(ids, first), pa.array(decoded, pa.binary())],
                               ["doc_id", "ids", "decoded"])
    return map_slices(texts(docs), run, "doc_id long, ids array<int>, decoded binary")
