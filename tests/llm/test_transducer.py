import random

import numpy as np
import pytest

from gridevents.llm.transducer import Decoder, Encoder, encode_decode, read_ranks

public_tokenizers = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")
PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
R = random.Random(8)


def texts():
    pools = [range(32, 127), range(0x400, 0x450), range(0x4E00, 0x4E80), range(0x1F600, 0x1F640), [32, 10, 9], range(0xC0, 0x250)]
    return ["".join(chr(R.choice(R.choice(pools))) for _ in range(200)) for _ in range(150)] + \
        ["", " ", "a" * 3000, "the cat sat. " * 50, "It's 12,345 ünïcödé — “quotes”…", "́́", "xyz" * 500]


def test_ids_are_those_of_the_public_library():
    wanted = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=read_ranks(PATH), special_tokens={})
    encoder, column = Encoder(PATH, PATTERN), texts()
    ids, first = encoder.encode(column)
    assert [ids[a:b].tolist() for a, b in zip(first, first[1:])] == [wanted.encode_ordinary(t) for t in column]
    again, _ = encoder.encode(column[::-1])
    assert sorted(again) == sorted(ids)


def test_small_memory_changes_nothing(monkeypatch):
    import gridevents.llm.transducer as module
    column = texts()
    want, _ = Encoder(PATH, PATTERN).encode(column)
    monkeypatch.setattr(module, "KNOWN_STATES", 50)
    monkeypatch.setattr(module, "KNOWN_PIECES", 20)
    encoder = Encoder(PATH, PATTERN)
    got = np.concatenate([encoder.encode([t])[0] for t in column])
    assert got.tolist() == want.tolist()


def test_decoding_is_a_round_trip_and_marks_broken_bytes():
    ranks = read_ranks(PATH)
    encoder, column = Encoder(PATH, PATTERN), texts()
    decoder = Decoder(encoder.transducer.bytes)
    ids, first = encoder.encode(column)
    assert [decoder.decode(ids[a:b]).decode() for a, b in zip(first, first[1:])] == column
    for raw in (b"\xe4\xb8", b"a\xffb", b"\xe4\xb8a", b"\xf0\x9f\x98", b"\xc0\x80", b"\xed\xa0\x80"):
        got = decoder.decode(np.array([ranks[bytes([x])] for x in raw])).decode()
        assert got == raw.decode("utf-8", "replace")


def test_query_shape(docs):
    got = encode_decode(docs([(1, "é中 x"), (2, None), (None, "a"), (1, "é中 x")]), PATH, PATTERN).collect()
    assert sorted((r.doc_id or 0, bytes(r.decoded).decode()) for r in got) == [(0, "a"), (1, "é中 x"), (1, "é中 x"), (2, "")]
    assert encode_decode(docs([]), PATH, PATTERN).collect() == []
