import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings, strategies as st

from gridevents.llm.words import code_points, mix, shingles, words

TEXT = st.text(st.sampled_from("abcABC \n\t\x0b\x0c\r\x1c  é中\U0001f600.,#"), max_size=60)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=6))
def test_words_are_those_of_the_pattern(texts):
    found = words(pa.array(texts, pa.string()))
    data = bytes(found.data)
    got = [data[a:b].decode() for a, b in zip(found.start, found.end)]
    want = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    assert got == [w for ws in want for w in ws]
    assert found.counts.tolist() == [len(w) for w in want]
    hashes = found.hashes()
    assert len(set(hashes.tolist())) == len(set(got))
    assert len(set(found.hashes(lower=True).tolist())) == len({re.sub("[A-Z]", lambda m: m.group().lower(), w) for w in got})


def test_a_word_hashes_alike_wherever_it_stands():
    long = "x" * 9000
    found = words(pa.array([f"a {long} b", f"{long}", "b a"]))
    h = found.hashes().tolist()
    assert h[1] == h[3] and h[0] == h[5] and h[2] == h[4] and len(set(h)) == 3


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=8), max_size=5), st.integers(1, 4))
def test_shingles_are_the_windows(texts, size):
    flat = mix(np.array([w for t in texts for w in t], np.uint64) + np.uint64(1))
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)]).astype(np.int64)
    value, at = shingles(flat, first, size)
    want = [(tuple(t[i:i + size]), f + i) for t, f in zip(texts, first) for i in range(max(len(t) - size + 1, min(1, len(t))))]
    assert at.tolist() == [p for _, p in want]
    groups = {}
    for v, (w, _) in zip(value.tolist(), want):
        groups.setdefault(w, set()).add(v)
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_code_points():
    data = np.frombuffer("aé中".encode(), np.uint8)
    assert code_points(data).tolist() == [0, 1, 2, 2, 3, 3, 3]
