import math
import random
import re
import zlib
from collections import Counter

import pytest

from gridevents.llm.bloomlm import MU, score

R = random.Random(6)
WORDS = ["".join(R.choice("abcDEé") for _ in range(R.randrange(1, 6))) for _ in range(150)]
TEXTS = {i: " ".join(R.choice(WORDS[: 1 + i]) for _ in range(R.randrange(0, 80))) for i in range(120)} | {200: "", 201: None, 202: "only here"}
FOLD = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD)), "\0"]


def expected(count):
    q = 1 + int(math.log2(count)) if count else 0
    return (3 * 2.0 ** (q - 1) - 1) / 2 if q else 0.0


@pytest.mark.parametrize("options", [{}, {"head": 20}, {"segment_bits": 1, "bits_per_byte": 40}])
def test_scores_match_brute_force(docs, monkeypatch, options):
    import gridevents.llm.bloomlm as module
    monkeypatch.setattr(module, "SHARD_BYTES", 2000)  # several shards, and with small segments several passes
    options = {"bits_per_byte": 40} | options  # so many bits that no false counts come
    got = {r.doc_id: r for r in score(docs([*TEXTS.items(), (None, "a b")]), **options).collect()}
    one, two = Counter(), Counter()
    for i, t in TEXTS.items():
        if zlib.crc32(str(i).encode()) % 10:
            one.update(tokens(t))
            two.update(zip(["\1", *tokens(t)], tokens(t)))
    total, distinct = sum(one.values()), len(one)
    assert set(got) == {*TEXTS, None} and got[None].held_out
    for i, t in TEXTS.items():
        r, ws = got[i], tokens(t)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (
            zlib.crc32(str(i).encode()) % 10 == 0, len(ws), sum(one[w] > 0 for w in ws), total)
        assert abs(r.base_score - sum(math.log10((one[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in ws)) < 1e-8
        want, history = 0.0, one["\0"]
        for before, w in zip(["\1", *ws], ws):
            p = (expected(one[w]) + 0.1) / (total + 0.1 * (distinct + 1))
            c = expected(two[before, w])
            want += math.log10((c + MU * p) / (max(history, c) + MU))
            history = expected(one[w])
        assert abs(r.score - want) < 1e-6


def test_held_out_texts_like_the_corpus_score_better(docs):
    rows = [(i, " ".join(["the cat sat on the mat"] * 5)) for i in range(60)]
    odd = next(i for i in range(1000, 2000) if zlib.crc32(str(i).encode()) % 10 == 0)
    got = {r.doc_id: r for r in score(docs([*rows, (odd, " ".join(["mat the on sat cat the"] * 5))])).collect()}
    alike = next(r for i, r in got.items() if r.held_out and i != odd)
    assert alike.score > got[odd].score + 5 and abs(alike.base_score - got[odd].base_score) < 1e-9


def test_nothing_to_learn_from(docs):
    assert score(docs([])).collect() == []
    r, = score(docs([(None, "a b")])).collect()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (3, 0, 0, True)
