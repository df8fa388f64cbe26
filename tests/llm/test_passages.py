import random
import re

import numpy as np
from hypothesis import given, settings, strategies as st

from gridevents.llm import passages as module
from gridevents.llm.passages import (chains, common_pairs, common_words, cut, minimizers, passages, pieces,
                                     without_passages)

R = random.Random(2)


def prose(n):
    return ["".join(R.choice("abcdefghij") for _ in range(R.randrange(2, 8))) for _ in range(n)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=14), st.lists(st.integers(0, 4), max_size=14))
def test_common_words_is_the_longest_common_subsequence(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert common_words(a, b) == table[-1][-1]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=14), st.lists(st.integers(0, 4), max_size=14), st.sampled_from([8, 1 << 28]))
def test_common_pairs_are_a_longest_common_subsequence(a, b, bits):
    kept, module.TRACE_BITS = module.TRACE_BITS, bits
    try:
        found = common_pairs(a, b)
    finally:
        module.TRACE_BITS = kept
    assert len(found) == common_words(a, b) and all(a[i] == b[j] for i, j in found)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(found, found[1:]))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 12), st.integers(0, 5), st.integers(0, 5)), min_size=1, max_size=7))
def test_pieces_meet_all_similar_regions(runs):
    one, two = [], []
    for n, (shared, here, there) in enumerate(runs):
        same = [f"s{n}.{x}" for x in range(shared)]
        one += same + [f"o{n}.{x}" for x in range(here)]
        two += same + [f"t{n}.{x}" for x in range(there)]
    found, other = pieces(one, two, 0.8, 8), {w: j for j, w in enumerate(two)}
    common = [i for i, w in enumerate(one) if w in other]
    for a in common:  # brute force over all regions that begin and end with a common word
        for b in common:
            far = other[one[b]] - other[one[a]] + 1
            if b - a + 1 >= 8 and 2 * sum(a <= i <= b for i in common) >= 0.8 * (b - a + 1 + far):
                assert any(x <= b and a <= y for x, y in found)
    for n, (shared, _, _) in enumerate(runs):
        a = one.index(f"s{n}.0")
        assert shared < 8 or any(x <= a and a + shared - 1 <= y for x, y in found)
    for x, y in found:
        far = other[one[y]] - other[one[x]] + 1
        assert 2 * sum(x <= i <= y for i in common) >= 0.8 * (y - x + 1 + far) - 1e-9


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 40)), max_size=9, unique=True))
def test_first_chain_has_the_best_score(places):
    def best(places):
        top = {}
        for x, y in sorted(places):
            top[x, y] = 1 + max([0] + [s - (x - a + y - b) / 20 for (a, b), s in top.items() if a < x and b < y])
        return max(top.values(), default=0)
    found = chains([(x, y) for x, y in places], gap_cost=20, gap_cut=1000)
    assert sorted(p for c in found for p in c) == sorted(places)
    score = lambda c: len(c) - sum((d[0] - a[0] + d[1] - a[1]) / 20 for a, d in zip(c, c[1:]))
    assert not places or abs(max(map(score, found)) - best(places)) < 1e-9


def test_minimizers_touch_every_window():
    value = np.array([R.randrange(1 << 40) for _ in range(300)], np.uint64)
    owner = np.repeat([0, 1, 2], [200, 97, 3])
    picked = set(minimizers(value, owner, 10).tolist())
    for o, (a, b) in enumerate([(0, 200), (200, 297), (297, 300)]):
        for i in range(a, max(b - 9, a + 1)):
            window = range(i, min(i + 10, b))
            assert min(window, key=lambda j: value[j]) in picked


def test_planted_passages_are_found_and_clean_texts_left_alone(docs):
    passage, other = prose(70), prose(60)
    fuzzy = list(passage)
    for i in (20, 45):
        fuzzy[i] = "changed"
    texts = {i: " ".join(prose(R.randrange(30, 120))) for i in range(20)}
    texts[30] = " ".join(prose(40) + passage + prose(40))
    texts[31] = " ".join(prose(10) + passage) + "\n"
    texts[32] = "é中\n\n" + " ".join(passage) + " " + " ".join(prose(90))
    texts[33] = " ".join(prose(25) + fuzzy + prose(25))
    texts[34] = " ".join(other)
    texts[35] = " ".join(other)
    texts[36] = " ".join(passage[:30] + prose(40))    # too short a repeat
    texts[37] = " ".join(prose(5) + passage + prose(3) + other + prose(4))
    texts |= {40: "", 41: None}
    rows = list(texts.items()) + [(31, texts[31]), (None, texts[30])]
    frame = docs(rows)
    found = passages(frame).collect()
    spans = {}
    for r in found:
        spans.setdefault(r.doc_id, []).append((r.start, r.end, r.n_words, r.source_doc_id))
    assert set(spans) == {31, 32, 33, 35, 37}
    for i in (31, 32):
        (start, end, n, source), = spans[i]
        assert texts[i][start:end] == " ".join(passage) and n == 70 and source == 30
    (start, end, n, _), = spans[33]
    assert texts[33][start:end] == " ".join(fuzzy) and n == 70
    assert spans[35] == [(0, len(texts[35]), 60, 34)]
    assert sorted(texts[37][s:e] for s, e, *_ in spans[37]) == sorted([" ".join(passage), " ".join(other)])
    left = {r.doc_id: r.text for r in without_passages(frame, passages(frame)).where("doc_id IS NOT NULL").collect()}
    assert left[30] == texts[30] and left[36] == texts[36] and left[3] == texts[3] and left[41] is None
    assert 35 not in left and len(re.findall(r"\S+", left[37])) == 12


def test_a_passage_that_very_many_texts_share(docs):
    line = prose(55)
    rows = [(i, " ".join(prose(30) + line + prose(20))) for i in range(200)]
    found = passages(docs(rows)).collect()
    assert sorted(r.doc_id for r in found) == list(range(1, 200))
    assert all(r.source_doc_id < r.doc_id and 55 <= r.n_words <= 57 for r in found)  # a word beside it may agree by chance


def test_shared_paragraphs_between_rewritten_words(docs):
    shared = [prose(55) for _ in range(5)]
    texts = {i: " ".join(w for p in shared for w in p + prose(20)) for i in (1, 2)}
    found = passages(docs(list(texts.items()))).collect()
    spans = sorted((r.start, r.end) for r in found)
    for p in shared:
        at = texts[2].index(" ".join(p))
        assert any(a <= at and at + len(" ".join(p)) <= b for a, b in spans)
    assert sum(r.n_words for r in found) <= 5 * 57


def test_a_repeat_inside_a_rejected_chain(docs):
    newer, fresh = prose(160), prose(160)
    older = list(newer)
    for at in range(20, 160, 34):  # every seed of the edits' surroundings is new, and the passage is 0.7 alike
        older[at:at + 10] = fresh[at:at + 10]
    texts = {1: older, 5: newer, 9: newer}
    texts = {i: " ".join(prose(30) + t + prose(30)) for i, t in texts.items()}
    spans = [(r.start, r.end) for r in passages(docs(list(texts.items()))).collect() if r.doc_id == 9]
    at = texts[9].index(" ".join(newer))
    assert any(a <= at and at + len(" ".join(newer)) <= b for a, b in spans)


def test_passages_of_long_words(docs):
    hashes = lambda n: ["".join(R.choice("0123456789abcdef") for _ in range(64)) for _ in range(n)]
    shared = hashes(55)
    texts = {i: "é中 " + " ".join(hashes(12) + shared + hashes(9)) for i in (3, 4)}
    found = passages(docs(list(texts.items()))).collect()
    assert [(r.doc_id, texts[4][r.start:r.end], r.n_words) for r in found] == [(4, " ".join(shared), 55)]


def test_seeds_that_smaller_documents_hold_by_chance(docs):
    shared = prose(60)
    texts = {i: " ".join(prose(20) + shared[i:i + 5] + prose(20)) for i in range(56)}
    texts |= {i: " ".join(prose(30) + shared + prose(30)) for i in (100, 101)}
    found = passages(docs(list(texts.items()))).collect()
    assert [(r.doc_id, r.source_doc_id) for r in found] == [(101, 100)]
    assert " ".join(shared) in texts[101][found[0].start:found[0].end]


def test_repeated_rows_and_several_texts_of_one_id(docs):
    shared = prose(60)
    whole, other = " ".join(prose(7) + shared), " ".join(prose(12))
    rows = [(1, " ".join(shared)), (2, whole), (2, whole), (2, other), (2, " \n"), (2, None)]
    found = passages(docs(rows)).collect()
    assert [(r.doc_id, whole[r.start:r.end], r.n_words, r.source_doc_id) for r in found] == [(2, " ".join(shared), 60, 1)]


def test_cut_and_empty(docs):
    assert cut("abcdef", [(4, 5), (1, 2)]) == "acdf"
    assert passages(docs([])).collect() == []
