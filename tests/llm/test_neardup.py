import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from gridevents.llm import neardup
from gridevents.llm.components import components
from gridevents.llm.dartminhash import signatures
from gridevents.llm.neardup import forest, near_duplicates, similarities

R = random.Random(11)
WORDS = ["".join(R.choice("abcdefgh") for _ in range(4)) for _ in range(500)]


def prose(n):
    return [R.choice(WORDS) for _ in range(n)]


def edited(words, n):
    words = list(words)
    for i in R.sample(range(len(words)), n):
        words[i] = R.choice(WORDS)
    return words


def classes(texts):
    """Brute force over plain and weighted similarity of all pairs."""
    ids = [i for i, t in texts.items() if t and t.split()]
    parent = {i: i for i in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a in ids:
        close = similarities(pa.array([texts[a]] * len(ids)), pa.array([texts[b] for b in ids])) >= 0.8
        for b in np.flatnonzero(close):
            x, y = sorted((root(a), root(ids[b])))
            parent[y] = x
    return {i: root(i) for i in texts}


def test_similarity_is_exact():
    def plain(a, b):
        sets = [{tuple(t[i:i + 5]) for i in range(max(1, len(t) - 4))} for t in (a, b)]
        return len(sets[0] & sets[1]) / len(sets[0] | sets[1])
    pairs = [(w, edited(w, n)) for n in (0, 1, 3, 9) for w in [prose(80)]] + [(["a", "b"], ["a", "b"]), (["a"], ["b"])]
    got = similarities(pa.array([" ".join(a) for a, _ in pairs]), pa.array([" ".join(b) for _, b in pairs]))
    assert np.allclose(got, [plain(a, b) for a, b in pairs])


def test_signature_agreement_estimates_weighted_similarity():
    rng = np.random.default_rng(3)
    element = rng.integers(1, 1 << 62, 200, dtype=np.uint64)
    one, two = np.ones(200), np.where(np.arange(200) < 60, 2.5, 1.0)
    found = [np.mean(s[0] == s[1]) for s in (signatures(np.concatenate([element] * 2), np.concatenate([one, two]),
                                                        np.array([0, 200, 400]), 192, seed) for seed in range(25))]
    assert abs(np.mean(found) - 200 / 290) < 0.02
    assert (signatures(element, one, np.array([0, 0, 200]), 64)[0] == 0).all()


def test_forest_joins_all_that_is_linked():
    base = prose(60)
    texts = [" ".join(edited(base, R.randrange(0, 4))) for _ in range(40)] + ["q r s t u " * 9, "q r s t u " * 12]
    left = np.arange(0, 42, 2)
    found = forest(pa.array(texts), left, 5, 0.8)
    graph = defaultdict(set)
    close = [(i, k) for i in left for k in range(42) if i != k and similarities(pa.array([texts[i]]), pa.array([texts[k]]))[0] >= 0.8]

    def parts(edges):
        parent = list(range(42))

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x
        for a, b in edges:
            parent[root(a)] = root(b)
        return frozenset(frozenset(i for i in range(42) if root(i) == root(j)) for j in range(42))
    assert parts(found) == parts(close) and len(found) < 42 and not graph


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (200, 100), (7, 7)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, 100: 100, 101: 100, 200: 100}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_classes_match_brute_force(docs, monkeypatch):
    monkeypatch.setattr(neardup, "FULL", 6)   # so that the large group below is compared in cells
    monkeypatch.setattr(neardup, "BLOCK", 8)
    hot, texts = prose(60), {}
    for i in range(40):
        texts[i] = " ".join(edited(hot, R.randrange(0, 5)))
    for i in range(40, 70):
        texts[i] = " ".join(prose(R.randrange(1, 90)))
    for i in range(70, 80):
        texts[i] = " ".join(edited(texts[i - 30].split(), 1))
    texts |= {80: "", 81: None, 82: "  \n", 83: texts[40], 84: texts[40], 85: "a b", 86: "a  b"}
    rows = list(texts.items()) + [(85, "a b"), (None, texts[40])]
    got = {r.doc_id: r for r in near_duplicates(docs(rows)).collect()}
    want = classes(texts)
    assert {i: r.class_id for i, r in got.items()} == want
    sizes = defaultdict(int)
    for c in want.values():
        sizes[c] += 1
    assert all(r.class_size == sizes[r.class_id] and r.is_kept == (i == r.class_id) for i, r in got.items())


def test_doubled_texts_match_brute_force(docs):
    texts = {}
    for i in range(0, 120, 2):
        page = prose(R.randrange(60, 120))
        texts[i], texts[i + 1] = " ".join(page), " ".join(page * 2)
    got = {r.doc_id: r.class_id for r in near_duplicates(docs(list(texts.items()))).collect()}
    assert got == classes(texts) and all(got[i + 1] == i for i in range(0, 120, 2))


def test_empty_table(docs):
    assert near_duplicates(docs([])).collect() == []
