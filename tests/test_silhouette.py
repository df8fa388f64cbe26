import numpy as np
import pytest

from gridevents.operators import silhouette
from gridevents.operators.silhouette import chosen, silhouettes


def brute(x, own):
    """Exact Euclidean and squared mean silhouettes over all pairs."""
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    out = []
    for m in (d, d ** 2):
        scores = []
        for i, c in enumerate(own):
            n = (own == c).sum()
            if n == 1 or len(set(own)) < 2:
                scores.append(0.0)
                continue
            a = m[i][own == c].sum() / (n - 1)
            b = min(m[i][own == o].mean() for o in set(own) - {c})
            scores.append((b - a) / max(a, b) if max(a, b) else 0.0)
        out.append(np.mean(scores))
    return out


def table(spark, x, labels):
    rows = [(v.tolist(), *[int(labels[k][i]) for k in labels]) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "features array<double>, " + ", ".join(f"l{k} int" for k in labels)).repartition(3)


def grouped(rng, groups, n, width, spread):
    centre = rng.normal(size=(groups, width)) * 4
    own = rng.integers(0, groups, n)
    return centre[own] + rng.normal(size=(n, width)) * spread, own


@pytest.mark.parametrize("shift", [0.0, 1e6])
@pytest.mark.parametrize("pivots", [1, 4, 1000])
def test_bounds_enclose_the_exact_score(spark, pivots, shift):
    rng = np.random.default_rng(7)
    x, own = grouped(rng, 4, 120, 5, 1.0)
    x = np.vstack([x + shift, x[:7] + shift])
    own = np.concatenate([own, own[:7]])
    labels = {4: own, 2: own % 2, 3: rng.integers(0, 3, len(x)), 9: np.where(np.arange(len(x)) == 5, 8, own)}
    got = {r["k"]: r for r in silhouettes(table(spark, x, labels), {k: f"l{k}" for k in labels}, first=pivots, settle=False).collect()}
    for k, c in labels.items():
        exact, squared = brute(x, c)
        assert got[k]["low"] - 1e-12 <= exact <= got[k]["high"] + 1e-12
        assert got[k]["squared"] == pytest.approx(squared, abs=1e-6)
        if pivots == 1000:
            assert got[k]["high"] - got[k]["low"] < 1e-4


def test_only_rivals_are_refined(spark):
    rng = np.random.default_rng(3)
    x, own = grouped(rng, 4, 300, 6, 1.2)
    labels = {4: own, 2: rng.integers(0, 2, 300), 5: np.where(rng.random(300) < 0.04, 4, own)}
    got = {r["k"]: r for r in silhouettes(table(spark, x, labels), {k: f"l{k}" for k in labels}, first=1).collect()}
    exact = {k: brute(x, c)[0] for k, c in labels.items()}
    assert got[2]["pivots"] == 1 < got[4]["pivots"]
    assert [k for k in got if got[k]["best"]] == [max(exact, key=exact.get)]


def test_undecided_and_equal_scores(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x, own = grouped(rng, 3, 60, 3, 1.0)
    labels = {3: own, 4: own}
    frame = table(spark, x, labels)
    undecided = silhouettes(frame, {3: "l3", 4: "l4"}, first=1, most=2)
    assert not any(r["best"] for r in undecided.collect()) and chosen(undecided) == 3
    assert [r["k"] for r in silhouettes(frame, {3: "l3", 4: "l4"}, first=16).collect() if r["best"]] == [3]


def test_small_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(silhouette, "MATRIX", 8)
    same = np.ones((5, 2))
    labels = {2: np.array([0, 0, 1, 1, 1])}
    assert [(r["low"], r["high"]) for r in silhouettes(table(spark, same, labels), {2: "l2"}).collect()] == [(0.0, 0.0)]
    one = {1: np.zeros(5)}
    assert [r["squared"] for r in silhouettes(table(spark, same, one), {1: "l1"}).collect()] == [0.0]
    assert silhouettes(table(spark, same, labels).limit(0), {2: "l2"}).count() == 0
    with pytest.raises(ValueError):
        chosen(silhouettes(table(spark, same, labels).limit(0), {2: "l2"}))
