import itertools
import random
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from gridevents.llm import mixing
from gridevents.llm.mixing import fit, knapsack, mixture

R = random.Random(3)


def levels(words):
    """Targets by resharing the excess, in fractions."""
    order = sorted(words, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    capped, total = set(), sum(words.values())
    while True:
        rest = total - sum(3 * words[s] for s in capped)
        free = sum(weight[s] for s in words if s not in capped)
        if not free:
            break
        new = {s for s in words if s not in capped and Fraction(rest * weight[s], free) > 3 * words[s]}
        if not new:
            break
        capped |= new
    return {s: float(3 * words[s]) if s in capped else float(Fraction(rest * weight[s], free)) for s in words}


def check(spark, rows, window=mixing.WINDOW, near=1):
    frame = spark.createDataFrame([(*r, "x", 1, 2.0) for r in rows], "doc_id long, source string, text string, n string, words int, copies double")
    got = [tuple(r) for r in mixture(frame, window=window).collect()]
    sizes = [(i, s, len((t or "").split())) for i, s, t in rows]
    assert Counter(g[:3] for g in got) == Counter(sizes)
    words = Counter()
    for _, s, n in sizes:
        words[s] += n
    want = levels(words)
    taken = Counter()
    for _, s, size, source_size, target, n in got:
        assert source_size == words[s] and target == pytest.approx(want[s], rel=1e-12)
        assert n == 0 if not size else n % size == 0 and n <= 3 * size
        taken[s] += n
    for s in words:
        assert abs(taken[s] - want[s]) <= near
    return sorted(got, key=str)


def text(n):
    return " ".join(["w"] * n)


def test_sources_meet_their_targets_and_reruns_agree(spark, monkeypatch):
    monkeypatch.setattr(mixing, "PART_ROWS", 16)
    rows = [(i, R.choice(["a", "b", "b", "c", "d", "é", None]), text(int(R.paretovariate(1)) + R.randint(0, 30))) for i in range(1500)]
    once = check(spark, rows)
    R.shuffle(rows)
    assert check(spark, rows) == once
    check(spark, rows, window=64)


def test_repeated_rows_nulls_and_empty_texts(spark):
    rows = [(None, "a", text(7)), (1, None, None), (2, "", ""), (3, "a", " \t\n")]
    check(spark, rows + [(5, "a", text(3))] * 700 + [(None, "b", text(2))] * 400 + [(i, "c", text(1)) for i in range(90)])


def test_capped_sources_small_tables(spark):
    check(spark, [(1, "a", text(1)), (2, "b", text(100)), (3, "c", text(500))], near=250)
    check(spark, [])
    check(spark, [(1, "a", None), (2, "b", "")])
    check(spark, [(1, "a", text(12))])


def test_a_length_with_most_documents_is_spread(spark, monkeypatch):
    monkeypatch.setattr(mixing, "PART_ROWS", 8)
    check(spark, [(i, "a", text(5)) for i in range(900)] + [(i, "b", text(4 + i % 9)) for i in range(300)], near=5)


def test_knapsack_finds_the_nearest_sum():
    for _ in range(300):
        size = np.array(sorted(R.sample(range(1, 25), R.randint(1, 5))))
        count = np.array([R.randint(0, 4) for _ in size])
        budget = R.randint(1, 80)
        taken, best = knapsack(size, count, budget)
        assert (taken <= count).all() and (taken * size).sum() == best
        sums = {sum(c * s for c, s in zip(cs, size)) for cs in itertools.product(*[range(n + 1) for n in count])}
        assert abs(best - budget) == min(abs(x - budget) for x in sums)


def test_fit_is_nearest_on_small_sources_and_exact_on_varied_ones():
    for _ in range(200):
        size = np.array(sorted(R.sample(range(0, 20), R.randint(1, 5))))
        count = np.array([R.randint(1, 3) for _ in size])
        total = int((size * count).sum())
        target = R.uniform(0, 3 * total)
        whole, extra = fit(size, count, target)
        sums = {sum(c * s for c, s in zip(cs, size)) for cs in itertools.product(*[range(n + 1) for n in count])}
        got = whole * total + int((size * extra).sum())
        assert (extra <= count).all() and whole + (extra > 0).any() <= 3
        assert abs(got - round(target)) == min(abs(whole * total + x - round(target)) for x in sums)
    size = np.arange(1, 3000)
    count = 1 + 10 ** 7 // size ** 2
    for share in (0.1, 1.37, 2.999):
        target = share * int((size * count).sum())
        whole, extra = fit(size, count, target)
        assert whole * int((size * count).sum()) + int((size * extra).sum()) == round(target)


def test_fit_with_documents_far_longer_than_the_window():
    size, count = np.array([1_000_000, 2_500_001]), np.array([10, 10])
    whole, extra = fit(size, count, 0.5 * (size * count).sum(), window=1000)
    assert whole == 0 and abs(int((size * extra).sum()) - 0.5 * (size * count).sum()) <= 1_500_000
