import hashlib
import math
import random

import pytest

from gridevents.llm import centroids as module
from gridevents.llm.centroids import clusters, limbs

R = random.Random(11)


def brute(rows, count, rounds):
    kept = [(i, [math.floor(256 * x) if abs(x) < 2 ** 60 else 256 * int(x) for x in v]) for i, v in rows
            if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1])
    cs = [v for _, v in sorted((r for r in kept if r[0] is not None), key=key)[:count]]
    if not cs:
        return []
    dist = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    near = lambda v: min((dist(v, c), k) for k, c in enumerate(cs))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for k in range(len(cs)):
            mine = [v for (_, v), o in zip(kept, own) if o == k]
            if mine:
                cs[k] = [sum(x) // len(mine) for x in zip(*mine)]
    found = [(i, *near(v)[::-1]) for i, v in kept]
    fits = lambda x: x if x < 2 ** 63 else None
    def total(some):
        return fits(sum(some)) if all(x < 2 ** 63 for x in some) else None
    per = {k: total([d for _, o, d in found if o == k]) for k in range(len(cs))}
    whole = total([d for _, _, d in found])
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cs]
    return sorted(((i, k, fits(d), per[k], whole, sha[k]) for i, k, d in found), key=str)


def check(spark, rows, count=7, rounds=5, kind="double"):
    frame = spark.createDataFrame([(i, v, "x", 3) for i, v in rows], f"vec_id long, embedding array<{kind}>, cluster string, v int")
    got = sorted((tuple(r) for r in clusters(frame, count, rounds).collect()), key=str)
    assert got == brute(rows, count, rounds)
    return got


def blob(centre, spread):
    return [c + R.gauss(0, spread) for c in centre]


def test_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(module, "SLICE", 50)
    centres = [[R.gauss(0, 1) for _ in range(64)] for _ in range(9)]
    rows = [(i, blob(R.choice(centres), 0.4)) for i in range(400)]
    check(spark, rows)
    check(spark, rows + rows[:60] + [(None, blob(centres[0], 0.1))] * 3, 40, 2)


def test_vectors_that_take_no_part_and_ties(spark):
    odd = [(900, None), (901, [1.0] * 63), (902, [1.0] * 65), (903, [1.0] * 63 + [None]), (904, [float("nan")] * 64),
           (905, [float("-inf")] + [0.0] * 63), (906, [])]
    same = [(i, [0.5, -0.25] * 32) for i in range(50)]
    assert len(check(spark, odd + same + [(60, [0.5, -0.26] * 32)] * 2, 5)) == 52
    assert check(spark, odd, 5) == []


def test_few_or_no_rows(spark):
    assert check(spark, []) == []
    assert check(spark, [(None, [1.0] * 64)]) == []
    check(spark, [(3, [1.0] * 64), (4, [-1.0] * 64)], 40)
    check(spark, [(i, [i / 7] * 64) for i in range(9)], 3, 0)


@pytest.mark.parametrize("size", [100.0, 2.0 ** 13, 1e7, 1e17, 1e30])
def test_large_components_stay_exact(spark, size):
    rows = [(i, [R.uniform(-1, 1) * (size if i % 5 == 0 else 1.0) for _ in range(64)]) for i in range(40)]
    check(spark, rows, 6, 3)


def test_limbs():
    for x in [0, 5, -5, 2 ** 32, -2 ** 32, 2 ** 70 + 3, -2 ** 70 - 3, -2 ** 33 - 1]:
        assert sum(part << (32 * place) for place, part in limbs(x)) == x
