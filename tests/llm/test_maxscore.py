import math
import random

from pyspark.sql import functions as F

from conftest import plan
from gridevents.llm import maxscore
from gridevents.llm.maxscore import top_k

R = random.Random(9)


def brute(rows, asked, k=5):
    whole = {(i, tuple(math.floor(256 * x) for x in v)) for i, v in rows
             if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = set()
    for q, a in whole:
        if asked(q):
            ranked = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in whole if i != q)[:k]
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(ranked)}
    return out


def check(spark, rows):
    frame = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, score string")
    got = top_k(frame, F.col("vec_id") % 5 == 0).collect()
    assert {tuple(r) for r in got} == brute(rows, lambda q: q % 5 == 0) and len(got) == len({tuple(r) for r in got})


def test_matches_brute_force_over_several_shards(spark, monkeypatch):
    monkeypatch.setattr(maxscore, "SHARD_ROWS", 200)
    monkeypatch.setattr(maxscore, "QUERY_ROWS", 30)
    monkeypatch.setattr(maxscore, "SEEDS", 20)
    rows = [(i, [R.gauss(0, 1) * (0.2 if d else 3) if R.random() < 0.7 else 0.0 for d in range(12)]) for i in range(700)]
    check(spark, rows + rows[:40])


def test_ties_repeats_and_vectors_that_take_no_part(spark, monkeypatch):
    monkeypatch.setattr(maxscore, "SEEDS", 8)
    same = [(i, [0.5, -0.25, 1.0]) for i in range(60)]
    odd = [(100, None), (105, [1.0, None, 2.0]), (110, [float("nan"), 0.0, 0.0]), (115, [float("inf"), 0.0, 0.0]), (None, [1.0, 1.0, 1.0]),
           (120, []), (125, [2.0]), (130, [1e3, -1e3, 1e3])]
    check(spark, same + odd + same[:7])


def test_few_or_no_candidates(spark):
    check(spark, [(0, [1.0]), (1, [2.0])])
    check(spark, [(5, [1.0])])
    check(spark, [])


def test_large_components_stay_exact(spark):
    check(spark, [(i, [R.uniform(-1, 1) * 2 ** 22 for _ in range(6)]) for i in range(60)])


def test_components_beyond_32_bits_take_part(spark):
    check(spark, [(i, [R.uniform(-1, 1) for _ in range(4)]) for i in range(20)] + [(25, [1e7, -3.5, 2.0, 1.0]), (31, [-9e6, 1e8, 0.25, 4.0])])


def test_blocks_are_never_broadcast(spark, monkeypatch):
    """Blocks of queries are repeated for every shard: the size of the few queries must not decide."""
    monkeypatch.setattr(maxscore, "SHARD_ROWS", 50)
    frame = spark.range(400).select(F.col("id").alias("vec_id"), F.array(F.col("id") % 7 - 3.0, F.col("id") % 5 - 2.0).alias("embedding"))
    got = top_k(frame, F.col("vec_id") % 50 == 0)
    assert "SortMergeJoin" in plan(got, "simple")
    assert got.count() == 8 * 5 and "BroadcastExchange" not in plan(got, "simple")
