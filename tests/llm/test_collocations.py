import random
import re
from collections import Counter

import pytest

from gridevents.llm import collocations as module
from gridevents.llm.collocations import collocations

R = random.Random(5)
FOLD = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def brute(rows, least, top):
    counts = {}
    for lang, text in rows:
        own = counts.setdefault(lang or "und", Counter())
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(FOLD)):
            w = re.findall(r"[^\x20\x09]+", piece)
            own.update(tuple(w[i:i + m]) for m in range(1, 6) for i in range(len(w) - m + 1))
    out = []
    for lang, own in counts.items():
        n = sum(c for p, c in own.items() if len(p) == 1)
        cand = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        inner = {p[i:i + m] for p, a in cand.items() for m in range(2, len(p)) for i in range(len(p) - m + 1)
                 if 100 * a >= 100 * cand[p[i:i + m]]}
        ranked = []
        for p, a in cand.items():
            if p not in inner:
                score, k = min((1000 * a * n // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
                ranked.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r) in enumerate(sorted(ranked)[:top])]
    return sorted(out)


def text(words, phrases, size):
    parts = []
    while len(parts) < size:
        parts += R.choice(phrases) if R.random() < 0.3 else [R.choice(words)]
    return "".join(w + R.choice([" ", " ", " ", "  ", "\t", ", ", ". ", "\n", "!? "]) if R.random() < 0.4 else w + " " for w in parts)


def check(spark, rows, least, top):
    frame = spark.createDataFrame([(i, lang, t, "x", 1, 2) for i, (lang, t) in enumerate(rows)],
                                  "doc_id long, lang string, text string, word string, n long, hash long")
    got = sorted(tuple(r) for r in collocations(frame, least, top).collect())
    assert got == brute(rows, least, top)
    return got


@pytest.mark.parametrize("top", [4, 60, 5000])
def test_matches_brute_force(spark, monkeypatch, top):
    """Settled after the first wave, later, and only when all is expanded; small flushes and chunks."""
    monkeypatch.setattr(module, "FLUSH", 500)
    monkeypatch.setattr(module, "CHUNK", 64)
    words = [f"w{int(R.paretovariate(0.6))}" for _ in range(300)] + ["The", "É", "ölÖl", "of x"]
    phrases = [[R.choice(words) for _ in range(R.randint(2, 7))] for _ in range(25)]
    rows = [(R.choice(["en", "en", "de", None, "und"]), text(words, phrases, R.choice([3, 40, 200]))) for _ in range(150)]
    rows += [("en", None), ("fr", ""), ("fr", " \t .,"), (None, None)] + rows[:30]
    assert check(spark, rows, 6, top)


def test_a_small_bit_table_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(module, "TABLE_BITS", 1 << 16)
    words = [f"w{i}" for i in range(2000)]
    check(spark, [("en", text(words[:R.choice([50, 2000])], [["a", "b", "c"], ["w1", "w2"]], 300)) for _ in range(60)], 3, 40)


def test_repeats_overlaps_and_ties(spark):
    check(spark, [("en", "a a a a a a a a"), ("en", "b c. b c, B C b c"), ("en", "d e\nd e; d e d e")], 2, 2000)
    check(spark, [("en", "a b c d e f g ")] * 12 + [("en", "x b c d e f y")] * 3, 10, 2000)


def test_a_very_long_text_and_long_words(spark):
    check(spark, [("en", "new york city " * 20000 + "z" * 50000)] + [("en", "z" * 50000 + " end")] * 5, 5, 2000)


def test_no_rows_or_no_phrases(spark):
    assert check(spark, [], 5, 10) == []
    assert check(spark, [("en", "one two three"), (None, None)], 5, 10) == []
