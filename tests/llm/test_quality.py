import base64
import random
import re

from gridevents.llm.quality import passing, quality

R = random.Random(5)
PROSE = " ".join("".join(R.choice(["ta", "re", "in", "so", "lu", "mi", "en"]) for _ in range(R.randrange(1, 5))) for _ in range(900))


def brute(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = {}
    for i in range(len(ws) - 7):
        windows.setdefault(tuple(ws[i:i + 8]), []).append(i)
    covered = {i + j for places in windows.values() if len(places) > 1 for i in places for j in range(8)}
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    return (len(ws), sum(map(len, ws)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))


def test_counts_match_brute_force_and_verdicts_follow(docs):
    noise = "\n".join(base64.b64encode(R.randbytes(57)).decode() for _ in range(90))
    texts = ["", None, "one", PROSE, "a b c d e f g h " * 40, "line é 中 #1\nline é 中 #1\n\n \nother", PROSE + " " + PROSE[:400], noise,
             " ".join(f"w{i % 7}" for i in range(3000)), "\n".join(["x y"] * 30), " ".join(str(i % 3) * 300 for i in range(60))]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, PROSE), (3, PROSE)]
    got = quality(docs(rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        text = (PROSE if r.doc_id is None else texts[r.doc_id]) or ""
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(text)
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
    kept = {r.doc_id: r.kept for r in got}
    assert kept[3] and kept[6] and kept[None]
    assert not any(kept[i] for i in (0, 1, 2, 4, 7, 8, 9, 10))


def test_passing_keeps_rows_and_columns(docs):
    frame = docs([(1, PROSE), (2, None), (None, PROSE), (1, PROSE)])
    kept = passing(frame)
    assert kept.columns == frame.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 1]


def test_empty_table(docs):
    assert quality(docs([])).collect() == [] and passing(docs([])).collect() == []
