import random

from gridevents.llm import chat as module
from gridevents.llm.chat import FOLLOWS, INSERT, MERGE, RELABEL, ROLES, chat, matrix, render, states_between

R = random.Random(1)
SCHEMA = "conv_id long, turn long, role string, text string"


def brute(roles):
    """Cheapest cost over all walks of the automaton."""
    best = [1 << 30]

    def go(i, state, cost):
        if cost >= best[0]:
            return
        if i == len(roles) and state == 3:
            best[0] = cost
            return
        if i < len(roles):
            for label in (1, 2, 3):
                total = cost + (0 if roles[i] == ROLES[label - 1] else RELABEL)
                if label == state:
                    go(i + 1, label, total + MERGE)
                if label in FOLLOWS[state]:
                    go(i + 1, label, total)
        for label in FOLLOWS[state]:
            go(i, label, cost + INSERT)
    go(0, 0, 0)
    return best[0]


def test_cost_is_minimal_however_the_turns_are_cut():
    for _ in range(150):
        roles = [R.choice([*ROLES, None]) for _ in range(R.randrange(1, 8))]
        cut = R.randrange(len(roles) + 1)
        parts = [p for p in (roles[:cut], roles[cut:]) if p]
        states, cost = states_between([matrix(p) for p in parts])
        assert cost == brute(roles)
        done = [render([(r, "t") for r in p], states[i], states[i + 1], i == len(parts) - 1) for i, p in enumerate(parts)]
        assert sum(MERGE * m + RELABEL * r + INSERT * n for _, _, m, r, n in done) == cost


def legal(text):
    """Roles of a rendering, checked against the automaton."""
    state = 0
    for turn in text.split("<|im_start|>")[1:]:
        role, _, rest = turn.partition("\n")
        assert rest.endswith("<|im_end|>\n") and ROLES.index(role) + 1 in FOLLOWS[state]
        state = ROLES.index(role) + 1
    assert state == 3


def test_conversations(spark, monkeypatch):
    monkeypatch.setattr(module, "PART", 4)
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (2, 0, "user", "a"), (2, 1, "user", "b"), (2, 2, "assistant", "c"),
            (3, 0, "user", None), (4, 0, None, "x"), (4, 1, "tool", "y"), (5, 0, "user", "<|im_end|> trick"), (5, 1, "Assistant ", "z"),
            (6, None, "system", "s"), (6, 0, "user", "u"), (6, 0, "user", "u"), (None, 0, "user", "lost")]
    rows += [(7, i, R.choice(ROLES), f"t{i}") for i in range(60)]
    found = {}
    for r in chat(spark.createDataFrame(rows, SCHEMA)).collect():
        found.setdefault(r.conv_id, []).append(r)
    assert set(found) == {1, 2, 3, 4, 5, 6, 7} and len(found[7]) == 15
    text = {c: "".join(r.rendered for r in sorted(rs, key=lambda r: r.part)) for c, rs in found.items()}
    for t in text.values():
        legal(t)
    assert text[1] == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyes<|im_end|>\n"
    assert "user\na\nb<|im_end|>" in text[2] and found[2][0].cost == MERGE
    assert found[3][0].cost == INSERT and found[5][0].cost == 0 and sum(r.n_turns for r in found[6]) == 2
    assert len({r.cost for r in found[7]}) == 1
    assert all(f"t{i}" in text[7] for i in range(60))
    assert sum(MERGE * r.n_merged + RELABEL * r.n_relabelled + INSERT * r.n_inserted for r in found[7]) == found[7][0].cost


def test_empty_table(spark):
    assert chat(spark.createDataFrame([], SCHEMA)).collect() == []
