"""Chat formatting: cheapest repair of a conversation's roles, then its rendering.

A legal conversation is a walk of a small automaton: an optional system turn, then user
and assistant in turn, ending with the assistant.  A given turn keeps its role or is
relabelled, and it opens a turn or is merged into the turn before it when that has the
same role; empty turns may be put in between.  Dynamic programming over the automaton's
states finds the cheapest way.

One turn is a (min, +) matrix over the states, and so is any run of turns.  Conversations
are cut into parts of ``PART`` turn numbers: every part gives its matrix, the few
matrices of a conversation give the states between parts, and every part is repaired
between its states.  No task holds more than a part, however long a conversation is.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

#: Turn numbers of a part.
PART = 256
MERGE, RELABEL, INSERT = 1, 2, 3
ROLES = ("system", "user", "assistant")
#: States: nothing yet, or the role of the last turn; the turns each state may open.
START = 0
FOLLOWS = {0: (1, 2), 1: (2,), 2: (3,), 3: (2,)}
FINAL = 3
NEVER = 1 << 40

OPEN, CLOSE = "<|im_start|>{}\n", "<|im_end|>\n"


def _inserts() -> dict[tuple[int, int], tuple[int, ...]]:
    """Shortest sequence of empty turns from a state to one that may open a given turn."""
    out = {}
    for state in range(4):
        paths: list[tuple[int, tuple[int, ...]]] = [(state, ())]
        for at, path in paths:
            for role in FOLLOWS[at]:
                out.setdefault((state, role), path)
                if len(path) < 3:
                    paths.append((role, (*path, role)))
    return out


_INSERTS = _inserts()


def steps(role: str | None, state: int) -> list[tuple[int, int, str, tuple[int, ...]]]:
    """(cost, next state, merge or open, empty turns before) for a turn in a state, in order of preference."""
    given = ROLES.index(role) + 1 if role in ROLES else 0
    out = []
    for label in (1, 2, 3):
        cost = 0 if label == given else RELABEL
        if label == state:
            out.append((cost + MERGE, label, "merge", ()))
        if (state, label) in _INSERTS:
            between = _INSERTS[state, label]
            out.append((cost + INSERT * len(between), label, "open", between))
    return sorted(out, key=lambda s: (s[0], s[2], s[1]))


_STEPS = {(role, state): steps(role, state) for role in (*ROLES, None) for state in range(4)}


def _known(role: str | None) -> str | None:
    role = role.strip().lower() if role else None
    return role if role in ROLES else None


def matrix(roles: list[str | None]) -> list[int]:
    """Cheapest cost from every state to every state over the turns, row by row."""
    out = []
    for begin in range(4):
        cost = {begin: 0}
        for role in roles:
            following: dict[int, int] = {}
            for state, so_far in cost.items():
                for extra, label, *_ in _STEPS[role, state]:
                    if so_far + extra < following.get(label, NEVER):
                        following[label] = so_far + extra
            cost = following
        out += [cost.get(end, NEVER) for end in range(4)]
    return out


def states_between(matrices: list[list[int]]) -> tuple[list[int], int]:
    """The state before each part and after the last, and the whole cost with the closing empty turns."""
    best, back = {START: 0}, []
    for m in matrices:
        following: dict[int, tuple[int, int]] = {}
        for state, cost in sorted(best.items()):
            for end in range(4):
                total = cost + m[4 * state + end]
                if total < following.get(end, (NEVER, 0))[0]:
                    following[end] = total, state
        back.append({end: state for end, (_, state) in following.items()})
        best = {end: cost for end, (cost, _) in following.items()}
    cost, end = min((cost + INSERT * len(closing(state)), state) for state, cost in best.items())
    out = [end]
    for step in reversed(back):
        out.append(step[out[-1]])
    return out[::-1], cost


def closing(state: int) -> tuple[int, ...]:
    """Empty turns that bring a conversation to its end."""
    return () if state == FINAL else (*_INSERTS[state, FINAL], FINAL)


def repair(roles: list[str | None], begin: int, end: int) -> list[tuple[int, str, tuple[int, ...]]]:
    """(state after, merge or open, empty turns before) for every turn on the cheapest way between two states."""
    best: list[dict[int, tuple[int, int, tuple]]] = [{begin: (0, -1, ())}]
    for role in roles:
        following: dict[int, tuple[int, int, tuple]] = {}
        for state, (cost, _, _) in sorted(best[-1].items()):
            for extra, label, kind, between in _STEPS[role, state]:
                if cost + extra < following.get(label, (NEVER,))[0]:
                    following[label] = cost + extra, state, (label, kind, between)
        best.append(following)
    out, state = [], end
    for layer in reversed(best[1:]):
        _, state, step = layer[state]
        out.append(step)
    return out[::-1]


def _guarded(text: str) -> str:
    """Marks inside a text do not end its turn."""
    return text.replace("<|im_start|>", "<|im_start |>").replace("<|im_end|>", "<|im_end |>")


def render(turns: list[tuple[str | None, str]], begin: int, end: int, last: bool) -> tuple[str, int, int, int, int]:
    """(text, turns written, merged, relabelled, inserted) of a part between two states."""
    out, written, merged, relabelled, inserted, state = [], 0, 0, 0, 0, begin

    def opened(label: int, text: str) -> None:
        nonlocal state, written
        out.append((CLOSE if state else "") + OPEN.format(ROLES[label - 1]) + text)
        state, written = label, written + 1

    for (role, text), (label, kind, between) in zip(turns, repair([r for r, _ in turns], begin, end)):
        for empty in between:
            opened(empty, "")
            inserted += 1
        relabelled += ROLES[label - 1] != role
        if kind == "merge":
            out.append("\n" + _guarded(text))
            merged += 1
        else:
            opened(label, _guarded(text))
    if last:
        for empty in closing(state):
            opened(empty, "")
            inserted += 1
        out.append(CLOSE)
    return "".join(out), written, merged, relabelled, inserted


def chat(conversations: DataFrame) -> DataFrame:
    """(conv_id, part, rendered, n_turns, n_written, n_merged, n_relabelled, n_inserted, cost).

    Turns are ordered by turn, then role and text.  ``part`` is 0, 1, ... for every ``PART``
    turn numbers that hold turns; the rendering of a conversation is that of its parts one
    after another, and ``cost`` is that of the whole conversation (in every part).

    A null or unknown role has to be relabelled; a null text is empty; a null turn comes
    first; exact repeats of a row count once; rows with a null conv_id belong to no
    conversation and are left out; an empty table has no rows.  Equal costs are decided by
    a fixed order, so equal input gives equal output.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                F.col("role").cast("string").alias("role"),
                                F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where("conv_id IS NOT NULL")
    chunk = F.floor(F.coalesce("turn", F.lit(-1)) / F.lit(PART)).alias("chunk")
    parts = (rows.groupBy("conv_id", chunk).agg(F.collect_set(F.struct("turn", "role", "text")).alias("turns"))
                 .select("conv_id", "chunk", F.array_sort("turns").alias("turns")))

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [matrix([_known(t["role"]) for t in turns]) for turns in batch["turns"].to_pylist()]
            yield batch.append_column("matrix", pa.array(values, pa.list_(pa.int64())))

    kinds = "conv_id long, chunk long, turns array<struct<turn:long,role:string,text:string>>, matrix array<long>"
    measured = parts.mapInArrow(matrices, kinds)
    whole = measured.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("chunk", "matrix"))).alias("parts"))

    def between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, parts in zip(batch["conv_id"].to_pylist(), batch["parts"].to_pylist()):
                states, cost = states_between([p["matrix"] for p in parts])
                out += [(conv, p["chunk"], i, states[i], states[i + 1], i == len(parts) - 1, cost) for i, p in enumerate(parts)]
            types = [pa.int64()] * 5 + [pa.bool_(), pa.int64()]
            yield pa.record_batch([pa.array([o[i] for o in out], t) for i, t in enumerate(types)],
                                  ["conv_id", "chunk", "part", "begin", "end", "last", "cost"])

    ends = whole.mapInArrow(between, "conv_id long, chunk long, part long, begin long, end long, last boolean, cost long")

    def rendered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [render([(_known(t["role"]), t["text"]) for t in r["turns"]], r["begin"], r["end"], r["last"])
                   for r in batch.to_pylist()]
            counts = [pa.array([o[i] for o in out], pa.int64()) for i in range(1, 5)]
            yield pa.record_batch([batch["conv_id"], batch["part"], pa.array([o[0] for o in out], pa.string()),
                                   pc.list_value_length(batch["turns"]).cast(pa.int64()), *counts, batch["cost"]],
                                  ["conv_id", "part", "rendered", "n_turns", "n_written", "n_merged", "n_relabelled",
                                   "n_inserted", "cost"])

    return parts.join(ends, ["conv_id", "chunk"]).mapInArrow(
        rendered, "conv_id long, part long, rendered string, n_turns long, n_written long, n_merged long, "
                  "n_relabelled long, n_inserted long, cost long")
