"""DartMinHash: sparse weighted signatures from hashed darts (Christiani, 2020).

Picture every element of the universe as a strip, its weight along one axis and a
rank along the other.  Darts fall on the strips at random places that depend on
the element alone, one dart per unit of area on average, so two sets see the same
darts wherever their weights cover them.  A set keeps the darts below its weight;
each dart belongs to one of ``k`` coordinates, and per coordinate the dart of
lowest rank stays.  Two sets keep the same dart in a coordinate with probability
equal to their weighted Jaccard similarity.

Only darts of low rank can win, so a set of total weight W looks at ranks up to
``t / W`` with ``t = k ln k + 2 k`` expected darts: the work is the elements plus
the darts, not elements times coordinates.  Weight and rank axes are cut into
cells at powers of two, and darts are thrown cell by cell, which makes the darts of
an element the same whatever the weight and rank limits of the set.  A coordinate
left empty is filled by doubling the rank limit.
"""

from __future__ import annotations

import math

import numpy as np

from gridevents.llm.words import mix

_U = np.uint64
#: Cumulative probabilities of a Poisson variable with mean 1; beyond the last entry less than 1e-15.
_POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(18)])
_A, _B, _C, _D = (_U(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB))


def _unit(h: np.ndarray) -> np.ndarray:
    """Uniform in [0, 1) from 53 bits of a hash."""
    return (h >> _U(11)).astype(np.float64) * 2.0 ** -53


def _throw(element: np.ndarray, level: np.ndarray, cell: np.ndarray, seed: int):
    """Darts of cells of unit area: (row of the input, hash of the dart)."""
    key = mix(mix(element ^ _U(seed)) + level.astype(np.uint64) * _B + cell.astype(np.uint64) * _C)
    number = np.searchsorted(_POISSON, _unit(key), side="right")
    row = np.repeat(np.arange(len(element)), number)
    place = np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number)
    return row, mix(key[row] + (place.astype(np.uint64) + _U(1)) * _D)


def darts(element: np.ndarray, weight: np.ndarray, low: np.ndarray, high: np.ndarray, seed: int = 1):
    """Darts below ``weight`` with a rank in [low, high), per element: (row, rank, hash).

    The weight axis is cut into [0, 1), [1, 2), [2, 4), ...; level v has width s_v.
    Its rank axis is cut into cells 1 / s_v long, so every cell has area one.
    """
    rows, ranks, hashes = [], [], []
    level, active = 0, np.arange(len(element))
    while len(active):
        base = 0.0 if level == 0 else 2.0 ** (level - 1)
        width = 1.0 if level == 0 else base
        first = np.floor(low[active] * width).astype(np.int64)
        last = np.ceil(high[active] * width).astype(np.int64)
        number = np.maximum(last - first, 0)
        row = np.repeat(active, number)
        cell = np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number) + np.repeat(first, number)
        hit, h = _throw(element[row], np.full(len(row), level), cell, seed)
        h2 = mix(h ^ _A)
        rank = (cell[hit] + _unit(h)) / width
        row = row[hit]
        good = (rank >= low[row]) & (rank < high[row])
        if level or (weight[active] < 1).any():
            good &= base + _unit(h2) * width < weight[row]
        rows.append(row[good])
        ranks.append(rank[good])
        hashes.append(mix(h2[good] + _B))
        active = active[weight[active] > base + width]
        level += 1
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.uint64)
    return np.concatenate(rows), np.concatenate(ranks), np.concatenate(hashes)


def signatures(element: np.ndarray, weight: np.ndarray, first: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """A row of ``k`` dart hashes per set; ``first`` bounds the sets in the flat arrays.

    Elements of a set are distinct and weights positive; an empty set has zeros.
    """
    sets = len(first) - 1
    counts = np.diff(first)
    owner = np.repeat(np.arange(sets), counts)
    total = np.bincount(owner, weight, sets)
    out = np.zeros((sets, k), np.uint64)
    limit = np.where(total > 0, (k * math.log(k) + 2 * k) / np.where(total > 0, total, 1), 0)
    start = np.zeros(sets)
    open_sets = total > 0
    while open_sets.any():
        at = np.flatnonzero(open_sets[owner])
        row, rank, h = darts(element[at], weight[at], start[owner[at]], limit[owner[at]], seed)
        order = np.argsort(rank)[::-1]  # written last to first, so the lowest rank stays
        slot, h = (owner[at[row]] * k + (h % _U(k)).astype(np.int64))[order], h[order]
        flat = out.reshape(-1)
        empty = flat[slot] == 0  # darts of an earlier pass have lower ranks
        flat[slot[empty]] = np.maximum(h[empty], _U(1))
        open_sets &= (out == 0).any(axis=1)
        start, limit = np.where(open_sets, limit, 0), np.where(open_sets, 2 * limit, 0)
    return out


def bands(signature: np.ndarray, rows: int) -> np.ndarray:
    """Hash of every ``rows`` consecutive coordinates, with the band's number mixed in."""
    number = signature.shape[1] // rows
    parts = signature[:, :number * rows].reshape(len(signature), number, rows)
    value = np.broadcast_to(mix(np.arange(1, number + 1, dtype=np.uint64) * _C), parts.shape[:2]).copy()
    for i in range(rows):
        value = mix(value * _A + parts[:, :, i])
    return value
