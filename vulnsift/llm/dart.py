"""DartMinHash signatures of weighted sets, vectorised over a batch of sets.

Think of every element as a column of the plane: across lies its weight axis, upwards the rank axis.
Darts are thrown over all columns by hashing: each unit cell (element, unit of weight, unit of rank)
holds a Poisson(1) number of darts, and every dart has a place across, a rank and one of ``k``
coordinates, all functions of the element and the cell alone. A set sees the darts inside the regions
of its weights. The earliest dart of a coordinate is its signature there; for two sets these agree
with the probability of their weighted Jaccard similarity.

A set of total weight ``w`` looks up to rank ``t/w`` with ``t = k (ln k + 2)``, so it throws about ``t + w`` darts
whatever its size; sets that leave a coordinate empty look twice as far, again and again.
"""

from __future__ import annotations

import math

import numpy as np

_U = np.uint64
_POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(20)])
_CUTS = np.minimum(_POISSON * 2.0 ** 64, np.nextafter(2.0 ** 64, 0)).astype(np.uint64)
EMPTY = _U(0xFFFFFFFFFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _spread(lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, place) for ``lens[i]`` items of each owner i."""
    owner = np.repeat(np.arange(len(lens)), lens)
    ends = np.cumsum(lens)
    return owner, np.arange(len(owner)) - (ends - lens)[owner]


def _throw(out: np.ndarray, sets: np.ndarray, owner: np.ndarray, element: np.ndarray, weight: np.ndarray,
           first: np.ndarray, last: np.ndarray, reach: np.ndarray, k: int) -> None:
    """Throw the darts of the rank cells ``first..last-1`` of each set and keep the earliest ones."""
    col, unit = _spread(np.ceil(weight).astype(np.int64))               # one column per unit of weight
    of = owner[col]
    base = mix(element[col] + mix(unit.astype(np.uint64) + _U(0x5851F42D4C957F2D)))
    cell_of, cell = _spread((last - first)[of])
    cell = cell + first[of][cell_of]
    seed = mix(base[cell_of] ^ (cell.astype(np.uint64) * _U(0x9E3779B97F4A7C15)))
    darts = np.searchsorted(_CUTS, seed, side="right")
    dart_of, i = _spread(darts)
    h = mix(seed[dart_of] + (i.astype(np.uint64) + _U(1)) * _U(0xD1342543DE82EF95))
    c = cell_of[dart_of]
    o = of[c]
    rank = cell[dart_of] + (h >> _U(32)) * 2.0 ** -32
    seen = rank < reach[o]
    if (weight != np.floor(weight)).any():                              # a part of a unit: the dart's place decides
        across = unit[c] + (mix(h) >> _U(40)) * 2.0 ** -24
        seen &= across < weight[col[c]]
    h, o, cells = h[seen], o[seen], cell[dart_of][seen]
    coordinate = ((h & _U(0xFFFFFF)) * _U(k) >> _U(24)).astype(np.int64)
    # 20 bits of cell, 32 of rank inside it, 12 of the dart itself: order and identity in one number
    value = (cells.astype(np.uint64) << _U(44)) | ((h >> _U(32)) << _U(12)) | (mix(h) & _U(0xFFF))
    np.minimum.at(out.reshape(-1), sets[o] * k + coordinate, value)


def signatures(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, k: int) -> np.ndarray:
    """(n, k) signatures of ``n`` sets given as sorted (owner, element hash, weight > 0) triples; a set
    without elements has ``EMPTY`` everywhere."""
    out = np.full((n, k), EMPTY, dtype=np.uint64)
    total = np.bincount(owner, weights=weight, minlength=n)
    reach = np.zeros(n)
    alive = np.flatnonzero(total > 0)
    first = np.zeros(n, dtype=np.int64)
    t = k * (math.log(k) + 2)
    while len(alive):
        reach[alive] = t / total[alive]
        number = np.full(n, -1, dtype=np.int64)
        number[alive] = np.arange(len(alive))
        mine = number[owner] >= 0
        last = np.ceil(reach[alive]).astype(np.int64)
        _throw(out, alive, number[owner[mine]], element[mine], weight[mine], first[alive], last, reach[alive], k)
        # a further round starts in the cell that the reach cut through
        first[alive] = np.floor(reach[alive]).astype(np.int64)
        alive = alive[(out[alive] == EMPTY).any(axis=1)]
        t *= 2
    return out
