"""BagMinHash: signatures of weighted sets whose agreement is the weighted Jaccard similarity.

Weights are discretised to whole numbers and laid out as dyadic cells [0,1), [1,2), [2,4), [4,8),
... Each element has, per cell, a Poisson process of rate = the cell's width; a point of it carries
a time, one of ``size`` labels, and, going down the cell's binary tree, the unit interval of the
weight axis that it falls in. A set of weight w uses the points below w. Component k of the
signature is the earliest point with label k, so two sets agree in k with probability
sum(min)/sum(max) of their weights. Processes depend on element and cell alone; they run only up
to a time by which a set's signature is full (all sets of a batch at once; sets that are not full
go on), so a set costs its distinct elements plus about size*ln(size) points, not elements*size.
"""

from __future__ import annotations

import numpy as np

from hirelake.llm.wordhash import U, mix

SIZE = 256
_STEP, _LABEL, _CELL, _UNIT = (U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))


def bags(elements: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (element, owner) with counts, sorted by owner."""
    order = np.lexsort((elements, owner))
    elements, owner = elements[order], owner[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (elements[1:] != elements[:-1])
    first = np.flatnonzero(new)
    return elements[first], owner[first], np.diff(np.append(first, len(owner)))


def signatures(elements: np.ndarray, owner: np.ndarray, weight: np.ndarray, sets: int, size: int = SIZE) -> np.ndarray:
    """A row of ``size`` 64-bit components per set; a set without elements has zeros."""
    best = np.full(sets * size, np.inf)
    ident = np.zeros(sets * size, U)
    cells = []
    cell, low = 0, 0
    while True:  # cell 0 is [0,1), cell c is [2**(c-1), 2**c)
        rows = np.flatnonzero(weight > low)
        if not len(rows):
            break
        width = max(low, 1)
        cells.append((rows, np.full(len(rows), cell), np.full(len(rows), width), np.full(len(rows), low)))
        cell, low = cell + 1, low + width
    if not cells:
        return ident.reshape(sets, size)
    rows, cell_of, width, low_of = (np.concatenate(c) for c in zip(*cells, strict=True))
    key = mix(elements[rows] + _CELL * cell_of.astype(U))
    mine, top = owner[rows], weight[rows]
    time, state = np.zeros(len(rows)), key.copy()
    total = np.bincount(owner, weight, sets)
    until = size * (np.log(size) + 3.0) / np.maximum(total, 1)

    def draw(at: np.ndarray) -> None:
        """Move the processes ``at`` to their next points."""
        state[at] = mix(state[at] + _STEP)
        uniform = ((state[at] >> U(11)).astype(np.float64) + 0.5) * 2.0**-53
        time[at] -= np.log(uniform) / width[at]

    live = np.arange(len(rows))
    draw(live)
    while len(live):
        ready = live[time[live] <= until[mine[live]]]
        while len(ready):
            points = state[ready]
            flat = mine[ready] * size + (mix(points ^ _LABEL) % U(size)).astype(np.int64)
            cut = width[ready] > 1
            use = np.arange(len(ready))
            if cut.any():  # the unit interval, read bit by bit from the cell's root
                unit = low_of[ready] + (mix(points ^ _UNIT) & (width[ready] - 1).astype(U)).astype(np.int64)
                use = np.flatnonzero(unit < top[ready])
            flat, when = flat[use], time[ready[use]]
            np.minimum.at(best, flat, when)
            won = when == best[flat]
            ident[flat[won]] = points[use[won]]
            draw(ready)
            ready = ready[time[ready] <= until[mine[ready]]]
        empty = np.isinf(best).reshape(sets, size).any(1) & (total > 0)
        until = np.where(empty, until * 1.5, until)
        live = live[empty[mine[live]]]
    return ident.reshape(sets, size)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact similarity of two bags, each (sorted distinct elements, counts)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = int(np.minimum(a[1][i], b[1][j]).sum())
    whole = int(a[1].sum() + b[1].sum()) - shared
    return shared / whole if whole else 0.0
