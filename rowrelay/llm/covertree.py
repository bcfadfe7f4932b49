"""Cover trees over norm-augmented vectors, searched for the largest inner products inside windows.

A vector x of length |x| <= M becomes (x, sqrt(M^2 - |x|^2)): all have length M then, and for a query q
the squared distance to (q, 0) is |q|^2 + M^2 - 2 <q, x>. So a ball of the tree, with its centre's
distance D and its covering radius r, bounds the inner products of its points:

    |q|^2 + M^2 - (D + r)^2  <=  2 <q, x>  <=  |q|^2 + M^2 - max(0, D - r)^2
"""

from __future__ import annotations

import math

import numpy as np

FAN, LEAF = 16, 256
BASE = 2.0  # a node's children cover its points within its radius / BASE, as far as FAN children can
NONE = -(2**63)
SLACK = 1e-9  # of the bounds, as a share of |q|^2 + M^2: rounding may not hide a point


def augmented(x: np.ndarray, longest2: float) -> np.ndarray:
    """The vectors with the component that gives all of them the squared length ``longest2``."""
    return np.hstack([x, np.sqrt(np.maximum(0.0, longest2 - np.einsum("ij,ij->i", x, x)))[:, None]])


def spread_centres(x: np.ndarray, fan: int, base: float = BASE) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Centres farthest-first until all points are near enough: their rows, each point's centre and distance."""
    centres, near = [0], np.zeros(len(x), np.int64)
    dist = np.linalg.norm(x - x[0], axis=1)
    wanted = dist.max() / base
    while len(centres) < fan and dist.max() > wanted:
        far = int(dist.argmax())
        other = np.linalg.norm(x - x[far], axis=1)
        closer = other < dist
        near[closer], dist = len(centres), np.minimum(dist, other)
        centres.append(far)
    return centres, near, dist


def bounds(q: np.ndarray, centres: np.ndarray, radii: np.ndarray, longest2: float) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest possible inner product of every query with the points of every ball."""
    whole = (np.einsum("ij,ij->i", q, q) + longest2)[:, None]
    to_centre = q @ centres[:, :-1].T
    apart = np.sqrt(np.maximum(0.0, whole - 2 * to_centre))
    slack = SLACK * whole
    low, high = (whole - (apart + radii) ** 2) / 2 - slack, (whole - np.maximum(0.0, apart - radii) ** 2) / 2 + slack
    point = radii == 0
    return np.where(point, to_centre - slack, low), np.where(point, to_centre + slack, high)


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers held as doubles, of vectors whose squared lengths are below 2^63."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * x.shape[1]
    return (q @ x.T).astype(np.int64) if most < 2.0**53 else q.astype(np.int64) @ x.astype(np.int64).T


class CoverTree:
    """Levels of balls over points (rows of whole numbers); leaves hold up to ``LEAF`` points, or equal ones in parts."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, labels: np.ndarray, longest2: float):
        order = np.argsort(ids, kind="stable")
        self.x, self.ids, self.labels, self.longest2 = x[order], ids[order], labels[order], longest2
        full = augmented(self.x, longest2)
        self.centres: list[np.ndarray] = []
        self.radii: list[float] = []
        self.parents: list[list[int]] = []  # of each level: the parent of each of its nodes
        self.levels: list[list[int]] = []
        self.leaves: list[tuple[int, np.ndarray]] = []  # node, rows in ascending order of ids
        todo = [(-1, 0, np.arange(len(x)))] if len(x) else []  # parent, row of the centre, rows
        while todo:
            level, parents, below = [], [], []
            for parent, centre, rows in todo:
                node = len(self.centres)
                level.append(node)
                parents.append(parent)
                apart = np.linalg.norm(full[rows] - full[centre], axis=1)
                self.centres.append(full[centre])
                self.radii.append(float(apart.max()))
                if len(rows) <= LEAF or apart.max() == 0:
                    self.leaves += [(node, rows[i : i + LEAF]) for i in range(0, len(rows), LEAF)]
                    continue
                rows = np.append(centre, rows[rows != centre])
                picked, near, _ = spread_centres(full[rows], FAN)
                below += [(node, int(rows[c]), np.sort(rows[near == i])) for i, c in enumerate(picked)]
            self.levels.append(level)
            self.parents.append(parents)
            todo = below

    def best(self, q: np.ndarray, own: np.ndarray, labels: np.ndarray, same: bool, low: np.ndarray, high: np.ndarray, k: int):
        """(scores, ids), each (queries, k): the best points with ``low <= <q, x> <= high``, ties to the smaller id.

        ``own`` are the ids of the queries, which never are their own answers; answers have the query's label or,
        without ``same``, another one. Missing answers have the score NONE.
        """
        n = len(q)
        scores, found = np.full((n, k), NONE, np.int64), np.full((n, k), 2**63 - 1, np.int64)
        if not n or not self.leaves:
            return scores, found
        centres, radii = np.array(self.centres), np.array(self.radii)
        alive, upper = np.zeros((n, len(centres)), bool), np.full((n, len(centres)), -math.inf)
        for level, parents in zip(self.levels, self.parents, strict=True):
            reached = np.ones((n, len(level)), bool) if parents[0] < 0 else alive[:, parents]
            some = np.flatnonzero(reached.any(axis=0))
            nodes = np.array(level)[some]
            if not len(nodes):
                break
            least, most = bounds(q, centres[nodes], radii[nodes], self.longest2)
            alive[:, nodes] = reached[:, some] & (most >= low[:, None]) & (least <= high[:, None])
            upper[:, nodes] = np.minimum(most, high[:, None])
        at = np.array([node for node, _ in self.leaves])
        left = np.where(alive[:, at], upper[:, at], -math.inf)  # of each query and leaf it has not seen
        # Of leaves that reach the top of a window, first the one whose centre is nearest to it.
        to_top = np.abs(q @ centres[at][:, :-1].T - high[:, None].astype(np.float64))
        turn = np.where(left > -math.inf, left - SLACK * to_top, -math.inf)
        first_id = np.array([self.ids[rows[0]] for _, rows in self.leaves])
        waiting = np.flatnonzero((left > -math.inf).any(axis=1))
        while len(waiting):
            # Every query goes to its best leaf; queries of one leaf are answered together.
            leaf = turn[waiting].argmax(axis=1)
            turn[waiting, leaf] = -math.inf
            order = np.argsort(leaf, kind="stable")
            new_scores, new_ids = np.full((len(waiting), k), NONE, np.int64), np.full((len(waiting), k), 2**63 - 1, np.int64)
            for group in np.split(order, np.flatnonzero(np.diff(leaf[order])) + 1):
                who, rows = waiting[group], self.leaves[leaf[group[0]]][1]
                here = products(q[who], self.x[rows])
                fits = (here >= np.maximum(low[who], scores[who, -1])[:, None]) & (here <= high[who, None])
                fits &= (self.labels[rows] == labels[who, None]) == same
                fits &= self.ids[rows] != own[who, None]
                some = np.flatnonzero(fits.any(axis=1))
                if len(some):
                    top_scores, top_rows = top(np.where(fits[some], here[some], NONE), k)
                    new_scores[group[some]] = top_scores
                    new_ids[group[some]] = np.where(top_scores > NONE, self.ids[rows][top_rows], 2**63 - 1)
            got = np.flatnonzero(new_scores[:, 0] > NONE)
            who = waiting[got]
            both, ids = np.hstack([scores[who], new_scores[got]]), np.hstack([found[who], new_ids[got]])
            best = np.lexsort((ids, -np.maximum(both, NONE + 1)), axis=-1)[:, :k]
            scores[who], found[who] = np.take_along_axis(both, best, 1), np.take_along_axis(ids, best, 1)
            # What cannot beat a query's k-th answer is left out; ties go on while an id may be smaller.
            last, last_id = scores[waiting, -1, None], found[waiting, -1, None]
            rest, next_turn = left[waiting], turn[waiting]
            next_turn[(last > NONE) & ((rest < last) | ((rest < last + 1) & (first_id > last_id)))] = -math.inf
            turn[waiting] = next_turn
            waiting = waiting[(next_turn > -math.inf).any(axis=1)]
        return scores, found


def top(values: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest values of every row, the leftmost of equal ones first, and their columns; ``values`` is used up."""
    line = np.arange(len(values))
    scores, columns = np.full((len(values), k), NONE, np.int64), np.zeros((len(values), k), np.int64)
    for i in range(min(k, values.shape[1])):
        columns[:, i] = values.argmax(axis=1)
        scores[:, i] = values[line, columns[:, i]]
        values[line, columns[:, i]] = NONE
    return scores, columns
