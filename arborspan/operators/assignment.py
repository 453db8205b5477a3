"""From bins to children: a local search over all single moves at once.

A state of the search is a label for each bin. What any move of one bin to any
child would make of the loss follows from the children's sums and the bin's own:
two children change, and the table of all moves' losses is one array expression.
The best move is taken until none helps. Every assignment in such a table is a
candidate for the number of children that it fills.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from ..functions import criteria as C
from .inner import Bins, Loss, Sums


@dataclass
class Choice:
    """The best assignment of bins to ``arity`` children."""

    arity: int
    labels: list[int]
    impurity: float
    gain: float
    requested: int
    root_feasible: bool = False
    children: Sums | None = None


class Objective:
    """Losses (mass times impurity, summed over outputs) of sets of bins.

    Of criteria with sums a set is its totals: a bin is added to them or taken
    off. Of the absolute error it is the set itself, whose loss is found once and
    remembered.
    """

    def __init__(self, bins: Sums, loss: Loss):
        self.bins, self.loss = bins, loss
        self.mass = float(bins.w.sum())
        self._known: dict[bytes, float] = {}
        #: bins with weight, weight and statistics of each bin
        self._own = (bins.w > 0).astype(np.int64), bins.w, bins.s

    def sets(self, inside: np.ndarray) -> np.ndarray:
        """Loss of each set; ``inside[set, bin]`` says whether it holds a bin."""
        if self.loss.absolute:
            return np.array([self._absolute(row) for row in inside])
        return self._loss(*self._totals(inside))

    def grown(self, inside: np.ndarray, more: int | None = None) -> np.ndarray:
        """Loss ``[bin, set]`` of each set with each bin, and with the bin ``more``."""
        if more is not None:
            inside = inside | (np.arange(inside.shape[1]) == more)[None, :]
        if self.loss.absolute:
            eye = np.eye(inside.shape[1], dtype=bool)
            return np.array([[self._absolute(row | one) for row in inside] for one in eye])
        held, own = self._totals(inside), self._own
        new = ~inside.T
        parts = [h[None] + np.where(new.reshape(*new.shape, *[1] * (o.ndim - 1)), o[:, None], 0) for h, o in zip(held, own)]
        return self._loss(*parts)

    def shrunk(self, inside: np.ndarray, labels: np.ndarray, more: int | None = None) -> np.ndarray:
        """Loss, for each bin, of the set that its label names without it, but with
        the bin ``more``. Bins whose label names no set have 0."""
        at = np.flatnonzero(labels < len(inside))
        out = np.zeros(len(labels))
        if self.loss.absolute:
            for j in at:
                row = inside[labels[j]].copy()
                row[j] = False
                if more is not None:
                    row[more] = True
                out[j] = self._absolute(row)
            return out
        parts = [h[labels[at]] - o[at] for h, o in zip(self._totals(inside), self._own)]
        none = parts[0] == 0  # what subtraction leaves of nothing is rounding
        parts = [np.where(none.reshape(-1, *[1] * (p.ndim - 1)), 0, p) for p in parts]
        if more is not None:
            parts = [p + o[more][None] for p, o in zip(parts, self._own)]
        out[at] = self._loss(*parts)
        return out

    def _totals(self, inside: np.ndarray):
        hot = inside.astype(float)
        return (inside.astype(np.int64) @ self._own[0]), hot @ self._own[1], np.tensordot(hot, self._own[2], 1)

    def _loss(self, some, w, s) -> np.ndarray:
        return w * self.loss.of(Sums(some, w, s))

    def _absolute(self, row: np.ndarray) -> float:
        key = np.packbits(row).tobytes()
        if key not in self._known:
            part = self.bins.merged([np.flatnonzero(row)])
            self._known[key] = float(part.w[0] * self.loss.of(part)[0])
        return self._known[key]


class Partition:
    """An assignment of bins to ``k`` children. Bins with the label ``k`` are out."""

    def __init__(self, bins: Sums, loss: Loss, labels, k: int, objective: Objective | None = None):
        self.objective = objective or Objective(bins, loss)
        self.bins, self.loss, self.k = bins, loss, k
        self.labels = np.array(labels, np.int64)

    def inside(self) -> np.ndarray:
        """Whether each child holds each bin."""
        return self.labels[None, :] == np.arange(self.k)[:, None]

    def children(self) -> Sums:
        return self.bins.merged([np.flatnonzero(row) for row in self.inside()])

    def rows(self) -> np.ndarray:
        return self.inside().astype(np.int64) @ self.bins.n.astype(np.int64)

    def score(self) -> tuple[float, np.ndarray]:
        """Mean impurity by mass (summed over outputs) and row counts."""
        mass = float(self.bins.w[self.labels < self.k].sum())
        return (float(self.objective.sets(self.inside()).sum() / mass) if mass > 0 else 0.0), self.rows()

    def moves(self, out: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Loss ``[bin, child]`` and row counts ``[bin, child, child]`` of every
        move of one bin. A move to where a bin is changes nothing; a bin that is
        out comes in. With ``out``, a bin that is out, both have one more axis
        before the last: the child that this bin comes into as well."""
        b, k = len(self.labels), self.k
        inside, o, child = self.inside(), self.objective, np.arange(k)
        is_in = self.labels < k
        here = is_in[:, None] & (self.labels[:, None] == child[None, :])
        now, grown, shrunk = o.sets(inside), o.grown(inside), o.shrunk(inside, self.labels)
        left = np.where(is_in, shrunk - np.append(now, 0)[self.labels], 0.0)
        loss = now.sum() + np.where(here, 0.0, left[:, None] + grown - now[None, :])
        n = self.rows()[None, None, :] + self.bins.n[:, None, None] * (np.eye(k, dtype=np.int64)[None] - here[:, None, :].astype(np.int64))
        n = np.where(here[:, :, None], self.rows()[None, None, :], n)
        if out is None:
            return loss, n.astype(np.int64)
        # what the bin ``out`` adds to each child, as the move leaves it
        adds = np.broadcast_to(o.grown(inside)[out] - now, (b, k, k)).copy()
        add_left = o.shrunk(inside, self.labels, out) - shrunk
        add_grown = o.grown(inside, out) - grown
        moved = ~here
        adds = np.where(moved[:, :, None] & here[:, None, :], add_left[:, None, None], adds)
        adds = np.where(moved[:, :, None] & np.eye(k, dtype=bool)[None], add_grown[:, :, None], adds)
        return loss[:, :, None] + adds, (n[:, :, None, :] + self.bins.n[out] * np.eye(k, dtype=np.int64)[None, None]).astype(np.int64)


class Found:
    """The best assignment for each number of filled children and of requested ones."""

    def __init__(self, bins: Bins, loss: Loss, parent: float, min_leaf: int):
        self.loss, self.parent, self.min_leaf = loss, parent, min_leaf
        self.mass = float(bins.sums.w.sum())
        self.best: dict[tuple[int, int], tuple[float, list[int]]] = {}

    def arity(self, n: np.ndarray) -> np.ndarray:
        """Children with rows, or 0 where one of them has too few; ``n[.., child]``."""
        return np.where(((n > 0) & (n < self.min_leaf)).any(-1), 0, (n > 0).sum(-1))

    def note(self, losses: np.ndarray, n: np.ndarray, requested: int, labels_at) -> None:
        """``losses`` of some assignments; ``labels_at(place)`` gives the labels of one."""
        arity = self.arity(n).ravel()
        impurity = (losses.ravel() / self.mass if self.mass > 0 else np.zeros(losses.size)) / self.loss.outputs
        for a in np.unique(arity[arity >= 2]).tolist():
            own = np.where((arity == a) & np.isfinite(impurity), impurity, np.inf)
            at = int(np.argmin(own))
            value = float(own[at])
            old = self.best.get((a, requested))
            if np.isfinite(value) and self.mass * (self.parent - value) > C.EPS and (old is None or value < old[0] - C.TIE_SHARE * abs(self.parent)):
                self.best[a, requested] = value, [int(x) for x in labels_at(np.unravel_index(at, losses.shape))]


def weighted_kmeans(points: np.ndarray, weights: np.ndarray, k: int, rounds: int = 50) -> np.ndarray:
    """Clusters of weighted points; centres start at evenly spaced points with
    weight. A cluster that runs empty takes the point that is worst off."""
    labels = np.zeros(len(points), np.int64)
    heavy = np.flatnonzero(weights > 0)
    if not len(heavy):
        return labels
    x, w = points[heavy], weights[heavy]
    k = min(k, len(heavy))
    centres, near = x[np.arange(k) * len(heavy) // k], None
    for _ in range(rounds):
        apart = (x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)[None, :]
        new = apart.argmin(1)
        if near is not None and (new == near).all():
            break
        near = new
        hot = (near[:, None] == np.arange(k)[None, :]) * w[:, None]
        mass = hot.sum(0)
        centres = C.safe_divide(hot.T @ x, mass[:, None])
        for j in np.flatnonzero(mass == 0):
            centres[j] = x[apart[np.arange(len(x)), near].argmax()]
    labels[heavy] = near
    return labels


def seed_labels(bins: Bins, loss: Loss, k: int) -> np.ndarray:
    """Where the search for ``k`` children starts: bins alike in their target are together."""
    b, sums = len(bins.sums), bins.sums
    if loss.absolute:
        return np.arange(b) % k
    if loss.criterion == "squared_error":
        return weighted_kmeans(C.safe_divide(sums.s[:, :, 0], sums.w[:, None]), sums.w, k)
    flat = sums.s.reshape(b, -1)
    return weighted_kmeans(C.safe_divide(flat, flat.sum(1, keepdims=True)), sums.w, k)


def _look(part: Partition, found: Found, detached: bool) -> np.ndarray:
    """Losses of every move from here, all of them noted as candidates. With
    ``detached``, the last bin is out; a candidate has it in any child."""

    def moved(place) -> np.ndarray:
        labels = part.labels.copy()
        labels[place[0]] = place[1]
        if detached:
            labels[-1] = place[2]
        return labels

    loss, n = part.moves()
    if not detached:
        found.note(loss, n, part.k, moved)
        return loss
    last = len(part.labels) - 1
    both, rows = part.moves(last)
    found.note(both[:last], rows[:last], part.k, moved)
    return loss[:last]


def descend(part: Partition, found: Found, has_missing: bool, rounds: int) -> None:
    """Take the best move while one lowers the loss, at most ``rounds`` for each
    bin; the missing bin is taken out first and placed best at the end."""
    b, k = len(part.labels), part.k
    if b <= 1:
        return
    slack = C.TIE_SHARE * max(part.objective.mass, 1.0)
    if has_missing:
        part.labels[-1] = k
    for _ in range(rounds * b):
        loss = _look(part, found, has_missing)
        stay = loss[0, part.labels[0]]
        at = np.unravel_index(int(np.argmin(loss)), loss.shape)
        if not loss[at] < stay - slack:
            break
        part.labels[at[0]] = at[1]
    if has_missing:
        _, n = part.score()
        loss, counts = part.moves()
        found.note(loss[-1:], counts[-1:], k, lambda at: np.append(part.labels[:-1], at[1]))
        largest = int(np.argmax(n))
        best = int(np.argmin(loss[-1]))
        part.labels[-1] = best if loss[-1, best] < loss[-1, largest] - slack else largest


def search(bins: Bins, loss: Loss, parent: float, max_arity: int, min_leaf: int, rounds: int, descend_absolute: bool = False) -> dict[tuple[int, int], Choice]:
    """Best choice for each (children with rows, requested children).

    ``parent`` is the node's impurity as a mean over outputs; a choice must lower
    it. Starts are the first cut of the inner tree and clusters of the bins.
    """
    b = len(bins.sums)
    objective = Objective(bins.sums, loss)
    found = Found(bins, loss, parent, min_leaf)

    def at(labels, k) -> Partition:
        return Partition(bins.sums, loss, labels, k, objective)

    def consider(part: Partition, requested: int) -> tuple[float, int]:
        value, n = part.score()
        found.note(np.array([value * objective.mass]), n[None, :], requested, lambda _: part.labels)
        return value, int(found.arity(n))

    roots = [at(labels, 2) for labels in map(bins.root_labels, (0, 1)) if labels]
    scored = [consider(part, 2) for part in roots]
    root_feasible = any(arity >= 2 for _, arity in scored)
    first = min(range(len(roots)), key=lambda i: scored[i][0]) if roots else -1
    if not root_feasible and bins.thresholds:
        for cut in range(1, b - 1):
            for side in (0, 1):
                consider(at([*(int(i >= cut) for i in range(b - 1)), side], 2), 2)

    for k in range(2, min(b, max_arity) + 1):
        part = at(seed_labels(bins, loss, k), k)
        start, _ = consider(part, k)
        if first >= 0 and (loss.absolute or scored[first][0] <= start):
            part.labels = roots[first].labels.copy()
        if not loss.absolute or descend_absolute:
            descend(part, found, bins.has_missing, rounds)

    out: dict[tuple[int, int], Choice] = {}
    for (arity, requested), (_, labels) in sorted(found.best.items()):
        labels = np.array(labels)
        counts = np.bincount(labels, bins.sums.n, int(labels.max()) + 1)
        if bins.has_missing and bins.sums.n[-1] == 0:
            labels[-1] = int(np.argmax(counts))
        used = np.flatnonzero(counts > 0)
        part = at(np.where(np.isin(labels, used), np.searchsorted(used, labels), 0), arity)
        impurity = part.score()[0] / loss.outputs
        gain = objective.mass * (parent - impurity)
        if np.isfinite(gain) and gain > C.EPS:
            out[arity, requested] = Choice(arity, part.labels.tolist(), impurity, gain, requested, root_feasible, part.children())
    return out


def raw_best(choices: dict[tuple[int, int], Choice]) -> Choice | None:
    """Lowest impurity over arities; of equal ones the smallest arity."""
    best = None
    for _, c in sorted(choices.items()):
        if best is None or c.impurity < best.impurity - C.TIE_SHARE * abs(best.impurity):
            best = c
    return best
