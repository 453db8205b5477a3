"""Inner trees: from one feature's compressed values to bins.

The rows of a node are summed to cells, one for each distinct value of a
feature, and one for missing values. An inner tree cuts the ordered cells (or
peels categories one by one) into bins; the last bin is the missing one.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from ..functions import criteria as C

#: Two neighbouring values nearer than this, in single precision, aren't parted.
VALUE_TOLERANCE = np.float32(1e-7)


@dataclass
class Sums:
    """Row counts, weights and statistics of some cells or bins.

    ``s[cell, output, stat]``. For the absolute error, ``y`` and ``v`` hold each
    cell's targets and weights instead.
    """

    n: np.ndarray
    w: np.ndarray
    s: np.ndarray
    y: list[np.ndarray] | None = None
    v: list[np.ndarray] | None = None

    def __len__(self):
        return len(self.n)

    def take(self, at) -> "Sums":
        at = np.asarray(at, np.int64)
        return Sums(self.n[at], self.w[at], self.s[at], None if self.y is None else [self.y[i] for i in at], None if self.v is None else [self.v[i] for i in at])

    def merged(self, groups: list[np.ndarray]) -> "Sums":
        """One entry for each group of entries; an empty group has nothing."""
        n = np.array([self.n[g].sum() for g in groups], np.int64)
        w = np.array([self.w[g].sum() for g in groups], float)
        s = np.array([self.s[g].sum(0) for g in groups]) if groups else self.s[:0]
        y = v = None
        if self.y is not None:
            outputs = self.y[0].shape[1] if self.y else 1
            y = [np.concatenate([self.y[i] for i in g]) if len(g) else np.zeros((0, outputs)) for g in groups]
            v = [np.concatenate([self.v[i] for i in g]) if len(g) else np.zeros(0) for g in groups]
        return Sums(n, w, s, y, v)


@dataclass
class Loss:
    """A criterion over sums of rows; impurities are summed over outputs."""

    criterion: str
    outputs: int
    l2: float = 1.0

    @property
    def absolute(self) -> bool:
        return self.criterion == "absolute_error"

    def of(self, sums: Sums) -> np.ndarray:
        """Impurity of each entry."""
        if self.absolute:
            return np.array([C.absolute_error(y, v) for y, v in zip(sums.y, sums.v)])
        if self.criterion == "gain_hessian":
            return C.gain_hessian(sums.s, sums.w, self.l2)
        return C.IMPURITY[self.criterion](sums.s, sums.w)

    def whole(self, sums: Sums) -> float:
        """Impurity of all entries together."""
        return float(self.of(sums.merged([np.arange(len(sums))]))[0])


@dataclass
class Bins:
    """An inner tree's result.

    ``kind``: numeric, categorical or pair. ``thresholds``: of numeric bins, the
    upper bounds of all finite bins but the last. ``categories``: of categorical
    bins, the category positions of each. ``root``: for numeric and categorical
    bins, the side of the first split that each finite bin is on.
    """

    kind: str
    sums: Sums
    thresholds: list[float] = field(default_factory=list)
    categories: list[list[int]] = field(default_factory=list)
    root: list[int] = field(default_factory=list)
    tree: list[dict] = field(default_factory=list)
    has_missing: bool = True

    def root_labels(self, missing_side: int) -> list[int]:
        return [*self.root, missing_side] if len(set(self.root)) > 1 or (self.root and self.kind == "stump") else []


def midpoint(a: float, b: float) -> float:
    t = a / 2 + b / 2
    return a if t == b or not np.isfinite(t) else t


def running_absolute(y: np.ndarray, v: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Absolute deviations of the prefixes of these lengths, summed over outputs."""
    return sum((C.running_absolute(y[:, o], v, ends) for o in range(y.shape[1])), np.zeros(len(ends)))


def best_cut(x: np.ndarray, sums: Sums, loss: Loss, lo: int, hi: int, min_leaf: int) -> tuple[float, int] | None:
    """(children's impurity weighted by mass, first cell of the right side) of the
    best cut of cells ``lo..hi``; of equal cuts the one at the smallest value."""
    if hi - lo < 2:
        return None
    n = np.cumsum(sums.n[lo:hi])
    total = n[-1]
    gap = x[lo + 1 : hi].astype(np.float32) > x[lo : hi - 1].astype(np.float32) + VALUE_TOLERANCE
    ok = gap & (n[:-1] >= min_leaf) & (total - n[:-1] >= min_leaf)
    if not ok.any():
        return None
    if loss.absolute:
        y, v = np.concatenate(sums.y[lo:hi]), np.concatenate(sums.v[lo:hi])
        ends = np.cumsum([len(a) for a in sums.y[lo:hi]])[:-1]
        score = running_absolute(y, v, ends) + running_absolute(y[::-1], v[::-1], len(v) - ends)
    else:
        w, s = np.cumsum(sums.w[lo:hi]), np.cumsum(sums.s[lo:hi], 0)
        left = Sums(n[:-1], w[:-1], s[:-1])
        rw, rs = np.cumsum(sums.w[lo:hi][::-1])[::-1][1:], np.cumsum(sums.s[lo:hi][::-1], 0)[::-1][1:]
        score = left.w * loss.of(left) + rw * loss.of(Sums(total - n[:-1], rw, rs))
    score = np.where(ok & np.isfinite(score), score, np.inf)
    k = C.first_least(score, float(sums.w[lo:hi].sum()) * loss.whole(sums.take(np.arange(lo, hi))))
    return (float(score[k]), lo + k + 1) if np.isfinite(score[k]) else None


def growing(root, max_leaves: int | None, max_depth: int | None, min_gain: float):
    """Best-first growth (last-in first-out without a leaf cap), as a generator.

    A node is ``(gain, impurity, depth, payload)``. Asked for are the two children
    of a payload at a depth, as ``(node or None, leaf)``; the leaves are returned.
    """
    first, whole = root
    if first is None or first[1] <= C.EPS:
        return [whole]
    leaves: list = []
    waiting, count = [first], 1
    while waiting:
        # with a cap (few are waiting then) the largest gain, of equal ones the first
        at = -1 if max_leaves is None else max(range(len(waiting)), key=lambda i: (waiting[i][0], -i))
        gain, impurity, depth, payload = waiting.pop(at)
        closed = impurity <= C.EPS or gain + C.EPS < min_gain
        if closed or (max_leaves is not None and count >= max_leaves) or (max_depth is not None and depth >= max_depth):
            leaves.append(payload)
            continue
        count += 1
        for child, leaf in (yield payload, depth + 1):
            if child is None:
                leaves.append(leaf)
            else:
                waiting.append(child)
    return leaves


def grow(root, expand, max_leaves: int | None, max_depth: int | None, min_gain: float):
    """The leaves of :func:`growing`, with ``expand(payload, depth)`` for its questions."""
    steps = growing(root, max_leaves, max_depth, min_gain)
    answer = None
    while True:
        try:
            payload, depth = steps.send(answer)
        except StopIteration as e:
            return e.value
        answer = expand(payload, depth)


def numeric_bins(x: np.ndarray, sums: Sums, missing: Sums, loss: Loss, min_leaf: int, min_gain: float, max_depth: int | None, max_leaves: int | None) -> Bins | None:
    """Bins of a numeric feature; None if all its values are missing.

    ``x``: distinct values, ascending, of ``sums``; ``missing``: one entry.
    """
    if not len(x):
        return None
    mass = float(sums.w.sum())
    first: list[int] = []

    def node(lo, hi, depth):
        found = best_cut(x, sums, loss, lo, hi, min_leaf)
        if found is None:
            return None
        w = float(sums.w[lo:hi].sum())
        impurity = loss.whole(sums.take(np.arange(lo, hi)))
        gain = (w * impurity - found[0]) / mass if mass > 0 else 0.0
        return gain, impurity, depth, (lo, hi, found[1])

    def expand(payload, depth):
        lo, hi, cut = payload
        if not first:
            first.append(cut)
        return [(node(lo, cut, depth), (lo, cut, None)), (node(cut, hi, depth), (cut, hi, None))]

    leaves = sorted(grow((node(0, len(x), 0), (0, len(x), None)), expand, max_leaves, max_depth, min_gain))
    parts = sums.merged([np.arange(lo, hi) for lo, hi, _ in leaves])
    thresholds = [midpoint(float(x[hi - 1]), float(x[hi])) for _, hi, _ in leaves[:-1]]
    root = [int(lo >= first[0]) for lo, _, _ in leaves] if first else []
    return Bins("numeric", _append(parts, missing), thresholds, root=root)


def _append(parts: Sums, missing: Sums) -> Sums:
    return Sums(
        np.append(parts.n, missing.n), np.append(parts.w, missing.w), np.concatenate([parts.s, missing.s]),
        None if parts.y is None else [*parts.y, *missing.y], None if parts.v is None else [*parts.v, *missing.v],
    )


def category_bins(codes: np.ndarray, sums: Sums, missing: Sums, loss: Loss, categories: int, min_leaf: int, min_gain: float, max_depth: int | None, max_leaves: int | None) -> Bins | None:
    """Bins of a categorical feature: each split peels one category off.

    While splits are scored, rows without a category stand on the other side;
    then they are the missing bin.
    """
    if not len(codes) and not missing.n.sum():
        return None
    index = {int(c): i for i, c in enumerate(codes)}

    def rest_of(left):
        return sums.take([index[c] for c in left if c in index])

    def node(left: tuple[int, ...], depth):
        cells = rest_of(left)
        every = _append(cells, missing)
        n, best = int(every.n.sum()), None
        impurity, w = loss.whole(every), float(every.w.sum())
        for c in left:
            if c not in index:
                continue
            others = [index[d] for d in left if d != c and d in index]
            inactive = _append(sums.take(others), missing)
            active_n = int(sums.n[index[c]])
            if active_n < min_leaf or n - active_n < min_leaf:
                continue
            a = sums.take([index[c]])
            score = float(a.w.sum() * loss.whole(a) + inactive.w.sum() * loss.whole(inactive))
            if np.isfinite(score) and (best is None or score < best[0] - C.TIE_SHARE * abs(w * impurity)):
                best = score, c
        if best is None:
            return None
        return (impurity - best[0] / w if w > 0 else 0.0), impurity, depth, (left, best[1])

    def expand(payload, depth):
        left, c = payload
        others = tuple(d for d in left if d != c)
        return [(None, ((c,), "active")), (node(others, depth) if others else None, (others, "rest"))]

    every = tuple(range(categories))
    leaves = grow((node(every, 0), (every, "rest")), expand, max_leaves, max_depth, min_gain)
    active = [p for p in leaves if p[1] == "active"]
    rest = [p for p in leaves if p[1] != "active"]
    ordered = active + rest  # the first peeled category is the first bin
    groups = [np.array([index[c] for c in cats if c in index], np.int64) for cats, _ in ordered]
    parts = sums.merged(groups)
    root = [1] + [0] * (len(ordered) - 1) if len(ordered) > 1 else []
    return Bins("categorical", _append(parts, missing), categories=[list(c) for c, _ in ordered], root=root)


def numeric_stump(x: np.ndarray, sums: Sums, missing: Sums, loss: Loss, min_leaf: int) -> Bins | None:
    """The best two-way split when missing rows may join either side, or be alone.

    Feasibility is judged after the missing rows are placed. Both sides' sums
    are run up separately, so that a heavy cell doesn't swallow light ones.
    """
    m = len(x)
    if not m:
        return None
    every = _append(sums, missing)
    slack = C.TIE_SHARE * abs(float(every.w.sum()) * loss.whole(every))
    groups = [0]  # cells that begin a new value
    for i in range(1, m):
        if np.float32(x[i]) > np.float32(x[i - 1]) + VALUE_TOLERANCE:
            groups.append(i)
    bounds = [*groups, m]
    best, cut = np.inf, 0
    for k, at in enumerate(bounds):
        sides = [np.arange(at), np.arange(at, m)]
        for missing_side in (0, 1):
            parts = [sums.take(s) for s in sides]
            parts[missing_side] = _append(parts[missing_side], missing)
            counts = [int(p.n.sum()) for p in parts]
            if min(counts) < max(min_leaf, 1):
                continue
            value = sum(float(p.w.sum()) * loss.whole(p) for p in parts)
            if np.isfinite(value) and value < best - (slack if np.isfinite(best) else 0):
                best, cut = value, at
    return _stump(x, sums, missing, cut)


def _stump(x, sums, missing, cut) -> Bins:
    m = len(x)
    if 0 < cut < m:
        parts = sums.merged([np.arange(cut), np.arange(cut, m)])
        return Bins("numeric", _append(parts, missing), [midpoint(float(x[cut - 1]), float(x[cut]))], root=[0, 1])
    out = Bins("stump", _append(sums.merged([np.arange(m)]), missing), [], root=[0])
    return out


def fast_numeric_stump(x: np.ndarray, sums: Sums, missing: Sums, loss: Loss, min_leaf: int) -> Bins | None:
    """As :func:`numeric_stump`, with all cuts scored at once from running sums."""
    m = len(x)
    if not m:
        return None
    x32 = x.astype(np.float32)
    bounds = np.concatenate([[0], 1 + np.flatnonzero(x32[1:] > x32[:-1] + VALUE_TOLERANCE), [m]])

    def run(a):
        zero = np.zeros((1, *a.shape[1:]))
        left = np.concatenate([zero, np.cumsum(a, 0)])
        right = np.concatenate([np.cumsum(a[::-1], 0)[::-1], zero])
        return left[bounds], right[bounds]

    (nl, nr), (wl, wr), (sl, sr) = run(sums.n.astype(float)), run(sums.w), run(sums.s)
    if loss.absolute:
        y, v = np.concatenate(sums.y), np.concatenate(sums.v)
        ends = np.append(0, np.cumsum([len(c) for c in sums.y]))[bounds]

        def deviations(side: int) -> np.ndarray:
            """Of both sides of each cut, with the missing rows first on one of them."""
            more = [len(missing.v[0]) if side == k else 0 for k in (0, 1)]
            (yl, vl), (yr, vr) = [(np.concatenate([missing.y[0][:g], a]), np.concatenate([missing.v[0][:g], b])) for g, a, b in zip(more, (y, y[::-1]), (v, v[::-1]))]
            return running_absolute(yl, vl, ends + more[0]) + running_absolute(yr, vr, len(v) - ends + more[1])

    best, cut = np.inf, 0
    scores = []
    for side in (0, 1) if missing.n[0] else (0,):
        a = (nl + missing.n[0], wl + missing.w[0], sl + missing.s[0]) if side == 0 else (nl, wl, sl)
        b = (nr, wr, sr) if side == 0 else (nr + missing.n[0], wr + missing.w[0], sr + missing.s[0])
        value = deviations(side) if loss.absolute else a[1] * loss.of(Sums(*a)) + b[1] * loss.of(Sums(*b))
        scores.append(np.where((np.minimum(a[0], b[0]) >= max(min_leaf, 1)) & np.isfinite(value), value, np.inf))
    both = np.min(scores, axis=0)
    every = _append(sums, missing)
    k = C.first_least(both, float(every.w.sum()) * loss.whole(every))
    if np.isfinite(both[k]):
        best, cut = both[k], int(bounds[k])
    return _stump(x, sums, missing, cut)


def category_stump(codes: np.ndarray, sums: Sums, missing: Sums, loss: Loss, categories: int, min_leaf: int) -> Bins | None:
    """One category against the rest, with missing rows on either side."""
    best = None
    every = _append(sums, missing)
    slack = C.TIE_SHARE * abs(float(every.w.sum()) * loss.whole(every))
    for i, c in enumerate(codes):
        others = np.array([k for k in range(len(codes)) if k != i], np.int64)
        for missing_active in (False, True):
            a, b = sums.take([i]), sums.take(others)
            a, b = (_append(a, missing), b) if missing_active else (a, _append(b, missing))
            if min(a.n.sum(), b.n.sum()) < max(min_leaf, 1):
                continue
            value = float(a.w.sum() * loss.whole(a) + b.w.sum() * loss.whole(b))
            if np.isfinite(value) and (best is None or value < best[0] - slack):
                best = value, int(c), i, others
    if best is None:
        parts = sums.merged([np.arange(len(codes))])
        return Bins("categorical", _append(parts, missing), categories=[list(range(categories))])
    _, c, i, others = best
    parts = sums.merged([np.array([i]), others])
    return Bins("categorical", _append(parts, missing), categories=[[c], [k for k in range(categories) if k != c]], root=[1, 0])
