"""Pair trees: inner trees over two features at once."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from ..functions import criteria as C
from . import inner
from .inner import Bins, Loss, Sums, midpoint


@dataclass
class Asked:
    """What a growing pair tree asks for: ``made``, new entries as (entry, parent,
    side), and ``open``, the entries whose best split is wanted."""

    nodes: list[dict]
    made: list[tuple[int, int, int]]
    open: list[int]


def growing(kinds: tuple[str, str], min_gain: float, max_depth: int | None, max_leaves: int | None):
    """Growth of a pair tree as a generator of :class:`Asked`.

    An answer gives for each open entry its best split, ``(gain, axis, threshold
    or category, rows on the left, on the right, missing)``, or None. The tree is
    returned, with leaves numbered as bins in the order of its entries.
    """
    nodes: list[dict] = [{"depth": 0}]
    waiting: list[tuple[float, int, tuple]] = []
    made, finite = [(0, -1, -1)], 1
    while True:
        room = max_leaves is None or finite < max_leaves
        fresh = [k for k, _, _ in made if room and (max_depth is None or nodes[k]["depth"] < max_depth)]
        found = yield Asked(nodes, made, fresh)
        waiting += [(found[k][0], k, found[k]) for k in fresh if found.get(k) is not None and found[k][0] + C.EPS >= min_gain]
        if not waiting or not room:
            break
        entry = max(waiting, key=lambda e: (e[0], -e[1])) if max_leaves is not None else waiting[-1]
        waiting.remove(entry)
        _, k, (_, axis, threshold, n_left, n_right, n_gone) = entry
        base, depth = len(nodes), nodes[k]["depth"] + 1
        made = [(base + side, k, side) for side in range(3 if n_gone else 2)]
        nodes += [{"depth": depth} for _ in made]
        nodes[k] |= {"axis": axis, "kind": kinds[axis], "threshold": threshold, "left": base, "right": base + 1, "missing": base + 2 if n_gone else base + int(n_left < n_right)}
        finite += 1
    return as_tree(nodes)


def as_tree(nodes: list[dict], leaf=None) -> list[dict]:
    """Entries of a pair tree; ``leaf(entry)`` names leaves, by default in their order."""
    order = {k: i for i, k in enumerate(k for k, n in enumerate(nodes) if "axis" not in n)}
    fields = ("axis", "kind", "threshold", "left", "right", "missing")
    return [{"axis": -1, "bin": leaf(k) if leaf else order[k]} if k in order else {f: n[f] for f in fields} | {"bin": -1} for k, n in enumerate(nodes)]


def _numeric_cut(v: np.ndarray, cells: np.ndarray, sums: Sums, loss: Loss, min_leaf: int):
    """(loss, threshold, left cells, right cells) of the best cut of ``cells`` by their values, or None."""
    order = np.argsort(v, kind="stable")
    v, cells = v[order], cells[order]
    groups = np.flatnonzero(np.append(True, v[1:] != v[:-1]))
    ends = np.append(groups[1:], len(v))
    own = sums.take(cells)
    found = inner.best_cut(v[groups], own.merged([np.arange(a, b) for a, b in zip(groups, ends)]) if loss.absolute else _summed(own, groups), loss, 0, len(groups), min_leaf)
    if found is None:
        return None
    value, cut = found
    at = groups[cut]
    return value, midpoint(float(v[at - 1]), float(v[at])), cells[:at], cells[at:]


def _summed(own: Sums, heads: np.ndarray) -> Sums:
    return Sums(np.add.reduceat(own.n, heads), np.add.reduceat(own.w, heads), np.add.reduceat(own.s, heads, 0))


def _category_cut(v: np.ndarray, cells: np.ndarray, sums: Sums, loss: Loss, min_leaf: int):
    """(loss, category, the others' cells, its cells) of the best category against the rest, or None."""
    options = []
    for c in np.unique(v):
        left, right = cells[v != c], cells[v == c]
        both = sums.merged([left, right])
        if len(left) and min(both.n) >= min_leaf:
            options.append((float((both.w * loss.of(both)).sum()), int(c), left, right))
    if not options:
        return None
    own = sums.take(cells)
    return options[C.first_least(np.array([o[0] for o in options]), float(own.w.sum()) * loss.whole(own))]


def best_pair_split(x: np.ndarray, kinds: tuple[str, str], cells: np.ndarray, sums: Sums, loss: Loss, min_leaf: int, mass: float):
    """(gain, axis, threshold or category, left, right, missing cells) or None.

    ``x[cell, axis]`` with NaN for missing. A split's missing rows are a third
    child; only the two finite children must have ``min_leaf`` rows. The second
    axis must be better than the first.
    """
    own = sums.take(cells)
    whole, best = float(own.w.sum()) * loss.whole(own), None
    for axis, kind in enumerate(kinds):
        v = x[cells, axis]
        gone = np.isnan(v)
        if (~gone).sum() < 2:
            continue
        found = (_numeric_cut if kind == "continuous" else _category_cut)(v[~gone], cells[~gone], sums, loss, min_leaf)
        if found is None:
            continue
        lost = sums.take(cells[gone])
        value = found[0] + (float(lost.w.sum()) * loss.whole(lost) if gone.any() else 0.0)
        gain = (whole - value) / mass if mass > 0 else 0.0
        if np.isfinite(gain) and gain > C.EPS and (best is None or gain > best[0] + C.EPS):
            best = gain, axis, *found[1:], cells[gone]
    return best


def pair_bins(x: np.ndarray, kinds: tuple[str, str], sums: Sums, loss: Loss, min_leaf: int, min_gain: float, max_depth: int | None, max_leaves: int | None) -> Bins:
    """Bins of two features; all leaves of the pair tree in the order of its nodes."""
    mass = float(sums.w.sum())
    steps, answer = growing(kinds, min_gain, max_depth, max_leaves), None
    held: dict[int, np.ndarray] = {-1: np.arange(len(x))}
    splits: dict[int, tuple] = {}
    while True:
        try:
            asked = steps.send(answer)
        except StopIteration as e:
            tree = e.value
            break
        for k, parent, side in asked.made:
            held[k] = held[-1] if parent < 0 else splits[parent][side]
        answer = {}
        for k in asked.open:
            best = best_pair_split(x, kinds, held[k], sums, loss, min_leaf, mass)
            if best is not None:
                splits[k] = best[3:]
                answer[k] = *best[:3], *(int(sums.n[c].sum()) if i < 2 else len(c) for i, c in enumerate(best[3:]))
    return Bins("pair", sums.merged([held[k] for k, n in enumerate(tree) if n["axis"] < 0]), tree=tree, has_missing=False)


def route_pair(tree: list[dict], x: np.ndarray) -> np.ndarray:
    """Bin of each row of ``x[row, axis]``."""
    out = np.zeros(len(x), np.int64)
    todo = [(0, np.arange(len(x)))]
    while todo:
        k, rows = todo.pop()
        node = tree[k]
        if node["axis"] < 0:
            out[rows] = node["bin"]
            continue
        v = x[rows, node["axis"]]
        gone = np.isnan(v)
        left = ~gone & ((v <= node["threshold"]) if node["kind"] == "continuous" else (v != node["threshold"]))
        for child, mask in ((node["missing"], gone), (node["left"], left), (node["right"], ~gone & ~left)):
            if mask.any():
                todo.append((child, rows[mask]))
    return out
