"""Scoring of large forests in batches.

Generated conditions are the fastest way to score a tree, but a plan grows with
the trees. Beyond a number of nodes a forest is scored by vectorised walks over
batches of rows; results are the same.
"""

from __future__ import annotations

import numpy as np

from .pairs import route_pair


def node_children(node: dict, x: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Child of each of ``rows`` at a split node; ``x[row, feature]`` with NaN for missing."""
    labels = np.array(node["bin_to_partition"])
    if node["kind"] == "constant":
        return np.full(len(rows), labels[0])
    if node["kind"] == "pair":
        return labels[route_pair(node["pair_tree"], x[np.ix_(rows, node["logical"])])]
    v = x[rows, node["logical"][0]]
    gone = np.isnan(v)
    if node["kind"] == "numeric":
        bins = np.searchsorted(np.array(node["thresholds"]), v, side="left")
        return np.where(gone, labels[-1], labels[np.minimum(bins, len(labels) - 2)])
    out = np.full(len(rows), labels[len(node["categories"]) - 1])
    for codes, label in zip(node["categories"], labels):
        out[np.isin(v, codes)] = label
    return np.where(gone, labels[-1], out)


def walk(nodes: list[dict], x: np.ndarray) -> np.ndarray:
    """Leaf id of each row."""
    out = np.zeros(len(x), np.int64)
    todo = [(0, np.arange(len(x)))]
    while todo:
        k, rows = todo.pop()
        node = nodes[k]
        if node["is_leaf"] or not len(rows):
            out[rows] = k
            continue
        child = node_children(node, x, rows)
        todo += [(c, rows[child == p]) for p, c in enumerate(node["children"])]
    return out


def mean_values(trees: dict, scaling: dict, classes, outputs: int, x: np.ndarray) -> list[np.ndarray]:
    """Per output, class shares or values, averaged over the trees."""
    total = [0.0] * outputs
    for t, tree in sorted(trees.items()):
        leaf = walk(tree.nodes, x)
        for o in range(outputs):
            if classes is not None:
                total[o] = total[o] + np.array([n["value"][o] for n in tree.nodes], float)[leaf]
            else:
                mean, scale = scaling[t][o]
                total[o] = total[o] + np.array([n["value"][o] * scale + mean for n in tree.nodes], float)[leaf]
    return [v / len(trees) for v in total]
