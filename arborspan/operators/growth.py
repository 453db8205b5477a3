"""Growing trees: one set of jobs for all open nodes of all trees.

A level is: node ids as an expression of the trees so far; a long view of the
open nodes' rows; sums for each distinct value of each feature (native
aggregation); the search of each (tree, node, feature) on those sums; then, on
the driver, the choice among the few candidates that come back. Nodes without a
leaf cap are independent of each other, so a whole level is searched at once;
with a leaf cap the children of one split are, since the budget depends on it.
"""

from __future__ import annotations

import hashlib
import heapq
import pickle
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import criteria as C
from ..functions.features import Feature
from ..functions.params import TreeParams, feature_count, pair_budget
from ..plans.routing import child_column, walk_column
from ..runtime import ship
from . import assignment, inner, pairs, wide
from .inner import Loss, Sums


@dataclass
class Table:
    """Prepared rows: ``tree, mult, w``, feature values ``f0..``, targets ``y0..``.

    ``classes``: number of classes of each output; None for regression. ``wide``:
    numeric features with more values than one task searches.
    """

    rows: DataFrame
    features: list[Feature]
    outputs: int
    classes: list[int] | None = None
    wide: frozenset[int] = frozenset()

    @property
    def values(self) -> list[Column]:
        return [F.col(f"f{i}") for i in range(len(self.features))]

    @property
    def targets(self) -> list[str]:
        return [f"y{o}" for o in range(self.outputs)]


@dataclass
class Tree:
    nodes: list[dict] = field(default_factory=list)
    importances: np.ndarray | None = None


def node_seed(*parts) -> int:
    """Seed that depends on what a node is, not on when it is searched."""
    return int.from_bytes(hashlib.blake2b("/".join(map(str, parts)).encode(), digest_size=8).digest(), "little")


# --------------------------------------------------------------- aggregation


def stat_columns(table: Table) -> list[tuple[str, Column]]:
    mw = F.col("mult") * F.col("w")
    if table.classes is not None:
        return [(f"s_{o}_{k}", F.sum(F.when(F.col(f"y{o}") == k, mw).otherwise(F.lit(0.0)))) for o, n in enumerate(table.classes) for k in range(n)]
    return [c for o in range(table.outputs) for c in ((f"s_{o}_0", F.sum(mw * F.col(f"y{o}"))), (f"s_{o}_1", F.sum(mw * F.col(f"y{o}") * F.col(f"y{o}"))))]


def aggregate(rows: DataFrame, keys: list[str], table: Table, absolute: bool) -> DataFrame:
    """Sums of rows by ``keys``; for the absolute error by target values as well."""
    base = [F.sum("mult").cast("bigint").alias("n"), F.sum(F.col("mult") * F.col("w")).alias("wsum")]
    if absolute:
        return rows.groupBy(*keys, *table.targets).agg(*base)
    return rows.groupBy(*keys).agg(*base, *[c.alias(n) for n, c in stat_columns(table)])


def stat_shape(table_classes, outputs: int) -> tuple[int, int]:
    return outputs, (max(table_classes) if table_classes is not None else 2)


def sums_of(frame: pd.DataFrame, cells: np.ndarray, count: int, classes, outputs: int, absolute: bool) -> Sums:
    """Sums of a frame of aggregated rows; ``cells`` gives the entry of each row."""
    n = np.bincount(cells, frame["n"].to_numpy(float), count).astype(np.int64)
    w = np.bincount(cells, frame["wsum"].to_numpy(float), count)
    o, k = stat_shape(classes, outputs)
    s = np.zeros((count, o, k))
    if absolute:
        order = np.argsort(cells, kind="stable")
        ends = np.searchsorted(cells[order], np.arange(count + 1))
        y = frame[[f"y{i}" for i in range(outputs)]].to_numpy(float)[order]
        v = frame["wsum"].to_numpy(float)[order]
        return Sums(n, w, s, [y[a:b] for a, b in zip(ends[:-1], ends[1:])], [v[a:b] for a, b in zip(ends[:-1], ends[1:])])
    for i in range(outputs):
        for j in range(classes[i] if classes is not None else 2):
            s[:, i, j] = np.bincount(cells, frame[f"s_{i}_{j}"].to_numpy(float), count)
    return Sums(n, w, s)


# -------------------------------------------------------------------- search


def describe(bins: inner.Bins, choice: assignment.Choice, logical: list[int], loss: Loss) -> dict:
    """A candidate split as plain values."""
    kids = choice.children
    return {
        "kind": "numeric" if bins.kind == "stump" else bins.kind, "logical": logical, "arity": choice.arity, "requested": choice.requested, "impurity": choice.impurity, "gain": choice.gain,
        "thresholds": [float(t) for t in bins.thresholds], "categories": bins.categories, "pair_tree": bins.tree, "labels": choice.labels, "has_missing": bins.has_missing,
        "bin_n": bins.sums.n.tolist(), "bin_w": bins.sums.w.tolist(), "bin_s": bins.sums.s.tolist() if not loss.absolute else [],
        "child_n": kids.n.tolist(), "child_w": kids.w.tolist(), "child_s": kids.s.tolist(), "child_impurity": (loss.of(kids) / loss.outputs).tolist(),
        "child_median": [[C.median_of(y[:, o], v) for o in range(loss.outputs)] for y, v in zip(kids.y, kids.v)] if loss.absolute else [],
    }


def search_feature(frame: pd.DataFrame, feature: Feature, f: int, params: TreeParams, loss: Loss, classes, max_arity: int, parent: float | None):
    """All candidates of one (tree, node, feature), and the proxy for pairs."""
    x = frame["x"].to_numpy(float)
    gone = np.isnan(x)
    values, cells = np.unique(x[~gone], return_inverse=True)
    absolute = loss.absolute
    sums = sums_of(frame[~gone], cells, len(values), classes, loss.outputs, absolute)
    missing = sums_of(frame[gone], np.zeros(int(gone.sum()), np.int64), 1, classes, loss.outputs, absolute)
    if parent is None:
        parent = loss.whole(inner._append(sums, missing)) / loss.outputs
    caps = params.inner_max_depth, params.inner_max_leaf_nodes
    if feature.numeric:
        bins = inner.numeric_bins(values, sums, missing, loss, params.inner_min_samples_leaf, params.inner_min_impurity_decrease, *caps)
    else:
        count = len(feature.categories if feature.kind == "label" else feature.columns)
        bins = inner.category_bins(values, sums, missing, loss, count, params.inner_min_samples_leaf, params.inner_min_impurity_decrease, *caps)
    if bins is None:
        return [], None
    found = children_of(bins, params, loss, parent, max_arity)
    stump = None
    if wants_stump(found, feature, params, int(missing.n[0])):
        stump = inner.fast_numeric_stump(values, sums, missing, loss, params.min_samples_leaf) if feature.numeric else inner.category_stump(values, sums, missing, loss, count, params.min_samples_leaf)
    return candidates(bins, found, stump, f, params, loss, parent)


def children_of(bins: inner.Bins, params: TreeParams, loss: Loss, parent: float, max_arity: int, rounds: int | None = None):
    """Best assignments of bins to children."""
    rounds = params.coordinate_descent_max_iters if rounds is None else rounds
    return assignment.search(bins, loss, parent, max_arity, params.min_samples_leaf, rounds, params.mae_coordinate_descent)


def wants_stump(found, feature: Feature, params: TreeParams, missing: int) -> bool:
    """Whether a two-way cut of its own may do better than the inner tree's."""
    best = assignment.raw_best(found)
    return best is None or not best.root_feasible or (feature.numeric and (params.inner_min_samples_leaf > params.min_samples_leaf or missing > 0))


def candidates(bins: inner.Bins, found, stump: inner.Bins | None, f: int, params: TreeParams, loss: Loss, parent: float):
    """The inner tree's and the stump's candidates, and the better one's best as proxy."""
    best = assignment.raw_best(found)
    proxy = (best, bins) if best is not None else None
    out = [describe(bins, c, [f], loss) for c in found.values()]
    if stump is not None:
        also = children_of(stump, params, loss, parent, 2, 0)
        out += [describe(stump, c, [f], loss) for c in also.values()]
        other = assignment.raw_best(also)
        if other is not None and (best is None or other.impurity < best.impurity - C.TIE_SHARE * abs(parent)):
            proxy = (other, stump)
    return out, (describe(proxy[1], proxy[0], [f], loss) if proxy else None)


def search_wide(sums: DataFrame, table: Table, params: TreeParams, loss: Loss, parents: dict[tuple[int, int], float], max_arity: int) -> dict[tuple[int, int], dict[int, tuple]]:
    """As :func:`search_feature`, for all wide features of all open nodes at once, in range pieces."""
    cells = sums.withColumnRenamed("wsum", "w").persist()
    try:
        plan = wide.Plan(["tree", "node", "f"], loss, table.classes or [2] * table.outputs)
        caps = params.inner_min_samples_leaf, params.inner_min_impurity_decrease, params.inner_max_depth, params.inner_max_leaf_nodes
        bins = wide.numeric_bins(cells, plan, *caps)
        found = {key: children_of(b, params, loss, parents[key[:2]], max_arity) for key, b in bins.items()}
        again = [key for key, b in bins.items() if wants_stump(found[key], table.features[key[2]], params, int(b.sums.n[-1]))]
        stumps = wide.numeric_stumps(cells, plan, again, params.min_samples_leaf)
    finally:
        cells.unpersist()
    out: dict[tuple[int, int], dict[int, tuple]] = {}
    for key, b in bins.items():
        out.setdefault(key[:2], {})[key[2]] = candidates(b, found[key], stumps.get(key), key[2], params, loss, parents[key[:2]])
    return out


def _discover(table: Table, params: TreeParams, loss: Loss, trees: dict[int, Tree], open_: dict[tuple[int, int], dict], max_arity: int) -> dict[tuple[int, int], list[dict]]:
    """Candidates of every open node: ``open_[tree, node]`` holds its path."""
    ship(table.rows.sparkSession)
    features, classes, absolute = table.features, table.classes, loss.absolute
    wanted = feature_count(params.max_features, len(features))
    bags = {}
    for (t, k), info in open_.items():
        rng = np.random.default_rng(node_seed(params.random_state, t, info["path"], "bag"))
        if callable(params.max_features):
            order = np.array(list(dict.fromkeys(int(f) for f in params.max_features(len(features), rng))), np.int64)
        elif wanted < len(features):
            order = rng.permutation(len(features))[:wanted]
        else:
            order = np.arange(len(features))
        bags[t, k] = order.tolist()
    rows = with_nodes(table, trees, set(open_))
    allowed = None
    if any(len(b) < len(features) for b in bags.values()):  # open nodes times features: bounded by the trees' own size
        allowed = F.broadcast(rows.sparkSession.createDataFrame([(t, k, f) for (t, k), fs in bags.items() for f in fs], "tree int, node int, f int"))

    def sums(some: list[int]) -> DataFrame:
        long = rows.withColumn("cell", F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.col(f"f{i}").alias("x")) for i in some])))
        long = long.select("tree", "node", F.col("cell.f").alias("f"), F.col("cell.x").alias("x"), "mult", "w", *table.targets)
        long = long.join(allowed, ["tree", "node", "f"]) if allowed is not None else long
        return aggregate(long, ["tree", "node", "f", "x"], table, absolute)

    parents = {key: info["impurity"] for key, info in open_.items()}

    def run(key: tuple[Any, ...], frame: pd.DataFrame) -> pd.DataFrame:
        t, k, f = (int(v) for v in key)
        frame = frame.sort_values(["x", *[c for c in frame.columns if c.startswith("y")]], kind="stable")
        got = search_feature(frame, features[f], f, params, loss, classes, max_arity, parents[t, k])
        return pd.DataFrame({"tree": [t], "node": [k], "f": [f], "payload": [pickle.dumps(got)]})

    narrow = [i for i in range(len(features)) if i not in table.wide]
    by_node: dict[tuple[int, int], dict[int, tuple]] = search_wide(sums(sorted(table.wide)), table, params, loss, parents, max_arity) if table.wide else {}
    if narrow:
        for r in sums(narrow).groupBy("tree", "node", "f").applyInPandas(run, "tree int, node int, f int, payload binary").collect():
            by_node.setdefault((r["tree"], r["node"]), {})[r["f"]] = pickle.loads(r["payload"])
    budget = pair_budget(params.pairwise_candidates, len(features))
    kept_pairs = _pairs(table, params, loss, trees, open_, by_node, budget, max_arity) if budget else {}
    out: dict[tuple[int, int], list[dict]] = {}
    for key in open_:
        best: dict[int, dict] = {}
        found = by_node.get(key, {})
        slack = C.TIE_SHARE * abs(trees[key[0]].nodes[key[1]]["mass"] * parents[key])
        ordered = [c for f in bags[key] if f in found for c in found[f][0]] + kept_pairs.get(key, {}).get("candidates", [])
        for c in ordered:
            cost = params.min_impurity_decrease + params.branching_penalty * (c["arity"] - 2) + (params.pairwise_penalty if c["kind"] == "pair" else 0.0)
            c["reg_gain"] = c["gain"] - cost
            if np.isfinite(c["reg_gain"]) and c["reg_gain"] > C.EPS and (c["arity"] not in best or c["reg_gain"] > best[c["arity"]]["reg_gain"] + slack):
                best[c["arity"]] = c
        retained = kept_pairs.get(key, {}).get("pairs", [])
        for c in best.values():
            c["retained_pairs"] = retained
        out[key] = list(best.values())
    return out


def with_nodes(table: Table, trees: dict[int, Tree], only: set[tuple[int, int]] | None = None) -> DataFrame:
    """Rows with the ``node`` they are in; with ``only``, those in these nodes."""
    node = None
    for t, tree in trees.items():
        if only is not None and not any(o == t for o, _ in only):
            continue
        keep = None if only is None else {k for o, k in only if o == t}
        inside = walk_column(tree.nodes, table.values, lambda n, keep=keep: F.lit(n["node_id"] if keep is None or n["node_id"] in keep else None).cast("int"))
        node = F.when(F.col("tree") == t, inside) if node is None else node.when(F.col("tree") == t, inside)
    return table.rows.withColumn("node", node if node is not None else F.lit(None).cast("int")).where("node is not null")


# --------------------------------------------------------------------- pairs


def crossed(table: Table, loss: Loss, rows: DataFrame, proxies: dict[tuple[int, int], dict[int, dict]]) -> DataFrame:
    """Sums by (tree, node, first and second feature, their proxies' children)."""
    sides = []
    for f in sorted({f for p in proxies.values() for f in p}):
        col = None
        for (t, k), own in proxies.items():
            if f in own:
                at = (F.col("tree") == t) & (F.col("node") == k)
                child = child_column(split_node(own[f]), table.values)
                col = F.when(at, child) if col is None else col.when(at, child)
        sides.append(F.struct(F.lit(f).alias("f"), col.cast("int").alias("p")))
    listed = rows.withColumn("sides", F.filter(F.array(*sides), lambda s: s["p"].isNotNull()))
    pairs_of = F.flatten(F.transform("sides", lambda a: F.transform(F.filter("sides", lambda b: b["f"] > a["f"]), lambda b: F.struct(a["f"].alias("fa"), b["f"].alias("fb"), a["p"].alias("pa"), b["p"].alias("pb")))))
    long = listed.withColumn("pair", F.explode(pairs_of)).select("tree", "node", "pair.*", "mult", "w", *table.targets)
    return aggregate(long, ["tree", "node", "fa", "fb", "pa", "pb"], table, loss.absolute)


def split_node(c: dict) -> dict:
    """A candidate in the form that routing expressions take."""
    return {
        "kind": c["kind"], "logical": c["logical"], "thresholds": c["thresholds"], "categories": c["categories"], "pair_tree": c["pair_tree"],
        "bin_to_partition": c["labels"], "children": list(range(c["arity"])),
    }


def _pairs(table, params, loss, trees, open_, by_node, budget, max_arity) -> dict[tuple[int, int], dict]:
    """Screen feature pairs by crossed children, fit the best, search their bins."""
    proxies = {key: {f: got[1] for f, got in found.items() if got[1] is not None} for key, found in by_node.items()}
    proxies = {key: p for key, p in proxies.items() if len(p) >= 2}
    if not proxies:
        return {}
    rows = with_nodes(table, trees, set(proxies))
    classes, features = table.classes, table.features

    def screen(key: tuple[Any, ...], frame: pd.DataFrame) -> pd.DataFrame:
        cells = frame.groupby(["pa", "pb"]).ngroup().to_numpy()
        sums = sums_of(frame, cells, int(cells.max()) + 1, classes, loss.outputs, loss.absolute)
        mass = sums.w.sum()
        value = float((sums.w * loss.of(sums)).sum() / mass / loss.outputs) if mass > 0 else 0.0
        return pd.DataFrame({"tree": [key[0]], "node": [key[1]], "fa": [key[2]], "fb": [key[3]], "value": [value]})

    scored = crossed(table, loss, rows, proxies).groupBy("tree", "node", "fa", "fb").applyInPandas(screen, "tree int, node int, fa int, fb int, value double").collect()
    chosen: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for key, own in proxies.items():
        ranked = sorted((r["value"] - min(own[r["fa"]]["impurity"], own[r["fb"]]["impurity"]), r["fa"], r["fb"]) for r in scored if (r["tree"], r["node"]) == key)
        chosen[key] = [(a, b) for _, a, b in ranked[:budget]]
    listed = [(t, k, a, b) for (t, k), ps in chosen.items() for a, b in ps]
    if not listed:
        return {}
    spark = table.rows.sparkSession
    parents = {key: info["impurity"] for key, info in open_.items()}
    size = {(t, k): trees[t].nodes[k]["n"] for t, k in chosen}
    values = F.array(*table.values)

    def joint(some: list[tuple[int, int, int, int]]) -> DataFrame:
        wanted = F.broadcast(spark.createDataFrame(some, "tree int, node int, fa int, fb int"))  # a row for each pair
        both = [F.element_at(values, F.col(f"f{s}") + 1).alias(f"x{s}") for s in "ab"]
        return rows.join(wanted, ["tree", "node"]).select("tree", "node", "fa", "fb", *both, "mult", "w", *table.targets)

    def fit(key: tuple[Any, ...], frame: pd.DataFrame) -> pd.DataFrame:
        t, k, a, b = (int(v) for v in key)
        frame = frame.sort_values(["xa", "xb", *[c for c in frame.columns if c.startswith("y")]], kind="stable")
        x, cells = np.unique(frame[["xa", "xb"]].to_numpy(float), axis=0, return_inverse=True, equal_nan=True) if len(frame) else (np.zeros((0, 2)), np.zeros(0, np.int64))
        part = sums_of(frame, cells.ravel(), len(x), classes, loss.outputs, loss.absolute)
        bins = pairs.pair_bins(x, (features[a].kind, features[b].kind), part, loss, *caps)
        return pd.DataFrame({"tree": [t], "node": [k], "fa": [a], "fb": [b], "payload": [pickle.dumps(described(t, k, a, b, bins))]})

    def described(t, k, a, b, bins):
        found = children_of(bins, params, loss, parents[t, k], max_arity) if len(bins.sums) >= 2 else {}
        return [describe(bins, c, [a, b], loss) for c in found.values()]

    caps = params.inner_min_samples_leaf, params.inner_min_impurity_decrease, params.inner_max_depth, params.inner_max_leaf_nodes
    large = [key for key in listed if size[key[:2]] > params.max_distinct and not loss.absolute]
    small = [key for key in listed if key not in set(large)]
    fitted: dict[tuple[int, int, int, int], list[dict]] = {}
    if small:
        sums = aggregate(joint(small), ["tree", "node", "fa", "fb", "xa", "xb"], table, loss.absolute)
        for r in sums.groupBy("tree", "node", "fa", "fb").applyInPandas(fit, "tree int, node int, fa int, fb int, payload binary").collect():
            fitted[r["tree"], r["node"], r["fa"], r["fb"]] = pickle.loads(r["payload"])
    if large:
        plan = wide.Plan(["tree", "node", "fa", "fb"], loss, classes or [2] * table.outputs)
        kinds = {key: tuple("continuous" if features[f].numeric else features[f].kind for f in key[2:]) for key in large}
        bins, _ = wide.pair_bins(row_stats(joint(large), table), plan, kinds, *caps)
        fitted |= {key: described(*key, b) for key, b in bins.items()}
    return {key: {"pairs": [list(p) for p in ps], "candidates": [c for p in ps for c in fitted.get((*key, *p), [])]} for key, ps in chosen.items()}


def row_stats(rows: DataFrame, table: Table) -> DataFrame:
    """Rows with the columns ``n``, ``w`` and ``s_..`` of which the statistics are sums."""
    mw = F.col("mult") * F.col("w")
    if table.classes is not None:
        own = {f"s_{o}_{k}": F.when(F.col(f"y{o}") == k, mw).otherwise(F.lit(0.0)) for o, n in enumerate(table.classes) for k in range(n)}
    else:
        own = {f"s_{o}_{k}": mw * F.col(f"y{o}") * (F.col(f"y{o}") if k else F.lit(1.0)) for o in range(table.outputs) for k in (0, 1)}
    return rows.select("tree", "node", "fa", "fb", "xa", "xb", F.col("mult").cast("bigint").alias("n"), mw.alias("w"), *[c.alias(name) for name, c in own.items()])


# ---------------------------------------------------------------------- trees


def node_stats(rows: DataFrame, keys: list[str], table: Table, loss: Loss) -> dict[tuple, tuple]:
    """Per key: rows, mass, statistics, impurity (mean over outputs), medians.

    One row a key reaches the driver; medians and absolute errors are found by
    window plans, since those need all targets.
    """
    o, k = stat_shape(table.classes, table.outputs)
    mw = F.col("mult") * F.col("w")
    if loss.absolute:
        counted = rows.groupBy(*keys).agg(F.sum("mult").cast("bigint").alias("n"), F.sum(mw).alias("wsum"))
        medians = [{tuple(r[c] for c in keys): (r["median"], r["mae"]) for r in C.weighted_median(rows.withColumn("__mw", mw), keys, y, "__mw").collect()} for y in table.targets]
        out = {}
        for r in counted.collect():
            key = tuple(r[c] for c in keys)
            found = [m.get(key, (0.0, 0.0)) for m in medians]
            out[key] = r["n"], r["wsum"], np.zeros((o, k)), sum(e for _, e in found) / table.outputs, [m for m, _ in found]
        return out
    frame = aggregate(rows, keys, table, False).toPandas()
    sums = sums_of(frame, np.arange(len(frame)), len(frame), table.classes, table.outputs, False)
    impurity = loss.of(sums) / table.outputs
    return {tuple(int(v) for v in key): (int(sums.n[i]), float(sums.w[i]), sums.s[i], float(impurity[i]), []) for i, key in enumerate(frame[keys].itertuples(index=False, name=None))}


def leaf_value(w: float, s, classes, outputs: int, median: list[float]) -> list:
    """Class shares of each output (uniform without mass), or the mean or median."""
    if classes is not None:
        return [[s[o][k] / w if w > 0 else 1.0 / n for k in range(n)] for o, n in enumerate(classes)]
    return list(median) if median else [s[o][0] / w if w > 0 else 0.0 for o in range(outputs)]


def new_node(t: int, k: int, parent: int, partition: int, depth: int, n, w, s, impurity, median, table: Table) -> dict:
    return {
        "tree_id": t, "node_id": k, "parent_id": parent, "partition": partition, "depth": depth, "is_leaf": True, "n": int(n), "mass": float(w), "impurity": float(impurity), "raw_gain": 0.0, "reg_gain": 0.0,
        "kind": "constant", "logical": [], "columns": [], "thresholds": [], "categories": [], "pair_tree": [], "bin_to_partition": [], "bin_n": [], "bin_w": [], "bin_stats": [], "retained_pairs": [],
        "class_counts": [list(s[o][:c]) for o, c in enumerate(table.classes)] if table.classes is not None else [], "value": leaf_value(w, s, table.classes, table.outputs, median), "children": [],
    }


def commit(tree: Tree, k: int, c: dict, table: Table) -> list[int]:
    """Split node ``k`` by a candidate; ids of the new children."""
    node, t = tree.nodes[k], tree.nodes[k]["tree_id"]
    kids = []
    for p in range(c["arity"]):
        kids.append(len(tree.nodes))
        tree.nodes.append(new_node(t, kids[-1], k, p, node["depth"] + 1, c["child_n"][p], c["child_w"][p], c["child_s"][p], c["child_impurity"][p], c["child_median"][p] if c["child_median"] else [], table))
    node |= {
        "is_leaf": False, "kind": c["kind"], "logical": c["logical"], "columns": [x for f in c["logical"] for x in table.features[f].columns], "thresholds": c["thresholds"], "categories": c["categories"], "pair_tree": c["pair_tree"],
        "bin_to_partition": c["labels"], "bin_n": c["bin_n"], "bin_w": c["bin_w"], "bin_stats": c["bin_s"], "raw_gain": c["gain"], "reg_gain": c["reg_gain"], "retained_pairs": c["retained_pairs"], "children": kids,
    }
    share = c["gain"] / len(c["logical"])
    for f in c["logical"]:
        tree.importances[f] += share
    return kids


def fit_trees(table: Table, params: TreeParams) -> dict[int, Tree]:
    """Grow every tree of ``table``; all of them share each level's jobs."""
    loss = Loss(params.criterion, table.outputs)
    trees: dict[int, Tree] = {}
    paths: dict[tuple[int, int], str] = {}
    for (t,), (n, w, s, impurity, median) in sorted(node_stats(table.rows, ["tree"], table, loss).items(), key=lambda x: x[0]):
        tree = Tree([], np.zeros(len(table.features)))
        tree.nodes.append(new_node(t, 0, -1, 0, 0, n, w, s, impurity, median, table))
        trees[t] = tree
        paths[t, 0] = ""

    def searchable(t: int, k: int) -> bool:
        node = trees[t].nodes[k]
        deep = params.max_depth is not None and node["depth"] >= params.max_depth
        return not deep and node["n"] >= 2 * params.min_samples_leaf and node["impurity"] > 0

    def discover(keys, max_arity):
        keys = [key for key in keys if searchable(*key)]
        if not keys or max_arity < 2:
            return {}
        info = {key: {"path": paths[key], "impurity": trees[key[0]].nodes[key[1]]["impurity"]} for key in keys}
        return _discover(table, params, loss, trees, info, max_arity)

    def split(key, c):
        t, k = key
        kids = commit(trees[t], k, c, table)
        for p, kid in enumerate(kids):
            paths[t, kid] = f"{paths[t, k]}.{p}"
        return [(t, kid) for kid in kids]

    best_of = lambda cs: min(cs, key=lambda c: (-c["reg_gain"], c["arity"], c["kind"] == "pair"))
    if params.max_leaf_nodes is None:
        level = [(t, 0) for t in trees]
        while level:
            found = discover(level, params.num_partitions)
            level = [kid for key in level if found.get(key) for kid in split(key, best_of(found[key]))]
    else:
        _grow_capped(params, trees, discover, split, best_of)
    for t in trees:
        trees[t] = renumbered(trees[t])
        total = trees[t].importances.sum()
        if total > 0:
            trees[t].importances = trees[t].importances / total
    return trees


def _grow_capped(params, trees, discover, split, best_of) -> None:
    """Best-first growth under a leaf cap, a step of every tree at a time."""
    leaves = {t: 1 for t in trees}
    frontier: dict[int, dict[tuple[int, int], list[dict]]] = {t: {} for t in trees}
    cap = params.max_leaf_nodes
    new = {t: [(t, 0)] for t in trees if cap > 1}
    while new:
        by_arity: dict[int, list] = {}
        for t, keys in new.items():
            by_arity.setdefault(min(params.num_partitions, cap - leaves[t] + 1), []).extend(keys)
        for arity, keys in by_arity.items():
            for key, cs in discover(keys, arity).items():
                cs = [c for c in cs if c["arity"] <= arity]
                if cs:
                    frontier[key[0]][key] = cs
        new = {}
        for t, own in frontier.items():
            room = cap - leaves[t] + 1
            for key in list(own):
                own[key] = [c for c in own[key] if c["arity"] <= room]
                if not own[key]:
                    del own[key]
            if leaves[t] >= cap or not own:
                continue
            key = min(own, key=lambda k: (-(c := best_of(own[k]))["reg_gain"], c["arity"], c["kind"] == "pair", k[1]))
            kids = split(key, best_of(own.pop(key)))
            leaves[t] += len(kids) - 1
            new[t] = kids if leaves[t] < cap else []


def renumbered(tree: Tree) -> Tree:
    """Node ids in the order in which best-first growth commits splits."""
    nodes = tree.nodes
    order, names = [0], {0: 0}
    heap = [(-nodes[0]["reg_gain"], len(nodes[0]["children"]), nodes[0]["kind"] == "pair", 0, 0)] if nodes and not nodes[0]["is_leaf"] else []
    while heap:
        *_, k = heapq.heappop(heap)
        for c in nodes[k]["children"]:
            names[c] = len(order)
            order.append(c)
            if not nodes[c]["is_leaf"]:
                heapq.heappush(heap, (-nodes[c]["reg_gain"], len(nodes[c]["children"]), nodes[c]["kind"] == "pair", names[c], c))
    out = []
    for k in order:
        out.append(nodes[k] | {"node_id": names[k], "parent_id": names.get(nodes[k]["parent_id"], -1), "children": [names[c] for c in nodes[k]["children"]]})
    return Tree(out, tree.importances)
