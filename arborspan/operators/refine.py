"""Refining a fitted tree's routing with its topology fixed.

Nodes are visited from the deepest level up. At a node, only rows whose reward
differs between the children matter. The current router competes with sending
all rows to one child, with the best single-column router and with the
retained pairs. Nodes of one depth hold disjoint rows and subtrees, so a whole
depth of all trees is one set of jobs; leaf statistics are refreshed after each.
"""

from __future__ import annotations

import copy
import pickle
from dataclasses import replace
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.params import check_int, check_number
from ..plans.cuts import best_reward_cuts
from ..plans.routing import child_column, walk_column
from ..runtime import ship
from . import inner, pairs, wide
from .estimators import TreeModel, prepare
from .growth import Table, Tree, leaf_value, node_stats
from .inner import Loss, Sums, midpoint

#: Rewards nearer than this, relative to the best, count as equal.
CARE_TOLERANCE = 1e-9
#: Mean rewards nearer than this are a tie, which the cheaper router wins.
TIE = 1e-12


def refine(model: TreeModel, df: DataFrame, weight: str | None = None, n_runs: int = 1, lambda_: float = 1e-4, pair_scale: float = 2.0, check: bool = True) -> TreeModel:
    """A refined copy of a tree or forest; ``model`` stays as it is.

    ``lambda_`` prices the rows that a router must look at: nothing for a
    constant one, once for a single column, ``pair_scale`` times for a pair.
    Importances aren't defined for the result.
    """
    check_int("n_runs", n_runs, 0)
    check_number("lambda_", lambda_)
    check_number("pair_scale", pair_scale)
    classification = model.classes is not None
    params = replace(model.params, class_weight=model.params.class_weight)
    fixed = model.scaling if not classification else {t: None for t in model.trees}
    made = prepare(df, model.feature_names_in_, model.targets, params, classification, weight, None, features=model.features, classes=model.classes, check=check, scaling=fixed)
    table = replace(made.table, rows=made.table.rows.persist())
    trees = {t: Tree(copy.deepcopy(tree.nodes), tree.importances) for t, tree in model.trees.items()}
    loss = Loss(params.criterion, table.outputs)
    try:
        for _ in range(n_runs):
            if not _sweep(table, trees, params, loss, lambda_, pair_scale):
                break
    finally:
        table.rows.unpersist()
    return replace(model, trees=trees, refined=n_runs > 0)


def _sweep(table: Table, trees: dict[int, Tree], params, loss: Loss, lam: float, pair_scale: float) -> bool:
    depths = {n["depth"] for tree in trees.values() for n in tree.nodes if not n["is_leaf"]}
    changed = False
    for depth in sorted(depths, reverse=True):
        at = {(t, n["node_id"]): n for t, tree in trees.items() for n in tree.nodes if n["depth"] == depth and len(n["children"]) >= 2}
        accepted = _refine_level(table, trees, at, params, loss, lam, pair_scale) if at else False
        if accepted:
            refresh(table, trees, loss)
            changed = True
    return changed


def child_rewards(table: Table, tree: Tree, node: dict, absolute: bool) -> list[Column]:
    """Reward of each child for a row: how right the leaf is that it leads to."""
    out = []
    for child in node["children"]:
        parts = []
        for o in range(table.outputs):
            y = F.col(f"y{o}")
            if table.classes is not None:
                leaf = walk_column(tree.nodes, table.values, lambda n, o=o: F.lit(int(np.argmax(n["value"][o]))), child)
                parts.append(F.when(leaf == y, F.lit(1.0)).otherwise(F.lit(0.0)))
            else:
                leaf = walk_column(tree.nodes, table.values, lambda n, o=o: F.lit(float(n["value"][o])), child)
                parts.append(-F.abs(y - leaf) if absolute else -(y - leaf) * (y - leaf))
        total = parts[0]
        for p in parts[1:]:
            total = total + p
        out.append(total / F.lit(float(table.outputs)) if table.classes is not None else total)
    return out


def care_rows(table: Table, trees: dict[int, Tree], at: dict[tuple[int, int], dict], loss: Loss) -> DataFrame:
    """Rows at the given nodes with ``rewards``, ``here`` (current child), ``good``
    (mask of children that count as right) and ``care``."""
    k = max(len(n["children"]) for n in at.values())
    node = rewards = here = None
    for t, tree in trees.items():
        own = {key[1]: n for key, n in at.items() if key[0] == t}
        if not own:
            continue

        def found(nodes=tree.nodes, own=own):
            stop = [dict(n, is_leaf=True) if n["node_id"] in own else n for n in nodes]
            return walk_column(stop, table.values, lambda n: F.lit(n["node_id"] if n["node_id"] in own else None).cast("int"))

        is_tree = F.col("tree") == t
        node = F.when(is_tree, found()) if node is None else node.when(is_tree, found())
    rows = table.rows.withColumn("node", node).where("node is not null")
    for (t, i), n in at.items():
        is_node = (F.col("tree") == t) & (F.col("node") == i)
        each = child_rewards(table, trees[t], n, loss.absolute) + [F.lit(None).cast("double")] * (k - len(n["children"]))
        rewards = F.when(is_node, F.array(*each)) if rewards is None else rewards.when(is_node, F.array(*each))
        child = child_column(n, table.values)
        here = F.when(is_node, child) if here is None else here.when(is_node, child)
    rows = rows.withColumn("rewards", rewards).withColumn("here", here.cast("int"))
    best, worst = F.array_max("rewards"), F.array_min("rewards")
    near = lambda r, b: F.abs(r - b) <= CARE_TOLERANCE * (1 + F.abs(b))
    rows = rows.withColumn("care", best - worst > CARE_TOLERANCE * (1 + F.abs(best)))
    if table.classes is not None and table.outputs == 1:
        good = F.transform("rewards", lambda r: F.coalesce(r > 0.5, F.lit(False)))
        share = F.lit(1.0) / F.size(F.filter(good, lambda g: g))
    elif table.classes is not None:
        good, share = F.transform("rewards", lambda r: F.coalesce(~near(r, worst), F.lit(False))), F.lit(1.0)
    else:
        good, share = F.transform("rewards", lambda r: F.coalesce(near(r, best), F.lit(False))), F.lit(1.0)
    return rows.withColumn("good", good).withColumn("share", share)


def _care_sums(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    mw = F.col("mult") * F.col("w")
    aggs = [F.sum("mult").cast("bigint").alias("n"), F.sum(F.col("mult") * F.size(F.filter("good", lambda g: g))).cast("bigint").alias("nexp"), F.sum(mw).alias("mass")]
    for c in range(k):
        aggs.append(F.sum(F.when(F.col("good")[c], mw * F.col("share")).otherwise(F.lit(0.0))).alias(f"g{c}"))
        aggs.append(F.sum(mw * F.coalesce(F.col("rewards")[c], F.lit(0.0))).alias(f"q{c}"))
    return rows.groupBy(*keys).agg(*aggs)


def raw_columns(table: Table) -> list[tuple[int, int | None]]:
    """Every raw column as (feature, category or None)."""
    out: list[tuple[int, int | None]] = []
    for i, f in enumerate(table.features):
        out += [(i, None)] if f.numeric else [(i, c) for c in range(len(f.categories if f.kind == "label" else f.columns))]
    return out


def _refine_level(table, trees, at, params, loss, lam, pair_scale) -> bool:
    ship(table.rows.sparkSession)
    k = max(len(n["children"]) for n in at.values())
    rows = care_rows(table, trees, at, loss)
    care = rows.where("care")
    reward_here = F.element_at("rewards", F.col("here") + 1)
    total = rows.groupBy("tree", "node").agg(F.sum("mult").alias("n_node"), F.sum(F.when(F.col("care"), F.col("mult") * F.col("w") * reward_here)).alias("current"))
    sums = _care_sums(care, ["tree", "node"], k)
    heads = {(r["tree"], r["node"]): r for r in total.join(sums, ["tree", "node"]).collect()}
    heads = {key: r for key, r in heads.items() if r["mass"] and r["mass"] > 0}
    if not heads:
        return False
    dummies = {key: int(np.argmax([r[f"g{c}"] for c in range(len(at[key]["children"]))])) for key, r in heads.items()}
    arity = {key: len(at[key]["children"]) for key in heads}
    router = "gini" if table.classes is None else params.criterion
    caps = (params.inner_min_samples_leaf, params.inner_min_impurity_decrease, params.inner_max_depth, params.inner_max_leaf_nodes)
    raw = raw_columns(table)
    keep = ["tree", "node", "mult", "w", "rewards", "good", "share"]
    broad = [r for r, (f, _) in enumerate(raw) if f in table.wide]

    def column_sums(some: list[int]) -> DataFrame:
        cells = [F.struct(F.lit(r).alias("r"), (F.col(f"f{f}") if c is None else F.when(F.col(f"f{f}") == float(c), F.lit(1.0)).otherwise(F.lit(0.0))).alias("x")) for r in some for f, c in [raw[r]]]
        long = care.withColumn("cell", F.explode(F.array(*cells))).select(*keep, F.col("cell.r").alias("r"), F.col("cell.x").alias("x"))
        return _care_sums(long, ["tree", "node", "r", "x"], k)

    def single(key: tuple[Any, ...], frame: pd.DataFrame) -> pd.DataFrame:
        t, i, r = (int(v) for v in key)
        best = _best_single(frame.sort_values("x", kind="stable"), arity[t, i], dummies[t, i], router, caps)
        return pd.DataFrame({"tree": [t], "node": [i], "r": [r], "payload": [pickle.dumps(best)]})

    singles: dict[tuple[int, int], dict[int, list]] = _wide_singles(column_sums(broad), arity, dummies, router, caps, k) if broad else {}
    if len(broad) < len(raw):
        some = [r for r in range(len(raw)) if r not in broad]
        for g in column_sums(some).groupBy("tree", "node", "r").applyInPandas(single, "tree int, node int, r int, payload binary").collect():
            singles.setdefault((g["tree"], g["node"]), {})[g["r"]] = pickle.loads(g["payload"])
    fitted = _refine_pairs(table, care, keep, at, heads, arity, dummies, router, caps, k, params.max_distinct)
    accepted = False
    for key, head in heads.items():
        node, mass, n_node = trees[key[0]].nodes[key[1]], head["mass"], head["n_node"]
        price = lam * n_node / mass
        scale = 0.0 if not node["logical"] else pair_scale if len(node["logical"]) == 2 else 1.0
        current = (head["current"] or 0.0) / mass - scale * price
        dummy = head[f"q{dummies[key]}"] / mass
        one = None
        for kind in ("tree", "cut"):  # exact cuts come after the fitted routers
            for r, options in sorted(singles.get(key, {}).items()):
                for o in options:
                    if o["how"] == kind and (one is None or o["reward"] / mass - price > one[0] + TIE):
                        one = o["reward"] / mass - price, r, o
        two = None
        for (a, b), o in sorted(fitted.get(key, {}).items()):
            value = o["reward"] / mass - pair_scale * price
            if two is None or value > two[0] + TIE:
                two = value, (a, b), o
        s1, s2 = one[0] if one else -np.inf, two[0] if two else -np.inf
        if dummy >= current - TIE and dummy >= s1 - TIE and dummy >= s2 - TIE:
            node |= {"kind": "constant", "logical": [], "columns": [], "thresholds": [], "categories": [], "pair_tree": [], "bin_to_partition": [dummies[key]], "raw_gain": 0.0}
        elif one and s1 > current + TIE and s1 >= s2 - TIE:
            node |= _as_router(table, raw[one[1]], one[2])
        elif two and s2 > current + TIE:
            a, b = two[1]
            node |= {"kind": "pair", "logical": [a, b], "columns": [*table.features[a].columns, *table.features[b].columns], "thresholds": [], "categories": [], "pair_tree": two[2]["tree"], "bin_to_partition": two[2]["labels"]}
        else:
            continue
        accepted = True
    return accepted


def _as_router(table: Table, column: tuple[int, int | None], o: dict) -> dict:
    f, c = column
    out = {"logical": [f], "columns": list(table.features[f].columns), "pair_tree": [], "thresholds": o["thresholds"], "categories": [], "bin_to_partition": o["labels"], "kind": "numeric"}
    if c is not None:  # a 0/1 column of a category: set, or not (missing counts as not)
        count = len(table.features[f].categories if table.features[f].kind == "label" else table.features[f].columns)
        finite = o["labels"][:-1]
        low, high = finite[0], finite[-1]
        out |= {"kind": "categorical", "thresholds": [], "categories": [[c], [d for d in range(count) if d != c]], "bin_to_partition": [high, low, low]}
    return out


def _best_single(frame: pd.DataFrame, k: int, dummy: int, router: str, caps) -> list[dict]:
    """Routers on one column: its inner tree relabelled by reward, and for two
    children the cut with the most reward."""
    x = frame["x"].to_numpy(float)
    gone = np.isnan(x)
    g, q = frame[[f"g{c}" for c in range(k)]].to_numpy(float), frame[[f"q{c}" for c in range(k)]].to_numpy(float)
    nexp, n = frame["nexp"].to_numpy(np.int64), frame["n"].to_numpy(np.int64)
    v = x[~gone]
    out = []
    sums = Sums(nexp[~gone], g[~gone].sum(1), g[~gone][:, None, :])
    missing = Sums(np.array([nexp[gone].sum()]), np.array([g[gone].sum()]), g[gone].sum(0)[None, None, :])
    bins = inner.numeric_bins(v, sums, missing, Loss(router, 1), *caps)
    if bins is not None:
        at = np.where(gone, len(bins.thresholds) + 1, np.searchsorted(bins.thresholds, x, side="left"))
        by_bin = np.array([q[at == b].sum(0) for b in range(len(bins.thresholds) + 2)])
        mass = np.bincount(at, frame["mass"].to_numpy(float), len(by_bin))
        labels = np.where(mass > 0, by_bin.argmax(1), dummy)
        out.append({"how": "tree", "reward": float(by_bin[np.arange(len(labels)), labels].sum()), "thresholds": [float(t) for t in bins.thresholds], "labels": labels.tolist()})
    if k == 2 and len(v) > 1:
        rows = np.cumsum(n[~gone])
        run = np.cumsum(q[~gone], 0)
        v32 = v.astype(np.float32)
        ok = (v32[1:] > v32[:-1] + inner.VALUE_TOLERANCE) & (rows[:-1] >= caps[0]) & (rows[-1] - rows[:-1] >= caps[0])
        if ok.any():
            left, right = run[:-1], run[-1] - run[:-1]
            both = np.stack([left[:, 0] + right[:, 1], left[:, 1] + right[:, 0]], 1)
            both = np.where(ok[:, None], both, -np.inf)
            cut, side = (int(z) for z in np.unravel_index(np.argmax(both), both.shape))
            lost = q[gone].sum(0)
            nan_child = int(np.argmax(lost)) if gone.any() and frame["mass"].to_numpy(float)[gone].sum() > 0 else dummy
            out.append({"how": "cut", "reward": float(both[cut, side] + lost[nan_child]), "thresholds": [midpoint(float(v[cut]), float(v[cut + 1]))], "labels": [side, 1 - side, nan_child]})
    return out


def _wide_singles(sums: DataFrame, arity, dummies, router: str, caps, k: int) -> dict[tuple[int, int], dict[int, list]]:
    """As :func:`_best_single`, for all wide columns of all nodes at once, in range pieces."""
    good = [F.col(f"g{c}") for c in range(k)]
    cells = sums.withColumnRenamed("n", "rows").withColumns({"n": F.col("nexp"), "w": sum(good[1:], good[0])} | {f"s_0_{c}": g for c, g in enumerate(good)}).persist()
    plan = wide.Plan(["tree", "node", "r"], Loss(router, 1), [k])
    out: dict[tuple[int, int], dict[int, list]] = {}
    rewards = [f"q{c}" for c in range(k)]
    try:
        bins = wide.numeric_bins(cells.select(*plan.keys, "x", *plan.names), plan, *caps)
        asked = plan.listed(sums.sparkSession, [(*key, b.thresholds) for key, b in bins.items()], "cut array<double>") if bins else None
        totals: dict[tuple, dict[int, Any]] = {}
        if asked is not None:
            at = F.when(F.col("x").isNull(), F.size("cut") + 1).otherwise(F.size(F.filter("cut", lambda t: t < F.col("x"))))
            for r in cells.join(asked, plan.keys).withColumn("bin", at).groupBy(*plan.keys, "bin").agg(F.sum("mass").alias("mass"), *[F.sum(q).alias(q) for q in rewards]).collect():
                totals.setdefault(plan.key(r), {})[r["bin"]] = r
        for key, b in bins.items():
            rows = [totals.get(key, {}).get(i) for i in range(len(b.thresholds) + 2)]
            by_bin = np.array([[r[q] if r else 0.0 for q in rewards[: arity[key[:2]]]] for r in rows])
            mass = np.array([r["mass"] if r else 0.0 for r in rows])
            labels = np.where(mass > 0, by_bin.argmax(1), dummies[key[:2]])
            reward = float(by_bin[np.arange(len(labels)), labels].sum())
            out.setdefault(key[:2], {}).setdefault(key[2], []).append({"how": "tree", "reward": reward, "thresholds": [float(t) for t in b.thresholds], "labels": labels.tolist()})
        two = [key for key in bins if arity[key[:2]] == 2]
        if two:
            own = cells.join(plan.listed(sums.sparkSession, [(*key, 0) for key in two], "one int").drop("one"), plan.keys).drop("n").withColumnRenamed("rows", "n")
            lost = {plan.key(r): r for r in own.where("x is null").groupBy(*plan.keys).agg(F.sum("mass").alias("mass"), F.sum("q0").alias("q0"), F.sum("q1").alias("q1")).collect()}
            for r in best_reward_cuts(own.select(*plan.keys, "x", "n", "q0", "q1"), plan.keys, ("q0", "q1"), caps[0], plan.pieces).collect():
                key = plan.key(r)
                gone = lost.get(key)
                q = [gone["q0"], gone["q1"]] if gone else [0.0, 0.0]
                nan_child = int(np.argmax(q)) if gone and gone["mass"] > 0 else dummies[key[:2]]
                side = r["left_child"]
                out[key[:2]][key[2]].append({"how": "cut", "reward": r["reward"] + q[nan_child], "thresholds": [r["threshold"]], "labels": [side, 1 - side, nan_child]})
    finally:
        cells.unpersist()
    return out


def _refine_pairs(table, care, keep, at, heads, arity, dummies, router, caps, k, most):
    listed = [(t, i, a, b) for (t, i) in heads for a, b in at[t, i]["retained_pairs"]]
    if not listed:
        return {}
    values = F.array(*table.values)
    features = table.features

    def joint(some) -> DataFrame:
        wanted = F.broadcast(table.rows.sparkSession.createDataFrame(some, "tree int, node int, fa int, fb int"))  # a row for each pair
        return care.join(wanted, ["tree", "node"]).select(*keep, "fa", "fb", *[F.element_at(values, F.col(f"f{s}") + 1).alias(f"x{s}") for s in "ab"])

    def fit(key: tuple[Any, ...], frame: pd.DataFrame) -> pd.DataFrame:
        t, i, a, b = (int(v) for v in key)
        frame = frame.sort_values(["xa", "xb"], kind="stable")
        c = arity[t, i]
        x = frame[["xa", "xb"]].to_numpy(float)
        g, q = frame[[f"g{j}" for j in range(c)]].to_numpy(float), frame[[f"q{j}" for j in range(c)]].to_numpy(float)
        sums = Sums(frame["nexp"].to_numpy(np.int64), g.sum(1), g[:, None, :])
        bins = pairs.pair_bins(x, (features[a].kind, features[b].kind), sums, Loss(router, 1), *caps)
        where = pairs.route_pair(bins.tree, x)
        by_bin = np.array([q[where == j].sum(0) for j in range(len(bins.sums))])
        mass = np.bincount(where, frame["mass"].to_numpy(float), len(by_bin))
        labels = np.where(mass > 0, by_bin.argmax(1), dummies[t, i])
        got = {"reward": float(by_bin[np.arange(len(labels)), labels].sum()), "labels": labels.tolist(), "tree": bins.tree}
        return pd.DataFrame({"tree": [t], "node": [i], "fa": [a], "fb": [b], "payload": [pickle.dumps(got)]})

    out: dict[tuple[int, int], dict] = {}
    large = [key for key in listed if heads[key[:2]]["n_node"] > most]
    small = [key for key in listed if key not in set(large)]
    if large:
        mw = F.col("mult") * F.col("w")
        good = [F.when(F.col("good")[c], mw * F.col("share")).otherwise(F.lit(0.0)) for c in range(k)]
        names = ["tree", "node", "fa", "fb", "xa", "xb"]
        rows = joint(large).select(
            *names, (F.col("mult") * F.size(F.filter("good", lambda g: g))).cast("bigint").alias("n"), sum(good[1:], good[0]).alias("w"), *[g.alias(f"s_0_{c}") for c, g in enumerate(good)],
            mw.alias("mass"), *[(mw * F.coalesce(F.col("rewards")[c], F.lit(0.0))).alias(f"q{c}") for c in range(k)],
        )
        plan = wide.Plan(names[:4], Loss(router, 1), [k])
        kinds = {key: tuple("continuous" if features[f].numeric else features[f].kind for f in key[2:]) for key in large}
        bins, more = wide.pair_bins(rows, plan, kinds, *caps, more=("mass", *(f"q{c}" for c in range(k))))
        for (t, i, a, b), own in bins.items():
            by_bin = np.stack([more[t, i, a, b][f"q{c}"] for c in range(arity[t, i])], 1)
            labels = np.where(more[t, i, a, b]["mass"] > 0, by_bin.argmax(1), dummies[t, i])
            out.setdefault((t, i), {})[a, b] = {"reward": float(by_bin[np.arange(len(labels)), labels].sum()), "labels": labels.tolist(), "tree": own.tree}
    if not small:
        return out
    for r in _care_sums(joint(small), ["tree", "node", "fa", "fb", "xa", "xb"], k).groupBy("tree", "node", "fa", "fb").applyInPandas(fit, "tree int, node int, fa int, fb int, payload binary").collect():
        out.setdefault((r["tree"], r["node"]), {})[r["fa"], r["fb"]] = pickle.loads(r["payload"])
    return out


def refresh(table: Table, trees: dict[int, Tree], loss: Loss) -> None:
    """Statistics of all leaves, and of the nodes above them, from the routed rows.

    A leaf that no row reaches any more keeps its value and has no mass.
    """
    leaf = None
    for t, tree in trees.items():
        here = walk_column(tree.nodes, table.values, lambda n: F.lit(n["node_id"]))
        leaf = F.when(F.col("tree") == t, here) if leaf is None else leaf.when(F.col("tree") == t, here)
    found = node_stats(table.rows.withColumn("leaf", leaf), ["tree", "leaf"], table, loss)
    for t, tree in trees.items():
        for n in (n for n in tree.nodes if n["is_leaf"]):
            rows, mass, s, impurity, median = found.get((t, n["node_id"]), (0, 0.0, None, 0.0, []))
            n |= {"n": int(rows), "mass": float(mass), "impurity": float(impurity)}
            if table.classes is not None:
                n["class_counts"] = [s[o, :c].tolist() if s is not None else [0.0] * c for o, c in enumerate(table.classes)]
            if mass > 0:
                n["value"] = leaf_value(float(mass), s.tolist(), table.classes, table.outputs, median)
        for n in sorted((n for n in tree.nodes if not n["is_leaf"]), key=lambda n: -n["depth"]):
            kids = [tree.nodes[c] for c in n["children"]]
            n |= {"n": sum(c["n"] for c in kids), "mass": sum(c["mass"] for c in kids)}
            if table.classes is not None:
                n["class_counts"] = [np.sum([c["class_counts"][o] for c in kids], 0).tolist() for o in range(table.outputs)]
