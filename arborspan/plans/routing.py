"""Trees as Spark expressions: routing, scoring and SQL predicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.features import Feature, value_column


def merged_intervals(thresholds: list[float], labels: list[int]) -> list[tuple[float | None, float | None, int]]:
    """(low, high, child) of the finite bins; neighbours of one child are one interval."""
    bounds = [None, *thresholds, None]
    out: list[tuple] = []
    for i in range(len(bounds) - 1):
        child = labels[i]
        if out and out[-1][2] == child:
            out[-1] = (out[-1][0], bounds[i + 1], child)
        else:
            out.append((bounds[i], bounds[i + 1], child))
    return out


def bin_column(x: Column, thresholds: list[float]) -> Column:
    """Numeric bin: how many thresholds are below the value; missing is the last bin."""
    inside = F.size(F.filter(F.array(*[F.lit(float(t)) for t in thresholds]), lambda t: t < x)) if thresholds else F.lit(0)
    return F.when(x.isNull(), F.lit(len(thresholds) + 1)).otherwise(inside)


def category_bin_column(x: Column, categories: list[list[int]]) -> Column:
    """Bin of a category position; missing is the last bin."""
    out = F.when(x.isNull(), F.lit(len(categories)))
    for b, codes in enumerate(categories):
        if codes:
            out = out.when(x.isin([float(c) for c in codes]), F.lit(b))
    return out.otherwise(F.lit(max(len(categories) - 1, 0)))


def pair_bin_column(tree: list[dict], axes: tuple[Column, Column], at: int = 0) -> Column:
    """Bin of a pair tree as nested conditions."""
    node = tree[at]
    if node["axis"] < 0:
        return F.lit(node["bin"])
    x = axes[node["axis"]]
    left = x <= F.lit(float(node["threshold"])) if node["kind"] == "continuous" else x != F.lit(float(node["threshold"]))
    sides = {k: pair_bin_column(tree, axes, node[k]) for k in ("missing", "left", "right")}
    return F.when(x.isNull(), sides["missing"]).when(left, sides["left"]).otherwise(sides["right"])


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions) if conditions else F.lit(False)


def child_conditions(node: dict, values: list[Column]) -> list[Column]:
    """For each child of a split node, whether a row goes there (never null)."""
    k = len(node["children"])
    labels = node["bin_to_partition"]
    if node["kind"] == "constant":
        return [F.lit(p == labels[0]) for p in range(k)]
    x = values[node["logical"][0]]
    parts: list[list[Column]] = [[] for _ in range(k)]
    if node["kind"] == "pair":
        bins = pair_bin_column(node["pair_tree"], tuple(values[f] for f in node["logical"]))
        for p in range(k):
            parts[p] = [bins.isin([b for b, q in enumerate(labels) if q == p])]
        return [any_of(p) for p in parts]
    parts[labels[-1]].append(x.isNull())
    if node["kind"] == "categorical":
        seen = set()
        last = labels[len(node["categories"]) - 1]
        for b, codes in enumerate(node["categories"]):
            if codes:
                parts[labels[b]].append(x.isNotNull() & x.isin([float(c) for c in codes]))
                seen |= set(codes)
        if seen:
            parts[last].append(x.isNotNull() & ~x.isin([float(c) for c in sorted(seen)]))
    else:
        for low, high, child in merged_intervals(node["thresholds"], labels):
            cond = x.isNotNull()
            if low is not None:
                cond = cond & (x > F.lit(float(low)))
            if high is not None:
                cond = cond & (x <= F.lit(float(high)))
            parts[child].append(cond)
    return [any_of(p) for p in parts]


def child_column(node: dict, values: list[Column]) -> Column:
    """Partition of a row at one split node."""
    conditions = child_conditions(node, values)
    out = None
    for p, cond in enumerate(conditions[:-1]):
        out = F.when(cond, F.lit(p)) if out is None else out.when(cond, F.lit(p))
    last = F.lit(len(conditions) - 1)
    return out.otherwise(last) if out is not None else last


def walk_column(nodes: list[dict], values: list[Column], result, at: int = 0) -> Column:
    """``result(leaf node)`` of the leaf that a row reaches from node ``at``.

    The whole tree is one nested condition in which each leaf appears once.
    """
    node = nodes[at]
    if node["is_leaf"]:
        return result(node)
    children = [walk_column(nodes, values, result, c) for c in node["children"]]
    if len(children) == 1:
        return children[0]
    out = None
    for cond, child in zip(child_conditions(node, values)[:-1], children[:-1]):
        out = F.when(cond, child) if out is None else out.when(cond, child)
    return out.otherwise(children[-1])


def path_column(nodes: list[dict], values: list[Column], at: int = 0) -> Column:
    """Array of the ids of all nodes that a row passes."""
    parents = {c: n["node_id"] for n in nodes for c in n["children"]}

    def path(leaf: dict) -> Column:
        ids, k = [leaf["node_id"]], leaf["node_id"]
        while k != at:
            k = parents[k]
            ids.append(k)
        return F.array(*[F.lit(i) for i in reversed(ids)])

    return walk_column(nodes, values, path, at)


def feature_columns(features: list[Feature]) -> list[Column]:
    return [value_column(f) for f in features]


# ------------------------------------------------------------------ SQL text


def sql_number(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


def sql_condition(node: dict, partition: int, features: list[Feature], quote: str = '"') -> str:
    """A split's child as a predicate in standard SQL over the source columns.

    A numeric column is compared in single precision; null is missing.
    """
    q = lambda c: f"{quote}{c}{quote}"
    f = features[node["logical"][0]]
    labels, parts = node["bin_to_partition"], []
    if node["kind"] == "pair":
        raise ValueError("a pair split has no flat predicate")
    if node["kind"] == "categorical" and f.kind == "label":
        known = [c for codes in node["categories"] for c in codes]
        last = labels[len(node["categories"]) - 1]
        text = lambda i: "'" + f.categories[i].replace("'", "''") + "'"
        missing = f"({q(f.columns[0])} IS NULL OR {q(f.columns[0])} NOT IN ({', '.join(text(i) for i in range(len(f.categories)))}))"
        if labels[-1] == partition:
            parts.append(missing)
        for b, codes in enumerate(node["categories"]):
            if labels[b] == partition and codes:
                parts.append(f"{q(f.columns[0])} IN ({', '.join(text(i) for i in codes)})")
        rest = [i for i in range(len(f.categories)) if i not in known]
        if rest and last == partition:
            parts.append(f"{q(f.columns[0])} IN ({', '.join(text(i) for i in rest)})")
        return " OR ".join(parts) if parts else "FALSE"
    if f.kind != "continuous":
        raise ValueError("a one-hot split has no flat predicate")
    x = f"CAST(CAST({q(f.columns[0])} AS FLOAT) AS DOUBLE)"
    if labels[-1] == partition:
        parts.append(f"({q(f.columns[0])} IS NULL OR isnan(CAST({q(f.columns[0])} AS DOUBLE)))")
    for low, high, child in merged_intervals(node["thresholds"], labels):
        if child == partition:
            both = [f"{x} > {sql_number(low)}"] if low is not None else []
            both += [f"{x} <= {sql_number(high)}"] if high is not None else []
            both = both or [f"{q(f.columns[0])} IS NOT NULL"]
            parts.append("(" + " AND ".join([*both, f"NOT isnan(CAST({q(f.columns[0])} AS DOUBLE))"]) + ")")
    return " OR ".join(parts) if parts else "FALSE"


def leaf_predicates(nodes: list[dict], features: list[Feature], quote: str = '"') -> dict[int, str]:
    """Each leaf as a conjunction of its path's predicates."""
    out = {}

    def down(at, held):
        node = nodes[at]
        if node["is_leaf"]:
            out[at] = " AND ".join(f"({h})" for h in held) or "TRUE"
            return
        for p, child in enumerate(node["children"]):
            down(child, [*held, sql_condition(node, p, features, quote)])

    down(0, [])
    return out
