"""Inner trees of features, and of pairs, with more values than one task should hold.

The trees are those of :mod:`inner` and :mod:`pairs`: the same generators ask for
the best split of an interval or a box. Here the answers come from window plans
whose running sums are cut into range pieces, for all that is asked in a round at
once; what reaches the driver is a row for each open interval or box and, at the
end, one for each bin.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import criteria as C
from ..plans import cuts
from ..plans.routing import pair_bin_column
from . import inner, pairs
from .inner import Bins, Loss, Sums

#: Range pieces that a group's running sums are cut into.
PIECES = 64
Key = tuple


class Plan:
    """Columns of summed rows ``(keys.., x.., n, w, s_<output>_<stat>)`` and how they are judged."""

    def __init__(self, keys: list[str], loss: Loss, stats: list[int]):
        self.keys, self.loss, self.pieces = keys, loss, PIECES
        self.outputs = [[f"s_{o}_{k}" for k in range(n)] for o, n in enumerate(stats)]
        self.names = ["n", "w", *(c for o in self.outputs for c in o)]
        self.width = max(stats)

    def total(self, df: DataFrame, group: list[str], more: tuple[str, ...] = ()) -> DataFrame:
        return df.groupBy(*group).agg(*[F.sum(c).alias(c) for c in (*self.names, *more)])

    def sums(self, rows: list) -> Sums:
        """Collected totals as one entry each."""
        s = np.zeros((len(rows), len(self.outputs), self.width))
        for o, names in enumerate(self.outputs):
            for k, name in enumerate(names):
                s[:, o, k] = [r[name] for r in rows]
        return Sums(np.array([r["n"] for r in rows], np.int64), np.array([r["w"] for r in rows], float), s)

    def losses(self, rows: list) -> np.ndarray:
        """Impurity of each collected total, summed over outputs."""
        return self.loss.of(self.sums(rows)) if rows else np.zeros(0)

    def key(self, row) -> Key:
        return tuple(row[k] for k in self.keys)

    def listed(self, spark, rows: list[tuple], extra: str) -> DataFrame:
        """A small table by key: broadcast, since it has a row for each open interval, box or inner tree."""
        kinds = ", ".join(f"{k} int" for k in self.keys)
        return F.broadcast(spark.createDataFrame(rows, f"{kinds}, {extra}"))


def _run_all(generators: dict[Key, object], answer) -> dict[Key, object]:
    """Drive generators together: each round all requests are answered at once."""
    done, asked = {}, {}
    for key, g in generators.items():
        try:
            asked[key] = next(g)
        except StopIteration as e:
            done[key] = e.value
    while asked:
        answers, again = answer(asked), {}
        for key in asked:
            try:
                again[key] = generators[key].send(answers[key])
            except StopIteration as e:
                done[key] = e.value
        asked = again
    return done


def numeric_bins(cells: DataFrame, plan: Plan, min_leaf: int, min_gain: float, max_depth: int | None, max_leaves: int | None) -> dict[Key, Bins]:
    """Bins of each key's feature from ``cells (keys.., x, n, w, s..)``; a null
    ``x`` is missing. Keys without a finite value have none."""
    spark, known = cells.sparkSession, cells.where("x is not null")
    first: dict[Key, float] = {}

    def look(requests: list[tuple]) -> dict[tuple, tuple]:
        """Of intervals ``(key, lo, hi)``: impurity, weight, and the best cut's (loss, threshold) or None."""
        asked = plan.listed(spark, [(*key, i, lo, hi) for i, (key, lo, hi) in enumerate(requests)], "part int, lo double, hi double")
        inside = known.join(asked, plan.keys).where("x > lo and x <= hi").drop("lo", "hi")
        group = [*plan.keys, "part"]
        whole = plan.total(inside, group).collect()
        best = {r["part"]: (r["loss"], r["threshold"]) for r in cuts.best_cuts(inside, group, plan.loss.criterion, plan.outputs, min_leaf, plan.pieces).collect()}
        return {requests[r["part"]]: (float(v), r["w"], best.get(r["part"])) for r, v in zip(whole, plan.losses(whole))}

    mass: dict[Key, float] = {}

    def node(key, lo, hi, found, depth):
        if (key, lo, hi) not in found or found[key, lo, hi][2] is None:
            return None
        impurity, w, (value, threshold) = found[key, lo, hi]
        gain = (w * impurity - value) / mass[key] if mass[key] > 0 else 0.0
        return gain, impurity, depth, (lo, hi, threshold)

    whole = [(plan.key(r), -np.inf, np.inf) for r in known.select(*plan.keys).distinct().collect()]
    found = look(whole) if whole else {}
    for request, (_, w, _) in found.items():
        mass[request[0]] = w
    grown = {key: inner.growing((node(key, lo, hi, found, 0), (lo, hi, None)), max_leaves, max_depth, min_gain) for key, lo, hi in whole}

    def answer(asked):
        parts = {key: [(key, lo, t), (key, t, hi)] for key, ((lo, hi, t), _) in asked.items()}
        for key, ((_, _, t), _) in asked.items():
            first.setdefault(key, t)
        found = look([p for two in parts.values() for p in two])
        return {key: [(node(*p, found, asked[key][1]), (p[1], p[2], None)) for p in two] for key, two in parts.items()}

    leaves = _run_all(grown, answer)
    thresholds = {key: sorted(hi for _, hi, _ in own)[:-1] for key, own in leaves.items()}
    return _with_sums(cells, plan, thresholds, first)


def _with_sums(cells: DataFrame, plan: Plan, thresholds: dict[Key, list[float]], first: dict[Key, float]) -> dict[Key, Bins]:
    """Numeric bins between ``thresholds``, the missing one last, with their sums."""
    if not thresholds:
        return {}
    asked = plan.listed(cells.sparkSession, [(*key, [float(t) for t in own]) for key, own in thresholds.items()], "cut array<double>")
    at = F.when(F.col("x").isNull(), F.size("cut") + 1).otherwise(F.size(F.filter("cut", lambda t: t < F.col("x"))))
    got: dict[Key, dict[int, object]] = {}
    for r in plan.total(cells.join(asked, plan.keys).withColumn("bin", at), [*plan.keys, "bin"]).collect():
        got.setdefault(plan.key(r), {})[r["bin"]] = r
    out = {}
    empty = dict.fromkeys(plan.names, 0)
    for key, own in thresholds.items():
        rows = [got.get(key, {}).get(b, empty) for b in range(len(own) + 2)]
        root = [int(b > 0 and own[b - 1] >= first[key]) for b in range(len(own) + 1)] if key in first else []
        out[key] = Bins("numeric", plan.sums(rows), [float(t) for t in own], root=root)
    return out


def numeric_stumps(cells: DataFrame, plan: Plan, keys: list[Key], min_leaf: int) -> dict[Key, Bins]:
    """As :func:`inner.fast_numeric_stump`, for some keys of ``cells``."""
    if not keys:
        return {}
    own = cells.join(plan.listed(cells.sparkSession, [(*k, 0) for k in keys], "one int").drop("one"), plan.keys)
    best = {plan.key(r): r["threshold"] for r in cuts.best_stumps(own, plan.keys, plan.loss.criterion, plan.outputs, max(min_leaf, 1), plan.pieces).collect()}
    cut = {k: [best[k]] if best.get(k) is not None else [] for k in keys}
    out = _with_sums(own, plan, cut, {k: t[0] for k, t in cut.items() if t})
    for key, bins in out.items():
        if not bins.thresholds:
            bins.kind, bins.root = "stump", [0]
    return out


def pair_bins(rows: DataFrame, plan: Plan, kinds: dict[Key, tuple[str, str]], min_leaf: int, min_gain: float, max_depth: int | None, max_leaves: int | None, more: tuple[str, ...] = ()):
    """Bins of each key's pair from ``rows (keys.., xa, xb, n, w, s..)``, and each
    key's totals of the columns ``more`` by bin."""
    spark = rows.sparkSession
    trees: dict[Key, list[dict]] = {key: [{"axis": -1, "bin": 0}] for key in kinds}
    mass: dict[Key, float] = {}

    def routed(only: list[Key]) -> DataFrame:
        leaf = None
        for key in only:
            mine = reduce(lambda a, b: a & b, [F.col(k) == v for k, v in zip(plan.keys, key)])
            at = pair_bin_column(trees[key], (F.col("xa"), F.col("xb")))
            leaf = F.when(mine, at) if leaf is None else leaf.when(mine, at)
        return rows.withColumn("leaf", leaf.cast("int")).where("leaf is not null")

    def answer(asked):
        for key, leaves in asked.items():
            trees[key] = pairs.as_tree(leaves.nodes, leaf=lambda k: k)
        wanted = [(*key, leaf) for key, leaves in asked.items() for leaf in leaves.open]
        found: dict[Key, dict[int, tuple]] = {key: {} for key in asked}
        if not wanted:
            return found
        inside = routed([key for key, leaves in asked.items() if leaves.open]).join(plan.listed(spark, wanted, "leaf int"), [*plan.keys, "leaf"])
        axis = F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(x).alias("x")) for a, x in enumerate(("xa", "xb"))]))
        group = [*plan.keys, "leaf", "axis"]
        cells = plan.total(inside.withColumn("at", axis).select(*plan.keys, "leaf", "at.axis", "at.x", *plan.names), [*group, "x"]).persist()
        try:
            numeric = [(*key, a) for key in asked for a in (0, 1) if kinds[key][a] == "continuous"]
            flag = plan.listed(spark, numeric, "axis int").withColumn("numeric", F.lit(True)) if numeric else None
            whole = plan.total(cells.withColumn("gone", F.col("x").isNull()), [*group, "gone"]).collect()
            value: dict[tuple, dict[bool, tuple]] = {}
            for r, v in zip(whole, plan.losses(whole)):
                value.setdefault((plan.key(r), r["leaf"], r["axis"]), {})[r["gone"]] = r, r["w"] * float(v)
            options: dict[tuple, tuple] = {}
            if flag is not None:
                for r in cuts.best_cuts(cells.join(F.broadcast(flag), [*plan.keys, "axis"]).drop("numeric"), group, plan.loss.criterion, plan.outputs, min_leaf, plan.pieces).collect():
                    options[plan.key(r), r["leaf"], r["axis"]] = r["loss"], r["threshold"], r["n_left"], r["n_right"]
            if len(numeric) < 2 * len(asked):
                others = cells if flag is None else cells.join(F.broadcast(flag), [*plan.keys, "axis"], "left_anti")
                for r in cuts.best_categories(others.where("x is not null"), group, plan.loss.criterion, plan.outputs, min_leaf).collect():
                    options[plan.key(r), r["leaf"], r["axis"]] = r["loss"], int(r["category"]), r["n_out"], r["n_in"]
        finally:
            cells.unpersist()
        for key, leaves in asked.items():
            for leaf in leaves.open:
                best = None
                for a in (0, 1):
                    parts, option = value.get((key, leaf, a), {}), options.get((key, leaf, a))
                    if option is None:
                        continue
                    both = plan.losses([{c: sum(r[c] for r, _ in parts.values()) for c in plan.names}])[0]
                    w = sum(r["w"] for r, _ in parts.values())
                    mass.setdefault(key, w)  # the root is asked for first
                    lost = parts[True][1] if True in parts else 0.0
                    gain = (w * both - option[0] - lost) / mass[key] if mass[key] > 0 else 0.0
                    gone = parts[True][0]["n"] if True in parts else 0
                    if np.isfinite(gain) and gain > C.EPS and (best is None or gain > best[0] + C.EPS):
                        best = float(gain), a, option[1], int(option[2]), int(option[3]), int(gone)
                found[key][leaf] = best
        return found

    grown = _run_all({key: pairs.growing(kinds[key], min_gain, max_depth, max_leaves) for key in kinds}, answer)
    trees.update(grown)
    out, extra = {}, {}
    totals = plan.total(routed(list(grown)), [*plan.keys, "leaf"], more).collect() if grown else []
    for key, tree in grown.items():
        size = sum(n["axis"] < 0 for n in tree)
        own = {r["leaf"]: r for r in totals if plan.key(r) == key}
        at = [own.get(b, dict.fromkeys([*plan.names, *more], 0)) for b in range(size)]
        out[key] = Bins("pair", plan.sums(at), tree=tree, has_missing=False)
        extra[key] = {c: np.array([r[c] for r in at], float) for c in more}
    return out, extra
