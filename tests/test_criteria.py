from itertools import product

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from arborspan.functions import criteria as C
from arborspan.operators import assignment, inner
from arborspan.operators.inner import Loss, Sums


def test_columns_equal_numpy(spark):
    rows = [(3.0, 1.0, 0.0), (2.0, 2.0, 2.0), (0.0, 0.0, 0.0), (5.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    cols = [F.col(c) for c in "abc"]
    got = df.select(C.gini_column(cols).alias("g"), C.entropy_column(cols).alias("e")).collect()
    s = np.array(rows)[:, None, :]
    w = np.array(rows).sum(1)
    for r, g, e, m in zip(got, C.gini(s, w), C.entropy(s, w), w):
        if m:
            assert r["g"] == pytest.approx(g) and r["e"] == pytest.approx(e)
        else:
            assert r["g"] is None and r["e"] is None
    mse = spark.createDataFrame([(2.0, 3.0, 5.0)], "w double, y double, yy double").select(C.squared_error_column(F.col("w"), F.col("y"), F.col("yy"))).first()[0]
    assert mse == pytest.approx(0.25) == C.squared_error(np.array([[[3.0, 5.0]]]), np.array([2.0]))[0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(-5, 5), st.integers(0, 3)), min_size=1, max_size=30))
def test_running_absolute_equals_direct(rows):
    y, w = np.array([float(a) for a, _ in rows]), np.array([float(b) for _, b in rows])
    run = C.running_absolute(y, w)
    for k in range(1, len(y) + 1):
        direct = C.absolute_error(y[:k, None], w[:k]) * w[:k].sum()
        assert run[k - 1] == pytest.approx(direct, abs=1e-9)


def test_weighted_median_rule(spark):
    assert C.median_of(np.array([1.0, 2.0]), np.array([1.0, 1.0])) == 1.5
    assert C.median_of(np.array([1.0, 2.0, 9.0]), np.array([1.0, 1.0, 3.0])) == 9.0
    df = spark.createDataFrame([("a", 1.0, 1.0), ("a", 2.0, 1.0), ("b", 1.0, 1.0), ("b", 2.0, 1.0), ("b", 9.0, 3.0)], "g string, y double, w double")
    got = {r["g"]: r for r in C.weighted_median(df, ["g"], "y", "w").collect()}
    assert got["a"]["median"] == 1.5 and got["b"]["median"] == 9.0 and got["a"]["mae"] == pytest.approx(0.5)


def sums(x, y, w=None):
    x, y = np.array(x, float), np.array(y)
    w = np.ones(len(x)) if w is None else np.array(w, float)
    keys, at = np.unique(x[~np.isnan(x)], return_inverse=True)
    def make(mask, cells, n):
        s = np.zeros((n, 1, int(y.max()) + 1))
        np.add.at(s, (cells, 0, y[mask]), w[mask])
        return Sums(np.bincount(cells, minlength=n), np.bincount(cells, w[mask], n), s)
    gone = np.isnan(x)
    return keys, make(~gone, at, len(keys)), make(gone, np.zeros(gone.sum(), int), 1)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.integers(0, 6), st.none()), st.integers(0, 2), st.integers(0, 3)), min_size=2, max_size=25), st.integers(1, 3))
def test_stump_equals_brute_force(rows, min_leaf):
    x = [float("nan") if a is None else float(a) for a, _, _ in rows]
    y, w = [b for _, b, _ in rows], [float(c) for _, _, c in rows]
    if all(a is None for a, _, _ in rows):
        return
    keys, own, gone = sums(x, y, w)
    loss = Loss("gini", 1)
    best = inner.fast_numeric_stump(keys, own, gone, loss, min_leaf)
    slow = inner.numeric_stump(keys, own, gone, loss, min_leaf)
    value = lambda b: min(
        (assignment.Partition(b.sums, loss, b.root_labels(side), 2).score()[0] for side in (0, 1) if b.root_labels(side) and (np.array([assignment.Partition(b.sums, loss, b.root_labels(side), 2).score()[1]]) >= min_leaf).all()),
        default=None,
    )
    a, b = value(best), value(slow)
    assert (a is None) == (b is None)
    if a is not None:
        assert a == pytest.approx(b, abs=1e-9)
    xs, ys, ws = np.array(x), np.array(y), np.array(w)
    brute = []
    for cut in [*keys[:-1], np.inf]:
        for side in (0, 1):
            left = np.where(np.isnan(xs), side == 0, xs <= cut)
            if min(left.sum(), (~left).sum()) < min_leaf:
                continue
            total = 0.0
            for part in (left, ~left):
                m = ws[part].sum()
                total += m - sum(ws[part & (ys == k)].sum() ** 2 for k in range(3)) / m if m else 0.0
            brute.append(total / ws.sum() if ws.sum() else 0.0)
    if brute:
        assert a == pytest.approx(min(brute), abs=1e-9)


def test_search_never_beats_its_parent_bound_and_observes_root():
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 30, 200), rng.integers(0, 3, 200)
    keys, own, gone = sums(x, y)
    loss = Loss("gini", 1)
    bins = inner.numeric_bins(keys, own, gone, loss, 1, 0.0, None, 8)
    whole = loss.whole(own)
    found = assignment.search(bins, loss, whole, 4, 1, 10)
    root = assignment.Partition(bins.sums, loss, bins.root_labels(0), 2).score()[0]
    best = {}
    for (arity, _), c in found.items():
        best[arity] = min(best.get(arity, 9), c.impurity)
    assert best[2] <= root + 1e-12 and best[3] <= best[2] + 1e-9 and all(c.gain > 0 for c in found.values())


def test_inner_tree_respects_limits():
    keys, own, gone = sums(range(20), [0] * 10 + [1] * 10)
    bins = inner.numeric_bins(keys, own, gone, Loss("gini", 1), 1, 0.0, None, None)
    assert bins.thresholds == [9.5] and bins.sums.n.tolist() == [10, 10, 0]
    assert inner.numeric_bins(keys, own, gone, Loss("gini", 1), 11, 0.0, None, None).thresholds == []
    assert inner.numeric_bins(np.zeros(0), own.take([]), gone, Loss("gini", 1), 1, 0.0, None, None) is None


def assignments(b, k):
    """Every assignment of ``b`` bins to ``k`` children."""
    return product(range(k), repeat=b)


@pytest.mark.parametrize("criterion", ["gini", "entropy", "squared_error", "absolute_error"])
def test_tables_of_moves_equal_plain_scores(criterion):
    rng = np.random.default_rng(3)
    for trial in range(12):
        bins = random_bins(rng, criterion, 6)
        loss = Loss(criterion, 1)
        k = 2 + trial % 2
        labels = rng.integers(0, k, 6)
        if trial % 3 == 0:
            labels[-1] = k
        part = assignment.Partition(bins, loss, labels, k)
        got, n = part.moves()
        for j in range(6):
            for p in range(k):
                trial_labels = labels.copy()
                trial_labels[j] = p
                plain = assignment.Partition(bins, loss, trial_labels, k)
                value, rows = plain.score()
                assert got[j, p] == pytest.approx(value * bins.w[trial_labels < k].sum(), abs=1e-9) and (n[j, p] == rows).all()
        if trial % 3 == 0:
            both, rows = part.moves(5)
            for j in range(5):
                for p in range(k):
                    for m in range(k):
                        trial_labels = labels.copy()
                        trial_labels[j], trial_labels[5] = p, m
                        value, count = assignment.Partition(bins, loss, trial_labels, k).score()
                        assert both[j, p, m] == pytest.approx(value * bins.w.sum(), abs=1e-9) and (rows[j, p, m] == count).all()


def random_bins(rng, criterion, b):
    y, w = rng.integers(0, 3, (b, 7)).astype(float), rng.integers(0, 3, (b, 7)).astype(float)
    mass = w.sum(1)
    if criterion in ("gini", "entropy"):
        s = np.stack([(w * (y == c)).sum(1) for c in range(3)], 1)[:, None, :]
    else:
        s = np.stack([(w * y).sum(1), (w * y * y).sum(1)], 1)[:, None, :]
    return inner.Sums(np.full(b, 7), mass, s, [v[:, None] for v in y], list(w)) if criterion == "absolute_error" else inner.Sums(np.full(b, 7), mass, s)


@pytest.mark.parametrize("criterion", ["gini", "squared_error"])
def test_search_is_near_the_best_of_all_assignments(criterion):
    rng = np.random.default_rng(5)
    loss, near = Loss(criterion, 1), 0
    for _ in range(20):
        sums_ = random_bins(rng, criterion, 7)
        bins = inner.Bins("numeric", sums_, [float(i) for i in range(5)], root=[0, 0, 1, 1, 1, 1])
        whole = loss.whole(sums_)
        found = assignment.search(bins, loss, whole, 3, 1, 10)
        for k in (2, 3):
            best = min(assignment.Partition(sums_, loss, a, k).score()[0] for a in assignments(7, k) if len(set(a)) == k)
            got = min((c.impurity for (arity, _), c in found.items() if arity == k), default=np.inf)
            assert got >= best - 1e-9
            near += got <= best + 0.02 * whole
    assert near >= 36


def test_equal_cuts_go_to_the_first_at_any_scale():
    values = np.array([1.0, 0.1, 0.7, 0.3, 0.7, 0.1, 1.0])
    for scale in (1e-9, 1.0, 1e9):
        keys, own, _ = sums(range(7), [0] * 7)
        y = values * scale
        own = inner.Sums(own.n, own.w, np.stack([y, y * y], 1)[:, None, :])
        assert inner.best_cut(keys, own, Loss("squared_error", 1), 0, 7, 1)[1] == 1


def absolute_sums(x, y, w):
    """Sums of rows ``y[row, output]`` by value of ``x``, and those of missing rows."""
    def make(groups):
        n = np.array([len(g) for g in groups])
        return Sums(n, np.array([w[g].sum() for g in groups]), np.zeros((len(groups), y.shape[1], 2)), [y[g] for g in groups], [w[g] for g in groups])
    keys = np.unique(x[~np.isnan(x)])
    return keys, make([np.flatnonzero(x == k) for k in keys]), make([np.flatnonzero(np.isnan(x))])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.integers(0, 6), st.none()), st.integers(-4, 4), st.integers(-4, 4), st.integers(0, 3)), min_size=2, max_size=25), st.integers(1, 3))
def test_absolute_stump_equals_brute_force(rows, min_leaf):
    x = np.array([np.nan if a is None else float(a) for a, *_ in rows])
    y, w = np.array([[float(b), float(c)] for _, b, c, _ in rows]), np.array([float(d) for *_, d in rows])
    if np.isnan(x).all():
        return
    keys, own, gone = absolute_sums(x, y, w)
    loss = Loss("absolute_error", 2)
    fast, slow = inner.fast_numeric_stump(keys, own, gone, loss, min_leaf), inner.numeric_stump(keys, own, gone, loss, min_leaf)
    assert (fast.kind, fast.thresholds, fast.root) == (slow.kind, slow.thresholds, slow.root)
    assert fast.sums.n.tolist() == slow.sums.n.tolist()


def test_absolute_stump_of_many_values_is_scored_at_once(monkeypatch):
    """Medians that are found anew for each cut take a time that grows with the square of the rows."""
    n, asked = 3000, []
    keys, own, gone = absolute_sums(np.append(np.arange(float(n)), np.nan), np.append(np.arange(n) % 100 + (np.arange(n) >= 2100) * 500.0, 7.0)[:, None], np.ones(n + 1))
    plain = C.median_of
    monkeypatch.setattr(C, "median_of", lambda y, w: asked.append(len(y)) or plain(y, w))
    assert inner.fast_numeric_stump(keys, own, gone, Loss("absolute_error", 1), 1).thresholds == [2099.5]
    assert len(asked) < 10


def test_running_absolute_of_real_weights_and_chosen_ends():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 9, 300):
        y, w = rng.normal(size=n), rng.random(n) * 10.0 ** rng.integers(-3, 9, n)
        direct = [C.absolute_error(y[:k, None], w[:k]) * w[:k].sum() for k in range(n + 1)]
        assert C.running_absolute(y, w) == pytest.approx(direct[1:], rel=1e-12)
        assert C.running_absolute(y, w, np.array([n, 0, n // 2])) == pytest.approx([direct[n], 0, direct[n // 2]], rel=1e-12)
