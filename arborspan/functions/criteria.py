"""Split criteria, once as Spark columns and once in numpy.

A criterion's impurity of some rows follows from sums: for ``gini`` and
``entropy`` the weight of each class, for ``squared_error`` the sums of weight,
weighted target and weighted squared target. ``absolute_error`` needs the
targets themselves.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.prefix import range_bucket, running_totals

EPS = float(np.finfo(np.float64).eps)
#: Two medians are averaged when the weight below them is half of all within this.
HALF_TOLERANCE = 1e-12
#: Losses that differ by less than this share of the whole are equal: sums that were added in another order differ that much.
TIE_SHARE = 1e-11

#: The names that criteria go by.
CLASSIFICATION = {"gini": "gini", "entropy": "entropy", "log_loss": "entropy"}
REGRESSION = {
    "squared_error": "squared_error", "mse": "squared_error", "friedman_mse": "squared_error",
    "absolute_error": "absolute_error", "mae": "absolute_error",
}


def parse_criterion(name: str, classification: bool) -> str:
    names = CLASSIFICATION if classification else REGRESSION
    key = str(name).strip().lower()
    if key not in names:
        raise ValueError(f"unknown criterion {name!r}; expected one of {sorted(names)}")
    return names[key]


# ------------------------------------------------------------------- columns


def total(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def gini_column(weights: list[Column]) -> Column:
    """1 minus the sum of squared class shares; null without weight."""
    all_ = F.nullif(total(weights), F.lit(0.0))
    return F.lit(1.0) - total([(w / all_) * (w / all_) for w in weights])


def entropy_column(weights: list[Column]) -> Column:
    """Base-2 entropy of class shares; null without weight."""
    all_ = F.nullif(total(weights), F.lit(0.0))
    return F.when(all_.isNotNull(), -total([F.when(w > 0, (w / all_) * F.log2(w / all_)).otherwise(F.lit(0.0)) for w in weights]))


def squared_error_column(weight: Column, wy: Column, wyy: Column) -> Column:
    """Mean squared deviation from the weighted mean; null without weight."""
    w = F.nullif(weight, F.lit(0.0))
    mean = wy / w
    return (wyy - F.lit(2.0) * mean * wy + weight * mean * mean) / w


def gain_hessian_column(gradient: Column, hessian: Column, l2: Column) -> Column:
    """Newton gain of gradient and Hessian sums."""
    return gradient * gradient / F.nullif(hessian + l2, F.lit(0.0))


def class_columns(code: str, weight: Column, classes: int) -> list[Column]:
    """Sum of weight of each class, as aggregates."""
    return [F.sum(F.when(F.col(code) == k, weight).otherwise(F.lit(0.0))) for k in range(classes)]


def weighted_median(df: DataFrame, groups: list[str], y: str, w: str, pieces: int = 8) -> DataFrame:
    """Per group: ``median`` and ``mae`` around it. ``groups`` are few (nodes).

    The median is the first value at which cumulative weight exceeds half of all;
    where the weight before it is just half, it is averaged with the value before.
    Values are summed per distinct value first, and a group's running sums are
    cut into ``pieces`` ranges, so that no task sorts a whole group.
    """
    cells = df.where((F.col(w) > 0) & F.col(y).isNotNull()).groupBy(*groups, F.col(y).alias("y")).agg(F.sum(w).alias("w"))
    run = running_totals(range_bucket(cells, groups, "y", pieces), groups, "bucket", [F.col("y")], {"w": "cum"})
    half = cells.groupBy(*groups).agg((F.sum("w") / 2).alias("half"))
    above = F.col("cum") > F.col("half")
    found = run.join(F.broadcast(half), groups).groupBy(*groups).agg(
        F.min(F.when(above, F.col("y"))).alias("at"), F.max(F.when(~above, F.col("y"))).alias("below"), F.max(F.when(~above, F.col("cum"))).alias("left"), F.first("half").alias("half")
    )
    even = F.col("below").isNotNull() & (F.abs(F.col("left") - F.col("half")) <= HALF_TOLERANCE)
    medians = found.select(*groups, F.when(even, (F.col("below") + F.col("at")) / 2).otherwise(F.col("at")).alias("median"))
    spread = (F.sum(F.col("w") * F.abs(F.col("y") - F.col("median"))) / F.sum("w")).alias("mae")
    return cells.join(F.broadcast(medians), groups).groupBy(*groups).agg(F.first("median").alias("median"), spread)


# --------------------------------------------------------------------- numpy


def first_least(values: np.ndarray, whole: float) -> int:
    """Place of the first of the least values, of which some may differ by rounding only."""
    return int(np.argmax(values <= values.min() + TIE_SHARE * abs(whole)))


def safe_divide(a, b):
    return np.divide(a, b, out=np.zeros(np.broadcast(a, b).shape), where=np.asarray(b) > 0)


def gini(s: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Sum over outputs of Gini impurities. ``s[..., output, class]``, ``w[...]``."""
    share = safe_divide(s, np.asarray(w)[..., None, None])
    return np.where(np.asarray(w)[..., None] > 0, 1 - (share**2).sum(-1), 0.0).sum(-1)


def entropy(s: np.ndarray, w: np.ndarray) -> np.ndarray:
    share = safe_divide(s, np.asarray(w)[..., None, None])
    return -(share * np.log2(share, out=np.zeros_like(share), where=share > 0)).sum((-1, -2))


def squared_error(s: np.ndarray, w: np.ndarray) -> np.ndarray:
    """``s[..., output, 0]`` sums of w*y, ``s[..., output, 1]`` of w*y*y."""
    w = np.asarray(w)[..., None]
    mean = safe_divide(s[..., 0], w)
    return np.maximum(safe_divide(s[..., 1] - 2 * mean * s[..., 0] + w * mean**2, w), 0).sum(-1)


def gain_hessian(s: np.ndarray, w: np.ndarray, l2: float = 1.0) -> np.ndarray:
    """Negated mean Newton gain, so that smaller is better."""
    w = np.asarray(w)[..., None]
    return -safe_divide(safe_divide(s[..., 0] ** 2, s[..., 1] + l2), w).sum(-1)


def median_of(y: np.ndarray, w: np.ndarray) -> float:
    """Weighted median of a vector, by the same rule as :func:`weighted_median`."""
    keep = w > 0
    if not keep.any():
        return float(np.mean(y)) if len(y) else 0.0
    values, at = np.unique(y[keep], return_inverse=True)
    weight = np.bincount(at, w[keep])
    run, half = np.cumsum(weight), weight.sum() / 2
    k = min(int(np.searchsorted(run, half, side="right")), len(values) - 1)
    if k and abs(run[k - 1] - half) <= HALF_TOLERANCE:
        return float((values[k - 1] + values[k]) / 2)
    return float(values[k])


def absolute_error(y: np.ndarray, w: np.ndarray) -> float:
    """Sum over outputs of weighted mean absolute deviations. ``y[row, output]``."""
    mass = w.sum()
    if mass <= 0:
        return 0.0
    return float(sum((w * np.abs(y[:, o] - median_of(y[:, o], w))).sum() for o in range(y.shape[1])) / mass)


def running_absolute(y: np.ndarray, w: np.ndarray, ends: np.ndarray | None = None) -> np.ndarray:
    """Sum of absolute deviations of each prefix from its weighted median, in the
    given order; with ``ends``, only of the prefixes of these lengths.

    All prefixes look for their medians at once, a bit of the values' ranks at a
    time: rows are dealt by the bit, in order, so that a prefix stays a range of
    rows on either side. Sums are extended, since a range's is a difference.
    """
    hi = np.arange(1, len(y) + 1) if ends is None else np.asarray(ends, np.int64)
    if not len(y):
        return np.zeros(len(hi))
    values, rank = np.unique(y, return_inverse=True)
    v = w.astype(np.longdouble)
    vy = v * y
    lo, at = np.zeros_like(hi), np.zeros_like(hi)
    all_w, all_y = np.append(0, np.cumsum(v))[hi], np.append(0, np.cumsum(vy))[hi]
    low_w, low_y = np.zeros_like(all_w), np.zeros_like(all_y)
    for bit in reversed(range((len(values) - 1).bit_length())):
        lower = (rank >> bit) & 1 == 0
        low = np.flatnonzero(lower)
        before = np.append(0, np.cumsum(lower))
        run_w, run_y = np.append(0, np.cumsum(v[low])), np.append(0, np.cumsum(vy[low]))
        a, b = before[lo], before[hi]
        more = run_w[b] - run_w[a]
        above = low_w + more <= all_w / 2
        low_w, low_y = low_w + np.where(above, more, 0), low_y + np.where(above, run_y[b] - run_y[a], 0)
        lo, hi = np.where(above, len(low) + lo - a, a), np.where(above, len(low) + hi - b, b)
        at |= above.astype(np.int64) << bit
        dealt = np.concatenate([low, np.flatnonzero(~lower)])
        rank, v, vy = rank[dealt], v[dealt], vy[dealt]
    m = values[np.minimum(at, len(values) - 1)]
    return np.maximum(m * low_w - low_y + (all_y - low_y) - m * (all_w - low_w), 0).astype(float)


IMPURITY = {"gini": gini, "entropy": entropy, "squared_error": squared_error, "gain_hessian": gain_hessian}
