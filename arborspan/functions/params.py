"""Parameters of trees and forests, with their checks."""

from __future__ import annotations

import math
import numbers
from dataclasses import dataclass, fields, replace

from .criteria import parse_criterion

#: Largest seed of a tree of a forest, exclusive.
SEED_LIMIT = 2**31 - 1


def check_number(name: str, value, least: float = 0.0) -> float:
    if isinstance(value, bool) or not isinstance(value, numbers.Real) or not math.isfinite(value) or value < least:
        raise ValueError(f"{name} must be a finite number of at least {least:g}")
    return float(value)


def check_int(name: str, value, least: int) -> int:
    if isinstance(value, bool) or not isinstance(value, numbers.Integral) or value < least:
        raise ValueError(f"{name} must be an integer of at least {least}")
    return int(value)


def feature_count(max_features, n: int) -> int:
    """How many of ``n`` features a node may look at. A function of ``(n, rng)``
    gives the features themselves, in order; it counts as a free choice here."""
    if callable(max_features):
        return n
    if max_features is None or (isinstance(max_features, numbers.Integral) and not isinstance(max_features, bool) and max_features == 0):
        return n
    if isinstance(max_features, str):
        kind = max_features.strip().lower()
        if kind not in ("sqrt", "log2"):
            raise ValueError(f"unknown max_features {max_features!r}")
        k = math.isqrt(n) if kind == "sqrt" else int(math.log2(n)) if n > 0 else 0
        return min(n, max(1, k))
    if isinstance(max_features, bool):
        raise ValueError("max_features must not be a bool")
    if isinstance(max_features, numbers.Integral):
        if max_features < 0:
            raise ValueError("max_features must not be negative")
        return min(n, int(max_features))
    if isinstance(max_features, numbers.Real) and 0 < max_features <= 1:
        return min(n, max(1, int(max_features * n)))
    raise ValueError("max_features as a share must be above 0 and at most 1")


def pair_budget(pairwise_candidates, n: int) -> int:
    """Feature pairs that a node may fit; a share is of the number of features."""
    value = check_number("pairwise_candidates", pairwise_candidates)
    return math.ceil(value * n) if isinstance(pairwise_candidates, float) else int(value)


@dataclass(frozen=True)
class TreeParams:
    """Parameters of one tree; ``None`` for a limit means none."""

    criterion: str = "gini"
    num_partitions: int = 2
    max_depth: int | None = 4
    max_leaf_nodes: int | None = None
    min_samples_leaf: int = 4
    min_impurity_decrease: float = 1.0
    inner_max_depth: int | None = None
    inner_max_leaf_nodes: int | None = 4
    inner_min_samples_leaf: int = 13
    inner_min_impurity_decrease: float = 0.01
    #: Moves of bins between children, for each bin at most.
    coordinate_descent_max_iters: int = 10
    #: Idle rounds after which the search ends; the best of all moves is looked
    #: for, so the first idle round proves that none is left.
    coordinate_descent_patience: int = 5
    random_state: int | None = 42
    max_features: object = None
    pairwise_candidates: object = 0
    pairwise_penalty: float = 0.0
    branching_penalty: float = 0.0
    class_weight: object = None
    tao_n_runs: int = 0
    tao_lambda: float = 1e-4
    tao_pair_scale: float = 2.0
    mae_coordinate_descent: bool = False
    #: Values of a numeric feature, or rows of a pair's node, that one task searches;
    #: beyond it the same search runs in range pieces, with the same result. (The
    #: absolute error, which no sums give, is searched in one task.)
    max_distinct: int = 1 << 20
    #: Cut numeric features with more than ``max_distinct`` values (under the absolute
    #: error: targets too) into this many quantiles first; None, as it is, for exact cuts.
    quantile_bins: int | None = None

    def checked(self, classification: bool) -> "TreeParams":
        for name in ("min_impurity_decrease", "pairwise_penalty", "branching_penalty", "inner_min_impurity_decrease", "tao_lambda", "tao_pair_scale"):
            check_number(name, getattr(self, name))
        for name, least in (("num_partitions", 2), ("min_samples_leaf", 1), ("inner_min_samples_leaf", 1), ("tao_n_runs", 0), ("coordinate_descent_max_iters", 0), ("coordinate_descent_patience", 0), ("max_distinct", 2)):
            check_int(name, getattr(self, name), least)
        for name, least in (("max_depth", 1), ("max_leaf_nodes", 1), ("inner_max_depth", 1), ("inner_max_leaf_nodes", 2), ("quantile_bins", 2)):
            if getattr(self, name) is not None:
                check_int(name, getattr(self, name), least)
        check_number("pairwise_candidates", self.pairwise_candidates)
        return replace(self, criterion=parse_criterion(self.criterion, classification))

    def get_params(self) -> dict:
        return {f.name: getattr(self, f.name) for f in fields(self)}


#: What a search tries for each parameter.
SEARCH = {
    "max_depth": [4, 6, 8, 10],
    "inner_max_leaf_nodes": [2, 4, 8, 16, 32, 64],
    "min_samples_leaf": [1, 2, 4, 8, 16, 32],
    "inner_min_samples_leaf": [1, 2, 4, 8, 16, 32],
    "min_impurity_decrease": [0.0, 0.01, 0.1, 1.0, 10.0],
    "inner_min_impurity_decrease": [0.0, 0.001, 0.01, 0.1],
}
SEARCH_TAO = {"tao_lambda": [0.01, 0.001, 0.0001], "tao_n_runs": [10]}
SEARCH_PAIRS = {"pairwise_candidates": [0.25, 0.5, 1.0, 2.0], "pairwise_penalty": [0.0, 0.01, 0.1, 1.0]}
SEARCH_PAIR_SCALE = [1.5, 1.75, 2.0]
SEARCH_BRANCHING = [0.0, 0.01, 0.1, 1.0]


def suggested_params(*, use_tao: bool = False, use_bivariate: bool = False) -> list[dict]:
    """Grids of values for a search: one for two-way and one for three-way
    branching, which alone varies the branching penalty."""
    shared = dict(SEARCH)
    for wanted, more in ((use_tao, SEARCH_TAO), (use_bivariate, SEARCH_PAIRS), (use_tao and use_bivariate, {"tao_pair_scale": SEARCH_PAIR_SCALE})):
        shared |= more if wanted else {}
    ways = ({"num_partitions": [2]}, {"num_partitions": [3], "branching_penalty": SEARCH_BRANCHING})
    return [{k: list(v) for k, v in (shared | way).items()} for way in ways]


def suggest_params(trial, *, use_tao: bool = False, use_bivariate: bool = False) -> dict:
    """Parameters drawn from ``trial``: any object with ``suggest_int``,
    ``suggest_float`` and ``suggest_categorical``."""
    drawn = {"num_partitions": trial.suggest_int("num_partitions", 2, 3)}
    for name, values in SEARCH.items():
        if isinstance(values[0], int):
            drawn[name] = trial.suggest_int(name, values[0], values[-1], **({} if name == "max_depth" else {"log": True}))
        else:
            drawn[name] = trial.suggest_categorical(name, values)
    if use_bivariate:
        drawn |= {name: trial.suggest_categorical(name, values) for name, values in SEARCH_PAIRS.items()}
    if drawn["num_partitions"] > 2:
        drawn["branching_penalty"] = trial.suggest_categorical("branching_penalty", SEARCH_BRANCHING)
    if use_tao:
        low, high = min(SEARCH_TAO["tao_lambda"]), max(SEARCH_TAO["tao_lambda"])
        drawn |= {"tao_n_runs": SEARCH_TAO["tao_n_runs"][0], "tao_lambda": trial.suggest_float("tao_lambda", low, high, log=True)}
        if use_bivariate:
            drawn["tao_pair_scale"] = trial.suggest_float("tao_pair_scale", SEARCH_PAIR_SCALE[0], SEARCH_PAIR_SCALE[-1])
    return drawn
