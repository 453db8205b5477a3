"""Estimators and fitted models.

An estimator's ``fit(df, ...)`` returns a model and leaves the estimator as it
was; a failed fit changes nothing. A model is its nodes; ``transform`` adds
columns by expressions only, so it works on streaming DataFrames as well.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import targets as Y
from ..functions.features import Feature, features_of, finite_checks, judge_finite, value_column
from ..functions.params import TreeParams, check_int
from ..plans.routing import path_column, walk_column
from ..runtime import ship
from . import sampling
from .growth import Table, Tree, fit_trees


#: Nodes of a model beyond which rows are scored in batches and not by one expression.
EXPRESSION_NODES = 1500


def _as_list(x) -> list:
    return [x] if isinstance(x, str) else list(x)


@dataclass
class Prepared:
    """Encoded rows of a fit: ``table`` with one tree, and what decodes it."""

    table: Table
    classes: list[list] | None
    scaling: list[tuple[float, float]] | None
    rows: int


def prepare(df: DataFrame, feature_columns: list[str], target: str | list[str], params: TreeParams, classification: bool, weight: str | None, feature_dict, features: list[Feature] | None = None, classes: list[list] | None = None, check: bool = True, row_id: str | None = None, scaling: dict | None = None) -> Prepared:
    """Validate, encode targets and weights, and narrow features, in one projection.

    All checks, the targets' means and the features' numbers of values are one
    job. ``check``: with False, the table is taken as valid and ``classes`` as
    given. ``scaling``: that of fitted trees; each tree then has its own copy of
    the rows.
    """
    targets = _as_list(target)
    features = features or features_of(df, feature_columns, feature_dict)
    values = [value_column(f) for f in features]
    w = Y.weight_column(weight)
    if classification:
        classes = classes or [Y.label_dictionary(df, t) for t in targets]
        w = Y.effective_weight(w, targets, Y.class_multipliers(params.class_weight, classes)).cast("float").cast("double")
    ys = {f"y{o}": Y.encode(t, classes[o]).cast("int") if classification else F.col(t).cast("double") for o, t in enumerate(targets)}
    aggs: dict[str, Column] = finite_checks(df, feature_columns) | Y.weight_checks(w) | Y.target_checks(ys, classification) if check else {}
    if not classification and scaling is None:
        aggs |= Y.mean_aggs(ys, w)
    aggs |= value_counts(features, values, ys, params)
    row = df.agg(*[c.alias(name) for name, c in aggs.items()]).first() if aggs else None
    n = -1
    if check:
        n = judge_finite(row, feature_columns)
        Y.judge_weights(row)
        Y.judge_targets(row, list(ys), classification)
    many = [c[len("values ") :] for c in aggs if c.startswith("values ") and row[c] > 0.9 * params.max_distinct]
    fixed, scaling = scaling, None
    if fixed is None and not classification:
        scaling = Y.scaling_about(df, ys, w, row)
        ys = {name: ((y - F.lit(mean)) / F.lit(scale)).cast("float").cast("double") for (name, y), (mean, scale) in zip(ys.items(), scaling)}
    base = df.select(
        F.lit(0).alias("tree"), F.lit(1).alias("mult"), w.alias("w"), *[v.alias(f"f{i}") for i, v in enumerate(values)], *[y.alias(name) for name, y in ys.items()],
        *([F.col(row_id).alias("row_id")] if row_id else []),
    )
    if fixed is not None:
        base = base.drop("tree").withColumn("tree", F.explode(F.array(*[F.lit(t) for t in sorted(fixed)])))
        for o, y in enumerate(ys) if not classification else ():
            scaled = None
            for t in sorted(fixed):
                mean, scale = fixed[t][o]
                own = (F.col(y) - F.lit(mean)) / F.lit(scale)
                scaled = F.when(F.col("tree") == t, own) if scaled is None else scaled.when(F.col("tree") == t, own)
            base = base.withColumn(y, scaled.cast("float").cast("double"))
    elif many and params.quantile_bins is not None:
        base, many = in_quantiles(base, many, params.quantile_bins), []
    wide = frozenset(int(c[1:]) for c in many if c.startswith("f"))
    return Prepared(Table(base, features, len(targets), [len(c) for c in classes] if classification else None, wide), classes if classification else None, scaling, n)


def value_counts(features: list[Feature], values: list[Column], ys: dict[str, Column], params: TreeParams) -> dict[str, Column]:
    """Aggregates: numbers of different values of numeric features and, where
    they are cut into quantiles, of targets under the absolute error."""
    absolute = params.criterion == "absolute_error"
    if absolute and params.quantile_bins is None:
        return {}
    counted = {f"f{i}": v for i, (f, v) in enumerate(zip(features, values)) if f.numeric} | (ys if absolute else {})
    return {f"values {c}": F.approx_count_distinct(v) for c, v in counted.items()}


def in_quantiles(rows: DataFrame, columns: list[str], bins: int) -> DataFrame:
    """Columns cut into quantiles, each named by its upper bound."""
    shares = [i / bins for i in range(1, bins)]
    cuts = rows.agg(*[F.percentile_approx(c, shares, 100_000).alias(c) for c in columns]).first()
    for c in columns:
        edges = sorted(set(cuts[c]))
        at = F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e < F.col(c)))
        above = edges[-1] + max(1.0, abs(edges[-1])) if c.startswith("f") else edges[-1]
        reps = F.array(*[F.lit(float(e)) for e in [*edges, above]])
        rows = rows.withColumn(c, F.when(F.col(c).isNotNull(), F.element_at(reps, at + 1)))
    return rows


@dataclass
class TreeModel:
    """A fitted tree or forest (several trees)."""

    kind: str  # classifier or regressor
    params: TreeParams
    features: list[Feature]
    feature_names_in_: list[str]
    targets: list[str]
    trees: dict[int, Tree]
    classes: list[list] | None = None
    scaling: dict[int, list[tuple[float, float]]] = field(default_factory=dict)
    refined: bool = False
    forest: bool = False

    # ---------------------------------------------------------------- scoring

    @property
    def outputs(self) -> int:
        return len(self.targets)

    @property
    def n_features_in_(self) -> int:
        return len(self.feature_names_in_)

    @property
    def n_outputs_(self) -> int:
        return self.outputs

    @property
    def processed_features_(self) -> list[Feature]:
        return self.features

    @property
    def classes_(self):
        return None if self.classes is None else self.classes[0] if self.outputs == 1 else self.classes

    @property
    def n_classes_(self):
        return None if self.classes is None else len(self.classes[0]) if self.outputs == 1 else [len(c) for c in self.classes]

    @property
    def estimators_(self) -> list["TreeModel"]:
        return [replace(self, trees={t: tree}, forest=False) for t, tree in sorted(self.trees.items())]

    def values(self) -> list[Column]:
        return [value_column(f) for f in self.features]

    def leaf_columns(self, values: list[Column] | None = None) -> list[Column]:
        values = values or self.values()
        return [walk_column(tree.nodes, values, lambda n: F.lit(n["node_id"])) for _, tree in sorted(self.trees.items())]

    def _leaf_values(self, o: int, names: list[str]) -> list[Column]:
        """Each tree's value at its leaf, by look-up in a literal array."""
        out = []
        for (t, tree), name in zip(sorted(self.trees.items()), names):
            held = []
            for n in tree.nodes:
                if self.classes is not None:
                    held.append(F.array(*[F.lit(float(v)) for v in n["value"][o]]))
                else:
                    mean, scale = self.scaling[t][o]
                    held.append(F.lit(float(n["value"][o] * scale + mean)))
            out.append(F.element_at(F.array(*held), F.col(name) + 1))
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with ``prediction``, for classifiers ``probability``, and for
        single trees ``leaf``; with several outputs the first two are arrays.

        Columns of these names give way. A missing column is an error.
        """
        missing = [c for f in self.features for c in f.columns if c not in df.columns]
        if missing:
            raise ValueError(f"the table lacks feature columns {missing}")
        if len(self.trees) > 1 and sum(len(t.nodes) for t in self.trees.values()) > EXPRESSION_NODES:
            return self._transform_batches(df)
        added = ["prediction", "probability", "leaf"]
        keep = [c for c in df.columns if c not in added]
        names = [f"__leaf_{t}" for t in sorted(self.trees)]
        inputs = [f"__f{i}" for i in range(len(self.features))]
        out = df.select(*keep, *[v.alias(n) for v, n in zip(self.values(), inputs)])
        out = out.select(*keep, *[c.alias(n) for c, n in zip(self.leaf_columns([F.col(i) for i in inputs]), names)])
        predictions, shares = [], []
        for o in range(self.outputs):
            each = self._leaf_values(o, names)
            if self.classes is None:
                total = each[0]
                for e in each[1:]:
                    total = total + e
                predictions.append(total / F.lit(float(len(each))) if len(each) > 1 else total)
                continue
            k = len(self.classes[o])
            columns = []
            for c in range(k):
                total = each[0][c]
                for e in each[1:]:
                    total = total + e[c]
                columns.append(total / F.lit(float(len(each))))
            p = F.array(*columns)
            mass = F.aggregate(p, F.lit(0.0), lambda a, x: a + x)
            p = F.transform(p, lambda x, mass=mass: F.when(mass > 0, x / mass).otherwise(x)) if len(each) > 1 else p
            shares.append(p)
            predictions.append(Y.decode(F.array_position(p, F.array_max(p)) - 1, self.classes[o]))
        one = self.outputs == 1
        extra = [(predictions[0] if one else F.array(*predictions)).alias("prediction")]
        if self.classes is not None:
            extra.append((shares[0] if one else F.array(*shares)).alias("probability"))
        if len(self.trees) == 1:
            extra.append(F.col(names[0]).alias("leaf"))
        return out.select(*keep, *extra)

    def _transform_batches(self, df: DataFrame) -> DataFrame:
        """As :meth:`transform`, with vectorised walks in Python workers. No shuffle."""
        import pandas as pd
        from pyspark.sql import types as T

        from . import walker

        ship(df.sparkSession)
        keep = [c for c in df.columns if c not in ("prediction", "probability", "leaf")]
        inputs = [f"__f{i}" for i in range(len(self.features))]
        rows = df.select(*keep, *[v.alias(n) for v, n in zip(self.values(), inputs)])
        values = T.ArrayType(T.ArrayType(T.DoubleType())) if self.classes is not None else T.ArrayType(T.DoubleType())
        schema = T.StructType([rows.schema[c] for c in keep] + [T.StructField("__values", values)])
        held = df.sparkSession.sparkContext.broadcast((self.trees, self.scaling, self.classes, self.outputs))  # nodes: bounded by the model's own size

        def run(frames):
            trees, scaling, classes, outputs = held.value
            for frame in frames:
                each = walker.mean_values(trees, scaling, classes, outputs, frame[inputs].to_numpy(float))
                out = frame[keep].copy()
                out["__values"] = [[list(map(float, e[i])) if classes is not None else float(e[i]) for e in each] for i in range(len(frame))]
                yield pd.DataFrame(out)

        scored = rows.mapInPandas(run, schema)
        one, get = self.outputs == 1, [F.element_at("__values", o + 1) for o in range(self.outputs)]
        if self.classes is None:
            return scored.select(*keep, (get[0] if one else F.col("__values")).alias("prediction"))
        labels = [Y.decode(F.array_position(p, F.array_max(p)) - 1, c) for p, c in zip(get, self.classes)]
        return scored.select(*keep, (labels[0] if one else F.array(*labels)).alias("prediction"), (get[0] if one else F.col("__values")).alias("probability"))

    def predict(self, df: DataFrame) -> DataFrame:
        return self.transform(df).select("prediction")

    def predict_proba(self, df: DataFrame) -> DataFrame:
        if self.classes is None:
            raise AttributeError("a regressor has no probabilities")
        return self.transform(df).select("probability")

    def reach_counts(self, df: DataFrame, tree: int | None = None) -> DataFrame:
        """``(node_id, n)``: rows that pass each node of a tree."""
        t = min(self.trees) if tree is None else tree
        path = path_column(self.trees[t].nodes, self.values())
        return df.select(F.explode(path).alias("node_id")).groupBy("node_id").agg(F.count(F.lit(1)).alias("n"))

    def score(self, df: DataFrame) -> float:
        """Share of right predictions (all outputs), or R2 (mean over outputs)."""
        out = self.transform(df)
        get = lambda o: F.col("prediction") if self.outputs == 1 else F.col("prediction")[o]
        if self.classes is not None:
            right = F.lit(True)
            for o, t in enumerate(self.targets):
                right = right & (get(o) == F.col(t))
            return float(out.agg(F.avg(right.cast("double"))).first()[0])
        scores = []
        for o, t in enumerate(self.targets):
            mean = out.agg(F.avg(F.col(t).cast("double"))).first()[0]
            r = out.agg(F.sum((F.col(t) - get(o)) ** 2).alias("e"), F.sum((F.col(t) - F.lit(mean)) ** 2).alias("v")).first()
            scores.append(1 - r["e"] / r["v"] if r["v"] else (1.0 if not r["e"] else 0.0))
        return float(np.mean(scores))

    # -------------------------------------------------------------- explaining

    @property
    def feature_importances_(self) -> np.ndarray:
        """Share of raw gain of each logical feature; pair gains are halved."""
        if self.refined:
            raise AttributeError("importances aren't defined after refinement")
        if any(n["kind"] == "pair" for tree in self.trees.values() for n in tree.nodes):
            warnings.warn("a pair split's gain is shared equally by its two features", UserWarning, stacklevel=2)
        if self.forest:
            return self.mean_feature_importances_
        return self.trees[min(self.trees)].importances

    @property
    def mean_feature_importances_(self) -> np.ndarray:
        if self.refined:
            raise AttributeError("importances aren't defined after refinement")
        return np.mean([t.importances for t in self.trees.values()], 0)

    @property
    def std_feature_importance_(self) -> np.ndarray:
        if self.refined:
            raise AttributeError("importances aren't defined after refinement")
        return np.std([t.importances for t in self.trees.values()], 0)


class _Estimator:
    classification = True
    forest = False
    defaults: dict = {}

    def __init__(self, **params):
        known = set(TreeParams.__dataclass_fields__) | set(self.extra())
        unknown = set(params) - known
        if unknown:
            raise TypeError(f"unknown parameters {sorted(unknown)}")
        base = dict(self.defaults) | params
        self.forest_params = {k: base.pop(k, v) for k, v in self.extra().items()}
        self.params = TreeParams(**base)

    @classmethod
    def extra(cls) -> dict:
        return {}

    def get_params(self) -> dict:
        return self.params.get_params() | self.forest_params

    def set_params(self, **params):
        self.__init__(**(self.get_params() | params))
        return self

    def copy(self):
        return type(self)(**self.get_params())

    def _warn(self, params: TreeParams) -> None:
        if params.criterion == "absolute_error" and not params.mae_coordinate_descent and params.num_partitions > 2:
            warnings.warn("coordinate descent is off for the absolute error; set mae_coordinate_descent to turn it on", UserWarning, stacklevel=3)

    def fit(self, df: DataFrame, features: list[str], target: str | list[str], weight: str | None = None, feature_dict: dict | None = None, check: bool = True, classes: list[list] | None = None) -> TreeModel:
        """Fit on ``df``: feature columns, one or several targets, optional weights."""
        params = self.params.checked(self.classification)
        if params.random_state is None:
            params = replace(params, random_state=42)
        self._warn(params)
        made = prepare(df, features, target, params, self.classification, weight, feature_dict, classes=classes, check=check)
        table = replace(made.table, rows=made.table.rows.persist())
        try:
            trees = fit_trees(table, params)
            model = self._model(params, made, features, _as_list(target), trees)
        finally:
            table.rows.unpersist()
        if params.tao_n_runs:
            from .refine import refine

            model = refine(model, df, weight=weight, n_runs=params.tao_n_runs, lambda_=params.tao_lambda, pair_scale=params.tao_pair_scale)
        return model

    def _model(self, params, made, features, targets, trees, scaling=None) -> TreeModel:
        scaling = scaling or {t: made.scaling for t in trees}
        return TreeModel(
            "classifier" if self.classification else "regressor", params, made.table.features, list(features), targets, trees, made.classes,
            scaling if not self.classification else {}, False, self.forest,
        )


class ShapeTreeClassifier(_Estimator):
    """Tree of learned one- or two-feature branchings for classes."""

    defaults = {"criterion": "gini"}


class ShapeTreeRegressor(_Estimator):
    """Tree of learned one- or two-feature branchings for numbers."""

    classification = False
    defaults = {"criterion": "squared_error"}


class _Forest(_Estimator):
    forest = True

    @classmethod
    def extra(cls) -> dict:
        return {"n_estimators": 100, "bootstrap": True, "max_samples": None, "row_id": None}

    def fit(self, df: DataFrame, features: list[str], target: str | list[str], weight: str | None = None, feature_dict: dict | None = None, check: bool = True, classes: list[list] | None = None) -> TreeModel:
        """Fit all trees together. With a numeric ``row_id`` column the bootstrap
        numbers rows in its order; without one, in the order of a hash."""
        params = self.params.checked(self.classification)
        opts = self.forest_params
        check_int("n_estimators", opts["n_estimators"], 1)
        if opts["max_samples"] is not None and not opts["bootstrap"]:
            raise ValueError("max_samples needs bootstrap")
        self._warn(params)
        made = prepare(df, features, target, params, self.classification, weight, feature_dict, classes=classes, check=check, row_id=opts["row_id"])
        rows = sampling.bootstrap(made.table.rows, opts["n_estimators"], params.random_state, opts["max_samples"], opts["bootstrap"], by_row_id=opts["row_id"] is not None)
        scaling = None
        if not self.classification:
            rows, scaling = _rescaled(rows, made)
        table = replace(made.table, rows=rows.persist())
        try:
            trees = fit_trees(table, replace(params, random_state=params.random_state if params.random_state is not None else 42))
            model = self._model(params, made, features, _as_list(target), trees, scaling)
        finally:
            table.rows.unpersist()
        if params.tao_n_runs:
            from .refine import refine

            model = refine(model, df, weight=weight, n_runs=params.tao_n_runs, lambda_=params.tao_lambda, pair_scale=params.tao_pair_scale)
        return model


def _rescaled(rows: DataFrame, made: Prepared):
    """Targets standardised within each tree's own sample; the scaling by tree."""
    names = made.table.targets
    weighted = rows.withColumn("__mw", F.col("mult") * F.col("w"))
    own = Y.standardisation(weighted, names, "__mw", ["tree"])
    out = rows
    for o, y in enumerate(names):
        mean = scale = None
        for (t,), pairs in own.items():
            m, s = F.lit(pairs[o][0]), F.lit(pairs[o][1])
            mean = F.when(F.col("tree") == t, m) if mean is None else mean.when(F.col("tree") == t, m)
            scale = F.when(F.col("tree") == t, s) if scale is None else scale.when(F.col("tree") == t, s)
        out = out.withColumn(y, ((F.col(y) - mean) / scale).cast("float").cast("double"))
    scaling = {t: [(gm + gs * m, gs * s) for (m, s), (gm, gs) in zip(pairs, made.scaling)] for (t,), pairs in own.items()}
    return out, scaling


class ShapeForestClassifier(_Forest):
    """Forest of shape trees for classes; ``max_features`` defaults to the square root."""

    defaults = {"criterion": "gini", "max_features": "sqrt", "random_state": None}


class ShapeForestRegressor(_Forest):
    """Forest of shape trees for numbers."""

    classification = False
    defaults = {"criterion": "squared_error", "max_features": 1.0, "random_state": None}
