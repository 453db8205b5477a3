"""One inner tree on its own: a feature, or a pair, to bins."""

from __future__ import annotations

import pickle
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.features import Feature
from ..functions.params import TreeParams
from ..plans.routing import bin_column, category_bin_column, pair_bin_column
from ..runtime import ship
from . import inner, pairs, wide
from .estimators import _as_list, prepare
from .growth import aggregate, row_stats, sums_of
from .inner import Bins, Loss


@dataclass
class ShapeDiscretizer:
    """Fit one inner tree; ``transform`` adds its ``bin``.

    ``criterion``: any of the classification or regression criteria.
    """

    criterion: str = "gini"
    min_samples_leaf: int = 1
    min_impurity_decrease: float = 0.0
    max_depth: int | None = None
    max_leaf_nodes: int | None = None
    #: Values of a feature, or rows of a pair, that one task searches; beyond it the search runs in range pieces.
    max_distinct: int = 1 << 20

    def fit(self, df: DataFrame, columns: list[str], target: str | list[str], weight: str | None = None, feature_dict: dict | None = None) -> "DiscretizerModel":
        classification = self.criterion.strip().lower() in ("gini", "entropy", "log_loss")
        params = TreeParams(criterion=self.criterion, max_distinct=self.max_distinct).checked(classification)
        made = prepare(df, columns, _as_list(target), replace(params, class_weight=None), classification, weight, feature_dict)
        table, loss = made.table, Loss(params.criterion, made.table.outputs)
        if not 1 <= len(table.features) <= 2:
            raise ValueError("a discretizer takes one feature or a pair")
        keys = [f"f{i}" for i in range(len(table.features))]
        sums, classes, features = aggregate(table.rows, keys, table, loss.absolute), table.classes, table.features
        caps = (self.min_samples_leaf, self.min_impurity_decrease, self.max_depth, self.max_leaf_nodes)
        ship(df.sparkSession)
        if not loss.absolute and (table.wide if len(keys) == 1 else table.rows.count() > self.max_distinct):
            return DiscretizerModel(self._wide(table, loss, caps), features, loss)

        def run(frame):
            import numpy as np
            import pandas as pd

            frame = frame.sort_values(keys, kind="stable")
            if len(keys) == 2:
                x, cells = np.unique(frame[keys].to_numpy(float), axis=0, return_inverse=True, equal_nan=True)
                bins = pairs.pair_bins(x, (features[0].kind, features[1].kind), sums_of(frame, cells.ravel(), len(x), classes, loss.outputs, loss.absolute), loss, *caps)
            else:
                v = frame[keys[0]].to_numpy(float)
                gone = np.isnan(v)
                x, cells = np.unique(v[~gone], return_inverse=True)
                own = sums_of(frame[~gone], cells, len(x), classes, loss.outputs, loss.absolute)
                lost = sums_of(frame[gone], np.zeros(int(gone.sum()), np.int64), 1, classes, loss.outputs, loss.absolute)
                if features[0].numeric:
                    bins = inner.numeric_bins(x, own, lost, loss, *caps)
                else:
                    count = len(features[0].categories if features[0].kind == "label" else features[0].columns)
                    bins = inner.category_bins(x, own, lost, loss, count, *caps)
            return pd.DataFrame({"payload": [pickle.dumps(bins)]})

        def all_in_one(key, frame):
            return run(frame)

        got = sums.groupBy(F.lit(0).alias("g")).applyInPandas(all_in_one, "payload binary").first()
        bins = pickle.loads(got["payload"]) if got is not None else None
        if bins is None:
            raise ValueError("the feature has no finite value")
        return DiscretizerModel(bins, features, loss)


    def _wide(self, table, loss: Loss, caps) -> Bins:
        features, stats = table.features, table.classes or [2] * table.outputs
        if len(features) == 1:
            cells = aggregate(table.rows, ["tree", "f0"], table, False).withColumnRenamed("wsum", "w").withColumnRenamed("f0", "x")
            found = wide.numeric_bins(cells, wide.Plan(["tree"], loss, stats), *caps)
        else:
            rows = row_stats(table.rows.select(F.lit(0).alias("node"), F.lit(0).alias("fa"), F.lit(1).alias("fb"), F.col("f0").alias("xa"), F.col("f1").alias("xb"), "tree", "mult", "w", *table.targets), table)
            kinds = tuple("continuous" if f.numeric else f.kind for f in features)
            found, _ = wide.pair_bins(rows, wide.Plan(["tree"], loss, stats), {(0,): kinds}, *caps)
        if (0,) not in found:
            raise ValueError("the feature has no finite value")
        return found[0,]


@dataclass
class DiscretizerModel:
    bins: Bins
    features: list[Feature]
    loss: Loss

    @property
    def n_bins(self) -> int:
        return len(self.bins.sums)

    @property
    def bin_weights(self):
        return self.bins.sums.w

    @property
    def bin_statistics(self):
        return self.bins.sums.s

    def bin_predictions(self):
        """Majority class of each bin and output (lowest on ties), or its mean or median."""
        from ..functions import criteria as C

        if self.loss.absolute:
            return [[C.median_of(y[:, o], v) for o in range(self.loss.outputs)] for y, v in zip(self.bins.sums.y, self.bins.sums.v)]
        if self.loss.criterion == "squared_error":
            return C.safe_divide(self.bins.sums.s[:, :, 0], self.bins.sums.w[:, None]).tolist()
        return self.bins.sums.s.argmax(-1).tolist()

    def transform(self, df: DataFrame) -> DataFrame:
        from ..functions.features import value_column

        values = [value_column(f) for f in self.features]
        if self.bins.kind == "pair":
            column = pair_bin_column(self.bins.tree, tuple(values))
        elif self.bins.kind == "categorical":
            column = category_bin_column(values[0], self.bins.categories)
        else:
            column = bin_column(values[0], self.bins.thresholds)
        return df.withColumn("bin", column.cast("int"))
