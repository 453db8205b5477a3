"""Models as tables: export to a DataFrame, Parquet or JSON, and back."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..functions.features import features_from_json, features_json
from ..functions.params import TreeParams
from ..operators.estimators import TreeModel
from ..operators.growth import Tree

NODE_SCHEMA = (
    "tree_id int, node_id int, parent_id int, partition int, depth int, is_leaf boolean, n bigint, mass double, impurity double, raw_gain double, reg_gain double, "
    "kind string, logical array<int>, columns array<string>, thresholds array<double>, bin_categories array<array<int>>, bin_to_partition array<int>, nan_partition int, "
    "pair_tree array<struct<axis:int,kind:string,threshold:double,left:int,right:int,missing:int,bin:int>>, bin_n array<bigint>, bin_w array<double>, bin_stats array<array<array<double>>>, "
    "retained_pairs array<array<int>>, class_counts array<array<double>>, value array<array<double>>, children array<int>"
)


def tree_export(model: TreeModel, tree: int | None = None) -> dict:
    """A tree as plain values; regression values are in the targets' own units.

    Numeric bins list only finite bins in ``bin_to_partition`` and give the
    missing bin's child as ``nan_partition``.
    """
    t = min(model.trees) if tree is None else tree
    nodes = []
    for n in model.trees[t].nodes:
        own = {k: v for k, v in n.items() if k != "categories"}
        own["bin_categories"] = n["categories"]
        own["nan_partition"] = None
        if not n["is_leaf"] and n["kind"] in ("numeric", "categorical"):
            own["nan_partition"] = n["bin_to_partition"][-1]
            own["bin_to_partition"] = n["bin_to_partition"][:-1]
        if model.classes is None:
            own["value"] = [[float(v * s + m)] for v, (m, s) in zip(n["value"], model.scaling[t])]
        nodes.append(own)
    return {"tree_id": t, "root_index": 0, "nodes": nodes, "classes": model.classes, "n_features": model.n_features_in_, "refined": model.refined}


def nodes_table(spark: SparkSession, model: TreeModel) -> DataFrame:
    """All trees' nodes as a DataFrame of ``NODE_SCHEMA``."""
    schema = T.StructType.fromDDL(NODE_SCHEMA)
    rows = []
    for t in sorted(model.trees):
        for n in tree_export(model, t)["nodes"]:
            pair = [{"kind": None, "threshold": None, "left": None, "right": None, "missing": None} | p for p in n["pair_tree"]]
            pair = [p | {"threshold": None if p["threshold"] is None else float(p["threshold"])} for p in pair]
            plain = n | {"pair_tree": pair, "value": [[float(x) for x in v] for v in n["value"]]}
            rows.append(tuple(_plain(plain[f.name]) for f in schema))
    return spark.createDataFrame(rows, schema)


def _plain(v):
    if isinstance(v, (np.floating, np.integer)):
        return v.item()
    if isinstance(v, np.ndarray):
        return _plain(v.tolist())
    if isinstance(v, (list, tuple)):
        return [_plain(x) for x in v]
    return {k: _plain(x) for k, x in v.items()} if isinstance(v, dict) else v


def to_json(model: TreeModel) -> str:
    """Everything of a model as one JSON text."""
    body = {
        "kind": model.kind, "params": {k: None if callable(v) else v for k, v in model.params.get_params().items()}, "features": features_json(model.features), "names": model.feature_names_in_, "targets": model.targets, "classes": model.classes,
        "scaling": {str(t): s for t, s in model.scaling.items()}, "refined": model.refined, "forest": model.forest,
        "trees": {str(t): {"nodes": tree.nodes, "importances": tree.importances} for t, tree in model.trees.items()},
    }
    return json.dumps(_plain(body))


def from_json(text: str) -> TreeModel:
    b = json.loads(text)
    trees = {int(t): Tree(v["nodes"], np.array(v["importances"])) for t, v in b["trees"].items()}
    scaling = {int(t): [tuple(p) for p in s] for t, s in b["scaling"].items()}
    return TreeModel(b["kind"], TreeParams(**b["params"]), features_from_json(b["features"]), b["names"], b["targets"], trees, b["classes"], scaling, b["refined"], b["forest"])


def save(spark: SparkSession, model: TreeModel, path: str) -> None:
    """Write a model as one row of text, through Spark, to any store it knows."""
    spark.createDataFrame([(to_json(model),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load(spark: SparkSession, path: str) -> TreeModel:
    return from_json(spark.read.text(path, wholetext=True).first()[0])
