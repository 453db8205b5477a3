import math
import re
import sys
from xml.etree import ElementTree

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from arborspan.operators import explain, wide
from arborspan.operators.discretizer import ShapeDiscretizer
from arborspan.operators.estimators import ShapeForestClassifier, ShapeForestRegressor, ShapeTreeClassifier, ShapeTreeRegressor
from arborspan.operators.pairs import route_pair
from arborspan.operators.refine import refine
from arborspan.plans import cuts
from arborspan.plans.routing import leaf_predicates
from arborspan.sources import datasets, snapshots
from arborspan.streaming.scoring import score_stream, windowed_predictions


def leaves(model):
    return [n for n in model.trees[0].nodes if n["is_leaf"]]


def test_golden_rules_of_a_regressor(spark, strict):
    df = spark.createDataFrame([(float(i), float(i > 1)) for i in range(4)], "x double, y double")
    model = ShapeTreeRegressor(**strict | {"max_leaf_nodes": 2}).fit(df, ["x"], "y")
    assert explain.export_text(model) == "|--- x <= 1.50 or x is missing\n|   |--- value: 0.00\n|--- x > 1.50\n|   |--- value: 1.00\n"


def test_golden_rules_of_a_classifier(spark, strict):
    df = spark.createDataFrame([(float(i), "a" if i < 3 else "b") for i in range(6)], "x double, y string")
    model = ShapeTreeClassifier(**strict | {"max_leaf_nodes": 2}).fit(df, ["x"], "y")
    assert explain.export_text(model, decimals=1) == "|--- x <= 2.5 or x is missing\n|   |--- class: a\n|--- x > 2.5\n|   |--- class: b\n"
    text = explain.export_text(model, class_names=["neg", "pos"], show_weights=True)
    assert "|   |--- weights: [3.00, 0.00] class: neg\n" in text
    assert [n["class_counts"] for n in leaves(model)] == [[[3.0, 0.0]], [[0.0, 3.0]]]
    assert model.classes_ == ["a", "b"] and model.n_classes_ == 2


@pytest.mark.parametrize("criterion, unit", [("gini", 2.0), ("entropy", 4.0)])
@pytest.mark.parametrize("weight", [1.0, 4.0])
def test_total_gain_and_cost_by_mass(spark, strict, criterion, unit, weight):
    df = spark.createDataFrame([(float(i // 2), i // 2, weight) for i in range(4)], "x double, y int, w double")
    fit = lambda cost: ShapeTreeClassifier(criterion=criterion, **strict | {"min_impurity_decrease": cost}).fit(df, ["x"], "y", weight="w")
    assert fit(0.0).trees[0].nodes[0]["raw_gain"] == pytest.approx(unit * weight)
    assert len(fit(1.5 * unit).trees[0].nodes) == (1 if weight == 1.0 else 3)


def test_regression_gain_is_in_scaled_units(spark, strict):
    df = spark.createDataFrame([(float(i // 2), 10.0 * (i // 2)) for i in range(4)], "x double, y double")
    for criterion in ("mse", "mae"):
        assert ShapeTreeRegressor(criterion=criterion, **strict).fit(df, ["x"], "y").trees[0].nodes[0]["raw_gain"] == pytest.approx(4.0)


def test_multi_output_impurity_is_a_mean(spark, strict):
    df = spark.createDataFrame([(0.0, 0, 0, 1.0), (0.0, 0, 1, 2.0), (1.0, 1, 0, 1.0), (1.0, 1, 1, 2.0)], "x double, y0 int, y1 int, w double")
    model = ShapeTreeClassifier(**strict).fit(df, ["x"], ["y0", "y1"], weight="w")
    assert model.trees[0].nodes[0]["impurity"] == pytest.approx((0.5 + 4 / 9) / 2)
    twice = ShapeTreeClassifier(**strict).fit(df, ["x"], ["y0", "y0"], weight="w")
    once = ShapeTreeClassifier(**strict).fit(df, ["x"], "y0", weight="w")
    assert twice.trees[0].nodes[0]["raw_gain"] == pytest.approx(once.trees[0].nodes[0]["raw_gain"])
    assert model.transform(df).first()["prediction"] == [0, 1]


def test_leaf_budget(spark, strict):
    df = spark.createDataFrame([(float(i), i // 6) for i in range(18)], "x double, y int")
    assert len(leaves(ShapeTreeClassifier(**strict | {"num_partitions": 3}).fit(df, ["x"], "y"))) == 3
    assert len(leaves(ShapeTreeClassifier(**strict | {"num_partitions": 3, "max_leaf_nodes": 2}).fit(df, ["x"], "y"))) == 2


def test_budget_goes_to_the_larger_total_gain(spark, strict):
    cells = [((0, 0), 0, 30), ((0, 1), 0, 18), ((0, 1), 1, 12), ((1, 0), 0, 5), ((1, 0), 1, 5), ((1, 1), 1, 10)]
    df = spark.createDataFrame([(float(a), float(b), y) for (a, b), y, n in cells for _ in range(n)], "x0 double, x1 double, y int")
    model = ShapeTreeClassifier(**strict | {"max_leaf_nodes": 3, "inner_max_depth": 1}).fit(df, ["x0", "x1"], "y")
    split = [n for n in model.trees[0].nodes if n["parent_id"] == 0 and not n["is_leaf"]]
    assert [n["n"] for n in split] == [60]


def test_missing_values_go_to_the_purer_child_and_unseen_to_the_largest(spark, strict):
    rows = [(float(x), y) for x, y in zip([0, 1, 2, 10, 11], [0, 0, 0, 1, 1])] + [(None, 1), (float("nan"), 1)]
    df = spark.createDataFrame(rows, "x double, y int")
    model = ShapeTreeClassifier(**strict).fit(df, ["x"], "y")
    assert model.score(df) == 1.0
    plain = ShapeTreeClassifier(**strict).fit(df.where("x is not null and not isnan(x)"), ["x"], "y")
    assert plain.transform(spark.createDataFrame([(None,)], "x double")).first()["prediction"] == 0


def test_finite_against_missing_alone(spark, strict):
    df = spark.createDataFrame([(1.0, 0), (1.0, 0), (None, 1), (None, 1)], "x double, y int")
    assert ShapeTreeClassifier(**strict).fit(df, ["x"], "y").score(df) == 1.0


def test_categories_native_and_one_hot_agree(spark, strict):
    rows = [(c, i % 3, int(c in "bd") ^ (i % 7 == 0)) for i, c in enumerate("abcd" * 20)]
    df = spark.createDataFrame(rows, "c string, z int, y int")
    hot = df.select("y", *[(F.col("c") == v).cast("double").alias(v) for v in "abcd"])
    a = ShapeTreeClassifier(**strict | {"max_depth": 1}).fit(df, ["c"], "y")
    b = ShapeTreeClassifier(**strict | {"max_depth": 1}).fit(hot, list("abcd"), "y", feature_dict={"c": list("abcd")})
    assert a.trees[0].nodes[0]["raw_gain"] == pytest.approx(b.trees[0].nodes[0]["raw_gain"])
    assert a.score(df) == b.score(hot)
    assert "c in {" in explain.export_text(a) and "c is missing" in explain.export_text(b)


def test_pair_root_on_uneven_xor(spark, strict):
    rows = [(float(a), float(b), int(a * b < 0)) for (a, b), n in zip([(-1, -1), (-1, 1), (1, -1), (1, 1)], [40, 30, 30, 28]) for _ in range(n)]
    df = spark.createDataFrame(rows, "x0 double, x1 double, y int")
    model = ShapeTreeClassifier(**strict | {"pairwise_candidates": 1}).fit(df, ["x0", "x1"], "y")
    assert model.trees[0].nodes[0]["kind"] == "pair" and model.score(df) == 1.0
    with pytest.warns(UserWarning):
        assert model.feature_importances_.tolist() == [0.5, 0.5]
    assert " and " in explain.export_text(model)
    even = spark.createDataFrame([(float(a), float(b), int(a * b < 0)) for a in (-1, 1) for b in (-1, 1) for _ in range(40)], "x0 double, x1 double, y int")
    flat = ShapeTreeClassifier(**strict | {"pairwise_candidates": 1}).fit(even, ["x0", "x1"], "y")
    assert len(flat.trees[0].nodes) == 1 and flat.score(even) == 0.5


def test_pair_routes_every_missing_state(spark, strict):
    states = [(a, b) for a in (-1.0, 1.0, None) for b in (-1.0, 1.0, None)]
    rows = [(a, b, i) for i, ((a, b), n) in enumerate(zip(states, [40, 31, 30, 29, 28, 27, 26, 25, 24])) for _ in range(n)]
    df = spark.createDataFrame(rows, "x0 double, x1 double, y int")
    model = ShapeTreeClassifier(**strict | {"pairwise_candidates": 1, "num_partitions": 9, "inner_max_leaf_nodes": 16}).fit(df, ["x0", "x1"], "y")
    assert model.score(df) == 1.0


def test_forest_shares_jobs_and_averages(spark):
    df = spark.range(200).select(F.col("id"), (F.col("id") % 20).cast("double").alias("x"), (F.col("id") % 7).cast("double").alias("z"), ((F.col("id") % 20) > 9).cast("int").alias("y"))
    model = ShapeForestClassifier(n_estimators=4, random_state=3, row_id="id", max_depth=2).fit(df, ["x", "z"], "y")
    again = ShapeForestClassifier(n_estimators=4, random_state=3, row_id="id", max_depth=2).fit(df.repartition(7), ["x", "z"], "y")
    assert snapshots.to_json(model) == snapshots.to_json(again)
    assert len(model.estimators_) == 4 and model.score(df) > 0.9
    each = [np.array([r["probability"] for r in t.transform(df.orderBy("id")).collect()]) for t in model.estimators_]
    assert np.allclose(np.mean(each, 0), [r["probability"] for r in model.transform(df.orderBy("id")).collect()])
    assert model.std_feature_importance_.shape == (2,)
    hashed = ShapeForestRegressor(n_estimators=3, random_state=3, max_depth=2).fit(df, ["x", "z"], "y")
    assert hashed.score(df) > 0.6


def test_refinement_never_hurts_without_a_price(spark):
    df = datasets.make_plus(spark, 400, random_state=1).cache()
    assert df.count() == 400
    model = ShapeTreeClassifier(max_depth=2, min_impurity_decrease=0.0).fit(df, ["x0", "x1"], "y")
    better = refine(model, df, lambda_=0.0)
    assert better.score(df) >= model.score(df) and not model.refined
    with pytest.raises(AttributeError):
        better.feature_importances_
    r = ShapeTreeRegressor(max_depth=2).fit(df, ["x0", "x1"], "y")
    assert refine(r, df, lambda_=0.0).score(df) >= r.score(df) - 1e-9
    dear = refine(model, df, lambda_=10.0)
    assert {n["kind"] for n in dear.trees[0].nodes} == {"constant"}
    assert refine(model, df, n_runs=0).score(df) == model.score(df)


def test_sql_predicates_replay_the_tree(spark):
    df = datasets.make_plus(spark, 300, random_state=2).withColumn("x0", F.when(F.col("row_id") % 9 != 0, F.col("x0"))).cache()
    model = ShapeTreeClassifier(max_depth=3, min_impurity_decrease=0.0).fit(df, ["x0", "x1"], "y")
    out = model.transform(df)
    for leaf, rule in leaf_predicates(model.trees[0].nodes, model.features, quote="`").items():
        assert out.where((F.col("leaf") == leaf) != F.expr(rule)).count() == 0


def test_snapshots_round_trip(spark, tmp_path):
    df = datasets.make_plus(spark, 300, random_state=4)
    model = ShapeTreeRegressor(max_depth=2, num_partitions=3).fit(df, ["x0", "x1"], "y")
    snapshots.save(spark, model, str(tmp_path / "model"))
    back = snapshots.load(spark, str(tmp_path / "model"))
    assert back.transform(df).exceptAll(model.transform(df)).count() == 0
    assert snapshots.nodes_table(spark, model).count() == len(model.trees[0].nodes)
    tree = snapshots.tree_export(model)
    root = tree["nodes"][0]
    assert len(root["bin_to_partition"]) == len(root["thresholds"]) + 1 and root["nan_partition"] is not None
    dot = explain.export_graphviz(model, df=df, out_file=str(tmp_path / "t.dot"))
    assert dot.startswith("digraph") and (tmp_path / "t.dot").read_text() == dot
    assert len(explain.layout(model)) == len(model.trees[0].nodes)
    assert explain.panel_histogram(df, model, 0).agg(F.sum("n")).first()[0] == 300


def test_streaming_scores_equal_batch(spark, tmp_path):
    df = datasets.make_plus(spark, 200, random_state=5).withColumn("ts", F.timestamp_seconds(F.col("row_id")))
    model = ShapeTreeClassifier(max_depth=2).fit(df, ["x0", "x1"], "y")
    df.write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    for frame, name in ((score_stream(stream(), model), "scored"), (windowed_predictions(stream(), model, "ts", "60 seconds", "10 seconds"), "windowed")):
        q = frame.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(60)
    assert spark.table("scored").drop("nothing").exceptAll(model.transform(df)).count() == 0
    assert spark.table("windowed").count() > 0


def test_discretizer(spark):
    df = datasets.make_plus(spark, 300, random_state=6)
    one = ShapeDiscretizer("gini", max_leaf_nodes=3).fit(df, ["x0"], "y")
    assert one.n_bins == 4 and one.transform(df).select("bin").distinct().count() == 3
    assert one.bin_weights.sum() == 300 and len(one.bin_predictions()) == 4
    two = ShapeDiscretizer("gini", max_leaf_nodes=5).fit(df, ["x0", "x1"], "y")
    assert two.transform(df).groupBy("bin").count().count() == two.n_bins
    for c in ("squared_error", "absolute_error"):
        assert ShapeDiscretizer(c, max_leaf_nodes=3).fit(df, ["x0"], "y").n_bins >= 2


def test_input_checks(spark, strict):
    ok = spark.createDataFrame([(1.0, 0, 1.0), (2.0, 1, 1.0)], "x double, y int, w double")
    for bad in (spark.createDataFrame([(1e39, 0, 1.0)], ok.schema), spark.createDataFrame([(math.inf, 0, 1.0)], ok.schema), spark.createDataFrame([], ok.schema), spark.createDataFrame([(1.0, None, 1.0)], ok.schema), spark.createDataFrame([(1.0, 0, -1.0)], ok.schema), spark.createDataFrame([(1.0, 0, 0.0)], ok.schema)):
        with pytest.raises(ValueError):
            ShapeTreeClassifier(**strict).fit(bad, ["x"], "y", weight="w")
    with pytest.raises(ValueError):
        ShapeTreeRegressor(**strict).fit(spark.createDataFrame([(1.0, math.nan)], "x double, y double"), ["x"], "y")
    model = ShapeTreeClassifier(**strict).fit(ok, ["x"], "y")
    with pytest.raises(ValueError):
        model.transform(ok.drop("x"))
    with pytest.raises(ValueError):
        ShapeTreeClassifier(class_weight={7: 1.0}, **strict).fit(ok, ["x"], "y")
    with pytest.raises(TypeError):
        ShapeTreeClassifier(depth=3)
    with pytest.warns(UserWarning):
        ShapeTreeRegressor(criterion="mae", **strict | {"num_partitions": 3}).fit(ok, ["x"], "y")


def test_many_values_are_cut_into_quantiles_if_asked(spark):
    df = spark.range(3000).select((F.col("id") * 1.0).alias("x"), (F.col("id") > 1500).cast("int").alias("y"))
    model = ShapeTreeClassifier(max_distinct=500, quantile_bins=64).fit(df, ["x"], "y")
    assert model.score(df) > 0.97
    assert ShapeTreeClassifier(max_distinct=500).fit(df, ["x"], "y").score(df) == 1.0


def same_trees(a, b):
    assert a.trees.keys() == b.trees.keys()
    for t in a.trees:
        left, right = a.trees[t].nodes, b.trees[t].nodes
        assert len(left) == len(right)
        for m, n in zip(left, right):
            for name in ("kind", "logical", "categories", "bin_to_partition", "children", "n", "bin_n", "depth", "retained_pairs"):
                assert m[name] == n[name], (name, m[name], n[name])
            assert m["thresholds"] == pytest.approx(n["thresholds"]) and m["mass"] == pytest.approx(n["mass"]) and m["raw_gain"] == pytest.approx(n["raw_gain"], abs=1e-7)
            assert [{k: v for k, v in e.items() if k != "missing"} for e in m["pair_tree"]] == [{k: v for k, v in e.items() if k != "missing"} for e in n["pair_tree"]]


def wide_table(spark):
    rng = np.random.default_rng(11)
    rows = []
    for i in range(400):
        a, b = float(rng.normal()), float(rng.integers(0, 40))
        rows.append((a if i % 11 else None, b, "uvwz"[i % 4] if i % 13 else None, int((a > 0) ^ (b > 20)), a * 3 + (b % 7), float(1 + i % 3), int(b > 10)))
    return spark.createDataFrame(rows, "a double, b double, c string, y int, v double, w double, z int")


@pytest.mark.parametrize("made, target, more, again", [
    (ShapeTreeClassifier, "y", {"criterion": "entropy", "num_partitions": 3, "pairwise_candidates": 2, "max_depth": 1}, True),
    (ShapeTreeRegressor, "v", {"pairwise_candidates": 1, "max_leaf_nodes": 3, "inner_min_samples_leaf": 20, "inner_max_leaf_nodes": 3}, True),
    (ShapeTreeClassifier, ["y", "z"], {"inner_max_depth": 2, "inner_max_leaf_nodes": None, "max_depth": 1}, False),
])
def test_range_pieces_find_the_same_trees(spark, monkeypatch, made, target, more, again):
    monkeypatch.setattr(wide, "PIECES", 5)
    df = wide_table(spark).cache()
    fit = lambda most: made(min_impurity_decrease=0.0, max_distinct=most, **more).fit(df, ["a", "b", "c"], target, weight="w")
    one, pieces = fit(1 << 20), fit(2)
    same_trees(one, pieces)
    if again:
        same_trees(refine(one, df, weight="w", lambda_=0.0), refine(pieces, df, weight="w", lambda_=0.0))


def test_range_pieces_find_the_same_bins(spark, monkeypatch):
    monkeypatch.setattr(wide, "PIECES", 5)
    df = wide_table(spark).cache()
    for columns, criterion, target in ((["a"], "gini", "y"), (["a", "c"], "squared_error", "v")):
        one, pieces = (ShapeDiscretizer(criterion, max_leaf_nodes=4, max_distinct=most).fit(df, columns, target, weight="w") for most in (1 << 20, 2))
        assert one.bins.thresholds == pytest.approx(pieces.bins.thresholds) and one.bins.sums.n.tolist() == pieces.bins.sums.n.tolist()
        assert np.allclose(one.bin_statistics, pieces.bin_statistics)


@pytest.mark.parametrize("parts", [1, 4, 7])
def test_cuts_do_not_depend_on_partitions(spark, tiny, parts):
    part = spark.read.parquet(f"{tiny}/part.parquet").withColumn("mirrored", F.abs(F.col("p_partkey") - 100.5)).repartition(parts)
    cells = part.groupBy(F.lit(0).alias("g"), F.col("p_partkey").cast("double").alias("x")).agg(F.count(F.lit(1)).alias("n"), F.count(F.lit(1)).cast("double").alias("w"), F.sum(F.col("mirrored") * 1e6).alias("wy"), F.sum(F.col("mirrored") * F.col("mirrored") * 1e12).alias("wyy"))
    found = cuts.best_cuts(cells, ["g"], "squared_error", [["wy", "wyy"]], 1, parts).first()
    x, y = (np.array(v, float) for v in zip(*sorted((r["p_partkey"], r["mirrored"]) for r in part.select("p_partkey", "mirrored").collect())))
    loss = [((y[:k] - y[:k].mean()) ** 2).sum() + ((y[k:] - y[k:].mean()) ** 2).sum() for k in range(1, len(y))]
    first = next(k for k, v in enumerate(loss, 1) if v <= min(loss) * (1 + 1e-11))
    assert found["threshold"] == (x[first - 1] + x[first]) / 2


def test_batches_score_as_expressions_do(spark, monkeypatch):
    from arborspan.operators import estimators

    df = datasets.make_plus(spark, 200, random_state=7).withColumn("c", F.when(F.col("row_id") % 3 == 0, "u").when(F.col("row_id") % 3 == 1, "v")).withColumn("x0", F.when(F.col("row_id") % 11 != 0, F.col("x0")))
    for made in (ShapeForestClassifier(n_estimators=3, max_depth=3, random_state=1, row_id="row_id", pairwise_candidates=1), ShapeForestRegressor(n_estimators=3, max_depth=3, random_state=1, row_id="row_id")):
        model = made.fit(df, ["x0", "x1", "c"], "y")
        plain = {r["row_id"]: r for r in model.transform(df).collect()}
        monkeypatch.setattr(estimators, "EXPRESSION_NODES", 1)
        for r in model.transform(df).collect():
            assert r["prediction"] == pytest.approx(plain[r["row_id"]]["prediction"])
        monkeypatch.undo()


def test_panels(spark, strict):
    rows = [(float(a), float(b), "uvw"[k % 3], int(a * b < 0)) for k, ((a, b), n) in enumerate(zip([(-1, -1), (-1, 1), (1, -1), (1, 1)], [40, 30, 30, 28])) for _ in range(n)]
    df = spark.createDataFrame(rows, "x0 double, x1 double, c string, y int")
    model = ShapeTreeClassifier(**strict | {"pairwise_candidates": 1}).fit(df, ["x0", "x1"], "y")
    grid = explain.pair_heatmap(spark, model, 0, [(-2.0, 2.0), (-2.0, 2.0)], cells=2)
    assert grid.count() == 9
    same = grid.where("a is not null and b is not null").selectExpr("a * b < 0 as other", "child").distinct()
    assert same.count() == 2
    one = ShapeTreeClassifier(**strict | {"max_depth": 1}).fit(df, ["x0"], "y")
    panel = explain.numeric_panel(one, 0, -1.0, 1.0, columns=4)
    assert panel["strips"][0] != panel["strips"][-1] and panel["switches"] == [0.0]
    cat = ShapeTreeClassifier(**strict | {"max_depth": 1}).fit(df, ["c"], "y")
    assert [n for n, _ in explain.category_panel(cat, 0)] == ["u", "v", "w", "missing"]


def test_absolute_error_on_quantiles(spark):
    df = spark.range(3000).select((F.col("id") * 1.0).alias("x"), F.when(F.col("id") > 1500, 100.0 + F.col("id") % 50).otherwise(F.col("id") % 50).alias("y"))
    model = ShapeTreeRegressor(criterion="mae", max_depth=1, max_distinct=40, quantile_bins=50).fit(df, ["x"], "y")
    assert model.score(df) > 0.8
    exact = ShapeTreeRegressor(criterion="mae", max_depth=1).fit(df, ["x"], "y")
    assert exact.score(df) > 0.9
    assert refine(exact, df, lambda_=0.0).score(df) >= exact.score(df) - 1e-6


def test_features_of_a_node_may_be_picked_by_a_function(spark):
    df = datasets.make_plus(spark, 300, random_state=8)
    model = ShapeTreeClassifier(max_depth=2, max_features=lambda n, rng: [1]).fit(df, ["x0", "x1"], "y")
    assert {f for n in model.trees[0].nodes for f in n["logical"]} == {1}
    assert snapshots.from_json(snapshots.to_json(model)).score(df) == model.score(df)


def picture_models(spark, strict):
    rows = [(float(a) if k % 9 else None, float(b), "uvw"[k % 3], int(a * b < 0), float(a * 3 + b)) for k, (a, b) in enumerate([(-1, -1)] * 40 + [(-1, 1)] * 30 + [(1, -1)] * 30 + [(1, 1)] * 28)]
    df = spark.createDataFrame(rows, "x0 double, x1 double, c string, y int, v double").cache()
    yield df, ShapeTreeClassifier(**strict | {"pairwise_candidates": 1, "max_depth": 2}).fit(df, ["x0", "x1"], "y")
    yield df, ShapeTreeClassifier(**strict | {"max_depth": 2}).fit(df, ["c", "x1"], "y")
    yield df, ShapeTreeRegressor(**strict | {"max_depth": 2, "num_partitions": 3}).fit(df, ["x0", "x1"], "v")


def test_graphs_are_well_formed(spark, strict):
    for df, model in picture_models(spark, strict):
        plain, full = explain.export_graphviz(model), explain.export_graphviz(model, df=df, filled=True, feature_names=["a<b", "c&d"])
        splits = [n for n in model.trees[0].nodes if not n["is_leaf"]]
        for text in (plain, full):
            labels = re.findall(r"label=<(.*)>\] ;", text)
            assert len(labels) == len(splits) and text.count("->") == sum(len(n["children"]) for n in splits)
            for label in labels:
                ElementTree.fromstring(label)
        assert full.count("fillcolor") == len(model.trees[0].nodes) - len(splits)
        assert len(full) > len(plain)  # the bars
        counts = explain.node_histograms(df, model, 0, explain.node_spans(df, model, 0))
        reach = {r["node_id"]: r["n"] for r in model.reach_counts(df).collect()}
        assert all(own.sum() == reach[k] for (k, _), own in counts.items())


def test_drawings_use_what_matplotlib_offers(spark, strict, monkeypatch):
    from unittest.mock import MagicMock

    pyplot = MagicMock()
    monkeypatch.setitem(sys.modules, "matplotlib", MagicMock(pyplot=pyplot))
    monkeypatch.setitem(sys.modules, "matplotlib.pyplot", pyplot)
    for df, model in picture_models(spark, strict):
        ax = MagicMock()
        assert explain.plot_tree(model, df=df, filled=True, ax=ax) is ax
        splits = [n for n in model.trees[0].nodes if not n["is_leaf"]]
        assert ax.inset_axes.call_count == len(splits)
        arrows = [c for c in ax.annotate.call_args_list if "arrowprops" in c.kwargs]
        assert len(arrows) == len(model.trees[0].nodes) - 1
        assert explain.plot_tree(model, max_depth=0, ax=MagicMock()) is not None


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.floats(0, 200), st.text("0123456789.", min_size=1, max_size=8)), max_size=12))
def test_packed_labels_do_not_overlap(labels):
    placed = explain.pack_labels(labels, 200.0, 5.0)
    assert [t for _, _, t in placed] == [t for _, t in labels]
    for i, (row, start, text) in enumerate(placed):
        assert 0 <= start and start + 5 * len(text) <= 200 + 1e-9
        for other, begin, name in placed[:i]:
            assert other != row or start >= begin + 5 * len(name) + 5 - 1e-9 or begin >= start + 5 * len(text) + 5 - 1e-9


def test_boxes_of_a_pair_hold_just_the_rows_of_their_bin(spark, strict):
    for df, model in picture_models(spark, strict):
        for node in (n for n in model.trees[0].nodes if n["kind"] == "pair"):
            boxes = explain.pair_boxes(node, model)
            for a in (-1.5, -1.0, 0.0, 1.0, None):
                for b in (-1.5, -1.0, 0.0, 1.0, None):
                    x = {f: v for f, v in zip(node["logical"], (a, b))}
                    fits = [k for k, box in boxes if all((x[c.feature] is None) if c.missing else x[c.feature] is not None and c.low < x[c.feature] <= c.high for c in box.conditions)]
                    want = route_pair(node["pair_tree"], np.array([[np.nan if a is None else a, np.nan if b is None else b]]))[0]
                    assert set(fits) == {want}
