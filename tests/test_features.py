import pytest

from arborspan.functions.features import configure_features, features_from_json, features_json, features_of, value_column
from arborspan.functions.params import TreeParams, feature_count, pair_budget, suggest_params, suggested_params
from arborspan.functions.criteria import parse_criterion
from arborspan.operators.sampling import bootstrap_size, tree_seeds


def names(fs):
    return [(f.name, f.kind, f.columns) for f in fs]


def test_unnamed_columns_are_continuous_and_named_by_position():
    assert names(configure_features(["a", "b"])) == [("0", "continuous", ("a",)), ("1", "continuous", ("b",))]


def test_groups_names_and_order():
    got = configure_features([f"c{i}" for i in range(12)], {"z": [0, 1], 5: "c2"})
    assert got[-1].name == "z" and got[-1].kind == "onehot"
    assert [f.name for f in got][:3] == ["10", "11", "3"]
    assert "5" in [f.name for f in got] and "5_1" in [f.name for f in got]


@pytest.mark.parametrize("bad", [{"a": 9}, {"a": "nope"}, {"a": True}, {"a": [0, 0]}, {"a": 0, "b": 0}, {"1": 0, 1: 1}, {"a": {"type": "odd", "indices": [0]}}, {"a": []}, {"a": {"type": "numeric", "indices": [0, 1]}}])
def test_bad_groups_are_refused(bad):
    with pytest.raises(ValueError):
        configure_features(["x", "y"], bad)


def test_ambiguous_name():
    with pytest.raises(ValueError):
        configure_features(["x", "x"], {"a": "x"})


def test_string_column_is_a_category_block(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,)], "s string")
    f, = features_of(df, ["s"])
    assert f.kind == "label" and f.categories == ("a", "b") and f.name == "s"
    assert [r[0] for r in df.select(value_column(f)).collect()] == [1.0, 0.0, None]
    assert features_from_json(features_json([f])) == [f]


def test_onehot_value_is_the_first_set_column(spark):
    df = spark.createDataFrame([(0.0, 1.0), (0.7, 1.0), (0.0, 0.2), (float("nan"), 1.0)], "a double, b double")
    f, = configure_features(["a", "b"], {"g": ["a", "b"]})
    assert [r[0] for r in df.select(value_column(f)).collect()] == [1.0, 0.0, None, 1.0]


def test_parameter_checks():
    for bad in ({"min_impurity_decrease": -1}, {"num_partitions": 1}, {"pairwise_penalty": float("nan")}, {"tao_n_runs": -1}, {"branching_penalty": True}, {"criterion": "odd"}):
        with pytest.raises(ValueError):
            TreeParams(**bad).checked(True)
    assert TreeParams(criterion=" Log_Loss ").checked(True).criterion == "entropy"
    assert parse_criterion("friedman_mse", False) == "squared_error"


def test_feature_count_and_budget():
    assert [feature_count(v, 9) for v in (None, 0, 3, 20, 0.5, "sqrt", "log2")] == [9, 9, 3, 9, 4, 3, 3]
    for bad in ("odd", -1, 1.5, True):
        with pytest.raises(ValueError):
            feature_count(bad, 9)
    assert pair_budget(0.25, 9) == 3 and pair_budget(2, 9) == 2


def test_bootstrap_arithmetic():
    assert bootstrap_size(10, None) == 10 and bootstrap_size(10, 3) == 3 and bootstrap_size(10, 0.25) == 2 and bootstrap_size(10, 0.01) == 1
    for bad in (0, 11, 1.5, True):
        with pytest.raises(ValueError):
            bootstrap_size(10, bad)
    assert tree_seeds(0, 2) == tree_seeds(0, 2)


def test_search_space():
    two, three = suggested_params(use_tao=True, use_bivariate=True)
    assert two["num_partitions"] == [2] and "branching_penalty" in three and two["tao_pair_scale"] == [1.5, 1.75, 2.0]

    class Trial:
        def suggest_int(self, name, low, high, log=False):
            return high

        def suggest_float(self, name, low, high, log=False):
            return low

        def suggest_categorical(self, name, choices):
            return choices[0]

    got = suggest_params(Trial(), use_tao=True, use_bivariate=True)
    TreeParams(**got).checked(True)
    assert got["num_partitions"] == 3 and got["tao_lambda"] == 1e-4
