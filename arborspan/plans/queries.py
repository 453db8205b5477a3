"""The registered queries of trees and their parts, each with its DuckDB SQL.

Every query works on whole tables. Tree queries use no growth cost, so that the
nearly independent columns of the tables still split.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import criteria as C
from ..functions import targets as Y
from ..functions.features import Feature, narrow
from ..functions.params import TreeParams
from ..operators import explain, growth
from ..operators.discretizer import ShapeDiscretizer
from ..operators.estimators import ShapeForestClassifier, ShapeForestRegressor, ShapeTreeClassifier, ShapeTreeRegressor, TreeModel
from ..operators.refine import refine
from ..operators.inner import Loss
from ..operators.sampling import bootstrap, tree_seeds
from ..sources import datasets, snapshots
from . import cuts, routing
from .prefix import in_pieces

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Parameters under which nothing but the data stops growth.
FREE = {"min_samples_leaf": 1, "min_impurity_decrease": 0.0, "inner_min_samples_leaf": 1, "inner_min_impurity_decrease": 0.0}
#: Two-way cuts only: inner trees of one split.
STUMPS = FREE | {"inner_max_depth": 1}
NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# ------------------------------------------------------- targets and weights


@query("SELECT label, (row_number() OVER (ORDER BY label) - 1)::INTEGER AS code FROM (SELECT DISTINCT l_returnflag AS label FROM lineitem)")
def label_dictionary(spark, sf_dir):
    return Y.label_codes(read(spark, sf_dir, "lineitem"), "l_returnflag")


@query("""
SELECT l_linestatus AS status, (CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END)::INTEGER AS code, l_returnflag AS decoded, count(*) AS n
FROM lineitem GROUP BY ALL""")
def label_encode(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem")
    classes = Y.label_dictionary(df, "l_returnflag")
    coded = df.select(F.col("l_linestatus").alias("status"), Y.encode("l_returnflag", classes).alias("code"))
    return coded.withColumn("decoded", Y.decode(F.col("code"), classes)).groupBy("status", "code", "decoded").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT l_returnflag AS flag, round(sum(l_quantity::FLOAT::DOUBLE * CASE l_returnflag WHEN 'R' THEN 2.0 WHEN 'A' THEN 0.5 ELSE 1.0 END), 4) AS mass
FROM lineitem GROUP BY ALL""")
def class_weighted_mass(spark, sf_dir):
    w = Y.effective_weight(Y.weight_column("l_quantity"), ["l_returnflag"], [{"R": 2.0, "A": 0.5}])
    return rounded(read(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(F.sum(w).alias("mass")), "mass", digits=4)


@query("""
SELECT l_returnflag AS flag, l_linestatus AS status,
  round(sum(l_quantity::FLOAT::DOUBLE * (CASE l_returnflag WHEN 'R' THEN 2.0 ELSE 1.0 END) * (CASE l_linestatus WHEN 'F' THEN 0.25 ELSE 1.0 END)), 4) AS mass
FROM lineitem GROUP BY ALL""")
def effective_weight_multioutput(spark, sf_dir):
    w = Y.effective_weight(Y.weight_column("l_quantity"), ["l_returnflag", "l_linestatus"], [{"R": 2.0}, {"F": 0.25}])
    out = read(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status")).agg(F.sum(w).alias("mass"))
    return rounded(out, "mass", digits=4)


@query("""
WITH t AS (SELECT o_totalprice AS y, 1.0 + o_custkey % 3 AS w, o_orderpriority AS p FROM orders),
m AS (SELECT sum(w * y) / sum(w) AS mean FROM t),
v AS (SELECT any_value(mean) AS mean, sqrt(sum(w * (y - mean) * (y - mean)) / sum(w)) AS scale FROM t, m)
SELECT p AS priority, round(avg((y - mean) / scale), 6) AS avg_z, round(avg((y - mean) / scale * scale + mean), 4) AS avg_back FROM t, v GROUP BY ALL""")
def standardize_target_weighted(spark, sf_dir):
    df = read(spark, sf_dir, "orders").select(F.col("o_totalprice").alias("y"), (F.lit(1.0) + F.col("o_custkey") % 3).alias("w"), F.col("o_orderpriority").alias("priority"))
    (mean, scale), = Y.standardisation(df, ["y"], "w")
    z = (F.col("y") - F.lit(mean)) / F.lit(scale)
    return df.groupBy("priority").agg(F.round(F.avg(z), 6).alias("avg_z"), F.round(F.avg(z * F.lit(scale) + F.lit(mean)), 4).alias("avg_back"))


# --------------------------------------------------------- node statistics


def _flag_sums(df: DataFrame, keys: list[str]) -> DataFrame:
    w = F.col("l_quantity")
    return df.groupBy(*keys).agg(*[F.sum(F.when(F.col("l_returnflag") == c, w).otherwise(F.lit(0.0))).alias(f"w_{c.lower()}") for c in "ANR"])


_FLAGS = "sum(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0 END) AS w_a, sum(CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE 0 END) AS w_n, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS w_r"
_SHARES = "w_a / (w_a + w_n + w_r) AS a, w_n / (w_a + w_n + w_r) AS n, w_r / (w_a + w_n + w_r) AS r"


@query(f"SELECT l_linestatus AS node, {_FLAGS} FROM lineitem GROUP BY ALL")
def node_histogram(spark, sf_dir):
    return _flag_sums(read(spark, sf_dir, "lineitem").withColumnRenamed("l_linestatus", "node"), ["node"])


@query(f"SELECT node, round(1 - a * a - n * n - r * r, 9) AS gini FROM (SELECT node, {_SHARES} FROM (SELECT l_linestatus AS node, {_FLAGS} FROM lineitem GROUP BY ALL))")
def node_gini(spark, sf_dir):
    return node_histogram(spark, sf_dir).select("node", F.round(C.gini_column([F.col(c) for c in ("w_a", "w_n", "w_r")]), 9).alias("gini"))


@query(f"SELECT node, round(-(a * log2(a) + n * log2(n) + r * log2(r)), 9) AS entropy FROM (SELECT node, {_SHARES} FROM (SELECT l_linestatus AS node, {_FLAGS} FROM lineitem GROUP BY ALL))")
def node_entropy(spark, sf_dir):
    return node_histogram(spark, sf_dir).select("node", F.round(C.entropy_column([F.col(c) for c in ("w_a", "w_n", "w_r")]), 9).alias("entropy"))


@query("SELECT l_linestatus AS node, sum(l_quantity) AS w, round(sum(l_quantity * l_tax), 6) AS wy, round(sum(l_quantity * l_tax * l_tax), 6) AS wyy FROM lineitem GROUP BY ALL")
def node_moments(spark, sf_dir):
    w, y = F.col("l_quantity"), F.col("l_tax")
    out = read(spark, sf_dir, "lineitem").groupBy(F.col("l_linestatus").alias("node")).agg(F.sum(w).alias("w"), F.sum(w * y).alias("wy"), F.sum(w * y * y).alias("wyy"))
    return rounded(out, "wy", "wyy")


@query("""
SELECT node, round(sum(w * (y - mean) * (y - mean)) / sum(w), 9) AS mse
FROM (SELECT l_linestatus AS node, l_quantity AS w, l_tax AS y, sum(l_quantity * l_tax) OVER p / sum(l_quantity) OVER p AS mean FROM lineitem WINDOW p AS (PARTITION BY l_linestatus))
GROUP BY ALL""")
def node_mse(spark, sf_dir):
    w, y = F.col("l_quantity"), F.col("l_tax")
    sums = read(spark, sf_dir, "lineitem").groupBy(F.col("l_linestatus").alias("node")).agg(F.sum(w).alias("w"), F.sum(w * y).alias("wy"), F.sum(w * y * y).alias("wyy"))
    return sums.select("node", F.round(C.squared_error_column(F.col("w"), F.col("wy"), F.col("wyy")), 9).alias("mse"))


@query("""
WITH c AS (SELECT l_returnflag AS flag, l_linestatus AS status, l_extendedprice AS y, sum(l_quantity) AS w FROM lineitem GROUP BY ALL),
r AS (SELECT *, sum(w) OVER (PARTITION BY flag, status ORDER BY y) AS cum, sum(w) OVER (PARTITION BY flag, status) / 2 AS half, lag(y) OVER (PARTITION BY flag, status ORDER BY y) AS prev FROM c),
m AS (SELECT flag, status, CASE WHEN abs(cum - w - half) <= 1e-12 AND prev IS NOT NULL THEN (prev + y) / 2 ELSE y END AS median FROM r WHERE cum > half AND cum - w <= half)
SELECT flag, status, median, round(sum(w * abs(y - median)) / sum(w), 6) AS mae FROM c JOIN m USING (flag, status) GROUP BY ALL""")
def weighted_median_mae(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), "l_extendedprice", "l_quantity")
    return rounded(C.weighted_median(df, ["flag", "status"], "l_extendedprice", "l_quantity"), "mae")


# ------------------------------------------------------------------- cuts


def _long(df: DataFrame, columns: list[str], keep: list[str]) -> DataFrame:
    cell = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), narrow(c).alias("x")) for c in columns]))
    return df.select(cell.alias("c"), *keep).select("c.feature", "c.x", *keep)


def _class_cells(df: DataFrame, group: list[str], codes: dict[str, int]) -> DataFrame:
    """Cells with class counts ``s_<column>_<code>`` for 0/1.. code columns."""
    aggs = [F.count(F.lit(1)).alias("n"), F.count(F.lit(1)).cast("double").alias("w")]
    aggs += [F.sum(F.when(F.col(y) == k, 1.0).otherwise(0.0)).alias(f"s_{y}_{k}") for y, n in codes.items() for k in range(n)]
    return df.groupBy(*group, "x").agg(*aggs)


def _moment_cells(df: DataFrame, group: list[str], y: str) -> DataFrame:
    return df.groupBy(*group, "x").agg(F.count(F.lit(1)).alias("n"), F.count(F.lit(1)).cast("double").alias("w"), F.sum(y).alias("wy"), F.sum(F.col(y) * F.col(y)).alias("wyy"))


def _about_mean(df: DataFrame, y: str) -> DataFrame:
    """``df`` with ``y`` less its mean, which changes no squared error but leaves
    the squares' sums of many rows their decimals."""
    mean = df.agg(F.avg(y).alias("__mean"))  # one row
    return df.crossJoin(F.broadcast(mean)).withColumn(y, F.col(y) - F.col("__mean")).drop("__mean")


def _sql_long(columns: list[str], table: str, keep: str) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS feature, {c}::FLOAT::DOUBLE AS x, {keep} FROM {table}" for c in columns)


def _sql_cut(long: str, sums: list[str], loss: str, min_leaf: int = 1) -> str:
    """SQL of the best cut; ``loss`` is in ``l_``, ``r_`` sums, ``ln`` and ``rn`` rows."""
    inside = ", ".join(f"sum({s}) AS {s}" for s in sums)
    run = ", ".join(f"sum({s}) OVER u AS l_{s}, sum({s}) OVER a - sum({s}) OVER u AS r_{s}" for s in sums)
    return f"""
WITH long AS ({long}),
cells AS (SELECT feature, x, count(*) AS n, {inside} FROM long WHERE x IS NOT NULL GROUP BY ALL),
run AS (SELECT feature, x, lead(x) OVER u AS nx, sum(n) OVER u AS ln, sum(n) OVER a - sum(n) OVER u AS rn, {run} FROM cells
  WINDOW u AS (PARTITION BY feature ORDER BY x ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY feature)),
scored AS (SELECT feature, x, x / 2 + nx / 2 AS threshold, ln::BIGINT AS n_left, rn::BIGINT AS n_right, {loss} AS loss FROM run
  WHERE nx IS NOT NULL AND nx::FLOAT > x::FLOAT + 1e-7::FLOAT AND ln >= {min_leaf} AND rn >= {min_leaf})
SELECT feature, threshold, round(loss, 4) AS loss, n_left, n_right FROM scored
QUALIFY row_number() OVER (PARTITION BY feature ORDER BY round(loss, 9), x) = 1"""


_IS_R = "CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS r1, CASE WHEN l_returnflag = 'R' THEN 0.0 ELSE 1.0 END AS r0"
_GINI = "ln * (1 - (l_r0 / ln) * (l_r0 / ln) - (l_r1 / ln) * (l_r1 / ln)) + rn * (1 - (r_r0 / rn) * (r_r0 / rn) - (r_r1 / rn) * (r_r1 / rn))"
_ENTROPY = "-" + " - ".join(f"(CASE WHEN {s}_r{k} > 0 THEN {s}_r{k} * log2({s}_r{k} / {s}n) ELSE 0 END)" for s in "lr" for k in "01")
_MSE = "(l_wyy - l_wy * l_wy / ln) + (r_wyy - r_wy * r_wy / rn)"


def _flag_cells(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem").withColumn("r", (F.col("l_returnflag") == "R").cast("int"))
    return _class_cells(_long(df, NUMBERS, ["r"]), ["feature"], {"r": 2})


def _cut(cells, kind, outputs, min_leaf=1, pieces=8):
    return rounded(cuts.best_cuts(cells, ["feature"], kind, outputs, min_leaf, pieces), "loss", digits=4)


@query(_sql_cut(_sql_long(NUMBERS, "lineitem", _IS_R), ["r0", "r1"], _GINI))
def best_cut_gini(spark, sf_dir):
    return _cut(_flag_cells(spark, sf_dir), "gini", [["s_r_0", "s_r_1"]])


@query(_sql_cut(_sql_long(NUMBERS, "lineitem", _IS_R), ["r0", "r1"], _ENTROPY))
def best_cut_entropy(spark, sf_dir):
    return _cut(_flag_cells(spark, sf_dir), "entropy", [["s_r_0", "s_r_1"]])


@query(_sql_cut(_sql_long(NUMBERS, "lineitem", _IS_R), ["r0", "r1"], _GINI, 1000))
def best_cut_minleaf(spark, sf_dir):
    return _cut(_flag_cells(spark, sf_dir), "gini", [["s_r_0", "s_r_1"]], 1000)


@query(_sql_cut(_sql_long(["p_size", "p_partkey"], "part", "p_retailprice AS wy, p_retailprice * p_retailprice AS wyy"), ["wy", "wyy"], _MSE))
def best_cut_mse(spark, sf_dir):
    df = _about_mean(read(spark, sf_dir, "part").select("p_size", "p_partkey", "p_retailprice"), "p_retailprice")
    return _cut(_moment_cells(_long(df, ["p_size", "p_partkey"], ["p_retailprice"]), ["feature"], "p_retailprice"), "squared_error", [["wy", "wyy"]])


_TWO = _IS_R + ", CASE WHEN l_linestatus = 'F' THEN 1.0 ELSE 0.0 END AS f1, CASE WHEN l_linestatus = 'F' THEN 0.0 ELSE 1.0 END AS f0"


@query(_sql_cut(_sql_long(["l_quantity", "l_discount", "l_tax"], "lineitem", _TWO), ["r0", "r1", "f0", "f1"], _GINI + " + " + _GINI.replace("_r0", "_f0").replace("_r1", "_f1")))
def best_cut_multioutput(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem").withColumn("r", (F.col("l_returnflag") == "R").cast("int")).withColumn("f", (F.col("l_linestatus") == "F").cast("int"))
    names = ["l_quantity", "l_discount", "l_tax"]
    return _cut(_class_cells(_long(df, names, ["r", "f"]), ["feature"], {"r": 2, "f": 2}), "gini", [["s_r_0", "s_r_1"], ["s_f_0", "s_f_1"]])


@query("""
WITH c AS (SELECT o_custkey::FLOAT::DOUBLE AS x, sum(o_totalprice - 150000) AS g, count(*)::DOUBLE AS h FROM orders GROUP BY ALL),
r AS (SELECT x, lead(x) OVER u AS nx, sum(g) OVER u AS lg, sum(h) OVER u AS lh, sum(g) OVER () AS tg, sum(h) OVER () AS th FROM c WINDOW u AS (ORDER BY x ROWS UNBOUNDED PRECEDING)),
s AS (SELECT x, x / 2 + nx / 2 AS threshold, lg * lg / (lh + 1) + (tg - lg) * (tg - lg) / (th - lh + 1) - tg * tg / (th + 1) AS gain FROM r WHERE nx IS NOT NULL)
SELECT threshold, round(gain / 1e6, 2) AS gain_m FROM s ORDER BY round(gain / 1e6, 2) DESC, x LIMIT 1""")
def best_cut_gain_hessian(spark, sf_dir):
    df = read(spark, sf_dir, "orders").select(narrow("o_custkey").alias("x"), (F.col("o_totalprice") - 150000).alias("g"))
    cells = df.groupBy("x").agg(F.sum("g").alias("g"), F.count(F.lit(1)).cast("double").alias("h")).withColumn("one", F.lit(1))
    run = in_pieces(cells, ["one"], "x", ["g", "h"], 8).withColumnsRenamed({"l_g": "lg", "l_h": "lh", "t_g": "tg", "t_h": "th"})
    l2 = F.lit(1.0)
    gain = C.gain_hessian_column(F.col("lg"), F.col("lh"), l2) + C.gain_hessian_column(F.col("tg") - F.col("lg"), F.col("th") - F.col("lh"), l2) - C.gain_hessian_column(F.col("tg"), F.col("th"), l2)
    scored = run.where("nx is not null").select("x", (F.col("x") / 2 + F.col("nx") / 2).alias("threshold"), F.round(gain / 1e6, 2).alias("gain_m"))
    return scored.groupBy().agg(F.max_by("threshold", F.struct("gain_m", -F.col("x"))).alias("threshold"), F.max("gain_m").alias("gain_m"))


# --------------------------------------------------------------- categories

_ONE_VS_REST = """
WITH c AS ({cells}),
t AS (SELECT c.*, {totals} FROM c),
s AS (SELECT x AS category, n AS n_in, tn - n AS n_out, {loss} AS loss FROM t)
SELECT category, 0 AS with_missing, round(loss, 4) AS loss, n_in::BIGINT AS n_in, n_out::BIGINT AS n_out FROM s WHERE n_out >= 1 ORDER BY round(loss, 9), category LIMIT 1"""


@query(
    _ONE_VS_REST.format(
        cells="SELECT p_brand AS x, count(*) AS n, sum(CASE WHEN p_size > 25 THEN 1.0 ELSE 0.0 END) AS s1, sum(CASE WHEN p_size > 25 THEN 0.0 ELSE 1.0 END) AS s0 FROM part GROUP BY ALL",
        totals="sum(n) OVER () AS tn, sum(s0) OVER () AS t0, sum(s1) OVER () AS t1",
        loss="n * (1 - (s0 / n) * (s0 / n) - (s1 / n) * (s1 / n)) + (tn - n) * (1 - ((t0 - s0) / (tn - n)) * ((t0 - s0) / (tn - n)) - ((t1 - s1) / (tn - n)) * ((t1 - s1) / (tn - n)))",
    )
)
def best_category_gini(spark, sf_dir):
    df = read(spark, sf_dir, "part").select(F.col("p_brand").alias("x"), (F.col("p_size") > 25).cast("int").alias("y"), F.lit(1).alias("one"))
    return rounded(cuts.best_categories(_class_cells(df, ["one"], {"y": 2}), ["one"], "gini", [["s_y_0", "s_y_1"]]).drop("one"), "loss", digits=4)


@query(
    _ONE_VS_REST.format(
        cells="SELECT o_orderpriority AS x, count(*) AS n, sum(o_totalprice / 1000) AS wy, sum((o_totalprice / 1000) * (o_totalprice / 1000)) AS wyy FROM orders GROUP BY ALL",
        totals="sum(n) OVER () AS tn, sum(wy) OVER () AS ty, sum(wyy) OVER () AS tyy",
        loss="(wyy - wy * wy / n) + (tyy - wyy - (ty - wy) * (ty - wy) / (tn - n))",
    )
)
def best_category_mse(spark, sf_dir):
    df = read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("x"), (F.col("o_totalprice") / 1000).alias("y"), F.lit(1).alias("one"))
    return rounded(cuts.best_categories(_moment_cells(df, ["one"], "y"), ["one"], "squared_error", [["wy", "wyy"]]).drop("one"), "loss", digits=4)


_HOLED = "CASE WHEN event_id % 10 = 0 THEN NULL ELSE value::FLOAT::DOUBLE END"


@query(f"""
WITH base AS (SELECT {_HOLED} AS x, CASE WHEN event_type = 'click' THEN 1.0 ELSE 0.0 END AS y FROM events),
c AS (SELECT x, count(*) AS n, sum(y) AS s1, count(*) - sum(y) AS s0 FROM base WHERE x IS NOT NULL GROUP BY ALL),
m AS (SELECT count(*) AS mn, coalesce(sum(y), 0) AS m1, count(*) - coalesce(sum(y), 0) AS m0 FROM base WHERE x IS NULL),
r AS (SELECT x, lead(x) OVER u AS nx, sum(n) OVER u AS ln, sum(s1) OVER u AS l1, sum(s0) OVER u AS l0, sum(n) OVER () - sum(n) OVER u AS rn, sum(s1) OVER () - sum(s1) OVER u AS r1, sum(s0) OVER () - sum(s0) OVER u AS r0
  FROM c WINDOW u AS (ORDER BY x ROWS UNBOUNDED PRECEDING)),
p AS (SELECT x, nx, side AS missing_side, ln + (1 - side) * mn AS an, l1 + (1 - side) * m1 AS a1, l0 + (1 - side) * m0 AS a0, rn + side * mn AS bn, r1 + side * m1 AS b1, r0 + side * m0 AS b0 FROM r, m, (VALUES (0), (1)) v(side)),
s AS (SELECT *, an * (1 - (a0 / an) * (a0 / an) - (a1 / an) * (a1 / an)) + bn * (1 - (b0 / bn) * (b0 / bn) - (b1 / bn) * (b1 / bn)) AS loss FROM p WHERE an >= 4 AND bn >= 4)
SELECT x / 2 + nx / 2 AS threshold, missing_side, round(loss, 4) AS loss, an::BIGINT AS n_left, bn::BIGINT AS n_right FROM s ORDER BY round(loss, 9), x, missing_side LIMIT 1""")
def stump_with_missing(spark, sf_dir):
    df = read(spark, sf_dir, "events").select(F.when(F.col("event_id") % 10 != 0, narrow("value")).alias("x"), (F.col("event_type") == "click").cast("int").alias("y"), F.lit(1).alias("one"))
    return rounded(cuts.best_stumps(_class_cells(df, ["one"], {"y": 2}), ["one"], "gini", [["s_y_0", "s_y_1"]], 4).drop("one"), "loss", digits=4)


@query("""
WITH base AS (SELECT CASE WHEN event_id % 10 = 0 THEN NULL ELSE event_type END AS x, CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END AS y FROM events),
c AS (SELECT x, count(*) AS n, sum(y) AS s1, count(*) - sum(y) AS s0 FROM base WHERE x IS NOT NULL GROUP BY ALL),
m AS (SELECT count(*) AS mn, coalesce(sum(y), 0) AS m1, count(*) - coalesce(sum(y), 0) AS m0 FROM base WHERE x IS NULL),
t AS (SELECT count(*) AS tn, sum(y) AS t1, count(*) - sum(y) AS t0 FROM base),
p AS (SELECT x, side, n + side * mn AS an, s1 + side * m1 AS a1, s0 + side * m0 AS a0, tn, t1, t0 FROM c, m, t, (VALUES (0), (1)) v(side)),
s AS (SELECT *, an * (1 - (a0 / an) * (a0 / an) - (a1 / an) * (a1 / an)) + (tn - an) * (1 - ((t0 - a0) / (tn - an)) * ((t0 - a0) / (tn - an)) - ((t1 - a1) / (tn - an)) * ((t1 - a1) / (tn - an))) AS loss FROM p WHERE an >= 4 AND tn - an >= 4)
SELECT x AS category, side AS with_missing, round(loss, 4) AS loss, an::BIGINT AS n_in, (tn - an)::BIGINT AS n_out FROM s ORDER BY round(loss, 9), x, side LIMIT 1""")
def category_stump_with_missing(spark, sf_dir):
    df = read(spark, sf_dir, "events").select(F.when(F.col("event_id") % 10 != 0, F.col("event_type")).alias("x"), (F.col("value") > 50).cast("int").alias("y"), F.lit(1).alias("one"))
    return rounded(cuts.best_categories(_class_cells(df, ["one"], {"y": 2}), ["one"], "gini", [["s_y_0", "s_y_1"]], 4, missing_sides=True).drop("one"), "loss", digits=4)


# ---------------------------------------------------------------- routing


@query("SELECT (CASE WHEN p_size <= 10 THEN 0 WHEN p_size <= 20.5 THEN 1 WHEN p_size <= 40 THEN 2 ELSE 3 END)::INTEGER AS bin, count(*) AS n FROM part GROUP BY ALL")
def bin_lookup(spark, sf_dir):
    bins = routing.bin_column(narrow("p_size"), [10.0, 20.5, 40.0])
    return read(spark, sf_dir, "part").groupBy(bins.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


_NUMERIC_NODE = {"kind": "numeric", "logical": [0], "thresholds": [10.0, 20.5, 40.0], "categories": [], "bin_to_partition": [0, 1, 0, 1, 0], "children": [1, 2]}


@query("SELECT (CASE WHEN p_size <= 10 OR (p_size > 20.5 AND p_size <= 40) THEN 0 ELSE 1 END)::INTEGER AS child, count(*) AS n, round(avg(p_retailprice), 4) AS price FROM part GROUP BY ALL")
def bin_to_child(spark, sf_dir):
    child = routing.child_column(_NUMERIC_NODE, [narrow("p_size")])
    return read(spark, sf_dir, "part").groupBy(child.alias("child")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("p_retailprice"), 4).alias("price"))


@query("SELECT (CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 0 WHEN o_orderpriority = '5-LOW' THEN 1 ELSE 2 END)::INTEGER AS bin, count(*) AS n FROM orders GROUP BY ALL")
def category_bin_lookup(spark, sf_dir):
    df = read(spark, sf_dir, "orders")
    names = Y.label_dictionary(df, "o_orderpriority")
    code = F.coalesce(*[F.when(F.col("o_orderpriority") == c, F.lit(float(i))) for i, c in enumerate(names)])
    wanted = [[i for i, c in enumerate(names) if c in ("1-URGENT", "2-HIGH")], [i for i, c in enumerate(names) if c == "5-LOW"], [i for i, c in enumerate(names) if c not in ("1-URGENT", "2-HIGH", "5-LOW")]]
    return df.groupBy(routing.category_bin_column(code, wanted).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


_PAIR_TREE = [
    {"axis": 0, "kind": "continuous", "threshold": 25.0, "left": 1, "right": 2, "missing": 3, "bin": -1}, {"axis": 1, "kind": "continuous", "threshold": 0.05, "left": 4, "right": 5, "missing": 4, "bin": -1},
    {"axis": -1, "bin": 0}, {"axis": -1, "bin": 1}, {"axis": -1, "bin": 2}, {"axis": -1, "bin": 3},
]


@query("""
SELECT (CASE WHEN l_orderkey % 7 = 0 THEN 1 WHEN l_quantity > 25 THEN 0 WHEN l_discount::FLOAT::DOUBLE <= 0.05::DOUBLE THEN 2 ELSE 3 END)::INTEGER AS bin, count(*) AS n FROM lineitem GROUP BY ALL""")
def pair_route(spark, sf_dir):
    axes = (F.when(F.col("l_orderkey") % 7 != 0, narrow("l_quantity")), narrow("l_discount"))
    return read(spark, sf_dir, "lineitem").groupBy(routing.pair_bin_column(_PAIR_TREE, axes).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------- trees

def _sql_level(base: str, columns: list[str], kind: str, out: str) -> str:
    """CTEs that cut each node of ``base`` once: ``{out}_best`` and ``{out}``."""
    long = " UNION ALL ".join(f"SELECT node, {i} AS f, {c} AS x, y, w FROM {base}" for i, c in enumerate(columns))
    sums = "sum(w) AS sw, sum(w * y) AS sy, sum(w * y * y) AS syy"
    if kind == "gini":  # of a 0/1 target: 2 * sum of w*y times the rest over w
        loss = lambda a: f"2 * {a}y * ({a}w - {a}y) / nullif({a}w, 0)"
    else:
        loss = lambda a: f"({a}yy - {a}y * {a}y / nullif({a}w, 0))"
    return f"""
{out}_cells AS (SELECT node, f, x, count(*) AS n, {sums} FROM ({long}) GROUP BY ALL),
{out}_run AS (SELECT node, f, x, lead(x) OVER u AS nx, sum(sw) OVER u AS lw, sum(sy) OVER u AS ly, sum(syy) OVER u AS lyy,
  sum(sw) OVER a - sum(sw) OVER u AS rw, sum(sy) OVER a - sum(sy) OVER u AS ry, sum(syy) OVER a - sum(syy) OVER u AS ryy, sum(sw) OVER a AS tw, sum(sy) OVER a AS ty, sum(syy) OVER a AS tyy
  FROM {out}_cells WINDOW u AS (PARTITION BY node, f ORDER BY x ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY node, f)),
{out}_best AS (SELECT node, f, CASE WHEN x / 2 + nx / 2 = nx THEN x ELSE x / 2 + nx / 2 END AS cut, coalesce({loss('l')}, 0) + coalesce({loss('r')}, 0) AS loss, {loss('t')} AS whole FROM {out}_run
  WHERE nx IS NOT NULL QUALIFY row_number() OVER (PARTITION BY node ORDER BY round(loss, 7), f, x) = 1),
{out} AS (SELECT b.* EXCLUDE (node), CASE WHEN s.cut IS NULL OR whole - loss <= 2.3e-16 THEN b.node ELSE 2 * b.node + (CASE WHEN (CASE s.f {' '.join(f'WHEN {i} THEN {c}' for i, c in enumerate(columns))} END) <= s.cut THEN 1 ELSE 2 END) END AS node
  FROM {base} b LEFT JOIN {out}_best s ON b.node = s.node)"""


def _sql_tree(base: str, columns: list[str], kind: str, depth: int, select: str) -> str:
    parts, last = [f"b0 AS (SELECT 0 AS node, * FROM ({base}))"], "b0"
    for d in range(1, depth + 1):
        parts.append(_sql_level(last, columns, kind, f"b{d}"))
        last = f"b{d}"
    return "WITH " + ",".join(parts) + f"\n{select.format(last=last)}"


_PART_CLASS = "SELECT p_partkey, CASE WHEN p_retailprice > 912 AND p_retailprice < 960 THEN 1.0 ELSE 0.0 END AS y, 1.0::DOUBLE AS w, p_size::FLOAT::DOUBLE AS a, p_partkey::FLOAT::DOUBLE AS b FROM part"
_PART_PRICE = "SELECT p_partkey, p_retailprice AS y, 1.0::DOUBLE AS w, p_size::FLOAT::DOUBLE AS a, p_partkey::FLOAT::DOUBLE AS b FROM part"
_LEAVES = "SELECT count(*) AS n, round(avg(y), 6) AS rate FROM {last} GROUP BY node"


def _part(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "part").withColumn("dear", ((F.col("p_retailprice") > 912) & (F.col("p_retailprice") < 960)).cast("int"))


def _leaf_rates(model: TreeModel, df: DataFrame, y) -> DataFrame:
    return model.transform(df).groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(y), 6).alias("rate")).drop("leaf")


@query(_sql_tree(_PART_CLASS, ["a", "b"], "gini", 1, _LEAVES))
def tree_depth1_gini(spark, sf_dir):
    df = _part(spark, sf_dir)
    return _leaf_rates(ShapeTreeClassifier(**STUMPS | {"max_depth": 1}).fit(df, ["p_size", "p_partkey"], "dear"), df, F.col("dear").cast("double"))


@query(_sql_tree(_PART_CLASS, ["a", "b"], "gini", 2, _LEAVES))
def tree_depth2_gini(spark, sf_dir):
    df = _part(spark, sf_dir)
    return _leaf_rates(ShapeTreeClassifier(**STUMPS | {"max_depth": 2}).fit(df, ["p_size", "p_partkey"], "dear"), df, F.col("dear").cast("double"))


@query(_sql_tree(_PART_PRICE, ["a", "b"], "mse", 2, _LEAVES))
def tree_depth2_mse(spark, sf_dir):
    df = read(spark, sf_dir, "part")
    return _leaf_rates(ShapeTreeRegressor(**STUMPS | {"max_depth": 2}).fit(df, ["p_size", "p_partkey"], "p_retailprice"), df, F.col("p_retailprice"))


@query(_sql_tree("SELECT CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS y, l_quantity AS w, l_discount::FLOAT::DOUBLE AS a, l_tax::FLOAT::DOUBLE AS b FROM lineitem", ["a", "b"], "gini", 1, _LEAVES))
def tree_weighted(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem").withColumn("r", (F.col("l_returnflag") == "R").cast("int"))
    model = ShapeTreeClassifier(**STUMPS | {"max_depth": 1}).fit(df, ["l_discount", "l_tax"], "r", weight="l_quantity")
    return _leaf_rates(model, df, F.col("r").cast("double"))


@query(_sql_tree(_PART_CLASS, ["a", "b"], "gini", 2, "SELECT p_partkey, round(avg(y) OVER (PARTITION BY node), 6) AS p_dear, (CASE WHEN avg(y) OVER (PARTITION BY node) > 0.5 THEN 1 ELSE 0 END)::INTEGER AS predicted FROM {last}"))
def predict_class(spark, sf_dir):
    df = _part(spark, sf_dir)
    out = ShapeTreeClassifier(**STUMPS | {"max_depth": 2}).fit(df, ["p_size", "p_partkey"], "dear").transform(df)
    return out.select("p_partkey", F.round(F.col("probability")[1], 6).alias("p_dear"), F.col("prediction").cast("int").alias("predicted"))


@query(_sql_tree(_PART_CLASS, ["a", "b"], "gini", 2, "SELECT round(1 - rate, 6) AS p0, round(rate, 6) AS p1, count(*) AS n FROM (SELECT avg(y) OVER (PARTITION BY node) AS rate FROM {last}) GROUP BY ALL"))
def predict_proba(spark, sf_dir):
    df = _part(spark, sf_dir)
    p = ShapeTreeClassifier(**STUMPS | {"max_depth": 2}).fit(df, ["p_size", "p_partkey"], "dear").predict_proba(df)
    return p.groupBy(F.round(F.col("probability")[0], 6).alias("p0"), F.round(F.col("probability")[1], 6).alias("p1")).agg(F.count(F.lit(1)).alias("n"))


@query(_sql_tree(_PART_PRICE, ["a", "b"], "mse", 2, "SELECT p_partkey, round(avg(y) OVER (PARTITION BY node), 2) AS predicted FROM {last}"))
def predict_regression(spark, sf_dir):
    df = read(spark, sf_dir, "part")
    out = ShapeTreeRegressor(**STUMPS | {"max_depth": 2}).fit(df, ["p_size", "p_partkey"], "p_retailprice").transform(df)
    return out.select("p_partkey", F.round("prediction", 2).alias("predicted"))


@query(_sql_tree(_PART_CLASS, ["a", "b"], "gini", 2, """
, gains AS (SELECT f, whole - loss AS g FROM b1_best UNION ALL SELECT f, whole - loss FROM b2_best WHERE whole - loss > 2.3e-16)
SELECT feature, round(coalesce(sum(g), 0) / (SELECT sum(g) FROM gains), 6) AS importance FROM (VALUES (0, 'p_size'), (1, 'p_partkey')) v(f, feature) LEFT JOIN gains USING (f) GROUP BY ALL"""))
def feature_importance(spark, sf_dir):
    df = _part(spark, sf_dir)
    model = ShapeTreeClassifier(**STUMPS | {"max_depth": 2}).fit(df, ["p_size", "p_partkey"], "dear")
    names = [f.columns[0] for f in model.features]
    return spark.createDataFrame([(n, float(v)) for n, v in zip(names, model.feature_importances_)], "feature string, importance double").withColumn("importance", F.round("importance", 6))


@query(_sql_tree(_PART_CLASS, ["a", "b"], "gini", 1, "SELECT depth, count(*) AS n FROM (SELECT 0 AS depth, 0 AS node FROM {last} UNION ALL SELECT 1 AS depth, node FROM {last} WHERE node > 0) GROUP BY depth, node"))
def node_reach_counts(spark, sf_dir):
    df = _part(spark, sf_dir)
    model = ShapeTreeClassifier(**STUMPS | {"max_depth": 1}).fit(df, ["p_size", "p_partkey"], "dear")
    depth = F.element_at(F.array(*[F.lit(n["depth"]) for n in model.trees[0].nodes]), F.col("node_id") + 1)
    return model.reach_counts(df).select(depth.alias("depth"), "n")


@query("""
WITH s AS (SELECT min(value::FLOAT::DOUBLE) AS lo, max(value::FLOAT::DOUBLE) AS hi FROM events)
SELECT least(floor((value::FLOAT::DOUBLE - lo) / ((hi - lo) / 20)), 19)::INTEGER AS bucket, count(*) AS n FROM events, s GROUP BY ALL""")
def panel_histogram(spark, sf_dir):
    return explain.value_histogram(read(spark, sf_dir, "events").select(narrow("value").alias("x"))).select("bucket", "n")


@query("SELECT low, high, child FROM (VALUES (NULL::DOUBLE, 1.0::DOUBLE, 0), (1.0, 3.0, 1), (3.0, NULL, 0)) v(low, high, child)")
def merged_regions(spark, sf_dir):
    rows = routing.merged_intervals([1.0, 2.0, 3.0, 4.0], [0, 1, 1, 0, 0])
    return spark.createDataFrame(rows, "low double, high double, child int")


# ------------------------------------------------------- choice among splits

_CANDIDATES = """
WITH long AS (SELECT 0 AS f, p_size::DOUBLE AS x, p_retailprice AS y FROM part UNION ALL SELECT 1, p_partkey::DOUBLE, p_retailprice FROM part),
c AS (SELECT f, least(floor(x / 10), 9)::INTEGER AS bin, count(*)::DOUBLE AS n, sum(y) AS s, sum(y * y) AS q FROM long GROUP BY ALL),
t AS (SELECT f, sum(n) AS n, sum(q) - sum(s) * sum(s) / sum(n) AS whole FROM c GROUP BY f),
k AS (SELECT f, k, sum(q - s * s / n) AS loss FROM (SELECT f, k, bin % k AS child, sum(n) AS n, sum(s) AS s, sum(q) AS q FROM c, (VALUES (2), (3), (4)) v(k) GROUP BY ALL) GROUP BY ALL),
g AS (SELECT f, k AS arity, whole - loss AS gain, whole - loss - 1.0 - 100.0 * (k - 2) AS score FROM k JOIN t USING (f))"""


def _candidates(spark, sf_dir) -> DataFrame:
    """Splits of two features into bin modulo k children, with penalised gains."""
    df = read(spark, sf_dir, "part")
    long = df.select(F.explode(F.array(F.struct(F.lit(0).alias("f"), F.col("p_size").cast("double").alias("x")), F.struct(F.lit(1).alias("f"), F.col("p_partkey").cast("double").alias("x")))).alias("c"), F.col("p_retailprice").alias("y"))
    cells = long.groupBy(F.col("c.f").alias("f"), F.least(F.floor(F.col("c.x") / 10), F.lit(9)).cast("int").alias("bin")).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("y").alias("s"), F.sum(F.col("y") * F.col("y")).alias("q"))
    error = lambda n, s, q: n * C.squared_error_column(n, s, q)
    whole = cells.groupBy("f").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")).select("f", error(F.col("n"), F.col("s"), F.col("q")).alias("whole"))
    kids = cells.withColumn("k", F.explode(F.array(F.lit(2), F.lit(3), F.lit(4)))).groupBy("f", "k", (F.col("bin") % F.col("k")).alias("child")).agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    loss = kids.groupBy("f", "k").agg(F.sum(error(F.col("n"), F.col("s"), F.col("q"))).alias("loss"))
    gain = F.col("whole") - F.col("loss")
    return loss.join(F.broadcast(whole), "f").select("f", F.col("k").alias("arity"), gain.alias("gain"), (gain - 1.0 - 100.0 * (F.col("k") - 2)).alias("score"))


@query(_CANDIDATES + " SELECT f, arity, round(gain, 2) AS gain, round(score, 2) AS score, score > 2.220446049250313e-16 AS accepted FROM g")
def split_penalties(spark, sf_dir):
    return _candidates(spark, sf_dir).select("f", "arity", F.round("gain", 2).alias("gain"), F.round("score", 2).alias("score"), (F.col("score") > C.EPS).alias("accepted"))


@query(_CANDIDATES + " SELECT arity, f, round(score, 2) AS score FROM g QUALIFY row_number() OVER (PARTITION BY arity ORDER BY round(score, 6) DESC, f) = 1")
def best_per_arity(spark, sf_dir):
    best = F.max_by(F.struct("f", "score"), F.struct(F.round("score", 6), -F.col("f")))
    return _candidates(spark, sf_dir).groupBy("arity").agg(best.alias("b")).select("arity", "b.f", F.round("b.score", 2).alias("score"))


@query(f"""
WITH rows AS (SELECT row_number() OVER () AS id, CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS y, * FROM lineitem),
sides AS ({' UNION ALL '.join(f"SELECT id, y, {i} AS f, ({c}::DOUBLE > {t}::DOUBLE)::INTEGER AS p FROM rows" for i, (c, t) in enumerate(zip(NUMBERS, (25, 50000, 0.05, 0.04))))}),
cells AS (SELECT a.f AS fa, b.f AS fb, a.p AS pa, b.p AS pb, count(*) AS n, sum(a.y) AS s FROM sides a JOIN sides b ON a.id = b.id AND a.f < b.f GROUP BY ALL),
scored AS (SELECT fa, fb, sum(2 * s * (n - s) / n) / sum(n) AS impurity FROM cells GROUP BY ALL)
SELECT fa, fb, round(impurity, 9) AS impurity FROM scored ORDER BY round(impurity, 9), fa, fb LIMIT 3""")
def pair_screen_topk(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem").withColumn("y", (F.col("l_returnflag") == "R").cast("int"))
    rows = df.select(F.lit(0).alias("tree"), F.lit(0).alias("node"), F.lit(1).alias("mult"), F.lit(1.0).alias("w"), F.col("y").alias("y0"), *[narrow(c).alias(f"f{i}") for i, c in enumerate(NUMBERS)])
    table = growth.Table(rows, [Feature(c, "continuous", (c,)) for c in NUMBERS], 1, [2])
    cut = lambda f, t: {"kind": "numeric", "logical": [f], "thresholds": [float(np.float32(t))], "categories": [], "pair_tree": [], "labels": [0, 1, 0], "arity": 2}
    cells = growth.crossed(table, Loss("gini", 1), rows, {(0, 0): {f: cut(f, t) for f, t in enumerate((25, 50000, 0.05, 0.04))}})
    gini = C.gini_column([F.col("s_0_0"), F.col("s_0_1")])
    scored = cells.groupBy("fa", "fb").agg((F.sum(F.col("wsum") * gini) / F.sum("wsum")).alias("impurity"))
    return scored.select("fa", "fb", F.round("impurity", 9).alias("impurity")).orderBy("impurity", "fa", "fb").limit(3)


@query("""
WITH base AS (SELECT p_size::FLOAT::DOUBLE AS x, CASE WHEN p_retailprice > 912 AND p_retailprice < 960 THEN 1.0 ELSE 0.0 END AS y FROM part),
c AS (SELECT x, count(*) AS n, sum(y) AS r1, count(*) - sum(y) AS r0 FROM base GROUP BY ALL),
u AS (SELECT x, lead(x) OVER w AS nx, sum(n) OVER w AS ln, sum(n) OVER () - sum(n) OVER w AS rn, sum(r0) OVER w AS l0, sum(r1) OVER w AS l1, sum(r0) OVER () - sum(r0) OVER w AS t0, sum(r1) OVER () - sum(r1) OVER w AS t1 FROM c WINDOW w AS (ORDER BY x ROWS UNBOUNDED PRECEDING))
SELECT x / 2 + nx / 2 AS threshold, greatest(l0 + t1, l1 + t0)::DOUBLE AS reward, (CASE WHEN l0 + t1 >= l1 + t0 THEN 0 ELSE 1 END)::INTEGER AS left_child FROM u WHERE nx IS NOT NULL AND ln >= 13 AND rn >= 13 ORDER BY reward DESC, x LIMIT 1""")
def refine_best_threshold(spark, sf_dir):
    df = _part(spark, sf_dir).select(narrow("p_size").alias("x"), F.col("dear").cast("double").alias("y"), F.lit(1).alias("one"))
    cells = df.groupBy("one", "x").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("r1"), F.sum(1 - F.col("y")).alias("r0"))
    return cuts.best_reward_cuts(cells, ["one"], ("r0", "r1"), 13, 8).drop("one")


# ------------------------------------------------------------------- others


@query(_sql_tree("SELECT CASE WHEN label = 0 THEN 1.0 ELSE 0.0 END AS y, 1.0::DOUBLE AS w, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b FROM embeddings", ["a", "b"], "gini", 1, _LEAVES))
def embedding_features_tree(spark, sf_dir):
    df = read(spark, sf_dir, "embeddings").select(F.element_at("embedding", 1).alias("e0"), F.element_at("embedding", 2).alias("e1"), (F.col("label") == 0).cast("int").alias("zero"))
    return _leaf_rates(ShapeTreeClassifier(**STUMPS | {"max_depth": 1}).fit(df, ["e0", "e1"], "zero"), df, F.col("zero").cast("double"))


@query("""
WITH base AS (SELECT lang AS x, quality::DOUBLE AS y FROM documents JOIN labels USING (doc_id)),
c AS (SELECT x, count(*) AS n, sum(y) AS s FROM base GROUP BY ALL),
t AS (SELECT *, sum(n) OVER () AS tn, sum(s) OVER () AS ts FROM c),
b AS (SELECT x FROM t WHERE tn > n ORDER BY round(2 * s * (n - s) / n + 2 * (ts - s) * (tn - n - ts + s) / (tn - n), 7), x LIMIT 1)
SELECT count(*) AS n, round(avg(y), 6) AS rate FROM base, b GROUP BY base.x = b.x""")
def document_quality_tree(spark, sf_dir):
    df = read(spark, sf_dir, "documents").select("doc_id", "lang").join(read(spark, sf_dir, "labels"), "doc_id")
    model = ShapeTreeClassifier(**STUMPS | {"max_depth": 1}).fit(df, ["lang"], "quality")
    return _leaf_rates(model, df, F.col("quality").cast("double"))


# -------------------------------------------- learners that SQL can follow

def _sql_bins(base: str, kind: str, leaves: int) -> str:
    """CTEs of inner trees over ``base (f, x, y, w)``, one for each ``f``: each round
    cuts the interval that gains most. ``grown`` has the rows with their interval
    ``node``; intervals are named by their least value."""
    loss = (lambda a: f"2 * {a}y * ({a}w - {a}y) / nullif({a}w, 0)") if kind == "gini" else (lambda a: f"({a}yy - {a}y * {a}y / nullif({a}w, 0))")
    parts, last = [f"g0 AS (SELECT f, x, y, w, min(x) OVER (PARTITION BY f) AS node FROM ({base}))"], "g0"
    for k in range(1, leaves):
        parts.append(f"""
g{k}_cells AS (SELECT f, node, x, sum(w) AS sw, sum(w * y) AS sy, sum(w * y * y) AS syy FROM {last} GROUP BY ALL),
g{k}_run AS (SELECT f, node, x, lead(x) OVER u AS nx, sum(sw) OVER u AS lw, sum(sy) OVER u AS ly, sum(syy) OVER u AS lyy, sum(sw) OVER a AS tw, sum(sy) OVER a AS ty, sum(syy) OVER a AS tyy,
  sum(sw) OVER a - sum(sw) OVER u AS rw, sum(sy) OVER a - sum(sy) OVER u AS ry, sum(syy) OVER a - sum(syy) OVER u AS ryy FROM g{k}_cells
  WINDOW u AS (PARTITION BY f, node ORDER BY x ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY f, node)),
g{k}_cut AS (SELECT f, node, x, nx, {loss('t')} - {loss('l')} - {loss('r')} AS gain FROM g{k}_run WHERE nx IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY f ORDER BY round(gain, 7) DESC, node, x) = 1),
g{k} AS (SELECT b.f, b.x, b.y, b.w, CASE WHEN c.node = b.node AND b.x > c.x THEN c.nx ELSE b.node END AS node FROM {last} b LEFT JOIN g{k}_cut c USING (f))""")
        last = f"g{k}"
    return "WITH " + ",".join(parts) + f",\ngrown AS (SELECT *, dense_rank() OVER (PARTITION BY f ORDER BY node) - 1 AS bin FROM {last})"


_PRICE_BY_KEY = "SELECT 0 AS f, p_partkey::FLOAT::DOUBLE AS x, p_retailprice AS y, 1.0::DOUBLE AS w FROM part"
_ODD = "CASE WHEN (p_size > 20) <> (p_partkey % 5 = 0) THEN 1.0 ELSE 0.0 END"
_ODD_LONG = f"SELECT 0 AS f, p_size::FLOAT::DOUBLE AS x, {_ODD} AS y, 1.0::DOUBLE AS w FROM part UNION ALL SELECT 1, (p_partkey % 7)::FLOAT::DOUBLE, {_ODD}, 1.0::DOUBLE FROM part"


def _odd_part(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "part").withColumn("odd", ((F.col("p_size") > 20) != (F.col("p_partkey") % 5 == 0)).cast("int")).withColumn("m", F.col("p_partkey") % 7)


@query(_sql_bins(_ODD_LONG, "gini", 3) + """,
sums AS (SELECT f, bin, sum(w) AS w, sum(y) AS y FROM grown GROUP BY ALL),
best AS (SELECT f FROM sums GROUP BY f ORDER BY round(sum(2 * y * (w - y) / w), 7), f LIMIT 1)
SELECT w::BIGINT AS n, round(y / w, 6) AS rate FROM sums JOIN best USING (f)""")
def kway_stumps(spark, sf_dir):
    """Three bins of an inner tree, a child each: the feature that gains most."""
    df = _odd_part(spark, sf_dir)
    model = ShapeTreeClassifier(**FREE | {"max_depth": 1, "num_partitions": 3, "inner_max_leaf_nodes": 3}).fit(df, ["p_size", "m"], "odd")
    return _leaf_rates(model, df, F.col("odd").cast("double"))


@query(_sql_bins(_ODD_LONG, "gini", 4) + """,
sums AS (SELECT f, bin, sum(w) AS w, sum(y) AS y FROM grown GROUP BY ALL),
sides AS (SELECT f, mask, (mask >> bin) & 1 AS side, sum(w) AS w, sum(y) AS y FROM sums, (SELECT unnest(range(1, 8)) AS mask) GROUP BY ALL),
best AS (SELECT f, mask FROM sides GROUP BY ALL HAVING count(*) = 2 ORDER BY round(sum(2 * y * (w - y) / w), 7), f, mask LIMIT 1)
SELECT w::BIGINT AS n, round(y / w, 6) AS rate FROM sides JOIN best USING (f, mask)""")
def coordinate_descent_stumps(spark, sf_dir):
    """Four bins of an inner tree, dealt to two children: SQL tries every way."""
    df = _odd_part(spark, sf_dir)
    model = ShapeTreeClassifier(**FREE | {"max_depth": 1, "inner_max_leaf_nodes": 4}).fit(df, ["p_size", "m"], "odd")
    return _leaf_rates(model, df, F.col("odd").cast("double"))


@query("""
WITH long AS (SELECT 0 AS f, p_size::FLOAT::DOUBLE AS x, p_retailprice + p_size AS y FROM part UNION ALL SELECT 1, (p_partkey % 100)::FLOAT::DOUBLE, p_retailprice + p_size FROM part),
cuts AS (SELECT f, x AS edge, lead(x) OVER (PARTITION BY f ORDER BY x) AS nx FROM (SELECT DISTINCT f, x FROM long)),
sides AS (SELECT c.f, c.edge, l.x <= c.edge AS low, l.y FROM cuts c JOIN long l USING (f) WHERE c.nx IS NOT NULL),
middle AS (SELECT f, edge, low, median(y) AS m FROM sides GROUP BY ALL),
loss AS (SELECT f, edge, sum(abs(y - m)) AS loss FROM sides JOIN middle USING (f, edge, low) GROUP BY ALL),
best AS (SELECT f, edge FROM loss ORDER BY round(loss, 5), f, edge LIMIT 1)
SELECT count(*) AS n, round(median(y), 2) AS predicted FROM sides JOIN best USING (f, edge) GROUP BY low""")
def mae_stump(spark, sf_dir):
    """Absolute error: SQL tries every cut, with the medians of both sides."""
    df = read(spark, sf_dir, "part").withColumn("y", F.col("p_retailprice") + F.col("p_size")).withColumn("m", F.col("p_partkey") % 100)
    model = ShapeTreeRegressor(criterion="absolute_error", **STUMPS | {"max_depth": 1}).fit(df, ["p_size", "m"], "y")
    return model.transform(df).groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.round(F.first("prediction"), 2).alias("predicted")).drop("leaf")


@query(_sql_tree(_PART_CLASS, ["a", "b"], "gini", 2, """
, pick AS (SELECT node, f, cut FROM b2_best WHERE whole - loss > 2.3e-16 ORDER BY round(whole - loss, 7) DESC, node LIMIT 1)
SELECT count(*) AS n, round(avg(y), 6) AS rate FROM b1 LEFT JOIN pick ON b1.node = pick.node GROUP BY b1.node, CASE pick.f WHEN 0 THEN a <= cut WHEN 1 THEN b <= cut END"""))
def leaf_budget_stumps(spark, sf_dir):
    """Three leaves: of the root's children the one that gains more is split."""
    df = _part(spark, sf_dir)
    return _leaf_rates(ShapeTreeClassifier(**STUMPS | {"max_depth": None, "max_leaf_nodes": 3}).fit(df, ["p_size", "p_partkey"], "dear"), df, F.col("dear").cast("double"))


def _sql_draws(seed: int, trees: int, table: str, key: str) -> str:
    """CTEs of a bootstrap: ``drawn (tree, key, mult)``."""
    seeds = ", ".join(f"({t}, {v})" for t, v in enumerate(tree_seeds(seed, trees)))
    return f"""
places AS (SELECT {key}, row_number() OVER (ORDER BY {key}) - 1 AS place FROM {table}),
draws AS (SELECT t, ('0x' || substr(md5(seed || '/' || i), 1, 15))::BIGINT % (SELECT count(*) FROM {table}) AS place FROM (VALUES {seeds}) v(t, seed), (SELECT unnest(range((SELECT count(*) FROM {table}))) AS i)),
drawn AS (SELECT t, {key}, count(*)::INTEGER AS mult FROM draws JOIN places USING (place) GROUP BY ALL)"""


@query("WITH" + _sql_draws(11, 3, "part", "p_partkey") + " SELECT t::INTEGER AS tree, mult, count(*) AS rows FROM drawn GROUP BY ALL")
def bootstrap_counts(spark, sf_dir):
    """How many rows are drawn how often, by tree."""
    rows = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("row_id"), F.lit(0).alias("tree"), F.lit(1).alias("mult"))
    return bootstrap(rows, 3, 11, None, True, by_row_id=True).groupBy("tree", "mult").agg(F.count(F.lit(1)).alias("rows"))


_FOREST = "WITH" + _sql_draws(7, 3, "part", "p_partkey") + """,
b0 AS (SELECT t AS node, p_partkey, p_retailprice AS y, mult::DOUBLE AS w, p_size::FLOAT::DOUBLE AS a, (p_partkey % 100)::FLOAT::DOUBLE AS b FROM drawn JOIN part USING (p_partkey)),""" + _sql_level("b0", ["a", "b"], "mse", "b1")


def _stump_forest(spark, sf_dir):
    df = read(spark, sf_dir, "part").withColumn("m", F.col("p_partkey") % 100)
    return df, ShapeForestRegressor(n_estimators=3, random_state=7, row_id="p_partkey", **STUMPS | {"max_depth": 1}).fit(df, ["p_size", "m"], "p_retailprice")


@query(_FOREST + """,
leaf AS (SELECT node, sum(w * y) / sum(w) AS mean FROM b1 GROUP BY node),
each AS (SELECT p_partkey, s.node AS tree, 2 * s.node + CASE WHEN CASE f WHEN 0 THEN p_size::FLOAT::DOUBLE ELSE (p_partkey % 100)::FLOAT::DOUBLE END <= cut THEN 1 ELSE 2 END AS node FROM part, b1_best s)
SELECT p_partkey, round(avg(mean), 2) AS predicted FROM each JOIN leaf USING (node) GROUP BY p_partkey""")
def forest_mean_stumps(spark, sf_dir):
    """Bootstrapped regression stumps; predictions are their mean."""
    df, model = _stump_forest(spark, sf_dir)
    return model.transform(df).select("p_partkey", F.round("prediction", 2).alias("predicted"))


@query(_FOREST + """
SELECT feature, round(avg((b.f = v.f)::INTEGER), 6) AS mean, round(stddev_pop((b.f = v.f)::INTEGER), 6) AS std FROM (VALUES (0, 'p_size'), (1, 'm')) v(f, feature), b1_best b GROUP BY feature""")
def forest_importance_stumps(spark, sf_dir):
    _, model = _stump_forest(spark, sf_dir)
    rows = list(zip((f.columns[0] for f in model.features), map(float, model.mean_feature_importances_), map(float, model.std_feature_importance_)))
    return spark.createDataFrame(rows, "feature string, mean double, std double").select("feature", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query(_sql_tree(_PART_CLASS, ["a", "b"], "gini", 2, """
, reached AS (SELECT node, count(*) AS n, avg(y) AS rate FROM b1 GROUP BY node UNION ALL SELECT node, count(*), avg(y) FROM b2 WHERE node > 2 GROUP BY node),
splits AS (SELECT node, f, cut FROM b1_best UNION ALL SELECT node, f, cut FROM b2_best WHERE whole - loss > 2.3e-16),
named AS (SELECT s.node, CASE f WHEN 0 THEN 'p_size' ELSE 'p_partkey' END AS f, printf('%.2f', cut) AS cut, l.n AS ln, r.n AS rn, 2 * s.node + 1 AS lo, 2 * s.node + 2 AS hi FROM splits s JOIN reached l ON l.node = 2 * s.node + 1 JOIN reached r ON r.node = 2 * s.node + 2),
path(node, place) AS (VALUES (1, '1'), (2, '2'), (3, '11'), (4, '12'), (5, '21'), (6, '22')),
texts AS (
  SELECT lo AS node, 'a' AS kind, f || ' <= ' || cut || CASE WHEN ln >= rn THEN ' or ' || f || ' is missing' ELSE '' END AS t FROM named
  UNION ALL SELECT hi, 'a', f || ' > ' || cut || CASE WHEN ln >= rn THEN '' ELSE ' or ' || f || ' is missing' END FROM named
  UNION ALL SELECT node, 'b', 'class: ' || CASE WHEN rate > 0.5 THEN 1 ELSE 0 END FROM reached WHERE node NOT IN (SELECT node FROM splits))
SELECT (row_number() OVER (ORDER BY place, kind) - 1)::INTEGER AS line, repeat('|   ', (len(place) - (kind = 'a')::INTEGER)::INTEGER) || '|--- ' || t AS rule FROM texts JOIN path USING (node)"""))
def rules_text(spark, sf_dir):
    df = _part(spark, sf_dir)
    text = explain.export_text(ShapeTreeClassifier(**STUMPS | {"max_depth": 2}).fit(df, ["p_size", "p_partkey"], "dear"))
    return spark.createDataFrame(list(enumerate(text.splitlines())), "line int, rule string")


@query(_sql_tree(_PART_CLASS, ["a", "b"], "gini", 1, """
, reached AS (SELECT sum((node = 1)::INTEGER) AS ln, sum((node = 2)::INTEGER) AS rn FROM b1),
named AS (SELECT CASE f WHEN 0 THEN 'p_size' ELSE 'p_partkey' END AS f, printf('%.2f', cut) AS cut, ln, rn FROM b1_best, reached)
SELECT '0 -> 1 [color="#e58139", tooltip="' || f || ' <= ' || cut || CASE WHEN ln >= rn THEN ' or ' || f || ' is missing' ELSE '' END || '"] ;' AS edge FROM named
UNION ALL SELECT '0 -> 2 [color="#39e581", tooltip="' || f || ' > ' || cut || CASE WHEN ln >= rn THEN '' ELSE ' or ' || f || ' is missing' END || '"] ;' FROM named"""))
def graph_edges(spark, sf_dir):
    """Edges of a graph: a child's colour, and its rule as the tooltip."""
    df = _part(spark, sf_dir)
    text = explain.export_graphviz(ShapeTreeClassifier(**STUMPS | {"max_depth": 1}).fit(df, ["p_size", "p_partkey"], "dear"), df=df)
    return spark.createDataFrame([(x,) for x in text.splitlines() if "->" in x], "edge string")


@query(_sql_tree(_PART_CLASS, ["a", "b"], "gini", 1, """
SELECT 0 AS depth, (SELECT count(*) FROM part) AS n, (SELECT CASE f WHEN 0 THEN 'p_size' ELSE 'p_partkey' END FROM b1_best) AS feature, (SELECT round(cut, 6) FROM b1_best) AS threshold, (SELECT round(whole - loss, 6) FROM b1_best) AS gain, (SELECT round(sum(y), 4) FROM part, LATERAL (SELECT CASE WHEN p_retailprice > 912 AND p_retailprice < 960 THEN 1.0 ELSE 0.0 END AS y)) AS ones
UNION ALL SELECT 1, count(*), NULL, NULL, 0.0, round(sum(y), 4) FROM {last} GROUP BY node"""))
def snapshot_splits(spark, sf_dir):
    """A snapshot's rows: each node's depth, rows, split, gain and class weight."""
    df = _part(spark, sf_dir)
    rows = snapshots.nodes_table(spark, snapshots.from_json(snapshots.to_json(ShapeTreeClassifier(**STUMPS | {"max_depth": 1}).fit(df, ["p_size", "p_partkey"], "dear"))))
    split = lambda c: F.when(F.size(c) > 0, F.col(c)[0])
    return rows.select("depth", F.col("n").cast("bigint").alias("n"), split("columns").alias("feature"), F.round(split("thresholds"), 6).alias("threshold"), F.round("raw_gain", 6).alias("gain"), F.round(F.col("class_counts")[0][1], 4).alias("ones"))


@query(_sql_bins(_PRICE_BY_KEY, "mse", 4) + " SELECT bin::INTEGER AS bin, count(*) AS n, round(avg(y), 4) AS price FROM grown GROUP BY bin")
def discretizer_bins(spark, sf_dir):
    df = read(spark, sf_dir, "part")
    model = ShapeDiscretizer("squared_error", max_leaf_nodes=4).fit(df, ["p_partkey"], "p_retailprice")
    return model.transform(df).groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("p_retailprice"), 4).alias("price"))


@query(_sql_tree(_PART_CLASS, ["a", "b"], "gini", 1, "SELECT strip::INTEGER AS strip, (lo + (strip + 0.5) * (hi - lo) / 80 > cut)::INTEGER AS child FROM b1_best, (SELECT min(p_partkey)::DOUBLE AS lo, max(p_partkey)::DOUBLE AS hi FROM part), (SELECT unnest(range(80)) AS strip)").replace("SELECT node, 0 AS f, a AS x, y, w FROM b0 UNION ALL ", ""))
def numeric_panel_stump(spark, sf_dir):
    """The child of each strip along a feature."""
    df = _part(spark, sf_dir)
    model = ShapeTreeClassifier(**STUMPS | {"max_depth": 1}).fit(df, ["p_partkey"], "dear")
    span = df.agg(F.min("p_partkey"), F.max("p_partkey")).first()
    return spark.createDataFrame(list(enumerate(explain.numeric_panel(model, 0, float(span[0]), float(span[1]))["strips"])), "strip int, child int")


@query("""
SELECT i::INTEGER AS i, j::INTEGER AS j, (CASE WHEN i = 10 THEN 1 WHEN i * 5 + 2.5 > 25 THEN 0 WHEN j = 10 OR j * 0.01 + 0.005 <= 0.05 THEN 0 ELSE 1 END)::INTEGER AS child
FROM (SELECT unnest(range(11)) AS i), (SELECT unnest(range(11)) AS j)""")
def pair_grid(spark, sf_dir):
    """Children over a grid of a pair split's two features, missing cells last."""
    node = {"node_id": 0, "kind": "pair", "logical": [0, 1], "pair_tree": _PAIR_TREE, "bin_to_partition": [0, 1, 0, 1], "children": [1, 2], "is_leaf": False}
    features = [Feature(c, "continuous", (c,)) for c in ("l_quantity", "l_discount")]
    model = TreeModel("classifier", TreeParams(), features, ["l_quantity", "l_discount"], ["y"], {0: growth.Tree([node])}, [[0, 1]])
    return explain.pair_heatmap(spark, model, 0, [(0.0, 50.0), (0.0, 0.1)], cells=10).select("i", "j", "child")


@query(f"""
WITH base AS (SELECT p_size::DOUBLE AS a, (p_partkey % 7)::DOUBLE AS b, {_ODD} AS y FROM part),
long AS (SELECT 0 AS f, a AS x, y FROM base UNION ALL SELECT 1, b, y FROM base),
cells AS (SELECT f, x, sum(y) AS r1, sum(1 - y) AS r0 FROM long GROUP BY ALL),
run AS (SELECT sum(r1) OVER u AS l1, sum(r0) OVER u AS l0, sum(r1) OVER a - sum(r1) OVER u AS t1, sum(r0) OVER a - sum(r0) OVER u AS t0 FROM cells WINDOW u AS (PARTITION BY f ORDER BY x ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY f))
SELECT max(greatest(l0 + t1, l1 + t0))::BIGINT AS correct FROM run""")
def refine_stump(spark, sf_dir):
    """Rows that a refined stump classifies right: as many as the best cut of any feature does."""
    df = _odd_part(spark, sf_dir)
    model = refine(ShapeTreeClassifier(**STUMPS | {"max_depth": 1}).fit(df, ["p_size", "m"], "odd"), df, lambda_=0.0)
    return model.transform(df).where("prediction = odd").agg(F.count(F.lit(1)).alias("correct"))


def _leaf_table(model: TreeModel, df: DataFrame) -> DataFrame:
    return model.transform(df).groupBy("leaf", F.col("prediction").cast("string").alias("prediction")).agg(F.count(F.lit(1)).alias("n"))


@query()
def kway_tree(spark, sf_dir):
    """Three-way branching with production costs."""
    df = read(spark, sf_dir, "part")
    return _leaf_table(ShapeTreeRegressor(num_partitions=3, max_depth=2).fit(df, ["p_size", "p_partkey", "p_brand"], "p_retailprice"), df)


@query()
def coordinate_descent_tree(spark, sf_dir):
    """Eight inner bins, assigned to two children by coordinate descent."""
    df = _part(spark, sf_dir)
    return _leaf_table(ShapeTreeClassifier(max_depth=2, inner_max_leaf_nodes=8).fit(df, ["p_size", "p_partkey"], "dear"), df)


@query()
def mae_tree(spark, sf_dir):
    """Absolute error; leaves hold weighted medians."""
    df = read(spark, sf_dir, "part")
    return _leaf_table(ShapeTreeRegressor(criterion="absolute_error", max_depth=2).fit(df, ["p_size", "p_partkey"], "p_retailprice"), df)


@query()
def leaf_budget_tree(spark, sf_dir):
    """Best-first growth under a cap of five leaves."""
    df = read(spark, sf_dir, "part")
    return _leaf_table(ShapeTreeRegressor(num_partitions=3, max_depth=None, max_leaf_nodes=5).fit(df, ["p_size", "p_partkey"], "p_retailprice"), df)


@query()
def pair_tree_fit(spark, sf_dir):
    """Pairs of features compete with single ones."""
    df = _part(spark, sf_dir).withColumn("both", F.when((F.col("p_size") > 25) == (F.col("p_partkey") % 97 > 40), 1).otherwise(0)).withColumn("m", F.col("p_partkey") % 97)
    return _leaf_table(ShapeTreeClassifier(max_depth=2, pairwise_candidates=1.0).fit(df, ["p_size", "m"], "both"), df)


@query()
def forest_classifier(spark, sf_dir):
    df = _part(spark, sf_dir)
    model = ShapeForestClassifier(n_estimators=4, max_depth=2, random_state=7, row_id="p_partkey").fit(df, ["p_size", "p_partkey"], "dear")
    return model.transform(df).select("p_partkey", "prediction", F.round(F.col("probability")[1], 6).alias("p_dear"))


@query()
def forest_proba_mean(spark, sf_dir):
    """Mean regression of a forest."""
    df = read(spark, sf_dir, "part")
    model = ShapeForestRegressor(n_estimators=4, max_depth=2, random_state=7, row_id="p_partkey").fit(df, ["p_size", "p_partkey"], "p_retailprice")
    return model.transform(df).select("p_partkey", F.round("prediction", 4).alias("predicted"))


@query()
def forest_importance_stats(spark, sf_dir):
    df = read(spark, sf_dir, "part")
    model = ShapeForestRegressor(n_estimators=4, max_depth=2, random_state=7, row_id="p_partkey").fit(df, ["p_size", "p_partkey"], "p_retailprice")
    rows = list(zip((f.columns[0] for f in model.features), map(float, model.mean_feature_importances_), map(float, model.std_feature_importance_)))
    return spark.createDataFrame(rows, "feature string, mean double, std double")


@query()
def refine_tree(spark, sf_dir):
    df = _part(spark, sf_dir)
    model = ShapeTreeClassifier(max_depth=2).fit(df, ["p_size", "p_partkey"], "dear")
    return _leaf_table(refine(model, df, lambda_=0.0), df)


@query()
def graph_text(spark, sf_dir):
    df = _part(spark, sf_dir)
    text = explain.export_graphviz(ShapeTreeClassifier(**STUMPS | {"max_depth": 1}).fit(df, ["p_size", "p_partkey"], "dear"), df=df)
    return spark.createDataFrame(list(enumerate(text.splitlines())), "line int, dot string")


@query()
def model_snapshot(spark, sf_dir):
    df = _part(spark, sf_dir)
    return snapshots.nodes_table(spark, ShapeTreeClassifier(**STUMPS | {"max_depth": 2}).fit(df, ["p_size", "p_partkey"], "dear"))


@query("""
SELECT (CASE WHEN event_id % 10 = 0 THEN 0 WHEN value::FLOAT::DOUBLE <= 10 OR (value::FLOAT::DOUBLE > 20.5 AND value::FLOAT::DOUBLE <= 40) THEN 0 ELSE 1 END)::INTEGER AS child, count(*) AS n
FROM events GROUP BY ALL""")
def stream_route_counts(spark, sf_dir):
    """Rows of a stream by the child that a split sends them to."""
    schema = read(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    x = F.when(F.col("event_id") % 10 != 0, narrow("value"))
    counted = stream.groupBy(routing.child_column(_NUMERIC_NODE, [x]).alias("child")).agg(F.count(F.lit(1)).alias("n"))
    run = counted.writeStream.format("memory").queryName("stream_route_counts").outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.table("stream_route_counts")


@query()
def plus_dataset(spark, sf_dir):
    return datasets.make_plus(spark, 1500, random_state=0)


@query()
def numeric_panel(spark, sf_dir):
    """The root's child along its feature, in 80 strips."""
    df = read(spark, sf_dir, "part")
    model = ShapeTreeRegressor(num_partitions=3, max_depth=1, min_impurity_decrease=0.0).fit(df, ["p_partkey"], "p_retailprice")
    span = df.agg(F.min("p_partkey"), F.max("p_partkey")).first()
    panel = explain.numeric_panel(model, 0, float(span[0]), float(span[1]))
    return spark.createDataFrame(list(enumerate(panel["strips"])), "strip int, child int")


@query()
def pair_heatmap(spark, sf_dir):
    """Children of a pair split over a grid of both features."""
    df = _part(spark, sf_dir).withColumn("both", F.when((F.col("p_size") > 25) == (F.col("p_partkey") % 97 > 40), 1).otherwise(0)).withColumn("m", F.col("p_partkey") % 97)
    model = ShapeTreeClassifier(max_depth=2, pairwise_candidates=1.0, **FREE).fit(df, ["p_size", "m"], "both")
    pairs = [n["node_id"] for n in model.trees[0].nodes if n["kind"] == "pair"]
    if not pairs:
        return spark.createDataFrame([], "i int, j int, a double, b double, child int")
    return explain.pair_heatmap(spark, model, pairs[0], [(0.0, 50.0), (0.0, 97.0)], cells=20)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fit a tree on lineitem and give each leaf's rule, rows and class share."""
    df = read(spark, sf_dir, "lineitem").withColumn("returned", (F.col("l_returnflag") == "R").cast("int"))
    model = ShapeTreeClassifier(**STUMPS | {"max_depth": 3}).fit(df, NUMBERS, "returned")
    rules = routing.leaf_predicates(model.trees[0].nodes, model.features, quote="`")
    names = spark.createDataFrame([(k, r) for k, r in rules.items()], "leaf int, rule string")
    found = model.transform(df).groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("returned").cast("double")), 6).alias("rate"))
    return found.join(F.broadcast(names), "leaf")  # a row for each leaf of one tree
