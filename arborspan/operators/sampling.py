"""Bootstrap samples as row multiplicities."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.params import SEED_LIMIT
from ..plans.prefix import range_bucket, running_totals

#: Range pieces in which rows are numbered.
PIECES = 64


def bootstrap_size(n: int, max_samples) -> int:
    """Rows drawn for each tree: all, a count, or a share (one at least)."""
    if max_samples is None:
        return n
    if isinstance(max_samples, bool):
        raise ValueError("max_samples must not be a bool")
    if isinstance(max_samples, int):
        if not 1 <= max_samples <= n:
            raise ValueError(f"max_samples must be between 1 and {n}")
        return max_samples
    if not 0 < max_samples <= 1:
        raise ValueError("max_samples as a share must be above 0 and at most 1")
    return max(round(n * max_samples), 1)


def tree_seeds(random_state: int | None, trees: int) -> list[int]:
    rng = np.random.RandomState(random_state)
    return [int(rng.randint(SEED_LIMIT)) for _ in range(trees)]


def draw_column(seed: Column, draw: Column, n: int) -> Column:
    """Number of the row that a tree's draw takes: the first 60 bits of the md5 of
    ``seed/draw``, modulo ``n``."""
    bits = F.substring(F.md5(F.concat_ws("/", seed, draw).cast("binary")), 1, 15)
    return F.pmod(F.conv(bits, 16, 10).cast("bigint"), F.lit(n))


def numbered(rows: DataFrame, key: Column) -> DataFrame:
    """Rows with ``__at``: 0, 1, .. in the order of a numeric key and then of a
    hash of the row. Numbers are counted up in range pieces, not in one task."""
    named = rows.withColumns({"__key": key, "__tie": F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]), "__one": F.lit(1)})
    at = running_totals(range_bucket(named, ["__one"], "__key", PIECES), ["__one"], "bucket", [F.col("__key"), F.col("__tie")], {"__one": "__at"})
    return at.withColumn("__at", (F.col("__at") - 1).cast("bigint")).drop("__key", "__tie", "__one", "bucket")


def bootstrap(rows: DataFrame, trees: int, random_state: int | None, max_samples=None, replace: bool = True, by_row_id: bool = False) -> DataFrame:
    """``rows`` once for each tree that draws it, with ``mult`` draws.

    A tree makes its draws with replacement, by a hash of its seed and the draw's
    number, from numbered rows: the same rule for every number of rows, and the
    same sample when a lost task is run again. ``by_row_id``: rows are numbered in
    the order of the numeric ``row_id``; otherwise by a hash of their values (rows
    that are alike in every column are interchangeable).
    """
    base = rows.drop("tree", "mult")
    each = F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree")
    if not replace:
        return base.select("*", each).withColumn("mult", F.lit(1)).drop("row_id")
    n = base.count()
    m = bootstrap_size(n, max_samples)
    spark, seeds = rows.sparkSession, tree_seeds(random_state, trees)
    seed = F.element_at(F.array(*[F.lit(s) for s in seeds]), F.col("tree") + 1)
    draws = spark.range(m).select(F.col("id").alias("draw"), each).select("tree", draw_column(seed, F.col("draw"), max(n, 1)).alias("__at"))
    drawn = draws.groupBy("tree", "__at").agg(F.count(F.lit(1)).cast("int").alias("mult"))
    key = F.col("row_id").cast("double") if by_row_id else F.xxhash64(*[F.col(f"`{c}`") for c in base.columns]).cast("double")
    return numbered(base, key).join(drawn, "__at").drop("__at", "row_id")
