"""Running totals that no single task has to make alone."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def running_totals(df: DataFrame, group: list[str], bucket: str, order: list[Column], values: dict[str, str]) -> DataFrame:
    """Sums over the rows up to each row, by ``group``, in the order of ``bucket``
    and then ``order``; ``values`` maps a column to its total's name.

    ``bucket`` cuts a group into ordered pieces: only a piece is sorted in one
    task, and a group's pieces are summed first.
    """
    keys = [*group, bucket]
    whole = df.groupBy(*keys).agg(*[F.sum(v).alias(f"__sum_{v}") for v in values])
    pieces = Window.partitionBy(*(group or [F.lit(0)])).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    heads = whole.select(
        *[F.col(k).alias(f"__{k}") for k in keys], *[F.coalesce(F.sum(f"__sum_{v}").over(pieces), F.lit(0)).alias(f"__before_{v}") for v in values]
    )
    match = reduce(lambda a, b: a & b, [df[k].eqNullSafe(heads[f"__{k}"]) for k in keys])
    within = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = df.join(heads, match)
    for v, name in values.items():
        out = out.withColumn(name, F.col(f"__before_{v}") + F.sum(v).over(within))
    return out.drop(*[f"__before_{v}" for v in values], *[f"__{k}" for k in keys])


def range_bucket(df: DataFrame, group: list[str], x: str, pieces: int) -> DataFrame:
    """``df`` with ``bucket``: the position of ``x`` among its group's quantiles.

    ``group`` names a column at least. Groups are few (a node's features); their
    quantiles are broadcast.
    """
    if pieces <= 1:
        return df.withColumn("bucket", F.lit(0))
    shares = [i / pieces for i in range(1, pieces)]
    edges = df.groupBy(*group).agg(F.percentile_approx(x, shares, 1000).alias("__edges"))
    out = df.join(F.broadcast(edges), group)
    return out.withColumn("bucket", F.size(F.filter("__edges", lambda e: e < F.col(x)))).drop("__edges")


def pieces_of(df: DataFrame, group: list[str], x: str, values: list[str]) -> DataFrame:
    """A row for each group and piece of ``df`` (with ``bucket``): sums before it
    (``before_..``), after it (``after_..``) and of the group (``all_..``), and the
    least ``x`` of the piece after it (``next_piece``). One pass; few rows, of
    which :func:`in_pieces` broadcasts all."""
    whole = df.groupBy(*group, "bucket").agg(F.min(x).alias("__least"), *[F.sum(v).alias(f"own_{v}") for v in values])
    ordered = Window.partitionBy(*group).orderBy("bucket")
    every = Window.partitionBy(*group)
    return whole.select(
        *group, "bucket", F.lead("__least").over(ordered).alias("next_piece"),
        *[F.coalesce(F.sum(f"own_{v}").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"before_{v}") for v in values],
        *[F.coalesce(F.sum(f"own_{v}").over(ordered.rowsBetween(1, Window.unboundedFollowing)), F.lit(0)).alias(f"after_{v}") for v in values],
        *[F.sum(f"own_{v}").over(every).alias(f"all_{v}") for v in values],
    )


def in_pieces(df: DataFrame, group: list[str], x: str, values: list[str], pieces: int, right: bool = False) -> DataFrame:
    """``df`` in the order of the distinct values ``x`` of each group, with totals
    up to a row (``l_..``) and of the group (``t_..``), the value after it (``nx``)
    and, with ``right``, totals after it, added up from the right (``r_..``).

    Groups are few; a group is cut into ``pieces`` ranges, and only a range is
    sorted in one task. The ranges' sums, a row each, are broadcast.
    """
    cut = range_bucket(df, group, x, pieces)
    rows = cut.join(F.broadcast(pieces_of(cut, group, x, values)), [*group, "bucket"])
    within = Window.partitionBy(*group, "bucket").orderBy(x)
    up = within.rowsBetween(Window.unboundedPreceding, 0)
    # a frame that begins after the row is summed anew for each row; a falling order isn't
    after = Window.partitionBy(*group, "bucket").orderBy(F.col(x).desc()).rowsBetween(Window.unboundedPreceding, -1)
    out = [F.coalesce(F.lead(x).over(within), F.col("next_piece")).alias("nx")]
    for v in values:
        out += [(F.col(f"before_{v}") + F.sum(v).over(up)).alias(f"l_{v}"), F.col(f"all_{v}").alias(f"t_{v}")]
        if right:
            out.append((F.col(f"after_{v}") + F.coalesce(F.sum(v).over(after), F.lit(0))).alias(f"r_{v}"))
    return rows.select(*df.columns, *out)
