"""Best cuts and categories as window plans, for any number of groups at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import criteria as C
from .prefix import in_pieces


def impurity_column(kind: str, sums: list[Column], weight: Column) -> Column:
    """Impurity from sums of one output, or of several as lists."""
    if kind == "gini":
        return C.gini_column(sums)
    if kind == "entropy":
        return C.entropy_column(sums)
    if kind == "squared_error":
        return C.squared_error_column(weight, *sums)
    raise ValueError(kind)


#: Two losses are equal when they differ by less than this share of the group's own loss, in decimals.
TIE_DECIMALS = 10


def centred(cells: DataFrame, group: list[str], kind: str, outputs: list[list[str]]) -> DataFrame:
    """``cells`` with squared-error sums taken about their group's mean, so that
    sums of squares don't cancel; other criteria's sums stay."""
    if kind != "squared_error":
        return cells
    means = cells.groupBy(*group).agg(*[(F.sum(wy) / F.nullif(F.sum("w"), F.lit(0.0))).alias(f"mean_{wy}") for wy, _ in outputs])
    out = cells.join(F.broadcast(means), group)
    for wy, wyy in outputs:
        m = F.coalesce(f"mean_{wy}", F.lit(0.0))
        out = out.withColumn(wyy, F.col(wyy) - 2 * m * F.col(wy) + m * m * F.col("w")).withColumn(wy, F.col(wy) - m * F.col("w")).drop(f"mean_{wy}")
    return out


def whole_loss(kind: str, outputs: list[list[str]], sums) -> Column:
    """Impurity times weight of a whole group, summed over outputs; ``sums(name)`` is a total."""
    parts = [sums("w") * impurity_column(kind, [sums(c) for c in o], sums("w")) for o in outputs]
    return C.total([F.coalesce(p, F.lit(0.0)) for p in parts])


def ranked(loss, whole: Column) -> Column:
    """What cuts are compared by: the loss as a share of the group's own."""
    return F.round(F.coalesce(F.col(loss) / F.nullif(whole, F.lit(0.0)), F.col(loss)), TIE_DECIMALS)


def best_cuts(cells: DataFrame, group: list[str], kind: str, outputs: list[list[str]], min_leaf: int = 1, pieces: int = 1) -> DataFrame:
    """Per group, the best numeric cut of ``cells (group.., x, n, w, sums..)``.

    ``outputs`` lists each output's sum columns. Equal losses go to the smallest
    value; they are compared relative to the group's loss, which no scale of the
    target and no order of partial sums changes. ``pieces`` cuts a group's running
    sums into that many tasks. Groups without a cut have no row. Columns:
    ``threshold, loss, n_left, n_right``; ``loss`` is the children's impurity
    times weight, summed over outputs.
    """
    stats = [c for o in outputs for c in o]
    known = centred(cells.where(F.col("x").isNotNull()), group, kind, outputs)
    run = in_pieces(known, group, "x", ["n", "w", *stats], pieces)
    right = {c: F.col(f"t_{c}") - F.col(f"l_{c}") for c in ["n", "w", *stats]}
    loss = None
    for o in outputs:
        a = F.col("l_w") * impurity_column(kind, [F.col(f"l_{c}") for c in o], F.col("l_w"))
        b = right["w"] * impurity_column(kind, [right[c] for c in o], right["w"])
        both = F.coalesce(a, F.lit(0.0)) + F.coalesce(b, F.lit(0.0))
        loss = both if loss is None else loss + both
    apart = F.col("nx").cast("float") > F.col("x").cast("float") + F.lit(1e-7).cast("float")
    fits = (F.col("l_n") >= min_leaf) & (right["n"] >= min_leaf)
    middle = F.col("x") / 2 + F.col("nx") / 2
    found = run.where(F.col("nx").isNotNull() & apart & fits).select(
        *group, "x", F.when(middle == F.col("nx"), F.col("x")).otherwise(middle).alias("threshold"), loss.alias("loss"), F.col("l_n").alias("n_left"), right["n"].alias("n_right"),
        whole_loss(kind, outputs, lambda c: F.col(f"t_{c}")).alias("whole"),
    )
    pick = F.min_by(F.struct("threshold", "loss", "n_left", "n_right"), F.struct(ranked("loss", F.col("whole")), "x"))
    return found.groupBy(*group).agg(pick.alias("b")).select(*group, "b.*")


def best_categories(cells: DataFrame, group: list[str], kind: str, outputs: list[list[str]], min_leaf: int = 1, missing_sides: bool = False) -> DataFrame:
    """Per group, the best category against the rest of ``cells (group.., x, n, w, sums..)``.

    A null ``x`` is a missing category: it stands with the rest, or, with
    ``missing_sides``, on either side. Ties go to the first category.
    """
    stats = [c for o in outputs for c in o]
    names = ["n", "w", *stats]
    cells = centred(cells, group, kind, outputs)
    totals = cells.groupBy(*group).agg(*[F.sum(c).alias(f"t_{c}") for c in names], *[F.coalesce(F.sum(F.when(F.col("x").isNull(), F.col(c))), F.lit(0)).alias(f"m_{c}") for c in names])
    known = cells.where("x is not null").join(F.broadcast(totals), group)
    options = known.withColumn("with_missing", F.explode(F.array(*[F.lit(k) for k in ((0, 1) if missing_sides else (0,))])))
    a = {c: F.col(c) + F.when(F.col("with_missing") == 1, F.col(f"m_{c}")).otherwise(F.lit(0)) for c in names}
    b = {c: F.col(f"t_{c}") - a[c] for c in names}
    loss = None
    for o in outputs:
        both = F.coalesce(a["w"] * impurity_column(kind, [a[c] for c in o], a["w"]), F.lit(0.0)) + F.coalesce(b["w"] * impurity_column(kind, [b[c] for c in o], b["w"]), F.lit(0.0))
        loss = both if loss is None else loss + both
    found = options.where((a["n"] >= min_leaf) & (b["n"] >= min_leaf)).select(*group, "x", "with_missing", loss.alias("loss"), a["n"].alias("n_in"), b["n"].alias("n_out"), whole_loss(kind, outputs, lambda c: F.col(f"t_{c}")).alias("whole"))
    pick = F.min_by(F.struct(F.col("x").alias("category"), "with_missing", "loss", "n_in", "n_out"), F.struct(ranked("loss", F.col("whole")), "x", "with_missing"))
    return found.groupBy(*group).agg(pick.alias("b")).select(*group, "b.*")


def best_stumps(cells: DataFrame, group: list[str], kind: str, outputs: list[list[str]], min_leaf: int = 1, pieces: int = 1) -> DataFrame:
    """Per group, the best cut when missing rows (null ``x``) may join either side.

    Feasibility is judged with the missing rows placed; finite against missing
    is a cut as well (``threshold`` null). Left and right are summed separately,
    each in ``pieces`` ranges.
    """
    stats = [c for o in outputs for c in o]
    names = ["n", "w", *stats]
    cells = centred(cells, group, kind, outputs)
    gone = cells.groupBy(*group).agg(*[F.coalesce(F.sum(F.when(F.col("x").isNull(), F.col(c))), F.lit(0)).alias(f"m_{c}") for c in names])
    run = in_pieces(cells.where("x is not null"), group, "x", names, pieces, right=True)
    run = run.join(F.broadcast(gone), group).withColumn("missing_side", F.explode(F.array(F.lit(0), F.lit(1))))
    a = {c: F.col(f"l_{c}") + F.when(F.col("missing_side") == 0, F.col(f"m_{c}")).otherwise(F.lit(0)) for c in names}
    b = {c: F.col(f"r_{c}") + F.when(F.col("missing_side") == 1, F.col(f"m_{c}")).otherwise(F.lit(0)) for c in names}
    loss = None
    for o in outputs:
        both = F.coalesce(a["w"] * impurity_column(kind, [a[c] for c in o], a["w"]), F.lit(0.0)) + F.coalesce(b["w"] * impurity_column(kind, [b[c] for c in o], b["w"]), F.lit(0.0))
        loss = both if loss is None else loss + both
    middle = F.col("x") / 2 + F.col("nx") / 2
    apart = F.col("nx").isNull() | (F.col("nx").cast("float") > F.col("x").cast("float") + F.lit(1e-7).cast("float"))
    found = run.where(apart & (a["n"] >= min_leaf) & (b["n"] >= min_leaf)).select(
        *group, "x", "missing_side", F.when(middle == F.col("nx"), F.col("x")).otherwise(middle).alias("threshold"), loss.alias("loss"), a["n"].alias("n_left"), b["n"].alias("n_right"),
        whole_loss(kind, outputs, lambda c: a[c] + b[c]).alias("whole"),
    )
    pick = F.min_by(F.struct("threshold", "missing_side", "loss", "n_left", "n_right"), F.struct(ranked("loss", F.col("whole")), "x", "missing_side"))
    return found.groupBy(*group).agg(pick.alias("b")).select(*group, "b.*")


def best_reward_cuts(cells: DataFrame, group: list[str], rewards: tuple[str, str], min_leaf: int = 1, pieces: int = 1) -> DataFrame:
    """Per group of ``cells (group.., x, n, rewards..)``, the cut that earns most
    when one side goes to one child and the rest to the other: ``threshold,
    reward, left_child``. Ties go to the smallest value, then to the first child."""
    known = cells.where("x is not null")
    names = ["n", *rewards]
    run = in_pieces(known, group, "x", names, pieces)
    right = {c: F.col(f"t_{c}") - F.col(f"l_{c}") for c in names}
    a, b = rewards
    run = run.select(*group, "x", "nx", F.col("l_n").alias("ln"), right["n"].alias("rn"), (F.col(f"l_{a}") + right[b]).alias("straight"), (F.col(f"l_{b}") + right[a]).alias("crossed"))
    apart = F.col("nx").cast("float") > F.col("x").cast("float") + F.lit(1e-7).cast("float")
    middle = F.col("x") / 2 + F.col("nx") / 2
    scored = run.where(apart & (F.col("ln") >= min_leaf) & (F.col("rn") >= min_leaf)).select(
        *group, "x", F.when(middle == F.col("nx"), F.col("x")).otherwise(middle).alias("threshold"), F.greatest("straight", "crossed").alias("reward"), (F.col("crossed") > F.col("straight")).cast("int").alias("left_child")
    )
    return scored.groupBy(*group).agg(F.max_by(F.struct("threshold", "reward", "left_child"), F.struct("reward", -F.col("x"))).alias("b")).select(*group, "b.*")
