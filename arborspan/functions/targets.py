"""Targets and weights: label dictionaries, class weights, standardisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A spread below this share of the mean square counts as none.
FLAT = 10 * 2.220446049250313e-16


def label_dictionary(df: DataFrame, column: str, max_classes: int = 1000) -> list:
    """Sorted distinct labels; an error for nulls or too many of them."""
    values = [r[0] for r in df.select(column).distinct().limit(max_classes + 2).collect()]
    if any(v is None for v in values):
        raise ValueError(f"target {column!r} holds nulls")
    if len(values) > max_classes:
        raise ValueError(f"target {column!r} has more than {max_classes} classes")
    return sorted(values)


def encode(column: str, classes: list) -> Column:
    """Code of a label; null for an unknown one."""
    if not classes:
        return F.lit(None).cast("int")
    return F.coalesce(*[F.when(F.col(column) == F.lit(c), F.lit(k)) for k, c in enumerate(classes)])


def decode(code: Column, classes: list) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in classes]), code.cast("int") + 1)


def label_codes(df: DataFrame, column: str) -> DataFrame:
    """Dictionary table ``(label, code)``."""
    from pyspark.sql.window import Window

    labels = df.select(F.col(column).alias("label")).where("label is not null").distinct()
    return labels.withColumn("code", (F.dense_rank().over(Window.orderBy("label")) - 1).cast("int"))


def target_checks(ys: dict[str, Column], classification: bool) -> dict[str, Column]:
    """Aggregates of :func:`judge_targets`: rows whose code is unknown, or whose number isn't finite."""
    bad = lambda y: y.isNull() if classification else y.isNull() | F.isnan(y) | (F.abs(y) == float("inf"))
    return {f"bad {name}": F.sum(F.when(bad(y), 1).otherwise(0)) for name, y in ys.items()}


def judge_targets(row, names: list[str], classification: bool) -> None:
    for name in names:
        if row[f"bad {name}"]:
            raise ValueError(f"target holds labels that the model does not know ({name})" if classification else "regression targets must be finite")


def weight_column(weight: str | None) -> Column:
    """Sample weight in single precision; 1 where none is given."""
    return F.lit(1.0) if weight is None else F.coalesce(F.col(weight).cast("double"), F.lit(1.0)).cast("float").cast("double")


def weight_checks(w: Column) -> dict[str, Column]:
    """Aggregates of :func:`judge_weights`."""
    return {"bad weights": F.sum(F.when((w < 0) | F.isnan(w) | (w == float("inf")), 1).otherwise(0)), "most weight": F.max(w)}


def judge_weights(row) -> None:
    """Weights are finite, not negative and not all zero."""
    if row["bad weights"]:
        raise ValueError("sample weights must be finite and not negative")
    if not row["most weight"]:
        raise ValueError("at least one sample weight must be positive")


def class_multipliers(class_weight, classes: list[list]) -> list[dict]:
    """Per output, the multiplier of each label. ``class_weight`` is a mapping
    for one output, or a mapping or None for each."""
    if class_weight is None:
        return [{} for _ in classes]
    given = [class_weight] if isinstance(class_weight, dict) else list(class_weight)
    if isinstance(class_weight, dict) and len(classes) > 1:
        raise ValueError("class_weight needs one mapping per output")
    if len(given) != len(classes):
        raise ValueError("class_weight must have one entry per output")
    for g, c in zip(given, classes):
        unknown = set(g or {}) - set(c)
        if unknown:
            raise ValueError(f"class_weight names unknown classes {sorted(map(str, unknown))}")
    return [dict(g or {}) for g in given]


def effective_weight(weight: Column, targets: list[str], multipliers: list[dict]) -> Column:
    """Weight times the class multipliers of all outputs."""
    for t, m in zip(targets, multipliers):
        for label, factor in m.items():
            weight = weight * F.when(F.col(t) == F.lit(label), F.lit(float(factor))).otherwise(F.lit(1.0))
    return weight


def mean_aggs(ys: dict[str, Column], w: Column) -> dict[str, Column]:
    """Weighted mean of each target."""
    return {f"mean {name}": F.sum(w * y) / F.nullif(F.sum(w), F.lit(0.0)) for name, y in ys.items()}


def scaling_about(df: DataFrame, ys: dict[str, Column], w: Column, means) -> list[tuple[float, float]]:
    """(mean, population deviation) of each target, given its mean; a flat target has scale 1."""
    centre = {name: means[f"mean {name}"] or 0.0 for name in ys}
    mass = F.nullif(F.sum(w), F.lit(0.0))
    spread = df.agg(*[(F.sum(w * (y - F.lit(centre[name])) * (y - F.lit(centre[name]))) / mass).alias(name) for name, y in ys.items()]).first()
    return [(m, v**0.5 if (v := spread[name] or 0.0) > max(FLAT * FLAT * max(m * m, 1e-300), 0.0) else 1.0) for name, m in centre.items()]


def standardisation(df: DataFrame, targets: list[str], weight: str, groups: list[str] | None = None):
    """Weighted mean and population deviation of each target, as rows; a flat target has scale 1."""
    w = F.col(weight)
    if not groups:
        ys = {t: F.col(t) for t in targets}
        return scaling_about(df, ys, w, df.agg(*[c.alias(n) for n, c in mean_aggs(ys, w).items()]).first())
    mass = F.nullif(F.sum(w), F.lit(0.0))
    first = df.groupBy(*(groups or [])).agg(*[(F.sum(w * F.col(t)) / mass).alias(f"m_{t}") for t in targets])
    # one row per group (a tree of a forest): few by construction
    spread = df.join(F.broadcast(first), groups).groupBy(*groups).agg(
        *[F.first(f"m_{t}").alias(f"m_{t}") for t in targets],
        *[(F.sum(w * (F.col(t) - F.col(f"m_{t}")) * (F.col(t) - F.col(f"m_{t}"))) / mass).alias(f"v_{t}") for t in targets],
    )
    return {
        tuple(r[g] for g in groups): [(r[f"m_{t}"] or 0.0, (r[f"v_{t}"] or 0.0) ** 0.5 if (r[f"v_{t}"] or 0.0) > 0 else 1.0) for t in targets] for r in spread.collect()
    }
