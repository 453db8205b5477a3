"""Logical features: what a tree may branch on."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Names of the two kinds.
CONTINUOUS = frozenset({"continuous", "numeric"})
CATEGORICAL = frozenset({"categorical", "one_hot", "onehot"})
#: A one-hot column counts as set from this value on.
ACTIVE = 0.5


@dataclass(frozen=True)
class Feature:
    """``kind``: continuous, onehot (several 0/1 columns) or label (one string column)."""

    name: str
    kind: str
    columns: tuple[str, ...]
    categories: tuple[str, ...] = ()

    @property
    def numeric(self) -> bool:
        return self.kind == "continuous"


def resolve_column(ref, columns: list[str]) -> int:
    """Position of a column given by position or unique name."""
    if isinstance(ref, bool):
        raise ValueError("a column reference must be a position or a name, not a bool")
    if isinstance(ref, int):
        if not 0 <= ref < len(columns):
            raise ValueError(f"column position {ref} is outside 0..{len(columns) - 1}")
        return ref
    found = [i for i, c in enumerate(columns) if c == ref]
    if len(found) != 1:
        raise ValueError(f"column name {ref!r} is {'ambiguous' if found else 'unknown'}")
    return found[0]


def configure_features(columns: list[str], feature_dict: dict | None = None) -> list[Feature]:
    """Logical features of ``columns``.

    ``feature_dict``: name to a reference, a list of references, or
    ``{"type": ..., "indices": [...]}``. Columns that it leaves out become
    continuous features named by position. Features named by other than strings
    come first, then the others, each sorted by name.
    """
    groups: dict = {}
    used: set[int] = set()
    names: set[str] = set()
    for key, value in (feature_dict or {}).items():
        if str(key) in names:
            raise ValueError(f"feature names must differ as text: {key!r}")
        names.add(str(key))
        kind = None
        if isinstance(value, dict):
            kind, value = value.get("type"), value["indices"]
        refs = list(value) if isinstance(value, (list, tuple, range)) else [value]
        if not refs:
            raise ValueError(f"feature {key!r} has no columns")
        at = [resolve_column(r, columns) for r in refs]
        if used & set(at) or len(set(at)) < len(at):
            raise ValueError(f"feature {key!r} uses a column that is already used")
        used |= set(at)
        if kind is None:
            kind = "categorical" if len(at) > 1 else "continuous"
        if kind not in CONTINUOUS | CATEGORICAL:
            raise ValueError(f"unknown feature type {kind!r}")
        if kind in CONTINUOUS and len(at) > 1:
            raise ValueError(f"continuous feature {key!r} must have one column")
        groups[key] = Feature(str(key), "continuous" if kind in CONTINUOUS else "onehot", tuple(columns[i] for i in at))
    for i in range(len(columns)):
        if i not in used:
            name, k = str(i), 0
            while name in names:
                k += 1
                name = f"{i}_{k}"
            names.add(name)
            groups[i if name == str(i) else name] = Feature(name, "continuous", (columns[i],))
    return [groups[k] for k in sorted(groups, key=lambda k: (isinstance(k, str), str(k)))]


def features_of(df: DataFrame, columns: list[str], feature_dict: dict | None = None, max_categories: int = 1000) -> list[Feature]:
    """As :func:`configure_features`; a string column stands for a block of one-hot
    columns, one for each of its values in order (at most ``max_categories``)."""
    out = []
    for f in configure_features(columns, feature_dict):
        if len(f.columns) == 1 and isinstance(df.schema[f.columns[0]].dataType, T.StringType):
            c = f.columns[0]
            values = [r[0] for r in df.select(c).where(F.col(c).isNotNull()).distinct().orderBy(c).limit(max_categories + 1).collect()]
            if len(values) > max_categories:
                raise ValueError(f"column {c!r} has more than {max_categories} categories")
            named = c if f.name.isdigit() else f.name
            f = Feature(named, "label", (c,), tuple(values))
        out.append(f)
    return out


def narrow(c: Column | str) -> Column:
    """A value as a double of single precision; missing (null or NaN) is null."""
    c = F.col(c) if isinstance(c, str) else c
    x = c.cast("double").cast("float").cast("double")
    return F.when(x.isNotNull() & ~F.isnan(x), x)


def is_missing(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.isNull() | F.isnan(c.cast("double"))


def active_index(columns: tuple[str, ...]) -> Column:
    """Position of the first one-hot column that is set; null if none is."""
    return F.coalesce(*[F.when(narrow(c) >= ACTIVE, F.lit(float(i))) for i, c in enumerate(columns)])


def value_column(f: Feature) -> Column:
    """A feature as one double: its value, or its category's position; null if missing."""
    if f.kind == "continuous":
        return narrow(f.columns[0])
    if f.kind == "onehot":
        return active_index(f.columns)
    return F.coalesce(*[F.when(F.col(f.columns[0]) == c, F.lit(float(i))) for i, c in enumerate(f.categories)]) if f.categories else F.lit(None).cast("double")


def category_names(f: Feature) -> list[str]:
    return list(f.categories if f.kind == "label" else f.columns)


def finite_checks(df: DataFrame, columns: list[str]) -> dict[str, Column]:
    """Aggregates of :func:`judge_finite`: rows, and rows with a value that is
    infinite or beyond single precision, by column."""
    numeric = [c for c in columns if not isinstance(df.schema[c].dataType, T.StringType)]
    beyond = lambda c: F.abs(F.col(c).cast("double").cast("float")) == float("inf")
    return {"rows": F.count(F.lit(1))} | {f"beyond {c}": F.sum(F.when(beyond(c), 1).otherwise(0)) for c in numeric}


def judge_finite(row, columns: list[str], what: str = "X") -> int:
    """Number of rows; an error if there are none or a value isn't finite."""
    found = row.asDict()
    for c in columns:
        if found.get(f"beyond {c}"):
            raise ValueError(f"{what} column {c!r} holds infinite values or values beyond single precision")
    if not found["rows"]:
        raise ValueError("no rows")
    return found["rows"]


def features_json(features: list[Feature]) -> str:
    return json.dumps([[f.name, f.kind, list(f.columns), list(f.categories)] for f in features])


def features_from_json(text: str) -> list[Feature]:
    return [Feature(n, k, tuple(c), tuple(g)) for n, k, c, g in json.loads(text)]
