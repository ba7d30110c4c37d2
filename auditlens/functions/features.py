"""Declared features: eight kinds of derived number, each one Column expression."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditlens import fixed
from auditlens.functions.scalars import c, flag, safe_num, safe_ts


@dataclass(frozen=True)
class FeatureRule:
    name: str
    feature_type: str
    first_column: str
    second_column: str | None = None


def safe_name(name: str | None, default: str) -> str:
    """Rule or feature name usable as a column: word characters only, at most 63."""
    text = re.sub(r"[^a-zA-Z0-9_]", "_", (name or "").strip())
    if not text:
        return default
    return (text if text[0].isalpha() or text[0] == "_" else f"col_{text}")[:63]


def resolve(columns: Sequence[str], name: str) -> str:
    """Joined column for ``table.column`` or a bare name that occurs in one table only."""
    if name in columns:
        return name
    if "." in name:
        raise ValueError(f"Column not found: {name}")
    hits = [full for full in columns if full.split(".", 1)[-1] == name]
    if not hits:
        raise ValueError(f"Column not found: {name}")
    if len(hits) > 1:
        raise ValueError(f"Column is ambiguous: {name}. Matches: {hits[:10]}")
    return hits[0]


Typed = tuple[Column, T.DataType]


def _days_between(a: Typed, b: Typed) -> Column:
    micros = F.timestamp_diff("MICROSECOND", safe_ts(*b), safe_ts(*a))
    return micros / F.lit(86_400_000_000.0)


ONE_COLUMN: dict[str, Callable[[Typed], Column]] = {
    "numeric": lambda a: safe_num(*a),
    "missingflag": lambda a: flag(a[0].isNull()),
    "isweekend": lambda a: flag(F.dayofweek(safe_ts(*a)).isin(1, 7)),
    "isbusinesshour": lambda a: flag(F.hour(safe_ts(*a)).between(*fixed.BUSINESS_HOURS)),
}
TWO_COLUMNS: dict[str, Callable[[Typed, Typed], Column]] = {
    "difference": lambda a, b: safe_num(*a) - safe_num(*b),
    "ratio": lambda a, b: F.try_divide(safe_num(*a), safe_num(*b)),
    "sum": lambda a, b: F.coalesce(safe_num(*a), F.lit(0.0)) + F.coalesce(safe_num(*b), F.lit(0.0)),
    "daysbetween": _days_between,
}


def feature(rule: FeatureRule, schema: T.StructType) -> Column:
    """Expression of one declared feature over a joined schema."""

    def typed(name: str) -> Typed:
        full = resolve(schema.names, name)
        return c(full), schema[full].dataType

    kind = (rule.feature_type or "").strip().lower()
    if kind in ONE_COLUMN:
        return ONE_COLUMN[kind](typed(rule.first_column))
    if kind in TWO_COLUMNS and rule.second_column:
        return TWO_COLUMNS[kind](typed(rule.first_column), typed(rule.second_column))
    raise ValueError(f"Unsupported feature type: {rule.feature_type}")


def apply_features(
    df: DataFrame, rules: Sequence[FeatureRule]
) -> tuple[DataFrame, list[str], list[str]]:
    """Add the features in one projection. Returns the frame, their names and warnings."""
    added: dict[str, Column] = {}
    warnings: list[str] = []
    for number, rule in enumerate(rules, start=1):
        name = safe_name(rule.name, f"Feature {number}")
        while name in added:
            name = f"{name}_{len(added) + 1}"
        try:
            added[name] = feature(rule, df.schema)
        except ValueError as problem:
            warnings.append(f"Skipped feature rule '{name}': {problem}")
    return df.withColumns(added) if added else df, list(added), warnings
