"""Imputation, robust scaling and one-hot encoding as Column expressions.

Fitting runs a few aggregations; their results are a handful of numbers per column and live
in plain dataclasses. Applying is one projection inside the JVM.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlens.functions.scalars import c
from auditlens.operators.cleaning import FeatureColumns
from auditlens.operators.ordering import BUFFER_ROWS, _run, exact_percentiles


@dataclass(frozen=True)
class NumericStep:
    column: str
    median: float
    scale: float


@dataclass(frozen=True)
class BooleanStep:
    column: str
    mode: float


@dataclass(frozen=True)
class CategoryStep:
    column: str
    mode: str
    categories: list[str]


@dataclass(frozen=True)
class ModelFeature:
    """One model input: its name, the column it comes from and, for one-hot, the category."""

    name: str
    source: str
    kind: str
    category: str | None = None

    @property
    def display(self) -> str:
        return self.source if self.category is None else f"{self.source}::{self.category}"


@dataclass(frozen=True)
class Preprocessor:
    numeric: list[NumericStep] = field(default_factory=list)
    boolean: list[BooleanStep] = field(default_factory=list)
    categorical: list[CategoryStep] = field(default_factory=list)

    def features(self) -> list[ModelFeature]:
        return [
            *[ModelFeature(s.column, s.column, "numeric") for s in self.numeric],
            *[ModelFeature(s.column, s.column, "boolean") for s in self.boolean],
            *[ModelFeature(f"{s.column}_{v}", s.column, "category", v)
              for s in self.categorical for v in s.categories],
        ]

    def columns(self) -> list[Column]:
        """Transformed values, in the order of :meth:`features`."""
        out = [scaled(c(s.column), s) for s in self.numeric]
        out += [F.coalesce(c(s.column).cast("double"), F.lit(s.mode)) for s in self.boolean]
        for s in self.categorical:
            value = F.coalesce(c(s.column).cast("string"), F.lit(s.mode))
            out += [F.when(value == v, 1.0).otherwise(0.0) for v in s.categories]
        return out

    def vector(self) -> Column:
        return F.array(*self.columns())

    def to_dict(self) -> dict:
        return asdict(self)

    @classmethod
    def from_dict(cls, data: dict) -> Preprocessor:
        return cls(
            [NumericStep(**s) for s in data["numeric"]],
            [BooleanStep(**s) for s in data["boolean"]],
            [CategoryStep(**s) for s in data["categorical"]],
        )


def scaled(value: Column, step: NumericStep) -> Column:
    return (F.coalesce(_number(value), F.lit(step.median)) - step.median) / step.scale


def _number(value: Column) -> Column:
    """Double with NaN as NULL."""
    return F.nanvl(value.cast("double"), F.lit(None).cast("double"))


def fit_numeric(
    df: DataFrame, columns: Sequence[str], *, buffer_rows: int = BUFFER_ROWS
) -> list[NumericStep]:
    """Median of the present values, then the quartile range with the median filled in.

    A zero range scales by 1. Columns without any value are left out.
    """
    found = exact_percentiles(df, columns, [0.25, 0.5, 0.75], buffer_rows=buffer_rows)
    known = {n: m for n, (_, m, _) in found.items() if m is not None}
    ranges = {n: (found[n][0], found[n][2]) for n in known}
    # Only where values are missing does filling move the quartiles.
    gaps = _run(df, [F.count_if(_number(c(n)).isNull()) for n in known]) if known else ()
    filled = df.select(*[F.coalesce(_number(c(n)), F.lit(known[n])).alias(n)
                         for n, missing in zip(known, gaps) if missing])
    ranges.update(exact_percentiles(filled, filled.columns, [0.25, 0.75], buffer_rows=buffer_rows))
    return [NumericStep(n, m, (ranges[n][1] - ranges[n][0]) or 1.0) for n, m in known.items()]


def fit_modes(df: DataFrame, columns: Sequence[str]) -> dict[str, object]:
    """Most frequent value per column, ties to the smallest. Meant for few-valued columns:
    the counts of all values of a column are kept in one buffer."""
    if not columns:
        return {}
    row = df.agg(*[F.mode(c(n), True).alias(f"m{i}") for i, n in enumerate(columns)]).first()
    return dict(zip(columns, row))


def fit_categories(df: DataFrame, columns: Sequence[str]) -> list[CategoryStep]:
    """Mode and sorted values of few-valued columns; columns without any value are left out."""
    texts = df.select(*[c(n).cast("string").alias(n) for n in columns])
    modes = fit_modes(texts, columns)
    if not columns:
        return []
    row = texts.agg(*[F.sort_array(F.collect_set(c(n))).alias(f"v{i}")
                      for i, n in enumerate(columns)]).first()
    return [CategoryStep(n, modes[n], list(values))
            for n, values in zip(columns, row) if modes[n] is not None]


def fit_preprocessor(
    df: DataFrame, columns: FeatureColumns, *, buffer_rows: int = BUFFER_ROWS
) -> Preprocessor:
    """Fit on a feature frame whose boolean columns are already 1.0 / 0.0 / NULL."""
    modes = fit_modes(df, columns.boolean)
    return Preprocessor(
        fit_numeric(df, columns.numeric, buffer_rows=buffer_rows),
        [BooleanStep(n, float(m)) for n, m in modes.items() if m is not None],
        fit_categories(df, columns.categorical),
    )
