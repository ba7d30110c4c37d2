"""Qualified names, row locators and column pruning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlens import fixed
from auditlens.functions.scalars import c, family
from auditlens.operators.ordering import _run


def qualify(df: DataFrame, table: str, *, datetimes_as_text: bool = False) -> DataFrame:
    """Columns renamed ``table.column``; dates and timestamps optionally as text."""
    return df.select(*[
        (c(f.name).cast("string") if datetimes_as_text and family(f.dataType) == "datetime"
         else c(f.name)).alias(f"{table}.{f.name}")
        for f in df.schema
    ])


def to_model_name(name: str) -> str:
    """``table.column`` as the model sees it: ``table_column``."""
    return name.replace(".", "_", 1)


def to_joined_name(name: str, tables: Sequence[str] = fixed.MODEL_TABLES) -> str:
    """Back from ``table_column``: the longest known table prefix wins, else the first part."""
    if "." in name:
        return name
    known = [t for t in tables if name.startswith(f"{t}_")]
    table = max(known, key=len) if known else name.partition("_")[0]
    rest = name[len(table) + 1:]
    return f"{table}.{rest}" if rest or "_" in name else name


def with_model_names(df: DataFrame) -> DataFrame:
    return df.select(*[c(n).alias(to_model_name(n)) for n in df.columns])


def with_joined_names(df: DataFrame, tables: Sequence[str] = fixed.MODEL_TABLES) -> DataFrame:
    return df.select(*[c(n).alias(to_joined_name(n, tables)) for n in df.columns])


def with_locator(df: DataFrame, table: str) -> DataFrame:
    """Qualified columns of a file-backed table plus where each row is stored."""
    place = F.concat_ws("#", F.col("_metadata.file_path"), F.col("_metadata.row_index"))
    columns = [c(n).alias(f"{table}.{n}") for n in df.columns]
    return df.select(place.alias(f"__ml_locator__{table}"), *columns)


def present_ratios(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Share of non-null values per column, in one pass; 0 for an empty frame. Runs a job."""
    total, *counts = _run(df, [F.count("*"), *[F.count(c(n)) for n in columns]])
    return {n: (k / total if total else 0.0) for n, k in zip(columns, counts)}


def drop_sparse(
    df: DataFrame, min_ratio: float = fixed.MIN_PRESENT_RATIO, keep: Sequence[str] = ()
) -> DataFrame:
    """Keep columns that are filled often enough; ``keep`` columns stay in any case."""
    candidates = [n for n in df.columns if n not in keep]
    limit = max(0.0, min(float(min_ratio), 1.0))
    ratios = present_ratios(df, candidates)
    return df.select(*[c(n) for n in df.columns if n in keep or ratios[n] >= limit])


def preview(df: DataFrame, rows: int) -> tuple[DataFrame, list[str]]:
    """A preview of the final rows; there is no limit per source table."""
    cap = max(1, int(rows))
    return df.limit(cap), [f"The final result is capped at {cap} rows; sources are not limited."]
