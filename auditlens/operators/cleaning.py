"""Row and column cleaning before training, and its summaries."""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditlens import fixed
from auditlens.functions.scalars import (
    any_of, at_night, busday_gap, c, family, has_time, has_time_of_day, safe_ts,
)
from auditlens.operators.ordering import _run


def is_id_like(name: str) -> bool:
    return name.endswith(fixed.ID_LIKE_SUFFIXES) or any(p in name for p in fixed.ID_LIKE_PARTS)


@dataclass(frozen=True)
class InvoiceKey:
    """Columns that identify an invoice, and the status that can make it void."""

    invoice: str
    date: str
    status: str


def invoice_keys(columns: Sequence[str], tables: Sequence[str]) -> list[InvoiceKey]:
    found = []
    for table in tables:
        invoice = next((f"{table}_{n}" for n in fixed.INVOICE_COLUMNS
                        if f"{table}_{n}" in columns), None)
        key = InvoiceKey(invoice or "", f"{table}_invoice_date", f"{table}_record_status")
        if invoice and key.date in columns and key.status in columns:
            found.append(key)
    return found


#: White space of Java's ``\\s``.
BLANKS = " \t\n\x0b\f\r"

# --- duplicate groups -------------------------------------------------------------------------


def in_duplicate_group(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Add whether other rows share the full key. Counts are aggregated first and joined
    back, so a hot key costs one count per task and not one giant window group."""
    filled = df
    for key in keys:
        filled = filled.where(c(key).isNotNull())
    groups = (
        filled.groupBy(*[c(k).alias(f"__{i}") for i, k in enumerate(keys)])
        .agg(F.count("*").alias("__members"))
        .where("__members > 1")
    )
    on = [c(k) == F.col(f"__{i}") for i, k in enumerate(keys)]
    # Keys of the groups are unique, so their hash tables are even; the rows need no sort.
    return (
        df.join(groups.hint("shuffle_hash"), on, "left")
        .withColumn(name, F.col("__members").isNotNull())
        .drop("__members", *[f"__{i}" for i in range(len(keys))])
    )


def _void(key: InvoiceKey) -> Column:
    word = F.lower(F.btrim(c(key.status).cast("string"), F.lit(BLANKS)))
    return F.coalesce(word == "v", F.lit(False))


def _with_void_duplicates(df: DataFrame, keys: Sequence[InvoiceKey]) -> tuple[DataFrame, list[str]]:
    names = []
    for i, key in enumerate(keys):
        names.append(f"__void_duplicate_{i}")
        df = in_duplicate_group(df, [key.invoice, key.date], names[-1])
        df = df.withColumn(names[-1], c(names[-1]) & _void(key))
    return df, names


def drop_void_duplicates(df: DataFrame, keys: Sequence[InvoiceKey]) -> DataFrame:
    """Drop void rows of invoices that occur more than once; the other rows stay."""
    marked, names = _with_void_duplicates(df, keys)
    return marked.where(~any_of(c(n) for n in names)).drop(*names)


# --- date order and night ---------------------------------------------------------------------

Pair = tuple[str, str]


def stage_plan(columns: Sequence[str], tables: Sequence[str]) -> dict[str, list[tuple[str, str | None]]]:
    """Per table, every stage in order with the column that carries it, if any.

    Officer and disposal stages come from the table itself, the others from the first table
    of the dataset that has them.
    """

    def first(aliases: Iterable[str], owners: Sequence[str]) -> str | None:
        return next((f"{t}_{a}" for t in owners for a in aliases if f"{t}_{a}" in columns), None)

    return {
        table: [
            (stage, first(aliases, [table] if stage in fixed.STAGES_FROM_SAME_TABLE else tables))
            for stage, aliases in fixed.DATE_STAGES
        ]
        for table in tables
    }


def stage_pairs(plan: dict[str, list[tuple[str, str | None]]]) -> list[Pair]:
    """Columns of stages that follow each other directly, each pair once."""
    pairs = [
        (a, b)
        for stages in plan.values()
        for (_, a), (_, b) in zip(stages, stages[1:])
        if a and b
    ]
    return list(dict.fromkeys(pairs))


def out_of_order(pair: Pair) -> Column:
    return F.coalesce(c(pair[1]) < c(pair[0]), F.lit(False))


def drop_bad_sequence(df: DataFrame, pairs: Sequence[Pair]) -> DataFrame:
    return df.where(~any_of(out_of_order(p) for p in pairs))


def night_columns(schema: T.StructType) -> list[str]:
    return [f.name for f in schema if has_time_of_day(f.dataType)]


def night_hit(df: DataFrame, column: str) -> Column:
    return at_night(c(column), df.schema[column].dataType, fractions=True)


def drop_night(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.where(~any_of(night_hit(df, n) for n in columns))


def coerce_dates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns read as timestamps; what does not parse becomes NULL."""
    return df.withColumns({n: safe_ts(c(n), df.schema[n].dataType) for n in columns})


def gap_name(pair: Pair) -> str:
    return f"gap_days_{pair[0]}_to_{pair[1]}"


def gap_features(df: DataFrame, pairs: Sequence[Pair], drop_columns: Sequence[str] = ()) -> DataFrame:
    """Business days between neighbouring stages; the raw dates are dropped afterwards."""
    gaps = {gap_name(p): busday_gap(c(p[0]), c(p[1])) for p in pairs}
    return (df.withColumns(gaps) if gaps else df).drop(*drop_columns)


# --- columns ------------------------------------------------------------------------------------


def null_percent(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Percentage of NULLs per column, one row each, from a single pass."""
    names = list(columns or df.columns)
    counts = df.agg(F.count("*").alias("__n"), *[
        F.count(c(n)).alias(f"p{i}") for i, n in enumerate(names)
    ])
    rows = F.array(*[
        F.struct(F.lit(n).alias("column_name"),
                 F.try_divide((F.col("__n") - F.col(f"p{i}")) * 100.0, F.col("__n")).alias(
                     "null_percent"))
        for i, n in enumerate(names)
    ])
    return counts.select(F.explode(rows).alias("r")).select("r.*")


def cardinality(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exact number of distinct values per column, one row each.

    Values are reduced to distinct (column, value) pairs before they are counted.
    """
    pairs = F.array(*[
        F.struct(F.lit(n).alias("column_name"), c(n).cast("string").alias("value"))
        for n in columns
    ])
    long = df.select(F.explode(pairs).alias("p")).select("p.*").distinct()
    return long.groupBy("column_name").agg(F.count("value").alias("distinct_count"))


@dataclass(frozen=True)
class DroppedColumns:
    high_null: list[str]
    id_like: list[str]
    text_like: list[str]
    long_text: list[str]

    @property
    def all(self) -> list[str]:
        return sorted({*self.high_null, *self.id_like, *self.text_like, *self.long_text})


def filter_columns(
    df: DataFrame,
    *,
    null_limit: float = fixed.NULL_PERCENT_LIMIT,
    text_limit: int = fixed.VARCHAR_LIMIT,
    text_columns: Sequence[str] = (),
) -> tuple[DataFrame, DroppedColumns]:
    """Drop mostly-empty, identifier-like and long text columns. Runs one job.

    ``text_columns`` are free text by declaration; for the other text columns the longest
    value decides.
    """
    names = df.columns
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    row = _run(df, [F.count("*"), *[F.count(c(n)) for n in names],
                    *[F.max(F.length(c(n))) for n in texts]])
    total, present, longest = row[0], row[1:len(names) + 1], row[len(names) + 1:]
    empty = [n for n, k in zip(names, present) if total and 100 * (total - k) / total >= null_limit]
    left = [n for n in names if n not in empty]
    dropped = DroppedColumns(
        sorted(empty),
        sorted(n for n in left if is_id_like(n)),
        sorted(n for n in text_columns if n in left),
        sorted(n for n, size in zip(texts, longest)
               if n in left and n not in text_columns and (size or 0) > text_limit),
    )
    return df.select(*[c(n) for n in names if n not in dropped.all]), dropped


@dataclass(frozen=True)
class FeatureColumns:
    numeric: list[str]
    boolean: list[str]
    categorical: list[str]
    unsupported: list[str]

    @property
    def inputs(self) -> list[str]:
        return [*self.numeric, *self.boolean, *self.categorical]


#: Marks per allowed value by which columns of many values are told apart.
MARKS_PER_VALUE = 8
#: Columns whose combinations of values are counted together.
COMBINED_COLUMNS = 3


def _fewest(df: DataFrame, columns: Sequence[str], limit: int) -> list[int]:
    """Per column a number of distinct values that it has at least: the marks that its values set
    in a bit map. Plain aggregates of one pass; NULL sets none. Runs a job."""
    words = max(1, math.ceil(MARKS_PER_VALUE * limit / 64))
    marks = df.select(*[F.when(c(n).isNotNull(), F.pmod(F.xxhash64(c(n).cast("string")), F.lit(64 * words)))
                        .alias(f"m{i}") for i, n in enumerate(columns)])
    row = _run(marks, [
        F.bit_or(F.expr(f"CASE WHEN m{i} DIV 64 = {word} THEN shiftleft(1L, CAST(m{i} % 64 AS INT)) END"))
        for i in range(len(columns)) for word in range(words)])
    bits = [((value or 0) & (2**64 - 1)).bit_count() for value in row]
    return [sum(bits[i * words:(i + 1) * words]) for i in range(len(columns))]


def few_valued(df: DataFrame, columns: Sequence[str], limit: int) -> list[str]:
    """Columns with at most ``limit`` distinct values. Runs jobs: one for all columns, and one for
    every few columns that are left.

    Marks rule out the columns with more values; one with far more passes with next to no
    probability. The rest is counted exactly, after the combinations of a few columns are reduced to
    distinct ones, so no job shuffles the values of a high-cardinality column.
    """
    if not columns:
        return []
    near = [n for n, k in zip(columns, _fewest(df, columns, limit)) if k <= limit]
    exact = {}
    for start in range(0, len(near), COMBINED_COLUMNS):
        some = near[start:start + COMBINED_COLUMNS]
        combined = df.select(*[c(n) for n in some]).distinct()
        exact.update((r[0], r[1]) for r in cardinality(combined, some).collect())  # one row per column
    return [n for n in near if exact.get(n, 0) <= limit]


def select_features(
    df: DataFrame, limit: int = fixed.CATEGORY_LIMIT, text_columns: Sequence[str] = ()
) -> FeatureColumns:
    """Split columns into model inputs by type; text is categorical when it has few values."""
    by_family: dict[str, list[str]] = {}
    for f in df.schema:
        by_family.setdefault(family(f.dataType), []).append(f.name)
    numeric = sorted(by_family.get("numeric", []))
    boolean = by_family.get("boolean", [])
    candidates = [n for n in by_family.get("text", []) if n not in text_columns]
    categorical = few_valued(df, candidates, limit)
    used = {*numeric, *boolean, *categorical}
    return FeatureColumns(numeric, boolean, categorical,
                          sorted(n for n in df.columns if n not in used))


# --- summaries ----------------------------------------------------------------------------------


def cleaning_summary(
    df: DataFrame,
    invoices: Sequence[InvoiceKey] = (),
    pairs: Sequence[Pair] = (),
    nights: Sequence[str] = (),
) -> DataFrame:
    """Rows checked and rows invalid per cleaning check, all from one pass over the rows."""
    marked, names = _with_void_duplicates(df, invoices)
    checks = [
        *[("void_duplicate", k.invoice,
           F.count_if(c(k.invoice).isNotNull() & c(k.date).isNotNull()), F.count_if(c(n)))
          for k, n in zip(invoices, names)],
        *[("date_sequence", f"{a} > {b}", F.count_if(c(a).isNotNull() & c(b).isNotNull()),
           F.count_if(out_of_order((a, b)))) for a, b in pairs],
        *[("night_timestamp", n,
           F.count_if(has_time(c(n), df.schema[n].dataType, fractions=True)),
           F.count_if(night_hit(df, n))) for n in nights],
    ]
    totals = marked.agg(*[
        count.alias(f"{side}{i}")
        for i, (_, _, checked, invalid) in enumerate(checks)
        for side, count in (("checked", checked), ("invalid", invalid))
    ])
    rows = F.array(*[
        F.struct(F.lit(kind).alias("check_kind"), F.lit(target).alias("target"),
                 F.col(f"checked{i}").alias("rows_checked"),
                 F.col(f"invalid{i}").alias("rows_invalid"))
        for i, (kind, target, _, _) in enumerate(checks)
    ])
    return totals.select(F.explode(rows).alias("r")).select("r.*")
