"""Declared equi-joins, key tests against other tables and join diagnostics."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlens import fixed
from auditlens.functions.scalars import c, family
from auditlens.operators.projection import qualify
from auditlens.sources.catalog import Catalog
from auditlens.sources.staging import stage

# --- Fixed values: accepted spellings of join types --------------------------------------
JOIN_TYPES = {
    "inner": "inner", "left": "left", "left outer": "left", "right": "right",
    "right outer": "right", "full": "full", "full outer": "full",
}


@dataclass(frozen=True)
class JoinStep:
    left_table: str
    left_column: str
    right_table: str
    right_column: str
    join_type: str = "inner"


def join_type(name: str | None) -> str:
    word = (name or "inner").strip().lower()
    if word not in JOIN_TYPES:
        raise ValueError(f"Unsupported join type '{name}'. Use inner, left, right or full.")
    return JOIN_TYPES[word]


def check_joins(catalog: Catalog, tables: Sequence[str], joins: Sequence[JoinStep]) -> None:
    """Raise unless the steps connect all selected tables, one new table per step."""
    for table in tables:
        catalog.table(table)
    if len(tables) > 1 and not joins:
        raise ValueError("Two or more tables need at least 1 join.")
    joined = {tables[0]}
    for number, step in enumerate(joins, start=1):
        place = f"Join step {number}"
        for side, table in (("left", step.left_table), ("right", step.right_table)):
            if table not in tables:
                raise ValueError(f"{place}: {side} table '{table}' is not selected.")
        if step.left_table == step.right_table:
            raise ValueError(f"{place}: self-joins are not supported: '{step.left_table}'.")
        if step.left_table not in joined:
            raise ValueError(f"{place}: left table '{step.left_table}' is not joined yet.")
        if step.right_table in joined:
            raise ValueError(f"{place}: right table '{step.right_table}' is already joined.")
        for table, column in ((step.left_table, step.left_column),
                              (step.right_table, step.right_column)):
            if column not in catalog.table(table).columns:
                raise ValueError(f"{place}: column not found: {table}.{column}")
        join_type(step.join_type)
        joined.add(step.right_table)
    loose = [t for t in tables if t not in joined]
    if loose:
        raise ValueError(f"Tables not connected by the joins: {loose}")


def full_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Full outer equi-join that survives a hot key.

    Spark splits skewed partitions of left, inner and anti joins but not of full joins, so
    the rows of the right side without a partner are added by an anti join on distinct keys. Of
    the left side the second pass reads the key alone.
    """
    matched = left.join(right, c(left_key) == c(right_key), "left")
    keys = left.where(c(left_key).isNotNull()).select(c(left_key).alias("__key")).distinct()
    unmatched = right.join(keys, c(right_key) == F.col("__key"), "left_anti")
    return matched.unionByName(unmatched, allowMissingColumns=True)


def join_tables(
    catalog: Catalog,
    tables: Sequence[str],
    joins: Sequence[JoinStep],
    *,
    datetimes_as_text: bool = False,
) -> DataFrame:
    """Chain of single-column equi-joins over qualified columns. Keys are compared as they
    are. Sides are not forced to broadcast: Spark does so when their size allows. What a chain has
    joined before a full step is written once, as that step reads it twice."""
    check_joins(catalog, tables, joins)

    def source(table: str) -> DataFrame:
        return qualify(catalog.table(table), table)

    out = source(tables[0])
    for number, step in enumerate(joins):
        left, right = (f"{step.left_table}.{step.left_column}",
                       f"{step.right_table}.{step.right_column}")
        how = join_type(step.join_type)
        if how == "full":
            before = stage(out, "joined") if number else out
            out = full_join(before, source(step.right_table), left, right)
        else:
            out = out.join(source(step.right_table), c(left) == c(right), how)
    order = [f"{t}.{n}" for t in tables for n in catalog.table(t).columns]
    texts = {f.name for f in out.schema if datetimes_as_text and family(f.dataType) == "datetime"}
    return out.select(*[c(n).cast("string").alias(n) if n in texts else c(n) for n in order])


def distinct_keys(df: DataFrame, column: str, name: str = "__key") -> DataFrame:
    return df.where(c(column).isNotNull()).select(c(column).alias(name)).distinct()


def missing_in(
    df: DataFrame, key: str, other: DataFrame, other_key: str, scope: Column | None = None
) -> DataFrame:
    """Rows in scope with a key that the other table does not have."""
    wanted = df.where(c(key).isNotNull() if scope is None else c(key).isNotNull() & scope)
    keys = distinct_keys(other, other_key)
    return wanted.join(keys, c(key) == F.col("__key"), "left_anti")


def exists_in(
    df: DataFrame, key: str, other: DataFrame, other_key: str, scope: Column | None = None
) -> DataFrame:
    """Rows in scope with a key that the other table has."""
    wanted = df.where(c(key).isNotNull() if scope is None else c(key).isNotNull() & scope)
    keys = distinct_keys(other, other_key)
    return wanted.join(keys, c(key) == F.col("__key"), "left_semi")


def common_keys(left: DataFrame, left_key: str, right: DataFrame, right_key: str) -> DataFrame:
    """Distinct keys both columns hold. Both sides are reduced before they meet."""
    return distinct_keys(left, left_key, "join_key").join(
        distinct_keys(right, right_key, "join_key"), "join_key", "left_semi"
    )


def common_key_count(
    left: DataFrame, left_key: str, right: DataFrame, right_key: str
) -> DataFrame:
    return common_keys(left, left_key, right, right_key).agg(
        F.count("*").alias("common_key_count")
    )


def common_key_sample(
    left: DataFrame, left_key: str, right: DataFrame, right_key: str, size: int = 20
) -> DataFrame:
    rows = max(1, min(int(size), 100))
    return common_keys(left, left_key, right, right_key).orderBy("join_key").limit(rows)


def column_sample(df: DataFrame, column: str, size: int = 10) -> DataFrame:
    """Smallest non-null values of a column, repeats included."""
    rows = max(1, min(int(size), 100))
    return df.where(c(column).isNotNull()).select(c(column)).orderBy(c(column)).limit(rows)


def join_diagnostics(
    catalog: Catalog, tables: Sequence[str], joins: Sequence[JoinStep], *, full: bool = False
) -> DataFrame:
    """One row per join step: keys, types, row counts and, in full mode, key overlap and samples."""
    check_joins(catalog, tables, joins)
    if not joins:
        raise ValueError("There is no join step to describe.")
    measures = None
    for number, step in enumerate(joins, start=1):
        left, right = catalog.table(step.left_table), catalog.table(step.right_table)
        for part in _step_measures(left, step.left_column, right, step.right_column, full):
            part = part.select(F.lit(number).alias("step"), "*")
            measures = part if measures is None else measures.unionByName(part, True)
    names = [n for n in measures.columns if n != "step"]
    by_step = measures.groupBy("step").agg(*[F.max(n).alias(n) for n in names])

    def fact(values) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), F.col("step"))

    def key_type(table: str, column: str) -> str:
        return catalog.table(table).schema[column].dataType.simpleString()

    return by_step.select(
        "step",
        fact([f"{s.left_table}.{s.left_column}" for s in joins]).alias("left_key"),
        fact([f"{s.right_table}.{s.right_column}" for s in joins]).alias("right_key"),
        fact([key_type(s.left_table, s.left_column) for s in joins]).alias("left_type"),
        fact([key_type(s.right_table, s.right_column) for s in joins]).alias("right_type"),
        fact([join_type(s.join_type) for s in joins]).alias("join_type"),
        F.lit("full" if full else "light").alias("mode"),
        *names,
    )


def _step_measures(
    left: DataFrame, left_key: str, right: DataFrame, right_key: str, full: bool
) -> list[DataFrame]:
    """One-row frames with the measures of a join step."""
    def sample(df: DataFrame, key: str, name: str) -> DataFrame:
        return df.agg(F.array_sort(F.collect_list(c(key).cast("string"))).alias(name))

    parts = [left.agg(F.count("*").alias("left_rows")), right.agg(F.count("*").alias("right_rows"))]
    if full:
        keys = (left, left_key, right, right_key)
        parts += [
            common_key_count(*keys),
            sample(common_key_sample(*keys), "join_key", "common_key_sample"),
            sample(column_sample(left, left_key), left_key, "left_sample"),
            sample(column_sample(right, right_key), right_key, "right_sample"),
        ]
    return parts


def preset_joins(dataset: str) -> list[JoinStep]:
    """Joins of a trained dataset: first the base, then children of the cheque slip."""
    tables = fixed.DATASETS[dataset]
    steps = []
    for table in tables[1:]:
        if table in ("schedule3", "ecs"):
            how = "left" if table == "schedule3" else "inner"
            steps.append(JoinStep("cheque_slip", "fk_dak", table, "fk_dak", how))
        else:
            steps.append(JoinStep(fixed.BASE_TABLE, "id", table, "fk_dak"))
    return steps


def resolve_dataset(tables: Sequence[str]) -> str:
    """Name of the trained dataset for a selection in any order; the base table is optional."""
    wanted = {str(t).strip().lower() for t in tables}
    for name, members in fixed.DATASETS.items():
        children = set(members) - {fixed.BASE_TABLE}
        if wanted == set(members) or (children and wanted == children):
            return name
    raise ValueError(f"No trained dataset for the selected tables: {sorted(wanted)}")


def default_amount_column(tables: Sequence[str]) -> str | None:
    names = {str(t).strip().lower() for t in tables}
    for table in ("dak_info", fixed.BASE_TABLE):
        if table in names:
            return f"{table}.amount"
    return None


def training_join(catalog: Catalog, dataset: str) -> DataFrame:
    return join_tables(catalog, list(fixed.DATASETS[dataset]), preset_joins(dataset))
