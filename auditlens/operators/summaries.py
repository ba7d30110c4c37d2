"""Counts and totals over anomaly rows and runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditlens.functions.payload import payload_amount
from auditlens.functions.scalars import c, float_of, safe_num
from auditlens.functions.texts import key_label, norm_key
from auditlens.functions.features import resolve
from auditlens.operators.filters import anomaly_filter, run_filter


def money(total: Column) -> Column:
    """Exact decimal, so that the sum does not depend on the order of the rows."""
    return F.coalesce(F.sum(total.cast("decimal(28,4)")), F.lit(0)).cast("double")


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("row_count"))


def next_run_id(df: DataFrame) -> DataFrame:
    """One row: the largest run id plus one, 1 for an empty table."""
    return df.agg((F.coalesce(F.max("ml_run_id"), F.lit(0)) + 1).cast("long").alias("next_run_id"))


def feedback_summary(df: DataFrame, run_id: int | None = None) -> DataFrame:
    score = safe_num(c("feedback_score"), df.schema["feedback_score"].dataType)
    return run_filter(df, run_id).agg(
        F.count("feedback_score").alias("reviewed_count"),
        F.count_if(c("feedback_score").isNull()).alias("pending_count"),
        F.count_if(score == 1.0).alias("accepted_count"),
    )


def dataset_summary(df: DataFrame, filter_name: str = "all", run_id: int | None = None) -> DataFrame:
    """Rows and amount under a filter; without payloads the amount is 0."""
    kept = run_filter(anomaly_filter(df, filter_name), run_id)
    amount = payload_amount(c("payload")) if "payload" in df.columns else F.lit(0.0)
    return kept.agg(F.count("*").alias("total_rows"), money(amount).alias("total_amount"))


def table_options(df: DataFrame) -> DataFrame:
    """Rows per normalised table key with its label, sorted by key."""
    raw = df.groupBy("selected_tables").agg(F.count("*").alias("rows"))
    key = norm_key(F.col("selected_tables"))
    named = raw.withColumn("table_key", key).where(F.col("table_key") != "")
    return (
        named.groupBy("table_key").agg(F.sum("rows").alias("row_count"))
        .withColumn("label", key_label(F.col("table_key")))
        .orderBy("table_key")
    )


def list_summary(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count("*").alias("total_rows"),
        F.count("feedback_score").alias("reviewed_rows"),
        F.count_if(c("feedback_score").isNull()).alias("not_reviewed_rows"),
    )


def amount_total(df: DataFrame, column: str | None) -> DataFrame:
    """Sum of an amount column, text that is no number counts 0. A named column that is
    missing raises, for instance when it was dropped as sparse."""
    if not column:
        return df.limit(0).agg(F.lit(0.0).alias("amount_total"))
    name = resolve(df.columns, column)
    dtype = df.schema[name].dataType
    value = safe_num(c(name), dtype) if isinstance(dtype, T.NumericType) else float_of(
        c(name).cast("string"))
    return df.agg(money(F.coalesce(value, F.lit(0.0))).alias("amount_total"))


def run_counters(
    df: DataFrame, rule: str = "rule_flag", ml: str = "ml_flag", kept: Column | None = None
) -> DataFrame:
    """Total, rule, model and final counts; ``kept`` limits all but the total to rows that
    reached the model."""
    inside = F.lit(True) if kept is None else kept
    return df.agg(
        F.count("*").alias("total_rows"),
        F.count_if(inside & c(rule)).alias("user_rule_count"),
        F.count_if(inside & c(ml)).alias("ml_anomaly_count"),
        F.count_if(inside & (c(rule) | c(ml))).alias("final_anomaly_count"),
    )


def extreme_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], *, first: bool = False
) -> DataFrame:
    """One row per group: the one of highest (or first: lowest) order, NULLs last either way.

    Late: a hash aggregate sees the keys and the leading order column alone; only rows that hold
    the extreme value of their group are then read in full. Those of one group that still tie are
    settled by the other order columns. A hot group is reduced where its rows are, and its join
    with one row is split.
    """
    best = F.min if first else F.max
    at, lead = [f"__{i}" for i in range(len(keys))], order[0] if order else None
    groups = df.groupBy(*[c(k).alias(a) for k, a in zip(keys, at, strict=True)])
    rows = df
    if lead is not None:
        tops = groups.agg(best(c(lead)).alias("__lead"))
        meet = [c(k).eqNullSafe(F.col(a)) for k, a in zip(keys, at, strict=True)]
        rows = df.join(tops, [*meet, c(lead).eqNullSafe(F.col("__lead"))], "left_semi")
    by = F.struct(*[x for o in order[1:] for x in ((c(o).isNull(), c(o)) if first else (c(o),))] or [F.lit(0)])
    pick = F.min_by if first else F.max_by
    one = rows.groupBy(*[c(k).alias(a) for k, a in zip(keys, at, strict=True)]).agg(
        pick(F.struct(*[c(n) for n in df.columns]), by).alias("r"))
    return one.select("r.*")


def latest_per(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Row with the highest order per group, see :func:`extreme_rows`."""
    return extreme_rows(df, keys, order)


def run_report(runs: DataFrame, anomalies: DataFrame, run_id: int) -> DataFrame:
    """One row: the run with its review counts and amount. The amount and counts come from
    the run's own partition."""
    run = runs.where(c("run_id") == run_id)
    own = run_filter(anomaly_filter(anomalies, "all"), run_id)
    amount = payload_amount(c("payload")) if "payload" in anomalies.columns else F.lit(0.0)
    totals = own.agg(F.count("*").alias("__rows"), money(amount).alias("amount"))
    review = feedback_summary(anomalies, run_id)
    key = F.lit(run_id).cast("long").alias("run_id")
    out = (
        run.withColumn("run_id", c("run_id").cast("long"))
        .join(totals.select(key, "*"), "run_id")
        .join(review.select(key, "*"), "run_id")
    )
    final = F.when(c("final_anomaly_count") > 0, c("final_anomaly_count")).otherwise(c("__rows"))
    return out.select(
        "run_id", "run_name", "total_rows", final.alias("anomaly_count"), "reviewed_count",
        "pending_count", "accepted_count", "amount", "selected_model",
    )
