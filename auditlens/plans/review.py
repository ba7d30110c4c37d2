"""Review and report: pages of predictions, the anomaly list and their summaries."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlens import fixed
from auditlens.functions.payload import payload_amount
from auditlens.functions.scalars import c, truthy
from auditlens.functions.texts import (
    description, feedback_label, key_label, norm_key, type_label,
)
from auditlens.operators.enrich import attach_payload, enrich_names, rebuild_payload
from auditlens.operators.explain import reason_sentence
from auditlens.operators.filters import anomaly_filter, anomaly_list_filter, run_filter
from auditlens.operators.ordering import page
from auditlens.operators.summaries import dataset_summary, list_summary, money, table_options
from auditlens.sources.catalog import Catalog
from auditlens.sources.staging import stage

# --- Fixed values: columns a page needs ---------------------------------------------------
PAGE_COLUMNS = (
    "id", "selected_tables", "user_rule_name", "user_rule", "isolation_rule", "ml_if_score",
    "ml_threshold", "feedback_score", "ml_run_id", "fk_dak", "feature_values",
)


def review_page(
    df: DataFrame, filter_name: str = "all", run_id: int | None = None,
    limit: int | None = None, offset: int = 0,
) -> DataFrame:
    """One review page in id order, with the page columns only."""
    kept = run_filter(anomaly_filter(df, filter_name), run_id)
    extra = [n for n in ("builtin_reason", "payload", "ml_reason") if n in df.columns]
    kept = kept.select(*[c(n) for n in (*PAGE_COLUMNS, *extra) if n in df.columns])
    return page(kept, "id", limit=max(1, int(limit or fixed.PAGE_SIZE)),
                offset=max(0, int(offset or 0)))


def anomaly_page(
    df: DataFrame, table_key: str | None = None, anomaly_type: str = "all",
    review_status: str = "all", limit: int | None = None, offset: int = 0,
) -> DataFrame:
    """One page of the anomaly list, newest first, at most 500 rows."""
    kept = anomaly_list_filter(df, table_key, anomaly_type, review_status)
    rows = min(max(1, int(limit or fixed.PAGE_SIZE)), fixed.LIST_PAGE_LIMIT)
    return page(kept, "id", limit=rows, offset=max(0, int(offset or 0)), descending=True)


def stored_sentence(df: DataFrame, signals: Column) -> Column:
    """The sentence that the run has stored, made from the signals only where there is none."""
    made = reason_sentence(signals)
    return F.coalesce(c("ml_reason"), made) if "ml_reason" in df.columns else made


def to_prediction(df: DataFrame) -> DataFrame:
    """Prediction records: flags, scores, feedback and all reasons of an anomaly row."""
    by_rule, by_model = truthy(c("user_rule")), truthy(c("isolation_rule"))
    label = feedback_label(c("feedback_score"))
    has = df.columns
    values = c("feature_values") if "feature_values" in has else None
    signals = F.when(by_model, values["signals"]) if values is not None else None
    sentence = F.lit(None).cast("string")
    if signals is not None:
        sentence = F.when(F.size(signals) > 0, stored_sentence(df, signals))
    builtin = F.nullif(F.trim(c("builtin_reason")), F.lit("")) if "builtin_reason" in has \
        else F.lit(None).cast("string")
    named = F.when(c("user_rule_name") != "", c("user_rule_name"))
    reasons = F.array_distinct(F.array_compact(F.array(named, builtin, sentence)))
    return df.select(
        c("id").alias("prediction_id"),
        norm_key(c("selected_tables")).alias("review_key"),
        by_rule.alias("rule_flag"),
        by_model.alias("ml_flag"),
        c("user_rule_name").alias("rule_codes"),
        F.when(by_rule, 1.0).otherwise(0.0).alias("rule_score"),
        c("ml_if_score").alias("ml_score"),
        c("ml_threshold"),
        F.coalesce(c("ml_if_score"), F.lit(1.0)).alias("final_score"),
        F.when(label.isNotNull(), "REVIEWED").otherwise("PENDING_REVIEW").alias("review_status"),
        label.alias("feedback"),
        reasons.alias("reason_list"),
        builtin.isNotNull().alias("default_rule_flag"),
        c("ml_run_id"), c("fk_dak"),
        *([signals.alias("signals"), values["rule_evidence"].alias("rule_evidence")]
          if values is not None else []),
        *([c("payload")] if "payload" in has else []),
    )


@dataclass(frozen=True)
class Review:
    rows: DataFrame
    summary: DataFrame
    limit: int
    offset: int


def latest_run(runs: DataFrame, dataset: str | None = None) -> int | None:
    """Newest run, of one dataset or of all."""
    kept = runs if dataset is None else runs.where(
        F.array_join("source_tables", ".") == F.lit(dataset))
    return kept.agg(F.max("run_id")).first()[0]


#: A page of at most so many rows looks its payloads up by ids that are part of the plan.
LOOKUP_ROWS = 2_000


def review_rows(
    anomalies: DataFrame,
    *,
    run_id: int | None = None,
    filter_name: str = "all",
    limit: int | None = None,
    offset: int = 0,
    payloads: DataFrame | Callable[[Sequence[int]], DataFrame] | None = None,
    catalog: Catalog | None = None,
    tables: Sequence[str] = (),
    lookups: Mapping[str, DataFrame] | None = None,
) -> Review:
    """One page of predictions with payload and names, and totals over all filtered rows.

    The page is found without payloads and written once. Its ids then filter the payloads - a
    frame, or a function of ids such as :meth:`ResultStore.rows_of`; by default the column of the
    anomalies, within the runs of the page - so that files and row groups without one of them are
    skipped and no payload is shuffled. Payloads without business data are rebuilt from the
    sources in the same way. A page of more than LOOKUP_ROWS rows, if somebody asks for one, gets
    the same rows by joins.
    """
    size, start = max(1, int(limit or fixed.PAGE_SIZE)), max(0, int(offset or 0))
    narrow = anomalies.drop("payload")
    rows = stage(to_prediction(review_page(narrow, filter_name, run_id, size, start)), "page")
    small = size <= LOOKUP_ROWS
    ids = [r[0] for r in rows.select("prediction_id").collect()] if small else None
    if payloads is None and "payload" in anomalies.columns:
        payloads = anomalies.select("id", "ml_run_id", "payload")
        if small:
            runs = [r[0] for r in rows.select("ml_run_id").distinct().collect()]
            payloads = payloads.where(c("ml_run_id").isin(runs))
        payloads = payloads.where(c("payload").isNotNull()).select("id", "payload")
    if payloads is not None:
        if callable(payloads):
            payloads = payloads(ids if small else [r[0] for r in rows.select("prediction_id").collect()])
        stored = payloads.where(c("id").isin(ids)) if small else payloads
        stored = stored.select(c("id").alias("prediction_id"), "payload")
        rebuilt = None
        if catalog is not None and tables:
            keys = rows.select(c("fk_dak").cast("long").alias("record_key"))
            listed = [r[0] for r in keys.where("record_key > 0").distinct().collect()] if small else None
            rebuilt = rebuild_payload(keys, catalog, tables, listed=listed)
        rows = attach_payload(rows, stored, rebuilt, id_column="prediction_id", one_page=small)
        rows = enrich_names(rows, lookups or {})
        rows = rows.withColumn("amount", payload_amount(c("payload")))
    return Review(rows.orderBy("prediction_id"),
                  dataset_summary(anomalies, filter_name, run_id), size, start)


def page_amount_total(review: Review) -> DataFrame:
    return review.rows.agg(money(c("amount")).alias("page_total_amount"))


@dataclass(frozen=True)
class AnomalyList:
    rows: DataFrame
    summary: DataFrame
    table_options: DataFrame


def anomaly_rows_view(df: DataFrame) -> DataFrame:
    """Anomaly list rows: key, label, kind, description and feedback."""
    by_rule, by_model = truthy(c("user_rule")), truthy(c("isolation_rule"))
    feedback = feedback_label(c("feedback_score"))
    sentence = F.lit(None).cast("string")
    if "feature_values" in df.columns:
        signals = c("feature_values")["signals"]
        sentence = F.when(by_model & (F.size(signals) > 0), stored_sentence(df, signals))
    return df.select(
        "id", "fk_dak",
        norm_key(c("selected_tables")).alias("table_key"),
        key_label(c("selected_tables")).alias("table_label"),
        type_label(by_rule, by_model).alias("anomaly_type"),
        description(by_rule, by_model, c("user_rule_name"), sentence).alias(
            "anomaly_description"),
        F.coalesce(feedback, F.lit("Not reviewed")).alias("user_feedback"),
        feedback.isNotNull().alias("reviewed"),
        c("ml_run_id").alias("run_id"),
    )


def anomaly_list(
    df: DataFrame, table_key: str | None = None, anomaly_type: str = "all",
    review_status: str = "all", limit: int | None = None, offset: int = 0,
) -> AnomalyList:
    """A page of the anomaly list with the totals of the filter and the table choices."""
    missing = [n for n in ("id", "selected_tables", "user_rule", "isolation_rule",
                           "feedback_score") if n not in df.columns]
    if missing:
        raise ValueError(f"The result table is missing columns: {missing}")
    rows = anomaly_page(df, table_key, anomaly_type, review_status, limit, offset)
    kept = anomaly_list_filter(df, table_key, anomaly_type, review_status)
    return AnomalyList(anomaly_rows_view(rows), list_summary(kept), table_options(df))
