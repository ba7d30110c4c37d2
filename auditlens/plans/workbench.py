"""An anomaly run: join, rules, scoring of what no rule hit, explanation, storage.

The flow is a few lazy frames between written stages. What reaches the driver is counters,
column ratios, profiles and the forest, never rows.
"""

from __future__ import annotations

from dataclasses import astuple, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlens import fixed
from auditlens.functions.features import apply_features, safe_name
from auditlens.functions.payload import review_payload
from auditlens.functions.scalars import c, record_key, round_half_even
from auditlens.functions.texts import presentable
from auditlens.model.io import Model, mark_contract, to_model_frame
from auditlens.operators.explain import explanation_signals, fit_profiles, reason_sentence
from auditlens.operators.filters import date_literal, date_window
from auditlens.operators.joins import join_tables
from auditlens.operators.projection import drop_sparse
from auditlens.operators.rules import DuplicateKeys, apply_rules, builtin_rules, related_keys
from auditlens.operators.signals import SIGNAL_TYPE
from auditlens.operators.summaries import amount_total, run_counters
from auditlens.operators.user_rules import apply_user_rules
from auditlens.plans.request import RunRequest
from auditlens.session import hash_joins
from auditlens.sources.catalog import Catalog
from auditlens.sources.results import ResultStore
from auditlens.sources.staging import spread, stage, staging_scope

RULE_COLUMNS = (
    "user_rule_flag", "user_rule_reasons", "sql_rule_flag", "sql_rule_reasons",
    "sql_rule_evidence",
)
INVOICE = ("table", "invoice_number", "invoice_date")


@dataclass(frozen=True)
class Flagged:
    """Joined rows with rule results, and what was applied to get there."""

    rows: DataFrame
    feature_names: list[str]
    warnings: list[str]
    duplicates: list[DuplicateKeys] = field(default_factory=list)


def flag_rows(catalog: Catalog, request: RunRequest) -> Flagged:
    """Join, window, declared features, user rules and built-in rules. Lazy."""
    joined = join_tables(catalog, request.tables, request.joins)
    window = date_window(joined, request.from_date, request.to_date, tables=request.tables)
    rules = builtin_rules(catalog, window.schema, request.tables, request.clock_columns)
    flagged = apply_rules(window, catalog, rules)
    user, user_warnings = apply_user_rules(flagged, request.user_rules)
    featured, names, feature_warnings = apply_features(user, request.feature_rules)
    return Flagged(featured, names, feature_warnings + user_warnings,
                   [r.duplicates for r in rules if r.duplicates])


def contract_rows(flagged: DataFrame, model: Model) -> DataFrame:
    """Joined rows with ``rule_flag``, their model features, and whether training would have
    dropped them (``__dropped``)."""
    by_rule = c("user_rule_flag") | c("sql_rule_flag")
    keep = [*flagged.columns, "rule_flag"]
    frame = to_model_frame(flagged.withColumn("rule_flag", by_rule), model.contract, keep)
    return mark_contract(frame, model.contract, keep)


def score_candidates(
    flagged: DataFrame, model: Model, *, keep_rule_rows: bool = False
) -> DataFrame:
    """Score the rows that no rule hit, in one pass; rule rows keep a NULL score.

    Rows that training would have dropped are not scored. Rule hits among them leave the
    result too, unless ``keep_rule_rows`` is set.
    """
    usable = ~c("__dropped")
    score = model.score(flagged.sparkSession, guard=usable & ~c("rule_flag"))
    scored = contract_rows(flagged, model).withColumn("ml_score", score)
    kept = usable | c("rule_flag") if keep_rule_rows else usable
    return scored.withColumns({"ml_flag": model.flag(c("ml_score")), "kept": kept}).drop("__dropped")


def rule_name(user_rules, user_reason: Column, own_reasons: Column, hit: Column) -> Column:
    """Reason to store: the user's, else the built-in one, else the rule labels."""
    labels = [f"RULE::{safe_name(r.name, f'User rule {i}')}"
              for i, r in enumerate(user_rules, start=1)]
    generic = F.lit(", ".join(labels) or fixed.REASON_USER_RULE)
    text = F.coalesce(presentable(user_reason),
                      presentable(F.array_join(own_reasons, ", ")), generic)
    return F.when(hit, text)


def build_anomalies(
    found: DataFrame, request: RunRequest, model: Model, run_id: int, payload: Column,
    signals: Column,
) -> DataFrame:
    """Result rows of the final anomalies, with payload and explanation."""
    dtypes = {f.name: f.dataType for f in found.schema}
    return found.select(
        F.lit(".".join(t for t in request.tables if t.strip())).alias("selected_tables"),
        F.struct(signals.alias("signals"),
                 F.coalesce(c("sql_rule_evidence"), F.array().cast(dtypes["sql_rule_evidence"]))
                 .alias("rule_evidence")).alias("feature_values"),
        rule_name(request.user_rules, c("user_rule_reasons"), c("sql_rule_reasons"),
                  c("rule_flag")).alias("user_rule_name"),
        c("rule_flag").alias("user_rule"),
        c("ml_flag").alias("isolation_rule"),
        round_half_even(c("ml_score")).alias("ml_if_score"),
        round_half_even(F.lit(float(model.threshold))).alias("ml_threshold"),
        F.lit(int(run_id)).alias("ml_run_id"),
        record_key(found.columns, dtypes, list(request.tables)).alias("fk_dak"),
        F.array_join(c("sql_rule_reasons"), ", ").alias("builtin_reason"),
        payload.alias("payload"),
        F.when(c("ml_flag"), reason_sentence(signals)).alias("ml_reason"),
    )


def run_workbench(
    catalog: Catalog,
    request: RunRequest,
    model: Model,
    store: ResultStore,
    *,
    keep_rule_rows: bool = False,
    dataset_defaults: bool = True,
) -> dict:
    """Run a request and store its anomalies, related keys and record as one unit. Returns the
    record. Nothing that was staged on the way remains."""
    with staging_scope(store.spark), hash_joins(store.spark):
        return _run(catalog, request, model, store, keep_rule_rows, dataset_defaults)


def _run(
    catalog: Catalog, request: RunRequest, model: Model, store: ResultStore, keep_rule_rows: bool,
    dataset_defaults: bool,
) -> dict:
    warnings: list[str] = []
    if dataset_defaults:
        request, warnings = request.with_dataset_defaults()
    flagged = flag_rows(catalog, request)
    warnings += flagged.warnings
    rows = stage(flagged.rows, "flagged")
    writer = store.begin()
    run_id = writer.run_id
    base = {
        "run_id": run_id, "run_name": request.run_name, "source_tables": list(request.tables),
        "join_config": [astuple(j) for j in request.joins],
        "feature_rules": [(r.name, r.feature_type, r.first_column, r.second_column)
                          for r in request.feature_rules],
        "amount_field": request.amount_field, "selected_model": "IsolationForest",
        "status": "COMPLETED",
    }
    metrics = {
        "dataset": ".".join(request.tables), "contamination": str(request.contamination),
        "from_date": str(date_literal(request.from_date) or ""),
        "to_date": str(date_literal(request.to_date) or ""),
        "requested_user_rules": str(len(request.user_rules)),
        "requested_feature_rules": str(len(request.feature_rules)),
        "applied_feature_rules": str(len(flagged.feature_names)),
        "feature_count": str(len(model.contract.feature_columns)),
    }
    if rows.isEmpty():
        if store.row_count() == 0:
            raise ValueError("The selected join returned no rows.")
        warnings.append("No rows in the selected window.")
        record = {**base, "metrics": {**metrics, "warnings": "\n".join(warnings)}}
        writer.commit(record)
        return {**record, "amount_total": 0.0}

    dense = drop_sparse(rows, keep=RULE_COLUMNS)
    scored = score_candidates(spread(rows, dense), model, keep_rule_rows=keep_rule_rows)
    found = stage(
        scored.where(c("kept") & (c("rule_flag") | c("ml_flag"))), "found")
    by_model = run_counters(found).first()
    total = rows.count()

    features = model.contract.feature_columns
    signals = F.array().cast(f"array<{SIGNAL_TYPE}>")
    if by_model["ml_anomaly_count"]:
        # Profiles need no scores: they read the staged rows, not the scored ones.
        scored_rows = contract_rows(dense, model).where(~c("__dropped") & ~c("rule_flag"))
        eligible = stage(scored_rows.select(*[c(n) for n in features]), "eligible")
        profiles = fit_profiles(eligible, model.preprocessor)
        signals = F.when(
            c("ml_flag"), explanation_signals(found, model.preprocessor, profiles)
        ).otherwise(signals)
    business = [n for n in dense.columns if n not in RULE_COLUMNS]
    payload = review_payload(
        dense.select(*[c(n) for n in business]).schema, list(request.tables),
        flagged.feature_names)
    # Before the write: an amount column that is not there must not leave anomalies behind.
    amount = amount_total(found, request.amount_field).first()[0]
    written = writer.write_anomalies(
        build_anomalies(spread(found), request, model, run_id, payload, signals))
    told = stage(found.select(F.explode("sql_rule_evidence").alias("e")).select(
        *[F.col("e")[n].alias(n) for n in INVOICE]).distinct(), "invoices")
    for keys in flagged.duplicates:
        wanted = told.where(c("table") == F.lit(keys.table)).select(*INVOICE[1:])
        writer.write_related(related_keys(catalog.table(keys.table), keys, wanted))
    record = {
        **base, "total_rows": total, "user_rule_count": by_model["user_rule_count"],
        "ml_anomaly_count": by_model["ml_anomaly_count"],
        "final_anomaly_count": by_model["final_anomaly_count"],
        "metrics": {**metrics, "warnings": "\n".join(warnings),
                    "new_rows_written": str(written["appended_row_count"]),
                    "result_row_count": str(written["row_count"])},
    }
    writer.commit(record)
    return {**record, "amount_total": amount}
