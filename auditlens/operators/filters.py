"""Row filters: date windows, anomaly kinds, runs and report criteria."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditlens import fixed
from auditlens.functions.scalars import c, family, safe_date, truthy
from auditlens.functions.texts import flex_date, norm_key


def date_literal(value) -> date | None:
    """ISO date of the first ten characters, or None."""
    try:
        return date.fromisoformat(str(value).strip()[:10]) if value else None
    except ValueError:
        return None


def window_column(
    schemas: Mapping[str, T.StructType],
    tables: Sequence[str],
    priority: Sequence[str] = fixed.DATE_FILTER_PRIORITY,
) -> tuple[str, str] | None:
    """Table and column that carry the date window: by name priority, base table first."""
    ordered = [t for t in tables if t == fixed.BASE_TABLE] + [
        t for t in tables if t != fixed.BASE_TABLE
    ]
    for wanted in priority:
        for table in ordered:
            for name in schemas[table].names:
                if name.strip().lower() == wanted:
                    return table, name
    return None


def window_predicate(
    col: Column, dtype: T.DataType, since: date | None, until: date | None
) -> Column:
    """Typed columns compare as they are, so the predicate reaches the file scan."""
    if family(dtype) == "datetime":
        value, inside = col, col.isNotNull()
        if since:
            inside = inside & (value >= F.lit(since.isoformat()).cast(dtype))
        if until:
            after = F.date_add(F.lit(until.isoformat()).cast("date"), 1).cast(dtype)
            inside = inside & (value < after)
        return inside
    value = safe_date(col, dtype)
    inside = value.isNotNull()
    if since:
        inside = inside & (value >= F.lit(since.isoformat()).cast("date"))
    if until:
        inside = inside & (value <= F.lit(until.isoformat()).cast("date"))
    return inside


def date_window(
    df: DataFrame,
    from_date,
    to_date,
    priority: Sequence[str] = fixed.DATE_FILTER_PRIORITY,
    tables: Sequence[str] | None = None,
) -> DataFrame:
    """Window on the preferred date column of a joined frame; no column or no range, no filter."""
    since, until = date_literal(from_date), date_literal(to_date)
    if (since is None and until is None) or (since and until and since > until):
        return df
    split = [(n.split(".", 1)[0] if "." in n else "", n.split(".", 1)[-1]) for n in df.columns]
    order = list(tables) if tables else list(dict.fromkeys(t for t, _ in split))
    schemas = {
        t: T.StructType([T.StructField(n, df.schema[f"{t}.{n}" if t else n].dataType)
                         for owner, n in split if owner == t])
        for t in order
    }
    target = window_column(schemas, order, priority)
    if target is None:
        return df
    name = ".".join(part for part in target if part)
    return df.where(window_predicate(c(name), df.schema[name].dataType, since, until))


def training_window(
    df: DataFrame, from_date=None, cutoff=fixed.TRAINING_CUTOFF, column: str = "list_date"
) -> DataFrame:
    """Rows from the lower bound (if any) up to, but without, the cutoff day."""
    if column not in df.columns:
        return df
    since, end = date_literal(from_date), date_literal(cutoff)
    if end is None:
        raise ValueError("cutoff must be in YYYY-MM-DD format.")
    if since and since >= end:
        raise ValueError("from_date must be earlier than cutoff.")
    dtype = df.schema[column].dataType
    value, dtype = (
        (c(column), dtype) if family(dtype) == "datetime" else (safe_date(c(column)), T.DateType())
    )
    kept = value < F.lit(end.isoformat()).cast(dtype)
    if since:
        kept = kept & (value >= F.lit(since.isoformat()).cast(dtype))
    return df.where(kept)


def _kinds(by_rule: str, by_model: str) -> dict[str, Column]:
    rule, model = truthy(c(by_rule)), truthy(c(by_model))
    return {"rule": rule, "ml": model, "rule_and_ml": rule & model, "all": rule | model}


def _reviewed(column: str) -> dict[str, Column]:
    return {"reviewed": c(column).isNotNull(), "not_reviewed": c(column).isNull()}


def anomaly_filter(df: DataFrame, name: str | None = "all") -> DataFrame:
    """Named filter of the review page: all, rule, ml, reviewed or not_reviewed."""
    kinds = _kinds("user_rule", "isolation_rule")
    kinds.pop("rule_and_ml")
    choices = {**kinds, **_reviewed("feedback_score")}
    return df.where(choices.get((name or "all").strip().lower(), choices["all"]))


def table_key_filter(df: DataFrame, table_key: str | None) -> DataFrame:
    """Rows whose normalised table key equals the normalised wanted key."""
    if not table_key:
        return df
    wanted = norm_key(F.lit(table_key))
    own = norm_key(c("selected_tables"))
    return df.where(F.when(wanted != "", own == wanted).otherwise(
        c("selected_tables") == F.lit(table_key)))


def anomaly_list_filter(
    df: DataFrame,
    table_key: str | None = None,
    anomaly_type: str | None = "all",
    review_status: str | None = "all",
) -> DataFrame:
    """Kind, review state and table filters of the anomaly list, combined."""
    kinds = _kinds("user_rule", "isolation_rule")
    kept = df.where(kinds.get((anomaly_type or "all").strip().lower(), kinds["all"]))
    state = _reviewed("feedback_score").get((review_status or "all").strip().lower())
    return table_key_filter(kept if state is None else kept.where(state), table_key)


def run_filter(df: DataFrame, run_id: int | None) -> DataFrame:
    """One run; on the partitioned result table this prunes to one directory."""
    if run_id is None or "ml_run_id" not in df.columns:
        return df
    return df.where(c("ml_run_id") == int(run_id))


def report_filter(
    df: DataFrame,
    *,
    risk: str = "all",
    status: str = "all",
    search: str = "",
    from_date=None,
    to_date=None,
) -> DataFrame:
    """Report criteria; with a date range, rows without a readable date drop out."""
    kept = df
    if risk != "all":
        kept = kept.where(c("risk_label") == risk)
    if status != "all":
        kept = kept.where(c("status") == status)
    words = search.strip().lower()
    if words:
        hay = F.concat_ws(" ", "bill_no", "vendor_name", "office", "anomaly_type")
        kept = kept.where(F.lower(hay).contains(words))
    since, until = date_literal(from_date), date_literal(to_date)
    found = flex_date(c("detected_on"))
    if since:
        kept = kept.where(found >= F.lit(since.isoformat()).cast("date"))
    if until:
        kept = kept.where(found <= F.lit(until.isoformat()).cast("date"))
    return kept


def final_anomalies(
    df: DataFrame, rule_flag: str = "rule_flag", ml_flag: str = "ml_flag"
) -> DataFrame:
    return df.where(F.coalesce(c(rule_flag), F.lit(False)) | F.coalesce(c(ml_flag), F.lit(False)))


def eligible(df: DataFrame, rule_flag: str = "rule_flag") -> DataFrame:
    """Rows no rule hit: the ones the model scores."""
    return df.where(~F.coalesce(c(rule_flag), F.lit(False)))
