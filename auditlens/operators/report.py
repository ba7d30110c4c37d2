"""Report rows and their aggregations, over the full filtered set of predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlens import fixed
from auditlens.functions.payload import (
    entity_of, page_amount, payload_value, payload_values,
)
from auditlens.functions.scalars import c, float_of
from auditlens.functions.texts import (
    capitalize, flex_date, format_reason, review_status, risk_label, risk_score, simplify_reason,
    strip_blanks,
)
from auditlens.operators.summaries import money


# --- Fixed values: what a report row looks up in the payload ------------------------------
REPORT_KEYS = {
    "bill_no": fixed.BILL_KEYS,
    "vendor_name": fixed.VENDOR_KEYS,
    "office_name": fixed.OFFICE_KEYS,
    "detected_on": fixed.DETECTED_KEYS,
    "amount": fixed.REPORT_AMOUNT_KEYS,
    "vendor": fixed.VENDOR_TYPE_KEYS,
    "office": fixed.OFFICE_TYPE_KEYS,
}


#: Columns of a report row and the looked-up fields that each one needs.
REPORT_COLUMNS = {
    "prediction_id": (), "bill_no": ("bill_no",), "vendor_name": ("vendor_name",),
    "office": ("office_name",), "anomaly_type": (), "amount": ("amount",), "risk_score": (),
    "risk_label": (), "detected_on": ("detected_on",), "status": (), "feedback": (),
    "entity_type": ("vendor", "office"),
}


def report_rows(
    predictions: DataFrame, columns: Sequence[str] = tuple(REPORT_COLUMNS)
) -> DataFrame:
    """Twelve derived columns per prediction, or some of them; only what they need is looked up
    in the payload. Needs ``prediction_id``, ``rule_flag``, ``ml_score``, ``review_status``,
    ``feedback``, ``reason_list`` and ``payload``."""
    keys = {field: REPORT_KEYS[field] for name in columns for field in REPORT_COLUMNS[name]}
    simple = F.transform(F.slice(c("reason_list"), 1, 2), lambda r: simplify_reason(format_reason(r)))
    kind = F.array_join(simple, ", ")
    points = risk_score(c("rule_flag"), c("ml_score"))
    found = F.col("__found")

    def shown(name: str) -> Column:
        return F.coalesce(found[name], F.lit("Unavailable"))

    looked_up = predictions.withColumn(
        "__found", payload_values(c("payload"), keys, skip_blank_text=True)) if keys else predictions
    made = {
        "prediction_id": lambda: c("prediction_id"),
        "bill_no": lambda: shown("bill_no"),
        "vendor_name": lambda: shown("vendor_name"),
        "office": lambda: shown("office_name"),
        "anomaly_type": lambda: F.when(kind != "", kind).otherwise("No reason"),
        "amount": lambda: F.coalesce(float_of(found["amount"]), F.lit(0.0)),
        "risk_score": lambda: points,
        "risk_label": lambda: risk_label(points),
        "detected_on": lambda: shown("detected_on"),
        "status": lambda: review_status(c("review_status"), c("feedback")),
        "feedback": lambda: F.coalesce(capitalize(c("feedback")), F.lit("Pending")),
        "entity_type": lambda: entity_of(found),
    }
    return looked_up.select(*[made[name]().alias(name) for name in columns])


def risk_buckets(rows: DataFrame) -> DataFrame:
    """High, medium and low counts and the share of high, in one row."""
    counts = rows.agg(
        F.count_if(c("risk_label") == "High").alias("high"),
        F.count_if(c("risk_label") == "Medium").alias("medium"),
        F.count_if(~c("risk_label").isin("High", "Medium")).alias("low"),
    )
    total = F.col("high") + F.col("medium") + F.col("low")
    percent = F.coalesce(F.try_divide(F.col("high") * 100.0, total), F.lit(0.0))
    return counts.withColumn("high_percent", percent)


def reason_stats(rows: DataFrame, reasons: str = "reason_list", k: int = 5) -> DataFrame:
    """Most frequent simplified reasons with their share of rows; no reason is ``Others``."""
    listed = F.coalesce(c(reasons), F.array().cast("array<string>"))
    labels = F.when(F.size(listed) == 0, F.array(F.lit("Others"))).otherwise(
        F.transform(listed, lambda r: simplify_reason(format_reason(r))))
    counts = rows.select(F.explode(labels).alias("label")).groupBy("label").agg(F.count("*").alias("count"))
    total = rows.agg(F.count("*")).scalar()
    best = counts.orderBy(F.desc("count"), "label").limit(k)
    return best.withColumn("percent", F.col("count") * 100.0 / total)


def trend(rows: DataFrame, k: int = 5) -> DataFrame:
    """Counts and amount in crores per day, the last ``k`` days in order. Text that is no
    date is a group of its own, after all days."""
    day = flex_date(c("detected_on"))
    label = F.when(day.isNotNull(), F.date_format(day, "dd MMM")).otherwise(
        F.coalesce(F.when(c("detected_on") != "", c("detected_on")), F.lit("Unknown")))
    grouped = rows.groupBy(label.alias("label")).agg(
        F.count("*").alias("all_count"),
        F.count_if(c("risk_label") == "High").alias("high_count"),
        F.round(money(c("amount") / 10_000_000), 2).alias("impact"),
        F.min(day).alias("first_day"),
    )
    return grouped.orderBy(F.desc_nulls_first("first_day"), F.desc("label")).limit(k).orderBy(
        F.asc_nulls_last("first_day"), "label")


def row_totals(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count_if(c("status").isin("Under Review", "Approved")).alias("reviewed"),
        F.count_if(c("status") == "Approved").alias("accepted"),
        F.count_if(~c("status").isin("Under Review", "Approved")).alias("pending"),
        money(c("amount")).alias("amount"),
    )


def top_alerts(rows: DataFrame, k: int | None = 4) -> DataFrame:
    """Rows by falling risk; ties by id. ``None`` keeps all."""
    ordered = rows.orderBy(F.desc("risk_score"), "prediction_id")
    return ordered if k is None else ordered.limit(k)


def approvers(df: DataFrame, k: int, order: str = "prediction_id") -> DataFrame:
    """First ``k`` distinct approvers in row order. A row offers its id and, when that id has
    been seen before, its code or name.

    An approver named by an id is seen where that id first occurs. A name counts only from a
    row whose id was seen earlier, or that has none, so both come from grouped first rows.
    """
    ids = strip_blanks(payload_value(c("payload"), fixed.APPROVER_ID_KEYS, skip_blank_text=True))
    names = strip_blanks(
        payload_value(c("payload"), fixed.APPROVER_NAME_KEYS, skip_blank_text=True))

    def usable(value: Column) -> Column:
        return F.when((value != "") & (value != "Unavailable"), value)

    rows = df.select(c(order).alias("at"), usable(ids).alias("id"), usable(names).alias("name"))
    first_ids = rows.where("id IS NOT NULL").groupBy("id").agg(F.min("at").alias("first_at"))
    repeats = rows.where("name IS NOT NULL").join(first_ids, "id", "left").where(
        "first_at IS NULL OR at > first_at")
    first_names = repeats.groupBy(F.col("name").alias("emp_id")).agg(F.min("at").alias("at"))
    named = first_ids.select(F.col("id").alias("emp_id"), F.col("first_at").alias("at"))
    return (
        named.unionByName(first_names).groupBy("emp_id").agg(F.min("at").alias("first_row"))
        .orderBy("first_row", "emp_id").limit(k)
    )


def running_total(page: DataFrame, offset: int = 0, order: str = "prediction_id") -> DataFrame:
    """Serial number and running amount over one page; the window holds one page only."""
    window = Window.orderBy(c(order))
    so_far = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    amount = page_amount(c("payload"))
    return page.withColumn("amount", amount).select(
        (F.row_number().over(window) + offset).cast("long").alias("serial_no"),
        c(order), "amount",
        F.sum(c("amount").cast("decimal(28,4)")).over(so_far).cast("double").alias("total_amount"),
    )
