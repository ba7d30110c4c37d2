"""Projections, windows, user rules and named filters."""

from pyspark.sql import functions as F

from auditlens.functions.scalars import c, truthy
from auditlens.operators import filters as FL
from auditlens.operators import projection as P
from auditlens.operators.joins import join_tables
from auditlens.operators.user_rules import UserRule, apply_user_rules, rule_predicate
from auditlens.plans.training import training_sample
from driver_queries.base import Tables, over, query
from driver_queries.joins import DAK_BILL


@query("qualified_projection", 'SELECT event_id AS "events.event_id", CAST(ts AS VARCHAR) AS '
       '"events.ts", user_id AS "events.user_id", event_type AS "events.event_type", '
       'value AS "events.value", props AS "events.props" FROM events')
def qualified_projection(t: Tables):
    return P.qualify(t.events, "events", datetimes_as_text=True)


@query("model_names", over("SELECT id AS dak_id, amount AS dak_amount FROM dak", "dak"))
def model_names(t: Tables):
    named = P.with_model_names(P.qualify(t.dak.select("id", "amount"), "dak"))
    return P.with_model_names(P.with_joined_names(named))


@query("row_locator", "SELECT count(*) AS row_count, count(*) AS distinct_locators FROM lineitem")
def row_locator(t: Tables):
    placed = P.with_locator(t.lineitem, "lineitem")
    each = placed.groupBy("__ml_locator__lineitem").agg(F.count("*").alias("n"))
    return each.agg(F.sum("n").alias("row_count"), F.count("*").alias("distinct_locators"))


@query("date_window", over(
    "SELECT d.id AS dak_id, b.invoice_no, b.line FROM dak d JOIN bill b ON d.id = b.fk_dak "
    "WHERE d.list_date >= DATE '1997-01-01' AND d.list_date < DATE '1998-01-01'", "dak", "bill"))
def date_window(t: Tables):
    joined = join_tables(t.catalog("dak", "bill"), ["dak", "bill"], DAK_BILL)
    kept = FL.date_window(joined, "1997-01-01", "1997-12-31", tables=["dak", "bill"])
    return kept.select(c("dak.id").alias("dak_id"), c("bill.invoice_no").alias("invoice_no"),
                       c("bill.line").alias("line"))


@query("date_window_text", over(
    "SELECT id, list_date FROM (SELECT id, CASE WHEN id % 7 = 0 THEN 'unknown' ELSE "
    "CAST(list_date AS VARCHAR) END AS list_date FROM dak) WHERE list_date <> 'unknown' AND "
    "CAST(list_date[1:10] AS DATE) BETWEEN DATE '1997-03-01' AND DATE '1997-06-30'", "dak"))
def date_window_text(t: Tables):
    text = t.dak.select("id", F.when(F.col("id") % 7 == 0, "unknown").otherwise(
        F.col("list_date").cast("string")).alias("list_date"))
    return FL.date_window(text, "1997-03-01", "1997-06-30")


@query("training_window", over(
    "SELECT id, amount FROM dak WHERE list_date >= DATE '1996-01-01' "
    "AND list_date < DATE '1998-01-01'", "dak"))
def training_window(t: Tables):
    return FL.training_window(t.dak, "1996-01-01", "1998-01-01").select("id", "amount")


@query("training_sample", over(
    "SELECT id, CAST(list_date AS VARCHAR) AS list_date FROM dak "
    "ORDER BY dak.list_date NULLS LAST, id LIMIT 12000", "dak"))
def training_rows(t: Tables):
    return training_sample(t.dak.select("id", "list_date"), ["list_date", "id"], 12_000).withColumn(
        "list_date", F.col("list_date").cast("string"))


@query("sparse_drop", over(
    "SELECT id, amount, nullif(record_status, 'F') AS mostly FROM dak", "dak"))
def sparse_drop(t: Tables):
    df = t.dak.select(
        "id", "amount", F.expr("nullif(record_status, 'F')").alias("mostly"),
        F.expr("CASE WHEN priority = '1-URGENT' THEN priority END").alias("rarely"))
    return P.drop_sparse(df, keep=["id"])


@query("preview_cap", "SELECT least(count(*), 1000) AS row_count FROM lineitem")
def preview_cap(t: Tables):
    return P.preview(t.lineitem, 1000)[0].agg(F.count("*").alias("row_count"))


def _rule(t: Tables, rule: UserRule, df=None):
    joined = df if df is not None else join_tables(
        t.catalog("dak", "bill"), ["dak", "bill"], DAK_BILL)
    hit = F.coalesce(rule_predicate(rule, joined.schema), F.lit(False))
    return joined.where(hit).select(
        c("dak.id").alias("dak_id"), c("bill.invoice_no").alias("invoice_no"),
        c("bill.line").alias("line"))


def _rule_sql(condition: str) -> str:
    return over("SELECT d.id AS dak_id, b.invoice_no, b.line FROM dak d JOIN bill b "
                f"ON d.id = b.fk_dak WHERE {condition}", "dak", "bill")


@query("rule_num_gt", _rule_sql("b.amount > 90000"))
def rule_num_gt(t: Tables):
    return _rule(t, UserRule("large", "bill.amount", ">", "90000"))


@query("rule_col_col", _rule_sql("b.amount >= d.amount"))
def rule_col_col(t: Tables):
    return _rule(t, UserRule("more", "bill.amount", ">=", second_column="dak.amount"))


@query("rule_datetime", _rule_sql("b.invoice_date < TIMESTAMP '1996-06-01'"))
def rule_datetime(t: Tables):
    return _rule(t, UserRule("early", "invoice_date", "<", "1996-06-01T00:00:00Z"))


@query("rule_datetime_columns", _rule_sql("b.invoice_date < d.list_date"))
def rule_datetime_columns(t: Tables):
    return _rule(t, UserRule("before", "invoice_date", "<", second_column="list_date"))


@query("rule_num_or_text_eq", _rule_sql("b.line = b.quantity"))
def rule_num_or_text_eq(t: Tables):
    return _rule(t, UserRule("same", "bill.line", "=", second_column="bill.quantity"))


@query("rule_text_literal", _rule_sql("b.record_status <> 'V'"))
def rule_text_literal(t: Tables):
    return _rule(t, UserRule("open", "bill.record_status", "!=", "V"))


@query("rule_null", _rule_sql("nullif(d.priority, '5-LOW') IS NULL"))
def rule_null(t: Tables):
    joined = join_tables(t.catalog("dak", "bill"), ["dak", "bill"], DAK_BILL)
    joined = joined.withColumn("dak.priority", F.nullif(c("dak.priority"), F.lit("5-LOW")))
    return _rule(t, UserRule("none", "priority", "null"), joined)


@query("user_rules_flag_reasons", over(
    "SELECT d.id AS dak_id, b.line, b.invoice_no, b.amount > 90000 OR d.record_status = 'P' OR "
    "b.invoice_date < d.list_date AS user_rule_flag, concat_ws(', ', "
    "CASE WHEN b.amount > 90000 THEN 'RULE::Large_amount' END, "
    "CASE WHEN d.record_status = 'P' THEN 'RULE::col_2nd_status' END, "
    "CASE WHEN b.invoice_date < d.list_date THEN 'RULE::User rule 4' END) AS user_rule_reasons "
    "FROM dak d JOIN bill b ON d.id = b.fk_dak", "dak", "bill"))
def user_rules_flag_reasons(t: Tables):
    joined = join_tables(t.catalog("dak", "bill"), ["dak", "bill"], DAK_BILL)
    flagged, _ = apply_user_rules(joined, [
        UserRule("Large amount", "bill.amount", ">", "90000"),
        UserRule("2nd status", "dak.record_status", "=", "P"),
        UserRule("bad", "bill.amount", ">", "many"),
        UserRule("", "invoice_date", "<", second_column="list_date"),
    ])
    return flagged.select(c("dak.id").alias("dak_id"), c("bill.line").alias("line"),
                          c("bill.invoice_no").alias("invoice_no"),
                          "user_rule_flag", "user_rule_reasons")


SPELLED = ("CASE l_linenumber WHEN 1 THEN ' Yes ' WHEN 2 THEN 'T' WHEN 3 THEN 'no' "
           "WHEN 4 THEN '1' WHEN 5 THEN 'truth' WHEN 6 THEN NULL ELSE 'Y' END")


@query("truthy", f"SELECT l_orderkey, l_linenumber, coalesce(lower(trim({SPELLED})) IN "
       "('true', 't', '1', 'yes', 'y'), false) AS truthy FROM lineitem")
def truthy_words(t: Tables):
    return t.lineitem.select("l_orderkey", "l_linenumber", truthy(F.expr(SPELLED)).alias("truthy"))


NAMED = {
    "filter_all": ("all", "user_rule OR isolation_rule"),
    "filter_rule": ("rule", "user_rule"),
    "filter_ml": ("ml", "isolation_rule"),
    "filter_reviewed": ("reviewed", "feedback_score IS NOT NULL"),
    "filter_not_reviewed": ("not_reviewed", "feedback_score IS NULL"),
}
for _name, (_kind, _where) in NAMED.items():
    query(_name, over(f"SELECT id, ml_run_id FROM results WHERE {_where}", "results"))(
        lambda t, kind=_kind: FL.anomaly_filter(t.results, kind).select("id", "ml_run_id"))


@query("filter_rule_and_ml", over(
    "SELECT id FROM results WHERE user_rule AND isolation_rule AND feedback_score IS NOT NULL "
    "AND selected_tables IN ('dak.bill', 'dak.null.bill')", "results"))
def filter_rule_and_ml(t: Tables):
    return FL.anomaly_list_filter(t.results, "dak.bill", "rule_and_ml", "reviewed").select("id")


@query("run_filter", over("SELECT id FROM results WHERE ml_run_id = 1997", "results"))
def run_filter(t: Tables):
    return FL.run_filter(t.results, 1997).select("id")


@query("final_anomalies", over(
    "SELECT id FROM results WHERE user_rule OR isolation_rule", "results"))
def final_anomalies(t: Tables):
    return FL.final_anomalies(t.results, "user_rule", "isolation_rule").select("id")


@query("eligible_rows", over("SELECT id FROM results WHERE NOT user_rule", "results"))
def eligible_rows(t: Tables):
    return FL.eligible(t.results, "user_rule").select("id")
