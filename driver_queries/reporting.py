"""Report rows, breakdowns and rankings over all predictions."""

from pyspark.sql import functions as F

from auditlens.functions.scalars import c
from auditlens.operators import report as R
from auditlens.operators import signals as G
from auditlens.operators.filters import report_filter
from auditlens.operators.ordering import page
from auditlens.plans.review import to_prediction
from driver_queries.base import Tables, over, query

POINTS = ("CAST(greatest(35, floor(CASE WHEN user_rule THEN greatest(ml_if_score, 0.95::DOUBLE) ELSE "
          "ml_if_score END * 100 + 0.5)) AS INT)")
REPORT = (
    "SELECT *, CASE WHEN risk_score >= 85 THEN 'High' WHEN risk_score >= 60 THEN 'Medium' ELSE 'Low' END "
    f"AS risk_label FROM (SELECT id AS prediction_id, CAST(id * 10 AS VARCHAR) AS bill_no, CASE WHEN id % 5 "
    "= 0 THEN 'Unavailable' ELSE concat('Vendor ', fk_dak % 50) END AS vendor_name, 'Unavailable' AS office, "
    "CASE WHEN user_rule_name LIKE 'RULE%' THEN 'Over Payment' WHEN user_rule_name IS NOT NULL THEN "
    f"'Duplicate Claim' ELSE 'No reason' END AS anomaly_type, amount, {POINTS} AS risk_score, "
    "CASE WHEN id % 11 = 0 THEN 'Unavailable' ELSE detected END AS detected_on, CASE feedback_score WHEN 1.0 "
    "THEN 'Approved' WHEN 0.5 THEN 'Under Review' WHEN 0.0 THEN 'Under Review' ELSE 'Pending' END AS "
    "status, CASE feedback_score WHEN 1.0 THEN 'Accept' WHEN 0.5 THEN 'Maybe' WHEN 0.0 THEN 'Reject' ELSE "
    "'Pending' END AS feedback, CASE WHEN id % 5 = 0 THEN 'bill' ELSE 'vendor' END AS entity_type, "
    "id, fk_dak, user_rule_name FROM results)"
)


def predictions(t: Tables):
    """Predictions of all result rows with payloads."""
    keys = {
        "dak.amount": "CAST(CAST(amount AS DECIMAL(12,2)) AS STRING)",
        "bill.bill_number": "CAST(id * 10 AS STRING)",
        "bill.Vendor": "CASE WHEN id % 5 = 0 THEN ' ' ELSE concat('Vendor ', fk_dak % 50) END",
        "dak.created_at": "CASE WHEN id % 11 <> 0 THEN detected END",
        "dak.approver_id": "CASE WHEN id % 4 = 0 THEN concat('A', fk_dak % 40) END",
        "dak.approver_name": "CASE WHEN id % 2 = 0 THEN concat('Name ', fk_dak % 60) END",
    }
    payload = F.map_from_arrays(F.array(*[F.lit(k) for k in keys]),
                                F.array(*[F.expr(e).cast("string") for e in keys.values()]))
    return to_prediction(t.results.withColumn("payload", payload))


def report(t: Tables, *columns: str):
    return R.report_rows(predictions(t), columns) if columns else R.report_rows(predictions(t))


@query("report_rows", over(
    "SELECT prediction_id, bill_no, vendor_name, office, anomaly_type, amount, risk_score, risk_label, "
    "detected_on, status, feedback, entity_type FROM g", "results", g=REPORT))
def report_rows(t: Tables):
    return report(t)


@query("report_filter", over(
    "SELECT prediction_id FROM g WHERE risk_label = 'High' AND status = 'Approved' AND lower(concat_ws(' ', "
    "bill_no, vendor_name, office, anomaly_type)) LIKE '%vendor 1%' AND detected_on <> 'Unavailable' AND "
    "CAST(detected_on[1:10] AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1997-12-31'", "results", g=REPORT))
def filtered_report(t: Tables):
    return report_filter(report(t), risk="High", status="Approved", search=" VENDOR 1",
                         from_date="1996-01-01", to_date="1997-12-31").select("prediction_id")


@query("risk_buckets", over(
    "SELECT *, round(high * 100.0::DOUBLE / (high + medium + low), 6) AS high_percent FROM (SELECT count(*) "
    "FILTER (WHERE risk_label = 'High') AS high, count(*) FILTER (WHERE risk_label = 'Medium') AS medium, "
    "count(*) FILTER (WHERE risk_label = 'Low') AS low FROM g)", "results", g=REPORT))
def risk_buckets(t: Tables):
    return R.risk_buckets(report(t, "risk_label")).withColumn("high_percent", F.round("high_percent", 6))


@query("reason_stats", over(
    "SELECT label, count(*) AS \"count\", round(count(*) * 100.0 / (SELECT count(*) FROM results), 6) AS "
    "percent FROM (SELECT CASE WHEN user_rule_name IS NULL THEN 'Others' WHEN user_rule_name LIKE 'RULE%' "
    "THEN 'Over Payment' ELSE 'Duplicate Claim' END AS label FROM results UNION ALL SELECT CASE WHEN "
    "id % 3 = 0 THEN 'Late filing' ELSE 'GST Wrong' END FROM results WHERE user_rule_name IS NOT NULL) "
    "GROUP BY label ORDER BY 2 DESC, label LIMIT 5", "results"))
def reason_stats(t: Tables):
    extra = F.when(c("id") % 3 == 0, "late_filing").otherwise("RULE::value_mismatch")
    rows = t.results.select(F.when(c("user_rule_name").isNotNull(),
                                   F.array(c("user_rule_name"), extra)).alias("reason_list"))
    return R.reason_stats(rows).withColumn("percent", F.round("percent", 6))


@query("trend", over(
    "SELECT label, all_count, high_count, impact, CAST(first_day AS VARCHAR) AS first_day FROM (SELECT CASE "
    "WHEN d IS NULL THEN detected_on ELSE strftime(d, '%d %b') END AS label, count(*) AS all_count, "
    "count(*) FILTER (WHERE risk_label = 'High') AS high_count, CAST(round(sum(CAST(amount / 10000000 AS "
    "DECIMAL(28,4))), 2) AS DOUBLE) AS impact, min(d) AS first_day FROM (SELECT *, TRY_CAST(detected_on[1:10] "
    "AS DATE) AS d FROM g) GROUP BY 1) ORDER BY first_day DESC NULLS FIRST, label DESC LIMIT 5",
    "results", g=REPORT))
def trend(t: Tables):
    return R.trend(report(t, "detected_on", "risk_label", "amount")).withColumn("first_day", c("first_day").cast("string"))


@query("row_totals", over(
    "SELECT count(*) FILTER (WHERE status IN ('Approved', 'Under Review')) AS reviewed, count(*) FILTER "
    "(WHERE status = 'Approved') AS accepted, count(*) FILTER (WHERE status = 'Pending') AS pending, "
    "CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) AS amount FROM g", "results", g=REPORT))
def row_totals(t: Tables):
    return R.row_totals(report(t, "status", "amount"))


@query("top_alerts", over(
    "SELECT prediction_id, risk_score, vendor_name FROM g ORDER BY risk_score DESC, prediction_id LIMIT 4",
    "results", g=REPORT))
def top_alerts(t: Tables):
    return R.top_alerts(report(t, "prediction_id", "risk_score", "vendor_name")).select("prediction_id", "risk_score", "vendor_name")


@query("approvers", over(
    "SELECT emp_id, min(seen) AS first_row FROM (SELECT code AS emp_id, min(id) AS seen FROM s WHERE code IS NOT "
    "NULL GROUP BY code UNION ALL SELECT name, min(s.id) FROM s LEFT JOIN (SELECT code, min(id) AS first_at "
    "FROM s WHERE code IS NOT NULL GROUP BY code) f ON f.code = s.code WHERE name IS NOT NULL AND (f.code "
    "IS NULL OR s.id > first_at) GROUP BY name) GROUP BY emp_id ORDER BY first_row, emp_id LIMIT 12",
    "results",
    s="SELECT id, CASE WHEN id % 4 = 0 THEN concat('A', fk_dak % 40) END AS code, CASE WHEN id % 2 = 0 THEN "
      "concat('Name ', fk_dak % 60) END AS name FROM results"))
def approvers(t: Tables):
    return R.approvers(predictions(t), 12)


@query("running_total", over(
    "SELECT row_number() OVER (ORDER BY id) + 100 AS serial_no, id AS prediction_id, amount, CAST(sum("
    "CAST(amount AS DECIMAL(18,2))) OVER (ORDER BY id) AS DOUBLE) AS total_amount FROM (SELECT id, amount "
    "FROM results ORDER BY id LIMIT 500 OFFSET 100)", "results"))
def running_total(t: Tables):
    rows = page(predictions(t).select("prediction_id", "payload"), "prediction_id", limit=500, offset=100)
    return R.running_total(rows, 100)


# --- ranking inside a row -----------------------------------------------------------------------

# (feature, value, strength, direction) as expressions over a line item.
SIGNALS = (
    ("'quantity'", "CAST(l_quantity AS STRING)", "l_quantity / 10", "'high'"),
    ("'flag::A'", "l_returnflag", "l_discount * 60", "'rare'"),
    ("'flag::Yes'", "l_returnflag", "l_tax * 60", "'rare'"),
    ("'gap_days_order_to_ship'", "CAST(l_linenumber AS STRING)", "CAST(l_linenumber AS DOUBLE)", "'low'"),
    ("'status__missing'", "CAST(NULL AS STRING)", "CAST(1.5 AS DOUBLE)", "'missing'"),
    ("'price'", "CAST(l_partkey AS STRING)", "l_extendedprice / 20000", "'low'"),
)


def _signals():
    return F.array(*[
        F.struct(F.expr(f).alias("feature"), F.expr(v).alias("value"),
                 F.lit(None).cast("double").alias("scaled_value"), F.expr(s).alias("strength"),
                 F.expr(d).alias("direction"))
        for f, v, s, d in SIGNALS])


def _long_sql() -> str:
    """One row per signal; line items that agree in all keys stay apart by their number."""
    cells = ", ".join(
        f"{{'i': {i}, 'feature': {f}, 'strength': {s}, 'direction': {d}}}"
        for i, (f, _, s, d) in enumerate(SIGNALS))
    return (f"SELECT rid, l_orderkey, l_partkey, l_linenumber, l_suppkey, s.i, s.feature, s.strength, "
            f"s.direction FROM (SELECT *, unnest([{cells}]) AS s FROM (SELECT row_number() OVER () AS rid, * "
            "FROM lineitem))")


def _chosen(order: str, group: str, k: int) -> str:
    return over(
        "SELECT l_orderkey, l_partkey, l_linenumber, l_suppkey, string_agg(feature, ' > ' ORDER BY n) AS "
        "signals FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY "
        f"{order}, i) AS n FROM (SELECT *, row_number() OVER (PARTITION BY rid, {group} ORDER BY {order}, i) "
        f"AS g FROM long) WHERE g = 1) WHERE n <= {k} GROUP BY rid, 1, 2, 3, 4", long=_long_sql())


PRIORITY = ("CASE WHEN feature LIKE '%missing' THEN 1 WHEN feature LIKE 'gap%' THEN 2 WHEN feature LIKE "
            "'%::%' THEN 3 ELSE 4 END")
CARD = ("strength + CASE WHEN feature LIKE '%missing' OR feature LIKE 'gap%' THEN 100 WHEN feature = "
        "'flag::Yes' THEN 30 ELSE 0 END + CASE WHEN direction = 'high' THEN 5 ELSE 0 END")


def _lines(t: Tables, ranked):
    names = F.array_join(F.transform(ranked, lambda s: s["feature"]), " > ")
    return t.lineitem.select("l_orderkey", "l_partkey", "l_linenumber", "l_suppkey",
                             names.alias("signals"))


@query("rank_signals", _chosen(f"{PRIORITY}, strength DESC", "split_part(feature, '::', 1)", 4))
def rank_signals(t: Tables):
    return _lines(t, G.rank_signals(_signals(), 4))


@query("collapse_signals", _chosen(f"({CARD}) DESC", "split_part(feature, '::', 1)", 3))
def collapse_signals(t: Tables):
    return _lines(t, G.collapse_signals(_signals(), 3))


@query("key_fields", over(
    "SELECT id, string_agg(key, ' ' ORDER BY score DESC, key) AS fields, max(score) AS best FROM (SELECT *, "
    "row_number() OVER (PARTITION BY id ORDER BY score DESC, key) AS n FROM (SELECT id, 'dak.amount' AS key, "
    "150 AS score FROM results UNION ALL SELECT id, 'dak.created_at', CASE WHEN id % 11 <> 0 THEN 100 ELSE 0 "
    "END FROM results UNION ALL SELECT id, 'dak.approver_id', CASE WHEN id % 4 = 0 THEN 100 ELSE 0 END FROM "
    "results UNION ALL SELECT id, 'dak.approver_name', CASE WHEN id % 2 = 0 THEN 125 ELSE 25 END FROM "
    "results)) WHERE n <= 3 GROUP BY id", "results"))
def key_fields(t: Tables):
    fields = G.key_fields(c("payload"), "dak", 3)
    rows = predictions(t).select(c("prediction_id").alias("id"), fields.alias("fields"))
    return rows.select("id", F.array_join(F.transform("fields", lambda f: f["key"]), " ").alias("fields"),
                       F.array_max(F.transform("fields", lambda f: f["score"])).alias("best"))


@query("row_facts", over(
    "SELECT id, concat('amount=', CASE WHEN amount >= 1000 THEN format('{:,}', CAST(round_even(amount, 0) "
    "AS BIGINT)) ELSE printf('%.2f', amount) END, '; bill number=', CASE WHEN id * 10 >= 1000 THEN "
    "format('{:,}', id * 10) ELSE printf('%.2f', (id * 10)::DOUBLE) END) AS facts FROM results", "results"))
def row_facts(t: Tables):
    facts = F.array_join(F.slice(G.row_facts(c("payload")), 1, 2), "; ")
    return predictions(t).select(c("prediction_id").alias("id"), facts.alias("facts"))
