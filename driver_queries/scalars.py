"""Scalar functions over whole columns."""

from pyspark.sql import functions as F

from auditlens.functions import payload as PL
from auditlens.functions import scalars as S
from auditlens.functions import texts as X
from auditlens.functions.features import FeatureRule, apply_features
from auditlens.functions.scalars import c
from auditlens.operators.rules import parse_evidence
from driver_queries.base import Tables, over, query
from auditlens.operators.joins import join_tables
from driver_queries.joins import DAK_BILL

NUMBER_TEXT = (
    "CASE p_partkey % 12 WHEN 0 THEN '12.' WHEN 1 THEN '1e5' WHEN 2 THEN concat(' ', p_size, ' ') "
    "WHEN 3 THEN 'nan' WHEN 4 THEN '' WHEN 5 THEN '-.5' WHEN 6 THEN '+3.25' WHEN 7 THEN p_name "
    "WHEN 8 THEN 'None' WHEN 9 THEN '1,000' WHEN 10 THEN substr(p_brand, 7) ELSE NULL END"
)
NUMBER = r"'^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)$'"


@query("safe_num", f"SELECT p_partkey, CASE WHEN regexp_matches(trim({NUMBER_TEXT}), {NUMBER}) "
       f"THEN CAST(trim({NUMBER_TEXT}) AS DOUBLE) END AS number FROM part")
def safe_num(t: Tables):
    return t.part.select("p_partkey", S.safe_num(F.expr(NUMBER_TEXT)).alias("number"))


DATE_TEXT = (
    "CASE l_linenumber WHEN 1 THEN concat(substr(CAST(l_shipdate AS STRING), 1, 10), 'T07:08:09') "
    "WHEN 2 THEN concat(substr(CAST(l_shipdate AS STRING), 1, 10), ' 23:59:00+05:30') "
    "WHEN 3 THEN concat(substr(CAST(l_shipdate AS STRING), 1, 10), ' approx') "
    "WHEN 4 THEN concat(' ', substr(CAST(l_shipdate AS STRING), 1, 10), ' ') "
    "WHEN 5 THEN concat(substr(CAST(l_shipdate AS STRING), 1, 10), 'T21:00Z') "
    "WHEN 6 THEN 'none' ELSE '07/1996' END"
)


@query("safe_ts_date", over(
    "SELECT l_orderkey, l_partkey, l_linenumber, CAST(d AS VARCHAR) AS day, "
    "CAST(d + CASE l_linenumber WHEN 1 THEN INTERVAL '7 hours 8 minutes 9 seconds' WHEN 2 THEN "
    "INTERVAL '23 hours 59 minutes' WHEN 5 THEN INTERVAL '21 hours' ELSE INTERVAL '0 hours' END "
    "AS VARCHAR) AS moment, CASE WHEN d IS NOT NULL THEN CASE l_linenumber WHEN 1 THEN 7 WHEN 2 "
    "THEN 23 WHEN 5 THEN 21 ELSE 0 END END AS hour, l_linenumber IN (1, 2, 5) AS timed, "
    "l_linenumber IN (2, 5) AS night FROM x",
    x="SELECT *, CASE WHEN l_linenumber < 6 THEN CAST(l_shipdate AS DATE) END AS d FROM lineitem"))
def safe_ts_date(t: Tables):
    text = F.expr(DATE_TEXT)
    return t.lineitem.select(
        "l_orderkey", "l_partkey", "l_linenumber",
        S.safe_date(text).cast("string").alias("day"), S.safe_ts(text).cast("string").alias("moment"),
        S.safe_hour(text).alias("hour"), S.has_time(text).alias("timed"),
        S.at_night(text).alias("night"))


@query("typed_times", "SELECT event_id, CAST(hour(ts) AS INT) AS hour, "
       "CAST(ts AS DATE) = CAST('2024-01-01' AS DATE) AS first_day, "
       "hour(ts) >= 21 OR hour(ts) < 6 AS night FROM events "
       "WHERE NOT (hour(ts) = 0 AND minute(ts) = 0 AND second(ts) = 0)")
def typed_times(t: Tables):
    ts, kind = c("ts"), t.events.schema["ts"].dataType
    return t.events.where(S.has_time(ts, kind)).select(
        "event_id", S.safe_hour(ts, kind).alias("hour"),
        (S.safe_date(ts, kind) == F.lit("2024-01-01").cast("date")).alias("first_day"),
        S.at_night(ts, kind).alias("night"))


FEATURES = [
    FeatureRule("n", "numeric", "bill.amount"),
    FeatureRule("diff", "difference", "dak.amount", "bill.amount"),
    FeatureRule("ratio", "ratio", "bill.amount", "bill.line"),
    FeatureRule("total", "sum", "dak.amount", "bill.amount"),
    FeatureRule("no status", "missingflag", "dak.record_status"),
    FeatureRule("lag", "daysbetween", "bill.invoice_date", "dak.list_date"),
    FeatureRule("weekend", "isweekend", "bill.invoice_date"),
    FeatureRule("office", "isbusinesshour", "bill.invoice_date"),
    FeatureRule("broken", "ratio", "bill.nowhere", "bill.line"),
]


@query("feature_all", over(
    "SELECT d.id AS dak_id, b.invoice_no, b.line, b.amount AS n, "
    "round(d.amount - b.amount, 4) AS diff, round(b.amount / nullif(b.line - 1, 0), 4) AS ratio, "
    "round(d.amount + b.amount, 4) AS total, 0.0::DOUBLE AS no_status, "
    "epoch(b.invoice_date - d.list_date) / 86400.0 AS lag, "
    "CASE WHEN dayofweek(b.invoice_date) IN (0, 6) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS weekend, "
    "0.0::DOUBLE AS office FROM dak d JOIN bill b ON d.id = b.fk_dak", "dak", "bill"))
def feature_all(t: Tables):
    joined = join_tables(t.catalog("dak", "bill"), ["dak", "bill"], DAK_BILL)
    joined = joined.withColumn("bill.line", c("bill.line") - 1)
    df, _, _ = apply_features(joined, FEATURES)
    return df.select(
        c("dak.id").alias("dak_id"), c("bill.invoice_no").alias("invoice_no"),
        (c("bill.line") + 1).alias("line"), "n", F.round("diff", 4).alias("diff"),
        F.round("ratio", 4).alias("ratio"), F.round("total", 4).alias("total"), "no_status", "lag",
        "weekend", "office")


@query("business_hours", "SELECT event_id, CASE WHEN hour(ts) BETWEEN 8 AND 21 THEN 1.0::DOUBLE "
       "ELSE 0.0::DOUBLE END AS office, CASE WHEN dayofweek(ts) IN (0, 6) THEN 1.0::DOUBLE "
       "ELSE 0.0::DOUBLE END AS weekend FROM events")
def business_hours(t: Tables):
    df, _, _ = apply_features(t.events, [FeatureRule("office", "isbusinesshour", "ts"),
                                         FeatureRule("weekend", "isweekend", "ts")])
    return df.select("event_id", "office", "weekend")


@query("busday_gap", over(
    "SELECT o.o_orderkey, l.l_partkey, l.l_linenumber, CASE WHEN o_orderdate <= l_shipdate "
    "THEN b.before - a.before ELSE bn.before - an.before END::DOUBLE AS gap "
    "FROM orders o JOIN lineitem l ON o_orderkey = l_orderkey "
    "JOIN days a ON a.day = o_orderdate JOIN days b ON b.day = l_shipdate "
    "JOIN days an ON an.day = o_orderdate + INTERVAL '1 day' "
    "JOIN days bn ON bn.day = l_shipdate + INTERVAL '1 day'",
    days="SELECT day, coalesce(sum(CASE WHEN dayofweek(day) BETWEEN 1 AND 5 THEN 1 ELSE 0 END) "
         "OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before "
         "FROM (SELECT unnest(generate_series(TIMESTAMP '1990-01-01', TIMESTAMP '2010-12-31', "
         "INTERVAL '1 day')) AS day)"))
def busday_gap(t: Tables):
    df = t.orders.join(t.lineitem, c("o_orderkey") == c("l_orderkey"))
    return df.select("o_orderkey", "l_partkey", "l_linenumber",
                     S.busday_gap(c("o_orderdate"), c("l_shipdate")).alias("gap"))


BOOL_TEXT = ("CASE l_linenumber WHEN 1 THEN ' TRUE' WHEN 2 THEN 'f' WHEN 3 THEN 'n ' "
             "WHEN 4 THEN 'maybe' WHEN 5 THEN '1' WHEN 6 THEN '' ELSE NULL END")


@query("norm_bool", "SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN 1.0::DOUBLE "
       "WHEN 5 THEN 1.0::DOUBLE WHEN 2 THEN 0.0::DOUBLE WHEN 3 THEN 0.0::DOUBLE END AS value "
       "FROM lineitem")
def norm_bool(t: Tables):
    return t.lineitem.select("l_orderkey", "l_linenumber",
                             S.norm_bool(F.expr(BOOL_TEXT)).alias("value"))


@query("num_or_text_eq", "SELECT l_orderkey, l_partkey, l_linenumber, coalesce("
       "CASE WHEN l_linenumber < 4 THEN l_linenumber = l_quantity ELSE "
       "concat('x', l_linenumber) = concat('x', l_quantity::INT) END, false) AS same FROM lineitem")
def num_or_text_eq(t: Tables):
    left = "CASE WHEN l_linenumber < 4 THEN concat(l_linenumber, '.0') ELSE concat('x', l_linenumber) END"
    right = "CASE WHEN l_linenumber < 4 THEN concat(' ', CAST(l_quantity AS INT)) ELSE concat('x', CAST(l_quantity AS INT)) END"
    return t.lineitem.select("l_orderkey", "l_partkey", "l_linenumber", F.coalesce(
        S.num_or_text_eq(F.expr(left), F.expr(right)), F.lit(False)).alias("same"))


@query("labels", over(
    "SELECT id, CASE WHEN user_rule AND isolation_rule THEN 'Rule + ML' WHEN user_rule THEN 'Rule' "
    "WHEN isolation_rule THEN 'ML' ELSE 'Anomaly' END AS kind, "
    "CASE WHEN user_rule AND user_rule_name IS NOT NULL THEN user_rule_name "
    "WHEN user_rule AND isolation_rule THEN 'Rule and ML anomaly detected' "
    "WHEN user_rule THEN 'Rule anomaly detected' WHEN isolation_rule THEN 'ML anomaly detected' "
    "ELSE 'Anomaly detected' END AS description, CASE feedback_score WHEN 1.0 THEN 'accept' "
    "WHEN 0.5 THEN 'maybe' WHEN 0.0 THEN 'reject' END AS feedback, feedback_score AS score_again, "
    "CASE feedback_score WHEN 1.0 THEN 'Approved' WHEN 0.5 THEN 'Under Review' "
    "WHEN 0.0 THEN 'Under Review' ELSE 'Pending' END AS status FROM results", "results"))
def labels(t: Tables):
    rule, model = c("user_rule"), c("isolation_rule")
    feedback = X.feedback_label(c("feedback_score"))
    return t.results.select(
        "id", X.type_label(rule, model).alias("kind"),
        X.description(rule, model, c("user_rule_name"), F.lit(None).cast("string")).alias(
            "description"),
        feedback.alias("feedback"), X.feedback_score(feedback).alias("score_again"),
        X.review_status(F.lit("PENDING_REVIEW"), feedback).alias("status"))


def payload_of(t: Tables):
    """Orders with their lines as payload maps, keys as the joined columns are called."""
    joined = t.orders.join(t.lineitem, c("o_orderkey") == c("l_orderkey"))
    keys = {
        "bill.Vendor_Name": F.expr("CASE WHEN l_linenumber = 1 THEN concat('V', l_suppkey) "
                                   "WHEN l_linenumber = 2 THEN '  ' END"),
        "dak.amount": F.expr("CASE WHEN l_linenumber % 2 = 0 THEN '0' ELSE "
                             "CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS STRING) END"),
        "bill.amount_claimed": F.expr("CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS STRING)"),
        "bill.amount_passed": F.expr("CASE WHEN l_linenumber = 4 THEN 'n/a' END"),
        "bill.invoice_no": F.expr("CAST(l_partkey AS STRING)"),
    }
    payload = F.map_from_arrays(F.array(*[F.lit(k) for k in keys]),
                                F.array(*[v.cast("string") for v in keys.values()]))
    return joined.select("l_orderkey", "l_partkey", "l_linenumber", payload.alias("payload"))


PAYLOAD_SQL = "FROM orders JOIN lineitem ON o_orderkey = l_orderkey"


@query("payload_amount", "SELECT l_orderkey, l_partkey, l_linenumber, CASE WHEN l_linenumber % 2 = 1 "
       "THEN o_totalprice ELSE l_extendedprice END AS amount, CASE WHEN l_linenumber % 2 = 0 THEN "
       "0.0::DOUBLE ELSE o_totalprice END AS stored, CASE WHEN l_linenumber % 2 = 0 THEN 0.0::DOUBLE "
       f"ELSE o_totalprice END AS page {PAYLOAD_SQL}")
def payload_amount(t: Tables):
    p = c("payload")
    return payload_of(t).select(
        "l_orderkey", "l_partkey", "l_linenumber", PL.payload_amount(p).alias("amount"),
        PL.stored_amount(p).alias("stored"), PL.page_amount(p).alias("page"))


@query("payload_value", "SELECT l_orderkey, l_partkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN "
       "concat('V', l_suppkey) WHEN l_linenumber = 2 THEN '  ' END AS vendor, "
       "CASE WHEN l_linenumber = 1 THEN 'vendor' ELSE 'bill' END AS entity, "
       f"CAST(l_partkey AS VARCHAR) AS invoice {PAYLOAD_SQL}")
def payload_value(t: Tables):
    p = c("payload")
    return payload_of(t).select(
        "l_orderkey", "l_partkey", "l_linenumber",
        PL.payload_value(p, ["vendor_name"]).alias("vendor"), PL.entity_type(p).alias("entity"),
        PL.payload_value(p, ["bill_no", "invoice_no"]).alias("invoice"))


@query("norm_key", over(
    "SELECT id, CASE selected_tables WHEN 'dak.null.bill' THEN 'dak.bill' WHEN 'null' THEN '' "
    "ELSE selected_tables END AS table_key, CASE selected_tables WHEN 'dak.null.bill' THEN "
    "'dak + bill' WHEN 'dak.bill' THEN 'dak + bill' WHEN 'null' THEN 'Unknown' WHEN 'dak_info' THEN "
    "'dak info' ELSE 'dak + cheque slip + schedule3' END AS label FROM results", "results"))
def norm_key(t: Tables):
    return t.results.select("id", X.norm_key(c("selected_tables")).alias("table_key"),
                            X.key_label(c("selected_tables")).alias("label"))


@query("normalise_labels", over(
    "SELECT id, CASE selected_tables WHEN 'dak.null.bill' THEN 'dak.bill' WHEN 'null' THEN '' "
    "ELSE selected_tables END AS selected_tables FROM results", "results"))
def normalise_labels(t: Tables):
    from auditlens.sources.results import normalise_labels as normalise

    return normalise(t.results).select("id", "selected_tables")


@query("risk", over(
    "SELECT id, points AS risk_score, CASE WHEN points >= 85 THEN 'High' WHEN points >= 60 THEN "
    "'Medium' ELSE 'Low' END AS risk_label FROM (SELECT id, CAST(greatest(35, floor("
    "CASE WHEN user_rule THEN greatest(ml_if_score, 0.95::DOUBLE) ELSE ml_if_score END "
    "* 100 + 0.5)) AS INT) AS points FROM results)", "results"))
def risk(t: Tables):
    points = X.risk_score(c("user_rule"), c("ml_if_score"))
    return t.results.select("id", points.alias("risk_score"), X.risk_label(points).alias("risk_label"))


@query("score_rounding", "SELECT event_id, round(value / 7, 3) AS rounded FROM events")
def score_rounding(t: Tables):
    return t.events.select("event_id", S.round_half_even(c("value") / 7).alias("rounded"))


@query("texts", over(
    "SELECT l_orderkey, l_partkey, l_linenumber, concat('Large amount of ', l_partkey) AS shown, "
    "'Over Payment' AS category, CASE WHEN l_extendedprice >= 1000 THEN "
    "format('{:,}', CAST(round_even(l_extendedprice, 0) AS BIGINT)) "
    "ELSE printf('%.2f', l_extendedprice) END AS amount_text, "
    "CASE WHEN l_discount = 0 THEN '0.00' ELSE printf('%.4f', l_discount) END AS discount_text, "
    "CASE WHEN l_discount >= 0.1 THEN '10.0%' WHEN l_discount >= 0.01 THEN "
    "printf('%.2f%%', l_discount * 100) ELSE '0.000%' END AS percent, "
    "round(-log10(greatest(l_discount, 1e-6)), 6) AS rarity FROM lineitem"))
def texts(t: Tables):
    reason = F.concat(F.lit("RULE::Large__amount  of_"), c("l_partkey").cast("string"))
    payment = F.concat(F.lit("outlier::vast_payment_"), c("l_partkey").cast("string"))
    return t.lineitem.select(
        "l_orderkey", "l_partkey", "l_linenumber", X.presentable(reason).alias("shown"),
        X.simplify_reason(X.format_reason(payment)).alias("category"),
        X.value_text(c("l_extendedprice").cast("string")).alias("amount_text"),
        X.value_text(c("l_discount").cast("string")).alias("discount_text"),
        X.percent_text(c("l_discount")).alias("percent"),
        F.round(X.rarity(c("l_discount")), 6).alias("rarity"))


@query("readable_names", "SELECT p_partkey, lower(concat(p_name, ' ', p_type)) AS readable, "
       "lower(p_name) AS category FROM part")
def readable_names(t: Tables):
    name = F.concat(F.lit("t."), F.replace(c("p_name"), F.lit(" "), F.lit("__")), F.lit("_"),
                    c("p_type"), F.lit("__Flag"))
    value = F.concat(F.lit(" _"), F.replace(c("p_name"), F.lit(" "), F.lit("-")), F.lit("  "))
    return t.part.select("p_partkey", X.readable(name).alias("readable"),
                         X.readable_category(value).alias("category"))


@query("epoch_date", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN strftime(ts, '%Y-%m-%d') "
       "WHEN 1 THEN strftime(ts, '%Y-%m-%d') END AS day FROM events")
def epoch_date(t: Tables):
    seconds = F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), c("ts"))
    number = F.when(c("event_id") % 3 == 0, seconds).when(
        c("event_id") % 3 == 1, seconds * 1000).otherwise(c("value"))
    return t.events.select("event_id", X.epoch_date(number.cast("double")).alias("day"))


@query("flex_date", "SELECT l_orderkey, l_partkey, l_linenumber, CASE WHEN l_linenumber < 5 THEN "
       "strftime(l_shipdate, '%Y-%m-%d') END AS day FROM lineitem")
def flex_date(t: Tables):
    iso = "substr(CAST(l_shipdate AS STRING), 1, 10)"
    parts = f"substr({iso}, 9, 2), '{{0}}', substr({iso}, 6, 2), '{{0}}', substr({iso}, 1, 4)"
    text = (f"CASE l_linenumber WHEN 1 THEN {iso} WHEN 2 THEN concat({iso}, 'T10:00:00') "
            f"WHEN 3 THEN concat({parts.format('/')}) WHEN 4 THEN concat({parts.format('-')}) "
            f"WHEN 5 THEN '99/99/1999' ELSE 'Unavailable' END")
    return t.lineitem.select("l_orderkey", "l_partkey", "l_linenumber",
                             X.flex_date(F.expr(text)).cast("string").alias("day"))


@query("merge_reasons", "SELECT l_orderkey, l_partkey, l_linenumber, concat_ws(' | ', "
       "CASE WHEN l_linenumber % 2 = 0 THEN 'late' END, 'Late bill', "
       "CASE WHEN l_linenumber % 3 > 0 THEN concat('bill amount ', l_partkey, ' was paid to wrong "
       "account') END, concat('Bill amount ', l_partkey, ' is above the vendor history mean.')) "
       "AS merged FROM lineitem")
def merge_reasons(t: Tables):
    part = c("l_partkey").cast("string")
    listed = F.concat(F.when(c("l_linenumber") % 2 == 0, "late").otherwise(""), F.lit(",Late bill , "),
                      F.lit("RULE::late_bill"))
    # All words shared says the same; a reason that shares less than half of them does not.
    restated = F.when(c("l_linenumber") % 3 == 0,
                      F.concat(F.lit("vendor history mean: bill amount "), part, F.lit(" above")))
    other = F.concat(F.lit("bill amount "), part, F.lit(" was paid to wrong account"))
    reasons = F.array(listed, F.coalesce(restated, other))
    signal = F.concat(F.lit("Bill amount "), part, F.lit(" is above the vendor history mean."))
    return t.lineitem.select(
        "l_orderkey", "l_partkey", "l_linenumber",
        F.array_join(X.merge_reasons(reasons, F.array(signal)), " | ").alias("merged"))


@query("parse_evidence", "SELECT l_orderkey, l_partkey, l_linenumber, CASE l_linenumber WHEN 1 THEN 0 "
       "WHEN 2 THEN 1 ELSE 2 END AS items, CASE WHEN l_linenumber > 1 THEN l_partkey END AS invoice, "
       "CASE WHEN l_linenumber > 1 THEN concat(l_orderkey, '|', l_suppkey) END AS related "
       "FROM lineitem")
def evidence(t: Tables):
    row = ("concat('{\"kind\":\"duplicate_invoice_fk_daks\",\"table\":\"bill\",\"invoice_number\":\"', "
           "l_partkey, '\",\"duplicate_count\":2,\"similar_fk_daks\":\"', l_orderkey, ', ', l_suppkey, "
           "'\"}')")
    text = (f"CASE l_linenumber WHEN 1 THEN NULL WHEN 2 THEN concat('not json\\n', {row}) "
            f"ELSE concat({row}, '\\n\\n', {row}) END")
    items = parse_evidence(F.expr(text))
    first = F.get(items, 0)
    return t.lineitem.select(
        "l_orderkey", "l_partkey", "l_linenumber", F.size(items).alias("items"),
        first["invoice_number"].cast("long").alias("invoice"),
        F.array_join(first["similar_fk_daks"], "|").alias("related"))
