"""Review: pages, lists, payloads, names, feedback and summaries."""

from pyspark.sql import functions as F

from auditlens.functions.scalars import c
from auditlens.functions.texts import feedback_score
from auditlens.operators import enrich as E
from auditlens.operators import summaries as S
from auditlens.plans import review as V
from auditlens.sources.results import latest_feedback, with_feedback
from driver_queries.base import Tables, over, query

# --- payloads: one per order; every eighth has no business data and is rebuilt -----------------

AMOUNT = "CAST(CAST(amount AS DECIMAL(12,2)) AS STRING)"


def every_payload(t: Tables):
    """A payload for every result row; those of some rows have no business columns."""
    full = F.create_map(
        F.lit("dak.amount"), F.expr(AMOUNT), F.lit("dak.detected_on"), c("detected"),
        F.lit("dak.fk_office_id"), (c("fk_dak") % 30).cast("string"),
        F.lit("dak.fk_vendor"), (c("fk_dak") % 150).cast("string"),
        F.lit("dak.fk_central_vendor"), c("fk_dak").cast("string"),
        F.lit("dak.fk_section"), (c("id") % 7).cast("string"),
        F.lit("bill.invoice_no"), c("id").cast("string"),
    )
    bare = F.create_map(F.lit("fk_dak"), c("fk_dak").cast("string"))
    return t.results.select(
        "id", F.when((c("id") % 3 == 0) | (c("id") % 8 == 0), bare).otherwise(full).alias("payload"))


def payloads(t: Tables):
    """Stored payloads; a third of the rows have none stored, so that readers must do without."""
    return every_payload(t).where("id % 3 <> 0")


def lookups(t: Tables):
    """Office, vendor, central vendor and section names from the small tables."""
    return {
        "dad_office": t.nation.select(c("n_nationkey").alias("id"), F.expr(
            "CASE WHEN n_nationkey = 3 THEN ' ' ELSE concat(n_name, ' ') END").alias("office_name")),
        "vendor": t.supplier.where("s_suppkey <= 90").select(
            c("s_suppkey").alias("id"), c("s_name").alias("vendor_name")),
        "aaa_central_vendor": t.customer.select(
            c("c_custkey").alias("id"), c("c_name").alias("vendor_name")),
        "section": t.region.select(c("r_regionkey").alias("id"), c("r_name").alias("section_name")),
    }


def with_payload(t: Tables):
    """Result rows with their stored payload; rows without one have an empty payload."""
    return t.results.join(payloads(t), "id", "left")


NAMES = ("SELECT id, n_name AS office, coalesce(s_name, c_name) AS vendor, r_name AS section FROM "
         "results LEFT JOIN nation ON n_nationkey = fk_dak % 30 AND n_nationkey > 0 AND n_nationkey <> 3 "
         "LEFT JOIN supplier ON s_suppkey = fk_dak % 150 AND s_suppkey > 0 AND s_suppkey <= 90 "
         "LEFT JOIN customer ON c_custkey = fk_dak AND c_custkey > 0 "
         "LEFT JOIN region ON r_regionkey = id % 7 AND r_regionkey > 0 "
         "WHERE id % 3 <> 0 AND id % 8 <> 0")


@query("enrich_names", over(
    "SELECT r.id, office, vendor, section FROM results r LEFT JOIN n ON n.id = r.id", "results", n=NAMES))
def enrich_names(t: Tables):
    named = E.enrich_names(every_payload(t), lookups(t))
    return named.select("id", *[
        F.try_element_at("payload", F.lit(f"resolved_{n}_name")).alias(n)
        for n in ("office", "vendor", "section")])


@query("lookup_ids", over(
    "SELECT DISTINCT 'fk_section' AS lookup, id % 7 AS id FROM results WHERE id % 3 <> 0 AND id % 8 <> 0 "
    "AND id % 7 > 0 UNION ALL SELECT DISTINCT 'fk_vendor', fk_dak % 150 FROM results WHERE id % 3 <> 0 "
    "AND id % 8 <> 0 AND fk_dak % 150 > 0", "results"))
def lookup_ids(t: Tables):
    return E.lookup_ids(every_payload(t), ["fk_section", "fk_vendor"])


@query("attach_payload", over(
    "SELECT id, CASE WHEN id % 3 = 0 OR id % 8 = 0 THEN 'fk_dak' ELSE 'bill.invoice_no' END AS first_key, "
    "CASE WHEN id % 3 <> 0 AND id % 8 <> 0 THEN CAST(detected AS VARCHAR) END AS detected FROM results",
    "results"))
def attach_payload(t: Tables):
    df = E.attach_payload(t.results, payloads(t))
    return df.select("id", F.array_min(F.map_keys("payload")).alias("first_key"),
                     F.try_element_at("payload", F.lit("dak.detected_on")).alias("detected"))


@query("rebuild_payload", over(
    "SELECT d.id AS record_key, CAST(d.priority AS VARCHAR) AS priority, CAST(b.id AS VARCHAR) AS bill_id, "
    "CAST(b.line AS VARCHAR) AS line FROM dak d LEFT JOIN (SELECT fk_dak, min(id) AS id, "
    "arg_min(line, id) AS line FROM lines GROUP BY fk_dak) b ON b.fk_dak = d.id WHERE d.id > 0",
    "dak", lines="SELECT l_orderkey AS fk_dak, l_partkey * 100000 + l_suppkey * 10 + l_linenumber AS id, "
                 "l_linenumber AS line FROM lineitem"))
def rebuild_payload(t: Tables):
    catalog = t.catalog("dak")
    catalog["bill"] = t.lineitem.selectExpr(
        "l_orderkey AS fk_dak", "l_partkey * 100000 + l_suppkey * 10 + l_linenumber AS id",
        "l_linenumber AS line")
    keys = t.dak.select(c("id").alias("record_key"))
    built = E.rebuild_payload(keys, catalog, ["dak", "bill"])
    return built.select("record_key", *[
        F.try_element_at("payload", F.lit(key)).alias(n)
        for n, key in (("priority", "dak.priority"), ("bill_id", "bill.id"), ("line", "bill.line"))])


@query("reason_by_id", over(
    "SELECT id, trim(user_rule_name) AS reason FROM results WHERE trim(user_rule_name) <> ''", "results"))
def reason_by_id(t: Tables):
    return E.reason_by_id(t.results, reasons="user_rule_name")


@query("payload_amount_total", over(
    "SELECT count(*) AS total_rows, CAST(sum(CASE WHEN id % 3 <> 0 AND id % 8 <> 0 THEN "
    "CAST(amount AS DECIMAL(18,2)) ELSE 0 END) AS DOUBLE) AS total_amount FROM results", "results"))
def payload_amount_total(t: Tables):
    return E.payload_amount_total(t.results, payloads(t))


# --- summaries ----------------------------------------------------------------------------------


@query("feedback_summary", over(
    "SELECT count(feedback_score) AS reviewed_count, count(*) - count(feedback_score) AS pending_count, "
    "count(*) FILTER (WHERE feedback_score = 1.0) AS accepted_count FROM results WHERE ml_run_id = 1997",
    "results"))
def feedback_summary(t: Tables):
    return S.feedback_summary(t.results, 1997)


@query("dataset_summary", over(
    "SELECT count(*) AS total_rows, CAST(sum(CASE WHEN id % 3 <> 0 AND id % 8 <> 0 THEN "
    "CAST(amount AS DECIMAL(18,2)) ELSE 0 END) AS DOUBLE) AS total_amount FROM results "
    "WHERE user_rule AND ml_run_id = 1997", "results"))
def dataset_summary(t: Tables):
    return S.dataset_summary(with_payload(t), "rule", 1997)


@query("table_options", over(
    "SELECT table_key, sum(n)::BIGINT AS row_count, CASE table_key WHEN 'dak.bill' THEN 'dak + bill' "
    "WHEN 'dak_info' THEN 'dak info' ELSE 'dak + cheque slip + schedule3' END AS label FROM (SELECT "
    "replace(selected_tables, '.null', '') AS table_key, count(*) AS n FROM results WHERE "
    "selected_tables <> 'null' GROUP BY 1) GROUP BY 1", "results"))
def table_options(t: Tables):
    return S.table_options(t.results)


@query("list_summary", over(
    "SELECT count(*) AS total_rows, count(feedback_score) AS reviewed_rows, "
    "count(*) - count(feedback_score) AS not_reviewed_rows FROM results", "results"))
def list_summary(t: Tables):
    return S.list_summary(t.results)


@query("amount_total", "SELECT CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) FILTER "
       "(WHERE l_linenumber <> 2) AS DOUBLE) AS amount_total FROM lineitem")
def amount_total(t: Tables):
    text = F.expr("CASE WHEN l_linenumber = 2 THEN 'n/a' ELSE "
                  "CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS STRING) END")
    return S.amount_total(t.lineitem.select(text.alias("bill.amount")), "amount")


@query("run_counters", over(
    "SELECT count(*) AS total_rows, count(*) FILTER (WHERE user_rule) AS user_rule_count, "
    "count(*) FILTER (WHERE isolation_rule) AS ml_anomaly_count, count(*) FILTER (WHERE user_rule OR "
    "isolation_rule) AS final_anomaly_count FROM results", "results"))
def run_counters(t: Tables):
    return S.run_counters(t.results, "user_rule", "isolation_rule")


def runs(t: Tables):
    """Run records as the counters of each run in the result table."""
    counted = t.results.groupBy(c("ml_run_id").cast("long").alias("run_id")).agg(
        F.count("*").alias("total_rows"), F.count_if("user_rule").alias("user_rule_count"),
        F.count_if(c("user_rule") | c("isolation_rule")).alias("final_anomaly_count"))
    return counted.select(
        "*", F.concat(F.lit("run "), c("run_id").cast("string")).alias("run_name"),
        F.array(F.lit("dak"), F.when(c("run_id") % 2 == 0, "bill").otherwise("ecs")).alias(
            "source_tables"),
        F.lit("IsolationForest").alias("selected_model"))


@query("run_report", over(
    "SELECT CAST(1997 AS BIGINT) AS run_id, 'run 1997' AS run_name, count(*) AS total_rows, "
    "count(*) FILTER (WHERE user_rule OR isolation_rule) AS anomaly_count, "
    "count(feedback_score) AS reviewed_count, count(*) - count(feedback_score) AS pending_count, "
    "count(*) FILTER (WHERE feedback_score = 1.0) AS accepted_count, CAST(sum(CASE WHEN id % 3 <> 0 AND "
    "id % 8 <> 0 AND (user_rule OR isolation_rule) THEN CAST(amount AS DECIMAL(18,2)) ELSE 0 END) AS "
    "DOUBLE) AS amount, 'IsolationForest' AS selected_model FROM results WHERE ml_run_id = 1997",
    "results"))
def run_report(t: Tables):
    return S.run_report(runs(t), with_payload(t), 1997)


@query("latest_runs", over(
    "SELECT source, CAST(max(ml_run_id) AS BIGINT) AS run_id, CAST(arg_max(n, ml_run_id) AS BIGINT) AS "
    "total_rows FROM (SELECT CASE WHEN ml_run_id % 2 = 0 THEN 'dak.bill' ELSE 'dak.ecs' END AS source, "
    "ml_run_id, count(*) AS n FROM results GROUP BY 1, 2) GROUP BY source", "results"))
def latest_runs(t: Tables):
    named = runs(t).withColumn("source", F.array_join("source_tables", "."))
    return S.latest_per(named, ["source"], ["run_id"]).select("source", "run_id", "total_rows")


@query("latest_per_group", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER "
       "(PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def latest_per_group(t: Tables):
    return S.latest_per(t.events, ["user_id"], ["ts", "event_id"]).select(
        "user_id", "event_id", "event_type")


FEEDBACK = ("SELECT record_id, sequence, feedback FROM (SELECT *, row_number() OVER (PARTITION BY "
            "record_id ORDER BY \"at\" DESC, sequence DESC) AS n FROM feedback_log) WHERE n = 1")


def feedback_log(t: Tables):
    return t.feedback_log.withColumn("feedback_score", feedback_score(c("feedback")))


@query("feedback_latest", over(FEEDBACK, "feedback_log"))
def feedback_latest(t: Tables):
    return latest_feedback(feedback_log(t)).select("record_id", "sequence", "feedback")


@query("feedback_on_rows", over(
    "SELECT id, CASE feedback WHEN 'accept' THEN 1.0::DOUBLE WHEN 'maybe' THEN 0.5::DOUBLE WHEN 'reject' "
    "THEN 0.0::DOUBLE END AS feedback_score FROM results LEFT JOIN f ON f.record_id = id",
    "results", "feedback_log", f=FEEDBACK))
def feedback_on_rows(t: Tables):
    return with_feedback(t.results, feedback_log(t)).select("id", "feedback_score")


# --- pages --------------------------------------------------------------------------------------


@query("review_page", over(
    "SELECT id, selected_tables, user_rule_name, user_rule, isolation_rule, ml_if_score, ml_threshold, "
    "feedback_score, ml_run_id, fk_dak FROM results WHERE user_rule AND ml_run_id = 1996 "
    "ORDER BY id LIMIT 50 OFFSET 100", "results"))
def review_page(t: Tables):
    return V.review_page(t.results, "rule", 1996, None, 100)


@query("anomaly_page", over(
    "SELECT id, selected_tables FROM results WHERE (user_rule OR isolation_rule) AND feedback_score IS "
    "NULL ORDER BY id DESC LIMIT 500 OFFSET 20", "results"))
def anomaly_page(t: Tables):
    return V.anomaly_page(t.results, None, "all", "not_reviewed", 9_999, 20).select(
        "id", "selected_tables")


LIST = ("SELECT id, fk_dak, CASE selected_tables WHEN 'dak.null.bill' THEN 'dak.bill' ELSE selected_tables "
        "END AS table_key, 'dak + bill' AS table_label, CASE WHEN user_rule AND isolation_rule THEN "
        "'Rule + ML' WHEN user_rule THEN 'Rule' ELSE 'ML' END AS anomaly_type, CASE WHEN user_rule THEN "
        "user_rule_name ELSE 'ML anomaly detected' END AS anomaly_description, CASE feedback_score WHEN "
        "1.0 THEN 'accept' ELSE 'maybe' END AS user_feedback, true AS reviewed, ml_run_id AS run_id "
        "FROM results WHERE (user_rule OR isolation_rule) AND selected_tables IN ('dak.bill', "
        "'dak.null.bill') ORDER BY id DESC LIMIT 500")


@query("anomaly_list", over(LIST, "results"))
def anomaly_list(t: Tables):
    return V.anomaly_list(t.results, "dak.bill", limit=500).rows


@query("anomaly_list_summary", over(
    "SELECT count(*) AS total_rows, count(*) AS reviewed_rows, 0 AS not_reviewed_rows FROM results WHERE "
    "user_rule AND selected_tables IN ('dak.bill', 'dak.null.bill')", "results"))
def anomaly_list_summary(t: Tables):
    return V.anomaly_list(t.results, "dak.bill", "rule").summary


PREDICTIONS = (
    "SELECT id AS prediction_id, user_rule AS rule_flag, isolation_rule AS ml_flag, CASE WHEN user_rule "
    "THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS rule_score, ml_if_score AS final_score, CASE WHEN "
    "feedback_score IS NULL THEN 'PENDING_REVIEW' ELSE 'REVIEWED' END AS review_status, CASE feedback_score "
    "WHEN 1.0 THEN 'accept' WHEN 0.5 THEN 'maybe' WHEN 0.0 THEN 'reject' END AS feedback, "
    "coalesce(user_rule_name, '') AS reasons FROM results")


@query("predictions", over(PREDICTIONS, "results"))
def predictions(t: Tables):
    return V.to_prediction(t.results).select(
        "prediction_id", "rule_flag", "ml_flag", "rule_score", "final_score", "review_status",
        "feedback", F.array_join("reason_list", "; ").alias("reasons"))


@query("review_rows", over(
    "SELECT p.prediction_id, p.reasons, CASE WHEN r.id % 3 <> 0 AND r.id % 8 <> 0 THEN r.amount ELSE d.amount "
    "END AS amount, n.office, n.vendor, n.section FROM (" + PREDICTIONS + ") p JOIN results r ON r.id = "
    "p.prediction_id JOIN dak d ON d.id = r.fk_dak LEFT JOIN n ON n.id = r.id WHERE r.ml_run_id = 1997 AND "
    "(r.user_rule OR r.isolation_rule) ORDER BY p.prediction_id LIMIT 200 OFFSET 40",
    "results", "dak", n=NAMES))
def review_rows(t: Tables):
    """A page with stored payloads; rows without business data are rebuilt from the sources."""
    review = V.review_rows(
        t.results, run_id=1997, limit=200, offset=40, payloads=payloads(t), catalog=t.catalog("dak"),
        tables=["dak"], lookups=lookups(t))
    return review.rows.select(
        "prediction_id", F.array_join("reason_list", "; ").alias("reasons"), "amount", *[
            F.when((c("prediction_id") % 3 != 0) & (c("prediction_id") % 8 != 0),
                   F.try_element_at("payload", F.lit(f"resolved_{n}_name"))).alias(n)
            for n in ("office", "vendor", "section")])
