"""Training, scoring and whole runs. Scores have no SQL twin; what must hold for them does."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import functions as F

from auditlens.functions.features import FeatureRule
from auditlens.functions.scalars import c
from auditlens.model.forest import (
    ForestParams, collect_forest, fit_forest, score_column, score_threshold, tree_samples,
)
from auditlens.operators.user_rules import UserRule
from auditlens.plans.request import RunRequest
from auditlens.plans.review import review_rows
from auditlens.plans.training import train_dataset, training_summary, with_content_ids
from auditlens.plans.workbench import flag_rows, run_workbench, score_candidates
from auditlens.sources.results import ResultStore
from auditlens.sources.staging import spread, stage, staging_root
from driver_queries.base import Tables, over, query

FOREST = ForestParams()


def vectors(t: Tables):
    """Line items as feature vectors; one in a thousand is far off in all features."""
    off = F.expr("CASE WHEN pmod(l_orderkey * 7 + l_partkey, 1000) = 0 THEN 50 ELSE 1 END")
    rows = t.lineitem.select(
        *[(c(n) * off).cast("double").alias(n) for n in ("l_quantity", "l_extendedprice", "l_discount")],
        (off > 1).alias("planted"))
    staged = stage(with_content_ids(rows), "vectors")
    vector = F.array("l_quantity", "l_extendedprice", "l_discount")
    return spread(staged, staged.select("row_id", "planted", vector.alias("features")))


def with_scores(t: Tables):
    """The vectors, and their scores by a forest of them as a column."""
    rows = vectors(t)
    total = rows.count()
    trees = collect_forest(fit_forest(rows, total, FOREST))
    return rows, score_column(t.spark, trees, min(FOREST.tree_rows, total), F.col("features"))


def scored(t: Tables):
    rows, score = with_scores(t)
    return stage(rows.select("row_id", "planted", score.alias("score")), "scores")


@query("forest_samples", "SELECT 500 AS trees, 2048 AS fewest, 2048 AS most, 500 * 2048 AS \"rows\"")
def forest_samples(t: Tables):
    """Each tree draws its rows without replacement."""
    rows = vectors(t)
    drawn = tree_samples(rows.select("row_id"), rows.count(), FOREST).distinct()
    each = drawn.groupBy("tree").agg(F.count("*").alias("n"))
    return each.agg(F.count("*").alias("trees"), F.min("n").alias("fewest"), F.max("n").alias("most"),
                    F.sum("n").alias("rows"))


@query("forest_scores", "SELECT CAST(l_quantity * k AS DOUBLE) AS quantity, CAST(l_extendedprice * k AS DOUBLE) AS price, "
       "CAST(l_discount * k AS DOUBLE) AS discount, k > 1 AS planted, true AS in_range FROM (SELECT *, CASE WHEN "
       "(l_orderkey * 7 + l_partkey) % 1000 = 0 THEN 50 ELSE 1 END AS k FROM lineitem)")
def forest_scores(t: Tables):
    """Every vector gets a score in (0, 1]; scores themselves have no SQL twin."""
    rows, score = with_scores(t)
    vector = F.col("features")
    return rows.select(vector[0].alias("quantity"), vector[1].alias("price"), vector[2].alias("discount"), "planted",
                       F.coalesce((score > 0) & (score <= 1), F.lit(False)).alias("in_range"))


@query("forest_repeats", "SELECT count(*) AS scored_rows, 0 AS different FROM lineitem")
def forest_repeats(t: Tables):
    """Two trainings on the same rows, staged anew each time, give the same scores."""
    again = scored(t).select("row_id", c("score").alias("again"))
    return scored(t).join(again, "row_id").agg(
        F.count("*").alias("scored_rows"),
        F.count_if(~(F.abs(c("score") - c("again")) < 1e-12)).alias("different"))


@query("forest_properties", "SELECT count(*) AS scored_rows, true AS in_range, true AS share_matches, "
       "true AS planted_stand_out FROM lineitem")
def forest_properties(t: Tables):
    """Scores lie in (0, 1], the threshold leaves the wanted share above, outliers score higher."""
    rows = scored(t)
    threshold = score_threshold(rows, 0.02)
    return rows.agg(
        F.count("score").alias("scored_rows"),
        ((F.min("score") > 0) & (F.max("score") <= 1)).alias("in_range"),
        (F.abs(F.avg(F.when(c("score") > threshold, 1.0).otherwise(0.0)) - 0.02) < 0.002).alias(
            "share_matches"),
        F.coalesce(F.min(F.when(c("planted"), c("score")))
                   > F.avg(F.when(~c("planted"), c("score"))), F.lit(True)).alias("planted_stand_out"))


def trained(t: Tables):
    """Model of orders and their line items."""
    return train_dataset(t.catalog("dak", "bill"), "dak.bill")


@query("training_summary", over(
    "SELECT 'dak.bill' AS dataset, count(*) AS source, count(*) AS queried, "
    "count(*) FILTER (WHERE NOT void) AS after_invoices, count(*) FILTER (WHERE NOT void) AS training "
    "FROM g", "dak", "bill",
    g="SELECT b.*, count(*) OVER (PARTITION BY invoice_no, invoice_date) > 1 AND b.record_status = 'V' AS "
      "void FROM dak d JOIN bill b ON d.id = b.fk_dak"))
def summary_of_training(t: Tables):
    return training_summary([trained(t)], t.spark).select(
        "dataset", "source", "queried", "after_invoices", "training")


REQUEST = RunRequest(
    tables=["bill", "dak"], run_name="lines",
    user_rules=[UserRule("Large amount", "bill.amount", ">", "103000")],
    feature_rules=[FeatureRule("share", "ratio", "bill.amount", "dak.amount")],
    from_date="1996-01-01", to_date="1998-12-31")


@query("score_candidates", over(
    "SELECT count(*) AS total_rows, count(*) FILTER (WHERE rule) AS rule_rows, count(*) FILTER (WHERE NOT "
    "rule) AS scored_rows, 0 AS rule_rows_with_score FROM (SELECT b.amount > 103000 OR g.invoice_no IS NOT "
    "NULL AS rule FROM dak d JOIN bill b ON d.id = b.fk_dak LEFT JOIN g ON g.invoice_no = b.invoice_no AND "
    "g.invoice_date = b.invoice_date AND b.record_status = 'V' WHERE d.list_date >= DATE '1996-01-01' AND "
    "d.list_date < DATE '1999-01-01')", "dak", "bill",
    g="SELECT invoice_no, invoice_date FROM bill WHERE record_status = 'V' GROUP BY 1, 2 "
      "HAVING count(*) > 1"))
def candidates(t: Tables):
    request, _ = REQUEST.with_dataset_defaults()
    flagged = flag_rows(t.catalog("dak", "bill"), request).rows
    rows = score_candidates(flagged, trained(t))
    return rows.agg(
        F.count("*").alias("total_rows"), F.count_if("rule_flag").alias("rule_rows"),
        F.count("ml_score").alias("scored_rows"),
        F.count_if(c("rule_flag") & c("ml_score").isNotNull()).alias("rule_rows_with_score"))


def finished_run(t: Tables) -> tuple[dict, ResultStore]:
    store = ResultStore(t.spark, f"{staging_root(t.spark)}/store-{uuid.uuid4().hex}")
    record = run_workbench(t.catalog("dak", "bill"), REQUEST, trained(t), store)
    return record, store


@query("workbench_run", over(
    "SELECT 'lines' AS run_name, count(*) AS total_rows, count(*) FILTER (WHERE rule) AS user_rule_count, "
    "true AS counts_add_up FROM (SELECT b.amount > 103000 OR g.invoice_no IS NOT NULL AS rule FROM dak d JOIN "
    "bill b ON d.id = b.fk_dak LEFT JOIN g ON g.invoice_no = b.invoice_no AND g.invoice_date = b.invoice_date "
    "AND b.record_status = 'V' WHERE d.list_date >= DATE '1996-01-01' AND d.list_date < DATE '1999-01-01')",
    "dak", "bill", g="SELECT invoice_no, invoice_date FROM bill WHERE record_status = 'V' GROUP BY 1, 2 "
                     "HAVING count(*) > 1"))
def workbench_run(t: Tables):
    _, store = finished_run(t)
    stored = store.anomalies().agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"))
    n, ids = stored.first()
    return store.runs().select(
        "run_name", "total_rows", "user_rule_count",
        ((c("final_anomaly_count") == c("user_rule_count") + c("ml_anomaly_count"))
         & (c("final_anomaly_count") == n) & (F.lit(ids) == n)).alias("counts_add_up"))


DUPLICATE = "bill has duplicate invoice_no and invoice_date with record_status V"
RULE_ROWS = over(
    "SELECT d.id AS fk_dak, b.line, d.amount, b.amount > 103000 AS large, g.invoice_no IS NOT NULL AS twice, g.n, g.related "
    "FROM dak d JOIN bill b ON d.id = b.fk_dak LEFT JOIN g ON g.invoice_no = b.invoice_no AND g.invoice_date = b.invoice_date "
    "AND b.record_status = 'V' WHERE d.list_date >= DATE '1996-01-01' AND d.list_date < DATE '1999-01-01' "
    "AND (b.amount > 103000 OR g.invoice_no IS NOT NULL)", "dak", "bill",
    g="SELECT invoice_no, invoice_date, count(*) AS n, count(DISTINCT fk_dak) AS related FROM bill WHERE record_status = 'V' "
      "GROUP BY 1, 2 HAVING count(*) > 1")
NAMED = f"CASE WHEN large THEN 'Large amount' ELSE '{DUPLICATE.replace('_', ' ')}' END"


@query("anomaly_rows", f"SELECT fk_dak, CAST(line AS VARCHAR) AS line, 'dak.bill' AS selected_tables, {NAMED} AS user_rule_name, "
       f"true AS user_rule, false AS isolation_rule, true AS no_score, 1 AS ml_run_id, CASE WHEN twice THEN '{DUPLICATE}' ELSE '' END "
       f"AS builtin_reason, n AS duplicate_count, related AS related_count FROM ({RULE_ROWS})")
def anomaly_rows(t: Tables):
    """Rows that a run has stored for its rules, with reasons, payload cell and evidence."""
    _, store = finished_run(t)
    evidence = F.get(c("feature_values")["rule_evidence"], 0)
    return store.anomalies().where("user_rule").select(
        "fk_dak", F.try_element_at("payload", F.lit("bill.line")).alias("line"), "selected_tables", "user_rule_name", "user_rule",
        "isolation_rule", (c("ml_if_score").isNull() & c("ml_reason").isNull()).alias("no_score"), "ml_run_id", "builtin_reason",
        evidence["duplicate_count"].alias("duplicate_count"), evidence["similar_fk_dak_count"].alias("related_count"))


@query("model_rows", "SELECT true AS counts_match, 0 AS below_margin, 0 AS without_sentence, 0 AS with_rule, 0 AS without_payload")
def model_rows(t: Tables):
    """What must hold for the rows that a run has stored for its model."""
    record, store = finished_run(t)
    rows = store.anomalies().where("isolation_rule")
    return rows.agg(
        (F.count("*") == record["ml_anomaly_count"]).alias("counts_match"),
        F.count_if(~(c("ml_if_score") > c("ml_threshold"))).alias("below_margin"),
        F.count_if(F.coalesce(F.trim("ml_reason"), F.lit("")) == "").alias("without_sentence"),
        F.count_if("user_rule").alias("with_rule"),
        F.count_if(F.try_element_at("payload", F.lit("bill.line")).isNull()).alias("without_payload"))


@query("reviewed_run", f"SELECT true AS rule_flag, false AS ml_flag, 1.0::DOUBLE AS final_score, amount, CASE WHEN large AND twice THEN "
       f"concat('Large amount; ', '{DUPLICATE}') WHEN large THEN 'Large amount' ELSE concat('{DUPLICATE.replace('_', ' ')}', '; ', "
       f"'{DUPLICATE}') END AS reasons FROM ({RULE_ROWS})")
def reviewed_run(t: Tables):
    """The rule rows of a run as predictions, with payloads looked up by id."""
    record, store = finished_run(t)
    review = review_rows(store.anomalies(), run_id=record["run_id"], filter_name="rule", limit=record["total_rows"])
    return review.rows.select("rule_flag", "ml_flag", "final_score", "amount", F.array_join("reason_list", "; ").alias("reasons"))


@query("feedback_written", over(
    "SELECT id AS fk_dak, CASE WHEN place <= 40 THEN 1.0::DOUBLE WHEN place <= 60 THEN 0.5::DOUBLE WHEN place <= 100 THEN 0.0::DOUBLE "
    "END AS feedback_score FROM (SELECT id, row_number() OVER (ORDER BY amount DESC, id) AS place FROM results)", "results"))
def feedback_written(t: Tables):
    """All result rows stored as a run; the hundred largest get feedback, some of them twice."""
    store = ResultStore(t.spark, f"{staging_root(t.spark)}/store-{uuid.uuid4().hex}")
    writer = store.begin()
    writer.write_anomalies(t.results.withColumns({"fk_dak": c("id"), "feature_values": F.lit(None).cast("string")}).drop(
        "id", "feedback_score"))
    writer.commit({"run_name": "results"})
    largest = [r[0] for r in store.anomalies().orderBy(F.desc("amount"), "fk_dak").limit(100).select("id").collect()]
    store.record_feedback([(i, "maybe") for i in largest[:60]] + [(i, "reject") for i in largest[60:]], datetime(2026, 1, 1))
    store.record_feedback([(i, " Accept") for i in largest[:40]], datetime(2026, 1, 2))
    return store.anomalies().select("fk_dak", "feedback_score")
