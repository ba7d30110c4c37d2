"""Built-in rules, alone and combined."""

from pyspark.sql import functions as F

from auditlens import fixed
from auditlens.functions.scalars import c
from auditlens.operators import rules as R
from auditlens.operators.joins import join_tables, training_join
from auditlens.operators.projection import qualify
from auditlens.plans.training import TrainingOptions, training_count, training_source
from driver_queries.base import Tables, over, query
from driver_queries.joins import DAK_BILL, DUPLICATES

SLIP = ("cheque_slip.fk_dak", "cheque_slip.record_status", "cheque_slip.approved")
SLIP_COLUMNS = {
    "fk_dak": "cheque_slip.fk_dak", "line": "cheque_slip.fk_ecs_payment_mode",
    "amount": "cheque_slip.amount",
}
R2 = "(fk_ecs_payment_mode = 1 AND EXISTS (SELECT 1 FROM ecs e WHERE e.fk_dak = s.fk_dak))"
R3 = ("(record_status = 'V' AND NOT approved AND EXISTS "
      "(SELECT 1 FROM schedule3 x WHERE x.fk_dak = s.fk_dak))")
R4 = ("(record_status = 'V' AND approved AND (SELECT count(*) FROM cheque_slip y WHERE "
      "y.fk_dak = s.fk_dak AND y.record_status = 'V' AND y.approved) <> (SELECT count(*) FROM "
      "schedule3 x WHERE x.fk_dak = s.fk_dak AND x.record_status IN ('P', 'V')))")
R5 = "(approved AND fk_aao IS NULL AND fk_ao IS NULL AND fk_auditor IS NULL)"


def _slips(t: Tables, *rules):
    df = qualify(t.cheque_slip, "cheque_slip")
    catalog = t.catalog("cheque_slip", "schedule3", "ecs")
    flagged = R.apply_rules(df, catalog, list(rules))
    return flagged.where("sql_rule_flag").select(
        *[c(full).alias(n) for n, full in SLIP_COLUMNS.items()])


def _slip_sql(condition: str) -> str:
    return over("SELECT fk_dak, fk_ecs_payment_mode AS line, amount FROM cheque_slip s "
                f"WHERE {condition}", "cheque_slip", "schedule3", "ecs")


@query("rule_missing_ref", over(
    "SELECT payment_reference_no FROM cmp_scroll c WHERE cda_name = 'CDA- Main Office Jabalpur' "
    "AND NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = c.payment_reference_no)",
    "cmp_scroll"))
def rule_missing_ref(t: Tables):
    catalog = t.catalog("cmp_scroll")
    catalog["ecs"] = t.lineitem.select(F.col("l_orderkey").alias("payment_reference_no"))
    df = qualify(t.cmp_scroll, "cmp_scroll")
    rules = R.builtin_rules(catalog, df.schema, ["cmp_scroll", "ecs"])
    return R.apply_rules(df, catalog, rules).where("sql_rule_flag").select(
        c("cmp_scroll.payment_reference_no").alias("payment_reference_no"))


@query("rule_mode_conflict", _slip_sql(R2))
def rule_mode_conflict(t: Tables):
    return _slips(t, R.mode_conflict(SLIP[0], "cheque_slip.fk_ecs_payment_mode", "ecs", "fk_dak",
                                     fixed.REASON_MODE_CONFLICT))


@query("rule_unapproved_children", _slip_sql(R3))
def rule_unapproved_children(t: Tables):
    return _slips(t, R.slip_schedule_rules(*SLIP)[0])


@query("rule_count_mismatch", over(
    "SELECT s.fk_dak, fk_ecs_payment_mode AS line, amount FROM cheque_slip s LEFT JOIN "
    "(SELECT fk_dak, count(*) AS n FROM cheque_slip WHERE record_status = 'V' AND approved "
    "GROUP BY fk_dak) a ON a.fk_dak = s.fk_dak LEFT JOIN (SELECT fk_dak, count(*) AS n FROM "
    "schedule3 WHERE record_status IN ('P', 'V') GROUP BY fk_dak) b ON b.fk_dak = s.fk_dak "
    "WHERE record_status = 'V' AND approved AND coalesce(a.n, 0) <> coalesce(b.n, 0)",
    "cheque_slip", "schedule3"))
def rule_count_mismatch(t: Tables):
    return _slips(t, R.slip_schedule_rules(*SLIP)[1])


@query("rule_no_owner", _slip_sql(R5))
def rule_no_owner(t: Tables):
    owners = [f"cheque_slip.{n}" for n in fixed.OWNER_COLUMNS]
    return _slips(t, R.approved_without_owner(SLIP[2], owners, fixed.REASON_NO_OWNER))


@query("rule_duplicate_invoice", over(
    "SELECT b.fk_dak, b.line, b.invoice_no, g.duplicate_count, g.related, "
    "CAST(g.invoice_date_key AS VARCHAR) AS invoice_date, "
    "'bill has duplicate invoice_no and invoice_date with record_status V' AS reasons "
    "FROM bill b JOIN g ON g.invoice_key = b.invoice_no AND "
    "g.invoice_date_key = CAST(b.invoice_date AS DATE) WHERE b.record_status = 'V'",
    "bill", g=DUPLICATES))
def rule_duplicate_invoice(t: Tables):
    df, catalog = qualify(t.bill, "bill"), t.catalog("bill")
    keys = R.duplicate_key_columns(catalog, "bill")
    flagged = R.apply_rules(df, catalog, [R.duplicate_invoice(keys, df.schema)])
    found = F.get(c("sql_rule_evidence"), 0)
    return flagged.where("sql_rule_flag").select(
        c("bill.fk_dak").alias("fk_dak"), c("bill.line").alias("line"),
        c("bill.invoice_no").alias("invoice_no"), found["duplicate_count"].alias("duplicate_count"),
        F.array_join(found["similar_fk_daks"], ", ").alias("related"),
        found["invoice_date"].alias("invoice_date"),
        F.array_join("sql_rule_reasons", ", ").alias("reasons"))


@query("rule_date_sequence", over(
    "SELECT d.id, b.invoice_no, b.line, 'Date sequence violated across processing stages: "
    "invoice_date after disposal_date' AS reasons FROM dak d JOIN bill b ON d.id = b.fk_dak "
    "WHERE CAST(d.list_date AS DATE) > CAST(b.invoice_date AS DATE)", "dak", "bill"))
def rule_date_sequence(t: Tables):
    joined = join_tables(t.catalog("dak", "bill"), ["dak", "bill"], DAK_BILL).select(
        c("dak.id"), c("bill.invoice_no"), c("bill.line"),
        c("dak.list_date").alias("bill.invoice_date"), c("bill.invoice_date").alias("bill.disposal_date"))
    flagged = R.apply_rules(joined, t.catalog(), R.date_sequence(joined.schema))
    return flagged.where("sql_rule_flag").select(
        c("dak.id").alias("id"), c("bill.invoice_no").alias("invoice_no"),
        c("bill.line").alias("line"), F.array_join("sql_rule_reasons", ", ").alias("reasons"))


@query("rule_night", "SELECT event_id, 'Timestamp activity happened between 21:00 and 06:00: "
       "events.ts' AS reasons FROM events WHERE (hour(ts) >= 21 OR hour(ts) < 6) AND "
       "NOT (hour(ts) = 0 AND minute(ts) = 0 AND second(ts) = 0)")
def rule_night(t: Tables):
    df = qualify(t.events, "events")
    flagged = R.apply_rules(df, t.catalog(), R.night_activity(df.schema))
    return flagged.where("sql_rule_flag").select(
        c("events.event_id").alias("event_id"),
        F.array_join("sql_rule_reasons", ", ").alias("reasons"))


COUNTED = ("LEFT JOIN (SELECT fk_dak, count(*) AS n FROM cheque_slip WHERE record_status = 'V' AND "
           "approved GROUP BY fk_dak) a ON a.fk_dak = s.fk_dak LEFT JOIN (SELECT fk_dak, count(*) AS "
           "total, count(*) FILTER (WHERE record_status IN ('P', 'V')) AS n FROM schedule3 GROUP BY "
           "fk_dak) b ON b.fk_dak = s.fk_dak")
C3 = "(s.record_status = 'V' AND NOT s.approved AND coalesce(b.total, 0) > 0)"
C4 = "(s.record_status = 'V' AND s.approved AND coalesce(a.n, 0) <> coalesce(b.n, 0))"


@query("rules_combined", over(
    "SELECT d.id, s.fk_ecs_payment_mode AS line, s.amount, x.schedule3_amount, "
    f"{C3} OR {C4} OR {R5} AS flag, concat_ws(', ', "
    f"CASE WHEN {C3} THEN '{fixed.REASON_UNAPPROVED_WITH_CHILDREN}' END, "
    f"CASE WHEN {C4} THEN '{fixed.REASON_COUNT_MISMATCH}' END, "
    f"CASE WHEN {R5} THEN '{fixed.REASON_NO_OWNER}: fk_aao, fk_ao, fk_auditor' END) AS reasons "
    "FROM dak d JOIN cheque_slip s ON s.fk_dak = d.id LEFT JOIN schedule3 x ON x.fk_dak = s.fk_dak "
    f"{COUNTED}", "dak", "cheque_slip", "schedule3"))
def rules_combined(t: Tables):
    catalog = t.catalog("dak", "cheque_slip", "schedule3")
    joined = training_join(catalog, "dak.cheque_slip.schedule3")
    rules = [r for r in R.builtin_rules(catalog, joined.schema, list(catalog))
             if not r.reason.startswith(fixed.REASON_NIGHT)]
    flagged = R.apply_rules(joined, catalog, rules)
    return flagged.select(
        c("dak.id").alias("id"), c("cheque_slip.fk_ecs_payment_mode").alias("line"),
        c("cheque_slip.amount").alias("amount"),
        c("schedule3.schedule3_amount").alias("schedule3_amount"),
        c("sql_rule_flag").alias("flag"), F.array_join("sql_rule_reasons", ", ").alias("reasons"))


@query("exclude_rule_rows", over(
    "SELECT d.id, s.fk_ecs_payment_mode AS line, s.amount FROM dak d JOIN cheque_slip s ON "
    f"s.fk_dak = d.id LEFT JOIN schedule3 x ON x.fk_dak = s.fk_dak {COUNTED} WHERE "
    f"d.list_date >= DATE '1996-01-01' AND d.list_date < DATE '1999-01-01' AND NOT ({C3} OR {C4} OR {R5})",
    "dak", "cheque_slip", "schedule3"))
def exclude_rule_rows(t: Tables):
    df = training_source(t.catalog("dak", "cheque_slip", "schedule3"), "dak.cheque_slip.schedule3",
                         TrainingOptions(from_date="1996-01-01", cutoff="1999-01-01"))
    return df.select(c("dak.id").alias("id"), c("cheque_slip.fk_ecs_payment_mode").alias("line"),
                     c("cheque_slip.amount").alias("amount"))


@query("training_count", over(
    "SELECT count(*) AS row_count FROM dak d JOIN cheque_slip s ON s.fk_dak = d.id "
    "LEFT JOIN schedule3 x ON x.fk_dak = s.fk_dak WHERE d.list_date >= DATE '1996-01-01' "
    f"AND d.list_date < DATE '1999-01-01' AND NOT {R5}", "dak", "cheque_slip", "schedule3"))
def count_for_training(t: Tables):
    return training_count(t.catalog("dak", "cheque_slip", "schedule3"), "dak.cheque_slip.schedule3",
                          TrainingOptions(from_date="1996-01-01", cutoff="1999-01-01"))


@query("split_rule_columns", over(
    "SELECT id, user_rule AS default_rule_flag, CASE WHEN user_rule THEN 'RULE::Default SQL rule' "
    "END AS default_rule_reasons FROM results", "results"))
def split_rule_columns(t: Tables):
    rows = t.results.select("id", F.when(c("user_rule"), F.lit(True)).alias("sql_rule_flag"))
    return R.split_rule_columns(rows, "sql_rule_flag", "sql_rule_reasons")
