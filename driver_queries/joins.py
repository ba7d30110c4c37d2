"""Joins, key tests, counts and diagnostics."""

from pyspark.sql import functions as F

from auditlens.functions.scalars import c
from auditlens.operators import joins as J
from auditlens.operators.joins import JoinStep
from auditlens.operators.ordering import page
from auditlens.operators.rules import DuplicateKeys, approved_counts, duplicate_keys, status_counts
from auditlens.operators.summaries import next_run_id, row_count
from auditlens.sources.results import evolve
from driver_queries.base import Tables, over, query

DAK_BILL = [JoinStep("dak", "id", "bill", "fk_dak")]


def _pick(df, **columns):
    return df.select(*[c(full).alias(name) for name, full in columns.items()])


@query("join_inner", over(
    "SELECT d.id AS dak_id, d.amount AS dak_amount, b.invoice_no, b.amount AS bill_amount, "
    "CAST(b.invoice_date AS VARCHAR) AS invoice_date FROM dak d JOIN bill b ON d.id = b.fk_dak",
    "dak", "bill"))
def join_inner(t: Tables):
    df = J.join_tables(t.catalog("dak", "bill"), ["dak", "bill"], DAK_BILL, datetimes_as_text=True)
    return _pick(df, dak_id="dak.id", dak_amount="dak.amount", invoice_no="bill.invoice_no",
                 bill_amount="bill.amount", invoice_date="bill.invoice_date")


@query("join_left", over(
    "SELECT d.id AS dak_id, s.record_status AS status, s.schedule3_amount AS amount "
    "FROM dak d LEFT JOIN schedule3 s ON d.id = s.fk_dak", "dak", "schedule3"))
def join_left(t: Tables):
    df = J.join_tables(t.catalog("dak", "schedule3"), ["dak", "schedule3"],
                       [JoinStep("dak", "id", "schedule3", "fk_dak", "left")])
    return _pick(df, dak_id="dak.id", status="schedule3.record_status",
                 amount="schedule3.schedule3_amount")


@query("join_right", over(
    "SELECT o.id AS order_id, s.fk_dak, s.schedule3_amount AS amount "
    "FROM open_orders o RIGHT JOIN schedule3 s ON o.id = s.fk_dak", "open_orders", "schedule3"))
def join_right(t: Tables):
    df = J.join_tables(t.catalog("open_orders", "schedule3"), ["open_orders", "schedule3"],
                       [JoinStep("open_orders", "id", "schedule3", "fk_dak", "right outer")])
    return _pick(df, order_id="open_orders.id", fk_dak="schedule3.fk_dak",
                 amount="schedule3.schedule3_amount")


@query("join_full", over(
    "SELECT o.id AS order_id, o.amount AS order_amount, s.fk_dak, s.schedule3_amount AS amount "
    "FROM open_orders o FULL JOIN schedule3 s ON o.id = s.fk_dak", "open_orders", "schedule3"))
def join_full(t: Tables):
    df = J.join_tables(t.catalog("open_orders", "schedule3"), ["open_orders", "schedule3"],
                       [JoinStep("open_orders", "id", "schedule3", "fk_dak", "full")])
    return _pick(df, order_id="open_orders.id", order_amount="open_orders.amount",
                 fk_dak="schedule3.fk_dak", amount="schedule3.schedule3_amount")


@query("join_chain3", over(
    "SELECT d.id AS dak_id, s.approved, s.amount AS slip_amount, x.record_status AS child_status, "
    "x.schedule3_amount AS child_amount FROM dak d JOIN cheque_slip s ON d.id = s.fk_dak "
    "LEFT JOIN schedule3 x ON s.fk_dak = x.fk_dak", "dak", "cheque_slip", "schedule3"))
def join_chain3(t: Tables):
    df = J.training_join(t.catalog("dak", "cheque_slip", "schedule3"), "dak.cheque_slip.schedule3")
    return _pick(df, dak_id="dak.id", approved="cheque_slip.approved",
                 slip_amount="cheque_slip.amount", child_status="schedule3.record_status",
                 child_amount="schedule3.schedule3_amount")


@query("table_counts", "SELECT 'customer' AS table_name, count(*) AS row_count FROM customer "
       "UNION ALL SELECT 'orders', count(*) FROM orders "
       "UNION ALL SELECT 'lineitem', count(*) FROM lineitem")
def table_counts(t: Tables):
    parts = [row_count(getattr(t, n)).select(F.lit(n).alias("table_name"), "row_count")
             for n in ("customer", "orders", "lineitem")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("next_run_id", over(
    "SELECT CAST(coalesce(max(ml_run_id), 0) + 1 AS BIGINT) AS next_run_id FROM results",
    "results"))
def next_run(t: Tables):
    return next_run_id(t.results)


@query("evolve_schema", "SELECT o_orderkey, 'COMPLETED' AS status, CAST(0 AS BIGINT) AS total_rows, "
       "o_totalprice FROM orders")
def evolve_schema(t: Tables):
    old = t.orders.select("o_orderkey", "o_totalprice")
    return evolve(old, {"o_totalprice": ("double", None), "status": ("string", "COMPLETED"),
                        "total_rows": ("bigint", 0)})


@query("anti_rule", over(
    "SELECT payment_reference_no FROM cmp_scroll c WHERE payment_reference_no IS NOT NULL "
    "AND cda_name = 'CDA- Main Office Jabalpur' AND NOT EXISTS "
    "(SELECT 1 FROM lineitem l WHERE l.l_orderkey = c.payment_reference_no)", "cmp_scroll"))
def anti_rule(t: Tables):
    scope = F.col("cda_name") == "CDA- Main Office Jabalpur"
    return J.missing_in(t.cmp_scroll, "payment_reference_no", t.lineitem, "l_orderkey",
                        scope).select("payment_reference_no")


@query("semi_rule", over(
    "SELECT s.fk_dak, s.record_status, s.amount FROM cheque_slip s WHERE fk_ecs_payment_mode = 1 "
    "AND fk_dak IS NOT NULL AND EXISTS (SELECT 1 FROM ecs e WHERE e.fk_dak = s.fk_dak)",
    "cheque_slip", "ecs"))
def semi_rule(t: Tables):
    return J.exists_in(t.cheque_slip, "fk_dak", t.ecs, "fk_dak",
                       F.col("fk_ecs_payment_mode") == 1).select("fk_dak", "record_status", "amount")


@query("status_counts", over(
    "SELECT fk_dak, count(*) AS total_count, count(*) FILTER (WHERE upper(trim(record_status)) "
    "IN ('P', 'V')) AS status_count FROM schedule3 WHERE fk_dak IS NOT NULL GROUP BY fk_dak",
    "schedule3"))
def status_count(t: Tables):
    return status_counts(t.schedule3, "fk_dak", "record_status", ["P", "V"])


@query("approved_counts", over(
    "SELECT fk_dak, count(*) FILTER (WHERE record_status = 'V' AND approved) AS approved_count "
    "FROM cheque_slip WHERE fk_dak IS NOT NULL GROUP BY fk_dak", "cheque_slip"))
def approved_count(t: Tables):
    return approved_counts(t.cheque_slip, "fk_dak", "record_status", "approved")


@query("preagg_left", over(
    "SELECT d.id, coalesce(a.total_count, 0) AS total_count, "
    "coalesce(b.approved_count, 0) AS approved_count FROM dak d LEFT JOIN "
    "(SELECT fk_dak, count(*) AS total_count FROM schedule3 GROUP BY fk_dak) a ON a.fk_dak = d.id "
    "LEFT JOIN (SELECT fk_dak, count(*) FILTER (WHERE record_status = 'V' AND approved) "
    "AS approved_count FROM cheque_slip GROUP BY fk_dak) b ON b.fk_dak = d.id",
    "dak", "schedule3", "cheque_slip"))
def preagg_left(t: Tables):
    from auditlens.operators.rules import KeyCount, key_counts, status

    signed = (status(F.col("record_status")) == "V") & F.col("approved")
    children = KeyCount("id", "schedule3", "fk_dak")
    approved = KeyCount("id", "cheque_slip", "fk_dak", "approved", signed)
    facts = key_counts(t.catalog("schedule3", "cheque_slip"), [children, approved])
    return t.dak.join(facts, F.col("id") == F.col("__key"), "left").select(
        "id", children.value().cast("long").alias("total_count"),
        approved.value().cast("long").alias("approved_count"))


DUPLICATES = ("SELECT invoice_no AS invoice_key, CAST(invoice_date AS DATE) AS invoice_date_key, "
              "count(*) AS duplicate_count, count(DISTINCT fk_dak) AS related_key_count, "
              "string_agg(DISTINCT CAST(fk_dak AS VARCHAR), ', ' ORDER BY CAST(fk_dak AS VARCHAR)) "
              "AS related FROM bill WHERE record_status = 'V' GROUP BY 1, 2 HAVING count(*) >= 2")
BILL_KEYS = DuplicateKeys("bill", "invoice_no")


@query("duplicate_keys", over(
    "SELECT invoice_key, CAST(invoice_date_key AS VARCHAR) AS invoice_date_key, duplicate_count, "
    "related_key_count FROM g", "bill", g=DUPLICATES))
def duplicate_key_groups(t: Tables):
    return duplicate_keys(t.bill, BILL_KEYS).withColumn(
        "invoice_date_key", F.col("invoice_date_key").cast("string"))


@query("related_keys", "SELECT DISTINCT 'bill' AS \"table\", CAST(l_suppkey % 3 AS VARCHAR) AS invoice_number, "
       "'1997-01-01' AS invoice_date, CAST(l_orderkey AS VARCHAR) AS related_key FROM lineitem "
       "WHERE l_linestatus = 'F'")
def related_keys_of_large_groups(t: Tables):
    """Three invoices with a third of all rows each: every related key, one row each."""
    from auditlens.operators.rules import related_keys

    rows = t.lineitem.select(
        c("l_orderkey").alias("fk_dak"), (c("l_suppkey") % 3).alias("invoice_no"),
        F.lit("1997-01-01").alias("invoice_date"),
        F.when(c("l_linestatus") == "F", "V").otherwise("P").alias("record_status"))
    return related_keys(rows, BILL_KEYS)


@query("listagg_keys", over(
    "SELECT invoice_key, CAST(invoice_date_key AS VARCHAR) AS invoice_date_key, related FROM g",
    "bill", g=DUPLICATES))
def listagg_keys(t: Tables):
    from auditlens.operators.rules import related_key_pages

    return related_key_pages(t.bill, BILL_KEYS).select(
        "invoice_key", F.col("invoice_date_key").cast("string").alias("invoice_date_key"),
        F.array_join("related_keys", ", ").alias("related"))


@query("dup_key_left", over(
    "SELECT b.fk_dak, b.line, coalesce(g.duplicate_count, 0) AS duplicate_count FROM bill b "
    "LEFT JOIN g ON g.invoice_key = b.invoice_no "
    "AND g.invoice_date_key = CAST(b.invoice_date AS DATE)", "bill", g=DUPLICATES))
def dup_key_left(t: Tables):
    groups = duplicate_keys(t.bill, BILL_KEYS)
    bill = t.bill.withColumns({"invoice_key": F.col("invoice_no"),
                               "invoice_date_key": F.col("invoice_date").cast("date")})
    return bill.join(groups, ["invoice_key", "invoice_date_key"], "left").select(
        "fk_dak", "line", F.coalesce("duplicate_count", F.lit(0)).alias("duplicate_count"))


COMMON = ("SELECT DISTINCT s.fk_dak AS join_key FROM schedule3 s JOIN open_orders o "
          "ON o.id = s.fk_dak")


@query("common_key_count", over("SELECT count(*) AS common_key_count FROM k",
                                "schedule3", "open_orders", k=COMMON))
def common_key_count(t: Tables):
    return J.common_key_count(t.schedule3, "fk_dak", t.open_orders, "id")


@query("common_key_sample", over("SELECT join_key FROM k ORDER BY join_key LIMIT 20",
                                 "schedule3", "open_orders", k=COMMON))
def common_key_sample(t: Tables):
    return J.common_key_sample(t.schedule3, "fk_dak", t.open_orders, "id", 20)


@query("column_sample", over("SELECT id FROM open_orders WHERE id IS NOT NULL ORDER BY id LIMIT 10",
                             "open_orders"))
def column_sample(t: Tables):
    return J.column_sample(t.open_orders, "id")


@query("join_diagnostics", over(
    "SELECT 1 AS step, 'dak.id' AS left_key, 'bill.fk_dak' AS right_key, 'full' AS mode, "
    "(SELECT count(*) FROM dak) AS left_rows, (SELECT count(*) FROM bill) AS right_rows, "
    "(SELECT count(*) FROM (SELECT DISTINCT id FROM dak INTERSECT SELECT fk_dak FROM bill)) "
    "AS common_key_count", "dak", "bill"))
def join_diagnostics(t: Tables):
    return J.join_diagnostics(t.catalog("dak", "bill"), ["dak", "bill"], DAK_BILL, full=True).select(
        "step", "left_key", "right_key", "mode", "left_rows", "right_rows", "common_key_count")


@query("deep_page", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey "
       "LIMIT 500 OFFSET 12000")
def deep_page(t: Tables):
    return page(t.orders.select("o_orderkey", "o_totalprice"), "o_orderkey", limit=500,
                offset=12_000, sorted_rows=10_000, buffer_rows=5_000)




FAMILY = ("CASE WHEN column_type IN ('DATE', 'TIMESTAMP') THEN 'datetime' WHEN column_type = 'BOOLEAN' THEN 'boolean' "
          "WHEN column_type = 'VARCHAR' THEN 'text' ELSE 'numeric' END")


@query("merged_schema", " UNION ALL ".join(
    f"SELECT '{n}' AS source_table, column_name, concat('{n}_', column_name) AS model_column, {FAMILY} AS family "
    f"FROM (DESCRIBE SELECT * FROM {n})" for n in ("orders", "lineitem", "events")))
def merged_schema_of_tables(t: Tables):
    from auditlens.sources.catalog import Catalog, merged_schema

    names = ["orders", "lineitem", "events"]
    return merged_schema(Catalog({n: getattr(t, n) for n in names}), names)


@query("csv_source", "SELECT o_orderkey, o_orderstatus, o_totalprice, CAST(o_orderdate AS DATE) AS o_orderdate, o_orderpriority FROM orders")
def csv_source(t: Tables):
    """All orders through CSV files with a header and an export column, read with a schema."""
    import uuid

    from auditlens.sources.catalog import read_csv_source
    from auditlens.sources.staging import staging_root

    path = f"{staging_root(t.spark)}/orders-{uuid.uuid4().hex}"
    kept = t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice", c("o_orderdate").cast("date").alias("o_orderdate"), "o_orderpriority")
    rows = kept.select(F.lit("SET").alias("SET"), "*")
    rows.write.option("header", True).csv(path)
    return read_csv_source(t.spark, path, rows.schema)
