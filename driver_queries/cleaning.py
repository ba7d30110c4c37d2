"""Cleaning, features, profiles and preprocessing."""

from pyspark.sql import functions as F

from auditlens.functions.scalars import c
from auditlens.model.io import Contract, apply_contract, to_model_frame
from auditlens.model.preprocess import fit_categories, fit_modes, fit_numeric, fit_preprocessor
from auditlens.model.preprocess import Preprocessor
from auditlens.operators import cleaning as C
from auditlens.operators import profiles as P
from auditlens.operators.cleaning import FeatureColumns, InvoiceKey
from driver_queries.base import Tables, over, query

GAPPY = ("SELECT id, amount, nullif(record_status, 'F') AS status, "
         "CASE WHEN id % 10 = 0 THEN priority END AS rarely FROM dak")


def gappy(t: Tables):
    return t.dak.select(
        "id", "amount", F.expr("nullif(record_status, 'F')").alias("status"),
        F.expr("CASE WHEN id % 10 = 0 THEN priority END").alias("rarely"))


@query("null_percent", over(
    "SELECT 'id' AS column_name, round(avg(CASE WHEN id IS NULL THEN 100.0 ELSE 0 END), 6) AS "
    "null_percent FROM g UNION ALL SELECT 'status', round(avg(CASE WHEN status IS NULL THEN 100.0 "
    "ELSE 0 END), 6) FROM g UNION ALL SELECT 'rarely', round(avg(CASE WHEN rarely IS NULL THEN "
    "100.0 ELSE 0 END), 6) FROM g", "dak", g=GAPPY))
def null_percent(t: Tables):
    return C.null_percent(gappy(t), ["id", "status", "rarely"]).withColumn(
        "null_percent", F.round("null_percent", 6))


@query("cardinality", over(
    "SELECT 'id' AS column_name, count(DISTINCT id) AS distinct_count FROM g UNION ALL "
    "SELECT 'status', count(DISTINCT status) FROM g UNION ALL "
    "SELECT 'rarely', count(DISTINCT rarely) FROM g", "dak", g=GAPPY))
def cardinality(t: Tables):
    return C.cardinality(gappy(t), ["id", "status", "rarely"])


@query("filter_columns", over(
    "SELECT amount AS dak_amount, record_status AS dak_record_status, list_date::VARCHAR AS "
    "dak_list_date FROM dak", "dak"))
def filter_columns(t: Tables):
    df = t.dak.select(
        c("id").alias("dak_id"), c("amount").alias("dak_amount"),
        c("record_status").alias("dak_record_status"), c("priority").alias("dak_priority"),
        c("list_date").alias("dak_list_date"), c("fk_vendor").alias("dak_fk_vendor"),
        F.expr("CASE WHEN id % 10 = 0 THEN amount END").alias("dak_rare"))
    kept, _ = C.filter_columns(df)
    return kept.withColumn("dak_list_date", c("dak_list_date").cast("string"))


BILLS = {"bill_invoice_no": "invoice_no", "bill_invoice_date": "invoice_date",
         "bill_record_status": "record_status", "bill_line": "line", "bill_amount": "amount",
         "bill_fk_dak": "fk_dak"}
KEY = InvoiceKey("bill_invoice_no", "bill_invoice_date", "bill_record_status")


def bills(t: Tables):
    return t.bill.select(*[c(n).alias(alias) for alias, n in BILLS.items()])


GROUPED = ("SELECT *, count(*) OVER (PARTITION BY invoice_no, invoice_date) > 1 AS member FROM bill")


@query("dup_group_members", over(
    "SELECT fk_dak AS bill_fk_dak, line AS bill_line, invoice_no AS bill_invoice_no, member FROM g",
    "bill", g=GROUPED))
def dup_group_members(t: Tables):
    return C.in_duplicate_group(bills(t), [KEY.invoice, KEY.date], "member").select(
        "bill_fk_dak", "bill_line", "bill_invoice_no", "member")


@query("drop_void_duplicates", over(
    "SELECT fk_dak AS bill_fk_dak, line AS bill_line, amount AS bill_amount FROM g "
    "WHERE NOT (member AND record_status = 'V')", "bill", g=GROUPED))
def drop_void_duplicates(t: Tables):
    return C.drop_void_duplicates(bills(t), [KEY]).select("bill_fk_dak", "bill_line", "bill_amount")


DATED = ("SELECT d.id, b.line, b.invoice_no, d.list_date AS bill_invoice_date, "
         "CASE WHEN b.line <> 3 THEN b.invoice_date END AS bill_bill_date, "
         "b.invoice_date + INTERVAL '9 days' AS bill_disposal_date "
         "FROM dak d JOIN bill b ON b.fk_dak = d.id")


def dated(t: Tables):
    return t.dak.join(t.bill.withColumnRenamed("amount", "bill_amount").drop("record_status"),
                      c("id") == c("fk_dak")).select(
        "id", "line", "invoice_no", c("list_date").alias("bill_invoice_date"),
        F.expr("CASE WHEN line <> 3 THEN invoice_date END").alias("bill_bill_date"),
        F.expr("invoice_date + INTERVAL 9 DAYS").alias("bill_disposal_date"))


def bill_pairs(df):
    """Neighbouring stages: the reference date and others are absent, so only one pair is left."""
    return C.stage_pairs(C.stage_plan(df.columns, ["bill"]))


@query("drop_bad_sequence", over(
    "SELECT id, line, invoice_no FROM g WHERE NOT coalesce(bill_bill_date < bill_invoice_date, false)",
    "dak", "bill", g=DATED))
def drop_bad_sequence(t: Tables):
    df = dated(t)
    return C.drop_bad_sequence(df, bill_pairs(df)).select("id", "line", "invoice_no")


@query("drop_night", "SELECT event_id FROM events WHERE NOT ((hour(ts) >= 21 OR hour(ts) < 6) AND "
       "CAST(ts AS TIME) <> TIME '00:00:00')")
def drop_night(t: Tables):
    return C.drop_night(t.events, C.night_columns(t.events.schema)).select("event_id")


@query("coerce_dates", "SELECT l_orderkey, l_partkey, l_linenumber, CASE WHEN l_linenumber < 6 THEN "
       "CAST(l_shipdate AS VARCHAR) END AS moment FROM lineitem")
def coerce_dates(t: Tables):
    text = F.expr("CASE WHEN l_linenumber < 6 THEN CAST(l_shipdate AS STRING) ELSE 'soon' END")
    df = t.lineitem.select("l_orderkey", "l_partkey", "l_linenumber", text.alias("moment"))
    return C.coerce_dates(df, ["moment"]).withColumn("moment", c("moment").cast("string"))


@query("gap_features", over(
    "SELECT id, line, invoice_no, (SELECT count(*) FROM generate_series(1, 1)) * CASE WHEN "
    "bill_bill_date IS NULL THEN NULL WHEN bill_invoice_date <= bill_bill_date THEN b.before - "
    "a.before ELSE b1.before - a1.before END::DOUBLE AS gap FROM g "
    "JOIN days a ON a.day = bill_invoice_date LEFT JOIN days b ON b.day = bill_bill_date "
    "JOIN days a1 ON a1.day = bill_invoice_date + INTERVAL '1 day' "
    "LEFT JOIN days b1 ON b1.day = bill_bill_date + INTERVAL '1 day'",
    "dak", "bill", g=DATED,
    days="SELECT day, coalesce(sum(CASE WHEN dayofweek(day) BETWEEN 1 AND 5 THEN 1 ELSE 0 END) "
         "OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before "
         "FROM (SELECT unnest(generate_series(TIMESTAMP '1990-01-01', TIMESTAMP '2010-12-31', "
         "INTERVAL '1 day')) AS day)").replace(
             "(SELECT count(*) FROM generate_series(1, 1)) * ", ""))
def gap_features(t: Tables):
    df = dated(t)
    dates = ["bill_invoice_date", "bill_bill_date", "bill_disposal_date"]
    wide = C.gap_features(df, bill_pairs(df), dates)
    return wide.withColumnRenamed("gap_days_bill_invoice_date_to_bill_bill_date", "gap")


@query("cleaning_summary", over(
    "SELECT 'void_duplicate' AS check_kind, 'bill_invoice_no' AS target, count(*) AS rows_checked, "
    "count(*) FILTER (WHERE member AND record_status = 'V') AS rows_invalid FROM g UNION ALL "
    "SELECT 'date_sequence', 'bill_invoice_date > bill_disposal_date', count(*), "
    "count(*) FILTER (WHERE invoice_date + INTERVAL '1 day' * (line - 4) < invoice_date) FROM g "
    "UNION ALL SELECT 'night_timestamp', 'seen', "
    "count(*) FILTER (WHERE line > 0), count(*) FILTER (WHERE line IN (1, 2, 3, 4, 5)) FROM g",
    "bill", g=GROUPED))
def cleaning_summary(t: Tables):
    df = bills(t).withColumns({
        "bill_disposal_date": F.expr("date_add(CAST(bill_invoice_date AS DATE), bill_line - 4)")
        .cast("timestamp_ntz"),
        "seen": F.expr("CAST('2024-01-01' AS TIMESTAMP_NTZ) + make_interval(0,0,0,0,bill_line)"),
    })
    return C.cleaning_summary(df, [KEY], [("bill_invoice_date", "bill_disposal_date")], ["seen"])


@query("select_features",
       "SELECT 'l_quantity' AS column_name, 'numeric' AS kind UNION ALL SELECT 'l_partkey', 'numeric' "
       "UNION ALL SELECT 'open', 'boolean' UNION ALL SELECT 'l_returnflag', "
       "CASE WHEN count(DISTINCT l_returnflag) <= 10 THEN 'categorical' ELSE 'unsupported' END "
       "FROM lineitem UNION ALL SELECT 'part', CASE WHEN count(DISTINCT l_partkey) <= 10 THEN "
       "'categorical' ELSE 'unsupported' END FROM lineitem UNION ALL SELECT 'l_shipdate', 'unsupported'")
def select_features(t: Tables):
    df = t.lineitem.select(
        "l_quantity", "l_partkey", (c("l_linestatus") == "O").alias("open"), "l_returnflag",
        c("l_partkey").cast("string").alias("part"), "l_shipdate")
    chosen = C.select_features(df)
    rows = [(n, kind) for kind in ("numeric", "boolean", "categorical", "unsupported")
            for n in getattr(chosen, kind)]
    return t.spark.createDataFrame(rows, "column_name string, kind string")


# --- profiles -----------------------------------------------------------------------------------

NUMBERS = "SELECT l_extendedprice AS price, nullif(l_discount, 0) AS discount FROM lineitem"


@query("numeric_profile", over(" UNION ALL ".join(
    f"SELECT '{n}' AS column_name, count({n}) AS value_count, min({n}) AS min_value, max({n}) AS "
    f"max_value, round(sum({n}::DECIMAL(18,2))::DOUBLE / count({n}), 6) AS mean_value, "
    f"round(quantile_cont({n}, 0.25), 6) AS p25, round(quantile_cont({n}, 0.5), 6) AS median, "
    f"round(quantile_cont({n}, 0.75), 6) AS p75 FROM g" for n in ("price", "discount")), g=NUMBERS))
def numeric_profile(t: Tables):
    df = t.lineitem.select(c("l_extendedprice").alias("price"),
                           F.expr("nullif(l_discount, 0)").alias("discount"))
    profile = P.numeric_profile(df, ["price", "discount"])
    return profile.select("column_name", "value_count", "min_value", "max_value", *[
        F.round(n, 6).alias(n) for n in ("mean_value", "p25", "median", "p75")])


@query("percentiles_large", over(
    "SELECT 'price' AS column_name, round(quantile_cont(price, 0.02), 6) AS low, "
    "round(quantile_cont(price, 0.98), 6) AS high FROM g UNION ALL SELECT 'discount', "
    "round(quantile_cont(discount, 0.02), 6), round(quantile_cont(discount, 0.98), 6) FROM g",
    g=NUMBERS))
def percentiles_large(t: Tables):
    """The path for columns beyond one buffer, on a small buffer."""
    from auditlens.operators.ordering import exact_percentiles

    df = t.lineitem.select(c("l_extendedprice").alias("price"),
                           F.expr("nullif(l_discount, 0)").alias("discount"))
    found = exact_percentiles(df, ["price", "discount"], [0.02, 0.98], buffer_rows=4_000)
    return t.spark.createDataFrame([(n, round(v[0], 6), round(v[1], 6)) for n, v in found.items()],
                                   "column_name string, low double, high double")


@query("category_profile",
       "SELECT column_name, category, n AS match_count, total AS total_count, round(n / total, 6) AS "
       "match_ratio FROM (SELECT 'flag' AS column_name, lower(l_returnflag) AS category, count(*) AS n "
       "FROM lineitem GROUP BY 2 UNION ALL SELECT 'status', lower(l_linestatus), count(*) FROM lineitem "
       "WHERE l_linenumber <> 2 GROUP BY 2), (SELECT count(*) AS total FROM lineitem)")
def category_profile(t: Tables):
    df = t.lineitem.select(
        F.concat(F.lit(" "), c("l_returnflag")).alias("flag"),
        F.expr("CASE WHEN l_linenumber <> 2 THEN l_linestatus END").alias("status"))
    return P.category_profile(df, ["flag", "status"]).withColumn(
        "match_ratio", F.round("match_ratio", 6))


@query("boolean_profile",
       "SELECT 'open' AS column_name, count(*) AS total_count, count(*) FILTER (WHERE l_linestatus = 'O' "
       "AND l_linenumber <> 2) AS true_count, count(*) FILTER (WHERE NOT (l_linestatus = 'O' AND "
       "l_linenumber <> 2)) AS false_count, round(avg(CASE WHEN l_linestatus = 'O' AND l_linenumber "
       "<> 2 THEN 1.0 ELSE 0 END), 6) AS true_ratio FROM lineitem")
def boolean_profile(t: Tables):
    df = t.lineitem.select(
        F.expr("CASE WHEN l_linenumber <> 2 THEN l_linestatus = 'O' END").alias("open"))
    return P.boolean_profile(df, ["open"]).select(
        "column_name", "total_count", "true_count", "false_count",
        F.round("true_ratio", 6).alias("true_ratio"))


@query("missing_profile", over(
    "SELECT 'status' AS column_name, count(*) AS total_count, count(status) AS present_count, "
    "count(*) - count(status) AS missing_count, round(count(status) / count(*), 6) AS present_ratio, "
    "round((count(*) - count(status)) / count(*), 6) AS missing_ratio FROM g", "dak", g=GAPPY))
def missing_profile(t: Tables):
    return P.missing_profile(gappy(t), ["status"]).withColumns({
        n: F.round(n, 6) for n in ("present_ratio", "missing_ratio")})


@query("is_binary",
       "SELECT 'open' AS column_name, true AS is_binary UNION ALL SELECT 'zero_one', "
       "count(DISTINCT l_linenumber % 2) <= 2 FROM lineitem UNION ALL SELECT 'word', "
       "count(DISTINCT CASE WHEN l_linenumber > 3 THEN 'Yes' ELSE 'no' END) <= 2 FROM lineitem "
       "UNION ALL SELECT 'line', false UNION ALL SELECT 'mixed', false UNION ALL "
       "SELECT 'empty', false")
def is_binary(t: Tables):
    df = t.lineitem.selectExpr(
        "l_linestatus = 'O' AS open", "CAST(l_linenumber % 2 AS DOUBLE) AS zero_one",
        "CASE WHEN l_linenumber > 3 THEN 'Yes' ELSE 'no' END AS word", "l_linenumber AS line",
        "CASE WHEN l_linenumber > 3 THEN 'yes' WHEN l_linenumber > 1 THEN 'true' ELSE '0' END AS mixed",
        "CAST(NULL AS STRING) AS empty")
    return P.is_binary(df, df.columns)


# --- preprocessing ------------------------------------------------------------------------------


@query("impute_scale", over(
    "SELECT l_orderkey, l_partkey, l_linenumber, round((coalesce(discount, m.median) - m.median) / "
    "CASE WHEN s.width = 0 THEN 1 ELSE s.width END, 6) AS scaled FROM g, m, s",
    g="SELECT *, CASE WHEN l_linenumber <> 3 THEN l_discount END AS discount FROM lineitem",
    m="SELECT quantile_cont(discount, 0.5) AS median FROM g",
    s="SELECT quantile_cont(coalesce(discount, median), 0.75) - "
      "quantile_cont(coalesce(discount, median), 0.25) AS width FROM g, m"))
def impute_scale(t: Tables):
    df = t.lineitem.withColumn("discount", F.expr("CASE WHEN l_linenumber <> 3 THEN l_discount END"))
    steps = Preprocessor(numeric=fit_numeric(df, ["discount"]))
    return df.select("l_orderkey", "l_partkey", "l_linenumber",
                     F.round(steps.columns()[0], 6).alias("scaled"))


@query("mode_impute", over(
    "SELECT l_orderkey, l_linenumber, l_partkey, coalesce(status, m.value) AS status FROM g, m",
    g="SELECT *, CASE WHEN l_linenumber <> 2 THEN l_linestatus END AS status FROM lineitem",
    m="SELECT status AS value FROM g WHERE status IS NOT NULL GROUP BY status "
      "ORDER BY count(*) DESC, status LIMIT 1"))
def mode_impute(t: Tables):
    df = t.lineitem.withColumn("status", F.expr("CASE WHEN l_linenumber <> 2 THEN l_linestatus END"))
    modes = fit_modes(df, ["status"])
    return df.select("l_orderkey", "l_linenumber", "l_partkey",
                     F.coalesce("status", F.lit(modes["status"])).alias("status"))


@query("onehot", "SELECT l_orderkey, l_partkey, l_linenumber, "
       "CASE WHEN l_returnflag = 'A' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS l_returnflag_A, "
       "CASE WHEN l_returnflag = 'N' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS l_returnflag_N FROM lineitem")
def onehot(t: Tables):
    """Fitted without one of the values, which therefore encodes as all zero."""
    steps = Preprocessor(categorical=fit_categories(
        t.lineitem.where("l_returnflag <> 'R'"), ["l_returnflag"]))
    names = [f.name for f in steps.features()]
    return t.lineitem.select("l_orderkey", "l_partkey", "l_linenumber", *[
        col.alias(n) for n, col in zip(names, steps.columns())])


CONTRACT = Contract(
    raw_columns=["bill_invoice_no", "bill_invoice_date", "bill_disposal_date", "bill_amount",
                 "bill_extra", "bill_approved"],
    cleaned_columns=["bill_invoice_date", "bill_disposal_date", "bill_amount", "bill_extra",
                     "bill_approved"],
    date_columns=["bill_invoice_date", "bill_disposal_date"],
    invoice_keys=[KEY], stage_pairs=[("bill_invoice_date", "bill_disposal_date")],
    boolean_columns=["bill_approved"],
    feature_columns=["gap_days_bill_invoice_date_to_bill_disposal_date", "bill_amount", "bill_extra",
                     "bill_approved"])


@query("apply_contract", over(
    "SELECT d.id, b.line, b.amount AS bill_amount, NULL AS bill_extra, CASE WHEN b.record_status = "
    "'V' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS bill_approved FROM dak d JOIN bill b ON b.fk_dak = d.id "
    "WHERE NOT b.invoice_date < d.list_date", "dak", "bill"))
def contract(t: Tables):
    joined = t.dak.select("id", "list_date").join(t.bill, c("id") == c("fk_dak")).select(
        "id", "line", c("invoice_no").alias("bill.invoice_no"),
        c("list_date").cast("string").alias("bill.invoice_date"),
        c("invoice_date").cast("string").alias("bill.disposal_date"),
        c("amount").alias("bill.amount"),
        F.when(c("record_status") == "V", "Yes").otherwise("n").alias("bill.approved"))
    frame = to_model_frame(joined, CONTRACT, ["id", "line"])
    ready = apply_contract(frame, CONTRACT, ["id", "line"])
    return ready.drop(CONTRACT.feature_columns[0])


@query("model_features", over(
    "SELECT 'l_quantity' AS name, round(avg((l_quantity - m) / w), 4) AS average FROM lineitem, "
    "(SELECT quantile_cont(l_quantity, 0.5) AS m, quantile_cont(l_quantity, 0.75) - "
    "quantile_cont(l_quantity, 0.25) AS w FROM lineitem) UNION ALL SELECT 'open', round(avg(CASE "
    "l_linestatus WHEN 'O' THEN 1.0 ELSE 0 END), 4) FROM lineitem UNION ALL SELECT concat("
    "'l_returnflag_', f), round(count(*) / (SELECT count(*) FROM lineitem), 4) FROM (SELECT "
    "l_returnflag AS f FROM lineitem) GROUP BY f"))
def model_features(t: Tables):
    df = t.lineitem.select("l_quantity", "l_returnflag",
                           F.expr("CASE l_linestatus WHEN 'O' THEN 1.0D ELSE 0.0D END").alias("open"))
    steps = fit_preprocessor(df, FeatureColumns(["l_quantity"], ["open"], ["l_returnflag"], []))
    pairs = F.array(*[F.struct(F.lit(f.name).alias("name"), col.alias("value"))
                      for f, col in zip(steps.features(), steps.columns())])
    long = df.select(F.explode(pairs).alias("p")).select("p.*")
    return long.groupBy("name").agg(F.round(F.avg("value"), 4).alias("average"))
