import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditlens import fixed
from auditlens.functions.scalars import c
from auditlens.operators import cleaning as C
from auditlens.operators import joins as J
from auditlens.operators import ordering as O
from auditlens.operators import rules as R
from auditlens.operators import signals as G
from auditlens.operators.enrich import rebuild_payload
from auditlens.operators.filters import date_window, report_filter, training_window
from auditlens.operators.joins import JoinStep
from auditlens.operators.projection import drop_sparse, qualify, to_joined_name, to_model_name
from auditlens.operators.report import approvers, reason_stats
from auditlens.operators.summaries import amount_total
from auditlens.operators.user_rules import UserRule, apply_user_rules
from auditlens.plans.request import RunRequest
from auditlens.sources.catalog import Catalog, merged_schema, read_csv_source


# --- order statistics ---------------------------------------------------------------------------


@pytest.mark.parametrize("shape", ["normal", "hot", "few", "tiny"])
def test_percentiles_match_numpy_beyond_the_buffer(spark, shape):
    rng = np.random.default_rng(3)
    data = {
        "normal": rng.normal(size=20_000),
        "hot": np.where(rng.random(20_000) < 0.4, 5.0, rng.normal(5, 2, 20_000)),
        "few": rng.integers(0, 3, 20_000).astype(float),
        "tiny": np.array([4.0, 1.0]),
    }[shape]
    df = spark.createDataFrame([(float(v), None) for v in data] + [(None, None)], "x double, e double")
    probabilities = [0.0, 0.02, 0.25, 0.5, 0.75, 0.98, 1.0]
    got = O.exact_percentiles(df, ["x", "e"], probabilities, buffer_rows=500)
    assert np.allclose(got["x"], np.quantile(data, probabilities))
    assert got["e"] == [None] * len(probabilities)


@pytest.mark.parametrize("shape", ["far", "whole", "infinite"])
def test_percentiles_are_found_by_counting_buckets(spark, monkeypatch, shape):
    """Without sketches, also beside far values; infinite ones leave the buckets to sketches."""
    rng = np.random.default_rng(4)
    data = {
        "far": np.concatenate([rng.lognormal(3, 4, 6000), [-1e300, 1e300, 1e-300, 0.0, -0.0]]),
        "whole": rng.integers(10**15, 10**15 + 10**7, 6000).astype(float),
        "infinite": np.concatenate([rng.normal(size=3000), [np.inf] * 900, [-np.inf] * 900]),
    }[shape]
    df = spark.createDataFrame([(float(v), float(-v)) for v in data], "x double, y double")
    if shape != "infinite":
        monkeypatch.setattr(O, "_brackets", lambda group: pytest.fail("a sketch was used"))
    probabilities = [0.1, 0.4, 0.5, 0.98] if shape != "infinite" else [0.3, 0.5, 0.7]
    got = O.exact_percentiles(df, ["x", "y"], probabilities, buffer_rows=300)
    for name, values in (("x", data), ("y", -data)):
        assert np.allclose(got[name], np.quantile(values, probabilities), rtol=1e-12)


def test_few_valued_columns_are_counted_without_sketches(spark, monkeypatch):
    """Exactly at the limit, with NULLs, and without shuffling the values of a column of many."""
    df = spark.range(0, 4000, 1, 4).select(
        (c("id") % 10).cast("string").alias("ten"), (c("id") % 11).cast("string").alias("eleven"),
        c("id").cast("string").alias("many"), F.lit(None).cast("string").alias("none"),
        F.when(c("id") % 3 > 0, (c("id") % 7).cast("string")).alias("gaps"))
    counted, cardinality = [], C.cardinality
    monkeypatch.setattr(C, "cardinality", lambda df, names: counted.append(df.count()) or cardinality(df, names))
    monkeypatch.setattr(C.F, "approx_count_distinct", lambda *a: pytest.fail("a sketch was used"))
    assert C.few_valued(df, df.columns, 10) == ["ten", "none", "gaps"]
    assert max(counted) < 4000 and C.few_valued(df, df.columns, 11) == ["ten", "eleven", "none", "gaps"]


def test_hash_joins_end_with_their_scope(spark):
    from auditlens.session import HASHED_PARTITION, hash_joins

    names = ["spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", "spark.sql.adaptive.advisoryPartitionSizeInBytes"]
    before = [spark.conf.get(n) for n in names]
    with pytest.raises(ValueError), hash_joins(spark):
        assert [spark.conf.get(n) for n in names] == [HASHED_PARTITION] * 2
        raise ValueError
    assert [spark.conf.get(n) for n in names] == before


def test_first_rows_turns_the_cut_into_a_filter(spark):
    rng = np.random.default_rng(5)
    rows = [(int(d) if d < 20 else None, i) for i, d in enumerate(rng.integers(0, 25, 3000))]
    df = spark.createDataFrame(rows, "d int, id int")
    ordered = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    for n in (1, 150, 1500, 2900, 3000, 9999):
        got = O.first_rows(df, ["d", "id"], n, sorted_rows=0, buffer_rows=200)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(ordered[:n], key=str)
    tied = O.first_rows(df.select("d"), ["d"], 150, sorted_rows=0, buffer_rows=200)
    assert sorted(r[0] for r in tied.collect()) == [d for d, _ in ordered[:150]]


@pytest.mark.parametrize("descending", [False, True])
def test_far_pages_equal_sorted_pages(spark, descending):
    df = spark.range(0, 5000, 3)
    want = sorted((r[0] for r in df.collect()), reverse=descending)
    for offset in (0, 700, 1660, 99_999):
        got = O.page(df, "id", limit=10, offset=offset, descending=descending, sorted_rows=50,
                     buffer_rows=100)
        assert [r[0] for r in got.collect()] == want[offset:offset + 10]


@pytest.mark.parametrize("descending", [False, True])
def test_large_pages_are_not_gathered_in_one_task(spark, descending):
    df = spark.range(0, 3000, 1, 4).select((c("id") * 7 % 3001).alias("id"), F.lit("x").alias("t"))
    want = sorted((r[0] for r in df.collect()), reverse=descending)
    for offset, limit in ((0, 5000), (0, 400), (900, 1200), (2900, 700), (4000, 300)):
        got = O.page(df, "id", limit=limit, offset=offset, descending=descending, sorted_rows=50, buffer_rows=100)
        assert [r[0] for r in got.collect()] == want[offset:offset + limit]
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "Limit" not in plan and "Offset" not in plan
    equal = df.select(F.lit(1).alias("id"))
    assert O.page(equal, "id", limit=700, offset=200, sorted_rows=50, buffer_rows=100).count() == 700


def test_duplicate_groups_are_joined_without_a_sort(spark):
    """Rows that are looked up in unique groups are not sorted for it."""
    rows = spark.range(0, 400).select(
        (c("id") % 150).alias("b_invoice_no"), F.lit("2024-01-01").cast("date").alias("b_invoice_date"),
        F.when(c("id") % 2 == 0, " V\n").otherwise("P").alias("b_record_status"), "id")
    kept = C.drop_void_duplicates(rows, C.invoice_keys(rows.columns, ["b"]))
    assert sorted(r["id"] for r in kept.collect()) == [i for i in range(400) if i % 2]
    bill = rows.select(c("b_invoice_no").alias("invoice_no"), c("b_invoice_date").alias("invoice_date"),
                       F.trim(F.lit("v")).alias("record_status"), c("id").alias("fk_dak"))
    keys = R.DuplicateKeys("bill", "invoice_no")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        wide = R.with_rule_inputs(qualify(bill, "bill"), Catalog({"bill": bill}), [R.Rule("", F.lit(True), duplicates=keys)])
        for df in (kept, wide.select("`bill.fk_dak`", F.col(keys.name)["duplicate_count"])):
            plan = df._jdf.queryExecution().sparkPlan().toString()
            assert re.search(r"\w+Join\b", plan).group() == "ShuffledHashJoin"
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_related_keys_of_wanted_invoices(spark):
    bill = spark.createDataFrame(
        [("A", 1), ("A", 2), ("A", 2), ("B", 3), ("B", 4), ("C", 5), ("D", None), ("D", 6)], "invoice_no string, fk_dak int")
    bill = bill.withColumns({"invoice_date": F.lit("2024-01-01").cast("date"), "record_status": F.lit(" v")})
    keys = R.DuplicateKeys("bill", "invoice_no")
    every = {(r["invoice_number"], r["related_key"]) for r in R.related_keys(bill, keys).collect()}
    assert every == {("A", "1"), ("A", "2"), ("B", "3"), ("B", "4"), ("D", "6")}
    wanted = spark.createDataFrame([("A", "2024-01-01"), ("C", "2024-01-01"), ("B", "2024-01-02")],
                                   "invoice_number string, invoice_date string")
    some = R.related_keys(bill, keys, wanted).collect()
    assert sorted((r["table"], r["invoice_number"], r["related_key"]) for r in some) == [("bill", "A", "1"), ("bill", "A", "2")]


@pytest.mark.parametrize("descending", [False, True])
def test_pages_and_first_rows_are_the_same_on_both_sides_of_the_size_limit(spark, descending):
    rows = [(i // 3 if i < 300 else None, f"t{i % 50}", {"a": i % 70}) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, t string, m map<string,int>").repartition(3)
    sides = (dict(sorted_rows=10_000), dict(sorted_rows=0, buffer_rows=40))
    seen = []
    for offset in range(0, 440, 55):
        near, far = (O.page(df, "id", limit=55, offset=offset, descending=descending, **s).collect() for s in sides)
        assert near == far and len(near) == max(0, min(55, 400 - offset))
        seen += [(r["id"], r["t"], r["m"]) for r in far]
    assert sorted(map(str, seen)) == sorted(map(str, rows))
    if not descending:
        for n in (1, 100, 301, 350, 400, 500):
            near, far = (O.first_rows(df, ["id"], n, **s).collect() for s in sides)
            assert near == far and len(far) == min(n, 400)


# --- joins --------------------------------------------------------------------------------------


def catalog(spark):
    return Catalog({
        "dak": spark.createDataFrame([(1, "2026-01-05"), (2, None)], "id int, list_date string"),
        "bill": spark.createDataFrame([(1, "A"), (1, "B"), (None, "C")], "fk_dak int, no string"),
    })


def test_full_join_equals_sparks(spark):
    left = qualify(spark.createDataFrame([(1,), (2,), (2,), (None,)], "k int"), "l")
    right = qualify(spark.createDataFrame([(2,), (2,), (3,), (None,)], "k int"), "r")
    got = J.full_join(left, right, "l.k", "r.k")
    want = left.join(right, c("l.k") == c("r.k"), "full")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_hot_key_joins_stay_whole(spark):
    hot = spark.range(3000).select((F.col("id") * 0).alias("k"), "id")
    small = spark.createDataFrame([(0, "x"), (1, "y")], "k long, v string")
    full = J.full_join(qualify(hot, "h"), qualify(small, "s"), "h.k", "s.k")
    assert full.count() == 3001
    marked = C.in_duplicate_group(hot, ["k"], "member")
    assert marked.where("member").count() == 3000


@pytest.mark.parametrize("joins, message", [
    ([], "at least 1 join"),
    ([JoinStep("dak", "id", "dak", "id")], "self-joins"),
    ([JoinStep("bill", "fk_dak", "dak", "id")], "not joined yet"),
    ([JoinStep("dak", "id", "bill", "nope")], "column not found"),
    ([JoinStep("dak", "id", "bill", "fk_dak", "cross")], "Unsupported join type"),
    ([JoinStep("dak", "id", "ecs", "fk_dak")], "not selected"),
    ([JoinStep("dak", "id", "bill", "fk_dak")] * 2, "already joined"),
])
def test_bad_joins_are_refused(spark, joins, message):
    with pytest.raises(ValueError, match=message):
        J.join_tables(catalog(spark), ["dak", "bill"], joins)


def test_presets():
    assert J.resolve_dataset(["bill"]) == J.resolve_dataset(["bill", "dak"]) == "dak.bill"
    assert J.resolve_dataset(["schedule3", "cheque_slip"]) == "dak.cheque_slip.schedule3"
    assert J.preset_joins("dak.cheque_slip.schedule3")[1].join_type == "left"
    for bad in (["bill", "civ_paybill"], ["dak", "dak_info"]):
        with pytest.raises(ValueError):
            J.resolve_dataset(bad)
    request, warnings = RunRequest(["bill"], joins=[JoinStep("a", "b", "c", "d")]).with_dataset_defaults()
    assert request.tables == ["dak", "bill"] and request.amount_field == "dak.amount" and warnings
    with pytest.raises(ValueError):
        RunRequest([])


def test_model_names_round_trip():
    assert to_model_name("cheque_slip.fk_dak") == "cheque_slip_fk_dak"
    assert to_joined_name("cheque_slip_fk_dak") == "cheque_slip.fk_dak"
    assert to_joined_name("dak_info_amount") == "dak_info.amount"
    assert to_joined_name("other_amount") == "other.amount"
    assert to_joined_name("plain") == "plain"


# --- filters ------------------------------------------------------------------------------------


def test_date_window_choice_and_limits(spark):
    df = spark.createDataFrame(
        [("2026-01-31 23:59:59", "2020-01-01"), ("2026-02-01 00:00:00", "2026-01-10"), (None, None)],
        "`bill.list_date` string, `dak.created_at` string")
    df = df.withColumn("bill.list_date", c("bill.list_date").cast("timestamp_ntz"))
    kept = date_window(df, "2026-01-01", "2026-01-31", tables=["dak", "bill"])
    assert [str(r[0]) for r in kept.collect()] == ["2026-01-31 23:59:59"]
    assert date_window(df, "2026-02-01", "2026-01-01") is df
    assert date_window(df, None, "soon") is df
    assert date_window(df.select(c("dak.created_at")), "2026-01-01", None).count() == 1


def test_date_window_reaches_the_scan(spark):
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    base = qualify(orders.withColumnRenamed("o_orderdate", "list_date"), "dak")
    plan = date_window(base, "1997-01-01", "1997-12-31")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual(o_orderdate" in plan


def test_training_window_checks(spark):
    df = spark.createDataFrame([("2025-12-31",), ("2026-01-01",)], "list_date string")
    assert training_window(df, None, "2026-01-01").count() == 1
    with pytest.raises(ValueError):
        training_window(df, "2026-01-01", "2026-01-01")


def test_report_filter_drops_unreadable_dates(spark):
    rows = spark.createDataFrame(
        [("High", "Pending", "1", "v", "o", "t", "05/01/2026"),
         ("High", "Pending", "1", "v", "o", "t", "Unavailable")],
        "risk_label string, status string, bill_no string, vendor_name string, office string, "
        "anomaly_type string, detected_on string")
    assert report_filter(rows, from_date="2026-01-01").count() == 1
    assert report_filter(rows, search="V o").count() == 2


# --- rules --------------------------------------------------------------------------------------


def test_user_rules_without_a_usable_rule(spark):
    df = spark.createDataFrame([(1,)], "`t.a` int")
    out, warnings = apply_user_rules(df, [UserRule("x", "t.a", "between", "1")])
    assert warnings and out.select("user_rule_flag", "user_rule_reasons").first() == (False, None)
    out, _ = apply_user_rules(df, [UserRule("x", "a", ">", "5")])
    assert out.select("user_rule_flag", "user_rule_reasons").first() == (False, "")


def test_text_equality_is_not_numeric(spark):
    df = spark.createDataFrame([("100",), ("100.0",)], "`t.a` string")
    out, _ = apply_user_rules(df, [UserRule("x", "a", "=", "100")])
    assert [r["user_rule_flag"] for r in out.collect()] == [True, False]


def test_ambiguous_column_is_a_warning(spark):
    df = spark.createDataFrame([(1, 2)], "`a.x` int, `b.x` int")
    _, warnings = apply_user_rules(df, [UserRule("r", "x", ">", "0")])
    assert "ambiguous" in warnings[0]


def test_stage_columns_and_scopes(spark):
    schema = spark.createDataFrame(
        [], "`dak.list_date` date, `dak.dak_auditor_date` date, `dak.dak_aao_date` date, "
        "`bill.bill_auditor_date` date, `bill.aao_disposal_date` date").schema
    found = R.stage_columns(schema.names, dict(fixed.DATE_STAGES)["auditor_stage"])
    assert [(s.name, s.scope) for s in found] == [
        ("dak.dak_auditor_date", "dak"), ("bill.bill_auditor_date", "bill")]
    # Another scope never compares; the officer's disposal date also is a disposal stage.
    assert [r.reason.split(": ")[1] for r in R.date_sequence(schema)] == [
        "auditor_stage after aao_stage"]
    assert [s.scope for s in R.stage_columns(schema.names, ("disposal_date",))] == ["aao"]


def test_night_rule_columns(spark):
    schema = spark.createDataFrame(
        [], "`dak.list_date` date, `dak.created_at` timestamp_ntz, `dak.approved_time` string").schema
    reasons = [r.reason for r in R.night_activity(schema, ["dak.approved_time"])]
    assert [r.rsplit(": ", 1)[1] for r in reasons] == ["dak.created_at", "dak.approved_time"]


def invoices(spark, hot=400):
    rows = [(1, "A", "2024-01-01", "V"), (2, "A", "2024-01-01 10:00:00", " v "), (3, "A", "2024-01-01", "P")]
    rows += [(100 + i, "HOT", "2024-02-02", "V") for i in range(hot)]
    return spark.createDataFrame(rows, "fk_dak int, invoice_no string, invoice_date string, record_status string")


def test_duplicate_invoice_lists_stay_bounded_and_whole(spark):
    tables = Catalog({"bill": invoices(spark)})
    keys = R.duplicate_key_columns(tables, "bill")
    groups = {r["invoice_key"]: r for r in R.duplicate_invoices(tables["bill"], keys).collect()}
    assert groups["A"]["duplicate_count"] == 2 and groups["A"]["related_keys"] == ["1", "2"]
    assert groups["HOT"]["duplicate_count"] == 400 and groups["HOT"]["related_keys"] is None
    pages = R.related_key_pages(tables["bill"], keys, page_keys=50).where("invoice_key = 'HOT'").collect()
    listed = [k for p in pages for k in p["related_keys"]]
    assert len(pages) > 4 and max(len(p["related_keys"]) for p in pages) < 110
    assert sorted(map(int, listed)) == list(range(100, 500))


def test_rule_columns_and_null_logic(spark):
    slips = spark.createDataFrame(
        [(1, "V", True, None, 5), (2, "V", None, None, None), (3, "P", True, None, None)],
        "fk_dak int, record_status string, approved boolean, fk_aao int, fk_ao int")
    tables = Catalog({
        "dak": spark.createDataFrame([(1,), (2,), (3,)], "id int"), "cheque_slip": slips,
        "schedule3": spark.createDataFrame([(1, "V")], "fk_dak int, record_status string")})
    joined = J.training_join(tables, "dak.cheque_slip.schedule3")
    rules = R.builtin_rules(tables, joined.schema, list(tables))
    flagged = R.apply_rules(joined, tables, rules)
    assert {r["dak.id"]: r["sql_rule_flag"] for r in flagged.collect()} == {1: False, 2: False, 3: True}
    kept = R.exclude_rule_rows(
        joined, tables, R.training_rules(tables, joined.schema, "dak.cheque_slip.schedule3"))
    # Row 2 has an unknown approval: neither flagged nor kept, as WHERE NOT NULL has it.
    assert [r["dak.id"] for r in kept.collect()] == [1]


def test_one_join_answers_all_counts_on_a_key(spark):
    tables = Catalog({n: spark.createDataFrame([(1, "V", True, 1)],
                      "fk_dak int, record_status string, approved boolean, fk_ecs_payment_mode int")
                      for n in ("cheque_slip", "schedule3", "ecs")})
    df = qualify(tables["cheque_slip"], "cheque_slip")
    rules = R.builtin_rules(tables, df.schema, list(tables))
    plan = R.apply_rules(df, tables, rules)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter") == 1


# --- cleaning -----------------------------------------------------------------------------------


def test_void_duplicates(spark):
    df = spark.createDataFrame(
        [("A-1", "2025-01-01", "A", 1), ("A-1", "2025-01-01", "V", 2), ("B-1", "2025-01-01", "V", 3)],
        "invoice_no string, invoice_date string, record_status string, amount int")
    kept = C.drop_void_duplicates(df, [C.InvoiceKey("invoice_no", "invoice_date", "record_status")])
    assert sorted(r["amount"] for r in kept.collect()) == [1, 3]


def test_filter_columns_and_features(spark):
    df = spark.createDataFrame(
        [(1, 2.0, "x", "long text value", None, True), (2, 3.0, "y", "b", None, False)],
        "dak_fk_bill int, dak_amount double, dak_status string, dak_remarks string, dak_gone int, "
        "dak_ok boolean")
    kept, dropped = C.filter_columns(df)
    assert kept.columns == ["dak_amount", "dak_status", "dak_ok"]
    assert dropped.high_null == ["dak_gone"] and dropped.id_like == ["dak_fk_bill"]
    chosen = C.select_features(kept, limit=1)
    assert chosen.numeric == ["dak_amount"] and chosen.boolean == ["dak_ok"]
    assert chosen.unsupported == ["dak_status"]


def test_sparse_columns(spark):
    df = spark.createDataFrame([(1, None, None), (2, 1, None)], "a int, b int, c int")
    assert drop_sparse(df).columns == ["a", "b"]
    assert drop_sparse(df.limit(0), keep=["c"]).columns == ["c"]


def test_amount_total_errors_on_a_missing_column(spark):
    df = spark.createDataFrame([("100",), ("x",)], "`bills.amount` string")
    assert amount_total(df, "amount").first()[0] == 100.0
    assert amount_total(df, None).first()[0] == 0.0
    with pytest.raises(ValueError):
        amount_total(df, "dak.amount")


# --- reports and ranking ------------------------------------------------------------------------


def test_reason_stats_share_of_rows(spark):
    rows = spark.createDataFrame([(["gst x", "vendor y"],), ([],), (None,)], "reason_list array<string>")
    got = {r["label"]: (r["count"], round(r["percent"], 2)) for r in reason_stats(rows).collect()}
    assert got == {"Others": (2, 66.67), "GST Wrong": (1, 33.33), "Fake Vendor": (1, 33.33)}


def test_approvers_in_row_order(spark):
    rows = spark.createDataFrame(
        [(1, {"t.emp_id": "E1", "t.approver_name": "N1"}), (2, {"t.emp_id": "E1", "t.approver_name": "N1"}),
         (3, {"t.approver_code": "N2"}), (4, {"t.emp_id": "E9"})],
        "prediction_id int, payload map<string,string>")
    assert [r["emp_id"] for r in approvers(rows, 3).collect()] == ["E1", "N1", "N2"]


def test_rank_signals_by_priority_then_strength(spark):
    rows = [([("amount", 9.0), ("vendor::x", 2.0), ("vendor::y", 3.0), ("b__missing", 0.5),
              ("gap_days_a_to_b", 2.5), ("c", 4.0), ("d", 3.0)],)]
    df = spark.createDataFrame(rows, "s array<struct<feature:string,strength:double>>")
    ranked = df.select(G.rank_signals(c("s"))).first()[0]
    assert [r["feature"] for r in ranked] == ["b__missing", "gap_days_a_to_b", "vendor::y", "amount", "c"]


def test_rebuilt_payload_takes_the_first_row(spark):
    tables = Catalog({
        "dak": spark.createDataFrame([(7, "x")], "id int, note string"),
        "bill": spark.createDataFrame([(None, 7, "c"), (4, 7, "b"), (2, 7, "a")], "id int, fk_dak int, no string"),
        "other": spark.createDataFrame([(1,)], "z int")})
    keys = spark.createDataFrame([(7,), (8,), (0,)], "record_key int")
    got = rebuild_payload(keys, tables, ["dak", "bill", "other"]).collect()
    assert [(r["record_key"], r["payload"]) for r in got] == [
        (7, {"dak.id": "7", "dak.note": "x", "bill.id": "2", "bill.fk_dak": "7", "bill.no": "a"})]


# --- sources ------------------------------------------------------------------------------------


def test_csv_and_merged_schema(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text("SET,a,b\nx,1,2025-01-01\n")
    df = read_csv_source(spark, str(path))
    assert df.columns == ["a", "b"] and dict(df.dtypes)["a"] == "int"
    assert read_csv_source(spark, str(path), "SET string, a double, b string").dtypes[0] == ("a", "double")
    rows = merged_schema(Catalog({"t": df}), ["t"]).collect()
    assert [(r["model_column"], r["family"]) for r in rows] == [("t_a", "numeric"), ("t_b", "datetime")]


def test_staged_tables_can_be_removed(spark):
    from auditlens.sources.results import exists
    from auditlens.sources.staging import clear_staging, stage, staging_root

    kept = stage(spark.range(5).toDF("n"), "some")
    assert kept.count() == 5 and exists(spark, staging_root(spark))
    clear_staging(spark)
    assert not exists(spark, staging_root(spark))
