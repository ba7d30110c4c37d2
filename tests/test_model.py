from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from auditlens.functions.features import FeatureRule
from auditlens.functions.scalars import c
from auditlens.model.forest import (
    TREE_TYPE, ForestParams, Scorer, average_path, collect_forest, fit_forest, grow_tree, ml_flag, score_column,
    tree_samples,
)
from auditlens.model.io import load_model, save_model
from auditlens.model.preprocess import Preprocessor, fit_numeric, fit_preprocessor
from auditlens.operators.cleaning import FeatureColumns
from auditlens.operators.explain import explanation_signals, fit_profiles, reason_sentence
from auditlens.operators.user_rules import UserRule
from auditlens.plans.request import RunRequest
from auditlens.plans.review import anomaly_list, latest_run, page_amount_total, review_rows
from auditlens.plans.training import TrainingOptions, train_dataset, training_summary
from auditlens.plans.workbench import run_workbench
from auditlens.sources.catalog import Catalog
from auditlens.sources.results import RUN_COLUMNS, ResultStore, evolve
from auditlens.sources.staging import stage, with_dense_ids

PARAMS = ForestParams(trees=40, tree_rows=128)


def cloud(spark, n=3000):
    rng = np.random.default_rng(11)
    points = rng.normal(size=(n, 3))
    points[:5] += 12
    rows = [(i, [float(x) for x in p]) for i, p in enumerate(points)]
    return spark.createDataFrame(rows, "row_id long, features array<double>")


def test_forest_finds_planted_points_and_repeats(spark):
    rows = cloud(spark)
    trees = collect_forest(fit_forest(rows, 3000, PARAMS))
    again = collect_forest(fit_forest(rows.repartition(5), 3000, PARAMS))
    assert all(np.array_equal(a, b) for a, b in zip(trees["threshold"], again["threshold"]))
    scored = rows.select("row_id", score_column(spark, trees, 128, F.col("features")).alias("s"))
    ordered = [r["row_id"] for r in scored.orderBy(F.desc("s")).limit(5).collect()]
    assert sorted(ordered) == [0, 1, 2, 3, 4]
    low, high = scored.agg(F.min("s"), F.max("s")).first()
    assert 0 < low < high <= 1


def test_samples_are_full_and_without_replacement(spark):
    drawn = tree_samples(cloud(spark).select("row_id"), 3000, PARAMS)
    each = drawn.groupBy("tree").agg(F.count("*").alias("n"), F.countDistinct("row_id").alias("d"))
    assert {tuple(r)[1:] for r in each.collect()} == {(128, 128)} and each.count() == 40
    small = tree_samples(cloud(spark, 50).select("row_id"), 50, PARAMS)
    assert small.count() == 40 * 50


def test_scores_of_constant_rows_and_guarded_rows(spark):
    rows = spark.createDataFrame([(i, [1.0]) for i in range(10)], "row_id long, features array<double>")
    trees = collect_forest(fit_forest(rows, 10, ForestParams(trees=5, tree_rows=8)))
    guarded = F.when(c("row_id") > 4, F.col("features"))
    got = [r[0] for r in rows.select(score_column(spark, trees, 8, guarded)).collect()]
    assert got[:5] == [None] * 5 and np.allclose(got[5:], 0.5)
    assert Scorer(trees, 8).depth == 3
    assert np.allclose(average_path([1, 2]), [0, 1])


def walked(trees, tree_rows, values):
    """Scores by following the links of each tree, row by row."""
    scale = len(trees) * float(average_path(tree_rows))
    out = []
    for row in values:
        total = 0.0
        for tree in trees.itertuples():
            node = 0
            while tree.left[node] != node:
                node = tree.left[node] if row[tree.feature[node]] <= tree.threshold[node] else tree.right[node]
            total += tree.path[node]
        out.append(2.0 ** (-total / scale))
    return np.array(out)


@pytest.mark.parametrize("width", [2, 12])
def test_scores_are_those_of_the_linked_trees(width):
    """Exactly, on both sides of every threshold, in one word per row and in several codes."""
    rng = np.random.default_rng(3)
    seen = np.round(rng.normal(size=(400, width)), 2)
    trees = pd.DataFrame([
        {"tree": k, **grow_tree(seen[rng.permutation(400)[:64]], 6, np.random.default_rng(k))} for k in range(30)])
    cuts = np.unique(np.concatenate(trees["threshold"].tolist()))[:, None].repeat(width, 1)
    values = np.concatenate([seen, cuts, np.nextafter(cuts, np.inf), np.full((1, width), np.inf), np.full((1, width), -np.inf),
                             np.full((1, width), np.nan)])
    scorer = Scorer(trees, 64)
    assert scorer.narrow == (width == 2)
    assert np.array_equal(scorer.score(values, block=100), walked(trees, 64, values))


def test_codes_of_a_block_fit_one_word():
    """Features of few values take few bits, however many thresholds the forest has."""
    rng = np.random.default_rng(5)
    seen = np.concatenate([rng.normal(size=(2000, 2)), rng.integers(0, 50, (2000, 1)), rng.integers(0, 2, (2000, 6))], 1)
    trees = pd.DataFrame([
        {"tree": k, **grow_tree(seen[rng.permutation(2000)[:128]], 7, np.random.default_rng(k))} for k in range(200)])
    scorer = Scorer(trees, 128)
    assert not scorer.narrow and scorer._packed(*scorer._codes(seen)) is not None
    assert np.array_equal(scorer.score(seen[:300]), walked(trees, 128, seen[:300]))


def test_each_tree_is_grown_once(spark):
    grown = spark.sparkContext.accumulator(0)

    def grow(key, group):
        grown.add(1)
        return pd.DataFrame([{"tree": int(key[0]), "feature": [0], "threshold": [0.0], "left": [0], "right": [0], "path": [1.0]}])

    groups = spark.range(0, 300, 1, 6).groupBy((c("id") % 30).cast("int").alias("tree"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        trees = collect_forest(groups.applyInPandas(grow, TREE_TYPE))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert trees["tree"].tolist() == list(range(30)) and grown.value == 30


def test_batches_are_scored_together(spark, monkeypatch):
    """Several batches walk the forest as one block; NULL vectors and the order of rows stay."""
    rows = spark.range(0, 900, 1, 2).select("id", F.when(c("id") % 7 != 0, F.array(
        c("id").cast("double"), (c("id") % 13).cast("double"))).alias("features"))
    trees = collect_forest(fit_forest(rows.where("features IS NOT NULL"), 771, ForestParams(trees=10, tree_rows=32), row_id="id"))
    monkeypatch.setattr("auditlens.model.forest.SCORED_ROWS", 200)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 64)
    try:
        got = dict(rows.select("id", score_column(spark, trees, 32, F.col("features"))).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    values = np.array([[i, i % 13] for i in range(900)], float)
    want = Scorer(trees, 32).score(values)
    assert all(got[i] == (None if i % 7 == 0 else want[i]) for i in range(900))


def test_margin_above_threshold(spark):
    df = spark.createDataFrame([(0.62,), (0.64,), (0.651,), (None,)], "s double")
    assert [r[0] for r in df.select(ml_flag(c("s"), 0.58)).collect()] == [False, False, True, False]


def test_scaling_fills_before_it_measures_the_range(spark):
    values = [1.0, 2.0, 3.0, 10.0, None, None, None, None]
    df = spark.createDataFrame([(v, 5.0, None) for v in values], "x double, same double, none double")
    x, same = fit_numeric(df, ["x", "same", "none"])
    filled = np.array([2.5 if v is None else v for v in values])
    assert x.median == 2.5 and np.isclose(x.scale, np.subtract(*np.quantile(filled, [0.75, 0.25])))
    assert same.scale == 1.0
    assert Preprocessor.from_dict(Preprocessor(numeric=[x]).to_dict()).numeric == [x]


def test_signals_and_sentence(spark):
    rows = [(10.0 + i % 7, "common", None) for i in range(99)] + [(500.0, "rare_kind", 1.0)]
    df = spark.createDataFrame(rows, "dak_amount double, vendor string, ok double")
    steps = fit_preprocessor(df, FeatureColumns(["dak_amount"], ["ok"], ["vendor"], []))
    signals = explanation_signals(df, steps, fit_profiles(df, steps))
    out = df.withColumn("signals", signals).withColumn("text", reason_sentence(c("signals")))
    odd = out.where("vendor = 'rare_kind'").first()
    assert [s["feature"] for s in odd["signals"]] == ["vendor::rare_kind", "dak_amount", "ok"]
    assert odd["signals"][0]["comparison"]["match_ratio"] == 0.01
    assert odd["text"] == (
        "The vendor value (rare kind) appears in only 1.00% of similar records, and the dak amount value "
        "(500.00) is higher than normal, and the ok value is true, appearing in only 1.00% of similar records.")
    plain = out.where("vendor = 'common'").first()
    assert plain["signals"] == [] and "no single strong feature difference" in plain["text"]


def test_sentence_of_gaps_rules_and_long_text(spark):
    signal = ("gap_days_bill_date_to_disposal_date", "-120.0", -3.0, 3.0, "low", "m", None)
    rows = [([signal], ["RULE::late_bill", "the field is missing", "w " * 60], {"dak.status": "open"})]
    from auditlens.operators.signals import SIGNAL_TYPE

    df = spark.createDataFrame(
        rows, f"s array<{SIGNAL_TYPE}>, r array<string>, p map<string,string>")
    first, with_rules = df.select(reason_sentence(c("s")), reason_sentence(c("s"), c("r"), c("p"))).first()
    assert first == ("The gap from bill date to disposal date is 120 days, which is significantly shorter "
                     "than normal.")
    assert "(rule: late bill)" in with_rules and len(with_rules.split()) == 35
    nothing = df.select(reason_sentence(F.slice("s", 1, 0), None, c("p"))).first()[0]
    assert nothing == "Unusual combination of values: status=open."


# --- whole flows --------------------------------------------------------------------------------


def tables(spark, n=600):
    dak = spark.range(1, n + 1).select(
        c("id").cast("int").alias("id"),
        F.expr("timestamp_ntz'2024-03-01 09:00:00' + make_interval(0,0,0,CAST(id % 200 AS INT))").alias("list_date"),
        F.when(c("id") % 150 == 0, 90_000.0).otherwise(100.0 + c("id") % 13).alias("amount"),
        F.when(c("id") % 2 == 0, "A").otherwise("B").alias("kind"))
    bill = spark.range(1, n + 1).select(
        c("id").cast("int").alias("fk_dak"), c("id").cast("string").alias("invoice_no"),
        F.lit("2024-01-01").cast("date").alias("invoice_date"),
        F.when(c("id") % 3 == 0, "V").otherwise("P").alias("record_status"),
        F.when(c("id") % 150 == 0, 7_000.0).otherwise(c("id") % 11 + 0.5).alias("amount"),
        F.lit(None).cast("int").alias("empty"))
    return Catalog({"dak": dak, "bill": bill})


@pytest.fixture(scope="module")
def model(spark):
    return train_dataset(tables(spark), "dak.bill", TrainingOptions(
        forest=ForestParams(trees=40, tree_rows=128), max_rows=500))


def test_training_report(spark, model):
    row = training_summary([model], spark).first()
    assert row["source"] == 600 and row["queried"] == 500 and row["training"] == 500
    assert row["anomalies"] + row["inliers"] == 500
    assert "dak_amount" in model.contract.feature_columns
    assert "bill_empty" not in model.contract.cleaned_columns


def test_training_joins_void_duplicates_once(spark, monkeypatch):
    """Column checks, counts and features read what the join has written."""
    plans = {}

    def noted(df, name):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return stage(df, name)

    monkeypatch.setattr("auditlens.plans.training.stage", noted)
    trained = train_dataset(tables(spark), "dak.bill", TrainingOptions(forest=ForestParams(trees=5, tree_rows=64)))
    assert "Join" in plans["training-valid"] and "Join" not in plans["training-features"]
    report = trained.report
    assert report["after_sequence"] == report["training"] <= report["after_night"] <= report["after_invoices"]


def test_quartiles_of_full_columns_take_the_passes_of_the_median(spark, monkeypatch):
    from auditlens.operators import ordering

    passes, run = [], ordering._run
    monkeypatch.setattr(ordering, "_run", lambda df, aggregates: passes.append(df.columns) or run(df, aggregates))
    df = spark.createDataFrame([(float(v), None if v % 3 == 0 else float(v)) for v in range(50)], "x double, gaps double")
    x, gaps = fit_numeric(df, ["x", "gaps"])
    assert (x.median, x.scale) == (24.5, 24.5)
    filled = np.array([gaps.median if v % 3 == 0 else v for v in range(50)])
    assert gaps.median == 25.0 and gaps.scale == np.subtract(*np.quantile(filled, [0.75, 0.25]))
    assert passes == [["x", "gaps"]] * 2 + [["gaps"]] * 2


def test_model_round_trip(spark, model, tmp_path):
    save_model(spark, model, str(tmp_path / "m"))
    loaded = load_model(spark, str(tmp_path / "m"))
    assert loaded.contract == model.contract and loaded.preprocessor == model.preprocessor
    assert loaded.threshold == model.threshold and len(loaded.trees) == 40


def test_run_review_and_feedback(spark, model, tmp_path):
    source, store = tables(spark), ResultStore(spark, str(tmp_path / "store"))
    request = RunRequest(
        ["bill"], run_name="first", user_rules=[UserRule("big", "bill.amount", ">", "10.4")],
        feature_rules=[FeatureRule("share", "ratio", "bill.amount", "dak.amount")])
    record = run_workbench(source, request, model, store)
    rows = store.anomalies().orderBy("id").collect()
    big = [i for i in range(1, 601) if i % 150 == 0 or i % 11 == 10]
    assert record["user_rule_count"] == len(big) == sum(r["user_rule"] for r in rows)
    assert [r["id"] for r in rows] == list(range(1, len(rows) + 1))
    assert record["final_anomaly_count"] == len(rows) and record["total_rows"] == 600
    assert {r["fk_dak"] for r in rows if r["user_rule"]} == set(big)
    one = next(r for r in rows if r["fk_dak"] == 150)
    assert one["user_rule_name"] == "RULE::big".replace("RULE::", "") and one["ml_if_score"] is None
    assert "share" not in one["payload"] and one["payload"]["dak.amount"] == "90000.0"
    assert "bill.empty" not in one["payload"]

    again = run_workbench(source, request, model, store)
    assert again["run_id"] == record["run_id"] + 1 == latest_run(store.runs(), "dak.bill")
    ids = [r["id"] for r in store.anomalies().select("id").collect()]
    assert len(set(ids)) == len(ids) == 2 * len(rows)

    review = review_rows(store.anomalies(), run_id=record["run_id"], limit=5, offset=1)
    page = review.rows.collect()
    assert [r["prediction_id"] for r in page] == [2, 3, 4, 5, 6]
    assert page_amount_total(review).first()[0] == pytest.approx(sum(r["amount"] for r in page))
    summary = review.summary.first()
    assert summary["total_rows"] == len(rows) and summary["total_amount"] > 0

    store.record_feedback([(1, "Reject"), (2, "maybe")], datetime(2026, 1, 1))
    store.record_feedback([(1, "accept")], datetime(2026, 1, 2))
    current = {r["id"]: r["feedback_score"] for r in store.anomalies().where("id < 4").collect()}
    assert current == {1: 1.0, 2: 0.5, 3: None}
    assert anomaly_list(store.anomalies(), review_status="reviewed").summary.first()["total_rows"] == 2
    with pytest.raises(ValueError):
        store.record_feedback([(1, "perhaps")], datetime(2026, 1, 3))
    with pytest.raises(ValueError):
        store.record_feedback([(99_999, "accept")], datetime(2026, 1, 3))
    assert store.latest_runs().count() == 1

    empty = run_workbench(source, RunRequest(["bill"], from_date="1990-01-01", to_date="1990-01-02"),
                          model, store)
    assert empty["status"] == "COMPLETED" and store.runs().where("total_rows = 0").count() == 1


def test_empty_join_needs_an_earlier_result(spark, model, tmp_path):
    store = ResultStore(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError, match="no rows"):
        run_workbench(tables(spark), RunRequest(["bill"], to_date="1990-01-02"), model, store)
    with pytest.raises(ValueError, match="required columns"):
        store.begin().write_anomalies(spark.range(1))


def test_rows_dropped_by_the_contract(spark, model, tmp_path):
    source = tables(spark)
    late = source["dak"].withColumn("list_date", F.expr("list_date + INTERVAL 13 HOURS"))
    night = Catalog({**source, "dak": late})
    request = RunRequest(["bill"])
    gone = run_workbench(night, request, model, ResultStore(spark, str(tmp_path / "a")))
    kept = run_workbench(night, request, model, ResultStore(spark, str(tmp_path / "b")),
                         keep_rule_rows=True)
    assert gone["final_anomaly_count"] == 0 and kept["user_rule_count"] == 600


def test_ids_follow_stored_rows(spark):
    staged = stage(spark.range(1000).repartition(7), "ids")
    first, again = (dict(map(tuple, with_dense_ids(staged.withColumnRenamed("id", "v"), 5).select("v", "id")
                                        .collect())) for _ in range(2))
    assert first == again and sorted(first.values()) == list(range(5, 1005))


def test_run_columns_evolve(spark):
    old = spark.createDataFrame([(1, "x")], "run_id long, run_name string")
    row = evolve(old, RUN_COLUMNS).first()
    assert row["run_name"] == "x" and row["status"] == "COMPLETED" and row["total_rows"] == 0
