"""The result store as a unit of commit, pages that skip data, and late materialisation."""

import re

import pytest
from pyspark.sql import functions as F

from auditlens import fixed
from auditlens.functions.scalars import c
from auditlens.operators.joins import JoinStep, join_tables
from auditlens.operators.rules import EVIDENCE_TYPE
from auditlens.operators.signals import SIGNAL_TYPE
from auditlens.operators.summaries import extreme_rows, latest_per
from auditlens.plans.review import review_rows
from auditlens.plans.workbench import run_workbench
from auditlens.plans.request import RunRequest
from auditlens.sources.catalog import Catalog
from auditlens.sources.results import ResultStore, RunWriter, exists
from auditlens.sources.staging import staging_root
from tests.test_model import model, tables  # noqa: F401


def anomaly_rows(spark, n, run=1):
    made = {"ml_run_id": F.lit(run), "fk_dak": c("id"), "selected_tables": F.lit("dak.bill"), "user_rule": F.lit(True),
            "isolation_rule": F.lit(False), "ml_if_score": F.lit(None).cast("double"), "ml_threshold": F.lit(0.5),
            "payload": F.create_map(F.lit("dak.amount"), c("id").cast("string"), F.lit("dak.note"), F.repeat(F.lit("text "), 400))}
    made["feature_values"] = F.struct(F.array().cast(f"array<{SIGNAL_TYPE}>").alias("signals"),
                                      F.array().cast(EVIDENCE_TYPE).alias("rule_evidence"))
    return spark.range(n).select(*[
        made.get(x, F.lit(None).cast("string")).alias(x) for x in {*fixed.RESULT_COLUMNS, *made}])


def written(spark, store, *counts):
    for n in counts:
        writer = store.begin()
        writer.write_anomalies(anomaly_rows(spark, n))
        writer.write_related(spark.createDataFrame([("bill", "i", "d", str(n))], "table string, invoice_number string, invoice_date string, related_key string"))
        writer.commit({"run_name": f"rows {n}", "source_tables": ["dak", "bill"]})


class Stopped(Exception):
    pass


@pytest.mark.parametrize("place", ["write_related", "commit"])
def test_a_run_that_stops_between_two_writes_is_not_seen(spark, model, tmp_path, monkeypatch, place):  # noqa: F811
    source, store = tables(spark), ResultStore(spark, str(tmp_path / "store"))
    first = run_workbench(source, RunRequest(["bill"], run_name="first"), model, store)
    before = sorted(map(str, store.anomalies().collect()))

    def stop(*_):
        raise Stopped

    with monkeypatch.context() as patch:
        patch.setattr(RunWriter, place, stop)
        with pytest.raises(Stopped):
            run_workbench(source, RunRequest(["bill"], run_name="second"), model, store)
    assert sorted(map(str, store.anomalies().collect())) == before
    assert store.runs().count() == 1 and store.related_keys().where("ml_run_id > 1").count() == 0
    assert store.row_count() == len(before) and store.next_run_id() == first["run_id"] + 1
    assert exists(spark, f"{store.root}/anomalies/ml_run_id=2")  # orphans lie there, unseen

    again = run_workbench(source, RunRequest(["bill"], run_name="second"), model, store)
    rows = store.anomalies().collect()
    assert again["run_id"] == 2 and len(rows) == 2 * len(before)
    assert sorted(r["id"] for r in rows) == list(range(1, len(rows) + 1))
    assert len(list((tmp_path / "store" / "anomalies" / "ml_run_id=2").glob("attempt=*"))) == 1
    assert len(list((tmp_path / "store" / "runs").glob("*.parquet"))) == 2


def test_a_finished_run_leaves_nothing_staged(spark, model, tmp_path):  # noqa: F811
    import os

    root = staging_root(spark).removeprefix("file:")
    before = set(os.listdir(root)) if os.path.isdir(root) else set()
    run_workbench(tables(spark), RunRequest(["bill"]), model, ResultStore(spark, str(tmp_path / "store")))
    assert set(os.listdir(root)) <= before


def test_two_writers_of_one_number(spark, tmp_path):
    store = ResultStore(spark, str(tmp_path / "store"))
    one, two = store.begin(), store.begin()
    one.write_anomalies(anomaly_rows(spark, 3))
    two.write_anomalies(anomaly_rows(spark, 5))
    two.commit({"run_name": "two"})
    with pytest.raises(RuntimeError, match="another writer"):
        one.commit({"run_name": "one"})
    assert [r["run_name"] for r in store.runs().collect()] == ["two"] and store.anomalies().count() == 5


def test_runs_without_rows(spark, tmp_path):
    store = ResultStore(spark, str(tmp_path / "store"))
    assert store.next_run_id() == 1 and store.row_count() == 0 and store.related_keys().count() == 0
    with pytest.raises(ValueError, match="no result table"):
        store.anomalies()
    written(spark, store, 0)
    assert store.anomalies().count() == 0 and store.rows_of([1]).count() == 0
    written(spark, store, 4, 0, 2)
    assert [r["id"] for r in store.anomalies().orderBy("id").collect()] == [1, 2, 3, 4, 5, 6]
    assert store.next_run_id() == 5 and store.row_count() == 6
    assert {(r["ml_run_id"], r["related_key"]) for r in store.related_keys().collect()} == {(1, "0"), (2, "4"), (3, "0"), (4, "2")}


def files_read(df):
    """Files that the scans of an executed plan have opened."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    total, todo = 0, [plan]
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            todo.append(node.executedPlan())
            continue
        if node.nodeName().endswith("QueryStage"):
            todo.append(node.plan())
            continue
        if node.nodeName().startswith("Scan parquet"):
            total += node.metrics().apply("numFiles").value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return total


def test_few_rows_are_found_in_few_files(spark, tmp_path):
    store = ResultStore(spark, str(tmp_path / "store"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        written(spark, store, 800, 800)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    every = store.anomalies().inputFiles()
    assert len(every) >= 16
    found = store.rows_of(range(901, 951))
    assert sorted(r["id"] for r in found.collect()) == list(range(901, 951))
    assert len(found.inputFiles()) <= 2 and files_read(store.rows_of(range(901, 951))) <= 2
    assert [r["id"] for r in store.rows_of([5, 1599, 99_999, 5], ["id"]).orderBy("id").collect()] == [5, 1599]


def test_a_page_shuffles_no_payload_and_is_evaluated_once(spark, tmp_path):
    store = ResultStore(spark, str(tmp_path / "store"))
    written(spark, store, 800, 800)
    calls = spark.sparkContext.accumulator(0)

    def seen(value):
        calls.add(1)
        return value

    once = store.anomalies().where("ml_run_id = 2 AND id <= 900").withColumn("fk_dak", F.udf(seen, "long").asNondeterministic()("fk_dak"))
    for payloads in (store.rows_of, store.anomalies().select("id", "payload"), None):
        source = once if payloads is None else once.drop("payload")
        start = calls.value
        review = review_rows(source, limit=50, offset=10, payloads=payloads)
        assert calls.value - start == 100  # rows of the filter, each once
        page = review.rows.collect()
        assert calls.value - start == 100 or payloads is None
        assert [r["prediction_id"] for r in page] == list(range(811, 861))
        assert [r["amount"] for r in page] == [float(r["fk_dak"]) for r in page]
        plan = review.rows._jdf.queryExecution().executedPlan().toString()
        shuffles = [line for line in plan.splitlines() if re.search(r"\bExchange (hash|single|round)", line)]
        assert not any("hashpartitioning" in line for line in shuffles), plan
    joined = review_rows(store.anomalies(), limit=100_000, payloads=store.anomalies().select("id", "payload")).rows
    assert joined.count() == 1600 and joined.where("amount IS NULL OR amount < 0").count() == 0


def leaf_stages(plan):
    """Node names below the lowest exchanges of a formatted plan, by leaf."""
    text = plan._jdf.queryExecution().executedPlan().toString()
    lines = text.split("== Initial Plan ==")[-1].splitlines()
    out, path = [], []
    for line in lines:
        name = re.sub(r"^[\s:+\-*()\d]*", "", line)
        depth = len(line) - len(line.lstrip(" :+-"))
        path = [p for p in path if p[0] < depth] + [(depth, name.split(" ")[0].split("(")[0])]
        if "Scan" in name.split("(")[0] or "FileScan" in name:
            names = [n for _, n in path]
            last = max((i for i, n in enumerate(names) if n == "Exchange"), default=-1)
            out.append(names[last + 1:])
    return out


def test_latest_rows_are_sorted_late(spark, tmp_path):
    path = str(tmp_path / "events")
    spark.range(3000).select((c("id") % 40).alias("user"), (c("id") % 500).alias("ts"), c("id").alias("event"),
                             F.lit("wide").alias("more")).write.parquet(path)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        latest = latest_per(spark.read.parquet(path), ["user"], ["ts", "event"])
        stages = leaf_stages(latest)
        assert len(stages) == 2 and not any("Sort" in n or n == "SortAggregate" for s in stages for n in s), stages
        got = {r["user"]: r["event"] for r in latest.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    best = {}
    for i in range(3000):
        best[i % 40] = max(best.get(i % 40, (-1, -1)), (i % 500, i))
    assert got == {u: e for u, (_, e) in best.items()}


def test_extreme_rows_of_hot_null_and_tied_groups(spark):
    rows = [("hot", i % 7, i % 3, i) for i in range(900)] + [(None, 1, None, 1000), (None, 2, None, 1001), ("n", None, 5, 1002),
            ("n", None, 4, 1003), ("same", 1, 1, 7), ("same", 1, 1, 7), ("half", None, 9, 1), ("half", 3, None, 2)]
    df = spark.createDataFrame(rows, "k string, a int, b int, v int")
    last = {r["k"]: (r["a"], r["b"]) for r in extreme_rows(df, ["k"], ["a", "b"]).collect()}
    assert last == {"hot": (6, 2), None: (2, None), "n": (None, 5), "same": (1, 1), "half": (3, None)}
    first = extreme_rows(df, ["k"], ["a", "b"], first=True).collect()
    assert {r["k"]: (r["a"], r["b"]) for r in first} == {"hot": (0, 0), None: (1, None), "n": (None, 4), "same": (1, 1), "half": (3, None)}
    assert len(first) == 5 and extreme_rows(df, ["k"], []).count() == 5 and extreme_rows(df.limit(0), ["k"], ["a"]).count() == 0


def executed(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_a_full_step_does_not_join_twice_what_lies_before_it(spark, tmp_path):
    rows = {
        "a": [(1, 10), (2, 20), (2, 21), (None, 30)], "b": [(2, "x"), (3, "y"), (None, "z"), (2, "w")],
        "d": [(10, 1.0), (99, 2.0), (None, 3.0)]}
    shapes = {"a": "k int, v int", "b": "k int, w string", "d": "v int, u double"}
    for name, cells in rows.items():
        spark.createDataFrame(cells, shapes[name]).write.parquet(str(tmp_path / name))
    catalog = Catalog.from_parquet(spark, {n: str(tmp_path / n) for n in rows})
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        one = join_tables(catalog, ["a", "b"], [JoinStep("a", "k", "b", "k", "full")])
        got = sorted(map(tuple, one.collect()), key=str)
        chain = join_tables(catalog, ["a", "d", "b"], [JoinStep("a", "v", "d", "v", "left"), JoinStep("a", "k", "b", "k", "full")])
        plan = executed(chain)
        assert str(tmp_path / "d") not in plan and str(tmp_path / "a") not in plan  # only what was joined and written
        more = sorted(map(tuple, chain.collect()), key=str)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    want = [(1, 10, None, None), (2, 20, 2, "x"), (2, 20, 2, "w"), (2, 21, 2, "x"), (2, 21, 2, "w"), (None, 30, None, None),
            (None, None, 3, "y"), (None, None, None, "z")]
    assert got == sorted(want, key=str)
    side = {10: (10, 1.0)}
    assert more == sorted([(k, v, *side.get(v, (None, None)), *rest) for k, v, *rest in want], key=str)
