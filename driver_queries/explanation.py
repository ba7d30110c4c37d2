"""Signals, clauses and sentences of rows against the profile of all rows."""

from pyspark.sql import functions as F

from auditlens.functions.scalars import c
from auditlens.model.preprocess import fit_preprocessor
from auditlens.operators.cleaning import FeatureColumns
from auditlens.operators.explain import explanation_signals, fit_profiles, reason_sentence
from auditlens.operators.signals import SIGNAL_TYPE
from driver_queries.base import Tables, over, query

VOLUME = "floor(l_extendedprice * l_quantity * l_discount)"
KEYS = ["l_orderkey", "l_partkey", "l_suppkey"]


def explained(t: Tables):
    df = t.lineitem.select(
        *KEYS, F.expr(VOLUME).cast("double").alias("volume"),
        F.expr("CASE WHEN l_discount = 0 THEN 1.0D ELSE 0.0D END").alias("is_free"),
        c("l_linenumber").cast("string").alias("line_no"))
    steps = fit_preprocessor(df, FeatureColumns(["volume"], ["is_free"], ["line_no"], []))
    profiles = fit_profiles(df, steps)
    return df.withColumn("signals", explanation_signals(df, steps, profiles))


PROFILE = (
    "SELECT *, 'line_no::' || l_linenumber AS line_name, (v - m.median) / w.width AS z, "
    "count(*) OVER (PARTITION BY l_linenumber) / total AS line_share, free / total AS free_share "
    f"FROM (SELECT *, {VOLUME}::DOUBLE AS v FROM lineitem), (SELECT quantile_cont({VOLUME}::DOUBLE, 0.5) AS "
    f"median, count(*) AS total, count(*) FILTER (WHERE l_discount = 0) AS free FROM lineitem) m, "
    f"(SELECT quantile_cont({VOLUME}::DOUBLE, 0.75) - quantile_cont({VOLUME}::DOUBLE, 0.25) AS width "
    "FROM lineitem) w"
)
# A free row has no volume, so at most one of the two plain signals follows the category.
SAID = (
    "SELECT l_orderkey, l_partkey, l_suppkey, line_name || CASE WHEN l_discount = 0 AND free_share < 0.2 THEN "
    "' is_free' WHEN abs(z) >= 2 THEN ' volume' ELSE '' END AS features, 'The line no value (' || l_linenumber "
    "|| ') appears in only ' || pct(line_share) || ' of similar records' || CASE WHEN l_discount = 0 AND "
    "free_share < 0.2 THEN ', and the is free value is true, appearing in only ' || pct(free_share) || ' of "
    "similar records' WHEN z >= 2 THEN ', and the volume value (' || format('{:,}', v::BIGINT) || ') is higher "
    "than normal' ELSE '' END || '.' AS sentence FROM g"
)


def _percent(sql: str) -> str:
    for share in ("line_share", "free_share"):
        sql = sql.replace(
            f"pct({share})", f"(CASE WHEN {share} >= 0.1 THEN printf('%.1f%%', {share} * 100) WHEN "
            f"{share} >= 0.01 THEN printf('%.2f%%', {share} * 100) ELSE printf('%.3f%%', {share} * 100) END)")
    return sql


@query("explain", over(f"SELECT l_orderkey, l_partkey, l_suppkey, features FROM ({_percent(SAID)})",
                       g=PROFILE))
def explain(t: Tables):
    names = F.array_join(F.transform("signals", lambda s: s["feature"]), " ")
    return explained(t).select(*KEYS, names.alias("features"))


@query("reason_sentences", over(
    f"SELECT l_orderkey, l_partkey, l_suppkey, sentence FROM ({_percent(SAID)})", g=PROFILE))
def reason_sentences(t: Tables):
    return explained(t).select(*KEYS, reason_sentence(c("signals")).alias("sentence"))


@query("reason_fallbacks", over(
    "SELECT id, CASE WHEN user_rule_name IS NULL THEN 'Unusual combination of values: amount=' || CASE WHEN "
    "amount >= 1000 THEN format('{:,}', CAST(round_even(amount, 0) AS BIGINT)) ELSE printf('%.2f', amount) END "
    "|| '.' WHEN user_rule_name LIKE 'RULE%' THEN '(rule: large amount of payment).' ELSE "
    "'(rule: duplicate invoice).' END AS sentence FROM results", "results"))
def reason_fallbacks(t: Tables):
    """Rows without signals: rule reasons speak, else facts of the payload."""
    payload = F.create_map(F.lit("dak.amount"), F.expr("CAST(CAST(amount AS DECIMAL(12,2)) AS STRING)"),
                           F.lit("dak.colour"), F.lit("red"))
    rules = F.when(c("user_rule_name").isNotNull(),
                   F.array(F.lit("the status field is missing"), c("user_rule_name")))
    signals = F.lit(None).cast(f"array<{SIGNAL_TYPE}>")
    return t.results.select(
        "id", reason_sentence(signals, rules, payload).alias("sentence"))

