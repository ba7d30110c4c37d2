"""Ranking of explanation signals and payload fields inside each row.

All ranking here works on arrays that belong to one row, so it needs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from auditlens import fixed
from auditlens.functions.scalars import bind, float_of
from auditlens.functions.texts import readable, value_text

COMPARISON_TYPE = (
    "struct<kind:string,total_count:bigint,match_count:bigint,match_ratio:double,"
    "true_count:bigint,false_count:bigint,true_ratio:double,false_ratio:double,"
    "value_ratio:double,present_count:bigint,missing_count:bigint,present_ratio:double,"
    "missing_ratio:double,count:bigint,median:double,p25:double,p75:double,min:double,"
    "max:double,mean:double>"
)
SIGNAL_TYPE = (
    "struct<feature:string,value:string,scaled_value:double,strength:double,direction:string,"
    f"method:string,comparison:{COMPARISON_TYPE}>"
)


def is_missing_name(feature: Column) -> Column:
    return feature.endswith("__missing") | F.lower(feature).contains("missingflag")


def is_gap_name(feature: Column) -> Column:
    return feature.startswith("gap_days_") & feature.contains("_to_")


def signal_priority(feature: Column) -> Column:
    """Rank class of a feature name; lower comes first."""
    name = F.lower(F.trim(feature))
    return (
        F.when(name.startswith("iqr_flag::"), 0)
        .when(is_missing_name(name), 1)
        .when(is_gap_name(name) | name.contains("isweekend") | name.contains("isbusinesshour"), 2)
        .when(name.contains("::"), 3)
        .otherwise(4)
    )


def signal_group(feature: Column) -> Column:
    """Features of one source column form a group; a missing indicator is its own."""
    return F.when(feature.endswith("__missing"), feature).otherwise(
        F.substring_index(feature, "::", 1)
    )


def best_per_group(items: Column, keys, group, k: int) -> Column:
    """Items in ascending order of the keys, original order among equals, the first of each
    group only and at most ``k``. Keys and groups are computed once per item."""
    decorated = F.transform(items, lambda s, i: F.struct(
        *[key(s).alias(f"k{n}") for n, key in enumerate(keys)], i.alias("i"),
        group(s).alias("group"), s.alias("item")))

    def firsts(ranked: Column) -> Column:
        kept = F.filter(
            ranked, lambda r, i: F.array_position(ranked["group"], r["group"]) == i + 1)
        return F.slice(kept, 1, k)["item"]

    return bind(F.array_sort(decorated), firsts)


def rank_signals(signals: Column, k: int = fixed.MAX_SIGNALS) -> Column:
    """The ``k`` strongest signals: by priority, then strength, one per feature group."""
    return best_per_group(
        signals,
        [lambda s: signal_priority(s["feature"]), lambda s: -F.coalesce(s["strength"], F.lit(0.0))],
        lambda s: signal_group(s["feature"]), k)


# --- card view: at most three signals, scored by how telling they are -------------------------


def card_group(feature: Column) -> Column:
    name = F.trim(feature)
    return F.lower(
        F.when(name.endswith("__missing"), F.regexp_replace(name, "__missing$", ""))
        .when(name.startswith("iqr_flag::"), F.substring_index(name, "::", -1))
        .otherwise(F.substring_index(name, "::", 1))
    )


def card_kind(feature: Column) -> Column:
    name = F.trim(feature)
    return (
        F.when(name.endswith("__missing"), "missing")
        .when(name.startswith("iqr_flag::"), "iqr")
        .when(name.contains("::"), "category")
        .when(is_gap_name(name), "date_gap")
        .otherwise("numeric")
    )


def card_score(signal: Column) -> Column:
    kind = card_kind(signal["feature"])
    strength = F.coalesce(signal["strength"], F.abs(signal["scaled_value"]), F.lit(0.0))
    category = F.lower(F.trim(F.substring_index(signal["feature"], "::", -1)))
    number = float_of(signal["value"])
    true_value = F.coalesce(
        F.when(number.isNotNull(), number >= 0.5).otherwise(
            F.lower(F.trim(signal["value"])).isin("true", "yes", "1")),
        F.lit(False),
    )
    of_category = (
        F.when(category.isin("true", "yes", "1") | true_value, 30).otherwise(0)
        + F.when(category.isin("", *fixed.BLANK_CATEGORY_WORDS), 20).otherwise(0)
        - F.when(category.isin("false", "no", "0"), 10).otherwise(0)
    )
    high = F.lower(F.coalesce(signal["direction"], F.lit(""))) == "high"
    return (
        strength
        + F.when(kind == "category", of_category)
        .when(kind == "numeric", 0).otherwise(100)
        + F.when(high, 5).otherwise(0)
    )


def collapse_signals(signals: Column, k: int = 3) -> Column:
    """Best signal of each group by card score, the ``k`` best groups in order."""
    return best_per_group(
        signals, [lambda s: -card_score(s)], lambda s: card_group(s["feature"]), k)


# --- payload fields ---------------------------------------------------------------------------


def key_field_score(key: Column, value: Column) -> Column:
    lower = F.lower(key)
    score = F.when(value.isNotNull() & (value != ""), 100).otherwise(0)
    for word, points in fixed.KEY_FIELD_SCORES:
        score += F.when(lower.contains(word), points).otherwise(0)
    score += F.when(lower.contains("number") | lower.endswith(".no") | lower.endswith("_no"),
                    30).otherwise(0)
    return score + F.when(lower.contains("reason") | lower.contains("remarks"), 15).otherwise(0)


def key_fields(payload: Column, table: str, k: int = 12, *, only_table: bool = False) -> Column:
    """The ``k`` most telling payload entries of a table, filled ones first; ties by key.

    With ``only_table`` keys without a table part belong to it too.
    """

    def own_key(key: Column) -> Column:
        own = key.startswith(f"{table}.") | key.startswith(f"{table}__")
        plain = ~key.contains(".") & ~key.contains("__")
        hidden = F.lower(key).isin("amount", "review_key") | F.lower(key).rlike(
            "^(?:feature_|iqr_flag::)")
        return ((own | plain) if only_table else own) & ~hidden

    own = F.filter(F.map_entries(payload), lambda e: own_key(e["key"]))
    scored = F.transform(own, lambda e: F.struct(
        (-key_field_score(e["key"], e["value"])).alias("order"),
        e["key"].alias("key"), e["value"].alias("value"),
    ))
    filled_first = F.array_sort(F.transform(scored, lambda e: F.struct(
        F.coalesce(e["value"] == "", F.lit(True)).alias("empty"), e["order"].alias("order"),
        e["key"].alias("key"), e["value"].alias("value"),
    )))
    return F.transform(F.slice(filled_first, 1, k), lambda e: F.struct(
        e["key"].alias("key"), e["value"].alias("value"), (-e["order"]).alias("score")
    ))


def row_facts(payload: Column, limit: int = fixed.MAX_ROW_FACTS) -> Column:
    """``name=value`` facts of a payload: telling keys if there are any, else the first ones."""
    entries = F.filter(F.map_entries(payload), lambda e: e["value"] != "")

    def telling(key: Column) -> Column:
        lower, hit = F.lower(key), F.lit(False)
        for word in fixed.FACT_WORDS:
            hit = hit | lower.contains(word)
        return hit

    def facts(entries: Column) -> Column:
        return bind(F.filter(entries, lambda e: telling(e["key"])), lambda chosen: F.transform(
            F.slice(F.when(F.size(chosen) > 0, chosen).otherwise(F.slice(entries, 1, 12)), 1, limit),
            lambda e: F.concat(readable(e["key"]), F.lit("="), value_text(e["value"]))))

    return bind(entries, facts)
