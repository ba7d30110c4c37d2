"""Rules declared by the user: one comparison each, combined by OR."""

from __future__ import annotations

import operator as op
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditlens.functions.features import resolve, safe_name
from auditlens.functions.scalars import (
    any_of, c, family, num_or_text_eq, safe_num, safe_ts, text_of,
)
from auditlens.functions.texts import reasons_text

ORDER = {">": op.gt, ">=": op.ge, "<": op.lt, "<=": op.le}
EQUALITY = {"=": op.eq, "!=": op.ne}


@dataclass(frozen=True)
class UserRule:
    name: str
    first_column: str
    operator: str
    value: str | None = None
    second_column: str | None = None
    second_value: str | None = None  # accepted in requests, has no effect


def timestamp_literal(value) -> datetime:
    """Timestamp of a rule value; an offset is dropped, trailing text falls back to the date."""
    text = str(value if value is not None else "").strip()
    if not text:
        raise ValueError("Rule value is missing.")
    try:
        return datetime.fromisoformat(text.replace("Z", "+00:00")).replace(tzinfo=None)
    except ValueError:
        pass
    try:
        return datetime.combine(date.fromisoformat(text[:10]), datetime.min.time())
    except ValueError:
        raise ValueError(f"Rule value '{value}' is not a valid date or timestamp.") from None


def number_literal(value) -> float:
    try:
        number = float(str(value).strip())
    except ValueError:
        number = float("nan")
    if number != number:
        raise ValueError(f"Rule value '{value}' is not numeric.")
    return number


def rule_predicate(rule: UserRule, schema: T.StructType) -> Column:
    """Predicate of one rule over a joined schema; it may be NULL, like any SQL comparison."""
    first = resolve(schema.names, rule.first_column)
    a, a_type = c(first), schema[first].dataType
    word = (rule.operator or "").strip().lower()
    if word == "null":
        return a.isNull()
    if word == "not null":
        return a.isNotNull()
    compare = ORDER.get(word) or EQUALITY.get(word)
    if compare is None:
        raise ValueError(f"Unsupported user rule operator: {rule.operator}")

    second = resolve(schema.names, rule.second_column) if rule.second_column else None
    b, b_type = (c(second), schema[second].dataType) if second else (None, None)
    if "datetime" in (family(a_type), family(b_type) if second else None):
        if second:
            return compare(safe_ts(a, a_type), safe_ts(b, b_type))
        moment = F.lit(timestamp_literal(rule.value).isoformat(sep=" ")).cast("timestamp_ntz")
        return compare(safe_ts(a, a_type), moment)
    if word in ORDER:
        right = safe_num(b, b_type) if second else F.lit(number_literal(rule.value))
        return compare(safe_num(a, a_type), right)
    if second:
        equal = num_or_text_eq(a, b, a_type, b_type)
        return equal if word == "=" else ~equal
    literal = F.lit(None if rule.value is None else str(rule.value)).cast("string")
    return compare(text_of(a, a_type), literal)


def apply_user_rules(
    df: DataFrame,
    rules: Sequence[UserRule],
    flag_column: str = "user_rule_flag",
    reasons_column: str = "user_rule_reasons",
) -> tuple[DataFrame, list[str]]:
    """Add the OR of all rules and the labels that hit. A rule that cannot apply is skipped
    with a warning. Without usable rules the flag is false and the reasons are NULL."""
    hits: dict[str, Column] = {}
    labelled: list[tuple[str, Column]] = []
    warnings: list[str] = []
    for number, rule in enumerate(rules, start=1):
        name = safe_name(rule.name, f"User rule {number}")
        try:
            labelled.append((f"RULE::{name}", rule_predicate(rule, df.schema)))
        except ValueError as problem:
            warnings.append(f"Skipped user rule '{name}': {problem}")
    if labelled:
        hits[flag_column] = F.coalesce(any_of(p for _, p in labelled), F.lit(False))
        hits[reasons_column] = reasons_text(F.array(*[F.when(p, F.lit(l)) for l, p in labelled]))
    else:
        hits[flag_column] = F.lit(False)
        hits[reasons_column] = F.lit(None).cast("string")
    return df.withColumns(hits), warnings
