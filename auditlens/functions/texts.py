"""Labels and phrases: reasons, keys, statuses, risk and readable values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from auditlens import fixed
from auditlens.functions.scalars import bind, float_of


def collapse_blanks(col: Column) -> Column:
    return F.regexp_replace(col, r"\s+", " ")


def strip_blanks(col: Column) -> Column:
    return F.regexp_replace(col, r"^\s+|\s+$", "")


def presentable(col: Column) -> Column:
    """Reason text for people: no rule prefixes, no underscores; blank becomes NULL."""
    plain = F.regexp_replace(F.replace(F.replace(col, F.lit("RULE::"), F.lit("")),
                                       F.lit("OUTLIER::"), F.lit("")), "_", " ")
    filled = strip_blanks(col) != ""
    return F.when(filled, strip_blanks(collapse_blanks(plain)))


def reasons_text(reasons: Column) -> Column:
    """Reasons that hit, comma separated; empty text when none did."""
    return F.array_join(F.array_compact(reasons), ", ")


def _named_parts(key: Column) -> Column:
    return F.filter(F.split(F.coalesce(key, F.lit("")), r"\."),
                    lambda part: (part != "") & (F.lower(part) != "null"))


def norm_key(col: Column) -> Column:
    """Table key without blank and ``null`` parts."""
    return F.array_join(_named_parts(strip_blanks(col)), ".")


def key_label(col: Column) -> Column:
    """Readable table key, or ``Unknown``."""
    parts = _named_parts(strip_blanks(col))
    shown = F.transform(parts, lambda part: F.replace(part, F.lit("_"), F.lit(" ")))
    return F.when(F.size(parts) == 0, F.lit("Unknown")).otherwise(F.array_join(shown, " + "))


def type_label(by_rule: Column, by_model: Column) -> Column:
    return (
        F.when(by_rule & by_model, "Rule + ML")
        .when(by_rule, "Rule")
        .when(by_model, "ML")
        .otherwise("Anomaly")
    )


def description(
    by_rule: Column, by_model: Column, rule_reason: Column, sentence: Column
) -> Column:
    """What to show for an anomaly: its rule reason, else its explanation, else a default."""
    reason = strip_blanks(rule_reason)
    return (
        F.when(by_rule & (reason != ""), reason)
        .when(by_model & sentence.isNotNull(), sentence)
        .when(by_rule & by_model, "Rule and ML anomaly detected")
        .when(by_rule, "Rule anomaly detected")
        .when(by_model, "ML anomaly detected")
        .otherwise("Anomaly detected")
    )


def feedback_score(label: Column) -> Column:
    """Score of a feedback word; unknown words give NULL (the caller decides to reject)."""
    word = F.lower(strip_blanks(label))
    out = F.lit(None).cast("double")
    for name, score in fixed.FEEDBACK_SCORES.items():
        out = F.when(word == name, F.lit(score)).otherwise(out)
    return out


def feedback_label(score: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, value in fixed.FEEDBACK_SCORES.items():
        out = F.when(F.abs(score.cast("double") - value) < 0.001, F.lit(name)).otherwise(out)
    return out


def review_status(status: Column, feedback: Column) -> Column:
    word = F.lower(F.coalesce(feedback, F.lit("")))
    return (
        F.when(word == "accept", "Approved")
        .when(word.isin("reject", "maybe"), "Under Review")
        .when(F.upper(status) == "REVIEWED", "Under Review")
        .otherwise("Pending")
    )


def severity(by_rule: Column, score: Column) -> Column:
    known = F.coalesce(score.cast("double"), F.lit(0.0))
    return F.when(by_rule, F.greatest(known, F.lit(fixed.RULE_SEVERITY_FLOOR))).otherwise(known)


def risk_score(by_rule: Column, score: Column) -> Column:
    points = F.floor(severity(by_rule, score) * 100 + 0.5).cast("int")
    return F.greatest(F.lit(fixed.RISK_FLOOR), points)


def risk_label(points: Column) -> Column:
    return (
        F.when(points >= fixed.RISK_HIGH, "High")
        .when(points >= fixed.RISK_MEDIUM, "Medium")
        .otherwise("Low")
    )


def capitalize(col: Column) -> Column:
    return F.concat(F.upper(F.substring(col, 1, 1)), F.substring(col, 2, 2_147_483_647))


def format_reason(col: Column) -> Column:
    """Report form of a reason: leading prefix removed, blanks collapsed."""
    plain = F.regexp_replace(F.regexp_replace(col, r"(?i)^(?:OUTLIER|RULE)::", ""), "_", " ")
    return F.when(F.coalesce(col, F.lit("")) == "", F.lit("No reason")).otherwise(
        strip_blanks(collapse_blanks(plain))
    )


def simplify_reason(col: Column) -> Column:
    """Report category of a reason; the first word found decides."""
    lower = F.lower(col)
    out = capitalize(col)
    for word, category in reversed(fixed.REASON_CATEGORIES):
        out = F.when(lower.contains(word), F.lit(category)).otherwise(out)
    return out


def flex_date(col: Column) -> Column:
    """Date from ISO text, else from day-first text with slashes or dashes."""
    text = strip_blanks(col.cast("string"))
    iso = F.when(text.rlike(fixed.DATE_START_PATTERN), F.substring(text, 1, 10).try_cast("date"))
    day_first = F.when(
        text.rlike(r"^\d{2}[/-]\d{2}[/-]\d{4}$"),
        F.concat_ws("-", F.substring(text, 7, 4), F.substring(text, 4, 2), F.substring(text, 1, 2))
        .try_cast("date"),
    )
    return F.coalesce(iso, day_first)


def rarity(ratio: Column) -> Column:
    """How surprising a share is: 10 % is 1, 1 % is 2, 0.1 % is 3."""
    return -F.log10(F.greatest(ratio, F.lit(1e-6)))


def fixed_text(value: Column, digits: int) -> Column:
    """A number with so many decimals; halves by the exact binary value, true ones to even.

    The text of a double can end in a half that the double itself is not (2.675 is less). Such a
    double is the nearest one to k / 10**(digits + 1) with k ending in 5. There, the sign of
    value * 10**(digits + 1) - k decides; it is exact, as the value is split into two parts of
    26 bits whose products are exact.
    """
    power = 10.0 ** (digits + 1)

    def shown(size: Column) -> Column:
        k = F.rint(size * power)
        half = (k % 10 == 5) & (size == k / power)
        spread = size * 134217729.0  # 2**27 + 1
        high = spread - (spread - size)
        beyond = (high * power - k) + (size - high) * power
        low = (k - 5) / 10
        up = (beyond > 0) | ((beyond == 0) & (low % 2 == 1))
        return F.when(half, (low + F.when(up, 1.0).otherwise(0.0)) / 10.0 ** digits).otherwise(size)

    size = bind(F.abs(value), shown)
    return F.format_string(f"%.{digits}f", F.when(value < 0, -size).otherwise(size))


def percent_text(ratio: Column) -> Column:
    def shown(pct: Column) -> Column:
        return (
            F.when(pct >= 10, F.concat(fixed_text(pct, 1), F.lit("%")))
            .when(pct >= 1, F.concat(fixed_text(pct, 2), F.lit("%")))
            .when(pct < 1, F.concat(fixed_text(pct, 3), F.lit("%")))
        )

    return bind(ratio * 100, shown)


def number_text(value: Column) -> Column:
    size = F.abs(value)
    return (
        F.when(size >= 1000, F.format_string("%,.0f", F.rint(value)))
        .when((size < 1) & (value != 0), fixed_text(value, 4))
        .when(value.isNotNull(), fixed_text(value, 2))
    )


def value_text(text: Column) -> Column:
    """A value inside a sentence: numbers by size, text cut to 40 characters."""
    number = float_of(text)

    def cut(plain: Column) -> Column:
        return F.when(F.length(plain) <= 40, plain).otherwise(
            F.concat(F.substring(plain, 1, 37), F.lit("...")))

    return F.coalesce(
        bind(number, number_text), bind(strip_blanks(collapse_blanks(text)), cut), F.lit("unknown"))


def readable(name: Column) -> Column:
    """Column name as a phrase."""
    last = F.element_at(F.split(name, r"\."), -1)
    bare = F.regexp_replace(last, r"(?i)__(missing|flag|ratio|diff)$", "")
    phrase = F.lower(strip_blanks(F.regexp_replace(bare, r"[_\-]+", " ")))
    return bind(phrase, lambda p: F.when(p != "", p).otherwise("field"))


def readable_category(value: Column) -> Column:
    """Category value as a phrase of at most 60 characters; blank words become empty text."""
    edges = F.regexp_replace(
        collapse_blanks(F.coalesce(value, F.lit(""))), r"^[_ \-]+|[_ \-]+$", ""
    )

    def short(phrase: Column) -> Column:
        return F.when(
            F.length(phrase) > 60,
            F.concat(F.regexp_replace(F.substring(phrase, 1, 57), r"\s+$", ""), F.lit("...")),
        ).otherwise(phrase)

    def worded(edges: Column) -> Column:
        blank = F.lower(edges).isin("", *fixed.BLANK_CATEGORY_WORDS)
        phrase = strip_blanks(F.regexp_replace(edges, r"[_\-]+", " "))
        return F.when(blank, F.lit("")).otherwise(F.lower(bind(phrase, short)))

    return bind(edges, worded)


def epoch_date(value: Column) -> Column:
    """Date text of an epoch number: milliseconds from 1e12, seconds from 1e9, else NULL."""
    size = F.abs(value)
    seconds = F.when(size >= 1e12, value / 1000).when(size >= 1e9, value)
    days = F.floor(seconds / 86400).cast("int")
    return F.when(size < 2.5e14, F.date_format(F.date_from_unix_date(days), "yyyy-MM-dd"))


def normal_reason(col: Column) -> Column:
    """Comparison form of a reason: lower case words only."""
    return F.trim(F.regexp_replace(F.lower(format_reason(col)), r"[^a-z0-9]+", " "))


def split_reason(col: Column) -> Column:
    """A sentence stays whole; a comma list becomes its parts."""
    text = strip_blanks(col)
    parts = F.when(text.rlike(r"[.!?]"), F.array(text)).otherwise(F.split(text, ","))
    return F.filter(F.transform(parts, strip_blanks), lambda part: part != "")


def _with_forms(reasons: Column) -> Column:
    """First reason of each comparison form, in order, as records of form and text."""
    marked = F.transform(
        reasons, lambda r: F.struct(normal_reason(r).alias("form"), r.alias("text")))
    return bind(marked, lambda all_of: F.filter(
        all_of,
        lambda m, i: (m["form"] != "") & (F.array_position(all_of["form"], m["form"]) == i + 1)))


def dedupe_reasons(reasons: Column) -> Column:
    """First reason of each comparison form, in order."""
    return _with_forms(reasons)["text"]


def content_tokens(form: Column) -> Column:
    """Telling words of a reason in comparison form."""
    return F.filter(F.split(form, " "), lambda t: (F.length(t) > 1) & ~t.isin(*fixed.STOP_WORDS))


def tokens_overlap(left: Column, right: Column) -> Column:
    """True when two long enough lists of words share enough of them."""
    shared = F.size(F.filter(left, lambda t: F.array_contains(right, t)))
    shorter = F.least(F.size(left), F.size(right))
    return F.when(
        shorter >= fixed.OVERLAP_MIN_TOKENS, shared / shorter >= fixed.OVERLAP_MIN_RATIO
    ).otherwise(False)


def merge_reasons(reasons: Column, extra: Column) -> Column:
    """Split and de-duplicated reasons, then the extra ones; a reason that an extra one
    restates in other words is left out, an identical one is shown once."""
    base = F.transform(
        _with_forms(F.flatten(F.transform(reasons, split_reason))),
        lambda b: F.struct(b["form"].alias("form"), b["text"].alias("text"),
                           content_tokens(b["form"]).alias("tokens")))
    more = F.transform(
        _with_forms(extra),
        lambda m: F.struct(m["form"].alias("form"), m["text"].alias("text"),
                           content_tokens(m["form"]).alias("tokens")))

    def joined(kept: Column, more: Column) -> Column:
        new = F.filter(more, lambda m: ~F.array_contains(kept["form"], m["form"]))
        return F.concat(F.transform(kept["text"], format_reason), new["text"])

    def merged(more: Column) -> Column:
        kept = F.filter(
            base,
            lambda b: F.array_contains(more["form"], b["form"])
            | ~F.exists(more, lambda m: tokens_overlap(b["tokens"], m["tokens"])))
        return bind(kept, lambda rows: joined(rows, more))

    return bind(more, merged)
