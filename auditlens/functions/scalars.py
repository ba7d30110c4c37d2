"""Tolerant readers for dirty values: numbers, timestamps, dates, booleans, gaps.

Every function takes a Column, and where the source type changes the reading also its
``DataType``. Typed columns are cast directly; only text goes through patterns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditlens import fixed

FAMILIES = {
    "numeric": (T.NumericType,),
    "datetime": (T.DateType, T.TimestampType, T.TimestampNTZType),
    "text": (T.StringType, T.CharType, T.VarcharType),
    "boolean": (T.BooleanType,),
}


def family(dtype: T.DataType | None) -> str:
    """Type family that decides how a value is compared."""
    for name, types in FAMILIES.items():
        if isinstance(dtype, types):
            return name
    return dtype.simpleString() if dtype is not None else "text"


def has_time_of_day(dtype: T.DataType | None) -> bool:
    return isinstance(dtype, (T.TimestampType, T.TimestampNTZType))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def c(name: str) -> Column:
    """Column by its literal name, dots included."""
    return F.col(quoted(name))


def bind(value: Column, body) -> Column:
    """``body(value)`` with the value computed once per row, however often it is used."""
    return F.get(F.transform(F.array(value), body), 0)


def any_of(predicates) -> Column:
    return reduce(lambda a, b: a | b, predicates, F.lit(False))


def text_of(col: Column, dtype: T.DataType | None = None) -> Column:
    """Text of a value; whole floating numbers carry no ``.0`` and there is no exponent."""
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        plain = F.regexp_replace(col.try_cast("decimal(38,15)").cast("string"), r"\.?0+$", "")
        return F.coalesce(plain, col.cast("string"))
    return col.cast("string")


def safe_num(col: Column, dtype: T.DataType | None = None) -> Column:
    """Double, or NULL where the text is not a plain decimal number (no exponent form)."""
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        value = col.cast("double")
        return F.when(F.abs(value) < float("inf"), value)
    if isinstance(dtype, T.NumericType):
        return col.cast("double")
    text = F.trim(col.cast("string"))
    return F.when(text.rlike(fixed.NUMBER_PATTERN), text.try_cast("double"))


def float_of(text: Column) -> Column:
    """Finite double of any numeric spelling, exponents included; NULL otherwise."""
    def number(plain: Column) -> Column:
        return F.when(plain.rlike(fixed.FLOAT_PATTERN), plain.try_cast("double"))

    def finite(value: Column) -> Column:
        return F.when(F.abs(value) < float("inf"), value)

    return bind(bind(F.trim(text), number), finite)


def num_or_text_eq(
    a: Column, b: Column, a_type: T.DataType | None = None, b_type: T.DataType | None = None
) -> Column:
    """Equal as numbers when both read as numbers, otherwise equal as text."""
    left, right = safe_num(a, a_type), safe_num(b, b_type)
    both = left.isNotNull() & right.isNotNull()
    return F.when(both, left == right).otherwise(text_of(a, a_type) == text_of(b, b_type))


def safe_ts(col: Column, dtype: T.DataType | None = None) -> Column:
    """Local timestamp. Offsets in text are ignored; other text starting with a date is midnight."""
    if family(dtype) == "datetime":
        return col.cast("timestamp_ntz")
    text = F.trim(col.cast("string"))
    day = F.substring(text, 1, 10)
    clock = F.regexp_extract(text, fixed.DATE_TIME_PATTERN, 1)
    joined = F.when(clock != "", F.concat_ws(" ", day, clock)).otherwise(day)
    return F.when(text.rlike(fixed.DATE_START_PATTERN), joined.try_cast("timestamp_ntz"))


def safe_date(col: Column, dtype: T.DataType | None = None) -> Column:
    """Date part; text counts only when it starts with a full ISO date."""
    if family(dtype) == "datetime":
        return col.cast("date")
    text = F.trim(col.cast("string"))
    return F.when(text.rlike(fixed.DATE_START_PATTERN), F.substring(text, 1, 10).try_cast("date"))


def _clock(col: Column, dtype: T.DataType | None, clock_text: bool) -> Column:
    if not clock_text:
        return safe_ts(col, dtype)
    return F.concat(F.lit("1970-01-01 "), F.trim(col.cast("string"))).try_cast("timestamp_ntz")


def safe_hour(col: Column, dtype: T.DataType | None = None, *, clock_text: bool = False) -> Column:
    """Hour; ``clock_text`` marks a time of day kept as ``HH:mm:ss`` text."""
    return F.hour(_clock(col, dtype, clock_text))


def has_time(
    col: Column,
    dtype: T.DataType | None = None,
    *,
    clock_text: bool = False,
    fractions: bool = False,
) -> Column:
    """True when the value carries a time other than midnight (never NULL)."""
    ts = _clock(col, dtype, clock_text)
    found = (F.hour(ts) != 0) | (F.minute(ts) != 0) | (F.second(ts) != 0)
    if fractions:
        found = found | (F.date_format(ts, "SSSSSS") != "000000")
    return F.coalesce(found, F.lit(False))


def at_night(
    col: Column,
    dtype: T.DataType | None = None,
    *,
    clock_text: bool = False,
    fractions: bool = False,
) -> Column:
    hour = safe_hour(col, dtype, clock_text=clock_text)
    late = (hour >= fixed.NIGHT_FROM_HOUR) | (hour < fixed.NIGHT_TO_HOUR)
    timed = has_time(col, dtype, clock_text=clock_text, fractions=fractions)
    return F.coalesce(timed & late, F.lit(False))


def flag(predicate: Column) -> Column:
    """1.0 when true, 0.0 when false or unknown."""
    return F.when(predicate, F.lit(1.0)).otherwise(F.lit(0.0))


def truthy(col: Column) -> Column:
    """Text or boolean that spells true; unknown spellings and NULL are false."""
    return F.coalesce(F.lower(F.trim(col.cast("string"))).isin(*fixed.TRUE_WORDS), F.lit(False))


def norm_bool(col: Column) -> Column:
    """1.0 / 0.0 for spelled booleans, NULL for anything else."""
    word = F.lower(F.regexp_replace(col.cast("string"), r"^\s+|\s+$", ""))
    return F.when(word.isin(*fixed.TRUE_WORDS), F.lit(1.0)).when(
        word.isin(*fixed.FALSE_WORDS), F.lit(0.0)
    )


def _weekdays_before(day_number: Column) -> Column:
    """Weekdays between a fixed Monday and a day number counted from it."""
    return F.floor(day_number / 7) * 5 + F.least(F.pmod(day_number, F.lit(7)), F.lit(5))


def busday_gap(start: Column, end: Column) -> Column:
    """Weekdays from ``start`` (inclusive) to ``end`` (exclusive); negative when reversed."""
    # 1970-01-01 is a Thursday: +3 makes day numbers count from a Monday.
    a, b = F.unix_date(start.cast("date")) + 3, F.unix_date(end.cast("date")) + 3
    forward = _weekdays_before(b) - _weekdays_before(a)
    backward = _weekdays_before(b + 1) - _weekdays_before(a + 1)
    return F.when(a <= b, forward).otherwise(backward).cast("double")


def round_half_even(col: Column, digits: int = 3) -> Column:
    """Banker's rounding, as the numeric libraries do; NULL and NaN stay NULL."""
    value = col.cast("double")
    return F.when(~F.isnan(value), F.bround(value, digits))


def record_key(columns: list[str], dtypes: dict[str, T.DataType], tables: list[str]) -> Column:
    """Business key of a joined row: the base id, else the first foreign key present."""
    if fixed.BASE_TABLE in tables:
        names = [f"{fixed.BASE_TABLE}.id"]
    else:
        names = [f"{t}.fk_dak" for t in tables] + ["fk_dak"]
    found = [safe_num(c(n), dtypes[n]).try_cast("long") for n in names if n in columns]
    return F.coalesce(*found) if found else F.lit(None).cast("long")
