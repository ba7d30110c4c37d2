"""Readers of the review payload, a ``map<string,string>`` keyed ``table.column``."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditlens import fixed
from auditlens.functions.scalars import bind, c, float_of, safe_num


def plain_key(key: Column) -> Column:
    """Column part of a payload key, lower case."""
    return F.lower(F.substring_index(key, ".", -1))


def _named(payload: Column, aliases, usable) -> Column:
    """Usable values whose key or column part is one of the aliases: two arrays, the aliases and
    the values, those of exact keys first. Built once per row, then read by alias."""
    entries = F.transform(F.map_entries(payload), lambda e: F.struct(
        F.when(F.lower(e["key"]).isin(*aliases), F.lower(e["key"])).otherwise(
            plain_key(e["key"])).alias("alias"),
        e["value"].alias("value"), e["key"].isin(*aliases).alias("exact")))
    kept = F.filter(entries, lambda e: e["alias"].isin(*aliases) & usable(e["value"]))

    def arrays(found: Column) -> Column:
        return F.struct(found["alias"].alias("aliases"), found["value"].alias("values"))

    def exact_first(found: Column) -> Column:
        return bind(F.concat(F.filter(found, lambda e: e["exact"]), F.filter(found, lambda e: ~e["exact"])), arrays)

    return bind(kept, exact_first)


def _first(found: Column, alias: str) -> Column:
    """Value under the exact key, else under the first key whose column part matches."""
    at = F.array_position(found["aliases"], F.lit(alias)).cast("int")
    return F.get(found["values"], at - 1)


def payload_values(
    payload: Column, wanted: Mapping[str, Sequence[str]], *, skip_blank_text: bool = False
) -> Column:
    """Several looked-up values as a struct, from one pass over the payload.

    Per field, the first usable value by alias: the exact key, else a key whose column part
    matches. Empty text never counts; with ``skip_blank_text`` neither does white space.
    """
    def usable(value: Column) -> Column:
        return value.rlike(r"\S") if skip_blank_text else value != ""

    every = list(dict.fromkeys(alias for aliases in wanted.values() for alias in aliases))

    def fields(found: Column) -> Column:
        return F.struct(*[
            F.coalesce(*[_first(found, a) for a in aliases]).alias(name)
            for name, aliases in wanted.items()])

    return bind(_named(payload, every, usable), fields)


def payload_value(payload: Column, aliases, *, skip_blank_text: bool = False) -> Column:
    """One looked-up value, see :func:`payload_values`."""
    return payload_values(payload, {"value": aliases}, skip_blank_text=skip_blank_text)["value"]


def payload_ids(payload: Column, keys) -> Column:
    """Positive whole ids under several keys, as a struct with one field per key."""
    def usable(value: Column) -> Column:
        return value != ""

    def ids(found: Column) -> Column:
        numbers = {k: float_of(_first(found, k)).cast("long") for k in keys}
        return F.struct(*[F.when(n > 0, n).alias(k) for k, n in numbers.items()])

    return bind(_named(payload, keys, usable), ids)


def payload_amount(payload: Column) -> Column:
    """First non-zero number under the amount keys, else 0."""
    def usable(value: Column) -> Column:
        return value != ""

    def amount(found: Column) -> Column:
        texts = F.array(*[_first(found, key) for key in fixed.AMOUNT_KEYS])
        return F.get(F.filter(F.transform(texts, float_of), lambda n: n != 0), 0)

    return F.coalesce(bind(_named(payload, fixed.AMOUNT_KEYS, usable), amount), F.lit(0.0))


def stored_amount(payload: Column) -> Column:
    """First plain number under the stored amount keys (zero counts), else 0."""
    numbers = [safe_num(F.try_element_at(payload, F.lit(k))) for k in fixed.STORED_AMOUNT_KEYS]
    return F.coalesce(*numbers, F.lit(0.0))


def page_amount(payload: Column) -> Column:
    """Amount on a review page: exact keys first, then any key ending in one; zero counts."""
    exact = [float_of(F.try_element_at(payload, F.lit(key))) for key in fixed.AMOUNT_KEYS]
    named = _named(payload, fixed.AMOUNT_KEYS, lambda value: float_of(value).isNotNull())
    return F.coalesce(*exact, float_of(F.get(named["values"], 0)), F.lit(0.0))


def entity_type(payload: Column) -> Column:
    found = payload_values(
        payload, {"vendor": fixed.VENDOR_TYPE_KEYS, "office": fixed.OFFICE_TYPE_KEYS},
        skip_blank_text=True)
    return bind(found, entity_of)


def entity_of(found: Column) -> Column:
    """Entity kind of looked-up ``vendor`` and ``office`` values."""
    return (
        F.when(found["vendor"].isNotNull(), "vendor")
        .when(found["office"].isNotNull(), "office")
        .otherwise("bill")
    )


def canonical_key(column: str, tables: list[str]) -> str:
    """``table.column`` spelling of a stored column name, longest table name first."""
    if "." in column:
        return column
    for table in sorted(tables, key=len, reverse=True):
        if column.startswith(f"{table}_") and len(column) > len(table) + 1:
            return f"{table}.{column[len(table) + 1:]}"
    return column


def review_payload(schema: T.StructType, tables: list[str], exclude=()) -> Column:
    """Business columns of a joined row as a map; system and feature columns are left out."""
    hidden = set(exclude) | set(fixed.SYSTEM_COLUMNS)
    pairs: dict[str, str] = {}
    for name in schema.names:
        if name not in hidden:
            pairs.setdefault(canonical_key(name, tables), name)
    if not pairs:
        return F.create_map().cast("map<string,string>")
    return F.map_from_arrays(
        F.array(*[F.lit(key) for key in pairs]),
        F.array(*[c(name).cast("string") for name in pairs.values()]),
    )


def has_business_data(payload: Column) -> Column:
    keys = F.filter(F.map_keys(payload), lambda k: ~k.isin("fk_dak", "review_key"))
    return F.coalesce(F.size(keys) > 0, F.lit(False))
