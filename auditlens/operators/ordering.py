"""Exact order statistics, first rows and pages that never sort a whole table in one task.

Spark's own ``percentile`` keeps every distinct value of a column in one buffer, and a large
``orderBy().limit()`` merges all candidates in one task. Beyond a size limit the functions
here count values by buckets, go on with the bucket that holds the wanted rank and repeat; where
buckets do not divide the values, sketches bracket the rank and counts around it are exact. The
result is the same, and each pass returns a few numbers per column or bucket.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditlens.functions.scalars import bind, c
from auditlens.sources.staging import stage

BUFFER_ROWS = 2_000_000  # values one aggregation buffer may hold
SORTED_ROWS = 10_000  # rows one task may merge for a page
SKETCH_ACCURACY = 2_000
BUCKETS = 4_096  # equal parts of the range of values that one pass counts
BUCKET_PASSES = 3  # passes over buckets before sketches take over


@dataclass(eq=False)
class _Target:
    """One wanted rank of one value column; the value lies strictly between low and high."""

    name: str
    value: Column
    rank: int
    low: float | int | None = None
    high: float | int | None = None
    below: int = 0
    inside: int = 0
    found: float | int | None = None
    least: float | int | None = None  # of the values inside, once they were counted by buckets
    most: float | int | None = None
    passes: int = 0

    def within(self) -> Column:
        inside = self.value.isNotNull()
        if self.low is not None:
            inside = inside & (self.value > self.low)
        if self.high is not None:
            inside = inside & (self.value < self.high)
        return inside


def _run(df: DataFrame, aggregates: list[Column]):
    return df.agg(*[a.alias(f"a{i}") for i, a in enumerate(aggregates)]).first()


def _by_interval(targets: list[_Target]) -> list[list[_Target]]:
    """Targets of one column and interval share one list or sketch."""
    groups: dict[tuple, list[_Target]] = {}
    for t in targets:
        groups.setdefault((t.name, t.low, t.high), []).append(t)
    return list(groups.values())


def _select_ranks(df: DataFrame, targets: list[_Target], buffer_rows: int) -> None:
    """Set ``found`` of every target; ``inside`` must hold the column's non-null count."""
    while groups := _by_interval([t for t in targets if t.found is None]):
        small = [g for g in groups if g[0].inside * len(groups) <= buffer_rows]
        large = [g for g in groups if g not in small]
        if small:
            for group, values in zip(small, _run(df, [_pick(g) for g in small])):
                for t, value in zip(group, values):
                    t.found = value
        counted = [g for g in large if _divisible(g[0])]
        if counted:
            _count_buckets(df, counted)
        large = [g for g in large if g not in counted]
        if not large:
            continue
        pivots = [
            (t, *values[2 * i:2 * i + 2])
            for group, values in zip(large, _run(df, [_brackets(g) for g in large]))
            for i, t in enumerate(group)
        ]
        counts = _run(df, [
            count
            for t, left, right in pivots
            for count in (
                F.count_if(t.within() & (t.value < left)), F.count_if(t.value == left),
                F.count_if(t.within() & (t.value < right)), F.count_if(t.value == right),
            )
        ])
        for i, (t, left, right) in enumerate(pivots):
            _narrow(t, left, right, *counts[4 * i:4 * i + 4])


def _pick(group: list[_Target]) -> Column:
    """Values at the ranks of a group, from one sorted list of what lies in its interval."""
    first = group[0]
    ordered = F.sort_array(F.collect_list(F.when(first.within(), first.value)))
    places = [t.rank - t.below + 1 for t in group]
    return bind(ordered, lambda values: F.array(*[F.element_at(values, n) for n in places]))


def _divisible(t: _Target) -> bool:
    """Whether another pass over buckets is worth trying."""
    return t.passes < BUCKET_PASSES and all(v is None or math.isfinite(v) for v in (t.least, t.most))


def _bucket(t: _Target) -> Column:
    """Number of the bucket of a value, which never falls as the value grows: first by the order of
    magnitude, so that a few far values do not fill the range, then in equal parts of the range."""
    x = t.value.cast("double")
    if t.least is None:
        scaled = F.signum(x) * F.log1p(F.abs(x)) * 64
    else:
        low, high = float(t.least) / 2, float(t.most) / 2
        scaled = (x / 2 - low) / ((high - low) or 1.0) * BUCKETS
    return F.floor(F.least(F.greatest(scaled, F.lit(-1e6)), F.lit(1e6)))


def _count_buckets(df: DataFrame, groups: list[list[_Target]]) -> None:
    """One pass that counts the values of each group by buckets, and moves the interval of every
    target to the bucket of its rank. What comes back is a few numbers per bucket."""
    entries = [F.when(g[0].within(), F.struct(
        F.lit(i).alias("g"), _bucket(g[0]).alias("b"), g[0].value.alias("v"))) for i, g in enumerate(groups)]
    rows = df.select((F.explode(F.array(*entries)) if len(entries) > 1 else entries[0]).alias("e")).where("e IS NOT NULL")
    found = rows.groupBy("e.g", "e.b").agg(
        F.count("*").alias("n"), F.min("e.v").alias("least"), F.max("e.v").alias("most"))
    buckets: dict[int, list] = {}
    for row in sorted(found.collect(), key=lambda r: (r["g"], r["b"])):
        buckets.setdefault(row["g"], []).append(row)
    for i, group in enumerate(groups):
        for t in group:
            _enter(t, buckets[i])


def _enter(t: _Target, buckets: list) -> None:
    """Narrow a target to the bucket of its rank; ``buckets`` are those of its interval, in order."""
    t.passes += 1
    for k, row in enumerate(buckets):
        if t.rank - t.below < row["n"]:
            break
        t.below += row["n"]
    t.inside, t.least, t.most = row["n"], row["least"], row["most"]
    if k:
        t.low = buckets[k - 1]["most"]
    if k + 1 < len(buckets):
        t.high = buckets[k + 1]["least"]
    if t.least == t.most:
        t.found = t.least


def _brackets(group: list[_Target]) -> Column:
    """Two values around the place of each target, from one sketch."""
    first, around = group[0], []
    slack = 2 / SKETCH_ACCURACY
    for t in group:
        at = (t.rank - t.below) / max(t.inside - 1, 1)
        around += [max(0.0, at - slack), min(1.0, at + slack)]
    return F.percentile_approx(F.when(first.within(), first.value), around, SKETCH_ACCURACY)


def _narrow(t: _Target, left, right, lt_left: int, at_left: int, lt_right: int, at_right: int):
    """Move the open interval of a target using exact counts at two pivot values."""
    offset = t.rank - t.below
    if offset < lt_left:
        t.high, t.inside = left, lt_left
    elif offset < lt_left + at_left:
        t.found = left
    elif offset < lt_right:
        t.low, t.high = left, right
        t.below += lt_left + at_left
        t.inside = lt_right - lt_left - at_left
    elif offset < lt_right + at_right:
        t.found = right
    else:
        t.low = right
        t.below += lt_right + at_right
        t.inside -= lt_right + at_right


def exact_percentiles(
    df: DataFrame,
    columns: Sequence[str],
    probabilities: Sequence[float],
    *,
    buffer_rows: int = BUFFER_ROWS,
) -> dict[str, list[float | None]]:
    """Exact linear-interpolation percentiles of numeric columns, NULL and NaN left out.

    Runs jobs: a count, and one more pass while the columns fit the buffer.
    """
    if not columns:
        return {}
    values = {n: F.nanvl(c(n).cast("double"), F.lit(None).cast("double")) for n in columns}
    totals = _run(df, [F.count(v) for v in values.values()])
    wanted: dict[tuple[str, int], _Target] = {}
    for (name, value), total in zip(values.items(), totals):
        for p in probabilities:
            place = p * (total - 1)
            for rank in {math.floor(place), math.ceil(place)} if total else ():
                wanted.setdefault((name, rank), _Target(name, value, rank, inside=total))
    _select_ranks(df, list(wanted.values()), buffer_rows)
    out: dict[str, list[float | None]] = {}
    for name, total in zip(values, totals):
        places = [p * (total - 1) for p in probabilities]
        out[name] = [
            _interpolate(wanted, name, place) if total else None for place in places
        ]
    return out


def _interpolate(wanted, name: str, place: float) -> float:
    low = wanted[name, math.floor(place)].found
    high = wanted[name, math.ceil(place)].found
    return low + (high - low) * (place - math.floor(place))


def rank_key(df: DataFrame, name: str) -> Column | None:
    """Whole or floating number in the order of the column, or None for other types."""
    dtype = df.schema[name].dataType
    if isinstance(dtype, T.DateType):
        return F.unix_date(c(name))
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
        return F.timestamp_diff("MICROSECOND", epoch, c(name).cast("timestamp_ntz"))
    if isinstance(dtype, T.IntegralType):
        return c(name).cast("long")
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return c(name).cast("double")
    return None


def value_at_rank(
    df: DataFrame, key: Column, rank: int, total: int, *, buffer_rows: int = BUFFER_ROWS
):
    """Value of a number column at a 0-based rank among its ``total`` non-null values."""
    target = _Target("key", key, rank, inside=total)
    _select_ranks(df, [target], buffer_rows)
    return target.found


def _tie(df: DataFrame) -> Column:
    """Number that orders rows with equal keys: a hash of the whole row, NULLs counting."""
    values = [
        F.to_json(F.struct(c(f.name))) if "map<" in f.dataType.simpleString() else c(f.name)
        for f in df.schema.fields
    ]
    # 53 bits, so that sketches, which compute in doubles, give it exactly.
    return F.shiftright(F.xxhash64(*values, *[c(f.name).isNull() for f in df.schema.fields]), 11)


def _cut(
    df: DataFrame, narrow: DataFrame, keys: Sequence[Column], n: int, buffer_rows: int
) -> tuple[Column, Column, int]:
    """(kept, tied, left): the first ``n`` rows, NULL keys last, equal keys by ``_tie``, are those
    with ``kept`` and ``left`` of the rows with ``tied``, which are equal. ``narrow`` has the keys."""
    kept, tied, left = F.lit(False), F.lit(True), n
    if n <= 0:
        return kept, kept, 0
    for key, rows in [*((key, narrow) for key in keys), (_tie(df), df)]:
        scope = rows.where(tied)
        present, absent = _run(scope, [F.count(key), F.count_if(key.isNull())])
        if left >= present + absent:
            return kept | tied, F.lit(False), 0
        if left > present:
            kept, tied, left = kept | (tied & key.isNotNull()), tied & key.isNull(), left - present
            continue
        cut = value_at_rank(scope, key, left - 1, present, buffer_rows=buffer_rows)
        before, rows_tied = _run(scope, [F.count_if(key < cut), F.count_if(key == cut)])
        kept = kept | (tied & F.coalesce(key < cut, F.lit(False)))
        tied, left = tied & F.coalesce(key == cut, F.lit(False)), left - before
        if rows_tied == left:
            return kept | tied, F.lit(False), 0
    return kept, tied, left


def first_rows(
    df: DataFrame,
    order: Sequence[str],
    n: int,
    *,
    sorted_rows: int = SORTED_ROWS,
    buffer_rows: int = BUFFER_ROWS,
) -> DataFrame:
    """First ``n`` rows in ascending order, NULLs last, equal keys by a hash of the row; sorted.

    Small ``n`` is a top-k. Large ``n`` turns the cut into a filter on the same order, so that
    the result stays distributed; only equal rows are cut by a limit. Both give the same rows.
    The order columns are staged once, so the passes over them do not repeat what ``df`` computes.
    """
    keys = [rank_key(df, name) for name in order]
    total_order = [*[c(name).asc_nulls_last() for name in order], _tie(df)]
    if n <= sorted_rows or not keys or any(key is None for key in keys):
        return df.orderBy(*total_order).limit(n)
    narrow = stage(df.select(*[c(name) for name in order]), "order")
    kept, tied, left = _cut(df, narrow, keys, n, buffer_rows)
    rows = df.where(kept)
    if left:
        rows = rows.unionByName(df.where(tied & ~kept).limit(left))
    return rows.orderBy(*total_order)


def page(
    df: DataFrame,
    key: str,
    *,
    limit: int,
    offset: int = 0,
    descending: bool = False,
    sorted_rows: int = SORTED_ROWS,
    buffer_rows: int = BUFFER_ROWS,
) -> DataFrame:
    """One page by a whole-number key, itself sorted; NULL keys last, equal keys by a hash of the
    row.

    A near page is a top-k. For a far one the rows before the offset are left out by rank
    selection on the same order, so no task ever merges the skipped rows. Of a page of very many
    rows the end becomes a filter too, so that it is sorted in many tasks and never gathered in one;
    only where the cut falls between rows that are equal as a whole it is a limit. All give the same
    page.
    """
    order = [c(key).desc_nulls_last() if descending else c(key).asc_nulls_last(), _tie(df)]
    if offset + limit <= sorted_rows:
        return df.orderBy(*order).offset(offset).limit(limit)
    number = -c(key).cast("long") if descending else c(key).cast("long")
    kept, _, left = _cut(df, df, [number], offset, buffer_rows)
    if limit > sorted_rows and not left:
        within, _, more = _cut(df, df, [number], offset + limit, buffer_rows)
        if not more:
            return df.where(within & ~kept).orderBy(*order)
    return df.where(~kept).orderBy(*order).offset(left).limit(limit)
