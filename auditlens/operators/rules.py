"""Built-in business rules: each gives a predicate, a reason and, for some, evidence.

A rule may ask how many rows of another table share its key. All such questions on the same
key are answered by one pre-aggregated table and one left join, however many rules ask.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditlens import fixed
from auditlens.functions.scalars import (
    any_of, at_night, c, has_time_of_day, safe_date, text_of,
)
from auditlens.sources.catalog import Catalog

INLINE_KEYS = 100  # related keys listed in the evidence itself; longer lists stay in pages
PAGE_KEYS = 1000  # related keys per page, on average


def status(col: Column) -> Column:
    return F.upper(F.trim(col.cast("string")))


def _name_of(*parts: str) -> str:
    return "__" + "_".join(part.replace(".", "_") for part in parts)


# --- what a rule may ask about other tables -------------------------------------------------


@dataclass(frozen=True)
class KeyCount:
    """Number of rows of ``table`` whose ``column`` equals the joined column ``key``."""

    key: str
    table: str
    column: str
    label: str = "rows"
    condition: Column | None = field(default=None, compare=False)

    @property
    def name(self) -> str:
        return _name_of(self.table, self.column, self.label)

    def value(self) -> Column:
        return F.coalesce(F.col(self.name), F.lit(0))


@dataclass(frozen=True)
class DuplicateKeys:
    """Invoice number and date that at least two rows of a table share with status V."""

    table: str
    invoice: str
    date: str = "invoice_date"
    status: str = "record_status"
    related: str | None = "fk_dak"

    @property
    def name(self) -> str:
        return _name_of("duplicates", self.table)


@dataclass(frozen=True)
class Rule:
    reason: str
    predicate: Column
    counts: tuple[KeyCount, ...] = ()
    duplicates: DuplicateKeys | None = None
    evidence: Column | None = None


def status_counts(df: DataFrame, key: str, status_column: str, statuses: Sequence[str]) -> DataFrame:
    """Rows per non-null key, all of them and those in one of the statuses."""
    return df.where(c(key).isNotNull()).groupBy(c(key)).agg(
        F.count("*").alias("total_count"),
        F.count_if(status(c(status_column)).isin(*statuses)).alias("status_count"),
    )


def approved_counts(df: DataFrame, key: str, status_column: str, approved: str) -> DataFrame:
    """Approved rows with status V per non-null key."""
    return df.where(c(key).isNotNull()).groupBy(c(key)).agg(
        F.count_if((status(c(status_column)) == "V") & c(approved)).alias("approved_count")
    )


def key_counts(catalog: Catalog, counts: Sequence[KeyCount]) -> DataFrame:
    """One table with all counts on one key: union of the sources, then a single grouping."""
    sources: dict[tuple[str, str], list[KeyCount]] = {}
    for count in counts:
        sources.setdefault((count.table, count.column), []).append(count)
    stacked = None
    for (table, column), wanted in sources.items():
        here = {w.name: w for w in wanted}
        rows = catalog.table(table).where(c(column).isNotNull()).select(
            c(column).alias("__key"),
            *[
                (F.lit(0) if k.name not in here
                 else F.lit(1) if k.condition is None
                 else F.when(k.condition, 1).otherwise(0)).alias(k.name)
                for k in counts
            ],
        )
        stacked = rows if stacked is None else stacked.unionByName(rows)
    return stacked.groupBy("__key").agg(*[F.sum(k.name).alias(k.name) for k in counts])


# --- duplicate invoices -----------------------------------------------------------------------


def _marked_invoices(
    df: DataFrame, keys: DuplicateKeys, wanted: DataFrame | None = None
) -> DataFrame:
    """Rows with status V and an invoice key that two or more of them share, one per distinct
    related key, with counts; ``wanted`` (invoice_number, invoice_date) leaves other invoices out.

    Rows are counted by invoice first, so only those of duplicates, mostly few, are told apart by
    their related key; grouping by that key as well spreads a hot invoice over many tasks.
    """
    day = safe_date(c(keys.date), df.schema[keys.date].dataType)
    related = text_of(c(keys.related), df.schema[keys.related].dataType) if keys.related else (
        F.lit(None).cast("string")
    )
    rows = df.where(status(c(keys.status)) == "V").select(
        c(keys.invoice).alias("invoice_key"), day.alias("invoice_date_key"),
        related.alias("related_key"),
    ).where(F.col("invoice_key").isNotNull() & F.col("invoice_date_key").isNotNull())
    if wanted is not None:
        rows = rows.join(
            wanted, (F.col("invoice_key").cast("string") == wanted["invoice_number"])
            & (F.col("invoice_date_key").cast("string") == wanted["invoice_date"]), "left_semi")
    invoice = ["invoice_key", "invoice_date_key"]
    twice = rows.groupBy(*invoice).agg(F.count("*").alias("rows")).where("rows >= 2").select(*invoice)
    return rows.join(twice.hint("shuffle_hash"), invoice, "left_semi").groupBy(*invoice, "related_key").agg(
        F.count("*").alias("rows"))


def duplicate_keys(df: DataFrame, keys: DuplicateKeys) -> DataFrame:
    """Invoice keys with two or more V rows: their row count and distinct related keys."""
    return (
        _marked_invoices(df, keys)
        .groupBy("invoice_key", "invoice_date_key")
        .agg(F.sum("rows").alias("duplicate_count"),
             F.count("related_key").alias("related_key_count"))
        .where(F.col("duplicate_count") >= 2)
    )


def related_keys(
    df: DataFrame, keys: DuplicateKeys, wanted: DataFrame | None = None
) -> DataFrame:
    """All related keys of all duplicate invoices, or of the ``wanted`` ones among them, one row
    each: a shape that holds for groups of any size. The hot side of the join is split, as both
    sides are plain exchanges."""
    return _marked_invoices(df, keys, wanted).where(F.col("related_key").isNotNull()).select(
        F.lit(keys.table).alias("table"), F.col("invoice_key").cast("string").alias("invoice_number"),
        F.col("invoice_date_key").cast("string").alias("invoice_date"), "related_key")


def related_key_pages(
    df: DataFrame, keys: DuplicateKeys, *, page_keys: int = PAGE_KEYS
) -> DataFrame:
    """All related keys of all duplicate invoices, in sorted pages of bounded size.

    A group of up to ``page_keys`` keys is one page. Larger groups are divided by a hash of
    the related key, so that no task or cell ever holds a whole group.
    """
    groups = duplicate_keys(df, keys)
    pages = F.greatest(F.ceil(F.col("related_key_count") / page_keys), F.lit(1))
    return (
        _marked_invoices(df, keys)
        .where(F.col("related_key").isNotNull())
        .join(groups, ["invoice_key", "invoice_date_key"])
        .withColumn("pages", pages)
        .withColumn("page", F.pmod(F.xxhash64("related_key"), F.col("pages")))
        .groupBy("invoice_key", "invoice_date_key", "duplicate_count", "pages", "page")
        .agg(F.array_sort(F.collect_list("related_key")).alias("related_keys"))
    )


def duplicate_invoices(
    df: DataFrame, keys: DuplicateKeys, *, inline_keys: int = INLINE_KEYS
) -> DataFrame:
    """Duplicate invoice keys with their related keys, listed while there are few.

    Beyond ``inline_keys`` the list is NULL here; :func:`related_keys` holds every key, and a run
    stores them beside its anomalies.
    """
    groups = duplicate_keys(df, keys)
    # NULL keys are left out by the list itself: a filter would go down to the rows, which would
    # then be read and counted once for the groups and once for the lists.
    lists = (
        _marked_invoices(df, keys)
        .join(groups.where(F.col("related_key_count").between(1, inline_keys)),
              ["invoice_key", "invoice_date_key"], "left_semi")
        .groupBy("invoice_key", "invoice_date_key")
        .agg(F.array_sort(F.collect_list("related_key")).alias("related_keys"))
    )
    return groups.join(lists, ["invoice_key", "invoice_date_key"], "left")


def duplicate_evidence(keys: DuplicateKeys, invoice: Column, day: Column, found: Column) -> Column:
    """Evidence record of a duplicate invoice."""
    return F.struct(
        F.lit(fixed.DUPLICATE_EVIDENCE_KIND).alias("kind"),
        F.lit(keys.table).alias("table"),
        F.lit(keys.invoice).alias("invoice_column"),
        invoice.cast("string").alias("invoice_number"),
        day.cast("string").alias("invoice_date"),
        F.lit("V").alias("record_status"),
        found["duplicate_count"].alias("duplicate_count"),
        found["related_keys"].alias("similar_fk_daks"),
        found["related_key_count"].alias("similar_fk_dak_count"),
    )


# --- the rules --------------------------------------------------------------------------------


def missing_reference(
    key: str, other: str, other_key: str, scope: Column, reason: str
) -> Rule:
    """In scope, with a reference that the other table does not have."""
    found = KeyCount(key, other, other_key)
    return Rule(reason, c(key).isNotNull() & scope & (found.value() == 0), (found,))


def mode_conflict(key: str, mode: str, other: str, other_key: str, reason: str) -> Rule:
    """Payment mode 1, yet the other table has the record."""
    found = KeyCount(key, other, other_key)
    return Rule(reason, (c(mode) == 1) & c(key).isNotNull() & (found.value() > 0), (found,))


def unapproved_with_children(
    key: str, own_status: str, approved: str, child: str, child_key: str, reason: str
) -> Rule:
    children = KeyCount(key, child, child_key)
    hit = (
        (status(c(own_status)) == "V") & (c(approved) == F.lit(False))
        & c(key).isNotNull() & (children.value() > 0)
    )
    return Rule(reason, hit, (children,))


def count_mismatch(
    key: str,
    own_status: str,
    approved: str,
    own: tuple[str, str, Column],
    child: tuple[str, str, Column],
    reason: str,
) -> Rule:
    """Approved V rows per key against child rows per key; each side is
    ``(table, key column, condition)``."""
    mine = KeyCount(key, own[0], own[1], "approved", own[2])
    theirs = KeyCount(key, child[0], child[1], "active", child[2])
    hit = (
        (status(c(own_status)) == "V") & (c(approved) == F.lit(True))
        & c(key).isNotNull() & (mine.value() != theirs.value())
    )
    return Rule(reason, hit, (mine, theirs))


def approved_without_owner(approved: str, owners: Sequence[str], reason: str) -> Rule:
    hit = c(approved) == F.lit(True)
    for owner in owners:
        hit = hit & c(owner).isNull()
    return Rule(reason, hit)


def duplicate_invoice(keys: DuplicateKeys, schema: T.StructType) -> Rule:
    invoice, day_name = c(f"{keys.table}.{keys.invoice}"), f"{keys.table}.{keys.date}"
    day = safe_date(c(day_name), schema[day_name].dataType)
    found = F.col(keys.name)
    hit = (
        invoice.isNotNull() & day.isNotNull()
        & (status(c(f"{keys.table}.{keys.status}")) == "V")
        & (F.coalesce(found["duplicate_count"], F.lit(0)) >= 2)
    )
    reason = fixed.REASON_DUPLICATE_INVOICE.format(table=keys.table, invoice=keys.invoice)
    return Rule(reason, hit, duplicates=keys,
                evidence=F.when(hit, duplicate_evidence(keys, invoice, day, found)))


@dataclass(frozen=True)
class StageColumn:
    name: str
    table: str
    scope: str


def stage_columns(columns: Sequence[str], aliases: Sequence[str]) -> list[StageColumn]:
    """Joined columns that carry a stage: named like an alias, or ending in ``_alias``; what
    comes before the alias is the scope."""
    found = []
    for full in columns:
        table, _, plain = full.partition(".")
        plain = plain.strip().lower()
        for alias in aliases:
            if plain == alias or plain.endswith(f"_{alias}"):
                scope = plain[: -len(alias) - 1] if plain != alias else ""
                found.append(StageColumn(full, table, scope))
                break
    return found


def _comparable(a: StageColumn, b: StageColumn) -> bool:
    return a.scope == b.scope if a.scope or b.scope else a.table == b.table


def date_sequence(schema: T.StructType, stages=fixed.DATE_STAGES) -> list[Rule]:
    """One rule per pair of neighbouring stages that are present: the later one is earlier."""
    present = [(s, cols) for s, names in stages if (cols := stage_columns(schema.names, names))]
    rules = []
    for (left_name, left), (right_name, right) in zip(present, present[1:]):
        pairs = [(a.name, b.name) for a in left for b in right if _comparable(a, b)]
        if pairs:
            late = any_of(
                F.coalesce(safe_date(c(a), schema[a].dataType) > safe_date(c(b), schema[b].dataType),
                           F.lit(False))
                for a, b in pairs
            )
            rules.append(
                Rule(f"{fixed.REASON_DATE_SEQUENCE}: {left_name} after {right_name}", late)
            )
    return rules


def night_activity(schema: T.StructType, clock_columns: Sequence[str] = ()) -> list[Rule]:
    """One rule per column with a time of day; ``clock_columns`` hold times as text."""
    return [
        Rule(f"{fixed.REASON_NIGHT}: {f.name}",
             at_night(c(f.name), f.dataType, clock_text=f.name in clock_columns))
        for f in schema
        if has_time_of_day(f.dataType) or f.name in clock_columns
    ]


def builtin_rules(
    catalog: Catalog, schema: T.StructType, tables: Sequence[str],
    clock_columns: Sequence[str] = (),
) -> list[Rule]:
    """Rules that apply to the joined tables, in their fixed order. A rule whose columns are
    missing is left out."""
    names = set(schema.names)

    def has(*columns: str) -> bool:
        return names.issuperset(columns)

    def other_has(table: str, *columns: str) -> bool:
        return table in tables and set(catalog.table(table).columns).issuperset(columns)

    rules: list[Rule] = []
    slip_key, slip_status, approved = (
        "cheque_slip.fk_dak", "cheque_slip.record_status", "cheque_slip.approved")
    if has("cmp_scroll.payment_reference_no", "cmp_scroll.cda_name") and other_has(
            "ecs", "payment_reference_no"):
        rules.append(missing_reference(
            "cmp_scroll.payment_reference_no", "ecs", "payment_reference_no",
            c("cmp_scroll.cda_name") == fixed.SCROLL_SCOPE_VALUE, fixed.REASON_MISSING_REFERENCE))
    if has(slip_key, "cheque_slip.fk_ecs_payment_mode") and other_has("ecs", "fk_dak"):
        rules.append(mode_conflict(
            slip_key, "cheque_slip.fk_ecs_payment_mode", "ecs", "fk_dak",
            fixed.REASON_MODE_CONFLICT))
    if has(slip_key, slip_status, approved) and other_has("schedule3", "fk_dak", "record_status"):
        rules += slip_schedule_rules(slip_key, slip_status, approved)
    if has(approved):
        owners = [f"cheque_slip.{o}" for o in fixed.OWNER_COLUMNS if has(f"cheque_slip.{o}")]
        if owners:
            shown = ", ".join(o.split(".")[1] for o in owners)
            rules.append(
                approved_without_owner(approved, owners, f"{fixed.REASON_NO_OWNER}: {shown}"))
    for table in tables:
        keys = duplicate_key_columns(catalog, table)
        if keys and has(f"{table}.{keys.invoice}", f"{table}.{keys.date}"):
            rules.append(duplicate_invoice(keys, schema))
    return rules + date_sequence(schema) + night_activity(schema, clock_columns)


def slip_schedule_rules(key: str, own_status: str, approved: str) -> list[Rule]:
    """Cheque slip against schedule: children of unapproved slips, and unequal counts."""
    signed = (status(c("record_status")) == "V") & c("approved")
    active = status(c("record_status")).isin("P", "V")
    return [
        unapproved_with_children(key, own_status, approved, "schedule3", "fk_dak",
                                 fixed.REASON_UNAPPROVED_WITH_CHILDREN),
        count_mismatch(key, own_status, approved, ("cheque_slip", "fk_dak", signed),
                       ("schedule3", "fk_dak", active), fixed.REASON_COUNT_MISMATCH),
    ]


def duplicate_key_columns(catalog: Catalog, table: str) -> DuplicateKeys | None:
    columns = catalog.table(table).columns
    invoice = next((n for n in fixed.INVOICE_COLUMNS if n in columns), None)
    if invoice is None or not {"invoice_date", "record_status"}.issubset(columns):
        return None
    return DuplicateKeys(table, invoice, related="fk_dak" if "fk_dak" in columns else None)


# --- combination ------------------------------------------------------------------------------


def with_rule_inputs(df: DataFrame, catalog: Catalog, rules: Sequence[Rule]) -> DataFrame:
    """Join the counts and duplicate groups that the rules refer to."""
    by_key: dict[str, dict[str, KeyCount]] = {}
    for rule in rules:
        for count in rule.counts:
            by_key.setdefault(count.key, {})[count.name] = count
    for key, counts in by_key.items():
        facts = key_counts(catalog, list(counts.values()))
        df = df.join(facts, c(key) == F.col("__key"), "left").drop("__key")
    for keys in dict.fromkeys(r.duplicates for r in rules if r.duplicates):
        groups = duplicate_invoices(catalog.table(keys.table), keys).select(
            F.col("invoice_key").alias("__invoice"), F.col("invoice_date_key").alias("__day"),
            F.struct("duplicate_count", "related_keys", "related_key_count").alias(keys.name),
        )
        day = f"{keys.table}.{keys.date}"
        # Invoices are unique there and lists bounded, so hash tables are even; rows need no sort.
        df = df.join(
            groups.hint("shuffle_hash"),
            (c(f"{keys.table}.{keys.invoice}") == F.col("__invoice"))
            & (safe_date(c(day), df.schema[day].dataType) == F.col("__day")),
            "left",
        ).drop("__invoice", "__day")
    return df


def apply_rules(
    df: DataFrame,
    catalog: Catalog,
    rules: Sequence[Rule],
    *,
    flag_column: str = "sql_rule_flag",
    reasons_column: str = "sql_rule_reasons",
    evidence_column: str = "sql_rule_evidence",
) -> DataFrame:
    """Flag rows that any rule hits, with the reasons in rule order and the evidence records."""
    own = df.columns
    evidence = [r.evidence for r in rules if r.evidence is not None]
    reasons = [F.when(r.predicate, F.lit(r.reason)) for r in rules]
    results = {
        flag_column: F.coalesce(any_of(r.predicate for r in rules), F.lit(False)),
        reasons_column: F.array_compact(F.array(*reasons)) if reasons
        else F.array().cast("array<string>"),
        evidence_column: F.array_compact(F.array(*evidence)) if evidence
        else F.lit(None).cast(EVIDENCE_TYPE),
    }
    wide = with_rule_inputs(df, catalog, rules)
    return wide.select(*[c(n) for n in own], *[v.alias(n) for n, v in results.items()])


EVIDENCE_TYPE = (
    "array<struct<kind:string,`table`:string,invoice_column:string,invoice_number:string,"
    "invoice_date:string,record_status:string,duplicate_count:bigint,"
    "similar_fk_daks:array<string>,similar_fk_dak_count:bigint>>"
)


def exclude_rule_rows(df: DataFrame, catalog: Catalog, rules: Sequence[Rule]) -> DataFrame:
    """Rows for which no rule holds. Unknown counts as excluded, as ``WHERE NOT`` does."""
    if not rules:
        return df
    own = df.columns
    hit = rules[0].predicate
    for rule in rules[1:]:
        hit = hit | rule.predicate
    return with_rule_inputs(df, catalog, rules).where(~hit).select(*[c(n) for n in own])


def training_rules(catalog: Catalog, schema: T.StructType, dataset: str) -> list[Rule]:
    """Rules whose rows are kept out of training: count rules for the schedule dataset, and
    the owner rule wherever cheque slips are joined."""
    tables = fixed.DATASETS[dataset]
    applicable = builtin_rules(catalog, schema, tables)
    wanted = [fixed.REASON_NO_OWNER]
    if "schedule3" in tables:
        wanted += [fixed.REASON_UNAPPROVED_WITH_CHILDREN, fixed.REASON_COUNT_MISMATCH]
    return [r for r in applicable if r.reason.startswith(tuple(wanted))]


def split_rule_columns(
    df: DataFrame, flag_column: str, reasons_column: str, prefix: str = "default"
) -> DataFrame:
    """Flag without NULLs, and a default reason where a flag has no reason column."""
    hit = F.coalesce(c(flag_column).cast("boolean"), F.lit(False)) if flag_column in df.columns \
        else F.lit(False)
    reason = c(reasons_column) if reasons_column in df.columns else F.when(
        hit, F.lit(fixed.REASON_DEFAULT_RULE))
    others = [c(n) for n in df.columns if n not in (flag_column, reasons_column)]
    return df.select(
        *others, hit.alias(f"{prefix}_rule_flag"), reason.alias(f"{prefix}_rule_reasons"))


def parse_evidence(text: Column) -> Column:
    """Evidence kept as text, one JSON object per line, back into records. The list of related
    keys is comma separated text there; lines that are not objects are left out."""
    line_type = (
        "struct<kind:string,`table`:string,invoice_column:string,invoice_number:string,"
        "invoice_date:string,record_status:string,duplicate_count:bigint,similar_fk_daks:string>"
    )
    lines = F.filter(
        F.transform(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), lambda line: F.trim(line)),
        lambda line: line.startswith("{") & line.endswith("}"),
    )
    parsed = F.transform(lines, lambda line: F.from_json(line, line_type))

    def record(item: Column) -> Column:
        listed = F.transform(F.split(item["similar_fk_daks"], ","), lambda k: F.trim(k))
        keys = F.filter(listed, lambda k: k != "")
        fields = ["kind", "table", "invoice_column", "invoice_number", "invoice_date",
                  "record_status", "duplicate_count"]
        return F.struct(*[item[n].alias(n) for n in fields], keys.alias("similar_fk_daks"))

    return F.transform(F.filter(parsed, lambda item: item.isNotNull()), record)
