"""Names and payloads attached to anomaly rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlens import fixed
from auditlens.functions.payload import has_business_data, payload_amount, payload_ids
from auditlens.functions.scalars import c
from auditlens.operators.summaries import extreme_rows
from auditlens.sources.catalog import Catalog

# --- Fixed values: lookup tables, their name column and the payload keys that refer to them
LOOKUPS = {
    "dad_office": ("office_name", "fk_office_id"),
    "vendor": ("vendor_name", "fk_vendor"),
    "aaa_central_vendor": ("vendor_name", "fk_central_vendor"),
    "section": ("section_name", "fk_section"),
}


def lookup_names(df: DataFrame, id_column: str, name_column: str, name: str) -> DataFrame:
    """Id and trimmed name; blank names do not count."""
    text = F.trim(c(name_column).cast("string"))
    return df.where(c(id_column).isNotNull() & (text != "")).groupBy(
        c(id_column).cast("long").alias(f"__id_{name}")
    ).agg(F.min(text).alias(name))


def lookup_ids(df: DataFrame, keys: Sequence[str], payload: str = "payload") -> DataFrame:
    """Distinct lookup ids over all rows, per key."""
    rows = df.select(payload_ids(c(payload), keys).alias("ids"))
    pairs = F.array(*[F.struct(F.lit(k).alias("lookup"), F.col("ids")[k].alias("id")) for k in keys])
    found = rows.select(F.explode(pairs).alias("p")).select("p.*")
    return found.where(F.col("id").isNotNull()).distinct()


def enrich_names(
    df: DataFrame,
    dims: Mapping[str, DataFrame],
    *,
    payload: str = "payload",
) -> DataFrame:
    """Add resolved office, vendor and section names to the payload.

    The vendor falls back to the central vendor. A missing lookup table gives no names. The
    lookups are plain left joins: Spark broadcasts those whose size allows.
    """
    own = df.columns
    found: dict[str, Column] = {}
    df = df.withColumn("__ids", payload_ids(c(payload), [key for _, key in LOOKUPS.values()]))
    for table, (name_column, key) in LOOKUPS.items():
        if table not in dims:
            found[table] = F.lit(None).cast("string")
            continue
        name = f"__name_{table}"
        names = lookup_names(dims[table], "id", name_column, name)
        df = df.join(names, F.col("__ids")[key] == F.col(f"__id_{name}"), "left").drop(
            f"__id_{name}")
        found[table] = F.col(name)
    names = {
        "resolved_office_name": found["dad_office"],
        "resolved_vendor_name": F.coalesce(found["vendor"], found["aaa_central_vendor"]),
        "resolved_section_name": found["section"],
    }
    resolved = F.filter(
        F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in names.items()]),
        lambda e: e["value"].isNotNull())
    # Names resolved before stay unless there is a new one.
    kept = F.filter(
        F.map_entries(c(payload)),
        lambda e: ~F.coalesce(*[F.when(e["key"] == k, v.isNotNull()) for k, v in names.items()],
                              F.lit(False)))
    return df.withColumn(payload, F.map_from_entries(F.concat(kept, resolved))).select(
        *[c(n) for n in own])


def attach_payload(
    anomalies: DataFrame,
    payloads: DataFrame,
    rebuilt: DataFrame | None = None,
    *,
    id_column: str = "id",
    key_column: str = "fk_dak",
    one_page: bool = False,
) -> DataFrame:
    """Stored payload by row id; rows without business data take the rebuilt one by key.

    With ``one_page`` the caller vouches that ``payloads`` and ``rebuilt`` hold the rows of one
    page at most; these are sent to the rows instead of being shuffled.
    """
    stored = payloads.select(c(id_column), c("payload").alias("__stored"))
    if one_page:
        stored = F.broadcast(stored)
    df = anomalies.join(stored, id_column, "left")
    fallback = F.create_map(F.lit("fk_dak"), c(key_column).cast("string"))
    payload = F.coalesce(F.col("__stored"), fallback)
    if rebuilt is None:
        return df.withColumn("payload", payload).drop("__stored")
    source = rebuilt.select(c("record_key").alias("__key"), c("payload").alias("__rebuilt"))
    if one_page:
        source = F.broadcast(source)
    df = df.join(source, c(key_column) == F.col("__key"), "left")
    best = F.when(has_business_data(payload), payload).otherwise(
        F.coalesce(F.col("__rebuilt"), payload))
    return df.withColumn("payload", best).drop("__stored", "__key", "__rebuilt")


def first_row_per_key(df: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """First row of each key by an order column, NULLs last; see :func:`extreme_rows`."""
    return extreme_rows(df.where(c(key).isNotNull()), [key], [order] if order else [], first=True)


def rebuild_payload(
    keys: DataFrame, catalog: Catalog, tables: Sequence[str], key_column: str = "record_key",
    *, listed: Sequence[int] | None = None,
) -> DataFrame:
    """Payload of each wanted record key from the sources: per table the first row by id, all
    its columns as ``table.column``. Keys without any row are left out.

    ``listed`` names the keys of one page. They are then part of the filter of each source, which
    skips what holds none of them, and no source is shuffled.
    """
    out = keys.where(c(key_column) > 0).select(c(key_column).cast("long").alias("record_key"))
    out = out.distinct()
    pieces = []
    for table in tables:
        df = catalog.table(table)
        own_key = "id" if table == fixed.BASE_TABLE and "id" in df.columns else "fk_dak"
        if own_key not in df.columns:
            continue
        if listed is None:
            wanted = df.join(out, c(own_key).cast("long") == F.col("record_key"), "left_semi")
        else:
            wanted = df.where(c(own_key).isin(*listed))
        first = first_row_per_key(wanted, own_key, "id" if "id" in df.columns else None)
        piece = f"__{table}"
        cells = first.select(
            c(own_key).cast("long").alias("record_key"),
            F.map_from_arrays(
                F.array(*[F.lit(f"{table}.{n}") for n in df.columns]),
                F.array(*[c(n).cast("string") for n in df.columns]),
            ).alias(piece),
        )
        out = out.join(cells, "record_key", "left")
        pieces.append(F.coalesce(c(piece), F.create_map().cast("map<string,string>")))
    if not pieces:
        return out.select("record_key", F.create_map().cast("map<string,string>").alias(
            "payload")).where(F.lit(False))
    return out.select("record_key", F.map_concat(*pieces).alias("payload")).where(
        F.size("payload") > 0)


def reason_by_id(rows: DataFrame, id_column: str = "id", reasons: str = "sql_rule_reasons") -> DataFrame:
    """Non-blank reason text per row id; ids and reasons come from the same row, so there is
    no positional pairing to check."""
    text = F.trim(c(reasons))
    return rows.where(text != "").select(c(id_column), text.alias("reason"))


def payload_amount_total(anomalies: DataFrame, payloads: DataFrame) -> DataFrame:
    """Rows and amount over anomalies with their stored payloads."""
    amount = F.coalesce(payload_amount(F.col("payload")), F.lit(0.0)).cast("decimal(18,2)")
    joined = anomalies.select("id").join(payloads.select("id", "payload"), "id", "left")
    return joined.agg(
        F.count("*").alias("total_rows"),
        F.coalesce(F.sum(amount), F.lit(0)).cast("double").alias("total_amount"),
    )
