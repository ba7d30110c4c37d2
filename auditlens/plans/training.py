"""Training flow of one dataset: join, window, rule exclusion, cleaning, features, forest."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditlens import fixed
from auditlens.functions.scalars import c, family, norm_bool
from auditlens.model.forest import (
    ForestParams, collect_forest, fit_forest, score_column, score_threshold,
)
from auditlens.model.io import Contract, Model
from auditlens.model.preprocess import fit_preprocessor
from auditlens.operators.cleaning import (
    coerce_dates, drop_bad_sequence, drop_night, drop_void_duplicates, filter_columns,
    gap_features, gap_name, invoice_keys, night_columns, select_features, stage_pairs, stage_plan,
)
from auditlens.operators.filters import training_window
from auditlens.operators.joins import training_join
from auditlens.operators.ordering import first_rows
from auditlens.operators.projection import with_model_names
from auditlens.operators.rules import exclude_rule_rows, training_rules
from auditlens.session import hash_joins
from auditlens.sources.catalog import Catalog
from auditlens.sources.staging import spread, stage


@dataclass(frozen=True)
class TrainingOptions:
    from_date: str | None = None
    cutoff: str = fixed.TRAINING_CUTOFF
    max_rows: int = 0  # 0 trains on every row; else the first ones by date and ids
    null_limit: float = fixed.NULL_PERCENT_LIMIT
    text_limit: int = fixed.VARCHAR_LIMIT
    category_limit: int = fixed.CATEGORY_LIMIT
    text_columns: Sequence[str] = ()
    forest: ForestParams = field(default_factory=ForestParams)


def windowed(catalog: Catalog, dataset: str, options: TrainingOptions) -> Catalog:
    """Catalog whose base table is cut to the training window, before any join."""
    base = fixed.DATASETS[dataset][0]
    lower = options.from_date or fixed.TRAINING_LOWER_BOUNDS.get(dataset)
    return Catalog({**catalog, base: training_window(catalog.table(base), lower, options.cutoff)})


def training_source(catalog: Catalog, dataset: str, options: TrainingOptions) -> DataFrame:
    """Joined rows in the window without the rows that rules exclude."""
    joined = training_join(windowed(catalog, dataset, options), dataset)
    return exclude_rule_rows(joined, catalog, training_rules(catalog, joined.schema, dataset))


def training_count(catalog: Catalog, dataset: str, options: TrainingOptions) -> DataFrame:
    """Rows in the window. Only the owner rule is taken off here, so the number differs from
    the training rows where other rules exclude more."""
    joined = training_join(windowed(catalog, dataset, options), dataset)
    rules = [r for r in training_rules(catalog, joined.schema, dataset)
             if r.reason.startswith(fixed.REASON_NO_OWNER)]
    return exclude_rule_rows(joined, catalog, rules).agg(F.count("*").alias("row_count"))


def training_order(columns: Sequence[str], tables: Sequence[str]) -> list[str]:
    base = tables[0]
    wanted = [f"{base}.list_date", f"{base}.id"]
    if "cheque_slip" in tables:
        wanted += [f"{t}.id" for t in ("cheque_slip", "schedule3") if t in tables]
    return [n for n in wanted if n in columns]


def training_sample(df: DataFrame, order: Sequence[str], max_rows: int) -> DataFrame:
    """The first rows by date and ids after rule exclusion; 0 keeps all."""
    return first_rows(df, order, max_rows) if max_rows > 0 else df


COPIES_AT_ONCE = 10_000


def with_content_ids(features: DataFrame) -> DataFrame:
    """The rows with a ``row_id`` that depends on their values alone, so that another run or
    another layout of the files gives the same ids, samples and trees.

    Equal rows cannot be told apart; they are counted (with map-side combine) and numbered from
    the count where they are. Of more than a few thousand copies each lot is sent to a place of its
    own, so that no task holds all copies of one row.
    """
    counted = features.groupBy(*[c(n) for n in features.columns]).agg(F.count("*").alias("__copies"))
    few = counted.where(F.col("__copies") <= COPIES_AT_ONCE).withColumn(
        "__copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__copies") - 1)))
    lots = counted.where(F.col("__copies") > COPIES_AT_ONCE).withColumn("__lot", F.explode(F.sequence(
        F.lit(0), F.floor((F.col("__copies") - 1) / COPIES_AT_ONCE))))
    first = F.col("__lot") * COPIES_AT_ONCE
    last = F.least(first + COPIES_AT_ONCE, F.col("__copies")) - 1
    many = lots.repartition("__lot", *[c(n) for n in features.columns]).withColumn(
        "__copy", F.explode(F.sequence(first, last))).drop("__lot")
    return few.unionByName(many).select(
        *[c(n) for n in features.columns],
        F.xxhash64(*[c(n) for n in features.columns], F.col("__copy")).alias("row_id"))


def train_dataset(
    catalog: Catalog, dataset: str, options: TrainingOptions = TrainingOptions()
) -> Model:
    """Train one dataset and report the row counts of each step."""
    tables = list(fixed.DATASETS[dataset])
    source = training_source(catalog, dataset, options)
    with hash_joins(source.sparkSession):
        source_count = training_count(catalog, dataset, options).first()[0]
        order = training_order(source.columns, tables)
        raw = stage(with_model_names(training_sample(source, order, options.max_rows)), "training-raw")
        return train_frame(raw, dataset, tables, options, source_count)


def train_frame(
    raw: DataFrame, dataset: str, tables: Sequence[str], options: TrainingOptions,
    source_count: int | None = None,
) -> Model:
    """Train on a staged raw frame with ``table_column`` names."""
    spark = raw.sparkSession
    counts = {"source": source_count, "queried": raw.count()}
    keys = invoice_keys(raw.columns, tables)
    # Written once: the column checks, the counts and the features read it, without the join.
    no_void = stage(drop_void_duplicates(raw, keys), "training-valid") if keys else raw
    cleaned, dropped = filter_columns(
        no_void, null_limit=options.null_limit, text_limit=options.text_limit,
        text_columns=options.text_columns)
    dates = [f.name for f in cleaned.schema if family(f.dataType) == "datetime"]
    nights = night_columns(cleaned.schema)
    pairs = stage_pairs(stage_plan(cleaned.columns, tables))
    dated = coerce_dates(cleaned, dates)
    day = drop_night(dated, nights)
    ordered = drop_bad_sequence(day, pairs)
    wide = gap_features(ordered, pairs, dates)

    chosen = select_features(wide, options.category_limit, options.text_columns)
    if not chosen.inputs:
        raise ValueError(f"No usable feature columns for dataset {dataset}.")
    booleans = {n: norm_bool(c(n)) for n in chosen.boolean}
    ready = wide.withColumns(booleans) if booleans else wide
    # The same rows as ``ready``, written once: with their ids, which the forest needs.
    numbered = stage(with_content_ids(ready.select(*[c(n) for n in chosen.inputs])), "training-features")
    features = numbered.drop("row_id")
    total = numbered.count()
    counts.update(after_invoices=no_void.count(), after_night=day.count() if pairs else total,
                  after_sequence=total, training=total)

    preprocessor = fit_preprocessor(features, chosen)
    vectors = spread(numbered, numbered.select("row_id", preprocessor.vector().alias("features")))
    grown = fit_forest(vectors, total, options.forest)
    trees = collect_forest(grown)
    tree_rows = min(options.forest.tree_rows, total)
    scored = stage(
        vectors.select(score_column(spark, trees, tree_rows, F.col("features")).alias("score")),
        "training-scores")
    threshold = score_threshold(scored, options.forest.contamination)
    counts["anomalies"] = scored.where(F.col("score") > threshold).count()
    counts["inliers"] = total - counts["anomalies"]

    contract = Contract(
        raw_columns=raw.columns, cleaned_columns=cleaned.columns, date_columns=dates,
        invoice_keys=keys, stage_pairs=pairs, night_columns=nights,
        boolean_columns=chosen.boolean, feature_columns=chosen.inputs)
    report = {
        **counts,
        "raw_columns": len(raw.columns), "cleaned_columns": len(cleaned.columns),
        "feature_columns": len(chosen.inputs), "model_features": len(preprocessor.features()),
        "high_null_columns": len(dropped.high_null), "id_like_columns": len(dropped.id_like),
        "text_like_columns": len(dropped.text_like), "long_text_columns": len(dropped.long_text),
        "dropped_columns": len(dropped.all), "date_columns": len(dates),
        "date_gaps": len([p for p in pairs if gap_name(p) in chosen.numeric]),
        "unsupported_columns": len(chosen.unsupported),
    }
    return Model(dataset, list(tables), contract, preprocessor, threshold, tree_rows, trees, report)


def training_summary(models: Sequence[Model], spark) -> DataFrame:
    """One row per trained dataset: rows after each step and column counts."""
    rows = [{"dataset": m.dataset, "threshold": float(m.threshold),
             **{k: v for k, v in m.report.items()}} for m in models]
    names = list(rows[0])
    schema = T.StructType([
        T.StructField(n, T.StringType() if n == "dataset"
                      else T.DoubleType() if n == "threshold" else T.LongType()) for n in names])
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schema)


