"""A trained model: its preprocessing contract, its forest, and both on storage."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlens.functions.scalars import c, norm_bool, safe_ts
from auditlens.model.forest import TREE_TYPE, ml_flag, score_column
from auditlens.model.preprocess import Preprocessor
from auditlens.operators.cleaning import (
    InvoiceKey, _with_void_duplicates, drop_bad_sequence, drop_night, drop_void_duplicates,
    gap_features, night_hit, out_of_order,
)
from auditlens.operators.projection import to_joined_name


def looks_like_date(name: str) -> bool:
    lower = name.strip().lower()
    return "date" in lower or lower.endswith(("_at", "_time"))


@dataclass(frozen=True)
class Contract:
    """What training did to its rows and columns, to be repeated before scoring."""

    raw_columns: list[str]
    cleaned_columns: list[str]
    date_columns: list[str]
    invoice_keys: list[InvoiceKey] = field(default_factory=list)
    stage_pairs: list[tuple[str, str]] = field(default_factory=list)
    night_columns: list[str] = field(default_factory=list)
    boolean_columns: list[str] = field(default_factory=list)
    feature_columns: list[str] = field(default_factory=list)

    def to_dict(self) -> dict:
        return asdict(self)

    @classmethod
    def from_dict(cls, data: dict) -> Contract:
        return cls(**{
            **data,
            "invoice_keys": [InvoiceKey(**k) for k in data["invoice_keys"]],
            "stage_pairs": [tuple(p) for p in data["stage_pairs"]],
        })


@dataclass(frozen=True)
class Model:
    dataset: str
    tables: list[str]
    contract: Contract
    preprocessor: Preprocessor
    threshold: float
    tree_rows: int
    trees: pd.DataFrame
    report: dict = field(default_factory=dict)

    def score(self, spark: SparkSession, guard: Column | None = None) -> Column:
        """Score of a feature-frame row; rows where ``guard`` is false stay NULL."""
        vector = self.preprocessor.vector()
        if guard is not None:
            vector = F.when(guard, vector)
        return score_column(spark, self.trees, self.tree_rows, vector)

    def flag(self, score: Column) -> Column:
        return ml_flag(score, self.threshold)


def save_model(spark: SparkSession, model: Model, path: str) -> None:
    """Parameters as JSON text and trees as Parquet, below one directory."""
    params = {
        "dataset": model.dataset, "tables": model.tables, "contract": model.contract.to_dict(),
        "preprocessor": model.preprocessor.to_dict(), "threshold": model.threshold,
        "tree_rows": model.tree_rows, "report": model.report,
    }
    text = spark.createDataFrame([(json.dumps(params),)], "value string")
    text.coalesce(1).write.mode("overwrite").text(f"{path}/params")
    spark.createDataFrame(model.trees, TREE_TYPE).write.mode("overwrite").parquet(
        f"{path}/forest_nodes")


def load_model(spark: SparkSession, path: str) -> Model:
    params = json.loads(spark.read.text(f"{path}/params").first()[0])
    trees = spark.read.parquet(f"{path}/forest_nodes").orderBy("tree").toPandas()
    return Model(
        params["dataset"], params["tables"], Contract.from_dict(params["contract"]),
        Preprocessor.from_dict(params["preprocessor"]), params["threshold"],
        params["tree_rows"], trees, params["report"],
    )


def to_model_frame(df: DataFrame, contract: Contract, keep: Sequence[str] = ()) -> DataFrame:
    """Model columns of a joined frame under their model names; missing ones are NULL."""
    present = set(df.columns)
    joined = {raw: to_joined_name(raw) for raw in contract.raw_columns}
    if not present.intersection(joined.values()):
        raise ValueError("The data has none of the columns that the saved model expects.")
    return df.select(
        *[c(k) for k in keep],
        *[(c(full) if full in present else F.lit(None).cast("string")).alias(raw)
          for raw, full in joined.items()],
    )


def _as_model_types(df: DataFrame, contract: Contract, keep: Sequence[str]) -> DataFrame:
    dates = [n for n in contract.date_columns if n in contract.cleaned_columns
             and looks_like_date(n)]
    return df.select(*[c(k) for k in keep], *[
        (safe_ts(c(n), df.schema[n].dataType) if n in dates else c(n)).alias(n)
        for n in contract.cleaned_columns
    ])


def _checks(df: DataFrame, contract: Contract):
    have = set(df.columns)
    invoices = [k for k in contract.invoice_keys if {k.invoice, k.date, k.status} <= have]
    pairs = [p for p in contract.stage_pairs if set(p) <= have]
    nights = [n for n in contract.night_columns if n in have]
    return invoices, pairs, nights


def _features(df: DataFrame, contract: Contract, keep: Sequence[str]) -> DataFrame:
    pairs = [p for p in contract.stage_pairs if set(p) <= set(df.columns)]
    wide = gap_features(df, pairs)
    booleans = {n: norm_bool(c(n)) for n in contract.boolean_columns if n in wide.columns}
    wide = wide.withColumns(booleans) if booleans else wide
    return wide.select(*[c(k) for k in keep], *[
        (c(n) if n in wide.columns else F.lit(None).cast("double")).alias(n)
        for n in contract.feature_columns
    ])


def apply_contract(df: DataFrame, contract: Contract, keep: Sequence[str] = ()) -> DataFrame:
    """Clean a model frame as in training and return its feature columns. Rows that training
    would have dropped are dropped here too."""
    typed = _as_model_types(df, contract, keep)
    invoices, pairs, nights = _checks(typed, contract)
    kept = drop_void_duplicates(typed, invoices) if invoices else typed
    kept = drop_bad_sequence(kept, pairs) if pairs else kept
    kept = drop_night(kept, nights) if nights else kept
    return _features(kept, contract, keep)


def mark_contract(
    df: DataFrame, contract: Contract, keep: Sequence[str], name: str = "__dropped"
) -> DataFrame:
    """Like :func:`apply_contract`, but rows stay and are marked instead of dropped."""
    typed = _as_model_types(df, contract, keep)
    invoices, pairs, nights = _checks(typed, contract)
    marked, names = _with_void_duplicates(typed, invoices)
    hits = [*[c(n) for n in names], *[out_of_order(p) for p in pairs],
            *[night_hit(marked, n) for n in nights]]
    dropped = hits[0] if hits else F.lit(False)
    for hit in hits[1:]:
        dropped = dropped | hit
    return _features(marked.withColumn(name, dropped).drop(*names), contract, [*keep, name])


def feature_frame(df: DataFrame, model: Model, keep: Sequence[str] = ()) -> DataFrame:
    """Feature columns of a joined frame, ready to score."""
    if not model.contract.feature_columns:
        raise ValueError("The saved model does not list any feature columns.")
    return apply_contract(to_model_frame(df, model.contract, keep), model.contract, keep)
