"""Tables by logical name."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from auditlens.functions.scalars import family


class Catalog(dict[str, DataFrame]):
    """Logical table name to DataFrame. Nothing is read until a query runs."""

    @classmethod
    def from_parquet(cls, spark: SparkSession, paths: Mapping[str, str]) -> Catalog:
        return cls({name: spark.read.parquet(path) for name, path in paths.items()})

    @classmethod
    def from_tables(cls, spark: SparkSession, names: Mapping[str, str]) -> Catalog:
        """Tables of the Spark catalog, bucketed ones included (joins on the bucket key then
        need no shuffle)."""
        return cls({name: spark.table(table) for name, table in names.items()})

    @classmethod
    def from_jdbc(
        cls, spark: SparkSession, names: Mapping[str, str], **options: str
    ) -> Catalog:
        """Database tables; pass ``partitionColumn`` and bounds to read them in parallel."""
        reader = spark.read.format("jdbc").options(**options)
        return cls({name: reader.option("dbtable", table).load() for name, table in names.items()})

    def table(self, name: str) -> DataFrame:
        if name not in self:
            raise ValueError(f"Table not found: {name}")
        return self[name]


def read_csv_source(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None
) -> DataFrame:
    """CSV with a header. A schema saves the extra pass that inferring one costs.

    A column named ``SET`` is an export artefact and is left out.
    """
    reader = spark.read.option("header", True)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    frame = reader.csv(path)
    return frame.drop("SET") if "SET" in frame.columns else frame


def merged_schema(catalog: Catalog, tables: list[str]) -> DataFrame:
    """One row per column of the tables, in table then column order."""
    spark = catalog.table(tables[0]).sparkSession
    rows = [
        (table, field.name, f"{table}_{field.name}", family(field.dataType))
        for table in tables
        for field in catalog.table(table).schema
    ]
    return spark.createDataFrame(
        rows, "source_table string, column_name string, model_column string, family string"
    )
