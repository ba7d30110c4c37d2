"""Column profiles: what is usual in a set of rows. Aggregation buffers have fixed size,
except the exact percentiles, which :mod:`auditlens.operators.ordering` bounds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlens import fixed
from auditlens.functions.scalars import c, float_of, safe_num
from auditlens.functions.texts import strip_blanks
from auditlens.operators.ordering import BUFFER_ROWS, exact_percentiles


def _rows(df: DataFrame, columns: Sequence[str], measures, key: str = "column_name") -> DataFrame:
    """One output row per column from a single aggregation; ``measures(name)`` names them."""
    wanted = {n: measures(n) for n in columns}
    totals = df.agg(*[
        value.alias(f"m{i}_{name}")
        for i, n in enumerate(columns) for name, value in wanted[n].items()
    ])
    rows = F.array(*[
        F.struct(F.lit(n).alias(key), *[F.col(f"m{i}_{m}").alias(m) for m in wanted[n]])
        for i, n in enumerate(columns)
    ])
    return totals.select(F.explode(rows).alias("r")).select("r.*")


def missing_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Present and missing counts and ratios per column."""
    counts = _rows(df, columns, lambda n: {
        "total_count": F.count("*"), "present_count": F.count(c(n)),
        "missing_count": F.count_if(c(n).isNull()),
    })
    return counts.select(
        "*",
        F.try_divide("present_count", "total_count").alias("present_ratio"),
        F.try_divide("missing_count", "total_count").alias("missing_ratio"),
    )


def category_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count and share of each value per column, values compared trimmed and in lower case."""
    pairs = F.array(*[
        F.struct(F.lit(n).alias("column_name"),
                 F.lower(strip_blanks(c(n).cast("string"))).alias("category"))
        for n in columns
    ])
    counts = (
        df.select(F.explode(pairs).alias("p")).groupBy("p.column_name", "p.category")
        .agg(F.count("*").alias("match_count"))
    )
    totals = counts.groupBy("column_name").agg(F.sum("match_count").alias("total_count"))
    return (
        counts.where(F.col("category").isNotNull())
        .join(totals, "column_name")
        .withColumn("match_ratio", F.col("match_count") / F.col("total_count"))
    )


def spelled_true(df: DataFrame, column: str) -> Column:
    """Numbers from 0.5 and words that say true; NULL and everything else is false."""
    text = c(column).cast("string")
    number = float_of(text)
    word = F.lower(strip_blanks(text)).isin("true", "1", "yes")
    return F.coalesce(F.when(number.isNotNull(), number >= 0.5).otherwise(word), F.lit(False))


def boolean_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """True and false counts and ratios per column; NULL counts as false."""
    counts = _rows(df, columns, lambda n: {
        "total_count": F.count("*"), "true_count": F.count_if(spelled_true(df, n)),
        "false_count": F.count_if(~spelled_true(df, n)),
    })
    return counts.select(
        "*",
        F.try_divide("true_count", "total_count").alias("true_ratio"),
        F.try_divide("false_count", "total_count").alias("false_ratio"),
    )


def is_binary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Whether a column holds at most two of the spellings of true and false, and no other
    value. Each spelling is one bit, so the buffer does not grow with the data."""
    words = list(fixed.BINARY_WORDS)

    def measures(name: str) -> dict[str, Column]:
        text = F.lower(strip_blanks(c(name).cast("string")))
        number = float_of(text)
        bit = F.when(number == 0, 1).when(number == 1, 2)
        for i, word in enumerate(words):
            value = {"true": 2, "false": 1}.get(word) if name in booleans else None
            bit = bit.when(text == word, value or 4 << i)
        return {
            "seen": F.bit_or(bit),
            "others": F.count_if(c(name).isNotNull() & bit.isNull()),
            "present_count": F.count(c(name)),
        }

    booleans = [f.name for f in df.schema if f.dataType.typeName() == "boolean"]
    return _rows(df, columns, measures).select(
        "column_name",
        F.coalesce((F.col("others") == 0) & (F.col("present_count") > 0)
                   & (F.bit_count("seen") <= 2), F.lit(False)).alias("is_binary"),
    )


def numeric_profile(
    df: DataFrame, columns: Sequence[str], *, buffer_rows: int = BUFFER_ROWS
) -> DataFrame:
    """Count, quartiles, range and mean of each column that holds numbers. Runs jobs for the
    exact quartiles; the result has one row per column."""
    numbers = df.select(*[safe_num(c(n), df.schema[n].dataType).alias(n) for n in columns])
    quartiles = exact_percentiles(numbers, columns, [0.25, 0.5, 0.75], buffer_rows=buffer_rows)
    profile = _rows(numbers, columns, lambda n: {
        "value_count": F.count(c(n)), "min_value": F.min(c(n)), "max_value": F.max(c(n)),
        "mean_value": F.avg(c(n)),
        **{label: F.lit(quartiles[n][i]).cast("double")
           for i, label in enumerate(("p25", "median", "p75"))},
    })
    return profile.where("value_count > 0")
