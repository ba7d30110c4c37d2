"""Written intermediate tables: they cut lineage and outlive lost executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a row group of a staged table: what a writing task holds in memory.
ROW_GROUP_BYTES = 16 << 20

_own_folder: dict[str, str] = {}
#: Folders that the innermost open :func:`staging_scope` removes.
_scope: ContextVar[list[str] | None] = ContextVar("staging_scope", default=None)


def staging_root(spark: SparkSession) -> str:
    """Own folder of the application below the shared one named by ``spark.checkpoint.dir``; a
    temporary one in local mode only."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return f"{named.rstrip('/')}/{spark.sparkContext.applicationId}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("Set spark.checkpoint.dir to a folder that all executors share.")
    app = spark.sparkContext.applicationId
    if app not in _own_folder:
        _own_folder[app] = tempfile.mkdtemp(prefix="auditlens-")
    return _own_folder[app]


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write the frame as Parquet under the staging root and read it back."""
    path = f"{staging_root(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    if (opened := _scope.get()) is not None:
        opened.append(path)
    df.write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder with all that is in it; a missing one is no error."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def clear_staging(spark: SparkSession) -> None:
    """Remove all that the application has staged. Frames that read it are of no use then."""
    remove(spark, staging_root(spark))


@contextmanager
def staging_scope(spark: SparkSession) -> Iterator[None]:
    """Remove at the end, also after an error, what is staged within; for flows that return
    values or write their result elsewhere."""
    token = _scope.set([])
    try:
        yield
    finally:
        staged = _scope.get()
        _scope.reset(token)
        for path in staged:
            remove(spark, path)


def spread(staged: DataFrame, columns: DataFrame | None = None) -> DataFrame:
    """Rows for heavy work per row: a staged frame of few files for the number of cores is
    small, and is dealt out to all of them; a larger one is left as it lies.

    ``columns`` is a projection of the staged frame to deal out instead of it.
    """
    rows = staged if columns is None else columns
    cores = staged.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if 4 * len(staged.inputFiles()) <= cores else rows


def file_row_id() -> Column:
    """64-bit id of a row of a staged frame, the same on every read."""
    return F.xxhash64(F.col("_metadata.file_path"), F.col("_metadata.row_index"))


def with_dense_ids(staged: DataFrame, first_id: int, name: str = "id") -> DataFrame:
    """Number the rows of a staged frame from ``first_id`` without gaps and without a sort.

    Each file knows its row positions; only the per-file row counts are summed up, so the
    ordered step sees one row per file, not the data.
    """
    placed = staged.select(
        "*",
        F.col("_metadata.file_path").alias("__file"),
        F.col("_metadata.row_index").alias("__position"),
    )
    counts = placed.groupBy("__file").agg(F.count("*").alias("__rows"))
    starts = counts.select(
        "__file",
        F.expr("sum(__rows) OVER (ORDER BY __file ROWS UNBOUNDED PRECEDING) - __rows").alias(
            "__start"
        ),
    )
    return (
        placed.join(starts, "__file")
        .withColumn(name, F.col("__start") + F.col("__position") + first_id)
        .drop("__file", "__position", "__start")
    )
