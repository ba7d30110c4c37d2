"""The result store: anomaly rows, run records and the feedback log, all append-only Parquet."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from datetime import datetime

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditlens import fixed
from auditlens.functions.scalars import c
from auditlens.functions.texts import feedback_score, norm_key
from auditlens.operators.summaries import latest_per
from auditlens.sources.staging import stage, with_dense_ids

JOIN_TYPE = (
    "array<struct<left_table:string,left_column:string,right_table:string,right_column:string,"
    "join_type:string>>"
)
FEATURE_TYPE = (
    "array<struct<name:string,feature_type:string,first_column:string,second_column:string>>"
)
# --- Fixed values: columns of a run record, their types and defaults ---------------------
RUN_COLUMNS: dict[str, tuple[str, object]] = {
    "run_id": ("bigint", None),
    "run_name": ("string", "Ad hoc workbench run"),
    "source_tables": ("array<string>", None),
    "join_config": (JOIN_TYPE, None),
    "feature_rules": (FEATURE_TYPE, None),
    "amount_field": ("string", None),
    "total_rows": ("bigint", 0),
    "user_rule_count": ("bigint", 0),
    "ml_anomaly_count": ("bigint", 0),
    "final_anomaly_count": ("bigint", 0),
    "selected_model": ("string", None),
    "metrics": ("map<string,string>", None),
    "status": ("string", "COMPLETED"),
}
RELATED_SCHEMA = (
    "`table` string, invoice_number string, invoice_date string, related_key string, ml_run_id int"
)
#: What a manifest adds to the record of its run.
COMMIT_COLUMNS: dict[str, tuple[str, object]] = {
    "attempt": ("string", None), "anomaly_rows": ("bigint", 0), "first_id": ("bigint", None),
    "last_id": ("bigint", None),
}
RUN_SCHEMA = ", ".join(
    f"{name} {dtype}" for name, (dtype, _) in {**RUN_COLUMNS, **COMMIT_COLUMNS}.items())


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def evolve(df: DataFrame, defaults: Mapping[str, tuple[str, object]]) -> DataFrame:
    """Add the columns a stored table is missing, with typed defaults; others stay as they are."""
    missing = {
        name: F.lit(value).cast(dtype)
        for name, (dtype, value) in defaults.items() if name not in df.columns
    }
    return df.withColumns(missing) if missing else df


def normalise_labels(df: DataFrame, column: str = "selected_tables") -> DataFrame:
    """Table keys without the ``null`` parts that old writes left; clean keys stay untouched."""
    value = c(column)
    broken = value.contains(".null") | value.startswith("null.") | (F.lower(value) == "null")
    return df.withColumn(column, F.when(broken, norm_key(value)).otherwise(value))


class RunWriter:
    """One try at a run. What it writes lies in folders of its own and is seen by nobody until
    :meth:`commit` puts the manifest, a single file, in its place by one rename that fails if the
    place is taken. A try that stops before leaves folders that no manifest names; a second try of
    the same run gets the same numbers, and its commit removes them."""

    def __init__(self, store: ResultStore, run_id: int, next_id: int, rows_before: int):
        self.store, self.spark, self.run_id = store, store.spark, run_id
        self.attempt = f"a{uuid.uuid4().hex}"
        self.written: dict[str, object] = {
            "attempt": None, "anomaly_rows": 0, "first_id": None, "last_id": next_id - 1}
        self._next_id, self._rows_before = next_id, rows_before

    def _folder(self, table: str) -> str:
        return self.store.attempt_path(table, self.run_id, self.attempt)

    def write_anomalies(
        self, rows: DataFrame, required: Sequence[str] = fixed.RESULT_COLUMNS
    ) -> dict:
        """Write the anomaly rows of the run with new ids, in files that follow one another by id.

        Rows are written once to the staging area and numbered by their place there, so ids,
        payloads and reasons stay together and a lost executor changes none. Beside them lies a
        table of the ids in each file, so that a few rows are found without opening all files.
        """
        missing = [n for n in required if n not in rows.columns]
        if missing:
            raise ValueError(f"Anomaly rows are missing required columns: {missing}")
        staged = stage(rows.drop("ml_run_id"), "anomalies")
        added = staged.count()
        numbered = with_dense_ids(staged, self._next_id)
        numbered.repartitionByRange("id").sortWithinPartitions("id").write.parquet(
            self._folder("anomalies"))
        stored = self.spark.read.schema("id long").parquet(self._folder("anomalies"))
        files = stored.groupBy(F.col("_metadata.file_name").alias("file")).agg(
            F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.count("*").alias("rows"))
        files.coalesce(1).sortWithinPartitions("first_id").write.parquet(self._folder("files"))
        self.written = {
            "attempt": self.attempt, "anomaly_rows": added,
            "first_id": self._next_id if added else None, "last_id": self._next_id + added - 1}
        return {
            "appended_row_count": added, "row_count": self._rows_before + added,
            "first_id": self.written["first_id"], "last_id": self.written["last_id"],
        }

    def write_related(self, rows: DataFrame) -> None:
        """Add related keys of the duplicate invoices of the run, one row per key."""
        rows.write.mode("append").parquet(self._folder("related"))

    def commit(self, record: Mapping[str, object]) -> None:
        """Make the run visible: its record, which is the manifest, with all that was written.
        Absent fields take their defaults. An error if another run took the number meanwhile."""
        values = {**record, "run_id": self.run_id, **self.written}
        columns = {**RUN_COLUMNS, **COMMIT_COLUMNS}
        full = tuple(values.get(name, default) for name, (_, default) in columns.items())
        folder = self._folder("manifest")
        self.spark.createDataFrame([full], RUN_SCHEMA).coalesce(1).write.parquet(folder)
        self.store.publish(folder, self.run_id)
        self.store.remove_unfinished(self.run_id, self.attempt)


class ResultStore:
    """Tables below one directory: anomalies, related keys, run manifests and the feedback log.

    Runs are written by a :class:`RunWriter`. Readers see what the manifests name: they read the
    folders of committed tries only, all tables of a run or none. Numbers of runs and rows come
    from the manifests, one row per run; no stored table is scanned for them.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def attempt_path(self, table: str, run_id: int, attempt: str) -> str:
        return f"{self._path(table)}/ml_run_id={run_id}/attempt={attempt}"

    def _read(self, table: str, *, merge: bool = False) -> DataFrame | None:
        """Stored table. Only the small run table may differ between files and is merged."""
        path = self._path(table)
        if not exists(self.spark, path):
            return None
        return self.spark.read.option("mergeSchema", merge).parquet(path)

    def manifests(self) -> DataFrame:
        """One row per committed run: its record and what belongs to it."""
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self._path("runs"))
        files = folder.getFileSystem(conf)
        rows = self._read("runs", merge=True) if files.exists(folder) and files.listStatus(folder) else None
        if rows is None:
            rows = self.spark.createDataFrame([], RUN_SCHEMA)
        return evolve(rows, {**RUN_COLUMNS, **COMMIT_COLUMNS})

    def _committed(self, table: str) -> DataFrame | None:
        """Rows of a table that belong to committed runs."""
        named = self.manifests().where("attempt IS NOT NULL").select("run_id", "attempt").collect()
        paths = [self.attempt_path(table, *row) for row in named]
        if table == "related":  # a run without duplicate invoices writes none
            paths = [p for p in paths if exists(self.spark, p)]
        if not paths:
            return None
        return self.spark.read.option("basePath", self._path(table)).parquet(*paths).drop("attempt")

    # --- anomalies ------------------------------------------------------------------------

    def _anomalies(self) -> DataFrame:
        rows = self._committed("anomalies")
        if rows is None:
            raise ValueError(f"There is no result table below {self.root}.")
        return rows

    def anomalies(self) -> DataFrame:
        """Stored rows with their current feedback."""
        return with_feedback(normalise_labels(self._anomalies()), self._read("feedback"))

    def rows_of(self, ids: Sequence[int], columns: Sequence[str] = ("id", "payload")) -> DataFrame:
        """Columns of the rows with the given ids. The ids are part of the plan: only files that
        hold one of them are opened, and of those only fitting row groups are read."""
        wanted = sorted({int(i) for i in ids})
        table = self._anomalies()
        files = self._committed("files").where(F.exists(
            F.array(*[F.lit(i) for i in wanted]).cast("array<long>"),
            lambda i: i.between(c("first_id"), c("last_id"))))
        named = dict(self.manifests().where("attempt IS NOT NULL").select("run_id", "attempt").collect())
        paths = [f"{self.attempt_path('anomalies', r['ml_run_id'], named[r['ml_run_id']])}/{r['file']}"
                 for r in files.select("ml_run_id", "file").collect()]
        if not paths:
            return table.limit(0).select(*[c(n) for n in columns])
        schema = T.StructType([f for f in table.schema if f.name != "ml_run_id"])
        found = self.spark.read.schema(schema).option("basePath", self._path("anomalies")).parquet(*paths)
        return found.where(c("id").isin(wanted)).select(*[c(n) for n in columns])

    def row_count(self) -> int:
        return int(self.manifests().agg(F.coalesce(F.sum("anomaly_rows"), F.lit(0))).first()[0])

    def next_run_id(self) -> int:
        return self.begin().run_id

    def begin(self) -> RunWriter:
        """Start a try at the next run."""
        run, last, rows = self.manifests().agg(
            F.coalesce(F.max("run_id"), F.lit(0)), F.coalesce(F.max("last_id"), F.lit(0)),
            F.coalesce(F.sum("anomaly_rows"), F.lit(0))).first()
        return RunWriter(self, int(run) + 1, int(last) + 1, int(rows))

    def publish(self, folder: str, run_id: int) -> None:
        """Move the one file of ``folder`` to its place among the manifests, which must be free."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path
        source, place = path(folder), path(f"{self._path('runs')}/run-{run_id:012d}.parquet")
        files = source.getFileSystem(conf)
        parts = [f.getPath() for f in files.listStatus(source) if f.getPath().getName().startswith("part-")]
        files.mkdirs(place.getParent())
        no_options = self.spark.sparkContext._gateway.new_array(
            getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri(), conf).rename(
                parts[0], place, no_options)
        except Py4JJavaError as error:
            if "FileAlreadyExists" not in str(error.java_exception):
                raise
            raise RuntimeError(f"Run {run_id} was committed by another writer; start it again.") from error

    def remove_unfinished(self, run_id: int, kept: str) -> None:
        """Remove what other tries at a committed run have left, and its own used manifest."""
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for table in ("anomalies", "files", "related", "manifest"):
            run = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self._path(table)}/ml_run_id={run_id}")
            files = run.getFileSystem(conf)
            for found in files.listStatus(run) if files.exists(run) else ():
                if table == "manifest" or found.getPath().getName() != f"attempt={kept}":
                    files.delete(found.getPath(), True)

    def related_keys(self) -> DataFrame:
        """table, invoice_number, invoice_date, related_key and ml_run_id of all runs."""
        rows = self._committed("related")
        return self.spark.createDataFrame([], RELATED_SCHEMA) if rows is None else rows

    # --- runs -----------------------------------------------------------------------------

    def runs(self) -> DataFrame:
        return self.manifests().drop(*COMMIT_COLUMNS)

    def latest_runs(self) -> DataFrame:
        """Latest run per dataset."""
        runs = self.runs().withColumn("dataset", F.array_join("source_tables", "."))
        return latest_per(runs.drop("metrics"), ["dataset"], ["run_id"])

    # --- feedback -------------------------------------------------------------------------

    def record_feedback(self, records: Sequence[tuple[int, str]], at: datetime) -> None:
        """Append feedback words for row ids. An unknown word or id is an error."""
        words = {str(word).strip().lower() for _, word in records}
        unknown = words - set(fixed.FEEDBACK_SCORES)
        if unknown:
            raise ValueError(f"Unknown feedback words: {sorted(unknown)}; use one of {sorted(fixed.FEEDBACK_SCORES)}.")
        given = self.spark.createDataFrame(
            [(int(i), str(w).strip().lower(), at.isoformat(sep=" "), n)
             for n, (i, w) in enumerate(records)],
            "record_id bigint, feedback string, at string, sequence bigint",
        )
        ids = [int(i) for i, _ in records]
        stored = self._committed("anomalies") is not None
        known = {r[0] for r in self.rows_of(ids, ["id"]).collect()} if stored and ids else set()
        absent = sorted(set(ids) - known)
        if absent:
            raise ValueError(f"Records were not found: {absent}")
        given.withColumns({
            "feedback_score": feedback_score(c("feedback")), "at": c("at").cast("timestamp_ntz"),
        }).coalesce(1).write.mode("append").parquet(self._path("feedback"))


def latest_feedback(log: DataFrame) -> DataFrame:
    """Current feedback per record: the latest entry wins, ties by the larger sequence."""
    return latest_per(log, ["record_id"], ["at", "sequence"])


def with_feedback(rows: DataFrame, log: DataFrame | None) -> DataFrame:
    rows = rows.drop("feedback_score")
    if log is None:
        return rows.withColumn("feedback_score", F.lit(None).cast("double"))
    current = latest_feedback(log).select(c("record_id").alias("__id"), "feedback_score")
    return rows.join(current, c("id") == F.col("__id"), "left").drop("__id")
