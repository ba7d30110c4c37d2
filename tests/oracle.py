"""Compare queries with their SQL, row by row and value by value.

Usage: python -m tests.oracle [folder] [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(folder: str):
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return db


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else (int(value) if value.is_integer() else repr(value))
    if isinstance(value, bool) or value is None or isinstance(value, (int, str)):
        return value
    return str(value)


def _bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def compare(spark, db, folder: str, build, sql: str) -> str | None:
    """Difference of a query and its SQL, or None."""
    df = build(spark, folder)
    got_columns, got = _bag(df.columns, [tuple(r) for r in df.collect()])
    result = db.execute(sql)
    want_columns, want = _bag([d[0] for d in result.description], result.fetchall())
    if got_columns != want_columns:
        return f"columns {got_columns} != {want_columns}"
    if got != want:
        extra, missing = list((got - want).items())[:3], list((want - got).items())[:3]
        return (f"rows {sum(got.values())} vs {sum(want.values())}\n   only here: {extra}\n"
                f"   only SQL:  {missing}")
    if not got:
        return "no rows"
    return None


def main() -> int:
    from pyspark.sql import SparkSession

    from driver_queries import ORACLES, QUERIES

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "12g")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    db, bad = connect(folder), 0
    for name in names:
        start = time.time()
        try:
            if name in ORACLES:
                problem = compare(spark, db, folder, QUERIES[name], ORACLES[name])
            else:
                rows = QUERIES[name](spark, folder).collect()
                problem = None if rows else "no rows"
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += problem is not None
        kind = "sql" if name in ORACLES else "rows"
        print(f"{'OK  ' if problem is None else 'FAIL'} {kind:4} {time.time() - start:6.2f}s {name}"
              + (f"\n   {problem}" if problem else ""), flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
