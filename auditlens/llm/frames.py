"""Spark helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlens.sources.staging import stage

#: A side with at most so many ids (8 bytes each) is sent to all executors.
BROADCAST_IDS = 1_000_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` alone, a null text as an empty one."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def with_ids(docs: DataFrame) -> DataFrame:
    """The rows that can be found again: those with an id."""
    return texts(docs).where("doc_id IS NOT NULL")


def text_bytes(docs: DataFrame) -> int:
    """Bytes of all texts."""
    return docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]


def only_ids(rows: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows whose doc_id is among ``ids`` (staged, distinct), or with ``left_anti`` those whose
    is not; a counted, small set is broadcast."""
    small = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return rows.join(F.broadcast(ids) if small else ids, "doc_id", how)


def components(edges: DataFrame) -> DataFrame:
    """(id, root): the smallest id that each id of the edges (a, b) reaches.

    Alternates large and small stars: each round is two grouped minima and two equi-joins, the
    number of rounds is logarithmic in practice. Nothing is gathered in one task.
    """
    def hooked(links: DataFrame, least: DataFrame) -> DataFrame:
        # The minima are written first: a join of two plain exchanges is split at a hot node.
        return links.join(stage(least, "least"), "a")

    def distinct(links: DataFrame) -> DataFrame:
        return links.where("a <> b").select(
            F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def state(links: DataFrame):
        return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    links = stage(distinct(edges.select("a", "b")), "links")
    before = state(links)
    while before[0]:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = distinct(hooked(both, least).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = hooked(large, least).select(
            F.explode(F.array(F.struct("a", F.col("m").alias("b")),
                              F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        links = stage(distinct(small), "links")
        now = state(links)
        if now == before:
            break
        before = now
    return links.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(
        links.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())


def near_roots(edges: DataFrame, rounds: int) -> DataFrame:
    """(id, root): the smallest id within ``rounds`` edges. Equal roots mean one component; one
    component may have several roots. Far fewer jobs than :func:`components`."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    roots = stage(both.groupBy("a").agg(F.least("a", F.min("b")).alias("root")), "roots")
    for _ in range(rounds - 1):
        roots = stage(both.join(roots.withColumnRenamed("a", "b"), "b").groupBy("a").agg(
            F.least("a", F.min("root")).alias("root")), "roots")
    return roots.withColumnRenamed("a", "id")
