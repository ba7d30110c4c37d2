"""Cleaning of a corpus in five stages, each written as Parquet before the next one reads it.

A stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All but the
last return the columns of ``documents``. Rows without doc_id pass the stages that compare
documents, as they can not be told apart; rows that share a doc_id stay or go together.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlens.llm import bpe, contamination, language, minhash, secrets
from auditlens.llm.frames import only_ids, table
from auditlens.sources.staging import stage

#: Least mean probability of the predicted language.
MIN_LANGUAGE_SCORE = 0.4


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a language that the network recognises; texts without letters go."""
    added = ("__lang_pred", "__lang_score")
    marked = language.predict(docs, language.fit(docs), docs.columns, added)
    return marked.where(
        (F.col(added[0]) != language.UNKNOWN) & (F.col(added[1]) >= MIN_LANGUAGE_SCORE)).select(*docs.columns)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group that shares 80 % of its five-word shingles."""
    gone = minhash.near_duplicates(docs).where("NOT kept").select("doc_id").distinct()
    return only_ids(docs, stage(gone, "gone"), "left_anti").select(*docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no copy of a benchmark item."""
    found = contamination.contaminated(docs, table(spark, sf_dir, "benchmark"))
    return only_ids(docs, stage(found.select("doc_id").distinct(), "gone"), "left_anti").select(*docs.columns)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts masked and n_chars as it is then."""
    found = secrets.scan(docs.select(F.struct("*").alias("row"), "text"))
    text = secrets.masked(F.col("text"), F.col("found"))
    changed = {"text": text, "n_chars": F.when(F.size("found") > 0, F.length(text).cast("long")).otherwise(F.col("row.n_chars"))
               if "n_chars" in docs.columns else None}
    return found.select(*[changed.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document (little-endian 32-bit numbers), checked by decoding them."""
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN,
                      ("n_tokens", "ids", "ids_sha256", "decoded_sha256"))


STAGES = [
    ("language", known_language),
    ("near_duplicates", without_near_duplicates),
    ("decontamination", without_benchmark),
    ("secrets", without_secrets),
    ("tokens", tokens),
]

#: Trained networks, minhashes and alignments have no SQL; a brute-force version is in the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
