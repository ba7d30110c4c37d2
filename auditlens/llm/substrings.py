"""Substring deduplication: a De Bruijn graph of word k-mers, compacted to repeated paths.

Every run of k words is an edge between its first and its last k - 1 words. Edges are dealt to
buckets by their minimizer (the smallest hash of five words within), so consecutive edges of a
document travel together and equal edges meet. In its bucket each edge gets its source: the
smallest (document, place) where it starts. Consecutive edges of a document whose sources are
consecutive too form a nonbranching piece of a path; where the document leaves the path of its
source, the piece ends. Pieces that continue each other across buckets are then linked in Spark:
only pieces whose source coordinates continue as well are compacted to one span.

Equal edges are found by a 64-bit hash within a bucket that is drawn by an independent hash.

What is shuffled: eight bytes per word (packed arrays, a few MB of text each), then the repeated
pieces, and the texts once, to apply the spans. A passage in very many documents puts one run of
each document into its bucket. The edges of all buckets are counted first; a bucket of more than
``HOT_EDGES`` is not gathered: its sources are a grouped minimum, and an equi-join, which Spark
splits at a hot key, gives each of its edges the source. The driver sees the numbers of these
buckets, at most one per ``HOT_EDGES`` words of all texts. Rows without doc_id are left as they are; rows
that share a doc_id are rows of one document. Null and empty texts have no words.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditlens.llm.arrays import (
    U, Words, blobs, grams, inside, minimizers, mix, ranges, slices, unpacked,
)
from auditlens.llm.frames import text_bytes, texts, with_ids
from auditlens.sources.staging import stage

K_WORDS = 13
SEED_WORDS = 5
#: Bytes of text that share a bucket, and the fewest buckets.
BUCKET_BYTES, LEAST_BUCKETS = 16 << 20, 256
#: Edges of a bucket that one task gathers (about 60 bytes each while they are sorted).
HOT_EDGES = 6 << 20


def _runs(ids: pa.Array, rows: list[bytes], k: int, buckets: int):
    """Runs of edges with one minimizer, by bucket: (bucket, document, place, edges) of each run,
    and the keys of all their edges."""
    words = Words(rows)
    seeds = grams(words.hashes, SEED_WORDS, salt=1)
    good = inside(words.first, len(words.hashes), k)
    if not good.any():
        return (np.zeros(0, np.int32),) + (np.zeros(0, np.int64),) * 3 + (np.zeros(0, U),)
    keys = grams(words.hashes, k, salt=2)
    anchors = minimizers(seeds, k - SEED_WORDS + 1)
    owner = words.owners()[:len(keys)]
    starts = np.ones(len(keys), bool)
    starts[1:] = (anchors[1:] != anchors[:-1]) | ~good[:-1] | (owner[1:] != owner[:-1])
    starts = np.flatnonzero(starts & good)
    ends = np.flatnonzero(np.append((~good[1:]) | (anchors[1:] != anchors[:-1]) | (owner[1:] != owner[:-1]), True) & good) + 1
    bucket = (mix(seeds[anchors[starts]] ^ U(77)) % U(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    bucket, starts, lengths = bucket[order], starts[order], (ends - starts)[order]
    doc = np.asarray(ids)[owner[starts]].astype(np.int64)
    return bucket, doc, starts - words.first[owner[starts]], lengths, keys[ranges(starts, lengths)]


def _counted(k: int, buckets: int):
    """Task: how many edges go to each bucket."""

    def run(batches):
        for _, ids, rows in slices(batches):
            bucket, _, _, lengths, _ = _runs(ids, rows, k, buckets)
            found, at = np.unique(bucket, return_index=True)
            edges = np.add.reduceat(lengths, at) if len(at) else lengths
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(edges)], ["bucket", "edges"])

    return run


def _edges(k: int, buckets: int, hot: np.ndarray):
    """Task: the edges of documents, packed by bucket in runs, without those of hot buckets."""

    def run(batches):
        for _, ids, rows in slices(batches):
            bucket, doc, place, lengths, keys = _runs(ids, rows, k, buckets)
            calm = ~np.isin(bucket, hot)
            keys = keys[np.repeat(calm, lengths)]
            bucket, doc, place, lengths = bucket[calm], doc[calm], place[calm], lengths[calm]
            cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, np.int64)
            cuts_all = np.append(cuts, len(bucket))
            windows = np.append(0, np.cumsum(lengths))[cuts_all]
            yield pa.RecordBatch.from_arrays([
                pa.array(bucket[cuts]), blobs(doc, cuts_all),
                blobs(place.astype(np.int32), cuts_all), blobs(lengths.astype(np.uint8), cuts_all),
                blobs(keys, windows),
            ], ["bucket", "docs", "places", "lengths", "keys"])

    return run


def _hot_edges(k: int, buckets: int, hot: np.ndarray):
    """Task: one row per edge of the hot buckets."""

    def run(batches):
        for _, ids, rows in slices(batches):
            bucket, doc, place, lengths, keys = _runs(ids, rows, k, buckets)
            some = np.isin(bucket, hot)
            keys = keys[np.repeat(some, lengths)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(bucket[some], lengths[some])), pa.array(keys.view(np.int64)),
                 pa.array(np.repeat(doc[some], lengths[some])), pa.array(ranges(place[some], lengths[some]))],
                ["bucket", "key", "doc_id", "start"])

    return run


def _hot_pieces(given: DataFrame, k: int, buckets: int, hot: np.ndarray) -> DataFrame:
    """Pieces of one edge of the hot buckets: sources by an aggregate with map-side combine, and
    edges joined with them, which splits the rows of a hot key."""
    edges = given.mapInArrow(_hot_edges(k, buckets, hot), "bucket int, key long, doc_id long, start long")
    sources = stage(edges.groupBy("bucket", "key").agg(F.min(F.struct("doc_id", "start")).alias("source")), "sources")
    return edges.join(sources, ["bucket", "key"]).where("source.doc_id < doc_id").select(
        "doc_id", "start", F.lit(1).cast("long").alias("edges"),
        F.col("source.doc_id").alias("source_id"), F.col("source.start").alias("source_start"))


def _pieces(group: pa.Table) -> pa.Table:
    """One bucket: pieces of later documents whose edges have an earlier source."""
    doc, place = unpacked(group["docs"], np.int64), unpacked(group["places"], np.int32)
    length, keys = unpacked(group["lengths"], np.uint8).astype(np.int64), unpacked(group["keys"], U)
    by_place = np.lexsort((place, doc))
    ends = np.cumsum(length)
    keys = keys[ranges((ends - length)[by_place], length[by_place])]
    length = length[by_place]
    doc = np.repeat(doc[by_place], length)
    place = ranges(place[by_place].astype(np.int64), length)
    order = np.argsort(keys, kind="stable")
    fresh = np.append(True, keys[order[1:]] != keys[order[:-1]])
    source = np.empty(len(keys), np.int64)
    source[order] = order[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
    late = np.flatnonzero(doc[source] < doc)
    source = source[late]
    doc_s, place_s, doc, place = doc[source], place[source], doc[late], place[late]
    new = np.ones(len(late), bool)
    new[1:] = ((doc[1:] != doc[:-1]) | (place[1:] != place[:-1] + 1)
               | (doc_s[1:] != doc_s[:-1]) | (place_s[1:] != place_s[:-1] + 1))
    at = np.flatnonzero(new)
    return pa.table({"doc_id": doc[at], "start": place[at],
                     "edges": np.diff(np.append(at, len(late))),
                     "source_id": doc_s[at], "source_start": place_s[at]})


def repeated_spans(docs: DataFrame, k: int = K_WORDS) -> DataFrame:
    """Spans of words that repeat an earlier document: doc_id, start, end (exclusive),
    source_id, source_start, in words. Spans of one document may overlap."""
    given = with_ids(docs)
    buckets = max(LEAST_BUCKETS, text_bytes(given) // BUCKET_BYTES)
    sizes = given.mapInArrow(_counted(k, buckets), "bucket int, edges long").groupBy("bucket").agg(F.sum("edges").alias("edges"))
    hot = np.array([r["bucket"] for r in sizes.where(F.col("edges") > HOT_EDGES).collect()], np.int32)
    packed = given.mapInArrow(
        _edges(k, buckets, hot), "bucket int, docs binary, places binary, lengths binary, keys binary")
    pieces = packed.groupBy("bucket").applyInArrow(
        _pieces, "doc_id long, start long, edges long, source_id long, source_start long")
    if len(hot):
        pieces = pieces.unionByName(_hot_pieces(given, k, buckets, hot))
    # A piece continues the one before it if both its place and its source do.
    line = Window.partitionBy("doc_id").orderBy("start")
    end = F.col("start") + F.col("edges")
    follows = (
        (F.lag(end).over(line) == F.col("start"))
        & (F.lag("source_id").over(line) == F.col("source_id"))
        & (F.lag(F.col("source_start") + F.col("edges")).over(line) == F.col("source_start")))
    paths = pieces.withColumn("path", F.sum(F.when(follows, 0).otherwise(1)).over(
        line.rowsBetween(Window.unboundedPreceding, 0)))
    return paths.groupBy("doc_id", "path").agg(
        F.min("start").alias("start"), (F.max(end) + k - 1).alias("end"),
        F.min("source_id").alias("source_id"), F.min("source_start").alias("source_start"),
    ).drop("path")


def _kept(batches):
    for batch, _, rows in slices(batches):
        n_words, n_removed, digest, kept_texts = [], [], [], []
        for text, spans in zip(rows, batch.column("spans").to_pylist(), strict=True):
            words = text.split()
            kept, at = [], 0
            for a, b in sorted((s["start"], s["end"]) for s in spans or ()):
                kept += words[at:max(a, at)]
                at = max(at, b)
            kept += words[at:]
            line = b" ".join(kept)
            n_words.append(len(words))
            n_removed.append(len(words) - len(kept))
            digest.append(hashlib.sha256(line).hexdigest())
            kept_texts.append(line)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
             pa.array(digest, pa.string()), pa.array(kept_texts, pa.binary()).cast(pa.string())],
            ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])


def remove_repeated(docs: DataFrame, k: int = K_WORDS) -> DataFrame:
    """Each document without the words that repeat an earlier one: doc_id, n_words, n_removed,
    kept_sha256, kept_text."""
    spans = repeated_spans(docs, k).groupBy("doc_id").agg(
        F.collect_list(F.struct("start", "end")).alias("spans"))
    return texts(docs).join(spans, "doc_id", "left").mapInArrow(
        _kept, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
