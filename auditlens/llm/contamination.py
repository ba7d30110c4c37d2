"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment of words.

Words are runs of letters and digits, A-Z lower-cased. Every start of ``SEED_WORDS`` words in a
test item is a seed, however many documents hold it: a copy that keeps any ``SEED_WORDS``
neighbouring words of an item becomes a candidate, whatever other copies the corpus holds. Seeds
and documents meet in an equi-join; a bitmap of fixed size (``SLOTS`` bits) drops most other
n-grams before the shuffle, whatever the size of the benchmark.

Each candidate (document, item) is aligned: match 2, other word -1, gap -1. The score is the
best local alignment divided by that of the item with itself (0 to 1). Pairs with a score of at
least ``min_score`` are reported with the aligned words of the document. A passage that holds too
few of an item's words to reach that score is not aligned.

Items of fewer than SEED_WORDS words, null and empty texts match nothing; rows without id are
left out; equal items are all reported.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlens.llm.arrays import PUNCTUATION, U, Words, grams, inside, let_go, slices
from auditlens.llm.frames import only_ids, texts, with_ids
from auditlens.sources.staging import stage

SEED_WORDS, SLOTS = 3, 1 << 20
MATCH, OTHER, GAP = 2, -1, -1
MIN_SCORE = 0.5


def _words(rows: list[bytes]) -> Words:
    return Words(rows, PUNCTUATION, lower=True)


def _all_grams(batches):
    for _, ids, rows in slices(batches):
        words = _words(rows)
        at = np.flatnonzero(inside(words.first, len(words.hashes), SEED_WORDS))
        owner = words.owners()[at]
        yield pa.RecordBatch.from_arrays(
            [ids.take(pa.array(owner)), pa.array(grams(words.hashes, SEED_WORDS)[at].view(np.int64)),
             pa.array(at - words.first[owner])], ["item_id", "gram", "place"])


def _slots(seeds: DataFrame) -> np.ndarray:
    """Which of the SLOTS low parts of a gram occur among the seeds."""
    marks = np.zeros(SLOTS, bool)
    marks[[r[0] for r in seeds.select(F.pmod("gram", F.lit(SLOTS))).distinct().collect()]] = True
    return marks


def _found(marks: np.ndarray):
    """Task: where the grams of documents that are in the bitmap are."""

    def run(batches):
        for _, ids, rows in slices(batches):
            words = _words(rows)
            all_grams = grams(words.hashes, SEED_WORDS)
            at = np.flatnonzero(marks[all_grams & U(SLOTS - 1)] & inside(words.first, len(words.hashes), SEED_WORDS))
            owner = words.owners()[at]
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(owner)), pa.array(all_grams[at].view(np.int64)), pa.array(at - words.first[owner])],
                ["doc_id", "gram", "at"])

    return run


def align(passage: np.ndarray, item: np.ndarray) -> tuple[int, int]:
    """Best local alignment score and the end (exclusive) of its last passage word."""
    line = np.zeros(len(passage) + 1, np.int32)
    slope = np.arange(len(passage) + 1, dtype=np.int32) * -GAP
    best, end = 0, 0
    for word in item:
        new = np.zeros_like(line)
        new[1:] = line[:-1] + np.where(passage == word, MATCH, OTHER)
        new = np.maximum(np.maximum(new, line + GAP), 0)
        line = np.maximum.accumulate(new + slope) - slope
        top = int(line.argmax())
        if line[top] > best:
            best, end = int(line[top]), top
    return best, end


def _aligned(min_score: float):
    def run(batches):
        let_go()
        for batch in batches:
            docs, items = (batch.column(c).cast(pa.binary()).to_pylist() for c in ("text", "item_text"))
            out = []
            for k, (doc, item, shifts) in enumerate(zip(docs, items, batch.column("shifts").to_pylist(), strict=True)):
                words, wanted = _words([doc or b""]).hashes, _words([item or b""]).hashes
                best, size = (0, 0, 0), len(wanted)
                shifts = sorted(shifts)
                while shifts:
                    # Seeds whose places differ by less than the item belong to one passage.
                    group = [shifts.pop(0)]
                    while shifts and shifts[0] - group[-1] <= size:
                        group.append(shifts.pop(0))
                    low, high = max(0, group[0] - size), min(len(words), group[-1] + 2 * size)
                    # At most MATCH for each word of the item that the passage holds.
                    if np.isin(wanted, words[low:high]).sum() < min_score * size:
                        continue
                    score, end = align(words[low:high], wanted)
                    if score > best[0]:
                        _, back = align(words[low:low + end][::-1], wanted[::-1])
                        best = (score, low + end - back, low + end)
                if best[0] >= min_score * MATCH * size:
                    out.append((k, best[0] / (MATCH * size), best[1], best[2]))
            rows = pa.array([o[0] for o in out], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(rows), batch.column("item_id").take(rows),
                 pa.array([o[1] for o in out], pa.float64()), pa.array([o[2] for o in out], pa.int64()),
                 pa.array([o[3] for o in out], pa.int64())],
                ["doc_id", "item_id", "score", "start_word", "end_word"])

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """doc_id, item_id, score, start_word, end_word of every document that holds a copy, also
    an edited one, of a test item."""
    items = with_ids(benchmark.select(F.col("item_id").alias("doc_id"), "text"))
    given = with_ids(docs)
    seeds = stage(items.mapInArrow(_all_grams, "item_id long, gram long, place long"), "seeds")
    hits = given.mapInArrow(_found(_slots(seeds)), "doc_id long, gram long, at long")
    met = stage(hits.join(seeds, "gram").groupBy("doc_id", "item_id").agg(
        F.collect_set(F.col("at") - F.col("place")).alias("shifts")), "met")
    ids = stage(met.select("doc_id").distinct(), "ids")
    return (
        only_ids(given, ids).join(met, "doc_id")
        .join(items.select(F.col("doc_id").alias("item_id"), F.col("text").alias("item_text")), "item_id")
        .select("doc_id", "item_id", "text", "item_text", "shifts")
        .mapInArrow(_aligned(min_score), "doc_id long, item_id long, score double, start_word long, end_word long"))
