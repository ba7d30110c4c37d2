"""Phrase collocations: frequent word sequences by Rabin-Karp fingerprints.

Texts, with A-Z lower-cased, are cut at ``.,;:!?`` and line ends into pieces, those at blanks and
tabs into words. A prefix polynomial over the word hashes of a slice of texts gives the
fingerprint of every sequence of up to ``max_words`` words by one subtraction (numpy). Three steps,
each a pass over the whole texts with partial sums per task and one shuffle:

1. Fingerprints of one and two words are counted. Longer ones follow level by level, and only
   where both shorter sequences inside are frequent, as no other can be.
2. Where a sequence has a frequent fingerprint, the text is read: occurrences that share a
   fingerprint are compared word by word with the one its pointer names, so that two phrases with
   one fingerprint are told apart. Only these phrases become text, with their exact counts and the
   smallest doc_id that holds them. A bit array of fixed size tells frequent fingerprints from
   others; a false mark costs a row, never a wrong count, since rare phrases fall out by their sum.
3. Each phrase is cut after each word; the counts of both parts come by joins on the phrase.

Scores are exact whole numbers (decimals of 38 digits; up to 10**15 occurrences of a phrase).

A null text is empty, a null lang is ``und``; a null doc_id is no pointer; repeated rows count
again; an empty table gives no rows. Texts and words may be of any length.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditlens.llm.arrays import LOWER, U, joined, mix, ranges, seeds, slices, span_hashes, word_bounds
from auditlens.sources.staging import stage

MAX_WORDS, LEAST_COUNT, LEAST_SHARE, TOP = 3, 10, 50, 2000
#: Bits of the array that marks frequent fingerprints (8 MB).
SLOT_BITS = 26
SLICE_BYTES = 2 << 20

_CUT = np.zeros(256, bool)
_CUT[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_GAP = _CUT.copy()
_GAP[[0x20, 0x09]] = True
_BASE = U(0xD1342543DE82EF95)
_INVERSE = U(pow(int(_BASE), -1, 1 << 64))


class _Slice:
    """Words of a slice of texts, where pieces end, and fingerprints of word sequences."""

    def __init__(self, texts: list[bytes], langs: list[str]):
        data, offsets = joined(texts)
        self.data = LOWER[data]
        self.starts, self.ends = word_bounds(self.data, _GAP)
        self.piece = np.cumsum(_CUT[self.data], dtype=np.int64)[self.starts]
        first = np.searchsorted(self.starts, offsets)
        self.owner = np.repeat(np.arange(len(texts)), np.diff(first))
        self.count = len(self.starts)
        names, self.lang = np.unique(np.array(langs, object), return_inverse=True)
        self.names = [str(x) for x in names]
        self.hashes = span_hashes(self.data, self.starts, self.ends) if self.count else np.zeros(0, U)
        name_hashes = _text_hashes(self.names)
        self.salt = name_hashes[self.lang[self.owner]]
        factors = np.concatenate(([U(1)], np.full(max(self.count - 1, 0), _BASE)))[:self.count]
        self.up = np.multiply.accumulate(factors)
        self.down = np.multiply.accumulate(np.where(factors == _BASE, _INVERSE, U(1)))
        self.prefix = np.concatenate(([U(0)], np.cumsum(self.hashes * self.up)))

    def places(self, n: int) -> np.ndarray:
        """Where n words of one piece start."""
        last = self.count - n + 1
        return np.flatnonzero(self.piece[:last] == self.piece[n - 1:]) if last > 0 else np.zeros(0, np.int64)

    def fingerprints(self, n: int, at: np.ndarray) -> np.ndarray:
        """Of the n words from each place, apart by language and n."""
        return mix((self.prefix[at + n] - self.prefix[at]) * self.down[at] + self.salt[at] + seeds(n)[-1])

    def phrases(self, n: int, at: np.ndarray) -> list[bytes]:
        raw = self.data.tobytes()
        spans = zip(self.starts[at].tolist(), self.ends[at + n - 1].tolist(), strict=True)
        return [b" ".join(raw[a:b].split()) for a, b in spans] if n > 1 else [raw[a:b] for a, b in spans]

    def same_words(self) -> np.ndarray:
        """A number per word, equal for equal words only: hashes, compared byte by byte."""
        _, index, number = np.unique(self.hashes, return_index=True, return_inverse=True)
        lengths, leader = self.ends - self.starts, index[number]
        if (lengths == lengths[leader]).all() and (
                self.data[ranges(self.starts, lengths)] == self.data[ranges(self.starts[leader], lengths)]).all():
            return number
        numbers: dict[bytes, int] = {}
        return np.array([numbers.setdefault(w, len(numbers)) for w in self.phrases(1, np.arange(self.count))])


def _text_hashes(texts: list[str]) -> np.ndarray:
    data, offsets = joined([t.encode() for t in texts])
    return span_hashes(data, offsets[:-1], offsets[1:] - 1)


def _sliced(batches):
    for batch, ids, texts in slices(batches, SLICE_BYTES):
        yield _Slice(texts, batch.column("lang").to_pylist()), ids


def _marked(marks: np.ndarray | None, prints: np.ndarray) -> np.ndarray:
    if marks is None:
        return np.ones(len(prints), bool)
    slot = prints >> U(64 - SLOT_BITS)
    return (marks[slot >> U(6)] >> (slot & U(63))) & U(1) == 1


def _numbered(sizes: list[int], shorter):
    """Task: partial counts of the fingerprints of so many words, where ``shorter`` (a broadcast
    bit array) marks both sequences of one word less."""

    def run(batches):
        marks = shorter.value if shorter is not None else None
        for words, _ in _sliced(batches):
            for n in sizes:
                at = words.places(n)
                if marks is not None:
                    within = _marked(marks, words.fingerprints(n - 1, np.arange(words.count - n + 2))) if len(at) else None
                    at = at[within[at] & within[at + 1]] if len(at) else at
                prints, counts = np.unique(words.fingerprints(n, at), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(prints.view(np.int64)), pa.array(counts, pa.int64())], ["print", "n"])

    return run


def _bits(prints: DataFrame) -> np.ndarray:
    """Bit array of the slots of all fingerprints: at most 2**(SLOT_BITS - 6) numbers."""
    slot = F.shiftrightunsigned("print", 64 - SLOT_BITS)
    word = F.shiftright(slot, 6).cast("int").alias("word")
    # The lower six bits of a shift count are what the shift uses.
    found = prints.select(word, F.expr(f"shiftleft(1L, cast(shiftrightunsigned(print, {64 - SLOT_BITS}) & 63 AS int))").alias("bit"))
    table = found.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    marks = np.zeros(1 << (SLOT_BITS - 6), U)
    marks[table["word"].to_numpy()] = table["bits"].to_numpy().view(U)
    return marks


def _read(max_words: int, frequent):
    """Task: phrases with a frequent fingerprint as text, with partial counts; one row of size 0
    per language and slice counts all words."""

    def run(batches):
        marks = frequent.value
        for words, ids in _sliced(batches):
            lang = words.lang[words.owner]
            names = pa.array(words.names, pa.string())
            total = np.bincount(lang, minlength=len(names))
            nulls = pa.nulls(len(names), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [names, pa.array(np.zeros(len(names), np.int32)), pa.array([b""] * len(names), pa.binary()),
                 pa.array(total, pa.int64()), nulls], ["lang", "size", "phrase", "n", "doc_id"])
            if not words.count:
                continue
            number = words.same_words()
            for n in range(1, max_words + 1):
                at = words.places(n)
                prints = words.fingerprints(n, at)
                chosen = _marked(marks, prints)
                at, prints = at[chosen], prints[chosen]
                if not len(at):
                    continue
                _, pointer, group, counts = np.unique(prints, return_index=True, return_inverse=True, return_counts=True)
                leader = at[pointer]
                same = lang[at] == lang[leader][group]
                for j in range(n):
                    same &= number[at + j] == number[leader[group] + j]
                # Occurrences that differ from the one their fingerprint points at.
                other = np.flatnonzero(~same)
                counts -= np.bincount(group[other], minlength=len(counts))
                keys = list(zip(lang[at[other]].tolist(), words.phrases(n, at[other]), strict=True))
                more, first = Counter(keys), dict(zip(reversed(keys), reversed(at[other].tolist()), strict=True))
                owner = np.concatenate((words.owner[leader], words.owner[np.array(list(first.values()), np.int64)]))
                yield pa.RecordBatch.from_arrays(
                    [names.take(pa.array(words.lang[owner])), pa.array(np.full(len(owner), n, np.int32)),
                     pa.array(words.phrases(n, leader) + [phrase for _, phrase in first], pa.binary()),
                     pa.array(np.concatenate((counts, [more[key] for key in first])), pa.int64()),
                     ids.take(pa.array(owner))], ["lang", "size", "phrase", "n", "doc_id"])

    return run


def frequent_phrases(docs: DataFrame, max_words: int = MAX_WORDS, least: int = LEAST_COUNT) -> DataFrame:
    """lang, size, phrase, n, first_doc of all phrases of up to ``max_words`` words with at least
    ``least`` occurrences; the row of size 0 of each language counts all its words."""
    sc = docs.sparkSession.sparkContext
    given = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
        F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    marks, shorter = np.zeros(1 << (SLOT_BITS - 6), U), None
    for sizes in ([1, 2][:max_words], *([n] for n in range(3, max_words + 1))):
        counted = given.mapInArrow(_numbered(sizes, shorter), "print long, n long")
        found = stage(counted.groupBy("print").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("print"), "prints")
        level = _bits(found)
        marks |= level
        shorter = sc.broadcast(level)
    read = given.mapInArrow(_read(max_words, sc.broadcast(marks)), "lang string, size int, phrase binary, n long, doc_id long")
    summed = read.groupBy("lang", "size", "phrase").agg(F.sum("n").alias("n"), F.min("doc_id").alias("first_doc"))
    return summed.where((F.col("n") >= least) | (F.col("size") == 0)).withColumn("phrase", F.col("phrase").cast("string"))


def _part(first, length):
    return F.array_join(F.slice(F.split("phrase", " "), first, length), " ")


def scored(frequent: DataFrame) -> DataFrame:
    """lang, size, phrase, a, k, l, r, score of every phrase of two words or more at its weakest cut."""
    parts = frequent.where("size > 0")
    known = {side: parts.select("lang", F.col("phrase").alias(side), F.col("n").alias(f"n_{side}")) for side in ("head", "tail")}
    cuts = frequent.where("size > 1").select(
        "lang", "size", "phrase", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.withColumn("head", _part(F.lit(1), F.col("k"))).withColumn("tail", _part(F.col("k") + 1, F.col("size") - F.col("k")))
    met = stage(cuts.join(known["head"], ["lang", "head"]).drop("head"), "cuts").join(known["tail"], ["lang", "tail"])
    a, left, right = (F.col(c).cast("decimal(18,0)") for c in ("a", "n_head", "n_tail"))
    score = F.call_function("div", a * a * F.lit(1_000_000).cast("decimal(7,0)"), left * right)
    weakest = F.min(F.struct(score.alias("score"), "k", F.col("n_head").alias("l"), F.col("n_tail").alias("r")))
    return met.groupBy("lang", "size", "phrase", "a").agg(weakest.alias("cut")).select(
        "lang", "size", "phrase", "a", "cut.k", "cut.l", "cut.r", "cut.score")


def without_fragments(candidates: DataFrame, share: int = LEAST_SHARE) -> DataFrame:
    """Candidates but those whose words lie inside a longer candidate of at least ``share`` percent
    of their occurrences, whether that one is dropped or not."""
    longer = candidates.where("size > 2").select(
        "lang", F.col("a").alias("n_longer"), "phrase", "size", F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("part"))
    inside = longer.select("lang", "n_longer", F.explode(F.expr(
        "transform(sequence(1, size - part + 1), i -> array_join(slice(split(phrase, ' '), i, part), ' '))")).alias("phrase"))
    most = inside.groupBy("lang", "phrase").agg(F.max("n_longer").alias("n_longer"))
    return candidates.join(most, ["lang", "phrase"], "left").where(
        "n_longer IS NULL OR 100 * CAST(n_longer AS decimal(20,0)) < %d * CAST(a AS decimal(20,0))" % share).drop("n_longer")


def collocations(docs: DataFrame, max_words: int = MAX_WORDS, least: int = LEAST_COUNT,
                 share: int = LEAST_SHARE, top: int = TOP) -> DataFrame:
    """The ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    frequent = stage(frequent_phrases(docs, max_words, least), "phrases")
    candidates = stage(scored(frequent), "candidates")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    # First the best of each of many parts, so that no task ranks all phrases of a language.
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = without_fragments(candidates, share).withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(parts)))
    best = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    total = frequent.where("size = 0").select("lang", "n")
    return ranked.join(total, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
