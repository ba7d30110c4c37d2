"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max index.

Words are runs of letters and digits, A-Z lower-cased. The examples are a bounded sample of the
labelled documents: about ``PER_CLASS`` of each label, drawn by a hash of their id; the driver
sees the word counts of these alone. Terms are the ``TERMS`` words that tell the labels apart
best (chi-squared of at least ``MIN_CHI2``). Their document frequencies are counted over all
documents that are scored.

The index has, for each term, its weights in the examples and the largest weight in each block of
``BLOCK`` examples. A block whose largest possible cosine is under that of the ``NEAREST``-th best
example so far cannot hold a nearer one and is skipped, so the nearest examples are exact (ties:
the smaller doc_id). Their votes, weighted by similarity and by how many documents an example
stands for, are calibrated by isotonic regression on the examples themselves, each left out of
its own vote. The evidence is the list of the examples that voted.

A text without any term has the score of the examples without any; without labels all scores are
0. Null and empty texts have no terms. Conflicting labels of a document count as toxic.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlens.llm.arrays import PUNCTUATION, U, Words, slices

PER_CLASS, TERMS, MIN_CHI2, BLOCK, NEAREST = 2000, 512, 30.0, 64, 15
SLOTS = 1 << 16


def _term_counts(rows: list[bytes], terms: np.ndarray | None = None):
    """(text, term, count) of all words, or of those that are among the sorted terms."""
    words = Words(rows, PUNCTUATION, lower=True)
    owner, hashes = words.owners(), words.hashes
    if terms is not None:
        marks = np.zeros(SLOTS, bool)
        marks[terms & U(SLOTS - 1)] = True
        some = np.flatnonzero(marks[hashes & U(SLOTS - 1)])
        owner, hashes = owner[some], hashes[some]
        at = np.minimum(np.searchsorted(terms, hashes), max(len(terms) - 1, 0))
        hit = terms[at] == hashes if len(terms) else np.zeros(0, bool)
        owner, hashes = owner[hit], at[hit].astype(U)
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
    at = np.flatnonzero(new)
    return owner[at], hashes[at], np.diff(np.append(at, len(owner)))


def _example_words(batches):
    for batch, ids, rows in slices(batches):
        owner, hashes, counts = _term_counts(rows)
        cuts = np.searchsorted(owner, np.arange(len(rows) + 1))
        yield pa.RecordBatch.from_arrays(
            [ids, batch.column("toxic"),
             pa.array([hashes[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])], pa.binary()),
             pa.array([counts[a:b].astype(np.int64).tobytes() for a, b in zip(cuts[:-1], cuts[1:])], pa.binary())],
            ["doc_id", "toxic", "words", "counts"])


def _frequencies(terms: np.ndarray):
    """Task: how many texts have each term (and as number -1: how many texts there are)."""

    def run(batches):
        for _, _, rows in slices(batches):
            _, found, _ = _term_counts(rows, terms)
            number, count = np.unique(found.astype(np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.append(number, -1)), pa.array(np.append(count, len(rows)))], ["term", "docs"])

    return run


@dataclass
class Index:
    """Examples in blocks, their postings by term, and the calibration of votes."""

    terms: np.ndarray
    idf: np.ndarray
    ids: np.ndarray
    toxic: np.ndarray
    stands_for: np.ndarray
    starts: np.ndarray  # postings of term t: starts[t] to starts[t + 1]
    examples: np.ndarray
    weights: np.ndarray
    block_max: np.ndarray  # terms x blocks
    steps: np.ndarray  # votes, rising
    levels: np.ndarray  # calibrated score of each step
    base: float

    def vector(self, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        value = (1 + np.log(counts)) * self.idf[terms]
        return value / np.sqrt((value * value).sum())

    def nearest(self, terms: np.ndarray, query: np.ndarray, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The NEAREST examples with a cosine above 0, and these cosines; exact."""
        bounds = query @ self.block_max[terms]
        order = np.argsort(-bounds, kind="stable")
        order = order[bounds[order] > 0]
        best, cosine = np.zeros(0, np.int64), np.zeros(0)
        at, take = 0, 2
        while at < len(order):
            if len(best) >= NEAREST and bounds[order[at]] < cosine[-1] - 1e-9:
                break
            part = order[at:at + take]
            at, take = at + take, 2 * take
            found, value = self._scored(part, terms, query)
            keep = (value > 0) & (found != without)
            best, cosine = np.append(best, found[keep]), np.append(cosine, value[keep])
            rank = np.lexsort((self.ids[best], -cosine))[:NEAREST]
            best, cosine = best[rank], cosine[rank]
        return best, cosine

    def _scored(self, blocks: np.ndarray, terms: np.ndarray, query: np.ndarray):
        """Cosines of all examples of some blocks, from the postings."""
        wanted = np.zeros(self.block_max.shape[1], bool)
        wanted[blocks] = True
        total = np.zeros(len(self.ids))
        for t, q in zip(terms, query, strict=True):
            a, b = self.starts[t], self.starts[t + 1]
            rows = self.examples[a:b]
            some = wanted[rows // BLOCK]
            total[rows[some]] += q * self.weights[a:b][some]
        rows = np.flatnonzero(total)
        return rows, total[rows]

    def vote(self, best: np.ndarray, cosine: np.ndarray) -> float | None:
        weight = cosine ** 2 * self.stands_for[best]
        return float((weight * self.toxic[best]).sum() / weight.sum()) if len(best) else None

    def calibrated(self, vote: float | None) -> float:
        if vote is None or not len(self.steps):
            return self.base
        return float(np.interp(vote, self.steps, self.levels))


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rising mean of y by x (pool adjacent violators): steps and levels."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []  # weight, sum of y, sum of x
    for i in order:
        pools.append([weight[i], weight[i] * y[i], weight[i] * x[i]])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    return np.array([p[2] / p[0] for p in pools]), np.array([p[1] / p[0] for p in pools])


def fit(docs: DataFrame, labels: DataFrame, scored: DataFrame) -> Index | None:
    """Index of a sample of the labelled ``docs``; frequencies from all texts of ``scored``."""
    truth = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.col("toxic").cast("int")).alias("toxic"))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    known = truth.join(ids, "doc_id")
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    if not sizes:
        return None
    parts = 1 << 30
    share = F.lit(0)
    for toxic, count in sizes.items():
        share = F.when(F.col("toxic") == toxic, min(parts, -(-parts * PER_CLASS // count))).otherwise(share)
    drawn = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(parts)) < share)
    rows = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .join(drawn, "doc_id").mapInArrow(_example_words, "doc_id long, toxic int, words binary, counts binary").collect())
    rows.sort(key=lambda r: (r["doc_id"], bytes(r["words"])))
    toxic = np.array([float(r["toxic"] > 0) for r in rows])
    drawn_of = {label: sum(r["toxic"] == label for r in rows) for label in sizes}
    stands_for = np.array([sizes[r["toxic"]] / drawn_of[r["toxic"]] for r in rows])
    words = [np.frombuffer(r["words"], U) for r in rows]
    counts = [np.frombuffer(r["counts"], np.int64) for r in rows]
    terms = chosen_terms(words, toxic)
    total = {r["term"]: r["docs"] for r in scored.select("doc_id", F.col("text").cast("string").alias("text"))
             .mapInArrow(_frequencies(terms), "term long, docs long").groupBy("term").agg(F.sum("docs").alias("docs")).collect()}
    frequency = np.array([total.get(t, 0) for t in range(len(terms))], float)
    idf = np.log((1 + total.get(-1, 0)) / (1 + frequency)) + 1
    return build(rows, words, counts, terms, idf, toxic, stands_for)


def chosen_terms(words: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    """The words that tell the two labels apart best, sorted."""
    value, inverse = np.unique(np.concatenate([*words, np.zeros(0, U)]), return_inverse=True)
    label = np.repeat(toxic, [len(w) for w in words])
    with_word, both = np.bincount(inverse, minlength=len(value)), np.bincount(inverse, label, minlength=len(value))
    n, n1 = len(toxic), toxic.sum()
    chance = with_word * (n - with_word) * n1 * (n - n1) + 1e-9
    chi2 = n * (both * n - with_word * n1) ** 2.0 / chance
    best = np.argsort(-chi2, kind="stable")[:TERMS]
    return np.sort(value[best[chi2[best] >= MIN_CHI2]])


def build(rows, words, counts, terms, idf, toxic, stands_for) -> Index:
    vectors = []
    for w, c in zip(words, counts, strict=True):
        at = np.searchsorted(terms, w) if len(terms) else np.zeros(len(w), int)
        hit = np.flatnonzero((at < len(terms)) & (terms[np.minimum(at, max(len(terms) - 1, 0))] == w)) if len(terms) else []
        value = (1 + np.log(c[hit])) * idf[at[hit]] if len(hit) else np.zeros(0)
        norm = np.sqrt((value * value).sum())
        vectors.append((at[hit] if len(hit) else np.zeros(0, int), value / norm if norm else value))
    full = [i for i, (t, _) in enumerate(vectors) if len(t)]
    bare = [i for i, (t, _) in enumerate(vectors) if not len(t)]
    base = float((stands_for[bare] * toxic[bare]).sum() / stands_for[bare].sum()) if bare else float(np.average(toxic, weights=stands_for))
    # Examples with one main term lie in one block, so that most blocks have low bounds.
    full.sort(key=lambda i: (vectors[i][0][vectors[i][1].argmax()], toxic[i], rows[i]["doc_id"]))
    owner = np.repeat(np.arange(len(full)), [len(vectors[i][0]) for i in full])
    term = np.concatenate([*[vectors[i][0] for i in full], np.zeros(0, int)])
    weight = np.concatenate([*[vectors[i][1] for i in full], np.zeros(0)])
    order = np.lexsort((owner, term))
    owner, term, weight = owner[order], term[order], weight[order]
    block_max = np.zeros((len(terms), -(-len(full) // BLOCK)))
    np.maximum.at(block_max, (term, owner // BLOCK), weight)
    index = Index(
        terms, idf, np.array([rows[i]["doc_id"] for i in full], np.int64), toxic[full], stands_for[full],
        np.searchsorted(term, np.arange(len(terms) + 1)), owner, weight, block_max, np.zeros(0), np.zeros(0), base)
    votes = [index.vote(*index.nearest(*vectors[i], without=k)) for k, i in enumerate(full)]
    some = [k for k, v in enumerate(votes) if v is not None]
    if some:
        index.steps, index.levels = isotonic(
            np.array([votes[k] for k in some]), index.toxic[some], index.stands_for[some])
    return index


def _scores(index: Index | None):
    def run(batches):
        for _, ids, rows in slices(batches):
            score = np.full(len(rows), index.base if index else 0.0)
            evidence: list[list[dict]] = [[] for _ in rows]
            if index is not None and len(index.ids):
                owner, found, counts = _term_counts(rows, index.terms)
                cuts = np.searchsorted(owner, np.arange(len(rows) + 1))
                for i in np.flatnonzero(np.diff(cuts)):
                    terms = found[cuts[i]:cuts[i + 1]].astype(np.int64)
                    best, cosine = index.nearest(terms, index.vector(terms, counts[cuts[i]:cuts[i + 1]]))
                    score[i] = index.calibrated(index.vote(best, cosine))
                    evidence[i] = [{"doc_id": int(index.ids[b]), "cosine": float(c), "toxic": int(index.toxic[b])}
                                   for b, c in zip(best, cosine, strict=True)]
            kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(np.clip(score, 0, 1)), pa.array(evidence, kind)], ["doc_id", "score", "evidence"])

    return run


def scores(docs: DataFrame, index: Index | None) -> DataFrame:
    """doc_id, score (0 to 1) and evidence (examples with cosine and label) of each row."""
    shown = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return shown.mapInArrow(
        _scores(index), "doc_id long, score double, evidence array<struct<doc_id:bigint,cosine:double,toxic:int>>")
