"""Language of texts by a convolutional network over bytes.

Windows of 256 bytes (A-Z lower-cased, the last one padded) go through an embedding of bytes,
filters of several widths, max pooling over the window and a softmax. The network is trained in
numpy on a bounded sample: about ``SAMPLE_DOCS`` documents of each language, drawn by a hash of
their id, of each at most ``SAMPLE_WINDOWS`` windows spread over the text; that is what the driver
sees. It is applied to every window of every whole text, map-side; the probabilities of a text
are the mean over its windows.

A text that is null, or has no letter, is ``und`` with score 1. Ties go to the language that is
first in the alphabet. Without any labelled document all texts are ``und`` with score 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlens.llm.arrays import LOWER, let_go, slices

WINDOW, WIDTHS, FILTERS, EMBEDDING = 256, (2, 3, 4), 12, 8
SAMPLE_DOCS, SAMPLE_WINDOWS, EPOCHS, BATCH, RATE = 600, 2, 8, 64, 0.01
UNKNOWN = "und"


def windows_of(text: bytes) -> np.ndarray:
    """All windows of a text, as rows of bytes."""
    count = max(1, -(-len(text) // WINDOW))
    cells = np.zeros(count * WINDOW, np.uint8)
    cells[:len(text)] = LOWER[np.frombuffer(text, np.uint8)]
    return cells.reshape(count, WINDOW)


@dataclass
class Network:
    """Languages and weights; ``filters[w]`` has the shape (w, EMBEDDING, FILTERS)."""

    languages: list[str]
    embedding: np.ndarray
    filters: list[np.ndarray]
    dense: np.ndarray
    bias: np.ndarray

    def pooled(self, cells: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """The strongest answer of each filter per window, and the convolutions."""
        raw = []
        for weights in self.filters:
            width = len(weights)
            span = cells.shape[1] - width + 1
            # A filter's answer to a byte at one of its places is a row of a small table.
            total = (self.embedding @ weights[0])[cells[:, :span]]
            for j in range(1, width):
                total += (self.embedding @ weights[j])[cells[:, j:j + span]]
            raw.append(total)
        return np.concatenate([r.max(1) for r in raw], 1), raw

    def probabilities(self, cells: np.ndarray) -> np.ndarray:
        parts = [self.pooled(cells[i:i + BATCH])[0] for i in range(0, len(cells), BATCH)]
        logits = np.concatenate(parts) @ self.dense + self.bias
        odds = np.exp(logits - logits.max(1, keepdims=True))
        return odds / odds.sum(1, keepdims=True)


def train(languages: list[str], cells: np.ndarray, labels: np.ndarray, seed: int = 7) -> Network:
    """Adam on the cross entropy; the same data and seed give the same network."""
    rng = np.random.default_rng(seed)
    f32 = np.float32
    net = Network(
        languages, rng.normal(0, 0.5, (256, EMBEDDING)).astype(f32),
        [rng.normal(0, (2 / (w * EMBEDDING)) ** 0.5, (w, EMBEDDING, FILTERS)).astype(f32) for w in WIDTHS],
        rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(languages))).astype(f32),
        np.zeros(len(languages), f32))
    weights = [net.embedding, *net.filters, net.dense, net.bias]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(cells))
        for at in range(0, len(order), BATCH):
            rows = order[at:at + BATCH]
            step += 1
            for i, slope in enumerate(_slopes(net, cells[rows], labels[rows])):
                first[i] += 0.1 * (slope - first[i])
                second[i] += 0.001 * (slope * slope - second[i])
                size = RATE * (1 - 0.999 ** step) ** 0.5 / (1 - 0.9 ** step)
                weights[i] -= (size * first[i] / (np.sqrt(second[i]) + 1e-8)).astype(f32)
    return net


def _slopes(net: Network, cells: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
    pooled, raw = net.pooled(cells)
    logits = pooled @ net.dense + net.bias
    odds = np.exp(logits - logits.max(1, keepdims=True))
    error = odds / odds.sum(1, keepdims=True)
    error[np.arange(len(labels)), labels] -= 1
    error /= len(labels)
    back = error @ net.dense.T
    d_embedding, d_filters = np.zeros_like(net.embedding), []
    rows = np.arange(len(cells))[:, None]
    for k, weights in enumerate(net.filters):
        # Only the place of the maximum passes the error on.
        slope = back[:, k * FILTERS:(k + 1) * FILTERS]
        place = raw[k].argmax(1)
        d_weights = np.zeros_like(weights)
        for j in range(len(weights)):
            byte = cells[rows, place + j]
            d_weights[j] = np.einsum("nf,nfe->ef", slope, net.embedding[byte])
            np.add.at(d_embedding, byte, slope[:, :, None] * weights[j].T[None])
        d_filters.append(d_weights)
    return [d_embedding, *d_filters, pooled.T @ error, error.sum(0)]


def has_letter(text: Column | str) -> Column:
    return F.coalesce(F.rlike(text, F.lit(r"\p{L}")), F.lit(False))


def _sample_windows(batches):
    for batch, _, rows in slices(batches):
        cells, owner = [], []
        for i, text in enumerate(rows):
            own = windows_of(text)
            picked = np.unique(np.linspace(0, max(len(own) - 2, 0), SAMPLE_WINDOWS).astype(int))
            cells += [own[p].tobytes() for p in picked]
            owner += [i] * len(picked)
        yield pa.RecordBatch.from_arrays(
            [batch.column("lang").take(pa.array(owner, pa.int64())), batch.column("doc_id").take(pa.array(owner, pa.int64())),
             pa.array(cells, pa.binary())], ["lang", "doc_id", "cells"])


def fit(docs: DataFrame) -> Network | None:
    """Train on a sample of the documents with text, language and id; None if there are none."""
    known = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
        F.col("lang").cast("string").alias("lang"),
    ).where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & has_letter("text"))
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not counts:
        return None
    parts = 1 << 30
    share = F.lit(0)
    for lang, count in counts.items():
        share = F.when(F.col("lang") == lang, min(parts, -(-parts * SAMPLE_DOCS // count))).otherwise(share)
    drawn = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(parts)) < share)
    rows = drawn.mapInArrow(_sample_windows, "lang string, doc_id long, cells binary").collect()
    rows.sort(key=lambda r: (r["lang"], r["doc_id"], bytes(r["cells"])))
    languages = sorted({r["lang"] for r in rows})
    cells = np.frombuffer(b"".join(bytes(r["cells"]) for r in rows), np.uint8).reshape(-1, WINDOW)
    labels = np.array([languages.index(r["lang"]) for r in rows])
    return train(languages, cells, labels)


def _guessed(net: Network | None):
    """Function of batches of texts, null where there is no letter, to languages and scores."""

    def guess(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        let_go()
        for batch in batches:
            texts = batch.cast(pa.binary())
            langs, scores = [UNKNOWN] * len(texts), [1.0] * len(texts)
            rows = np.flatnonzero(texts.is_valid().to_numpy(zero_copy_only=False)).tolist()
            at = 0
            while at < len(rows):
                group, size = [], 0
                while at < len(rows) and (not group or size < 1 << 18):
                    group.append(windows_of(texts[rows[at]].as_py()))
                    size += group[-1].size
                    at += 1
                owners = rows[at - len(group):at]
                if net is None:
                    for i in owners:
                        scores[i] = 0.0
                    continue
                odds = net.probabilities(np.concatenate(group)).astype(np.float64)
                cuts = np.append(0, np.cumsum([len(g) for g in group])[:-1])
                means = np.add.reduceat(odds, cuts) / np.array([len(g) for g in group])[:, None]
                for i, mean in zip(owners, means, strict=True):
                    best = int(mean.argmax())
                    langs[i], scores[i] = net.languages[best], float(min(1.0, mean[best]))
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang", "score"])

    # Not deterministic for the optimizer: a filter on the result must not guess anew.
    return F.arrow_udf(guess, "lang string, score double").asNondeterministic()


def predict(docs: DataFrame, net: Network | None, columns: list[str],
            added: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The given columns of each row, then the language and its score. Map-side only: texts alone
    go to Python, and only the results come back. Repeated rows get the same result each."""
    text = F.col("text").cast("string")
    known = _guessed(net)(F.when(has_letter(text), text))
    shown = docs.select(*columns, known.alias("__guess"))
    return shown.select(*columns, F.col("__guess.lang").alias(added[0]), F.col("__guess.score").alias(added[1]))
