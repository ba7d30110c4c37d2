"""Isolation forest (Liu, Ting, Zhou 2008): trees grow in parallel, rows score in parallel.

Fitting draws a bounded sample per tree and grows each tree in its own group, so its cost
does not depend on the table beyond one scan. Scoring sends only the feature vectors through
Arrow; the forest is a broadcast of at most trees x 2 x rows-per-tree nodes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditlens import fixed
from auditlens.functions.scalars import c
from auditlens.operators.ordering import BUFFER_ROWS, exact_percentiles

SCORED_ROWS = 30_000  # rows that walk the forest together; their codes fit 16 bits

TREE_TYPE = (
    "tree int, feature array<int>, threshold array<double>, left array<int>, "
    "right array<int>, path array<double>"
)


@dataclass(frozen=True)
class ForestParams:
    trees: int = fixed.TREES
    tree_rows: int = fixed.TREE_ROWS
    contamination: float | str = fixed.CONTAMINATION
    seed: int = fixed.SEED


def average_path(n):
    """Expected path length of an unsuccessful search among ``n`` rows."""
    n = np.asarray(n, dtype=float)
    big = np.maximum(n, 3.0)
    long = 2.0 * (np.log(big - 1.0) + np.euler_gamma) - 2.0 * (big - 1.0) / big
    return np.where(n > 2, long, np.where(n == 2, 1.0, 0.0))


def _uniform(row_id: Column, seed: int, part: Column) -> Column:
    """Number in [0, 1) that depends only on the row, the seed and the part."""
    hashed = F.xxhash64(row_id, F.lit(seed), part)
    return F.pmod(hashed, F.lit(1 << 53)) / float(1 << 53)


def tree_samples(
    rows: DataFrame, total: int, params: ForestParams, row_id: str = "row_id"
) -> DataFrame:
    """Draw ``tree_rows`` rows per tree without replacement; adds ``tree``.

    Each row belongs to each tree with a slightly raised probability. Its first tree follows
    from one geometric draw, so on large tables nearly all rows are dropped by one filter
    before anything is expanded. The surplus per tree is cut by a hash order.
    """
    wanted = min(params.tree_rows, total)
    share = min(1.0, wanted / max(total, 1) * (1 + 8 / math.sqrt(wanted)))
    own_id = c(row_id)
    if share < 1.0:
        draw = _uniform(own_id, params.seed, F.lit(-1))
        first = F.floor(F.log(1 - draw) / math.log(1 - share)).cast("int")
        chosen = rows.withColumn("__first", first).where(F.col("__first") < params.trees)
        spread = chosen.withColumn(
            "tree", F.explode(F.sequence(F.col("__first"), F.lit(params.trees - 1)))
        ).where((F.col("tree") == F.col("__first"))
                | (_uniform(own_id, params.seed, F.col("tree")) < share)).drop("__first")
    else:
        spread = rows.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(params.trees - 1))))
    order = Window.partitionBy("tree").orderBy(
        F.xxhash64(own_id, F.lit(params.seed), F.col("tree"), F.lit("cut")), own_id
    )
    return spread.withColumn("__n", F.row_number().over(order)).where(
        F.col("__n") <= wanted
    ).drop("__n")


def grow_tree(values: np.ndarray, depth_limit: int, rng: np.random.Generator) -> dict:
    """One isolation tree as parallel node lists; a leaf points to itself."""
    feature, threshold, left, right, path = [], [], [], [], []

    def add(index: np.ndarray, depth: int) -> int:
        node = len(feature)
        feature.append(0)
        threshold.append(0.0)
        left.append(node)
        right.append(node)
        path.append(depth + float(average_path(len(index))))
        return node

    waiting = [(add(np.arange(len(values)), 0), np.arange(len(values)), 0)]
    while waiting:
        node, index, depth = waiting.pop()
        if depth >= depth_limit or len(index) < 2:
            continue
        here = values[index]
        low, high = here.min(axis=0), here.max(axis=0)
        usable = np.flatnonzero(high > low)
        if not len(usable):
            continue
        f = int(rng.choice(usable))
        cut = rng.uniform(low[f], high[f])
        goes_left = here[:, f] <= cut
        if goes_left.all():  # rounding put the cut on the largest value
            cut = low[f]
            goes_left = here[:, f] <= cut
        a, b = index[goes_left], index[~goes_left]
        feature[node], threshold[node] = f, cut
        left[node], right[node] = add(a, depth + 1), add(b, depth + 1)
        waiting += [(left[node], a, depth + 1), (right[node], b, depth + 1)]
    return {"feature": feature, "threshold": threshold, "left": left, "right": right, "path": path}


def fit_forest(
    rows: DataFrame, total: int, params: ForestParams = ForestParams(),
    *, row_id: str = "row_id", vector: str = "features",
) -> DataFrame:
    """Grow the forest; one result row per tree. ``row_id`` must be stable and unique, as
    :func:`auditlens.plans.training.with_content_ids` gives them."""
    wanted = min(params.tree_rows, total)
    depth_limit = math.ceil(math.log2(max(wanted, 2)))
    seed = params.seed

    def grow(key: tuple[int, ...], group: pd.DataFrame) -> pd.DataFrame:
        tree = int(key[0])
        ordered = group.sort_values(row_id)
        values = np.stack(ordered[vector].to_numpy())
        nodes = grow_tree(values, depth_limit, np.random.default_rng([seed, tree]))
        return pd.DataFrame([{"tree": tree, **nodes}])

    samples = tree_samples(rows.select(row_id, vector), total, params, row_id)
    return samples.groupBy("tree").applyInPandas(grow, TREE_TYPE)


class Scorer:
    """Forest as full binary trees in level order, ready to broadcast.

    Node i has its children at 2 i and 2 i + 1, so a step needs no links; a leaf above the last
    level is repeated below. Thresholds of a feature are known by their rank. Of these a block of
    rows can tell apart only those with a value of its own between them, so a value's code is its
    place among the codes that occur in the block, and codes are short: those of a row mostly fit
    one 64-bit word. The low bits of a node then say how far to shift it, and a step is the sign
    of a difference; else they say which code of the row to take. The first levels have few
    nodes; each of them is compared with all rows of the block, without looking anything up. A block
    of rows walks one tree at a time: the tree and the block both stay in the cache.
    """

    FEATURE_BITS = 16
    WORD_BITS = 58  # a word is shifted by 6 bits at least, so the low bits of a node are clear of it
    TOP_LEVELS = 3

    def __init__(self, trees: pd.DataFrame, tree_rows: int):
        self.count = len(trees)
        self.depth = math.ceil(math.log2(max(tree_rows, 2)))
        self.scale = self.count * float(average_path(tree_rows)) or 1.0
        split = np.zeros((self.count, 1 << self.depth), np.int32)
        threshold = np.zeros((self.count, 1 << self.depth))
        self.path = np.zeros((self.count, 1 << self.depth))
        for k, tree in enumerate(trees.itertuples()):
            feature, cut, left, right, path = (
                np.asarray(getattr(tree, n)) for n in ("feature", "threshold", "left", "right", "path"))
            nodes = np.zeros(1, np.int64)
            for level in range(self.depth):
                place = slice(1 << level, 2 << level)
                split[k, place] = np.maximum(feature[nodes], 0)
                threshold[k, place] = cut[nodes]
                nodes = np.stack((left[nodes], right[nodes]), 1).ravel().astype(np.int64)
            self.path[k] = path[nodes]
        used = range(int(split.max()) + 1) if self.count else ()
        self.cuts = [np.unique(threshold[split == f]) for f in used]
        self.starts = np.cumsum([0, *(len(cuts) for cuts in self.cuts)])
        #: Whether the codes of any block fit one word.
        self.narrow = sum(self._bits(len(cuts) + 1) for cuts in self.cuts) <= self.WORD_BITS
        #: Place of the threshold of a node among those of all features, one feature after the other.
        self.node = np.zeros((self.count, 1 << self.depth), np.int32)
        for f, cuts in enumerate(self.cuts):
            at = split == f
            self.node[at] = self.starts[f] + np.searchsorted(cuts, threshold[at])
        self.levels = min(self.TOP_LEVELS, self.depth)
        self.tops = split[:, 1:1 << self.levels].tolist()
        #: Node after the first levels, by the outcomes of their nodes as bits of a number.
        self.after = np.ones(1 << max((1 << self.levels) - 1, 0), np.int64)
        outcomes = np.arange(len(self.after))
        for _ in range(self.levels):
            right = (outcomes >> ((1 << self.levels) - 1 - self.after)) & 1
            self.after = 2 * self.after + right

    @staticmethod
    def _bits(codes: int) -> int:
        """Bits of so many codes around zero; one to spare keeps differences within 64 bits."""
        return codes.bit_length() + 1

    def _codes(self, part: np.ndarray):
        """Per feature the codes of the block, and of each threshold the smallest code above it."""
        codes, above = [], []
        kind = np.int16 if len(part) < 1 << 15 else np.int32
        for f, cuts in enumerate(self.cuts):
            rank = np.searchsorted(cuts, part[:, f])
            present = np.zeros(len(cuts) + 1, bool)
            present[rank] = True
            smaller = np.cumsum(present)
            codes.append((smaller[rank] - 1).astype(kind))
            above.append(smaller[:-1])
        return codes, above

    def _packed(self, codes: list[np.ndarray], above: list[np.ndarray]):
        """One word per row and the nodes that go with it, or None where the codes need more bits."""
        counts = [int(code.max()) + 1 for code in codes]
        bits = [self._bits(count) for count in counts]
        if sum(bits) > self.WORD_BITS:
            return None
        word, nodes, low = np.zeros(len(codes[0]), np.int64), [], 0
        for code, more, count, width in zip(codes, above, counts, bits, strict=True):
            centred = code.astype(np.int64) - count // 2
            word |= (centred & ((1 << width) - 1)) << low
            low += width
            # Just below the smallest word that goes right; the wanted shift is what is left of 64.
            nodes.append(((more - count // 2) << (64 - width)) - 64 + (64 - low))
        return word, np.concatenate(nodes).take(self.node)

    def _wide(self, codes: list[np.ndarray], above: list[np.ndarray]):
        """Codes of a row one after the other, and the nodes that go with them."""
        nodes = [((more << self.FEATURE_BITS) - (1 << self.FEATURE_BITS)) | f for f, more in enumerate(above)]
        return (np.stack(codes, 1).astype(np.int64) << self.FEATURE_BITS).ravel(), np.concatenate(nodes).take(self.node)

    def score(self, values: np.ndarray, block: int = SCORED_ROWS) -> np.ndarray:
        """Anomaly score in (0, 1] per row of ``values``."""
        out = np.empty(len(values))
        for start in range(0, len(values), block):
            total = self._paths(np.asarray(values[start:start + block], float))
            # One by one, as the vectorised power differs in the last digit between machines.
            out[start:start + block] = [2.0 ** x for x in (-total / self.scale).tolist()]
        return out

    def _paths(self, part: np.ndarray) -> np.ndarray:
        """Sum of the path lengths of all trees per row."""
        n = len(part)
        total = np.zeros(n)
        if not self.cuts:
            return total
        codes, above = self._codes(part)
        packed = self._packed(codes, above)
        words, nodes = packed or self._wide(codes, above)
        mask = 63 if packed else (1 << self.FEATURE_BITS) - 1
        firsts = np.concatenate(above).take(self.node[:, 1:1 << self.levels]).tolist()
        base = None if packed else np.arange(n) * len(codes)
        leaf, hit, outcome = np.empty(n), np.empty(n, bool), np.empty(n, np.uint8)
        step, place, value = (np.empty(n, np.int64) for _ in range(3))
        for node, path, tops, limits in zip(nodes, self.path, self.tops, firsts, strict=True):
            outcome[:] = 0
            for f, limit in zip(tops, limits, strict=True):
                np.greater_equal(codes[f], limit, out=hit)
                outcome += outcome
                outcome += hit.view(np.uint8)
            at = self.after.take(outcome)
            for _ in range(self.depth - self.levels):
                node.take(at, out=step, mode="clip")
                np.bitwise_and(step, mask, out=place)
                if packed:
                    np.left_shift(words, place, out=value)
                else:
                    place += base
                    words.take(place, out=value, mode="clip")
                step -= value
                step >>= 63  # -1 where the value is above the threshold
                at += at
                at -= step
            at -= 1 << self.depth
            total += path.take(at, out=leaf, mode="clip")
        return total


def collect_forest(trees: DataFrame) -> pd.DataFrame:
    """Forest on the driver, by tree; its size is bounded by trees x 2 x rows per tree. Sorted here,
    as a sort in Spark would grow every tree a second time to find the ranges of its tasks."""
    return trees.toPandas().sort_values("tree", ignore_index=True)


def score_column(spark: SparkSession, trees: pd.DataFrame, tree_rows: int, vector: Column) -> Column:
    """Score of a feature vector; a NULL vector is passed over and scores NULL."""
    shared = spark.sparkContext.broadcast(Scorer(trees, tree_rows))

    def scores(vectors: pa.Array) -> pa.Array:
        if vectors.null_count == len(vectors):
            return pa.nulls(len(vectors), pa.float64())
        wanted = vectors.is_valid().to_numpy(zero_copy_only=False)
        dense = vectors.drop_null().flatten().to_numpy(zero_copy_only=False)
        scores = np.full(len(vectors), np.nan)
        scores[wanted] = shared.value.score(dense.reshape(int(wanted.sum()), -1))
        return pa.array(scores, mask=~wanted)

    @F.arrow_udf("double")
    def isolation_score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        waiting, rows = [], 0
        for vectors in batches:
            waiting, rows = [*waiting, vectors], rows + len(vectors)
            if rows >= SCORED_ROWS:
                yield scores(pa.concat_arrays(waiting))
                waiting, rows = [], 0
        if waiting:
            yield scores(pa.concat_arrays(waiting))

    return isolation_score(vector)


def score_threshold(
    scores: DataFrame, contamination: float | str, column: str = "score",
    *, buffer_rows: int = BUFFER_ROWS,
) -> float:
    """Score that the given share of training rows exceeds; ``auto`` is 0.5."""
    if contamination == "auto":
        return 0.5
    found = exact_percentiles(scores, [column], [1 - contamination], buffer_rows=buffer_rows)
    return found[column][0]


def ml_flag(score: Column, threshold: float, margin: float = fixed.SCORE_MARGIN) -> Column:
    """Score at or above the threshold plus the margin; unscored rows are not flagged."""
    return F.coalesce(score >= threshold + margin, F.lit(False))
