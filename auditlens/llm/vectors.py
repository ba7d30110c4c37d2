"""Near-duplicate vectors by cosine: cross-polytope hashing with multiprobe buckets.

A hash rotates a vector by three rounds of random signs and fast Hadamard transforms and takes
the vertex of the cross-polytope (coordinate and sign) that is nearest. A table joins ``k``
hashes, so that about as many buckets exist as vectors; each vector goes to the ``PROBES`` most
likely buckets of each table. ``tables`` are so many that a pair with cosine 0.95 shares no bucket
with probability 2e-6 (measured rates per table: ``MEET``); closer pairs are missed more rarely.

Equal vectors are one class with a count before anything is compared. Buckets of one class are
dropped by a grouped count; a bucket of more than ``TILE`` classes is dealt to tasks in pairs of
tiles (cells). Cells are gathered in parts, whose number follows from the counted rows of all
cells, so that a part does not grow with the input. In a cell all pairs are compared by matrix products in double precision, but none is put
out: each vector gets the number of its links and a spanning forest of them. A pair that meets
several times counts in the first bucket that it shares, which both members know from their
codes, so counts are exact sums.

Vectors that are null, empty, zero, or hold null or non-finite components link with nothing.
Vectors of different length are not compared. Rows without vec_id are classes of their own and
are returned with no component; rows that share a vec_id are counted each.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlens.llm.arrays import U, mix
from auditlens.llm.frames import components
from auditlens.sources.staging import stage

PROBES, CANDIDATES, TILE, PAIRS = 4, 3, 4096, 50_000
#: Bytes of vectors and codes that a task gathers at once, on average; a cell has at most two tiles.
PART_BYTES = 16 << 20
#: How often a pair at cosine 0.95 (64 dimensions) shares a bucket of a table of k hashes.
MEET = {1: 0.97, 2: 0.90, 3: 0.73, 4: 0.55}
MISS = 2e-6


def plan(rows: int, width: int) -> tuple[int, int]:
    """Hashes per table and tables for so many vectors."""
    k = max(2, math.ceil(math.log(8 * max(rows, 1)) / math.log(2 * width)))
    meet = MEET[k] if k in MEET else MEET[4] * 0.75 ** (k - 4)
    return k, math.ceil(math.log(MISS) / math.log(1 - meet))


def rotate(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Three rounds of signs and Hadamard transform of the rows; a power of two columns."""
    width = x.shape[1]
    for round_signs in signs:
        x = x * round_signs
        step = 1
        while step < width:
            halves = x.reshape(len(x), -1, 2, step)
            x = np.stack((halves[:, :, 0] + halves[:, :, 1], halves[:, :, 0] - halves[:, :, 1]), 2).reshape(len(x), width)
            step *= 2
    return x


def bucket_codes(vectors: np.ndarray, k: int, tables: int, seed: int = 11) -> np.ndarray:
    """(vectors, tables, PROBES) codes of the most likely buckets, those of each table sorted."""
    length = vectors.shape[1]
    width = 1 << max(1, (length - 1).bit_length())
    padded = np.zeros((len(vectors), width))
    padded[:, :length] = vectors
    rng = np.random.default_rng([seed, length])
    combos = np.array(list(itertools.product(range(min(CANDIDATES, width)), repeat=k)))
    out = np.empty((len(vectors), tables, PROBES), np.int64)
    for t in range(tables):
        cost, code = np.zeros((len(vectors), len(combos))), np.full((len(vectors), len(combos)), U(t * 1000 + length))
        for i in range(k):
            y = rotate(padded, rng.choice((-1.0, 1.0), (3, width)))
            size = np.abs(y)
            top = np.argsort(-size, 1, kind="stable")[:, :CANDIDATES]
            value = np.take_along_axis(size, top, 1)
            vertex = (top * 2 + (np.take_along_axis(y, top, 1) > 0)).astype(U)
            # The further a vertex is behind the nearest one, the less likely it is for a neighbour.
            cost += ((value[:, :1] - value) ** 2)[:, combos[:, i]]
            code = mix(code * U(31) + vertex[:, combos[:, i]] + U(1))
        best = np.argsort(cost, 1, kind="stable")[:, :PROBES]
        out[:, t] = np.sort(np.take_along_axis(code, best, 1).view(np.int64), 1)
    return out


def _matrix(cells: list[list[float]]) -> np.ndarray:
    x = np.array(cells, np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _coded(k: int, tables: int):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                cells = part.column("vector").to_pylist()
                lengths = np.array([len(c) for c in cells])
                for length in np.unique(lengths):
                    rows = np.flatnonzero(lengths == length)
                    unit = _matrix([cells[i] for i in rows])
                    codes = bucket_codes(unit, k, tables).reshape(len(rows), -1)
                    yield pa.RecordBatch.from_arrays(
                        [part.column("vec_id").take(pa.array(rows)), part.column("n").take(pa.array(rows)),
                         pa.array([u.tobytes() for u in unit], pa.binary()), pa.array(list(codes), pa.list_(pa.int64()))],
                        ["vec_id", "n", "unit", "codes"])

    return run


def _pairs(a: np.ndarray, b: np.ndarray, least: float, same: bool):
    """Pairs of rows with a product of at least ``least``, a few at a time."""
    for i in range(0, len(a), 1024):
        for j in range(i if same else 0, len(b), 1024):
            x, y = np.nonzero(a[i:i + 1024] @ b[j:j + 1024].T >= least)
            x, y = x + i, y + j
            if same:
                keep = x < y
                x, y = x[keep], y[keep]
            for at in range(0, len(x), PAIRS):
                yield x[at:at + PAIRS], y[at:at + PAIRS]


def _first_meeting(a: np.ndarray, b: np.ndarray, code: int) -> np.ndarray:
    """Whether ``code`` is the first code, by table, that both rows of codes share."""
    met = np.zeros(len(a), bool)
    first = np.zeros(len(a), bool)
    for t in range(a.shape[1]):
        for p in range(PROBES):
            shared = (a[:, t, p, None] == b[:, t]).any(1) & ~met
            first |= shared & (a[:, t, p] == code)
            met |= shared
    return first


def _cells(least: float):
    """Task: links and spanning forests of all cells of a part."""

    def run(group: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        code, low, high = (np.asarray(group[c]) for c in ("code", "low", "high"))
        ids, counts, tile = (np.asarray(group[c]) for c in ("vec_id", "n", "tile"))
        order = np.lexsort((ids, tile, high, low, code))
        new = np.zeros(len(order), bool)
        new[:1] = True
        for key in (code, low, high):
            new[1:] |= key[order[1:]] != key[order[:-1]]
        starts = np.flatnonzero(new)
        units, codes = group["unit"].combine_chunks(), group["codes"].combine_chunks()
        for rows in np.split(order, starts[1:]):
            sides = [rows[tile[rows] == low[rows[0]]], rows[tile[rows] == high[rows[0]]]]
            same = low[rows[0]] == high[rows[0]]
            if same and len(rows) < 2 or not (len(sides[0]) and len(sides[1])):
                continue
            taken = [units.take(pa.array(s)).to_pylist() for s in sides]
            size = len(taken[0][0])
            if any(len(u) != size for t in taken for u in t):
                continue
            a, b = (np.frombuffer(b"".join(t)).reshape(len(t), -1) for t in taken)
            ca, cb = (np.array(codes.take(pa.array(s)).to_pylist(), np.int64).reshape(len(s), -1, PROBES) for s in sides)
            place = {r: i for i, r in enumerate(rows.tolist())}
            pa_, pb_ = (np.array([place[r] for r in s.tolist()]) for s in sides)
            links, root = np.zeros(len(rows), np.int64), np.arange(len(rows))
            n = counts[rows]
            for x, y in _pairs(a, b, least, same):
                keep = _first_meeting(ca[x], cb[y], code[rows[0]])
                x, y = pa_[x[keep]], pb_[y[keep]]
                np.add.at(links, x, n[y])
                np.add.at(links, y, n[x])
                _unite(root, x, y)
            some = np.flatnonzero(links)
            if len(some):
                out.append((ids[rows[some]], links[some], ids[rows[root[some]]]))
        columns = map(np.concatenate, zip(*out, strict=True)) if out else [np.zeros(0, np.int64)] * 3
        return pa.table(dict(zip(("vec_id", "links", "root"), columns, strict=True)))

    return run


def _unite(root: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Let ``root`` hold the smallest row that each row reaches, with links x - y added."""
    while True:
        low = np.minimum(root[x], root[y])
        if (root[x] == low).all() and (root[y] == low).all():
            return
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        while not np.array_equal(root, root[root]):
            root[:] = root[root]


def near_vectors(vectors: DataFrame, cosine: float = 0.95) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, embedding): vec_id, n_links, component_id, kept."""
    given = vectors.select(F.col("vec_id").cast("long").alias("vec_id"),
                           F.col("embedding").cast("array<double>").alias("vector"))
    bad = F.exists("vector", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    good = F.coalesce(
        F.col("vec_id").isNotNull() & ~bad & F.exists("vector", lambda v: v != 0), F.lit(False))
    prints = [F.size("vector").alias("width"), F.xxhash64("vector").alias("print1"),
              F.hash("vector").alias("print2")]
    known = stage(given.where(good).select("vec_id", "vector", *prints), "vectors")
    # A vector of a class is any of its rows: they are equal.
    same = ["width", "print1", "print2"]
    classes = stage(known.groupBy(*same).agg(F.min("vec_id").alias("first"), F.count("*").alias("n")), "classes")
    size = classes.agg(F.count("*"), F.max("width")).first()
    width = 1 << max(1, ((size[1] or 2) - 1).bit_length())
    k, tables = plan(size[0], width)
    firsts = known.join(classes, same).where("vec_id = first").dropDuplicates(["vec_id"]).select("vec_id", "n", "vector")
    coded = stage(firsts.mapInArrow(
        _coded(k, tables), "vec_id long, n long, unit binary, codes array<long>"), "coded")
    members = coded.select("vec_id", F.explode(F.array_distinct("codes")).alias("code"))
    shared = stage(members.groupBy("code").count().where("count > 1").select(
        "code", "count", F.ceil(F.col("count") / TILE).cast("int").alias("tiles")), "shared")
    tile = F.pmod(F.xxhash64("vec_id"), F.col("tiles")).cast("int")
    gathered = shared.agg(F.sum(F.col("count") * F.col("tiles"))).first()[0] or 0
    parts = max(4 * int(coded.sparkSession.conf.get("spark.sql.shuffle.partitions")),
                math.ceil(gathered * 8 * (width + tables * PROBES + 8) / PART_BYTES))
    cells = (
        members.join(shared.drop("count"), "code").withColumn("tile", tile)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .select("vec_id", "code", "tile", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"))
        .join(coded, "vec_id")
        .withColumn("part", F.pmod(F.xxhash64("code", "low", "high"), F.lit(parts))))
    met = stage(cells.groupBy("part").applyInArrow(_cells(cosine), "vec_id long, links long, root long"), "met")
    links = met.groupBy("vec_id").agg(F.sum("links").alias("links"))
    roots = components(met.select(F.col("vec_id").alias("a"), F.col("root").alias("b")))
    named = (
        known.select("vec_id", *same).join(classes, same)
        .join(links.withColumnRenamed("vec_id", "first"), "first", "left")
        .join(roots.withColumnRenamed("id", "first"), "first", "left")
        .select("vec_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
                F.coalesce("root", "first").alias("component_id")))
    alone = given.where(~good).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return named.unionByName(alone).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
