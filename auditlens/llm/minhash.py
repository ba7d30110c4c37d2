"""Near-duplicates by word shingles: MinHash with tensored banding, links verified on full sets.

A document is the set of its distinct shingles of ``size`` words (A-Z lower-cased); a text of
fewer words is one shingle, a text without words an empty set that links with nothing. Documents
link if 100 * |intersection| >= percent * |union|.

Tensored banding: each of ``REPEATS`` repetitions has two small collections of keys, ``LEFT`` keys
of ``LEFT_ROWS`` minhashes and ``RIGHT`` keys of ``RIGHT_ROWS``. Every pair (left key, right key)
is the key of one hash table, so LEFT * RIGHT tables need only LEFT * LEFT_ROWS + RIGHT *
RIGHT_ROWS minhashes: 72 tables of 5 rows from 78 minhashes instead of 360. A pair at similarity
0.8 shares no table with probability
    (1 - (1 - (1 - 0.8**3)**6) * (1 - (1 - 0.8**2)**4))**3 = 3e-5,
and one at 0.9 with 2e-9.

Steps, each a Spark shuffle by a key and none a group in one task:
1. documents with equal sets (128-bit fingerprint and size) become one class;
2. each class is compared with the smallest id of every table bucket that it is in;
3. documents that the links join within few steps are a cluster; in buckets that hold several
   clusters, each document outside the largest one is compared with a few drawn members of it;
4. the documents of all buckets that still hold several clusters, put together by the largest
   cluster of the bucket, are compared with all of other clusters there, by products of 0/1
   matrices of their full sets, in tiles. Only links between clusters are put out;
5. the components of all links are the result.
Every pair of a bucket is so either compared on full sets or within one component: no link is
lost, and no group is expanded into pairs.
Texts of the candidates alone are moved, and sets are computed anew where a pair is verified.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlens.llm.arrays import U, Words, grams, let_go, mix, seeds, slices
from auditlens.llm.frames import components, near_roots, only_ids, texts, with_ids
from auditlens.sources.staging import stage

REPEATS, LEFT, LEFT_ROWS, RIGHT, RIGHT_ROWS = 3, 6, 3, 4, 2
#: Members drawn of a component; documents of a tile; columns of a matrix at a time.
DRAWN, TILE, COLUMNS = 8, 256, 4096
#: Texts of which a task remembers the sets.
KNOWN_BYTES = 4 << 20
MINHASHES = REPEATS * (LEFT * LEFT_ROWS + RIGHT * RIGHT_ROWS)


def shingle_sets(rows: list[bytes], size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words = Words(rows, lower=True)
    whole = grams(words.hashes, size)
    sets = []
    for a, b in zip(words.first[:-1], words.first[1:], strict=True):
        if b - a >= size:
            sets.append(np.unique(whole[a:b - size + 1]))
        else:
            sets.append(grams(words.hashes[a:b], b - a, salt=9) if b > a else whole[:0])
    return sets


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def _sketches(size: int):
    factors, shifts = seeds(MINHASHES, 3), seeds(MINHASHES, 4)

    def run(batches):
        for _, ids, rows in slices(batches):
            sets = shingle_sets(rows, size)
            lengths = np.array([len(s) for s in sets], np.int64)
            full = np.flatnonzero(lengths)
            sums, other = np.zeros(len(sets), U), np.zeros(len(sets), U)
            signature = np.zeros((len(sets), MINHASHES), np.uint32)
            if len(full):
                values = np.concatenate([sets[i] for i in full])
                at = np.append(0, np.cumsum(lengths[full])[:-1])
                sums[full] = np.add.reduceat(values, at)
                other[full] = np.bitwise_xor.reduceat(mix(values ^ U(5)), at)
                for j in range(MINHASHES):
                    least = np.minimum.reduceat(values * factors[j] + shifts[j], at)
                    signature[full, j] = least >> U(32)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(lengths), _signed(sums), _signed(other),
                 pa.array([row.tobytes() for row in signature], pa.binary())],
                ["doc_id", "n_shingles", "print1", "print2", "signature"])

    return run


def table_keys(signature: np.ndarray) -> np.ndarray:
    """The keys (documents x tables) of signatures (documents x minhashes)."""
    keys, column = [], 0
    values = signature.astype(U)
    for r in range(REPEATS):
        parts = []
        for count, rows in ((LEFT, LEFT_ROWS), (RIGHT, RIGHT_ROWS)):
            part = []
            for _ in range(count):
                part.append(mix((values[:, column:column + rows] * seeds(rows, 5)).sum(1, dtype=U)))
                column += rows
            parts.append(part)
        keys += [mix(a * U(3) + b * U(5) + U(1 + len(parts[1]) * i + j + 1000 * r))
                 for i, a in enumerate(parts[0]) for j, b in enumerate(parts[1])]
    return np.stack(keys, 1)


def _keys(batches):
    let_go()
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            rows = np.frombuffer(b"".join(part.column("signature").to_pylist()), np.uint32)
            keys = table_keys(rows.reshape(-1, MINHASHES))
            yield pa.RecordBatch.from_arrays(
                [_signed(keys.ravel()), pa.array(np.repeat(np.asarray(part.column("doc_id")), keys.shape[1]))],
                ["key", "doc_id"])


def _verified(size: int, percent: int):
    def run(batches):
        let_go()
        known: dict[bytes, np.ndarray] = {}
        held = 0

        def set_of(text: bytes | None) -> np.ndarray:
            nonlocal held
            text = text or b""
            found = known.get(text)
            if found is None:
                if held > KNOWN_BYTES:
                    known.clear()
                    held = 0
                held += len(text)
                found = known[text] = shingle_sets([text], size)[0]
            return found

        for batch in batches:
            a, b = (batch.column(c).cast(pa.binary()).to_pylist() for c in ("text_a", "text_b"))
            good = []
            for x, y in zip(a, b, strict=True):
                one, two = set_of(x), set_of(y)
                both = len(np.intersect1d(one, two, assume_unique=True))
                good.append(both > 0 and 100 * both >= percent * (len(one) + len(two) - both))
            mask = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [batch.column("a").filter(mask), batch.column("b").filter(mask)], ["a", "b"])

    return run


def _links(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    ids = stage(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "ids")
    wanted = stage(only_ids(docs, ids), "texts")

    def side(name: str) -> DataFrame:
        return wanted.select(F.col("doc_id").alias(name), F.col("text").alias(f"text_{name}"))

    return (pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "text_a", "text_b")
            .mapInArrow(_verified(size, percent), "a long, b long"))


def _incidence_links(sets: list[np.ndarray], root: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int):
    """Pairs (one of ``left``, one of ``right``) of different roots whose sets are similar
    enough, from products of 0/1 matrices of the shingles that several sets have."""
    sizes = np.array([len(s) for s in sets], np.float64)
    value, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes.astype(int))
    column = np.cumsum(count > 1) - 1
    some = count[inverse] > 1
    owner, column = owner[some], column[inverse[some]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    both = np.zeros((len(left), len(right)))
    width = int((count > 1).sum())
    for at in range(0, width, COLUMNS):
        a, b = np.searchsorted(column, [at, at + COLUMNS])
        block = np.zeros((len(sets), min(COLUMNS, width - at)), np.float32)
        block[owner[a:b], column[a:b] - at] = 1
        both += block[left] @ block[right].T
    union = sizes[left][:, None] + sizes[right][None] - both
    x, y = np.nonzero((100 * both >= percent * union) & (root[left][:, None] != root[right][None]))
    return left[x], right[y]


def _across(size: int, percent: int):
    """Task: links between components in the cells of a part, as edges of a forest."""

    def run(group: pa.Table) -> pa.Table:
        let_go()
        main, low, high, tile, ids, root = (np.asarray(group[c]) for c in ("main", "low", "high", "tile", "doc_id", "root"))
        texts_of = group["text"].cast(pa.binary())
        order = np.lexsort((ids, tile, high, low, main))
        new = np.zeros(len(order), bool)
        new[:1] = True
        for key in (main, low, high):
            new[1:] |= key[order[1:]] != key[order[:-1]]
        a, b = [], []
        for rows in np.split(order, np.flatnonzero(new)[1:]):
            if len(rows) < 2 or (root[rows] == root[rows[0]]).all():
                continue
            sets = [shingle_sets([t or b""], size)[0] for t in texts_of.take(pa.array(rows)).to_pylist()]
            left, right = np.flatnonzero(tile[rows] == low[rows[0]]), np.flatnonzero(tile[rows] == high[rows[0]])
            if not (len(left) and len(right)):
                continue
            x, y = _incidence_links(sets, root[rows], left, right, percent)
            # Links between the same two components say the same: one of each is enough.
            pair = np.stack((root[rows][x], root[rows][y]), 1)
            _, first = np.unique(np.sort(pair, 1), axis=0, return_index=True)
            a += pair[first, 0].tolist()
            b += pair[first, 1].tolist()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _links_across(rest: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Links between documents of one ``main`` and different roots, as edges between roots.

    Each main is dealt to tasks in pairs of tiles of about TILE documents.
    """
    ids = stage(rest.select("doc_id").distinct(), "ids")
    wanted = stage(only_ids(docs, ids), "texts")
    tiles = stage(rest.groupBy("main").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles")), "tiles")
    parts = 4 * int(rest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = (
        rest.join(tiles, "main").withColumn("tile", F.pmod(F.xxhash64("doc_id"), F.col("tiles")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .select("main", "doc_id", "root", "tile", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"))
        .join(wanted, "doc_id")
        .withColumn("part", F.pmod(F.xxhash64("main", "low", "high"), F.lit(parts))))
    return cells.groupBy("part").applyInArrow(_across(size, percent), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    component_id is the smallest doc_id that links reach, kept says that it is the own one. Rows
    without doc_id have no component and are kept. Rows that share a doc_id are one document.
    """
    given = with_ids(docs)
    sketches = stage(texts(docs).mapInArrow(
        _sketches(size), "doc_id long, n_shingles long, print1 long, print2 long, signature binary"), "sketches")
    same = ["n_shingles", "print1", "print2"]
    classes = stage(sketches.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy(*same).agg(
        F.min("doc_id").alias("first")), "classes")
    firsts = sketches.join(classes.select(*same, F.col("first").alias("doc_id")), [*same, "doc_id"], "left_semi")
    keys = firsts.select("doc_id", "signature").mapInArrow(_keys, "key long, doc_id long")
    # Written first, so that Spark can split a hot bucket in the join; sizes below likewise.
    shared = stage(keys.groupBy("key").agg(F.min("doc_id").alias("pivot"), F.max("doc_id").alias("last")).where(
        "pivot < last").select("key", "pivot"), "shared")
    met = stage(keys.join(shared, "key"), "met")

    def mixed(roots: DataFrame) -> DataFrame:
        """The rows of buckets that hold several clusters, with the largest one (main)."""
        named = met.join(roots, met["doc_id"] == roots["id"], "left").select(
            "key", "doc_id", F.coalesce("root", "doc_id").alias("root"))
        sizes = named.groupBy("key", "root").count().groupBy("key").agg(
            F.max_by("root", F.struct("count", "root")).alias("main"), F.count("*").alias("roots"))
        return stage(named.join(stage(sizes.where("roots > 1").select("key", "main"), "sizes"), "key"), "mixed")

    pairs = stage(met.where("doc_id <> pivot").select(
        F.col("pivot").alias("a"), F.col("doc_id").alias("b")).distinct(), "pairs")
    links = stage(_links(pairs, given, size, percent), "links")
    rows = mixed(near_roots(links, 2))
    slot = F.pmod("key", F.lit(DRAWN))
    drawn = rows.where("root = main").groupBy("main", slot.alias("slot")).agg(
        F.min_by("doc_id", F.struct(F.xxhash64("doc_id", "key"), "doc_id")).alias("doc_id"))
    minor = rows.where("root <> main").select("main", slot.alias("slot"), F.col("doc_id").alias("x")).distinct()
    pairs = stage(minor.join(stage(drawn, "drawn"), ["main", "slot"]).select(
        F.least("x", "doc_id").alias("a"), F.greatest("x", "doc_id").alias("b")).distinct()
        .join(pairs, ["a", "b"], "left_anti"), "pairs")
    links = stage(links.unionByName(_links(pairs, given, size, percent)), "links")
    rest = stage(mixed(near_roots(links, 4)).select("main", "doc_id", "root").distinct(), "rest")
    roots = stage(components(links.unionByName(_links_across(rest, given, size, percent))), "roots")
    return (
        sketches.join(classes, same, "left").join(roots, F.col("first") == F.col("id"), "left")
        .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "first", "doc_id")).alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))
