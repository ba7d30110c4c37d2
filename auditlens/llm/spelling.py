"""Spelling variants: words that are one edit apart, grouped under their common form.

Words are counted first (whole texts, partial counts per task). Two words are near if exactly one
inserted, deleted or replaced code point tells them apart. With M the longer length this is so if
their common prefix and their common suffix together reach M - 1.

Dense prefix-suffix tiling: the place of the edit is the length of the common prefix, 0 to M - 1.
A block holds the words of length M and M - 1 that share all before place u and all after place v;
a near pair lies in the one block of its M whose range [u, v) holds its edit. The first blocks cut
M in two halves. A block of more than BLOCK_ROWS words is dealt out again by the halves of its
range, until the range is one place; such a block holds no more words than the alphabet has
letters, so no block grows with the data and no pair is left out. Blocks lie in padded matrices of
code points (one byte each, as the alphabet ends at U+00FF), which are compared tile by tile.
A task puts out one row per word and block - how many words are near, and the best of them - not
the pairs.

Roots follow the forms by doubling: each form is at least ``ratio`` times as frequent as its word,
so a chain has at most log(n) / log(ratio) steps.

Null and empty texts have no words; a row without doc_id counts with an empty id; repeated rows
count again; an empty table gives no rows. Texts and words may be of any length.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlens.llm.arrays import slices
from auditlens.sources.staging import stage

LETTERS = "A-Za-zÀ-ÿ"
LEAST_LETTERS, LEAST_COUNT, RATIO = 7, 2, 10
#: A run whose checksum is a multiple of this loses one letter.
LOSES_ONE_OF = 31
#: Words of a block before it is dealt out again, and rows of a tile.
BLOCK_ROWS, TILE_ROWS = 1024, 256
#: Comparisons of one step: stacked blocks of equal size fill so many cells.
CELLS = 1 << 18
#: Different words that a task holds before it passes their counts on.
HELD_WORDS = 200_000


def _counted(batches):
    """Task: partial counts of the words of whole texts."""
    run_of = re.compile(f"[{LETTERS}]{{{LEAST_LETTERS},}}")
    total: Counter[str] = Counter()

    def flush():
        rows = pa.RecordBatch.from_arrays(
            [pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"])
        total.clear()
        return rows

    for _, ids, texts in slices(batches):
        for doc_id, text in zip(ids.to_pylist(), texts, strict=True):
            prefix = zlib.crc32(b"%s:" % (b"" if doc_id is None else str(doc_id).encode()))
            text = text.lower().decode("utf-8", "replace")  # bytes: A-Z alone
            for word, count in Counter(map(re.Match.group, run_of.finditer(text))).items():
                checksum = zlib.crc32(word.encode(), prefix)
                if checksum % LOSES_ONE_OF == 0:
                    at = checksum % len(word)
                    word = word[:at] + word[at + 1:]
                if len(word) >= LEAST_LETTERS:
                    total[word] += count
            if len(total) >= HELD_WORDS:
                yield flush()
    if total:
        yield flush()


def words(docs: DataFrame) -> DataFrame:
    """(word, n) of all words with at least LEAST_LETTERS letters and LEAST_COUNT occurrences."""
    given = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return given.mapInArrow(_counted, "word string, n long").groupBy("word").agg(
        F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _dealt(rows: DataFrame, size, parts) -> DataFrame:
    """One row per word and range of ``parts`` (array of structs u, v) of edits for length ``size``."""
    each = rows.select("word", "n", size.alias("size"), F.explode(parts).alias("part")).select(
        "word", "n", "size", F.col("part.u").alias("u"), F.col("part.v").alias("v"))
    before = F.substring("word", F.lit(1), F.col("u"))
    after = F.substring("word", F.length("word") - (F.col("size") - F.col("v")) + 1, F.col("size") - F.col("v"))
    return each.withColumn("key", F.xxhash64("size", "u", "v", before, after))


def _halves(low, high):
    middle = F.floor((low + high) / 2).cast("int")
    return F.array(F.struct(low.alias("u"), middle.alias("v")), F.struct(middle.alias("u"), high.alias("v")))


BLOCK = ["size", "u", "v", "key"]


def blocks(counted: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Words dealt to blocks of at most ``block_rows`` words, or of one place of the edit."""
    sized = counted.select("word", "n", F.explode(F.array(F.length("word"), F.length("word") + 1)).alias("size"))
    open_rows = stage(_dealt(sized, F.col("size"), _halves(F.lit(0), F.col("size"))), "blocks")
    done = None
    while True:
        counts = open_rows.groupBy(*BLOCK).agg(F.count("*").alias("rows")).where("rows > 1")
        large = (F.col("rows") > block_rows) & (F.col("v") - F.col("u") > 1)
        counts = stage(counts.withColumn("again", large), "sizes")
        # A word alone in its block has nothing to be compared with there.
        kept = open_rows.join(counts.where("NOT again").select(*BLOCK), BLOCK)
        done = kept if done is None else done.unionByName(kept)
        if counts.where("again").isEmpty():
            return done
        large_rows = open_rows.join(counts.where("again").select(*BLOCK), BLOCK)
        open_rows = stage(_dealt(large_rows, F.col("size"), _halves(F.col("u"), F.col("v"))), "blocks")


class _Words:
    """Code points of words, one row each, from the left and from the right."""

    def __init__(self, column: pa.Array, width: int):
        codes = [w.encode("latin-1") for w in column.to_pylist()]
        self.length = np.fromiter(map(len, codes), np.int64, len(codes))
        data = np.frombuffer(b"".join(codes), np.uint8)
        begin = np.cumsum(self.length) - self.length
        row = np.repeat(np.arange(len(codes)), self.length)
        place = np.arange(len(data)) - begin[row]
        self.left = np.zeros((len(codes) + 1, width), np.uint8)
        self.right = np.zeros((len(codes) + 1, width), np.uint8)
        self.left[row, place] = data
        self.right[row, self.length[row] - 1 - place] = data


def _common(a: np.ndarray, b: np.ndarray, width: int) -> np.ndarray:
    """Common leading code points, up to ``width``, of each row of a with each of b: (block, i, j)."""
    running = np.ones((a.shape[0], a.shape[1], b.shape[1]), bool)
    total = np.zeros(running.shape, np.int32)
    for c in range(width):
        running &= a[:, :, None, c] == b[:, None, :, c]
        if not running.any():
            break
        total += running
    return total


def _tile(found: _Words, rows_a: np.ndarray, rows_b: np.ndarray, size: int, u: int, v: int):
    """Near pairs (row of a, row of b) of stacked tiles; -1 pads a tile."""
    before = _common(found.left[rows_a], found.left[rows_b], v)
    after = _common(found.right[rows_a], found.right[rows_b], size - 1 - u)
    near = (before >= u) & (before < v) & (before + after >= size - 1)
    near &= (rows_a >= 0)[:, :, None] & (rows_b >= 0)[:, None, :]
    k, i, j = np.nonzero(near)
    a, b = rows_a[k, i], rows_b[k, j]
    # Two words of size - 1 letters are compared in the blocks of that size.
    keep = (a != b) & (np.maximum(found.length[a], found.length[b]) == size)
    return a[keep], b[keep]


def _pairs(found: _Words, starts: np.ndarray, counts: np.ndarray, size: int, u: int, v: int):
    """Near pairs, in both directions, of blocks of one (size, u, v)."""
    padded = 1 << np.ceil(np.log2(np.maximum(counts, 2))).astype(np.int64)
    for side in np.unique(padded[counts <= TILE_ROWS]):
        chosen = np.flatnonzero((padded == side) & (counts <= TILE_ROWS))
        step = max(1, CELLS // int(side * side))
        for at in range(0, len(chosen), step):
            some = chosen[at:at + step]
            place = np.arange(side)
            rows = np.where(place < counts[some, None], starts[some, None] + place, -1)
            yield _tile(found, rows, rows, size, u, v)
    for k in np.flatnonzero(counts > TILE_ROWS):
        rows = starts[k] + np.arange(counts[k])
        tiles = [rows[None, at:at + TILE_ROWS] for at in range(0, len(rows), TILE_ROWS)]
        for i, a in enumerate(tiles):
            for j in range(i, len(tiles)):
                found_a, found_b = _tile(found, a, tiles[j], size, u, v)
                yield found_a, found_b
                if j > i:
                    yield found_b, found_a


_OUT = "word string, n_near long, best_n long, best string"


def _compared(batches):
    """Task: rows sorted by block; per word and block the number of near words and the best one."""
    names = ["word", "n", *BLOCK]
    held = pa.RecordBatch.from_pylist([], pa.schema([("word", pa.string()), ("n", pa.int64()), ("size", pa.int32()),
                                                     ("u", pa.int32()), ("v", pa.int32()), ("key", pa.int64())]))

    def whole(table: pa.Table):
        shape = np.stack([table[c].to_numpy() for c in BLOCK])
        block = np.flatnonzero(np.append(True, (shape[:, 1:] != shape[:, :-1]).any(0)))
        group = np.flatnonzero(np.append(True, (shape[:3, 1:] != shape[:3, :-1]).any(0)))
        ends = np.append(block, table.num_rows)
        for begin, end in zip(group, np.append(group[1:], table.num_rows), strict=True):
            size, u, v = (int(x) for x in shape[:3, begin])
            part = table.slice(begin, end - begin)
            chosen = (block >= begin) & (block < end)
            starts = block[chosen] - begin
            counts = np.diff(ends)[chosen]
            found = _Words(part["word"], size)
            n = part["n"].to_numpy()
            order = pc.sort_indices(part, [("n", "descending"), ("word", "ascending")]).to_numpy()
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            near, best = np.zeros(len(n), np.int64), np.full(len(n), len(n))
            for a, b in _pairs(found, starts, counts, size, u, v):
                near += np.bincount(a, minlength=len(n))
                np.minimum.at(best, a, rank[b])
            at = np.flatnonzero(near)
            top = order[best[at]]
            word = part["word"].combine_chunks()
            yield pa.RecordBatch.from_arrays(
                [word.take(pa.array(at)), pa.array(near[at]), pa.array(n[top]), word.take(pa.array(top))],
                ["word", "n_near", "best_n", "best"])

    for batch in batches:
        table = pa.Table.from_batches([held, batch.select(names).cast(held.schema)])
        if not table.num_rows:
            continue
        keys = np.stack([table[c].to_numpy() for c in BLOCK])
        differs = np.flatnonzero((keys != keys[:, -1:]).any(0))
        cut = differs[-1] + 1 if len(differs) else 0  # the last block may go on in the next batch
        yield from whole(table.slice(0, cut)) if cut else ()
        held = table.slice(cut).combine_chunks().to_batches()[0]
    if held.num_rows:
        yield from whole(pa.Table.from_batches([held]))


def near_words(counted: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """word, n_near, best_n, best: of each word that has near words their number and the one of
    largest n (ties: the first in code-point order)."""
    dealt = blocks(counted, block_rows)
    sorted_rows = dealt.repartition(*BLOCK).sortWithinPartitions(*BLOCK)
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    return sorted_rows.mapInArrow(_compared, _OUT).groupBy("word").agg(
        F.sum("n_near").alias("n_near"), best.alias("top")).select(
        "word", "n_near", (-F.col("top.n")).alias("best_n"), F.col("top.word").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for the rows (word, form): the last word that forms lead to."""
    now = stage(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        then = stage(now.join(ahead, "root", "left").select("word", "root", "further"), "roots")
        now = then.select("word", F.coalesce("further", "root").alias("root"))
        if then.where("further IS NOT NULL").isEmpty():
            return now


def variants(docs: DataFrame, ratio: int = RATIO, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word."""
    counted = stage(words(docs), "words")
    near = stage(near_words(counted, block_rows).join(counted, "word").select(
        "word", "n_near", *[F.when(F.col("best_n") >= ratio * F.col("n"), F.col(c)).alias(name)
                            for c, name in (("best", "form"), ("best_n", "form_n"))]), "near")
    ends = roots(near.where("form IS NOT NULL"))
    return counted.join(near, "word", "left").join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n",
        F.coalesce("n_near", F.lit(0)).alias("n_near"), "form_n")
