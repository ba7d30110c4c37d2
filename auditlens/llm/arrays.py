"""Numpy helpers for whole texts inside tasks: words, hashes, windows and minimizers.

Texts are handled in slices of a few MB, so a task needs memory for one slice (or one longer
text) at a time, however many rows it has. Hashes are 64 bit and do not depend on the process.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
SLICE_BYTES = 1 << 18
# Odd multipliers of a well-known 64-bit finaliser; any odd constants would do.
_M1, _M2, _GOLD = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB), U(0x9E3779B97F4A7C15)

#: Bytes between words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: The same and ASCII punctuation and control bytes: words of letters and digits only.
PUNCTUATION = np.array([c < 0x80 and not chr(c).isalnum() for c in range(256)])
#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = x ^ (x >> U(30))
    x *= _M1
    x ^= x >> U(27)
    x *= _M2
    x ^= x >> U(31)
    return x


def seeds(count: int, salt: int = 0) -> np.ndarray:
    """``count`` fixed odd multipliers."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, count + 1, dtype=U) + U(salt * 1000)) * _GOLD) | U(1)


_BYTE = mix(np.arange(1, 257, dtype=U) * _GOLD)
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], U)


_held: dict = {}


def held(key, make):
    """What the tasks of one operator share in a worker, made by the first of them."""
    let_go(key)
    if key not in _held:
        _held[key] = make()
    return _held[key]


def let_go(keep=None) -> None:
    """Drop what tasks of other operators have left in this worker, but for the key ``keep``.

    Workers outlive stages. Without this, one that has been through a pipeline would go on
    holding the tables of each operator at once. Each task calls it first, mostly by ``slices``.
    """
    gone = [key for key in _held if key != keep]
    for key in gone:
        del _held[key]
    if gone:
        pa.default_memory_pool().release_unused()


def slices(batches: Iterator[pa.RecordBatch], limit: int = SLICE_BYTES, keep=None):
    """Cut batches into slices of at most ``limit`` bytes of text (one row at least).

    Gives (slice, ids, texts): the columns ``doc_id`` and ``text`` of the slice, the texts as
    bytes, a null text as an empty one. ``keep`` is the key of what the operator itself holds.
    """
    let_go(keep)
    for batch in batches:
        column = batch.column("text").cast(pa.binary())
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(column), 0), np.int64))
        first = 0
        while first < len(column):
            before = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, before + limit, "right")))
            texts = [t or b"" for t in column[first:last].to_pylist()]
            yield batch.slice(first, last - first), batch.column("doc_id")[first:last], texts
            first = last
    # A worker that waits for its next task gives back what this one held.
    pa.default_memory_pool().release_unused()


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one byte array with a line feed after each, and where each one starts."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    return data, np.concatenate(([0], ends))


def word_bounds(data: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that are no gap bytes."""
    solid = np.zeros(len(data) + 2, np.int8)
    solid[1:-1] = ~gap[data]
    edges = np.flatnonzero(np.diff(solid))
    return edges[0::2], edges[1::2]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each span of bytes, equal for equal contents.

    Each block of 8 bytes of a span is scrambled with its number before the blocks are added.
    (A polynomial modulo 2**64 would give one hash to the two Thue-Morse words of 1024 bytes.)
    """
    lengths = np.asarray(ends - starts, np.int64)
    blocks = (lengths + 7) // 8
    first = np.cumsum(blocks) - blocks
    number = np.arange(int(blocks.sum())) - np.repeat(first, blocks)
    windows = np.lib.stride_tricks.sliding_window_view(np.concatenate((data, np.zeros(8, np.uint8))), 8)
    values = np.zeros(len(number) + 1, U)
    values[:-1] = windows[np.repeat(starts, blocks) + 8 * number].view("<u8")[:, 0]
    values[:-1] &= _MASKS[np.minimum(np.repeat(lengths, blocks) - 8 * number, 8)]
    values[:-1] = mix(values[:-1] + (number + 1).astype(U) * _GOLD)
    sums = np.add.reduceat(values, first) if len(first) else np.zeros(0, U)
    sums[blocks == 0] = 0
    return mix(sums + lengths.astype(U) * _GOLD)


class Words:
    """Word hashes of a slice of texts; ``first[i]`` to ``first[i + 1]`` are those of text i."""

    def __init__(self, texts: list[bytes], gap: np.ndarray = SPACE, lower: bool = False):
        data, offsets = joined(texts)
        self.data = LOWER[data] if lower else data
        self.starts, self.ends = word_bounds(data, gap)
        self.first = np.searchsorted(self.starts, offsets)
        self.hashes = (span_hashes(self.data, self.starts, self.ends) if len(self.starts)
                       else np.zeros(0, U))

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owners(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts())


def grams(hashes: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """Hash of ``n`` consecutive values at each place that has so many."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, U)
    total = np.zeros(count, U)
    for j, factor in enumerate(seeds(n, salt)):
        total += hashes[j:j + count] * factor
    return mix(total)


def inside(first: np.ndarray, total: int, n: int) -> np.ndarray:
    """Which of the places 0.. of runs of ``n`` values lie within one text."""
    good = np.zeros(max(total - n + 1, 0), bool)
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= n:
            good[a:b - n + 1] = True
    return good


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return np.minimum(values[:-rest], values[rest:]) if rest else values


PLACE_BITS = 24


def minimizers(hashes: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost smallest hash of each window of ``width`` hashes.

    Which one is smallest depends on the content of the window alone, so equal windows have
    equal minimizers at equal offsets. Long inputs go piece by piece, as a place has PLACE_BITS bits.
    """
    low, count = U((1 << PLACE_BITS) - 1), len(hashes) - width + 1
    step = (1 << PLACE_BITS) - width
    found = [np.zeros(0, np.int64)]
    for at in range(0, count, step):
        piece = hashes[at:at + step + width - 1]
        marked = (piece & ~low) | np.arange(len(piece), dtype=U)
        found.append((sliding_min(marked, width) & low).astype(np.int64) + at)
    return np.concatenate(found)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All numbers of the ranges [start, start + length), one range after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def blobs(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """The values from each cut to the next one as one binary cell each."""
    data = np.ascontiguousarray(values)
    offsets = pa.py_buffer((cuts * data.itemsize).astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, offsets, pa.py_buffer(data)])


def unpacked(column: pa.ChunkedArray | pa.Array, kind) -> np.ndarray:
    """The values of all binary cells of a column, one cell after the other."""
    return np.frombuffer(b"".join(x for x in column.to_pylist() if x), kind)
