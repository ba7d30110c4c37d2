"""Exact removal of repeated byte strings by blockwise suffix sorting with a difference cover.

Every string of ``length`` bytes that starts twice anywhere is found, and all bytes that such
strings cover are removed. Only suffixes that can have a long common prefix are sorted:

1. Each window of ``length`` bytes has an anchor, its smallest hash of ``SEED`` bytes. Equal
   windows have equal anchors at equal distances. Consecutive windows with one anchor are a run;
   runs whose anchor occurs once cannot repeat and go no further (a count and an equi-join).
2. The bytes of the other runs are fragments. Equal fragments of a task are put together before
   they are shuffled to buckets by their anchor.
3. In its bucket each fragment is sorted blockwise, with the suffixes at one distance from one
   anchor as one suffix bucket. A block is closed at ``BLOCK_BYTES``; an anchor adds at most
   ``ANCHOR_FRAGMENTS`` different fragments to it, which bounds the memory.
   Positions whose number modulo ``PERIOD`` is in the difference cover ``COVER`` are ranked by
   their long prefixes first (prefix doubling: as the cover is periodic, a shift by a multiple of
   the period stays in it). Two suffixes are then compared by the few bytes up to a cover position
   of both, the rank there, and the few bytes behind it, however long they agree.
4. Neighbours of the sorted suffixes that agree on ``length`` bytes are repeats.
5. An anchor with more different fragments (a common line in ever other contexts) is not gathered:
   it is made longer. Each window reaches half of its free bytes either to the left or to the
   right of the anchor, so a run falls into at most two, whose anchors are the old one and these
   bytes; equal windows still share anchor and distance. Longer anchors that occur once go no
   further, those with few fragments are sorted, and the rest is made longer again. An anchor of
   all ``length`` bytes has one fragment, so this ends after as many rounds as ``length`` has bits.

Texts of documents without repeated anchors are not shuffled. Null and empty texts have no bytes.
Rows without doc_id are left as they are. Rows that share a doc_id are rows of one document: a
span found in one of them is removed from each.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlens.llm.arrays import _BYTE, U, joined, minimizers, mix, ranges, seeds, slices, span_hashes
from auditlens.llm.frames import only_ids, text_bytes, texts, with_ids
from auditlens.sources.staging import stage

LENGTH, SEED = 200, 32
#: Longer texts are cut into pieces that overlap by a window.
PIECE_BYTES = 8 << 20
PERIOD, COVER = 8, (0, 1, 2, 4)
BLOCK_BYTES, BUCKET_BYTES, LEAST_BUCKETS = 4 << 20, 64 << 20, 256
#: Most different fragments of one anchor that are gathered; a task remembers so many fragments.
ANCHOR_FRAGMENTS, REMEMBERED = 1024, 1 << 16


def cover_distance(one: int, two: int) -> int:
    """The least shift that brings positions of both residues into the cover."""
    return next(d for d in range(PERIOD) if (one + d) % PERIOD in COVER and (two + d) % PERIOD in COVER)


def seed_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the SEED bytes at each place, by doubling."""
    hashes, size = _BYTE[data], 1
    for a, b in seeds(10, 11).reshape(-1, 2):
        hashes = hashes[:-size] * a + hashes[size:] * b
        size *= 2
    assert size == SEED
    return mix(hashes)


def runs(rows: list[bytes], length: int):
    """(text, start, windows, distance of the anchor, anchor hash, hash of the bytes) of all runs
    of the texts."""
    data, offsets = joined(rows)
    count = len(data) - length + 1
    if count <= 0:
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, U),) * 2
    hashes = seed_hashes(data)
    anchors = minimizers(hashes, length - SEED + 1)[:count]
    # A window is good if it ends before the line feed that joined() put behind its text.
    last = np.repeat(offsets[1:] - 1 - length, np.diff(offsets))[:count]
    good = np.arange(count) <= last
    new = good.copy()
    new[1:] &= (anchors[1:] != anchors[:-1]) | ~good[:-1]
    starts = np.flatnonzero(new)
    stop = good.copy()
    stop[:-1] &= new[1:] | ~good[1:]
    sizes = np.flatnonzero(stop) + 1 - starts
    owner = np.searchsorted(offsets, starts, "right") - 1
    content = span_hashes(data, starts, starts + sizes + length - 1)
    return owner, starts - offsets[owner], sizes, anchors[starts] - starts, hashes[anchors[starts]], content


def _cut(ids: pa.Array, rows: list[bytes], length: int):
    """The texts of a slice, a very long one in overlapping pieces: (ids, texts, base)."""
    if len(rows) > 1 or len(rows[0]) <= PIECE_BYTES:
        yield ids, rows, 0
    else:
        for at in range(0, max(len(rows[0]) - length + 1, 1), PIECE_BYTES):
            yield ids, [rows[0][at:at + PIECE_BYTES + length - 1]], at


def _anchors(length: int):
    def run(batches):
        for _, whole_ids, whole in slices(batches):
            for ids, rows, base in _cut(whole_ids, whole, length):
                owner, start, size, distance, seed, content = runs(rows, length)
                place = (start + base) << 16 | distance << 8 | (size - 1)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(owner)), pa.array(seed.view(np.int64)), pa.array(place), pa.array(content.view(np.int64))],
                    ["doc_id", "seed", "place", "content"])

    return run


def _digest(fragment: bytes) -> bytes:
    return hashlib.blake2b(fragment, digest_size=16).digest()


def _fragments(length: int, bucket_count: int, whole: bool):
    """Task: fragments with their bytes, equal ones of a slice once and of a task seldom more than
    twice; or where each one is."""

    def run(batches):
        given: dict[tuple[int, int, bytes], int] = {}
        for batch, ids, rows in slices(batches):
            found: dict[tuple[int, int, bytes], int] = {}
            docs, starts, digests = [], [], []
            for i, (text, places) in enumerate(zip(rows, batch.column("places").to_pylist(), strict=True)):
                # Rows of one document may share a place.
                for seed, place in {(p["seed"], p["place"]) for p in places}:
                    start = place >> 16
                    fragment = text[start:start + (place & 255) + length]
                    if whole:
                        key = seed, place >> 8 & 255, fragment
                        found[key] = found.get(key, 0) + 1
                    else:
                        docs.append(i)
                        starts.append(start)
                        digests.append(_digest(fragment))
            if whole:
                # Only whether there are several counts: what was given twice says so already.
                for key in list(found):
                    short = *key[:2], _digest(key[2])
                    if (before := given.get(short, 0)) > 1:
                        del found[key]
                    else:
                        given[short] = before + found[key]
                if len(given) > REMEMBERED:
                    given.clear()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k[0] % bucket_count for k in found], pa.int32()), pa.array([k[0] for k in found], pa.int64()),
                     pa.array([k[1] for k in found], pa.int32()), pa.array([k[2] for k in found], pa.binary()),
                     pa.array(list(found.values()), pa.int64())], ["bucket", "seed", "distance", "fragment", "n"])
            else:
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(docs, pa.int64())), pa.array(starts, pa.int64()), pa.array(digests, pa.binary())],
                    ["doc_id", "start", "digest"])

    return run


def _longer(length: int):
    """Task: the runs of wide anchors again, with longer anchors, each cut in two where need be.

    All windows of a run hold ``low`` bytes before its anchor and ``high`` behind its seed.
    """

    def run(batches):
        for batch, ids, rows in slices(batches):
            data, offsets = joined(rows)
            found = np.array([
                (i, *r) for i, (text, places) in enumerate(zip(rows, batch.column("runs").to_pylist(), strict=True))
                for r in sorted({(p["place"], p["low"], p["high"]) for p in places})
                if (r[0] >> 16) + (r[0] & 255) + length <= len(text)], np.int64).reshape(-1, 4)
            owner, place, low, high = found.T
            distance, size = place >> 8 & 255, (place & 255) + 1
            left = (length - SEED - low - high + 1) // 2
            right = length - SEED - low - high - left + 1
            # Windows before the cut hold ``left`` bytes more before the anchor, the others ``right`` behind.
            cut = np.clip(distance - low - left + 1, 0, size)
            one, two = np.flatnonzero(cut > 0), np.flatnonzero(cut < size)
            at = np.concatenate((one, two))
            start = np.concatenate((np.zeros(len(one), np.int64), cut[two]))
            size = np.concatenate((cut[one], size[two] - cut[two]))
            low, high = np.concatenate(((low + left)[one], low[two])), np.concatenate((high[one], (high + right)[two]))
            distance, start = distance[at] - start, (place >> 16)[at] + start
            begin = offsets[owner[at]] + start
            anchor = begin + distance
            seed = mix(span_hashes(data, anchor - low, anchor + SEED + high) + low.astype(U) * seeds(1, 12))
            content = span_hashes(data, begin, begin + size - 1 + length)
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(owner[at])), pa.array(seed.view(np.int64)), pa.array(start << 16 | distance << 8 | (size - 1)),
                 pa.array(content.view(np.int64)), pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32))],
                ["doc_id", "seed", "place", "content", "low", "high"])

    return run


def _dense(keys: np.ndarray) -> np.ndarray:
    """Rank of each key among the different ones; ranks are under 2**31."""
    order = np.argsort(keys)
    step = np.zeros(len(order), np.int64)
    step[1:] = keys[order[1:]] != keys[order[:-1]]
    ranks = np.empty(len(order), np.int64)
    ranks[order] = np.cumsum(step)
    return ranks


def _both(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """One number for two ranks, the first counting most; such numbers are sorted without lexsort."""
    return one << 32 | two


def equal_windows(fragments: list[bytes], seed: np.ndarray, distance: np.ndarray, length: int) -> list[np.ndarray]:
    """For one block: which windows of each fragment start more than once in the block.

    ``distance`` is that from the start of a fragment to its anchor, ``seed`` numbers the anchors.
    """
    sizes = np.array([len(f) for f in fragments])
    # Anchors start at multiples of the period, so equal windows have equal residues.
    room = -(-(sizes + PERIOD) // PERIOD) * PERIOD
    starts = np.cumsum(room) - room + (-distance % PERIOD)
    text = np.zeros(int(room.sum()) + PERIOD, np.uint8)
    text[ranges(starts, sizes)] = np.frombuffer(b"".join(fragments), np.uint8)

    def words(at: np.ndarray) -> np.ndarray:
        value = np.zeros(len(at), U)
        for j in range(PERIOD):
            value = value << U(8) | text[at + j]
        return value

    # Ranks of the cover positions by their first 8, 16, ... bytes, and at last by ``reach``.
    places = ranges(starts, sizes - PERIOD + 1)
    places = places[np.isin(np.arange(PERIOD), COVER)[places % PERIOD]]
    limit = np.repeat(starts + sizes, sizes - PERIOD + 1)[np.isin(np.arange(PERIOD), COVER)[ranges(starts, sizes - PERIOD + 1) % PERIOD]]
    rank = np.zeros(len(text), np.int64)
    rank[places] = _dense(words(places))
    reach, size = (length - PERIOD) // PERIOD * PERIOD, PERIOD
    while size < reach:
        further = min(size, reach - size)
        # The last step may overlap: its second half is as long as the first one.
        shift = size if further == size else reach - size
        inside = places + shift + size <= limit
        places, limit = places[inside], limit[inside]
        new = np.zeros(len(text), np.int64)
        new[places] = _dense(_both(rank[places], rank[places + shift]))
        rank, size = new, size + further
    windows = sizes - length + 1
    at = ranges(starts, windows)
    owner = np.repeat(np.arange(len(fragments)), windows)
    to_anchor = distance[owner] - (at - starts[owner])
    shift = np.array([cover_distance(r, r) for r in range(PERIOD)])[at % PERIOD]
    # Suffix buckets one after the other: anchor and distance first, then head, rank and tail.
    head = _both(_dense((seed[owner] << 8) + to_anchor + 255), _dense(words(at)))
    tail = _both(rank[at + shift], _dense(words(at + length - PERIOD)))
    keys = _both(_dense(head), _dense(tail))
    order = np.argsort(keys)
    same = keys[order[1:]] == keys[order[:-1]]
    twice = np.zeros(len(order), bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    return np.split(twice, np.cumsum(windows)[:-1])


def _repeats(length: int):
    """One bucket: parts of fragments that repeated windows cover."""

    def run(group: pa.Table) -> pa.Table:
        number: dict[tuple[int, int, bytes], int] = {}
        for key, n in zip(zip(group["seed"].to_pylist(), group["distance"].to_pylist(),
                              group["fragment"].to_pylist(), strict=True), group["n"].to_pylist(), strict=True):
            number[key] = number.get(key, 0) + n
        by_seed: dict[int, list[tuple[int, bytes, int]]] = {}
        for (seed, distance, fragment), n in number.items():
            by_seed.setdefault(seed, []).append((distance, fragment, n))
        digests, lows, highs = [], [], []

        def report(fragment: bytes, twice: np.ndarray | None) -> None:
            at = [0] if twice is None else np.flatnonzero(twice)
            if len(at):
                cut = np.flatnonzero(np.diff(at) > 1) if twice is not None else np.zeros(0, int)
                low = np.asarray(at)[np.append(0, cut + 1)]
                high = np.asarray(at)[np.append(cut, len(at) - 1)] + length
                if twice is None:
                    high = np.array([len(fragment)])
                digests.extend([_digest(fragment)] * len(low))
                lows.extend(low.tolist())
                highs.extend(high.tolist())

        block: list[tuple[int, int, bytes, int]] = []
        size = 0

        def sort_block() -> None:
            nonlocal size
            if block:
                flags = equal_windows([b[2] for b in block], np.array([b[0] for b in block]),
                                      np.array([b[1] for b in block]), length)
                for (_, _, fragment, n), twice in zip(block, flags, strict=True):
                    report(fragment, None if n > 1 else twice)
            block.clear()
            size = 0

        for i, same in enumerate(by_seed.values()):
            if len(same) == 1:
                # All runs of this anchor are alike; that there are several was counted before.
                distance, fragment, n = same[0]
                if n > 1:
                    report(fragment, None)
                continue
            block += [(i, *x) for x in same]
            size += sum(len(x[1]) for x in same)
            if size >= BLOCK_BYTES:
                sort_block()
        sort_block()
        return pa.table({"digest": pa.array(digests, pa.binary()), "low": pa.array(lows, pa.int64()),
                         "high": pa.array(highs, pa.int64())})

    return run


def repeated_bytes(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, start, end (exclusive, bytes): parts covered by strings of ``length`` bytes that
    start at least twice. Parts of one document may overlap."""
    if length - SEED + 1 > 255 or length < SEED + 2 * PERIOD:
        raise ValueError(f"length must be from {SEED + 2 * PERIOD} to {SEED + 254}")
    given = with_ids(docs)
    buckets = max(LEAST_BUCKETS, text_bytes(given) // BUCKET_BYTES)
    held = _held(given, length)
    fragments = held.mapInArrow(
        _fragments(length, buckets, True), "bucket int, seed long, distance int, fragment binary, n long")
    repeats = fragments.groupBy("bucket").applyInArrow(_repeats(length), "digest binary, low long, high long")
    spots = held.mapInArrow(_fragments(length, buckets, False), "doc_id long, start long, digest binary")
    return spots.join(repeats, "digest").select(
        "doc_id", (F.col("start") + F.col("low")).alias("start"), (F.col("start") + F.col("high")).alias("end"))


def _held(given: DataFrame, length: int) -> DataFrame:
    """The texts with runs whose anchor occurs more than once, with these runs. No anchor has
    more than ANCHOR_FRAGMENTS different fragments."""
    runs = given.mapInArrow(_anchors(length), "doc_id long, seed long, place long, content long").select(
        "*", F.lit(0).alias("low"), F.lit(0).alias("high"))
    found = []
    while True:
        # Written first, so that Spark can split a hot anchor in the join. What repeats is written
        # too: texts are read for their anchors twice, once to count and once to keep.
        several = stage(runs.groupBy("seed").count().where("count > 1"), "seeds")
        rows = stage(runs.join(several, "seed"), "repeated")
        wide = stage(rows.where(F.col("count") > ANCHOR_FRAGMENTS).select("seed", "content").distinct().groupBy("seed").agg(
            F.count("*").alias("n")).where(F.col("n") > ANCHOR_FRAGMENTS).select("seed"), "wide")
        found.append(rows.join(wide, "seed", "left_anti").select("doc_id", "seed", "place"))
        if wide.isEmpty():
            break
        hot = stage(rows.join(wide, "seed").groupBy("doc_id").agg(
            F.collect_list(F.struct("place", "low", "high")).alias("runs")), "runs")
        runs = stage(only_ids(given, stage(hot.select("doc_id"), "ids")).join(hot, "doc_id").select("doc_id", "text", "runs").mapInArrow(
            _longer(length), "doc_id long, seed long, place long, content long, low int, high int"), "runs")
    places = stage(reduce(DataFrame.unionByName, found).groupBy("doc_id").agg(
        F.collect_list(F.struct("seed", "place")).alias("places")), "places")
    ids = stage(places.select("doc_id"), "ids")
    return only_ids(given, ids).join(places, "doc_id").select("doc_id", "text", "places")


def _kept(batches):
    for batch, _, rows in slices(batches):
        out = []
        for text, spans in zip(rows, batch.column("spans").to_pylist(), strict=True):
            kept, at, removed, count = [], 0, 0, 0
            last = -1
            for a, b in sorted((s["start"], s["end"]) for s in spans or ()):
                a, b = min(a, len(text)), min(b, len(text))
                if a > last:
                    kept.append(text[at:a])
                    count += b > a
                    removed += b - a
                    at = last = b
                elif b > at:
                    removed += b - at
                    at = last = b
            kept.append(text[at:])
            rest = b"".join(kept)
            out.append((len(text), removed, count, hashlib.sha256(rest).hexdigest(), rest))
        names = ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *[pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds)]],
            ["doc_id", *names])


KEPT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def remove_repeated(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Each document without its repeated bytes: doc_id, n_bytes, n_removed, n_spans (maximal
    removed runs), kept_sha256, kept (bytes, as a cut may fall within a character)."""
    spans = stage(repeated_bytes(docs, length).groupBy("doc_id").agg(
        F.collect_list(F.struct("start", "end")).alias("spans")), "spans")
    ids = stage(spans.select("doc_id"), "ids")
    given = texts(docs)
    touched = only_ids(given, ids).join(spans, "doc_id").select("doc_id", "text", "spans")
    clean = only_ids(given, ids, "left_anti").select("doc_id", "text", F.lit(None).cast(spans.schema["spans"].dataType).alias("spans"))
    return touched.unionByName(clean).mapInArrow(_kept, KEPT)
