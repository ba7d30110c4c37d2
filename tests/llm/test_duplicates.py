"""Operators 1, 8 and 9 against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditlens.llm import arrays, minhash, substrings, suffixes
from auditlens.llm.queries import QUERIES
from tests.llm.conftest import prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SMALL = "/root/testdata/sf0.001"


def kept_words(corpus, k=13):
    first = {}
    words = {i: WORD.findall(t or "") for i, t in corpus}
    for i, w in words.items():
        for p in range(len(w) - k + 1):
            key = tuple(w[p:p + k])
            first[key] = min(first.get(key, i), i)
    out = {}
    for i, w in words.items():
        gone = set()
        for p in range(len(w) - k + 1):
            if first[tuple(w[p:p + k])] < i:
                gone |= set(range(p, p + k))
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def kept_bytes(corpus, length):
    data = {i: (t or "").encode() for i, t in corpus}
    count = Counter(d[p:p + length] for d in data.values() for p in range(len(d) - length + 1))
    out = {}
    for i, d in data.items():
        gone = bytearray(len(d))
        for p in range(len(d) - length + 1):
            if count[d[p:p + length]] > 1:
                gone[p:p + length] = b"\1" * length
        spans = len(re.findall(b"\1+", bytes(gone)))
        kept = bytes(b for b, g in zip(d, gone) if not g)
        out[i] = (len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def classes(corpus, size, percent=80):
    sets = {}
    for i, t in corpus:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[p:p + size]) for p in range(len(w) - size + 1)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and (both := len(sets[a] & sets[b])) and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i), i == find(i)) for i, s in sets.items()}


def test_words_that_repeat_an_earlier_document_go(docs, corpus):
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substrings.remove_repeated(docs).collect()}
    assert got == kept_words(corpus)


@pytest.mark.parametrize("edges", [0, 40])
def test_hot_buckets_of_edges_do_not_change_the_result(docs, corpus, monkeypatch, edges):
    monkeypatch.setattr(substrings, "HOT_EDGES", edges)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substrings.remove_repeated(docs).collect()}
    assert got == kept_words(corpus)


def test_no_bucket_of_many_edges_is_gathered(docs, monkeypatch):
    monkeypatch.setattr(substrings, "HOT_EDGES", 40)
    want = {tuple(r) for r in substrings.repeated_spans(docs).collect()}
    given = substrings.with_ids(docs)
    sizes = {r["bucket"]: r["n"] for r in given.mapInArrow(
        substrings._counted(13, 256), "bucket int, edges long").groupBy("bucket").agg(F.sum("edges").alias("n")).collect()}
    hot = np.array([b for b, n in sizes.items() if n > 40], np.int32)
    assert len(hot) and len(hot) < len(sizes)
    packed = given.mapInArrow(
        substrings._edges(13, 256, hot), "bucket int, docs binary, places binary, lengths binary, keys binary")
    gathered = packed.groupBy("bucket").agg(F.sum(F.octet_length("keys") / 8).alias("n")).collect()
    assert {r["bucket"]: r["n"] for r in gathered} == {b: n for b, n in sizes.items() if n <= 40}
    monkeypatch.undo()
    assert {tuple(r) for r in substrings.repeated_spans(docs).collect()} == want


def test_spans_name_a_place_with_the_same_words(docs, corpus):
    words = {i: WORD.findall(t or "") for i, t in corpus}
    spans = substrings.repeated_spans(docs).collect()
    assert spans
    for s in spans:
        size = s["end"] - s["start"]
        assert size >= 13 and s["source_id"] < s["doc_id"]
        assert words[s["doc_id"]][s["start"]:s["end"]] == words[s["source_id"]][s["source_start"]:s["source_start"] + size]


@pytest.mark.parametrize("length", [64, 200])
def test_bytes_of_repeated_strings_go(docs, corpus, length):
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"])
           for r in suffixes.remove_repeated(docs, length).collect()}
    assert got == kept_bytes(corpus, length)


def test_suffix_blocks_and_pieces_do_not_change_the_result(docs, corpus, monkeypatch):
    monkeypatch.setattr(suffixes, "BLOCK_BYTES", 500)
    rows = [(i, t) for i, t in corpus if i >= 400]
    fragments = [(t or "").encode() for _, t in rows]
    cut = [x for t in fragments for x in suffixes._cut(None, [t], 200)]
    assert sum(len(c[1]) for c in cut) >= len(fragments)
    monkeypatch.setattr(suffixes, "PIECE_BYTES", 1000)
    pieces = list(suffixes._cut(None, [b"x" * 2500], 200))
    assert [(len(p[1][0]), p[2]) for p in pieces] == [(1199, 0), (1199, 1000), (500, 2000)]


def test_a_common_line_in_ever_other_contexts_is_not_gathered(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "ANCHOR_FRAGMENTS", 10)
    rng = random.Random(6)
    line, long = prose(rng, 30)[:120], prose(rng, 80)[:260]
    rows = [(i, f"{prose(rng, 60)} {line if i % 4 else long} {prose(rng, 60)}") for i in range(48)]
    rows += [(100 + i, rows[i][1]) for i in range(6)] + [(200, rows[20][1][100:600])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"])
           for r in suffixes.remove_repeated(docs).collect()}
    assert got == kept_bytes(rows, 200)
    given = suffixes.with_ids(docs)
    runs = given.mapInArrow(suffixes._anchors(200), "doc_id long, seed long, place long, content long")
    assert runs.groupBy("seed").agg(F.countDistinct("content").alias("n")).agg(F.max("n")).first()[0] > 10
    held = suffixes._held(given, 200)
    fragments = held.mapInArrow(
        suffixes._fragments(200, 4, True), "bucket int, seed long, distance int, fragment binary, n long")
    most = fragments.groupBy("seed").agg(F.countDistinct("fragment").alias("n")).agg(F.max("n")).first()[0]
    assert most <= 10


def thue_morse(size):
    """Two different words whose polynomials modulo 2**64 are equal, whatever the base."""
    one = bytes(b"ab"[i.bit_count() & 1] for i in range(size))
    return one, one.translate(bytes.maketrans(b"ab", b"ba"))


def test_hashes_tell_spans_apart_and_depend_on_content_alone():
    rng = random.Random(9)
    spans = [b"", *thue_morse(1024), *thue_morse(2048), b"a", b"a\0", b"\0a", b"abcdefgh", b"abcdefgh\0", b"12345678abcdefgh", b"abcdefgh12345678"]
    spans += [rng.randbytes(rng.randint(0, 40)) for _ in range(500)]
    seen = {}
    for shift in (0, 3):
        data, starts = np.frombuffer(b"x" * shift + b"".join(s + b"x" * shift for s in spans), np.uint8), []
        at = shift
        for s in spans:
            starts.append(at)
            at += len(s) + shift
        starts = np.array(starts)
        for s, h in zip(spans, arrays.span_hashes(data, starts, starts + [len(x) for x in spans]).tolist(), strict=True):
            assert seen.setdefault(s, h) == h
    assert len(set(seen.values())) == len(seen)


def test_long_words_that_differ_are_not_repeats(spark):
    rows = []
    for i, word in enumerate(thue_morse(1024)):
        rows += [(i + 1, " ".join([f"w{k}" for k in range(12)] + [word.decode()])), (i + 11, word.decode())]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["n_removed"] for r in substrings.remove_repeated(docs).collect()} == {1: 0, 2: 0, 11: 0, 12: 0}
    assert {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs, 2).collect() if r["doc_id"] > 10} == {11: 11, 12: 12}


def test_minimizers_of_long_inputs_are_those_of_short_ones(monkeypatch):
    hashes = arrays.mix(np.arange(1000, dtype=arrays.U) % arrays.U(37)) & ~arrays.U((1 << 24) - 1)
    want = arrays.minimizers(hashes, 9)
    assert want.tolist() == [i + int(hashes[i:i + 9].argmin()) for i in range(992)]
    monkeypatch.setattr(arrays, "PLACE_BITS", 6)
    assert arrays.minimizers(hashes, 9).tolist() == want.tolist()
    assert len(arrays.minimizers(hashes[:8], 9)) == 0


def test_cover_brings_any_two_residues_together():
    for i in range(suffixes.PERIOD):
        for j in range(suffixes.PERIOD):
            d = suffixes.cover_distance(i, j)
            assert (i + d) % 8 in suffixes.COVER and (j + d) % 8 in suffixes.COVER


@pytest.mark.parametrize("size", [2, 5])
def test_classes_are_those_of_all_pairs(docs, corpus, size):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs, size).collect()}
    assert got == classes(corpus, size)


def test_tiles_and_drawn_members_do_not_change_the_classes(docs, corpus, monkeypatch):
    monkeypatch.setattr(minhash, "TILE", 4)
    monkeypatch.setattr(minhash, "DRAWN", 1)
    monkeypatch.setattr(minhash, "COLUMNS", 50)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs, 2).collect()}
    assert got == classes(corpus, 2)


def test_empty_tables(no_docs):
    assert substrings.remove_repeated(no_docs).collect() == []
    assert suffixes.remove_repeated(no_docs).collect() == []
    assert minhash.near_duplicates(no_docs).collect() == []


def test_rows_without_id_and_repeated_rows(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = spark.createDataFrame([(None, text), (7, text), (7, text), (3, text)], "doc_id long, text string")
    words = sorted((r["doc_id"] or 0, r["n_removed"]) for r in substrings.remove_repeated(rows).collect())
    assert words == [(0, 0), (3, 0), (7, 60), (7, 60)]
    size = len(text)
    cut = sorted((r["doc_id"] or 0, r["n_removed"]) for r in suffixes.remove_repeated(rows).collect())
    assert cut == [(0, 0), (3, size), (7, size), (7, size)]
    near = sorted((r["doc_id"] or 0, r["component_id"], r["kept"]) for r in minhash.near_duplicates(rows).collect())
    assert near == [(0, None, True), (3, 3, True), (7, 3, False), (7, 3, False)]


@pytest.mark.parametrize("name", ["op1_substring_dedup", "op8_suffix_dedup", "op9_minhash"])
def test_queries_on_the_smallest_tables(spark, name):
    corpus = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    want = {"op1_substring_dedup": kept_words, "op8_suffix_dedup": lambda c: kept_bytes(c, 200),
            "op9_minhash": lambda c: classes(c, 2)}[name](corpus)
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES[name](spark, SMALL).collect()}
    assert got == want
