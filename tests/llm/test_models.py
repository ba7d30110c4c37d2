"""Operators 5, 7 and 10: exact round trips, brute force and held-out accuracy."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from auditlens.llm import bpe, language, toxicity
from auditlens.llm.queries import QUERIES

SMALL, MEDIUM = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def own():
    return bpe.Tokenizer(PATH, PATTERN)


@pytest.fixture(scope="module")
def known(own):
    return tiktoken.Encoding("known", pat_str=PATTERN, mergeable_ranks=own.machine.ranks, special_tokens={})


def ids(own, text):
    return np.frombuffer(own.encode(text), "<u4").tolist()


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("abcdetinors TH'sl\n\t 019.,-=éßñ漢😀"), max_size=60))
def test_ids_are_those_of_the_library(own, known, text):
    assert ids(own, text) == known.encode_ordinary(text)


def test_long_runs_full_tables_and_blocks(own, known, monkeypatch):
    texts = ["a" * 3000, " " * 5000 + "x", "\n" * 999, "=-" * 900, "0123456789" * 300, "don't we'll " * 900, "the" * 700]
    for text in texts:
        assert ids(own, text) == known.encode_ordinary(text)
    monkeypatch.setattr(bpe, "MAX_STEPS", 50)
    monkeypatch.setattr(bpe, "MAX_PIECES", 3)
    monkeypatch.setattr(bpe, "MAX_PAIRS", 10)
    monkeypatch.setattr(bpe, "BLOCK", 7)
    monkeypatch.setattr(bpe, "LONG_TEXT", 30)
    for text in [*texts, "Some words, then Others and 12 more."]:
        assert ids(own, text) == known.encode_ordinary(text)
        parts = list(own.decode(own.encode(text)))
        assert b"".join(p[0] for p in parts).decode() == text == "".join(p[1] for p in parts)


def test_pair_test_is_that_of_merging(own):
    rng, machine = np.random.default_rng(1), own.machine
    for a, b in rng.integers(0, 50_000, (3000, 2)).tolist() + rng.integers(0, 2000, (3000, 2)).tolist():
        x, y = machine.bytes_of[a], machine.bytes_of[b]
        assert machine.fits(a, b) == (machine.merged(x + y) == [x, y])


@given(st.text(max_size=40), st.lists(st.integers(1, 5), min_size=1, max_size=60))
def test_characters_come_out_of_any_cuts(text, cuts):
    data, stream, out = text.encode("utf-8", "replace"), bpe.Utf8Stream(), ""
    while data:
        n = cuts[len(out) % len(cuts)]
        out, data = out + stream.feed(data[:n]), data[n:]
    assert out + stream.finish() == text.encode("utf-8", "replace").decode()


def test_encode_query_and_odd_rows(spark, docs, no_docs, corpus, known):
    got = {r["doc_id"]: r for r in bpe.encode(docs, PATH, PATTERN).collect()}
    for i, text in corpus:
        want = np.array(known.encode_ordinary(text or ""), "<u4").tobytes()
        assert bytes(got[i]["ids"]) == want and got[i]["n_tokens"] == len(want) // 4
        assert got[i]["decoded"] == (text or "")
    assert bpe.encode(no_docs, PATH, PATTERN).collect() == []
    texts = dict(map(tuple, spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()))
    for r in QUERIES["op5_bpe"](spark, SMALL).collect():
        want = np.array(known.encode_ordinary(texts[r["doc_id"]]), "<u4").tobytes()
        assert r["ids_sha256"] == hashlib.sha256(want).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_languages_of_held_out_documents(spark):
    truth = dict(map(tuple, spark.read.parquet(f"{MEDIUM}/documents.parquet").select("doc_id", "lang").collect()))
    rows = QUERIES["op10_language"](spark, MEDIUM).collect()
    assert len(rows) == len(truth)
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert sum(truth[r["doc_id"]] == r["lang_pred"] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_of_odd_rows(spark, docs, no_docs):
    net = language.fit(docs)
    assert net.languages == ["en"]
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 !?"), (4, "ä"), (None, "words"), (4, "ä")], "doc_id long, text string")
    got = [(r["lang_pred"], r["score"]) for r in language.predict(odd, net, ["doc_id"]).collect()]
    assert got == [("und", 1.0)] * 3 + [("en", 1.0)] * 3
    assert language.fit(no_docs) is None
    assert [r["score"] for r in language.predict(odd, None, ["doc_id"]).collect()] == [1.0] * 3 + [0.0] * 3
    assert language.predict(no_docs, net, ["doc_id", "spans"]).collect() == []


def test_slopes_are_those_of_small_changes():
    rng = np.random.default_rng(3)
    cells, labels = rng.integers(97, 110, (6, 40)).astype(np.uint8), rng.integers(0, 3, 6)
    net = language.train(["a", "b", "c"], cells, labels)
    for w in (net.embedding, *net.filters, net.dense, net.bias):
        assert w.dtype == np.float32
    wide = language.Network(net.languages, *[x.astype(float) if not isinstance(x, list) else [f.astype(float) for f in x]
                                             for x in (net.embedding, net.filters, net.dense, net.bias)])

    def loss():
        return -np.log(wide.probabilities(cells)[np.arange(6), labels]).mean()

    slopes = language._slopes(wide, cells, labels)
    for weights, slope in zip([wide.embedding, *wide.filters, wide.dense, wide.bias], slopes, strict=True):
        at = np.unravel_index(np.abs(slope).argmax(), slope.shape)
        weights[at] += 1e-6
        high = loss()
        weights[at] -= 2e-6
        low = loss()
        weights[at] += 1e-6
        assert (high - low) / 2e-6 == pytest.approx(slope[at], rel=0.02, abs=1e-6)


@pytest.fixture(scope="module")
def index(spark):
    docs, labels = (spark.read.parquet(f"{MEDIUM}/{t}.parquet") for t in ("documents", "labels"))
    return toxicity.fit(docs, labels, docs)


def test_nearest_examples_are_those_of_all_cosines(index):
    rng = np.random.default_rng(2)
    dense = np.zeros((len(index.ids), len(index.terms)))
    for t in range(len(index.terms)):
        part = slice(index.starts[t], index.starts[t + 1])
        dense[index.examples[part], t] = index.weights[part]
    for _ in range(200):
        terms = np.sort(rng.choice(len(index.terms), min(len(index.terms), rng.integers(1, 9)), replace=False))
        query = index.vector(terms, rng.integers(1, 5, len(terms)))
        best, cosine = index.nearest(terms, query)
        every = dense[:, terms] @ query
        order = np.lexsort((index.ids, -np.round(every, 9)))[:toxicity.NEAREST]
        order = order[every[order] > 0]
        assert np.allclose(np.sort(cosine), np.sort(every[order])) and len(best) == len(order)


def test_isotonic_levels_rise():
    rng = np.random.default_rng(1)
    x = rng.random(200)
    steps, levels = toxicity.isotonic(x, (rng.random(200) < x).astype(float), np.ones(200))
    assert (np.diff(steps) > 0).all() and (np.diff(levels) > 0).all()


def test_toxicity_of_held_out_documents(spark):
    truth = dict(map(tuple, spark.read.parquet(f"{MEDIUM}/labels.parquet").select("doc_id", "toxic").collect()))
    rows = QUERIES["op7_toxicity"](spark, MEDIUM).collect()
    held = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.95 * len(held)
    assert all(r["predicted"] == (r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in rows)


def test_toxicity_of_odd_rows(spark, docs, no_docs, index):
    labels = spark.createDataFrame([(1, 1, 0), (None, 1, 1), (2, None, 1)], "doc_id long, toxic int, score int")
    one = toxicity.fit(docs, labels, docs)
    assert one.base == 1.0
    assert toxicity.fit(docs, labels.limit(0), docs) is None
    odd = spark.createDataFrame([(1, None, 1), (None, "", 2), (3, "idiot", 3)], "doc_id long, text string, evidence int")
    got = toxicity.scores(odd, index).collect()
    assert got[0]["score"] == got[1]["score"] == index.base and got[2]["score"] > 0.5
    assert got[2]["evidence"] and [r["score"] for r in toxicity.scores(odd, None).collect()] == [0.0] * 3
    assert toxicity.scores(no_docs, index).collect() == []
