"""The pipeline against a brute-force version of its decisions."""

import gc
import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

import __spark_entry__
import corpus_pipeline
from auditlens.llm import bpe, contamination, language, minhash, secrets
from tests.llm.test_duplicates import classes
from tests.llm.test_scans import brute_spans, score_of, words

SMALL = "/root/testdata/sf0.001"


def test_stages_do_what_plain_code_does(spark):
    source = spark.read.parquet(f"{SMALL}/documents.parquet")
    items = [words(r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    docs = source
    kept = {}
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(step(spark, docs, SMALL).collect(), source.schema)
        kept[name] = {r["doc_id"]: r for r in docs.collect()}
    given = {r["doc_id"]: r for r in source.collect()}
    assert kept["language"].keys() <= given.keys() and len(kept["language"]) >= 0.98 * len(given)
    first = classes([(i, r["text"]) for i, r in kept["language"].items()], 5)
    assert kept["near_duplicates"].keys() == {i for i, c in first.items() if c[2]}
    clean = {i for i, r in kept["near_duplicates"].items()
             if max((score_of(words(r["text"]), item) for item in items if len(item) >= 3), default=0) < 0.5}
    assert kept["decontamination"].keys() == clean
    for i, r in kept["secrets"].items():
        text, out, at = kept["decontamination"][i]["text"], "", 0
        for a, _, b in brute_spans(text)[1]:
            if a >= at:
                out += text[at:a] + secrets.MASK
            at = max(at, b)
        assert r["text"] == out + text[at:]
        assert r["n_chars"] == (len(r["text"]) if out else given[i]["n_chars"])
        assert (r["lang"], r["source"]) == (given[i]["lang"], given[i]["source"])
    assert kept["secrets"].keys() == clean
    known = tiktoken.Encoding("known", pat_str=public_tokenizers.PATTERN, special_tokens={},
                              mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    rows = corpus_pipeline.run(spark, SMALL).collect()
    assert {r["doc_id"] for r in rows} == clean
    for r in rows:
        want = np.array(known.encode_ordinary(kept["secrets"][r["doc_id"]]["text"]), "<u4").tobytes()
        assert bytes(r["ids"]) == want and r["ids_sha256"] == hashlib.sha256(want).hexdigest()


def test_stages_of_an_empty_table_and_odd_rows(spark, docs):
    source = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for _, step in corpus_pipeline.STAGES:
        out = step(spark, source, SMALL)
        assert out.collect() == []
    for _, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, docs, SMALL)
        assert out.columns == docs.columns
        assert out.count() > 0


def test_all_are_registered():
    names = __spark_entry__.queries()
    for n in range(1, 11):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert "pipeline" in names and len(corpus_pipeline.STAGES) == 5


BATCH = {"doc_id": [1], "text": ["a few words of a text"]}
OTHERS = {
    "windows": (language._sample_windows, BATCH | {"lang": ["en"]}),
    "sketches": (minhash._sketches(5), BATCH),
    "keys": (minhash._keys, {"doc_id": [1], "signature": [bytes(4 * minhash.MINHASHES)]}),
    "verified": (minhash._verified(5, 80), {"a": [1], "b": [2], "text_a": ["x"], "text_b": ["y"]}),
    "found": (contamination._found(np.zeros(contamination.SLOTS, bool)), BATCH),
    "aligned": (contamination._aligned(0.5), {"doc_id": [1], "item_id": [2], "text": ["x"], "item_text": ["y"], "shifts": [[0]]}),
}


@pytest.mark.parametrize("name", [*OTHERS, "guess", "across"])
def test_a_worker_drops_the_tables_of_the_operator_before(spark, name):
    def tables():
        gc.collect()
        return sum(type(o) is bpe.Tokenizer for o in gc.get_objects())

    tokens = bpe._encoded(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ["n_tokens"])
    before = tables()
    for _ in range(2):
        assert [b["n_tokens"].to_pylist() for b in tokens(iter([pa.RecordBatch.from_pydict(BATCH)]))] == [[6]]
    assert tables() == before + 1
    if name == "guess":
        list(language._guessed(None).func(iter([pa.array(["text"])])))
    elif name == "across":
        none = {c: pa.array([], pa.int64()) for c in ("main", "low", "high", "tile", "doc_id", "root")}
        minhash._across(5, 80)(pa.table(none | {"text": pa.array([], pa.string())}))
    else:
        task, columns = OTHERS[name]
        list(task(iter([pa.RecordBatch.from_pydict(columns)])))
    assert tables() == before
