"""Operators 3, 4 and 6 against brute force."""

import hashlib
import math
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditlens.llm import contamination, licences, secrets
from auditlens.llm.arrays import Words, PUNCTUATION
from auditlens.llm.queries import QUERIES
from tests.llm.conftest import prose

SMALL = "/root/testdata/sf0.001"
ASSIGN = re.compile(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def entropy(text):
    return -sum(c / len(text) * math.log2(c / len(text)) for c in Counter(text).values())


def brute_spans(text):
    text = text or ""
    base = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    base += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    base += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    more = []
    for m in re.finditer("[A-Za-z0-9+/_=-]+", text):
        word = m[0]
        if len(word) < 20 or not re.search("[0-9]", word) or any(re.search(a, word) for a in secrets.ALLOWED):
            continue
        if any(s < m.end() and m.start() < e for s, _, e in base):
            continue
        no, least = next((3 + k, bits) for k, (_, p, bits) in enumerate(secrets.CLASSES) if re.search(p, word))
        hot = [i for i in range(len(word) - 19) if entropy(word[i:i + 20]) >= least]
        if hot:
            more.append((m.start() + hot[0], no, m.start() + hot[-1] + 20))
    return sorted(base), sorted(base + more)


def joined(spans):
    return ",".join(f"{secrets.KINDS[no]}:{a}:{b}" for a, no, b in spans)


@pytest.fixture(scope="module")
def secret_texts():
    rng = random.Random(8)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    make = lambda chars, n: "".join(rng.choices(chars, k=n))
    texts = [
        None, "", "nothing here", "token=token=abcdefgh", "token=token: abcdef", "TOKEN : 'abc' secret=abcdefg",
        "é😀 password = \"hunter2-long\" ü api_key:abcdef apikey=abcde api__key=abcdefgh",
        "AKIA" + make("ABCDEF012", 16) + " AKIA123 AKIAAKIA" + "Z" * 12, "x" + "0123456789abcdef" * 3 + "g",
        "deadbeef" * 3 + "-" + "deadbeef" * 2, "passwd=" + make(letters, 40) + "." + make("0123456789abcdef", 40),
        "key " + make(letters, 44) + "= and " + make(letters + "_-", 30), "550e8400-e29b-41d4-a716-446655440000",
        "20240101-123456789012345678", make("01", 40), "aaaaaaaaaaaaaaaaaaaaaaaaa1", "EXAMPLE" + make(letters, 30) + "1",
        make(letters, 3000), " ".join(make(letters, 25) for _ in range(200)), "1" + "a" * 30 + make(letters, 25) + "b" * 30,
        "\n".join("secret: " + make(letters, rng.randint(3, 9)) for _ in range(300)), "0" * 30 + make("0123456789ABCDEF", 32), "id " + make("13579ABCDEF", 40),
    ]
    return list(enumerate(texts))


def test_spans_are_those_of_plain_patterns_and_counted_windows(spark, secret_texts):
    rows = spark.createDataFrame([(i, t, 1, "x") for i, t in secret_texts], "doc_id long, text string, no int, base string")
    found = {r["doc_id"]: r for r in secrets.scan(rows).select(
        "doc_id", secrets.as_text(F.col("found")).alias("spans"), secrets.as_text(secrets.base_spans(F.col("found"))).alias("base"),
        secrets.masked(F.col("text"), F.col("found")).alias("masked")).collect()}
    kinds = set()
    for i, text in secret_texts:
        base, spans = brute_spans(text)
        assert found[i]["base"] == joined(base), text
        assert found[i]["spans"] == joined(spans), text
        kinds |= {no for _, no, _ in spans}
        out, at = "", 0
        for a, _, b in spans:
            if a >= at:
                out += text[at:a] + secrets.MASK
            at = max(at, b)
        assert found[i]["masked"] == (out + text[at:] if text is not None else None)
    assert kinds == set(range(6))
    assert secrets.scan(rows.limit(0)).collect() == []


def test_secret_scan_of_very_long_strings(spark):
    rng = random.Random(12)
    base64 = "".join(rng.choices(secrets.ALPHABET[:64], k=1 << 16))
    some = "ab1" * 3000 + base64[:30] + "ab1" * 9000 + base64[30:70] + "ab1" * 2000
    letters, many = "abcdefghijkmno" * 75000, " ".join(base64[i:i + 25] for i in range(0, 50000, 25))
    for name, text in (("base64", base64), ("letters", letters), ("some", some), ("many", many)):
        docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
        begun = time.monotonic()
        got = secrets.scan(docs).select(secrets.as_text(F.col("found")).alias("spans")).first()["spans"]
        assert got == joined(brute_spans(text)[1]), name
        assert time.monotonic() - begun < 30, name


def test_secret_query_on_the_smallest_tables(spark):
    texts = dict(map(tuple, spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()))
    for r in QUERIES["op3_secrets"](spark, SMALL).collect():
        base, spans = brute_spans(texts[r["doc_id"]])
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(no == k for _, no, _ in base) for k in range(3)]
        assert r["base_sha256"] == hashlib.sha256(joined(base).encode()).hexdigest()
        assert r["spans"] == joined(spans)


def test_secret_scan_runs_no_python(spark):
    plan = QUERIES["op3_secrets"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def score_of(doc, item):
    """Plain Smith-Waterman over words."""
    best, line = 0, [0] * (len(doc) + 1)
    for word in item:
        new = [0] * (len(doc) + 1)
        for j, other in enumerate(doc, 1):
            new[j] = max(0, line[j - 1] + (2 if word == other else -1), line[j] - 1, new[j - 1] - 1)
        best, line = max(best, *new), new
    return best / (2 * len(item))


def words(text):
    return Words([(text or "").encode()], PUNCTUATION, lower=True).hashes.tolist()


def test_copies_of_items_are_found_with_their_scores(spark, corpus):
    rng = random.Random(3)
    items = [(i, prose(rng, rng.randint(14, 50), 0.3)) for i in range(12)] + [(20, "two words"), (21, None), (22, "")]
    rows = [(i, t) for i, t in corpus if i < 360]
    for i, (_, text) in enumerate(items[:12]):
        edited = text.split()
        for _ in range(len(edited) // 6):
            at = rng.randrange(len(edited))
            edited[at:at + 1] = rng.choice([[], ["other"], [edited[at], "more"]])
        rows += [(500 + i, prose(rng, 80) + " " + text.upper() + "! " + prose(rng, 30)),
                 (600 + i, prose(rng, 20) + ". " + " ".join(edited) + ", " + prose(rng, 70)),
                 (700 + i, " ".join(text.split()[:len(text.split()) // 4]))]
    rows += [(800, None), (801, ""), (None, items[0][1])]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, gram string, item_id int").repartition(4)
    bench = spark.createDataFrame([(*i, 0) for i in items], "item_id long, text string, doc_id int")
    got = {(r["doc_id"], r["item_id"]): r for r in contamination.contaminated(docs, bench).collect()}
    want = {}
    for i, text in rows:
        if i is not None:
            doc = words(text)
            for k, item in items:
                item = words(item)
                if len(item) >= 3 and (score := score_of(doc, item)) >= 0.5:
                    want[i, k] = score
    assert {k: r["score"] for k, r in got.items()} == want
    assert {500 + i for i in range(12)} | {600 + i for i in range(12)} <= {i for i, _ in got}
    exact = got[500, 0]
    assert words(dict(rows)[500])[exact["start_word"]:exact["end_word"]] == words(items[0][1])
    assert contamination.contaminated(docs.limit(0), bench).collect() == []
    assert contamination.contaminated(docs, bench.limit(0)).collect() == []


def test_an_edited_copy_is_found_beside_a_verbatim_one(spark):
    item = [f"word{i}" for i in range(12)]
    edited = [f"other{i}" if i % 4 == 3 else w for i, w in enumerate(item)]
    docs = spark.createDataFrame([(1, "before " + " ".join(item)), (2, "ahead " + " ".join(edited) + " behind")], "doc_id long, text string")
    bench = spark.createDataFrame([(0, " ".join(item))], "item_id long, text string")
    got = {r["doc_id"]: r["score"] for r in contamination.contaminated(docs, bench).collect()}
    assert got == {1: 1.0, 2: score_of(edited, item)}


def test_alignment_is_the_plain_one():
    rng = np.random.default_rng(2)
    for _ in range(40):
        doc, item = rng.integers(0, 6, 40), rng.integers(0, 6, 15)
        assert contamination.align(doc, item)[0] == round(score_of(doc.tolist(), item.tolist()) * 30)


def test_licences_come_from_headers_or_the_nearest_directory(spark):
    rows = [
        (1, "a/LICENSE", "Released under the MIT License."), (2, "a/x.txt", "plain words"),
        (3, "a/b/COPYING.txt", "Licensed under the Apache License, Version 2.0. And more words here that are no header at all."),
        (4, "a/b/c/y", "nothing"), (5, "a/b/c/z", "First line.\nThis work is licensed under the GNU General Public License, version 3.\n" + "More words. " * 20),
        (6, "q/r", "the license of this text is not known to anybody who reads the words that stand here"), (7, None, None), (8, "", ""),
        (9, "ab/x", "under no directory of a"), (None, "a/k", "no id"), (10, "/a//b/w", "slashes"),
        (2, "a/x.txt", "plain words"), (11, "q/notice", "Copyright 2020. All rights reserved."), (12, "q/s/t/u", "x " * 50000),
    ]
    docs = spark.createDataFrame([(*r, "l", 1.0) for r in rows], "doc_id long, path string, text string, licence string, cosine double")
    got = sorted(((r["doc_id"] or 0, r["licence"], r["origin"], r["licence_dir"]) for r in licences.scan(docs).collect()),
                 key=lambda x: (x[0], str(x)))
    assert got == [
        (0, "MIT", "inherited", "a"), (1, "MIT", "header", None), (2, "MIT", "inherited", "a"), (2, "MIT", "inherited", "a"),
        (3, "Apache-2.0", "header", None), (4, "Apache-2.0", "inherited", "a/b"), (5, "GPL-3.0", "header", None),
        (6, "Proprietary", "inherited", "q"), (7, None, "none", None), (8, None, "none", None), (9, None, "none", None),
        (10, "Apache-2.0", "inherited", "a/b"), (11, "Proprietary", "header", None), (12, "Proprietary", "inherited", "q")]
    assert licences.scan(docs.limit(0)).collect() == []


def test_cosine_is_that_of_weighted_words(spark):
    texts = ["Released under the MIT License today", "the the license of the work", "words only", "Copyright by me. All rights reserved"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    count = Counter(w for t in texts for w in set(re.findall("[a-z0-9]+", t.lower())))
    known = set(licences._vocabulary())

    def vector(text):
        tf = Counter(re.findall("[a-z0-9]+", text.lower()))
        return {w: n * (math.log((len(texts) + 1) / ((count[w] if w in known else 0) + 1)) + 1) for w, n in tf.items()}

    def cosine(a, b):
        dot = sum(x * b.get(w, 0) for w, x in a.items())
        return dot / math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))

    got = {r["doc_id"]: (r["licence"], r["cosine"]) for r in licences.scored_headers(docs).collect()}
    for i, text in enumerate(texts):
        parts = [p for p in re.split(licences.SENTENCE_END, text) if re.search(licences.LIKELY, p)]
        rated = [(-round(cosine(vector(t), vector(p)), 9), name) for p in parts for name, t in licences.TEMPLATES]
        if rated and -min(rated)[0] >= 0.5:
            assert got[i] == (min(rated)[1], pytest.approx(-min(rated)[0], abs=1e-8))
        else:
            assert i not in got
