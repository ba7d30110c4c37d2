"""Operators 11, 12 and 13 against brute force."""

import base64
import glob
import gzip
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from auditlens.llm import phrases, spelling, warc
from auditlens.llm.queries import QUERIES
from tests.llm.conftest import prose

SMALL = "/root/testdata/sf0.001"


# --- 11: archives --------------------------------------------------------------------------------


def brute_pages(rows):
    """(page_id, bytes, digest, type, refers_to) of rows (page_id, url, html)."""
    top = {}
    for page, _, html in rows:
        if page is not None:
            top[html or ""] = max(top.get(html or "", page), page)
    out = []
    for page, _, html in rows:
        data, largest = (html or "").encode(), top.get(html or "")
        first = largest is None or page == largest
        out.append((page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(),
                    "response" if first else "revisit", None if first else largest))
    return Counter(out)


@pytest.fixture(scope="module")
def web():
    rng = random.Random(11)
    odd = ["", None, "\r\n", "\r\n\r\n", "x\r\n", "\r\n\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n", "WARC/1.1\r\n\r\n", "\r", "\n\n",
           "é😀\x00" * 50, "a\r\n\r\n" * 700, "long " * 60_000]
    rows = [(i, f"http://host{i % 3}.example.com/{i}", html) for i, html in enumerate(odd)]
    rows += [(100 + i, "http://hot.example.com/", "the same page") for i in range(60)]
    rows += [(200 + i, rng.choice(["https://www.a.example.org/B?q=1#top", "HTTP://user@A.example.org:80/b?Q=1", None, "", "a b\r\nX: y", "é/ü"]),
              prose(rng, rng.randint(0, 40))) for i in range(60)]
    rows += [(300, "u", "twice"), (300, "u", "twice"), (301, "u", "twice"), (None, "u", "twice"), (None, None, "only without id"),
             (None, None, "only without id"), (302, "u", "one"), (302, "u", "other"), (-5, "u", "below zero"), (10**17, "u", "far")]
    return rows


def test_pages_come_back_from_archives_in_one_order(spark, web, tmp_path):
    pages = spark.createDataFrame([(*r, 1, "x", b"y") for r in web], "page_id long, url string, html string, position int, run string, payload binary")
    found = warc.histories(pages.repartition(7), str(tmp_path / "archives"), run_rows=9, range_rows=20).collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found) == brute_pages(web)
    found.sort(key=lambda r: r.position)
    assert [r.position for r in found] == list(range(1, len(web) + 1))
    keys = [(r.url_key.encode(), r.captured, r.page_id is not None, r.page_id or 0) for r in found]
    assert keys == sorted(keys)
    seen = Counter()
    for r in found:
        seen[r.url_key] += 1
        assert r.capture_no == seen[r.url_key]
    assert {warc.url_key(url and url.replace("\r", "%0D").replace("\n", "%0A")) for _, url, _ in web} == set(seen)
    assert seen["com,example,hot)/"] == 60


def test_archives_are_records_that_lengths_delimit(spark, web, tmp_path):
    folder = str(tmp_path / "archives")
    warc.write_archives(spark.createDataFrame(web, "page_id long, url string, html string").repartition(3), folder)
    payloads, names, referred = Counter(), set(), set()
    for file in glob.glob(f"{folder}/*.gz"):
        data = gzip.open(file).read()
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
            assert head.startswith(b"WARC/1.1\r\n")
            size = int(fields["Content-Length"])
            block, end, data = rest[:size], rest[size:size + 4], rest[size + 4:]
            assert end == b"\r\n\r\n"
            names.add(fields["WARC-Record-ID"])
            http, _, payload = block.partition(b"\r\n\r\n")
            assert http.startswith(b"HTTP/1.1 200 OK")
            if fields["WARC-Type"] == "revisit":
                assert payload == b""
                referred.add(fields["WARC-Refers-To"])
            else:
                payloads[payload.decode()] += 1
            assert re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", fields["WARC-Date"])
    assert referred <= names
    assert set(payloads) == {html or "" for _, _, html in web}


def test_damaged_archives_are_errors(spark, tmp_path):
    page = spark.createDataFrame([(1, "http://a", "some payload")], "page_id long, url string, html string")
    text = warc.records(page).first()[0]
    for number, wrong in enumerate((text.replace("some", "SOME"), text.replace("response\r\nContent-Length: ", "response\r\nContent-Length: 9"), "x" + text)):
        folder = str(tmp_path / str(number))
        spark.createDataFrame([(wrong,)], "value string").write.option("lineSep", warc.BLANK).option("compression", "gzip").text(folder)
        with pytest.raises(Exception, match="digest|within a record|No WARC record"):
            warc.read_runs(spark, folder).collect()


def test_captured_times_and_empty_tables(spark):
    pages = spark.sql("SELECT 1L page_id, 'u' url, 'h' html, TIMESTAMP'2021-03-04 05:06:07.9' captured UNION ALL SELECT 2L, 'u', 'i', NULL")
    times = {r.page_id: r.captured for r in warc.histories(pages).collect()}
    assert times == {1: "2021-03-04T05:06:07Z", 2: "2020-01-01T00:00:02Z"}
    assert warc.histories(pages.limit(0)).collect() == []


def test_url_keys():
    assert warc.url_key("http://www2.Example.com:8080/A/b?C=d#e") == "com,example)/a/b?c=d"
    assert warc.url_key("https://example.com") == "com,example)/"
    assert warc.url_key("https://m.example.com?x") == "com,example,m)?x"
    assert warc.url_key(None) == warc.url_key("") == ""


def test_loser_tree_merges_any_number_of_sources():
    rng = random.Random(3)
    for k in [1, 2, 3, 4, 5, 8, 13]:
        runs = [sorted(rng.choices(range(9), k=rng.randint(0, 12))) for _ in range(k)]
        tree = warc.LoserTree([(lambda rows=iter(run): next(rows, None)) for run in runs])
        at, out = [0] * k, []
        for source in tree:
            out.append((runs[source][at[source]], source))
            at[source] += 1
        assert out == sorted((x, i) for i, run in enumerate(runs) for x in run)


# --- 12: spelling --------------------------------------------------------------------------------


def brute_words(rows):
    total = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-z\u00C0-\u00FF]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= 7 and n >= 2}


def is_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_variants(rows):
    count = brute_words(rows)
    near = {w: [x for x in count if abs(len(x) - len(w)) < 2 and is_near(w, x)] for w in count}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-count[x], x), default=None)
        form[w] = best if best is not None and count[best] >= 10 * count[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {w: (form[w], root(w), n, len(near[w]), form[w] and count[form[w]]) for w, n in count.items()}


def found_variants(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


@pytest.fixture(scope="module")
def spelled():
    rng = random.Random(12)
    base = ["".join(rng.choices("abé", k=rng.randint(7, 9))) for _ in range(40)] + ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "Straßenbahn", "Ünlü×÷ÿÀword"]
    base += ["commonword" + c for c in "abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêë"] + ["l" * 3000, "l" * 1500 + "m" + "l" * 1499, "l" * 3001]
    words = []
    for i, w in enumerate(base):
        words += [w] * (1 if i % 3 else 300)
        for _ in range(6):
            at = rng.randrange(len(w))
            other = rng.choice([w[:at] + w[at + 1:], w[:at] + "x" + w[at:], w[:at] + "z" + w[at + 1:]])
            words += [other] * rng.choice([1, 2, 3, 25])
    rng.shuffle(words)
    rows = [(i, rng.choice([" ", "-", "1", ", "]).join(words[i::20])) for i in range(20)]
    return rows + [(50, None), (51, ""), (None, "nullidword nullidword commonworda"), (52, "short words only"), (52, "short words only"), (53, "x" * 5000 + " " + "x" * 5000)]


def test_variants_are_those_of_all_pairs(spark, spelled):
    docs = spark.createDataFrame([(*r, "w", 3, "k") for r in spelled], "doc_id long, text string, word string, n int, key string").repartition(5)
    want = brute_variants(spelled)
    assert sum(v[0] is not None for v in want.values()) > 20 and any(v[0] != v[1] for v in want.values() if v[0])
    for rows in (spelling.BLOCK_ROWS, 3):  # the small limit deals blocks out again, to one place of the edit
        assert found_variants(spelling.variants(docs, block_rows=rows)) == want
    assert spelling.variants(docs.limit(0)).collect() == []


def test_no_block_is_larger_than_the_limit_or_the_alphabet(spark):
    words = spark.range(20000).select(F.concat(F.lit("prefix"), F.translate(F.lpad(F.col("id").cast("string"), 6, "0"), "0123456789", "abcdefghij"), F.lit("suffix")).alias("word"), F.lit(5).alias("n"))
    sizes = spelling.blocks(words, 50).groupBy(*spelling.BLOCK).count()
    assert sizes.agg(F.max("count")).first()[0] <= 50
    near = spelling.near_words(words, 50)
    # Each of the last four letters has nine others, the one before them has one.
    assert near.agg(F.min("n_near"), F.max("n_near"), F.count("*")).first() == (37, 37, 20000)


def test_spelling_query_on_the_smallest_tables(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").limit(60).collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found_variants(spelling.variants(docs)) == brute_variants(rows)


# --- 13: phrases ---------------------------------------------------------------------------------


def brute_phrases(rows, max_words=3, least=10, share=50, top=2000):
    f, total = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", text):
            words = re.findall("[^ \t]+", piece)
            total[lang] += len(words)
            for n in range(1, max_words + 1):
                f[lang].update(tuple(words[i:i + n]) for i in range(len(words) - n + 1))
    out = []
    for lang, counts in f.items():
        cands = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in cands.items():
            cuts = [(1000000 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p))]
            if any(len(q) > len(p) and 100 * b >= share * a and any(q[i:i + len(p)] == p for i in range(len(q))) for q, b in cands.items()):
                continue
            score, _, left, right = min(cuts)
            rows.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


def found_phrases(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def thue_morse(bits):
    word, other = "a", "b"
    for _ in range(bits):
        word, other = word + other, other + word
    return word, other


@pytest.fixture(scope="module")
def spoken():
    rng = random.Random(13)
    words = ["New", "york", "city", "of", "the", "É", "été", "x\u00a0y", "don't", "a" * 400]
    seps = [" ", " ", " ", " ", "  ", "\t", " \t ", ". ", ",", "\n", "\x0b", "!?", "\r\n"]
    rows = [(i, "".join(rng.choice(words) + rng.choice(seps) for _ in range(rng.randint(0, 90))), rng.choice(["en", "fr", None, "und", ""])) for i in range(120)]
    one, two = thue_morse(10)
    rows += [(200 + i, f"sees {one} here, sees {two} here {two}", "en") for i in range(11)]
    rows += [(300, None, "en"), (301, "", None), (None, "without an id " * 12, "de"), (302, "same row " * 7, "de"), (302, "same row " * 7, "de"),
             (303, "long " * 30_000, "xx"), (304, " \t\n.", "yy")]
    return rows


def test_phrases_are_those_of_plain_counts(spark, spoken):
    docs = spark.createDataFrame([(*r, 1, "p", 2) for r in spoken], "doc_id long, text string, lang string, n int, phrase string, size int").repartition(5)
    want = brute_phrases(spoken)
    assert any(len(row[2]) > 1000 for row in want)  # both of two words with one hash are told apart
    assert found_phrases(phrases.collocations(docs)) == want
    assert found_phrases(phrases.collocations(docs, top=5)) == [r for r in want if r[1] <= 5]
    assert found_phrases(phrases.collocations(docs, max_words=4, least=6, share=80)) == brute_phrases(spoken, 4, 6, 80)
    assert phrases.collocations(docs.limit(0)).collect() == []


def test_counts_of_frequent_phrases_have_a_pointer(spark, spoken):
    docs = spark.createDataFrame(spoken, "doc_id long, text string, lang string")
    texts = {d: (t or "").encode().lower().decode() for d, t, _ in spoken}
    rows = phrases.frequent_phrases(docs).where("size = 2 AND first_doc IS NOT NULL").collect()
    assert rows
    for r in rows:
        assert re.search(r"[ \t]+".join(map(re.escape, r["phrase"].split(" "))), texts[r["first_doc"]]), r


def test_scores_are_exact_beyond_64_bits(spark):
    rows = [("en", 1, "a", 3 * 10**14 + 1, 1), ("en", 1, "b", 10**15, 1), ("en", 2, "a b", 3 * 10**14, 1)]
    frequent = spark.createDataFrame(rows, "lang string, size int, phrase string, n long, first_doc long")
    a, left, right = 3 * 10**14, 3 * 10**14 + 1, 10**15
    assert phrases.scored(frequent).first()["score"] == 1000000 * a * a // (left * right)


def test_new_queries_are_registered():
    assert {"op11_warc", "op12_spelling", "op13_phrases"} <= set(QUERIES)
