"""The operators as queries over whole tables, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlens.llm import (
    bpe, contamination, language, licences, minhash, phrases, secrets, spelling, substrings, suffixes, toxicity, vectors, warc,
)
from auditlens.llm.frames import table
from auditlens.session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query that takes the session and the folder of the tables."""

    def register(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = lambda spark, folder: build(tune(spark), folder)
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


@query("op1_substring_dedup", """
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words
           FROM documents),
 win AS (SELECT doc_id, p, array_to_string(words[p:p + 12], ' ') AS win
         FROM w, unnest(range(1, len(words) - 11)) u(p)),
 late AS (SELECT doc_id, p FROM (SELECT *, min(doc_id) OVER (PARTITION BY win) AS first FROM win)
          WHERE first < doc_id),
 gone AS (SELECT DISTINCT doc_id, p + i AS p FROM late, range(0, 13) r(i)),
 each AS (SELECT w.doc_id, u.p, w.words[u.p] AS word, g.p IS NOT NULL AS removed
          FROM w CROSS JOIN unnest(range(1, len(words) + 1)) u(p)
          LEFT JOIN gone g ON g.doc_id = w.doc_id AND g.p = u.p),
 kept AS (SELECT doc_id, count(*) FILTER (removed) AS n_removed,
                 coalesce(string_agg(word, ' ' ORDER BY p) FILTER (NOT removed), '') AS line
          FROM each GROUP BY doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed,
       sha256(coalesce(line, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)""")
def op1_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.remove_repeated(table(spark, folder, "documents")).drop("kept_text")


@query("op9_minhash", """
WITH RECURSIVE
 w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
 s AS (SELECT DISTINCT doc_id, array_to_string(words[p:p + 1], ' ') AS s
       FROM w, unnest(range(1, greatest(len(words), 2))) u(p) WHERE len(words) > 0),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
 met AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c
          FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
 e AS (SELECT a, b FROM met JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
       WHERE 100 * c >= 80 * (na.n + nb.n - c)),
 r AS (SELECT doc_id AS id, doc_id AS other FROM w
       UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.other),
 c AS (SELECT id, min(other) AS component_id FROM r GROUP BY id)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, w.doc_id = component_id AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN c ON c.id = w.doc_id""")
def op9_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, folder, "documents"), size=2, percent=80)


@query("op10_language")
def op10_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    net = language.fit(docs.where(~held_out))
    return language.predict(docs.withColumn("held_out", held_out), net, ["doc_id", "held_out"])


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _secrets_sql() -> str:
    """The same spans from counted windows; candidates are cut without lookahead."""
    found = " UNION ALL ".join(
        f"SELECT doc_id, {no} AS no, regexp_extract_all(t, {_literal(p)}, 0) AS f, "
        f"regexp_extract_all(t, {_literal(p)}, {group}) AS v, string_split_regex(t, {_literal(p)}) AS b FROM d"
        for no, p, group in ((0, secrets.ASSIGN, 1), (1, secrets.ACCESS, 0), (2, secrets.HEX, 0),
                             (9, "[A-Za-z0-9+/_=-]{20,}", 0)))
    allowed = " OR ".join(f"regexp_matches(w, {_literal(p)})" for p in secrets.ALLOWED)
    kind = " ".join(f"WHEN regexp_matches(w, {_literal(p)}) THEN {3 + i}" for i, (_, p, _) in enumerate(secrets.CLASSES))
    least = " ".join(f"WHEN {3 + i} THEN {bits}" for i, (_, _, bits) in enumerate(secrets.CLASSES))
    names = ", ".join(map(_literal, secrets.KINDS))
    share = "(20 - length(replace(w[i + 1:i + 20], c, ''))) / 20.0"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), m AS ({found}),
 p AS (SELECT doc_id, no, list_sum(list_transform(b[1:i], lambda x: length(x)))
         + coalesce(list_sum(list_transform(f[1:i - 1], lambda x: length(x))), 0) AS s, f[i] AS w, v[i] AS v
       FROM m, unnest(range(1, len(f) + 1)) u(i)),
 base AS (SELECT doc_id, s, no, s + length(w) AS e FROM p WHERE no = 0 AND length(v) >= 6 OR no IN (1, 2)),
 c AS (SELECT doc_id, s, w, CASE {kind} END AS no FROM p
       WHERE no = 9 AND regexp_matches(w, '[0-9]') AND NOT ({allowed}) AND NOT EXISTS (
         SELECT 1 FROM base b WHERE b.doc_id = p.doc_id AND b.s < p.s + length(p.w) AND p.s < b.e)),
 hot AS (SELECT doc_id, s, no, i FROM c, unnest(range(0, length(w) - 19)) u(i)
         WHERE -list_sum(list_transform(list_distinct(string_split(w[i + 1:i + 20], '')),
           lambda c: {share} * log2({share}))) >= CASE no {least} END),
 x AS (SELECT * FROM base UNION ALL
       SELECT doc_id, s + min(i), no, s + max(i) + 20 FROM hot GROUP BY doc_id, s, no),
 y AS (SELECT *, concat([{names}][no + 1], ':', CAST(s AS BIGINT), ':', CAST(e AS BIGINT)) AS line FROM x)
SELECT doc_id, count(*) FILTER (no = 0) AS n_assign, count(*) FILTER (no = 1) AS n_access,
       count(*) FILTER (no = 2) AS n_hex,
       sha256(coalesce(string_agg(line, ',' ORDER BY s, no) FILTER (no < 3), '')) AS base_sha256,
       coalesce(string_agg(line, ',' ORDER BY s, no), '') AS spans
FROM d LEFT JOIN y USING (doc_id) GROUP BY doc_id"""


@query("op3_secrets", _secrets_sql())
def op3_secrets(spark: SparkSession, folder: str) -> DataFrame:
    found = F.col("found")
    base = secrets.base_spans(found)
    return secrets.scan(table(spark, folder, "documents").select("doc_id", "text")).select(
        "doc_id", *[secrets.count_of(k, found).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(secrets.as_text(base), 256).alias("base_sha256"), secrets.as_text(found).alias("spans"))


@query("op6_decontamination")
def op6_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return contamination.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op5_bpe")
def op5_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode(
        table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
        public_tokenizers.PATTERN, ("n_tokens", "ids_sha256", "decoded_sha256"))


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    return corpus_pipeline.run(spark, folder)


@query("op8_suffix_dedup", """
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
 s AS (SELECT doc_id, p, h[2 * p + 1:2 * p + 400] AS s
       FROM b, unnest(range(0, greatest(len(h) // 2 - 199, 0))) u(p)),
 t AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY s) AS n FROM s) WHERE n > 1),
 r AS (SELECT doc_id, p, CASE WHEN p - lag(p) OVER w <= 200 THEN 0 ELSE 1 END AS new
       FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
 g AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM r),
 x AS (SELECT doc_id, run, min(p) AS a, max(p) + 200 AS z FROM g GROUP BY ALL),
 k AS (SELECT b.doc_id, h, list(x.a ORDER BY x.a) FILTER (x.a IS NOT NULL) AS a,
              list(x.z ORDER BY x.a) FILTER (x.a IS NOT NULL) AS z
       FROM b LEFT JOIN x USING (doc_id) GROUP BY ALL),
 m AS (SELECT doc_id, len(h) // 2 AS n_bytes, coalesce(len(a), 0) AS n_spans,
              coalesce(list_sum(z) - list_sum(a), 0) AS n_removed,
              CASE WHEN a IS NULL THEN h ELSE array_to_string(list_transform(range(0, len(a) + 1),
                lambda i: h[2 * CASE WHEN i = 0 THEN 0 ELSE z[i] END + 1
                       :2 * CASE WHEN i = len(a) THEN len(h) // 2 ELSE a[i + 1] END]), '') END AS kept
       FROM k)
SELECT doc_id, n_bytes, CAST(n_removed AS BIGINT) AS n_removed, n_spans,
       sha256(unhex(kept)) AS kept_sha256 FROM m""")
def op8_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffixes.remove_repeated(table(spark, folder, "documents")).drop("kept")


@query("op2_vectors", """
WITH RECURSIVE
 v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
 g AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM v
       WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
         AND len(list_filter(e, lambda x: x <> 0)) > 0),
 l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b
         ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
        AND list_inner_product(a.e, b.e) / (a.n * b.n) >= 0.95),
 r AS (SELECT vec_id AS id, vec_id AS other FROM v UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.other),
 c AS (SELECT id, min(other) AS component_id FROM r GROUP BY id),
 n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN c ON id = vec_id LEFT JOIN n ON a = vec_id""")
def op2_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return vectors.near_vectors(table(spark, folder, "embeddings"))


@query("op7_toxicity")
def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    index = toxicity.fit(docs.where(~held_out), labels, docs)
    return toxicity.scores(docs, index).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def _licences_sql() -> str:
    """Cosines by joins of words; `source` is the only directory of a document here."""
    rows = ", ".join(
        f"({i}, {_literal(name)}, {_literal(word)})" for i, (name, text) in enumerate(licences.TEMPLATES)
        for word in licences.template_words(text))
    gap, likely = _literal(licences.WORD_GAP), _literal(licences.LIKELY)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS folder FROM documents),
 t AS (SELECT tid, licence, term, count(*) AS tf FROM (VALUES {rows}) v(tid, licence, term) GROUP BY ALL),
 total AS (SELECT count(*) AS n FROM d),
 f AS (SELECT term, count(*) AS docs FROM (SELECT unnest(list_distinct(string_split_regex(lower(t), {gap}))) AS term
         FROM d) WHERE term IN (SELECT term FROM t) GROUP BY term),
 idf AS (SELECT DISTINCT t.term, ln((n + 1) / (coalesce(docs, 0) + 1)) + 1 AS idf
         FROM t CROSS JOIN total LEFT JOIN f ON f.term = t.term),
 tw AS (SELECT tid, licence, term, tf * idf AS w FROM t JOIN idf USING (term)),
 tn AS (SELECT tid, sqrt(sum(w * w)) AS norm FROM tw GROUP BY tid),
 s AS (SELECT doc_id, string_split_regex(t, {_literal(licences.SENTENCE_END)}) AS s FROM d WHERE regexp_matches(t, {likely})),
 h AS (SELECT doc_id, i AS part, s[i] AS header FROM s, unnest(range(1, len(s) + 1)) u(i) WHERE regexp_matches(s[i], {likely})),
 w AS (SELECT doc_id, part, term, count(*) AS tf FROM (SELECT doc_id, part,
         unnest(string_split_regex(lower(header), {gap})) AS term FROM h) WHERE term <> '' GROUP BY ALL),
 hw AS (SELECT doc_id, part, w.term, tf * coalesce(idf, ln(n + 1) + 1) AS w FROM w CROSS JOIN total LEFT JOIN idf USING (term)),
 hn AS (SELECT doc_id, part, sqrt(sum(w * w)) AS norm FROM hw GROUP BY ALL),
 r AS (SELECT doc_id, part, licence, round(sum(hw.w * tw.w) / (any_value(hn.norm) * any_value(tn.norm)), 9) AS cosine
       FROM hw JOIN tw USING (term) JOIN hn USING (doc_id, part) JOIN tn USING (tid) GROUP BY doc_id, part, tid, licence),
 g AS (SELECT * FROM r WHERE cosine >= {licences.MIN_COSINE}),
 own AS (SELECT doc_id, licence, cosine FROM g
         QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY cosine DESC, licence, part) = 1),
 chars AS (SELECT doc_id, sum(length(header)) AS chars FROM h
           WHERE (doc_id, part) IN (SELECT (doc_id, part) FROM g) GROUP BY doc_id),
 dirs AS (SELECT folder, licence FROM own JOIN chars USING (doc_id) JOIN d USING (doc_id)
          WHERE chars >= {licences.MIN_SHARE} * length(t)
          QUALIFY row_number() OVER (PARTITION BY folder ORDER BY cosine DESC, licence, doc_id) = 1)
SELECT d.doc_id, coalesce(own.licence, near.licence, top.licence) AS licence, coalesce(own.cosine, 0) AS cosine,
       CASE WHEN own.licence IS NOT NULL THEN 'header' WHEN near.licence IS NOT NULL OR top.licence IS NOT NULL
         THEN 'inherited' ELSE 'none' END AS origin,
       CASE WHEN own.licence IS NULL THEN coalesce(near.folder, top.folder) END AS licence_dir
FROM d LEFT JOIN own USING (doc_id) LEFT JOIN dirs near ON near.folder = d.folder LEFT JOIN dirs top ON top.folder = ''"""


@query("op4_licences", _licences_sql())
def op4_licences(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return licences.scan(docs.select(
        "doc_id", "text", F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path")))


@query("op11_warc", """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
 d AS (SELECT page_id, strlen(payload) AS payload_bytes, sha1(payload) AS h,
              max(page_id) OVER (PARTITION BY payload) AS top FROM p)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST((CAST('0x' || substr(h, 10 * (i // 8) + 1, 10) AS BIGINT) >> (35 - 5 * (i % 8))) & 31 AS INTEGER) + 1, 1)), '')
         AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> top THEN top END AS refers_to FROM d""")
def op11_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.histories(table(spark, folder, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def _variants_sql() -> str:
    """Near words by equal rests after a deletion; the checksum by its table, built from its rule."""
    run = "[A-Za-z\u00C0-\u00FF]+"
    return f"""
WITH RECURSIVE
 bits AS (SELECT i AS byte, list_reduce(list_concat([CAST(i AS BIGINT)], range(0, 8)),
            lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS crc FROM range(0, 256) b(i)),
 tab AS MATERIALIZED (SELECT list(crc ORDER BY byte) AS t FROM bits),
 r AS MATERIALIZED (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{run}')) AS w
         FROM documents) WHERE length(w) >= {spelling.LEAST_LETTERS} GROUP BY ALL),
 b AS (SELECT doc_id, w, n, hex(encode(concat(doc_id, ':', w))) AS x FROM r),
 h AS (SELECT w, n, xor(list_reduce(list_concat([4294967295], list_transform(range(0, length(x) // 2),
                lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT))),
              lambda c, v: xor(c >> 8, t[CAST(xor(c & 255, v) AS INTEGER) + 1])), 4294967295) AS h FROM b CROSS JOIN tab),
 c AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT n, CASE WHEN h % {spelling.LOSES_ONE_OF} = 0
           THEN concat(substr(w, 1, h % length(w)), substr(w, h % length(w) + 2)) ELSE w END AS word FROM h)
       WHERE length(word) >= {spelling.LEAST_LETTERS} GROUP BY word HAVING sum(n) >= {spelling.LEAST_COUNT}),
 d AS MATERIALIZED (SELECT word, i, concat(substr(word, 1, i), substr(word, i + 2)) AS rest
       FROM c, unnest(range(0, length(word))) u(i)),
 e AS (SELECT a.word AS x, b.word AS y FROM d a JOIN d b USING (i, rest) WHERE a.word <> b.word
       UNION SELECT d.word, c.word FROM d JOIN c ON c.word = rest
       UNION SELECT c.word, d.word FROM d JOIN c ON c.word = rest),
 near AS MATERIALIZED (SELECT x AS word, count(*) AS n_near, arg_min(struct_pack(w := c.word, n := c.n), (-c.n, c.word)) AS top
         FROM e JOIN c ON c.word = y GROUP BY x),
 f AS MATERIALIZED (SELECT c.word, c.n, coalesce(n_near, 0) AS n_near, CASE WHEN top.n >= {spelling.RATIO} * c.n THEN top.w END AS form,
              CASE WHEN top.n >= {spelling.RATIO} * c.n THEN top.n END AS form_n FROM c LEFT JOIN near USING (word)),
 walk AS (SELECT word, word AS root FROM f UNION ALL
          SELECT walk.word, f.form FROM walk JOIN f ON f.word = walk.root WHERE f.form IS NOT NULL)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN walk ON walk.word = f.word
WHERE root IN (SELECT word FROM f WHERE form IS NULL)"""


@query("op12_spelling", _variants_sql())
def op12_spelling(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(table(spark, folder, "documents"))


@query("op13_phrases", f"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
 w AS (SELECT lang, regexp_extract_all(piece, '[^ \\x09]+') AS w FROM p),
 f AS MATERIALIZED (SELECT lang, size, phrase, count(*) AS n FROM (
         SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase
         FROM w, unnest([1, 2, 3]) s(size), unnest(range(1, len(w) - size + 2)) u(i)) GROUP BY ALL),
 total AS (SELECT lang, CAST(sum(n) AS BIGINT) AS n FROM f WHERE size = 1 GROUP BY lang),
 c AS (SELECT lang, size, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND n >= {phrases.LEAST_COUNT}),
 cut AS (SELECT c.lang, c.phrase, c.size, a, k, x.n AS l, y.n AS r,
                (CAST(a AS HUGEINT) * a * 1000000) // (CAST(x.n AS HUGEINT) * y.n) AS score
         FROM c, unnest(range(1, size)) u(k)
         JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(w[1:k], ' ')
         JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(w[k + 1:], ' ')),
 worst AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
 part AS (SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase, a FROM c WHERE size = 3),
 most AS (SELECT lang, phrase, max(a) AS longer FROM part GROUP BY ALL)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, total.n,
       CAST(score AS BIGINT) AS score
FROM worst LEFT JOIN most USING (lang, phrase) JOIN total USING (lang)
WHERE longer IS NULL OR 100 * longer < {phrases.LEAST_SHARE} * a
QUALIFY rank <= {phrases.TOP}""")
def op13_phrases(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.collocations(table(spark, folder, "documents")).select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score")
