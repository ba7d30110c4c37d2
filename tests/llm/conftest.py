import random

import pytest

SYLLABLES = "ba ne ti ro su la mi do ka ve po li ra te no si".split()


def prose(rng: random.Random, words: int, share: float = 0.0) -> str:
    """Invented words; with ``share`` some are very common."""
    common = ["the", "of", "and", "in"]
    return " ".join(rng.choice(common) if rng.random() < share
                    else "".join(rng.choices(SYLLABLES, k=rng.randint(1, 4))) for _ in range(words))


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text): copies, near copies, shared passages, empty, null, long and odd texts."""
    rng = random.Random(4)
    rows = [(i, prose(rng, rng.randint(1, 160), 0.3)) for i in range(60)]
    passage = prose(rng, 55)
    rows += [(100 + i, prose(rng, 30) + " " + passage + " " + prose(rng, 20)) for i in range(8)]
    base = prose(rng, 120)
    rows += [(200 + i, base) for i in range(12)]
    for i in range(15):
        words = base.split()
        for _ in range(rng.randint(0, 9)):
            words[rng.randrange(len(words))] = "changed"
        rows.append((300 + i, " ".join(words)))
    chain = prose(rng, 100).split()
    for i in range(12):  # neighbours are near, far ones are not
        rows.append((350 + i, " ".join(chain[3 * i:3 * i + 60])))
    long = prose(rng, 6000, 0.2)
    rows += [(400, long), (401, long[1000:9000] + prose(rng, 50)), (402, "a" * 5000), (403, "ab" * 400 + "x"),
             (404, "word " * 300), (405, None), (406, ""), (407, " \t\n"), (408, "one"), (409, "one"), (410, "One two"),
             (411, "é" * 300), (412, "ü 😀 " * 200), (413, "x" * 199), (414, "y" * 200), (415, "Zwölf Wörter\x0bmit\x0c Trennern " * 8)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """The corpus with the columns of documents and some with clashing names."""
    rows = [(i, t, "en", "src", len(t or ""), "x", 1, 2.5, None) for i, t in corpus]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, spans string, n int, score double, key string").repartition(5)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)
