import numpy as np
import pytest

from auditlens.llm import vectors


def brute(rows, least=0.95):
    """vec_id -> (n_links, component_id, kept), by comparing all pairs."""
    good = {}
    for i, v in rows:
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[i] = np.array(v, float)
    links = {i: set() for i, _ in rows}
    for a in good:
        for b in good:
            if a < b and len(good[a]) == len(good[b]):
                x, y = good[a], good[b]
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= least:
                    links[a].add(b)
                    links[b].add(a)
    root = {i: i for i in links}
    changed = True
    while changed:
        changed = False
        for i in links:
            low = min([root[i], *(root[j] for j in links[i])])
            if low < root[i]:
                root[i], changed = low, True
    return {i: (len(links[i]), root[i], i == root[i]) for i in links}


def near(rng, base, cosine):
    z = rng.normal(size=len(base))
    z -= (z @ base) / (base @ base) * base
    z *= np.linalg.norm(base) / np.linalg.norm(z)
    return cosine * base + np.sqrt(1 - cosine * cosine) * z


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    made = [rng.normal(size=64) for _ in range(300)]
    made += [near(rng, made[i], c) for i in range(60) for c in (0.93, 0.951, 0.97, 0.999)]
    made += [made[3]] * 40 + [made[4] * 7.5] * 2
    center = rng.normal(size=64)
    made += [near(rng, center, 0.975) for _ in range(150)]
    cells = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(made)]
    cells += [(9000, None), (9001, []), (9002, [0.0] * 64), (9003, [1.0, None] * 32), (9004, [float("nan")] * 64),
              (9005, [float("inf")] + [1.0] * 63), (9006, [1.0, 2.0, 3.0]), (9007, [1.0, 2.0, 3.01]), (9008, [1.0] * 63)]
    return cells


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumnRenamed("embedding", "embedding")


def test_links_and_components_are_those_of_all_pairs(spark, rows, monkeypatch):
    monkeypatch.setattr(vectors, "TILE", 64)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vectors.near_vectors(frame(spark, rows)).collect()}
    assert got == brute(rows)


def test_parts_of_few_bytes_do_not_change_the_links(spark, rows, monkeypatch):
    monkeypatch.setattr(vectors, "TILE", 64)
    monkeypatch.setattr(vectors, "PART_BYTES", 4096)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vectors.near_vectors(frame(spark, rows)).collect()}
    assert got == brute(rows)


def test_empty_and_extra_columns(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, code int, n string")
    assert vectors.near_vectors(empty).collect() == []
    two = spark.createDataFrame([(None, [1.0, 0.0], 1), (4, [1.0, 0.0], 2), (4, [1.0, 0.0], 3)], "vec_id long, embedding array<float>, label int")
    got = sorted((r["vec_id"] or 0, r["n_links"], r["kept"]) for r in vectors.near_vectors(two).collect())
    assert got == [(0, 0, True), (4, 1, True), (4, 1, True)]


def test_rotation_keeps_lengths():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(5, 16))
    y = vectors.rotate(x, rng.choice((-1.0, 1.0), (3, 16)))
    assert np.allclose(np.linalg.norm(y, axis=1), np.linalg.norm(x, axis=1) * 16 ** 1.5)
