"""Pairs of vectors in blocks against all pairs at once, and many copies."""

import tracemalloc

import numpy as np
import pytest

from rostrum.operators import identity, vectors
from rostrum.plans import registry

ROWS = "id long, v array<double>, label int"


@pytest.fixture
def voices(spark, monkeypatch):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(60, 5))
    v = np.concatenate([v, v[:20]]) / np.linalg.norm(np.concatenate([v, v[:20]]), axis=1, keepdims=True)
    monkeypatch.setattr(vectors, "SIDE", 7)
    monkeypatch.setattr(vectors, "BLOCK", 7)
    rows = [(i, x.tolist(), i % 2) for i, x in enumerate(v)]
    return v, spark.createDataFrame([*rows, (900, None, 0), (901, v[0].tolist(), 5), (902, None, 6), (903, None, 6)], ROWS)


def test_affinity_in_blocks(voices):
    v, df = voices
    s = np.where(np.arange(80)[:, None] % 2 == np.arange(80) % 2, v @ v.T, -np.inf)
    np.fill_diagonal(s, -np.inf)
    got = {r.id: r.similarity for r in identity.affinity(df, "label").collect()}
    want = {i: pytest.approx(np.sort(s[i])[-3:].mean()) for i in range(80)} | {900: None, 902: None, 903: None}
    assert got == want


def test_pairs_in_blocks(voices, spark):
    v, df = voices
    cells = df.withColumnRenamed("label", "cell")
    s = v @ v.T
    below = [sum(s[i, j] < 0.05 for i in range(c, 80, 2) for j in range(c, i, 2)) for c in (0, 1)]
    assert {r.cell: r.n for r in vectors.below(cells, 0.05).collect() if r.cell < 2} == dict(enumerate(below))
    least = list(range(80))
    for _ in range(80):
        for i in range(80):
            least[i] = min(least[j] for j in range(i % 2, 80, 2) if s[i, j] >= 0.8 or i == j)
    links = vectors.reaching(cells, 0.8)
    got = {r.id: r.component for r in identity.components(df.select("id"), links).collect()}
    assert got == {**dict(enumerate(least)), 900: 900, 901: 901, 902: 902, 903: 903}


def test_linkage_of_many_copies(spark, monkeypatch):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(30, 6))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = [("a", 1000 * c + i, x.tolist()) for c in range(70) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "rec string, id long, v array<double>")
    one = {r.id: r.cluster for r in vectors.linked(df.filter("id < 1000"), "rec", 0.02).collect()}
    got = {r.id: r.cluster for r in vectors.linked(df, "rec", 0.02).collect()}
    assert got == {1000 * c + i: one[i] for c in range(70) for i in range(30)}
    few = df.filter("id < 3000")
    local = {r.id: r.cluster for r in vectors.linked(few, "rec", 0.6).collect()}
    monkeypatch.setattr(vectors, "LOCAL", 5)  # rounds over the table, to a few clusters
    assert {r.id: r.cluster for r in vectors.linked(few, "rec", 0.6).collect()} == local


def joined_in_rounds(v, least):
    """The cluster of each vector, by a table of all similarities that is made anew in each round."""
    groups = [[i] for i in range(len(v))]
    while True:
        means = np.array([v[g].mean(axis=0) for g in groups])
        s = np.round(means @ means.T, vectors.DIGITS)
        np.fill_diagonal(s, -np.inf)
        best = s.argmax(axis=1)
        pairs = [(best[i], i) for i in range(len(groups)) if best[best[i]] == i and best[i] < i and s[i, best[i]] >= least]
        if not pairs:
            return {i: g[0] for g in groups for i in g}
        gone = {j for _, j in pairs}
        for i, j in pairs:
            groups[i] = groups[i] + groups[j]
        groups = [g for i, g in enumerate(groups) if i not in gone]


def lattice(seed, n=120):
    """Vectors of many equal similarities, no two alike."""
    v = np.unique(np.random.default_rng(seed).integers(-2, 3, (n, 4)), axis=0).astype(float)
    v = v[np.abs(v).sum(axis=1) > 0]
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v = v[np.unique(np.round(v, 9), axis=0, return_index=True)[1]]
    return np.random.default_rng(seed + 1).permutation(v)


@pytest.mark.parametrize("least", [0.2, 0.5, 0.9])
def test_linkage_of_ties(least):
    for seed in range(12):
        v = lattice(seed)
        out = vectors.agglomerated(np.arange(len(v)), v, np.ones(len(v)), least)
        assert dict(enumerate(out.tolist())) == joined_in_rounds(v, least)


def test_linkage_holds_no_table():
    v = np.random.default_rng(6).normal(size=(4000, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    tracemalloc.start()
    try:
        vectors.agglomerated(np.arange(len(v)), v, np.ones(len(v)), 0.2)
        assert tracemalloc.get_traced_memory()[1] < len(v) ** 2 * 8 / 3
    finally:
        tracemalloc.stop()


def test_linkage_looks_again_where_the_nearest_joined(spark, monkeypatch):
    v = np.concatenate([lattice(3, 60), np.random.default_rng(9).normal(size=(140, 4))])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([("a", i, x.tolist()) for i, x in enumerate(v)], "rec string, id long, v array<double>").repartition(3)
    pairs, were = [], vectors.in_blocks
    monkeypatch.setattr(vectors, "in_blocks", lambda m, q, *a, **k: (pairs.append((m.count(), q.count())), were(m, q, *a, **k))[1])
    monkeypatch.setattr(vectors, "LOCAL", 40)
    monkeypatch.setattr(vectors, "BLOCK", 50)
    got = {r.id: r.cluster for r in vectors.linked(df, "rec", 0.2).collect()}
    assert got == joined_in_rounds(v, 0.8)
    rounds = len(pairs) // 2 + 1
    assert rounds > 2 and sum(m * q for m, q in pairs[1:]) < sum(m * m for m, _ in pairs[1::2])  # all meet all in the first round only


def test_purity_counts_pairs_without_a_similarity(spark, tmp_path):
    rows = [(1, [1.0, 0.0], 3), (2, [0.0, 1.0], 3), (3, None, 3), (4, [1.0, 0.0], 4)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = registry.queries()["I21_cluster_purity"](spark, str(tmp_path)).collect()
    assert [tuple(r) for r in got] == [(3, 3, pytest.approx(1 / 3, abs=1e-6))]
