"""Linkage, mishearings and repairs against plain versions."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rostrum.operators import lexicon, repair, vectors


def average_linkage(vectors: np.ndarray, threshold: float) -> list[int]:
    """Cluster numbers by average-linkage agglomeration at a cosine distance.

    Joined clusters' distances are averages weighted by size, so that each join costs one row.
    """
    n = len(vectors)
    apart = 1 - vectors @ vectors.T
    np.fill_diagonal(apart, np.inf)
    size, root = np.ones(n), np.arange(n)
    for _ in range(n - 1):
        i, j = sorted(np.unravel_index(np.argmin(apart), apart.shape))
        if apart[i, j] > threshold:
            break
        row = (size[i] * apart[i] + size[j] * apart[j]) / (size[i] + size[j])
        apart[i], apart[:, i] = row, row
        apart[i, i] = np.inf
        apart[j], apart[:, j] = np.inf, np.inf
        size[i] += size[j]
        root[root == j] = i
    return np.unique(root, return_inverse=True)[1].tolist()


def test_linkage_as_the_dense_version(spark):
    rng, rows, want = np.random.default_rng(8), [], {}
    for k, (n, spread) in enumerate([(200, 0.35), (200, 0.8), (40, 0.1), (1, 0.0), (3, 0.0)]):
        v = rng.normal(size=(6, 12))[rng.integers(0, 6, n)] + spread * rng.normal(size=(n, 12))
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        numbers = average_linkage(v, 0.3)
        ids = [1000 * k + i for i in range(n)]
        rows += [(k, i, x.tolist()) for i, x in zip(ids, v, strict=True)]
        want |= {i: min(j for j, c in zip(ids, numbers, strict=True) if c == mine) for i, mine in zip(ids, numbers, strict=True)}
    df = spark.createDataFrame([*rows, (9, 99_999, None)], "k long, id long, v array<double>").repartition(4)
    got = vectors.linked(df, "k", 0.3).collect()
    assert {r.id: r.cluster for r in got} == want and len(got) == len(rows)
    sizes = Counter(want.values())
    assert max(sizes.values()) > 20 and len(sizes) > 10


def test_known_clusters(spark):
    rows = [("r", 1, [1.0, 0.0]), ("r", 2, [0.0, 1.0]), ("r", 3, [0.9938837, 0.1104315]), ("s", 4, [1.0, 0.0])]
    got = vectors.linked(spark.createDataFrame(rows, "rec string, id long, v array<double>"), "rec", 0.3)
    assert sorted((r.rec, r.id, r.cluster) for r in got.collect()) == [("r", 1, 1), ("r", 2, 2), ("r", 3, 1), ("s", 4, 4)]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_sounds(spark):
    words = ["Kiefer", "Keefer", "phone", "fone", "back", "bak", "tough", "", None, "McBride", "aeiou", "dad", "Oakley"]
    got = {w: k for w, k in spark.createDataFrame([(w,) for w in words], "w string").select("w", lexicon.sound(F.col("w"))).collect()}
    assert got["Kiefer"] == got["Keefer"] == "cfr" and got["phone"] == got["fone"] and got["back"] == got["bak"] == "pc"
    assert (got[""], got[None], got["aeiou"], got["dad"]) == ("", None, "a", "tt") and got["Oakley"] == "ocli"


def test_planted_mishearings(spark):
    table = lambda rows: spark.createDataFrame(rows, "word string, n long")
    written = table([("wellfield", 9), ("starkey", 5), ("sikhenes", 4), ("purvis", 4), ("rare", 2), ("meeting", 50), ("stirkey", 1)])
    spoken = table([("welfeld", 3), ("wellfeeld", 2), ("starcky", 4), ("stirkey", 7), ("sickenes", 1), ("pervious", 68), ("meeting", 70), ("rair", 5)])
    ordinary = spark.createDataFrame([("meeting",)], "word string")
    got = {r.term: (r.n_written, r.heard, r.variants) for r in lexicon.never_right(written, spoken, ordinary).collect()}
    # one heard once only, one said too often to be a mishearing, one written too seldom, one variant that the record has
    assert got == {"wellfield": (9, 5, "welfeld:3, wellfeeld:2"), "starkey": (5, 4, "starcky:4")}


@pytest.mark.parametrize("least", [0.85, 0.7])
def test_near_misses(spark, least):
    rng = random.Random(4)
    stems = ["".join(rng.choices("abcd", k=rng.randrange(4, 15))) for _ in range(60)]

    def changed(w):
        w = list(w)
        for _ in range(rng.randrange(0, 4)):
            at = rng.randrange(len(w))
            w[at : at + rng.randrange(2)] = rng.choices("abcd", k=rng.randrange(2))
            w = w or ["a"]
        return "".join(w)

    said = sorted({changed(rng.choice(stems)) for _ in range(300)} - {""})
    if least == 0.7:  # three letters at most are dropped, which is all of a word of nine
        stems, said = [w for w in stems if len(w) <= 9], [w for w in said if len(w) <= 9]
    counts = {w: rng.randrange(1, 5) for w in said}
    got = {r.word: (r.n, r.target, round(r.score, 9)) for r in lexicon.near_misses(spark.createDataFrame(list(counts.items()), "word string, n long"), spark.createDataFrame([(w,) for w in sorted(set(stems))], "word string"), 2, least).collect()}
    want = {}
    for w, n in counts.items():
        if n < 2 or w in stems:
            continue
        able = [(round(1 - distance(w, t) / max(len(w), len(t)), 9), t) for t in set(stems) if t[0] == w[0] and abs(len(t) - len(w)) <= 3]
        able = [(-s, t) for s, t in able if s >= least]
        if able:
            want[w] = (n, min(able)[1], -min(able)[0])
    assert got == want and len(want) > 20


def test_swap(spark):
    rng = random.Random(7)
    span = lambda k: [(rec, round(rng.uniform(0, 3000), 2)) for rec in "ab" for _ in range(k)]
    row = lambda rec, s, name: (rec, s, round(s + rng.uniform(0, 9), 2), name)
    words = [row(*x, f"w{i}") for i, x in enumerate(span(150))]
    segments = [row(*x, f"s{i}") for i, x in enumerate(span(60))]
    gaps = [(rec, g, s, s + rng.choice([1.0, 40.0, 900.0])) for g, (rec, s) in enumerate(span(8))] + [("c", 99, 0.0, 5.0)]
    new = lambda kind, share: [(rec, g, round(s + rng.uniform(-3, 3), 2), round(s + 4, 2), f"{kind}{g}.{i}") for rec, g, s, _ in gaps for i in range(3) if rng.random() < share]
    new_words, new_segments = new("nw", 0.3), new("ns", 0.8)
    middle = lambda r: (r[-3] + r[-2]) / 2
    of = {g: (rec, s - repair.EDGE, e + repair.EDGE) for rec, g, s, e in gaps}
    inside = lambda rows, able: [r for r in rows if r[1] in able and of[r[1]][1] <= middle(r) <= of[r[1]][2]]
    got = inside(new_words, of)
    active = {r[1] for r in got}
    kept = lambda rows: [r for r in rows if not any(of[g][0] == r[0] and of[g][1] <= middle(r) <= of[g][2] for g in active)]
    want = [sorted(r[-1] for r in kept(words) + got), sorted(r[-1] for r in kept(segments) + inside(new_segments, active))]
    old, fresh = "rec string, start double, end double, name string", "rec string, gap long, start double, end double, name string"
    make = spark.createDataFrame
    out = repair.swapped(make(words, old), make(segments, old), make(new_words, fresh), make(new_segments, fresh), make(gaps, "rec string, gap long, start double, end double"), "rec")
    assert [sorted(r.name for r in df.collect()) for df in out] == want
    assert 0 < len(active) < len(gaps) and len(kept(words)) < len(words)
