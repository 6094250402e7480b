"""Vector index, cover density, thread keys and the phrase index against brute force."""

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from rostrum.operators import phrases, search, vectors
from rostrum.plans import registry

SF = "/root/testdata/sf0.01"


def unit(rng, n, d, spread=0.3, centres=12):
    c = rng.normal(size=(centres, d))
    v = c[rng.integers(0, centres, n)] + spread * rng.normal(size=(n, d))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


@pytest.fixture(scope="module")
def planted(spark):
    v = unit(np.random.default_rng(3), 1500, 16)
    v[700:1200] = v[0]  # a third of the vectors in one place
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(9000, None)]
    return v, spark.createDataFrame(rows, "id long, v array<double>").repartition(4).cache()


def brute(v, qids, k):
    score = np.round(v[qids] @ v.T, vectors.DIGITS)
    return {(q, int(i), r + 1) for q, s in zip(qids, score, strict=True) for r, i in enumerate(np.lexsort((np.arange(len(v)), -s))[:k])}


@pytest.mark.parametrize("block, asked", [(20_000, 1000), (100, 7)])
def test_exact_in_blocks(planted, monkeypatch, block, asked):
    monkeypatch.setattr(vectors, "BLOCK", block)
    monkeypatch.setattr(vectors, "QUERIES", asked)
    v, df = planted
    q = df.filter("id % 50 = 0").select(F.col("id").alias("qid"), F.col("v").alias("q"))
    got = {(r.qid, r.id, r["rank"]) for r in vectors.exact(df, q, 10).collect()}
    assert got == brute(v, list(range(0, 1500, 50)), 10)


def recall(spark, df, k, probes):
    q = df.filter("id % 20 = 0").select(F.col("id").alias("qid"), F.col("v").alias("q"))
    index = vectors.build(df)
    assert index.vectors.count() == df.filter("v is not null").count()
    got = vectors.search(index, q, k, probes or vectors.probes_for(index, q, k))
    want = vectors.exact(df, q, k)
    # by score, as equal scores may go to either of two ids
    least = want.groupBy("qid").agg(F.min("score").alias("least"))
    hits = got.join(least, "qid").filter("score >= least").count()
    return hits / want.count(), got


def test_index_of_planted_vectors(spark, planted):
    _, df = planted
    share, got = recall(spark, df, 40, vectors.PROBES)
    assert share >= 0.97
    assert got.select("qid", "id").distinct().count() == got.count()


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_index_of_embeddings(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    share, _ = recall(spark, df, 40, None)  # hardly clustered at all
    assert share >= 0.97


def test_index_of_nothing(spark, planted):
    _, df = planted
    q = df.limit(3).select(F.col("id").alias("qid"), F.col("v").alias("q"))
    empty = vectors.build(df.filter("v is null"))
    assert (vectors.probes_for(empty, q, 5), vectors.search(empty, q, 5).count()) == (1, 0)
    assert vectors.search(vectors.build(df), q.limit(0), 5).count() == 0


def brute_covers(words, terms):
    places = {t: [i for i, w in enumerate(words) if w == t] for t in terms}
    holds = lambda a, b: all(any(a <= p <= b for p in places[t]) for t in terms)
    n = len(words)
    found = [(a, b) for a in range(n) for b in range(a, n) if holds(a, b) and not (a < b and (holds(a + 1, b) or holds(a, b - 1)))]
    score = 0.0
    for a, b in found:
        own = sum(a <= p <= b for t in terms for p in places[t])
        score += 0.1 / (1 + (b - a) - (own - 1))
    return len(found), round(score, 9)


def test_cover_density(spark):
    rng = random.Random(2)
    docs = [(i, " ".join(rng.choices("abcdef", k=rng.randrange(0, 18)))) for i in range(60)] + [(99, None)]
    asked = {1: ["a"], 2: ["a", "b"], 3: ["c", "d", "e"], 4: ["a", "zz"], 5: list("abcde")}
    places = search.positions(spark.createDataFrame(docs, "id long, text string"), "id", "text")
    q = spark.createDataFrame([(k, t) for k, ts in asked.items() for t in ts], "qid long, term string")
    got = {(r.qid, r.id): (r.covers, round(r.score, 9)) for r in search.cover_density(places, q).collect()}
    want = {(k, i): brute_covers((t or "").split(), ts) for (i, t), (k, ts) in itertools.product(docs, asked.items())}
    assert got == {k: v for k, v in want.items() if v[0]}


def test_cover_density_where_documents_are(spark):
    rng = random.Random(4)
    docs = [(i, " ".join(rng.choices("abcdef", k=rng.randrange(0, 40)))) for i in range(90)] + [(99, None), (98, "a " * 300 + "b")]
    asked = {1: ["a"], 2: ["a", "b"], 3: ["c", "d", "e"], 4: ["a", "zz"], 5: list("abcde")}
    q = spark.createDataFrame([(k, t) for k, ts in asked.items() for t in ts], "qid long, term string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")  # documents are cut by batches
    try:
        df = search.dense_covers(spark.createDataFrame(docs, "id long, text string").repartition(3), "id", "text", q)
        assert "Exchange hashpartitioning(id" not in df._jdf.queryExecution().executedPlan().toString()  # no occurrence moves
        got = {(r.qid, r.id): (r.covers, round(r.score, 9)) for r in df.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {(k, i): brute_covers((t or "").split(), ts) for (i, t), (k, ts) in itertools.product(docs, asked.items())}
    assert got == {k: v for k, v in want.items() if v[0]}


def test_thread_hits(spark):
    keys = spark.createDataFrame([(i, "topic", "all") for i in range(50)] + [(7, "case", "R1"), (60, "case", "R1"), (7, "case", "R1"), (3, "case", "R2")], "id long, kind string, key string")
    asked = spark.createDataFrame([(1, "topic", "all"), (1, "case", "R1"), (2, "case", "none"), (3, "case", "R2"), (3, "case", "R1")], "qid long, kind string, key string")
    got = {}
    for r in search.thread_hits(keys, asked, most=4).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append(r.id)
    assert got == {1: [7, 60, 0, 1, 2, 3], 3: [7, 60, 3]}


def test_thread_hits_are_whole(spark):
    pairs = [(i, "topic", "all") for i in range(700)] + [(699, "case", "R1"), (900, "case", "R1"), (5, "topic", "all")]
    keys = spark.createDataFrame(pairs, "id long, kind string, key string").repartition(5)
    asked = spark.createDataFrame([(1, "topic", "all"), (1, "case", "R1"), (1, "topic", "all"), (2, "case", "none"), (3, "topic", "all")], "qid long, kind string, key string")
    got = {}
    for r in search.thread_hits(keys, asked).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append((r.rank, r.id))
    assert got == {1: list(enumerate([699, 900, *range(699)], 1)), 3: list(enumerate(range(700), 1))}


def test_fusion_keeps_all_of_a_topic(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    tables = {
        "documents": ([(i, f"that and w{i}") for i in range(700)] + [(900, "other words")], "doc_id long, text string"),
        "benchmark": ([(1, "that and"), (2, "words")], "item_id long, text string"),
        "embeddings": ([(i, [1.0, i / 10]) for i in range(4)], "vec_id long, embedding array<float>"),
    }
    con = duckdb.connect()
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    got = sorted(map(tuple, registry.queries()["T6_reciprocal_rank_fusion"](spark, str(tmp_path)).collect()))
    assert {i for q, i, _ in got if q == 1} == set(range(700))  # 300 by words and 200 by the topic are fewer
    want = sorted(con.sql(registry.oracle_sql()["T6_reciprocal_rank_fusion"]).fetchall())
    assert [r[:2] for r in got] == [r[:2] for r in want] and [r[2] for r in got] == pytest.approx([float(r[2]) for r in want])


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def occurs(phrase, text):
    p, t = words(phrase), words(text)
    return bool(p) and any(t[i : i + len(p)] == p for i in range(len(t)))


def test_phrases(spark):
    rng = random.Random(1)
    texts = [(i, " ".join(rng.choices(["Alpha", "beta,", "gamma", "delta", "ÉTÉ", "x"], k=rng.randrange(1, 12)))) for i in range(80)] + [(98, None), (99, "")]
    asked = [(1, "alpha"), (2, "alpha beta"), (3, "Été x"), (4, "unseen"), (5, "alpha unseen"), (6, ""), (7, None), (8, "x x"), (9, "alpha beta gamma delta"), (10, "alp")]
    got = {tuple(r) for r in phrases.matches(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(asked, "pid long, phrase string")).collect()}
    assert got == {(p, i) for (p, x), (i, t) in itertools.product(asked, texts) if occurs(x, t)}


def test_equal_texts_are_looked_at_once(spark, monkeypatch):
    seen, were = [], phrases.matches
    monkeypatch.setattr(phrases, "matches", lambda texts, asked: (seen.append(texts.count()), were(texts, asked))[1])
    items = spark.createDataFrame([(i, ["red ring", "bolt", None][i % 3]) for i in range(60)], "id long, text string")
    tree = spark.createDataFrame([("goods", None), ("ring", "goods")], "slug string, parent string")
    terms = spark.createDataFrame([("ring", "ring", False)], "slug string, phrase string, negative boolean")
    want = [(s, i) for s in ("goods", "ring") for i in range(0, 60, 3)]
    for rows in (100_000, 0):  # sent, and by a shuffle join
        monkeypatch.setattr(phrases, "BROADCAST_ROWS", rows)
        assert sorted(tuple(r) for r in phrases.subjects_of(items, tree, terms).collect()) == want
    assert seen == [2, 2]


def test_subjects_of_a_tree(spark):
    tree = [("theme", None), ("roads", "theme"), ("bridges", "roads"), ("toll", "bridges"), ("lost", "nowhere"), ("a", "b"), ("b", "a"), ("none", None)]
    terms = [("roads", "road", False), ("roads", "road show", True), ("bridges", "bridge", False), ("bridges", "card bridge", True), ("toll", "toll", False), ("lost", "road", False), ("a", "ay", False), ("b", "bee", False)]
    items = ["road", "road show", "road bridge", "bridge", "card bridge road", "toll road bridge", "toll bridge", "toll", "ay bee", "ay", None]
    own = {s: [p for t, p, n in terms if t == s and not n] for s, _ in tree}
    bad = {s: [p for t, p, n in terms if t == s and n] for s, _ in tree}
    parent = {s: p if p in own else None for s, p in tree}

    def effective(s, seen=()):
        return [] if s in seen else own[s] + [x for k in own if parent[k] == s for x in effective(k, (*seen, s))]

    any_of = lambda ps, t: any(occurs(p, t) for p in ps)
    want = {(s, i) for s in own for i, t in enumerate(items) if any_of(effective(s), t) and not any_of(bad[s], t) and (not (parent[s] and own[parent[s]]) or any_of(own[parent[s]], t))}
    got = phrases.subjects_of(
        spark.createDataFrame(list(enumerate(items)), "id long, text string"), spark.createDataFrame(tree, "slug string, parent string"), spark.createDataFrame(terms, "slug string, phrase string, negative boolean")
    )
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want
    assert ("theme", 3) in want and ("bridges", 3) not in want and ("bridges", 2) in want  # a bridge without a road is the theme's only


def test_postings_are_counted_in_place(spark, monkeypatch):
    from rostrum.operators import search

    monkeypatch.setattr(search, "PART", 2)
    texts = ["a b a", None, "", "B c", "b " * 40_000, "c d e"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = search.postings(df, "id", "text")
    assert sorted(map(tuple, got.collect())) == [(0, "a", 2, 3), (0, "b", 1, 3), (3, "b", 1, 2), (3, "c", 1, 2), (4, "b", 32_767, 40_000), (5, "c", 1, 3), (5, "d", 1, 3), (5, "e", 1, 3)]
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
