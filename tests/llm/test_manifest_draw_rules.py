"""Merkle manifest, importance resampling and quality rules against plain brute-force versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rostrum.llm import merkle, resample, rules, shared

DOCS = "doc_id long, text string, lang string, source string, n_chars long, tree string, slot int, `a.b` int, pos long, block long, bucket int, n long, score double, row int"


def make_docs():
    rng = random.Random(4)
    words = ["alpha", "beta", "Gamma", "été", "ÜBER", "x1", "omega,", "日本", "#", "a|b", "no-w", "İ"]
    rows = []
    for i in range(60):
        text = "\n".join(" ".join(rng.choices(words, k=rng.randrange(0, 9))) for _ in range(rng.randrange(1, 7)))
        source = None if i % 11 == 0 else "hot" if i % 2 else rng.choice(["a", "b", "", "Z", "é", "日"])
        rows.append((i * 7 % 61, text, rng.choice(["en", None]), source, len(text) if i % 5 else None))
    rows += [(1, None, None, "hot", None), (1, None, None, "hot", None), (1, "other", "en", "hot", 5), (None, "x\ny", "en", "hot", 3), (None, None, None, None, None), (500, "", "en", "alone", 0)]
    rows += [(600, " ".join(words * 40), "en", "a", 1), (601, "same\n" * 30, "en", "a", 1), (602, "\n\n \t\n", "en", "a", 1), (603, "a b c d e " * 9, "en", "a", 1)]
    return [(*r, "t", 1, 2, 3, 4, 5, 6, 7.0, 8) for r in rows]


@pytest.fixture(scope="module")
def rows():
    return make_docs()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def tree_of(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def siblings(levels, i):
    out = []
    for level in levels[:-1]:
        at = i // 3 * 3
        out.append((level[at:i], level[i + 1 : at + 3]))
        i //= 3
    return out


def brute_manifest(rows):
    by = {}
    for doc_id, text, lang, source, n_chars, *_ in rows:
        bare = None if text is None else text.replace("\n", "")
        by.setdefault(source, []).append((doc_id is not None, doc_id or 0, leaf(doc_id, source, lang, n_chars, text), leaf(doc_id, source, lang, n_chars, bare)))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = [tree_of([x[2] for x in sorted(by[s])]) for s in order]
    top = tree_of([t[-1][0] for t in trees])
    out = []
    for k, s in enumerate(order):
        for i, (some, doc_id, own, bare) in enumerate(sorted(by[s])):
            path = siblings(trees[k], i) + siblings(top, k)
            fold = bare if some and zlib.crc32(str(doc_id).encode()) % 2 == 0 else own
            for left, right in path:
                fold = sha(*left, fold, *right)
            out.append((doc_id if some else None, own, trees[k][-1][0], top[-1][0], "".join(x for left, right in path for x in left + right), fold, fold == top[-1][0]))
    return out


@pytest.mark.parametrize("levels", [1, 2, merkle.LEVELS])
@pytest.mark.parametrize("whole", [True, False])
def test_manifest(docs, rows, monkeypatch, levels, whole):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    monkeypatch.setattr(merkle, "BUCKET", 3**levels)
    bare = merkle.leaf({f: docs[f] for f in merkle.FIELDS} | {"text": F.replace(docs["text"], F.lit("\n"), F.lit(""))})
    claimed = F.when(F.crc32(docs["doc_id"].cast("string").cast("binary")) % 2 == 0, bare)
    manifest = merkle.build(docs, claimed=claimed)
    want = brute_manifest(rows)
    if not whole:
        want = [(*w[:4], sha(w[4]), *w[5:]) for w in want]
    assert sorted(map(tuple, merkle.proofs(manifest, whole).collect()), key=repr) == sorted(want, key=repr)
    assert 0 < sum(w[-1] for w in want) < len(want)
    sizes = {r.tree: r["size"] for r in manifest.subroots.collect()}
    assert sizes == Counter("" if r[3] is None else "=" + r[3] for r in rows)


def test_manifest_of_other_fields(spark, docs, none):
    one = merkle.build(docs.filter("doc_id = 500"))
    (got,) = merkle.proofs(one).collect()
    assert (got.leaf, got.proof, got.verified) == (one.root, "", True)
    by_lang = merkle.build(docs, fields=("doc_id", "a.b"), by="lang")
    assert by_lang.subroots.count() == 2
    assert merkle.proofs(by_lang).filter("verified").count() == docs.count()
    empty = merkle.build(none)
    assert (empty.root, merkle.proofs(empty).count()) == (sha(), 0)


def test_buckets_stay_whole():
    import pyarrow as pa

    slots = [s for n in (5, 1, 9000, 3, 9000, 9000, 2) for s in range(n)]
    batches = [pa.RecordBatch.from_arrays([pa.array(slots[i : i + 4000])], names=["slot"]) for i in range(0, len(slots), 4000)]
    tables = list(merkle._buckets(iter(batches), 0))
    assert len(tables) > 1 and all(t["slot"][0].as_py() == 0 for t in tables)
    assert [s for t in tables for s in t["slot"].to_pylist()] == slots


def brute_draw(rows, target, percent, least, buckets, grams, seed):
    def features(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", shared.fold_ascii(text or ""))
        runs = [" ".join(w[i : i + k]) for k in range(1, grams + 1) for i in range(len(w) - k + 1)]
        return Counter(zlib.crc32(x.encode()) % buckets for x in runs), len(w)

    own = [(r[0], *features(r[1])) for r in rows]
    s, t = Counter(), Counter()
    for _, f, _ in own:
        s.update(f)
    for x in target:
        t.update(features(x)[0])
    a, z = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000.0 * math.log((t[b] + 1) * (a + buckets) / ((s[b] + 1) * (z + buckets)))) for b in s}
    out = []
    for doc_id, f, n_words in own:
        n = sum(f.values())
        weight = sum(c * gain[b] for b, c in f.items()) // n if n else 0
        h = int(sha(f"{seed}:{'' if doc_id is None else doc_id}")[:8], 16)
        out.append([doc_id, n, weight, weight + math.floor(-1000.0 * math.log(-math.log((h + 0.5) / 4294967296))), None, n_words])
    able = sorted((x for x in out if x[5] >= least), key=lambda x: (-x[3], x[0] is not None, x[0] or 0, x[1], x[2]))
    for rank, x in enumerate(able[: percent * len(able) // 100], 1):
        x[4] = rank
    return [tuple(x[:5]) for x in out]


@pytest.mark.parametrize("buckets, grams, percent, least", [(10_000, 1, 10, 20), (7, 1, 50, 0), (40, 3, 100, 2)])
def test_draw(spark, docs, rows, buckets, grams, percent, least):
    target = ["alpha beta gamma", "été x1 x1", None, "日本 unseen words"]
    bench = spark.createDataFrame([(i, t, 1) for i, t in enumerate(target)], "item_id long, text string, bucket int")
    got = resample.draw(docs, bench, percent, least, buckets, grams).collect()
    want = brute_draw(rows, target, percent, least, buckets, grams, resample.SEED)
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_draw_from_nothing(spark, docs, none):
    bench = spark.createDataFrame([(1, "alpha beta")], "item_id long, text string")
    assert resample.draw(none, bench).count() == 0
    assert resample.draw(docs, bench.limit(0)).count() == docs.count()
    blank = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert [(r.n_features, r.weight, r["rank"]) for r in resample.draw(blank, bench, 100, 0).orderBy("rank").collect()] == [(0, 0, 1), (0, 0, 2)]


@pytest.mark.parametrize("grams", [1, 2, 4])
def test_parts_of_long_texts(monkeypatch, grams):
    text = "Aa bb cc-dd " * 5 + "x" * 30 + " é日 1"
    whole = resample.Buckets(1000, grams)(resample.WORD.findall(shared.fold_ascii(text)))
    for size in range(1, 40):
        monkeypatch.setattr(resample, "CHARS", size)
        hashed = resample.Buckets(1000, grams)
        got = [b for words, counted in resample.parts(text, grams) for b in hashed(words, counted)]
        assert Counter(got) == Counter(whole)


def brute_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))


def test_rule_counts(docs, rows, none):
    got = rules.judge(rules.measure(docs), None).collect()
    want = [(r[0], *(c := brute_counts(r[1])), c[0] < 10 or 100 * c[4] > 20 * c[0]) for r in rows]
    assert sorted((tuple(g)[:7] for g in got), key=repr) == sorted(want, key=repr)
    assert all(g.kept == (not g.base_failed) for g in got)
    assert rules.judge(rules.measure(none), None).count() == 0
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choices(["a", "b", " ", " ", "\n", "\t", " ", "é", "#", "\x1c", "\U0001f600", "|"], k=rng.randrange(200)))
        assert rules.counts_of(text)[:5] == brute_counts(text)


def test_repeated_words_of_a_long_text():
    rng = random.Random(9)
    words = [str(rng.randrange(40_000)) for _ in range(200_000)]
    words[150_000:150_020] = words[100:120]
    assert rules.repeated_words(words) == brute_counts(" ".join(words))[4] >= 40


def test_forest_paths():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(400, 3)), rng.normal(8, 3, size=(20, 3))])
    forest = rules.grow(x, trees=30, sample=64)

    def path(t, row):  # one document, one tree, node by node
        node = 0
        while forest.path[t, node] < 0:
            node = 2 * node + (2 if row[forest.feature[t, node]] >= forest.split[t, node] else 1)
        return forest.path[t, node]

    want = [2 ** (-np.mean([path(t, row) for t in range(30)]) / rules.mean_path(64)) for row in x]
    assert np.allclose(forest.scores(x), want)
    assert np.min(forest.scores(x[400:])) > np.median(forest.scores(x[:400]))
    same = rules.grow(np.ones((5, 3)), trees=4)
    assert np.allclose(same.scores(np.ones((2, 3))), 0.5)


def test_calibration():
    scores = np.array([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.6, 0.9])
    good = np.array([1, 1, 1, 1, 1, 1, 0, 0], bool)
    assert rules.calibrated(scores, good, 0.0) == 0.75  # ties at 0.6 go or stay together
    assert rules.calibrated(scores, good, 0.2) == 0.55
    assert rules.calibrated(scores, np.ones(8, bool)) == rules.calibrated(scores, np.zeros(8, bool)) == np.inf


def test_rules_leave_good_documents(spark):
    rng = random.Random(6)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randrange(2, 9))) for _ in range(500)]

    def text(bad):
        words = rng.choices(vocabulary, k=rng.randrange(30, 200))
        if bad:
            words = [w + rng.choice(["###", "$$$", "|"]) for w in words] if rng.random() < 0.5 else [w.upper() + "!!" for w in words]
        return "\n".join(" ".join(words[i : i + 12]) for i in range(0, len(words), 12)) + "."

    bad = {i: i % 9 == 0 for i in range(900)}
    df = spark.createDataFrame([(i, text(bad[i]), 1) for i in bad], "doc_id long, text string, kept int").repartition(3)
    labels = spark.createDataFrame([(i, int(not bad[i]), 0) for i in bad], "doc_id long, quality int, toxic int")
    forest = rules.fit(df, labels)
    held = [i for i in bad if shared.held_out_id(i)]
    got = {r.doc_id: r.kept for r in rules.judge(rules.measure(df), forest).collect()}
    assert len(got) == 900
    assert sum(got[i] for i in held if bad[i]) <= 2
    assert sum(not got[i] for i in held if not bad[i]) <= 3
    assert rules.fit(df, labels.limit(0)) is None
    assert rules.fit(df, labels.filter("quality = 1")).cut == math.inf
    again = rules.fit(df.repartition(5), labels.repartition(2))
    assert np.array_equal(again.split, forest.split) and again.cut == forest.cut


@pytest.mark.parametrize("lost", [0.0, 0.004, 0.2])
def test_cut_of_many_rows(spark, lost):
    rng = np.random.default_rng(8)
    good = rng.random(3000) < 0.8
    scores = np.round(rng.normal(np.where(good, 0.4, 0.5), 0.05), 3)
    rows = spark.createDataFrame(list(zip(scores.tolist(), good.astype(int).tolist(), strict=True)), "score double, y int").repartition(3)
    assert rules.best_cut(rows, lost) == rules.calibrated(scores, good, lost)
    assert rules.best_cut(rows.filter("y = 1"), lost) == rules.best_cut(rows.limit(0), lost) == np.inf


def test_every_labelled_row_counts(spark):
    ids = [i for i in range(16_000) if not shared.held_out_id(i)][:12_500]
    last = {r.id for r in spark.createDataFrame([(i,) for i in ids], "id long").orderBy(F.xxhash64("id"), "id").collect()[12_000:]}
    text = lambda i: " ".join(("#$%" if i in last else "word") + "x" * (i % 7) + str(k) for k in range(10 + i % 3))
    docs = spark.createDataFrame([(i, text(i)) for i in ids], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, int(i not in last)) for i in ids], "doc_id long, quality int")
    counts = rules.measure(docs).cache()
    forest = rules.fitted(counts, labels)
    rows = counts.join(labels, "doc_id").toPandas()
    held = rows[~rules.failed(rows.n_words, rows.n_repeat_words)]
    want = rules.calibrated(forest.scores(rules.ratios(held[rules.COUNTS + rules.MORE].to_numpy())), held.quality.to_numpy() == 1)
    assert forest.cut == want < np.inf  # no cut came of the first 12,000 rows, which are all good


def test_draws_are_of_all_rows(spark):
    rows = spark.range(2000).select(F.col("id").alias("doc_id"), *[(F.col("id") % (k + 2) + 1).alias(c) for k, c in enumerate(rules.COUNTS + rules.MORE)])
    got = rules.drawn(rows.repartition(5), 2000, 50, 8).toPandas()
    assert (got.groupby("tree").size() == 8).all() and len(got) == 400 and got.doc_id.nunique() > 300
    whole = rules.drawn(rows.limit(2000), 2000, 50, 300).toPandas()  # nothing is left out before the draw
    first = {t: set(g.nsmallest(8, ["h", "doc_id"]).doc_id) for t, g in whole.groupby("tree")}
    assert first == {t: set(g.doc_id) for t, g in got.groupby("tree")}
