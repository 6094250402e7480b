"""Operators on small hand-written frames: the scenarios that their rules exist for."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from rostrum.functions import text as T
from rostrum.operators import aggregates, identity, intervals, parsers, passages, places, redaction, search, subjects
from rostrum.plans import registry
from rostrum.streaming import windows


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_as_of_rejects_a_hole(spark):
    points = spark.createDataFrame([("v", i) for i in (0, 4, 5, 6, 12)], "k string, idx int")
    spans = spark.createDataFrame([("v", 0, 4, 1), ("v", 6, 9, 2)], "k string, s int, e int, id int")
    got = intervals.as_of(points, spans, ["k"], "idx", "s", "e", "id")
    assert [tuple(r) for r in got.orderBy("idx").select("idx", "id").collect()] == [(0, 1), (4, 1), (5, None), (6, 2), (12, None)]


def test_uncovered(spark):
    speech = spark.createDataFrame([("v", 0.0, 10.0), ("v", 20.0, 30.0)], "k string, s double, e double")
    words = spark.createDataFrame([("v", 1.0, 3.0), ("v", 2.0, 4.0), ("v", 7.0, 22.0)], "k string, s double, e double")
    assert rows(intervals.uncovered(speech, words, ["k"], "s", "e", 2.0)) == [("v", 4.0, 7.0), ("v", 22.0, 30.0)]
    none = words.limit(0)
    assert rows(intervals.uncovered(speech, none, ["k"], "s", "e", 2.0)) == [("v", 0.0, 10.0), ("v", 20.0, 30.0)]


def test_overlapping_pairs_against_all_pairs(spark):
    rng = random.Random(3)
    spans = [(rng.choice("vw"), i, s := rng.randrange(-300, 300), s + rng.choice([-5, 0, 1, 40, 64, 500])) for i in range(150)]
    spans += [("v", 900, None, 4), ("v", 901, 4, None), (None, 902, 0, 9), ("w", 903, 64, 64), ("w", 904, 64, 64)]
    got = rows(intervals.overlapping_pairs(spark.createDataFrame(spans, "k string, id int, s int, e int"), ["k"], "id", "s", "e"))
    whole = [x for x in spans if None not in x]
    assert got == sorted((a[0], a[1], b[1]) for a in whole for b in whole if a[0] == b[0] and a[1] < b[1] and a[2] <= b[3] and b[2] <= a[3])


def test_merged_uses_the_furthest_end(spark):
    spans = spark.createDataFrame([("v", 0, 100), ("v", 5, 10), ("v", 90, 95), ("v", 161, 170)], "k string, s int, e int")
    assert rows(intervals.merged(spans, ["k"], "s", "e", 60)) == [("v", 0, 100, 3), ("v", 161, 170, 1)]


def test_claim_ladder(spark):
    lines = spark.createDataFrame([("v", i) for i in range(10)], "video_id string, idx int")
    claims = spark.createDataFrame(
        [(1, "v", 0, 9, "Ann", "voice", False), (2, "v", 3, 5, "Bob", "self", False), (3, "v", 4, 4, None, "override", False), (4, "v", 6, 8, "Cid", "read_aloud", False), (5, "v", 0, 1, "Dee", "cluster", True)],
        "id int, video_id string, start_idx int, end_idx int, name_text string, method string, corroborated boolean",
    )
    got = {r.idx: (r.name_text, r.method, r.contested) for r in identity.resolve(lines, claims).collect()}
    assert got[0] == ("Dee", "cluster", True)  # promoted to rank 7, and narrower
    assert got[2] == ("Ann", "voice", False) and got[3] == ("Bob", "self", True)
    assert got[4] == (None, "override", True) and got[6] == ("Cid", "read_aloud", False) and got[9] == ("Ann", "voice", False)


def test_components(spark):
    nodes = spark.createDataFrame([(i,) for i in range(12)], "id long")
    edges = spark.createDataFrame([(i, i + 1) for i in range(6)] + [(9, 8)], "a long, b long")
    assert rows(identity.components(nodes, edges)) == [*((i, 0) for i in range(7)), (7, 7), (8, 8), (9, 8), (10, 10), (11, 11)]
    with pytest.raises(RuntimeError):
        identity.components(nodes, edges, max_rounds=1)


def test_bm25_micro_corpus(spark):
    docs = spark.createDataFrame([(1, "red bolt"), (2, "red red ring"), (3, ""), (4, None), (5, "... !!")], "id long, text string")
    index = search.build_index(docs, "id", "text")
    stats = index.stats.first()
    assert stats.n_docs == 2 and stats.avgdl == 2.5
    q = spark.createDataFrame([(0, "red red bolt unknown")], "qid long, text string")
    got = [r.id for r in search.ranked(search.bm25(index, search.query_terms(q, "qid", "text")), 5).orderBy("rank").collect()]
    assert got == [1, 2]
    after = docs.withColumn("text", F.when(F.col("id") == 1, "blue ring").otherwise(F.col("text")))
    again = search.refreshed(index, after, spark.createDataFrame([(1,)], "id long"), "id", "text")
    new = search.build_index(after, "id", "text")
    for a, b in ((again.terms, new.terms), (again.df, new.df), (again.lengths, new.lengths), (again.stats, new.stats)):
        assert rows(a) == rows(b)


def test_fusion_ties_and_floor(spark):
    schema = "qid long, id long, rank int"
    a = spark.createDataFrame([(0, 7, 1)], schema)
    b = spark.createDataFrame([(0, 3, 1, 0.9), (0, 4, 2, -0.2), (1, 5, 1, 0.5), (1, 6, 2, 0.6)], schema + ", score double")
    c = a.limit(0)
    attributes = spark.createDataFrame([(i, "g") for i in range(3, 8)], "id long, g string")
    got = search.hybrid(a, b, c, attributes, F.lit(True), "g").select("qid", "place", "id")
    # equal sums keep the first list's order; the floor of 0.55 holds where no lexical list has hits
    assert rows(got) == [(0, 1, 7), (0, 2, 3), (1, 1, 6)]


def test_spread_slot_is_used_before_the_floor(spark):
    b = spark.createDataFrame([(0, 1, 1, 0.1), (0, 2, 2, 0.9)], "qid long, id long, rank int, score double")
    none = b.limit(0).drop("score")
    attributes = spark.createDataFrame([(1, "g"), (2, "g")], "id long, g string")
    assert search.hybrid(none, b, none, attributes, F.lit(True), "g", spread=1).count() == 0


def test_redaction_round(spark):
    lines = spark.createDataFrame([(1, "I live at 12 Oak and 12 Oak Road"), (2, "nothing")], "id int, raw string")
    spans = spark.createDataFrame([(1, 2, "12 Oak"), (1, 1, "12 Oak Road")], "id int, no int, span string")
    got = rows(redaction.republished(lines, spans, ["id"], "raw", "no", "span").select("id", "published"))
    assert got == [(1, "I live at [redacted] and [redacted]"), (2, "nothing")]
    assert rows(redaction.republished(lines, spans.limit(0), ["id"], "raw", "no", "span").select("published")) == rows(lines.select("raw"))


def test_outcomes_dates_and_clocks(spark):
    df = spark.createDataFrame([("Withdrawn by staff",), ("APPROVED as amended",), ("staff recommends approval",), ("",), (None,), ("Motion failed 2-3",)], "s string")
    assert [r[0] for r in df.select(T.outcome(F.col("s"))).collect()] == ["withdrawn", "approved", "other", None, None, "denied"]
    df = spark.createDataFrame([("BCC 6.9.2020 AM",), ("Board (01-02-19)",), ("March 3rd, 2021 workshop",), ("13/45/2020",), ("none",)], "s string")
    assert [r[0] for r in df.select(T.title_date(F.col("s"))).collect()] == ["2020-06-09", "2019-01-02", "2021-03-03", None, None]
    df = spark.createDataFrame([("1:06:30",), ("06:30",), ("30",)], "s string")
    assert [r[0] for r in df.select(T.seconds_of(F.col("s"))).collect()] == [3990.0, 390.0, 30.0]


def test_passages(spark):
    long = "one two three four five six seven eight nine ten eleven twelve "
    lines = [(0, "A", long * 4), (1, "A", long), (2, "B", "yes"), (3, "A", "no"), (4, "A", "well"), (5, "B", long)]
    df = spark.createDataFrame([("r", *x) for x in lines], "rec string, idx int, who string, body string")
    got = passages.build(df, "rec", "idx", "who", "body", least=1).orderBy("start_idx").collect()
    assert [tuple(g)[1:4] for g in got] == [(0, 1, "A"), (2, 4, "(exchange)"), (5, 5, "(exchange)")]
    assert got[1].text == "B: yes A: no well"


def test_parsers(spark):
    assert parsers.digits_of("case two six zero one of twenty five items and zero") == "case 2601 of 25 items and zero"
    assert parsers.sentences_of("Mr. Smith said no. Then J. Doe left. Done") == ["Mr. Smith said no.", "Then J. Doe left.", "Done"]
    df = spark.createDataFrame([("abcd", "abxd"), (None, "a")], "a string, b string")
    assert [r.r for r in parsers.similarity(df, "a", "b", "r").collect()] == [difflib.SequenceMatcher(None, "abcd", "abxd").ratio(), None]


def test_subject_containment(spark):
    items = spark.createDataFrame([(1, "red ring"), (2, "red bolt"), (3, "ring")], "id long, text string")
    got = rows(subjects.membership(items, [("top", None, None), ("ring", "top", "ring"), ("red", "ring", "red")]))
    assert got == [("red", 1), ("ring", 1), ("ring", 3), ("top", 1), ("top", 3)]


def test_rate_burst(spark):
    hits = spark.createDataFrame([(i, "a", f"2024-01-01 00:0{i}:00") for i in range(7)] + [(9, "a", "2024-01-01 00:20:00")], "id long, k string, ts string")
    got = windows.over_limit(hits.withColumn("ts", F.col("ts").cast("timestamp")), "k", "id", 600, 6)
    assert rows(got) == [(6, "a", 7)]


def test_upsert_keeps_what_was_fetched(spark):
    old = spark.createDataFrame([(1, "a", "body"), (2, "b", None)], "id int, name string, text string")
    new = spark.createDataFrame([(1, "A", "other"), (2, "B", "new"), (3, "C", None)], "id int, name string, text string")
    got = {r.id: (r.name, r.text) for r in aggregates.upsert(old, new, ["id"], ["text"]).collect()}
    assert got == {1: ("A", "body"), 2: ("B", "new"), 3: ("C", None)}


def test_assignment_is_the_best_permutation():
    from itertools import permutations

    import numpy as np

    from rostrum.operators import records

    rng = np.random.default_rng(4)
    for _ in range(40):
        votes = rng.integers(0, 6, (rng.integers(1, 5), rng.integers(1, 5)))
        got = records.best_assignment(votes.astype(float))
        square = np.zeros((4, 4))
        square[: votes.shape[0], : votes.shape[1]] = votes
        best = max(sum(square[i, p[i]] for i in range(4)) for p in permutations(range(4)))
        assert sum(votes[i, j] for i, j in got) == best
        assert len({i for i, _ in got}) == len(got) == len({j for _, j in got})


def test_redline():
    from rostrum.operators import records

    assert records.word_diff("a b c".split(), "a x c d".split()) == [("same", "a"), ("gone", "b"), ("new", "x"), ("same", "c"), ("new", "d")]


def test_agenda(spark):
    from rostrum.operators import records

    text = "CONSENT\nC1  First  item\nwrapped title\nPage 1 of 2\nRecommendation: approve\n\nPublic Hearings:\nP 12 Second\nDepartment: x\nADJOURN\nafter"
    files = spark.createDataFrame([(1, text), (2, ""), (3, None)], "id int, body string")
    assert rows(records.agenda_items(files, "id", "body")) == [(1, 1, "C1", "consent", "First item wrapped title", "approve"), (1, 2, "P12", "public hearings", "Second", None)]


def test_file_sources(spark, tmp_path):
    from rostrum.sources import files

    (tmp_path / "tab.txt").write_text("a\tTitle\t10\nbad line\nb\tOther\tNA\na\tAgain\t11\n")
    assert rows(files.catalogue(spark, str(tmp_path / "tab.txt"))) == [("a", "Title", 10.0)]
    (tmp_path / "turns.json").write_text('{"video_id": "v", "turns": [{"start": 0.0, "end": 1.5, "speaker": "S0"}]}\n')
    assert rows(files.diarization(spark, str(tmp_path / "turns.json"))) == [("v", 0.0, 1.5, "S0")]
    (tmp_path / "silence.txt").write_text("[x] silence_start: 1\n[x] silence_end: 2.5\n")
    assert rows(files.silences(spark, str(tmp_path / "silence.txt"))) == [(2.5,)]
    df = spark.createDataFrame([("v", 0, "a"), ("w", 0, "b")], "video_id string, idx int, text string")
    files.reload_recordings(df, str(tmp_path / "u"))
    files.reload_recordings(spark.createDataFrame([("w", 0, "c")], df.schema), str(tmp_path / "u"))
    assert rows(spark.read.parquet(str(tmp_path / "u")).select("video_id", "text")) == [("v", "a"), ("w", "c")]
    files.write_json_lines(df, str(tmp_path / "b"))
    assert rows(files.restore_json_lines(spark, str(tmp_path / "b"), df, 2)) == rows(df)
    spoken = spark.createDataFrame([("v", 0, 3661.5, 3662.0, "hi")], "video_id string, idx int, start double, end double, text string")
    assert files.subtitles(spoken).first().value == "1\n01:01:01,500 --> 01:01:02,000\nhi\n"


def test_anchors_grow_but_seeds_win(spark):
    v = [(1, [1.0, 0.0]), (2, [0.9, 0.436]), (3, [0.62, 0.785]), (4, [0.0, 1.0]), (5, [-1.0, 0.0])]
    voices = spark.createDataFrame(v, "id long, v array<double>")
    seeds = spark.createDataFrame([(1, "Ann"), (4, "Bob")], "id long, name string")
    got = {r.id: r.name for r in identity.grow_anchors(voices, seeds).collect()}
    assert got == {1: "Ann", 2: "Ann", 3: "Bob", 4: "Bob"}


def test_drift_of_stored_rows(spark):
    from rostrum.operators import checks

    of = lambda rows: spark.createDataFrame(rows, "k int, v string")
    got = checks.drift(of([(1, "a"), (2, None), (3, "c"), (5, None)]), of([(1, "a"), (2, "b"), (4, "d"), (5, None)]), ["k"], ["v"])
    assert {(r.k, r.state) for r in got.collect()} == {(2, "changed"), (3, "extra"), (4, "missing")}
    assert checks.drift(of([]), of([]), ["k"]).count() == 0


def test_numbers_read():
    from rostrum.operators.parsers import read_numbers

    said = {
        "nineteen ninety nine and twenty twenty four": "1999 and 2024",
        "Five thousand three hundred and forty two": "5342",
        "the twenty first of may": "the 21st of may",
        "three point one four percent": "3.14 percent",
        "two million five hundred thousand": "2500000",
        "one hundred and third street": "103rd street",
        "the eleventh hour, point taken": "the 11th hour, point taken",
        "hundred": "hundred",
        "": "",
    }
    assert {k: read_numbers(k) for k in said} == said
    assert read_numbers(None) is None


def test_folded_names(spark):
    from rostrum.operators import checks

    df = spark.createDataFrame([("The Mayor Lee",), ("Dr. Mary Wu ",), ("Drew Day",), (None,)], "n string")
    assert [r[0] for r in df.select(checks.folded_name(df["n"])).collect()] == ["lee", "mary wu", "drew day", None]


def test_case_ids_of_long_numbers(spark, tmp_path):
    """A sequence of seven digits is no case number, and its parts are empty, as in SQL."""
    from rostrum.plans import registry

    rows = [(1, "ECONOMY"), (999_900, "ECONOMY"), (2, None), (3, "X1")]
    spark.createDataFrame(rows, "p_partkey long, p_type string").write.parquet(str(tmp_path / "part.parquet"))
    got = {r.p_partkey: r.case_id for r in registry.queries()["T13_case_ids"](spark, str(tmp_path)).collect()}
    duck = pytest.importorskip("duckdb").connect()
    duck.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    assert got == dict(duck.sql(registry.oracle_sql()["T13_case_ids"]).fetchall())
    assert got[999_900] == "--" and got[1] == "ECON-21-101" and got[2] is None


def test_rates_of_a_hot_key_are_split(spark, monkeypatch):
    rng = random.Random(5)
    micros = [rng.randrange(-20_000, 40_000) * 500_000 for _ in range(700)] + [0, 0, 600_000_000, 600_000_001, None, None]
    events = [(i, rng.choice("aaaab") if i % 50 else None, m) for i, m in enumerate(micros)]
    df = spark.createDataFrame(events, "id long, k string, m long").withColumn("ts", F.timestamp_micros("m"))
    want = set()
    for i, k, m in events:
        n = sum(k == k2 and (m is m2 is None or None not in (m, m2) and m - 600_000_000 <= m2 <= m) for _, k2, m2 in events)
        want |= {(i, k, n)} if n > 1 else set()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = windows.over_limit(df, "k", "id", 600, 1)
        assert {tuple(r) for r in got.collect()} == want
        assert got.filter("k = 'a'").select(F.spark_partition_id()).distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_uncovered_by_sweep(spark, monkeypatch):
    speech = spark.createDataFrame([("v", 0.0, 10.0), ("v", 10.0, 20.0), ("v", 5.0, 8.0), ("v", 5.0, 8.0), ("w", 0.0, 9.0), ("x", None, 3.0)], "k string, s double, e double")
    words = spark.createDataFrame([("v", 6.0, 6.0), ("v", 13.0, 14.0), ("v", 13.5, 30.0), ("w", 9.0, 12.0), ("y", 0.0, 1.0)], "k string, s double, e double")
    monkeypatch.setattr(places, "ROWS", 3)
    got = intervals.uncovered(speech, words, ["k"], "s", "e", 2.0)
    assert rows(got) == [("v", 0.0, 6.0), ("v", 6.0, 13.0), ("w", 0.0, 9.0)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "RepartitionByExpression [k" in plan


def test_dealt_by_count(spark):
    rows_ = spark.range(1000).withColumn("k", F.col("id") % 97)
    assert places.dealt(rows_, 1000, "k").rdd.getNumPartitions() == 4
    assert places.dealt(rows_, 10 * places.ROWS + 1, "k").rdd.getNumPartitions() == 11


def test_page_letters_of_repeated_lines(spark, tmp_path):
    lines = [(1, s) for s in [5, 5, 7, None, None, *range(100, 130)]] + [(2, 5)]
    spark.createDataFrame(lines, "l_orderkey long, l_suppkey long").repartition(2).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = registry.queries()["Y10_page_letters"](spark, str(tmp_path))
    assert "Aggregate" not in got._jdf.queryExecution().optimizedPlan().toString()
    letters = {(r.l_orderkey, r.l_suppkey): r.letter for r in got.collect()}
    assert len(letters) == got.count() == 34 and letters[2, 5] == "A" and letters[1, 129] == "AG"
