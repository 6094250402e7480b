"""Replacing single recordings, and SQL functions."""

import uuid
from pathlib import Path

from pyspark.sql import functions as F

from rostrum.functions import sql
from rostrum.sources.store import BUCKET, Recordings


def files(path):
    return {str(p): p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}


def test_replace_leaves_other_files(spark, tmp_path):
    rows = [(f"r{i % 20}", i, f"line {i}") for i in range(200)]
    schema = "rec string, no long, said string"
    store = Recordings(spark, str(tmp_path / uuid.uuid4().hex), "rec", 8)
    store.load(spark.createDataFrame(rows, schema))
    assert sorted(map(tuple, store.read().collect())) == sorted(rows)
    before = files(store.path)

    same = [r for r in rows if r[0] in ("r3", "r4")]
    assert store.replace(spark.createDataFrame(same[::-1], schema)).count() == 0  # the same rows in another order
    assert files(store.path) == before

    new = [("r3", 900, None), ("r3", 901, "new"), ("r99", 1, "first")]
    changed = store.replace(spark.createDataFrame(new + [r for r in rows if r[0] == "r4"], schema))
    assert sorted(r[0] for r in changed.collect()) == ["r3", "r99"]
    want = [r for r in rows if r[0] != "r3"] + new
    assert sorted(map(repr, (tuple(r) for r in store.read().collect()))) == sorted(map(repr, want))
    touched = {r[0] for r in spark.createDataFrame([("r3",), ("r99",)], "rec string").select(F.pmod(F.xxhash64("rec"), F.lit(8))).collect()}
    after = files(store.path)
    assert {p: t for p, t in before.items() if not any(f"{BUCKET}={b}/" in p for b in touched)}.items() <= after.items()
    assert all(p not in after for p in before if any(f"{BUCKET}={b}/" in p for b in touched))


def test_replace_by_nothing(spark, tmp_path):
    rows = [("a", 1), ("a", 2), ("b", 3)]
    for buckets in (1, 64):
        store = Recordings(spark, str(tmp_path / uuid.uuid4().hex), "rec", buckets)
        store.load(spark.createDataFrame(rows, "rec string, no long"))
        none = spark.createDataFrame([], "rec string, no long")
        keys = spark.createDataFrame([("a",), ("unknown",)], "rec string")
        assert [r[0] for r in store.replace(none, keys).collect()] == ["a"]
        assert [tuple(r) for r in store.read().collect()] == [("b", 3)]
        store.replace(none, spark.createDataFrame([("b",)], "rec string"))
        assert store.read().count() == 0


def test_functions(spark):
    day = "DATE '2020-01-01'"
    people = spark.sql("SELECT * FROM VALUES (1, 'board', 'Oakley', 'Ron Oakley'), (2, 'public', 'Smith', 'Ann Smith'), (3, 'board', 'Jones', NULL) AS t(person_id, kind, surname, full_name)")
    videos = spark.sql(f"SELECT * FROM VALUES ('v1', 10, 'A', {day}), ('v2', 11, 'B', {day}), ('v3', 12, 'A', {day} + 401) AS t(video_id, meeting_id, body, upload_date)")
    roster = spark.sql("SELECT * FROM VALUES (11, 1) AS t(meeting_id, person_id)")
    terms = spark.sql(f"SELECT * FROM VALUES (1, 'A', {day}, {day}), (3, 'B', {day} + 121, {day} + 200) AS t(person_id, body, first_seen, last_seen)")
    sql.register(spark, "t", ["name_supported", "display_name"], people=people, videos=videos, roster=roster, terms=terms)
    ask = lambda v, n: spark.sql(f"SELECT name_supported('{v}', '{n}'), display_name('{n}')").first()
    assert tuple(ask("v1", "OAKLEY")) == (True, "Ron Oakley")  # by a term
    assert ask("v2", "Oakley")[0] and not ask("v3", "Oakley")[0]  # the roster; a day after the term's last
    assert not ask("v2", "Jones")[0] and tuple(ask("v9", "Smith")) == (True, "Smith")
    assert ask("v1", "Jones")[1] == "Jones"
