"""Names of voices on a small board: both outcomes of each guard."""

import datetime

import pytest

from rostrum.operators import voices as V

DAY = datetime.date(2020, 1, 1)


def later(days):
    return DAY + datetime.timedelta(days=days)


@pytest.fixture(scope="module")
def make(spark):
    return lambda rows, schema: spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def board(make):
    return {
        "people": make([(1, "board", "Oakley", "Ron Oakley"), (2, "public", "Smith", "Ann Smith"), (3, "board", "Jones", None), (4, "board", "Moore", "Kim Moore")], "person_id long, kind string, surname string, full_name string"),
        "videos": make([("v1", 10, "A", DAY), ("v2", 11, "B", DAY), ("v3", 12, "A", later(401)), ("v4", 13, "A", None)], "video_id string, meeting_id long, body string, upload_date date"),
        "roster": make([(11, 1), (13, 3)], "meeting_id long, person_id long"),
        "terms": make([(1, "A", DAY, DAY), (3, "B", later(121), later(200)), (4, "A", later(120), later(150))], "person_id long, body string, first_seen date, last_seen date"),
    }


def test_supported(make, board):
    asked = [("v1", "OAKLEY", True), ("v2", "oakley", True), ("v3", "Oakley", False), ("v4", "Oakley", False), ("v4", "Jones", True), ("v2", "Jones", False), ("v1", "Moore", True), ("v9", "Smith", True), ("v9", "Oakley", False), ("v1", None, None)]
    got = V.supported(make([a[:2] for a in asked] * 2, "video_id string, name string"), board).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(asked * 2, key=repr)


def test_merged(make, board):
    rows = [
        ("v1", "S1", "Oakley", "anchor", 5), ("v1", "S2", "Oakley", "cluster", 99), ("v1", "S3", "Smith", "commenter", 1), ("v1", "S4", "Smith", "cluster", 2),
        ("v3", "S1", "Oakley", "cluster", 9), ("v3", "S2", "Oakley", "human", 1), ("v2", "S1", "Jones", "anchor", 9), ("v2", "S1", "Smith", "cluster", 1), ("v2", "S2", "Oakley", "anchor", 3), ("v2", "S3", "oakley", "anchor", 4),
    ]
    got = V.merged(make(rows, "video_id string, label string, name string, source string, votes int"), board)
    assert {tuple(r) for r in got.collect()} == {
        ("v1", "S1", "Oakley", "anchor"),  # the seat's other voice has a weaker source
        ("v1", "S3", "Smith", "commenter"), ("v1", "S4", "Smith", "cluster"),  # no seat, any number of voices
        ("v3", "S2", "Oakley", "human"),  # people are believed
        ("v2", "S1", "Smith", "cluster"),  # the anchor's name isn't supported there
        ("v2", "S3", "oakley", "anchor"),  # more votes
    }


def test_upserted_and_retracted(make):
    key = "video_id string, label string"
    stored = make([("v", "a", 1, "old", None), ("v", "b", 1, "old", "chair"), ("v", "c", 1, "old", "chair"), ("v", "d", 1, "old", "llm")], f"{key}, cluster int, name string, source string")
    decided = make([("v", "a", 2, "new"), ("v", "b", 2, "new"), ("v", "c", 2, None), ("v", "e", 2, "new")], f"{key}, cluster int, name string")
    got = V.upserted(stored, decided, make([("v", "c"), ("v", "c"), ("v", "d")], key))
    assert sorted(tuple(r)[1:] for r in got.collect()) == [("a", 2, "new", None), ("b", 2, "old", "chair"), ("c", 2, None, None), ("d", 1, "old", "llm"), ("e", 2, "new", None)]
    lines = make([("v", i, x, 7) for i, x in enumerate("abcd")] + [("v", 9, None, 7)], "video_id string, idx int, label string, cluster int")
    kept, cleared = V.retracted(stored, lines, make([("v", "a"), ("v", "b"), ("v", "a")], key), make([("v", "b")], key))
    assert sorted(r.label for r in kept.collect()) == ["b", "c", "d"]
    assert sorted((r.idx, r.cluster) for r in cleared.collect()) == [(0, None), (1, 7), (2, 7), (3, 7), (9, 7)]


def test_voice_names(make, board):
    rows = [("v1", 5, "Oakley"), ("v1", 5, "Oakley"), ("v3", 5, "Smith"), ("v2", 5, None), ("v2", 6, "Smith"), ("v1", None, "Smith")]
    got = V.voice_names(make(rows, "video_id string, cluster int, name string"), board)
    assert {tuple(r) for r in got.collect()} == {("v1", 5, "Oakley"), ("v2", 5, "Oakley"), ("v2", 6, "Smith")}  # not in v3, after the term


def test_chairs(make):
    seats = make([(v, n) for v, ns in {"v1": "AB", "v2": "ABC", "v3": "AB", "v4": "A"}.items() for n in ns], "video_id string, name string")
    votes = make([("v1", "S1", "A"), ("v2", "S1", "A"), ("v3", "S1", "A"), ("v4", "S1", "A")], "video_id string, label string, name string")
    gavels = make([("v1", "S1", 9), ("v1", "S2", 3), ("v1", "S3", 3), ("v2", "S2", 9), ("v3", "S2", 2), ("v4", "S2", 9)], "video_id string, label string, n int")
    assert [tuple(r) for r in V.chairs(votes, gavels, seats).collect()] == [("v1", "S3", "B")]


def test_reader_view(make, board):
    lines = make([("v", i) for i in range(7)], "video_id string, idx int")
    said = [("v", 0, "oakley", 1, "label", False), ("v", 1, "A. Smith", 2, "self", True), ("v", 2, "Oakley", None, "cluster", False), ("v", 3, "Jones", 3, "override", False), ("v", 4, "Nobody", None, "voice", None)]
    resolved = make(said, "video_id string, idx int, name string, person_id long, method string, contested boolean")
    pending = make([("v", 4, 5), ("v", 3, 4)], "video_id string, lo int, hi int")
    got = {r.idx: tuple(r)[2:] for r in V.reader_view(lines, resolved, pending, board["people"]).collect()}
    assert got == {
        0: ("Oakley", "label", True, False, "Ron Oakley"),
        1: ("Ann Smith", "self", False, True, "Ann Smith"),
        2: ("Oakley", "cluster", False, False, "Ron Oakley"),
        3: ("Jones", "override", True, True, "Jones"),
        4: ("Nobody", "voice", False, True, "Nobody"),
        5: (None, None, False, True, None),
        6: (None, None, False, False, None),
    }


def test_term_checks(make, board):
    rows = make([("v1", "S1", 1, "Oakley"), ("v3", "S1", 1, "Oakley"), ("v3", "S2", 1, "Oakley"), ("v4", "S1", 1, "Oakley"), ("v2", "S1", 2, "Oakley"), ("v1", "S9", 3, "Smith")], "video_id string, label string, cluster int, name string")
    labelled = make([("v3", "S2")], "video_id string, label string")
    assert {tuple(r) for r in V.out_of_term(rows, labelled, board).collect()} == {("v3", "S1", "Oakley")}
    names = V.voice_names(rows, board)
    assert {tuple(r) for r in V.off_body(rows, names, board).collect()} == {("v2", 2, "Oakley")}  # on the roster once, never on that board


def test_backfilled(make):
    voice = [*[("v", i, "A", 1) for i in (0, 1, 5)], ("v", 2, "B", 1), ("v", 3, "B", 1), ("v", 4, None, 1), ("v", 6, "C", 1), ("w", 0, "A", 2), ("w", 0, "A", 2)]
    lines = make(voice, "video_id string, idx long, label string, cluster int")
    ids = make([("v", "A", "Ann", "llm"), ("v", "B", "Bob", "x"), ("w", "A", None, "chair")], "video_id string, label string, name string, source string")
    names = make([("v", 1, "Ann"), ("w", 2, "Cy")], "video_id string, cluster int, name string")
    labels = make([("w", "A", "Dee")], "video_id string, label string, name string")
    overrides = make([("v", 1, 9, "Eve")], "video_id string, lo long, hi long, name string")
    ask = lambda similar: {tuple(r) for r in V.backfilled(lines, overrides, labels, ids, names, make([("v", "A", "Ann", 0.9), ("w", "A", "Cy", similar)], "video_id string, label string, name string, similarity double")).collect()}
    common = {
        ("v", None, 1, 9, "Eve", "override"), ("w", "A", 0, 0, "Dee", "label"), ("v", "A", 0, 1, "Ann", "llm"), ("v", "A", 5, 5, "Ann", "llm"), ("v", "B", 2, 3, "Bob", "voice"),
        ("v", "A", 0, 1, "Ann", "cluster"), ("v", "A", 5, 5, "Ann", "cluster"),  # B and C hear Ann from their cluster, but A is Ann
    }
    assert ask(0.70) == common | {("w", "A", 0, 0, "Cy", "cluster")}
    assert ask(0.69) == common


def test_terms_of_many_people_meet_a_day_once(make, spark):
    """A surname that many members have: spans lie apart, and members are counted by the day."""
    many = 300
    board = {
        "people": make([(i, "board", "Oakley", None) for i in range(many)], "person_id long, kind string, surname string, full_name string"),
        "videos": make([(f"v{i}", i, "A", later(i * 50)) for i in range(40)], "video_id string, meeting_id long, body string, upload_date date"),
        "roster": make([], "meeting_id long, person_id long"),
        "terms": make([(i, "A", later(i % 7), later(i % 7 + i % 3)) for i in range(many)] + [(0, "A", later(1500), later(1501))], "person_id long, body string, first_seen date, last_seen date"),
    }
    assert V.spans(board).count() == 2
    rows = make([(f"v{i}", "S1", "Oakley") for i in range(40)], "video_id string, label string, name string")
    held = {i for i in range(40) if i * 50 <= 408 or 1380 <= i * 50 <= 1901}
    assert {r.video_id for r in V.supported(rows, board).filter("supported").collect()} == {f"v{i}" for i in held}
    none = make([], "video_id string, label string")
    all_held = {i for i in range(40) if i * 50 <= 400}  # each of the members has a term that holds the day
    assert {r.video_id for r in V.out_of_term(rows, none, board).collect()} == {f"v{i}" for i in range(40)} - {f"v{i}" for i in all_held}
    assert V.off_body(rows.withColumnRenamed("label", "cluster"), rows.withColumnRenamed("label", "cluster"), board).count() == 0
