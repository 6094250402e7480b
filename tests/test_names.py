"""The name grammar and the guards of self-introductions on known lines."""

import pytest
from pyspark.sql import functions as F

from rostrum.operators import names as N


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "text string").select(column(N.squeezed(F.col("text")))).first()[0]


@pytest.mark.parametrize(
    "text, name",
    [
        ("My name is Corey Ward and I live at", "Corey Ward"),
        ("my  name\nis Um Mike Peters", "Mike Peters"),
        ("MY NAME IS Margaret St. James.", "Margaret St. James"),
        ("My name is Barbara McBride", "Barbara McBride"),
        ("My name is Al", None),
        ("my name is shelley", None),
        ("Uh Shelley Johnson, 6400 Madison Street, and I have been sworn.", "Shelley Johnson"),
        ("Good afternoon, Shelley Johnson, [address removed], and I have been sworn", "Shelley Johnson"),
        ("Shelley Johnson, 6400 Madison Street", None),
        ("I live at 1234 Margaret Street, 55 and I have been sworn", None),
        ("", None),
        (None, None),
    ],
)
def test_said_names(spark, text, name):
    assert one(spark, text, N.said_name) == name


@pytest.mark.parametrize(
    "text, queue",
    [
        ("Elaine Lance, followed by Anthony Sikhenes. Followed by Nancy Hazelwood.", ["Elaine Lance", "Anthony Sikhenes", "Nancy Hazelwood"]),
        ("Thank you. Mr. Chairman Mariano. All right, Elaine Lance, followed by Bob.", ["Elaine Lance"]),
        ("And Nancy Hazelwood.", ["Nancy Hazelwood"]),
        ("I spoke with John Smith yesterday.", []),
        ("Next up we have Okay Debbie Manns And", ["Debbie Manns"]),
        ("Signed up is Nancy O'Neil", []),
        ("followed by the Agenda Item", []),
        ("Clerk Smith, and then Thomas Smyers", ["Thomas Smyers"]),
        ("", []),
        (None, []),
    ],
)
def test_queues(spark, text, queue):
    assert one(spark, text, N.queued) == queue


def test_guards_in_their_order(spark):
    me, letter = "My name is Ann Smith", "The next email is from Bob Jones. My name is Bob Jones"
    lines = [("a", i, "V1", "a line") for i in range(4)] + [("a", 4, "V1", me), ("a", 5, "V2", me), ("a", 6, "V1", "mrs smith spoke")]
    lines += [("b", 0, "V1", "say your name. My name is Ann Smith"), ("b", 1, "V1", letter)]  # reading wins over the prompt, also for its run's other lines
    lines += [("c", 0, "V1", "give us your name. My name is Ann Smith"), ("c", 1, "V2", "My name is Ann Smith. Give me your name")]
    lines += [("d", 0, "V1", me), ("d", 1, "V2", me), ("d", 2, "V3", letter), ("d", 3, "V2", "nothing"), ("d", 5, "V2", "To whom it may concern"), ("d", 6, "V2", "My name is Cy Young")]
    frame = spark.createDataFrame(lines, "rec string, idx long, label string, text string").repartition(3)
    held = spark.createDataFrame([("d", "V1", "Oakley"), ("d", "V2", "SMITH"), ("d", "V3", "Oakley")], "rec string, label string, name string")
    letters = spark.createDataFrame([("d", 2, 3), ("a", 0, 6)], "rec string, lo long, hi long")
    got = {(r.rec, r.idx): tuple(r)[3:] for r in N.self_claims(frame, held, letters).collect()}
    assert got == {
        ("a", 4): ("Ann Smith", "self", 0, 4, True),
        ("a", 5): ("Ann Smith", "self_weak", 5, 5, True),
        ("b", 0): ("Ann Smith", "read_aloud", 0, 0, False),
        ("b", 1): ("Bob Jones", "read_aloud", 1, 1, False),
        ("c", 0): ("Ann Smith", "prompted", 0, 0, False),
        ("c", 1): ("Ann Smith", "self_weak", 1, 1, True),
        ("d", 0): ("Ann Smith", "board_voice", 0, 0, False),
        ("d", 1): ("Ann Smith", "self", 1, 1, True),
        ("d", 2): ("Bob Jones", "read_aloud", 2, 3, False),
        ("d", 6): ("Cy Young", "read_aloud", 6, 6, False),
    }
