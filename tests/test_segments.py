"""Title grounding, assembly, binding and quotes on known cases."""

import pytest
from pyspark.sql import functions as F

from rostrum.functions import text as T
from rostrum.operators import segments as G


@pytest.mark.parametrize(
    "title, said, search, coverage",
    [
        ("Zoning of the Wellfield, R57 approval", "we hear the wellfield zoning today", "Zoning of the Wellfield, approval", 2 / 3),
        ("Public Hearing - Bridge repairs", "the BRIDGE needs a repair", "Public Hearing - Bridge repairs", 1.0),
        ("Public Hearing on Bridge repair", "bridges are what we spoke of", None, 0.5),
        ("Consent agenda items", "consent agenda items", None, 0.0),
        ("ALPR cameras 2024 / budget", "alpr and 2024 it is", "ALPR 2024", 0.5),
        ("", "anything", None, 0.0),
        (None, "anything", None, 0.0),
    ],
)
def test_grounded(spark, title, said, search, coverage):
    df = spark.createDataFrame([(title, said)], "title string, said string")
    got = df.select(G.grounded(F.col("title"), G.said(F.col("said"))).alias("g")).select("g.*").first()
    assert (got.search_title, round(got.coverage, 9)) == (search, round(coverage, 9))


def test_assembled_and_bound(spark):
    lines = [("d1", i, "am" if i < 4 else "pm", i % 4, f"the zoning bridge line {i}") for i in range(8)] + [("d2", 0, "x", 7, None)]
    marks = [("d1", 2, 1, "late", "never", "R1"), ("d1", 2, 0, "regular", "Bridge zoning", "R1"), ("d1", 5, 0, "hearing", "About R-02 and C3", "Q9"), ("d1", 99, 0, "regular", "beyond", None)]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    codes = frame([("d1", "R1"), ("d1", "R2"), ("d1", "C3")], "day string, code string")
    got = G.assembled(frame(lines, "day string, line long, rec string, idx long, text string"), frame(marks, "day string, line long, no int, phase string, title string, code string"), codes)
    rows = {(r.day, r.line, r.rec): (r.part, r.seq, r.start_idx, r.end_idx, r.phase, r.code, r.search_title) for r in got.collect()}
    assert rows == {
        ("d1", 0, "am"): (0, 0, 0, 1, "regular", "R1", "Bridge zoning"),  # the first mark's words for the day's head
        ("d1", 2, "am"): (0, 1, 2, 3, "regular", "R1", "Bridge zoning"),
        ("d1", 2, "pm"): (1, 0, 0, 0, "regular", "R1", "Bridge zoning"),
        ("d1", 5, "pm"): (0, 1, 1, 3, "hearing", None, None),
        ("d2", 0, "x"): (0, 0, 7, 7, "other", None, None),
    }
    items = frame([("d1", 10, 0, "R1"), ("d1", 11, 1, "R2"), ("d1", 12, 2, "C3"), ("d1", 13, 5, None)], "day string, item_id long, seq long, code string")
    assert sorted(map(tuple, G.bound(got, items).collect()), key=repr) == sorted(
        [("d1", "am", 0, 10, None, "bound"), ("d1", "am", 1, 10, None, "bound"), ("d1", "pm", 0, 10, None, "bound"), ("d1", "pm", 1, 11, None, "bound"), ("d2", "x", 0, None, 0, "phase")], key=repr
    )
    none = items.filter("code = 'C3'")
    assert sorted((r.rec, r.seq, r.new_seq, r.kind) for r in G.bound(got.filter("day = 'd1'").withColumn("code", F.lit(None).cast("string")), none).filter("item_id is null").collect()) == [
        ("am", 0, 3, "unmatched"), ("am", 1, 4, "unmatched"), ("pm", 0, 5, "unmatched"),
    ]


@pytest.mark.parametrize(
    "text, quote",
    [
        ("First. I object to this. Last.", "I object to this."),
        ("and so I object", "…and so I object"),
        ("So I object", "So I object"),
        ("a. " + "x " * 100 + "object" + " y" * 100 + ". z", ("x " * 100 + "object" + " y" * 100)[:240].rstrip() + "…"),
        ("nothing " * 50, ("nothing " * 50)[:240]),
        ("", ""),
    ],
)
def test_quotes(spark, text, quote):
    assert spark.createDataFrame([(text,)], "t string").select(T.quote(F.col("t"), "object")).first()[0] == quote
