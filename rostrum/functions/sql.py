"""SQL functions over registered views: scalar ones and table functions, to be called from the text of a query.

``register`` makes the views and the functions of a session; each function's body is SQL, so that the optimizer turns its
subqueries into joins where it is called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rostrum.operators import voices as V

#: The views that functions read, and their columns.
VIEWS = {
    "people": "person_id, kind, surname, full_name",
    "videos": "video_id, meeting_id, body, upload_date",
    "roster": "meeting_id, person_id",
    "terms": "person_id, body, first_seen, last_seen",
    "spans": "surname, spans",
    "named_lines": "video_id, idx, name, human, basis, rank",
    "postings": "id, term, tf, len",
    "frequencies": "term, df",
    "corpus": "n_docs, avgdl",
}

_BOARD = "p.kind = 'board' AND lower(p.surname) = lower(nm)"
FUNCTIONS = {
    # whether a name can be heard in a recording: no board member has it, or the meeting's roster does, or a term on that board spans the day
    "name_supported": f"""(v STRING, nm STRING) RETURNS BOOLEAN RETURN
        (SELECT count(*) FROM {{people}} p WHERE {_BOARD}) = 0
        OR (SELECT count(*) FROM {{videos}} x JOIN {{roster}} r ON r.meeting_id = x.meeting_id JOIN {{people}} p ON p.person_id = r.person_id WHERE x.video_id = v AND lower(p.surname) = lower(nm)) > 0
        OR in_a_span((SELECT collect_set(struct(x.body, x.upload_date)) FROM {{videos}} x WHERE x.video_id = v), (SELECT any_value(b.spans) FROM {{spans}} b WHERE b.surname = lower(nm)))""",
    # whether one of the days of a recording lies in one of the spans of its board
    "in_a_span": """(days ARRAY<STRUCT<body: STRING, upload_date: DATE>>, spans ARRAY<STRUCT<body: STRING, lo: DATE, hi: DATE>>) RETURNS BOOLEAN RETURN
        coalesce(exists(days, d -> exists(spans, s -> s.body = d.body AND d.upload_date BETWEEN s.lo AND s.hi)), false)""",
    # the full name of a board member, any other name as it is
    "display_name": f"""(nm STRING) RETURNS STRING RETURN coalesce((SELECT min_by(p.full_name, p.person_id) FROM {{people}} p WHERE {_BOARD} AND p.full_name IS NOT NULL), nm)""",
    # how sure the weakest name of a passage's lines is; a passage without named lines has none
    "passage_speaker": """(v STRING, lo BIGINT, hi BIGINT) RETURNS TABLE (name_human BOOLEAN, name_basis STRING) RETURN
        SELECT w.human, w.basis FROM (SELECT max_by(struct(l.human, l.basis), struct(l.rank, -l.idx)) AS w FROM {named_lines} l WHERE l.video_id = v AND l.idx BETWEEN lo AND hi AND l.name IS NOT NULL) WHERE w IS NOT NULL""",
    # the best documents for a text
    "bm25": r"""(q STRING, lim INT) RETURNS TABLE (id BIGINT, score DOUBLE, rank INT) RETURN
        SELECT id, score, rank FROM (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM (
          SELECT pt.id, round(sum(ln((s.n_docs - d.df + 0.5) / (d.df + 0.5) + 1) * (pt.tf * 2.2D) / (pt.tf + 1.2D * (0.25D + 0.75D * pt.len / s.avgdl))), 6) AS score
          FROM (SELECT DISTINCT explode(regexp_extract_all(lower(q), '([\\p{{L}}\\p{{N}}]+)', 1)) AS term) w JOIN {frequencies} d ON d.term = w.term JOIN {postings} pt ON pt.term = w.term CROSS JOIN {corpus} s GROUP BY pt.id)) WHERE rank <= lim""",
}

#: Functions and views that a function needs besides the given ones.
NEEDS = {"name_supported": ["in_a_span"]}


def register(spark: SparkSession, prefix: str, functions: list[str], **views: DataFrame) -> None:
    """Views ``prefix``_name and the ``functions`` that read them, under their own names in this session."""
    if "terms" in views:  # the few spans of each surname, made once: a call joins no terms
        spans = V.spans(views).groupBy(F.col("_s").alias("surname")).agg(F.collect_list(F.struct("body", "lo", "hi")).alias("spans"))
        views = views | {"spans": spans}
    for name, df in views.items():
        columns = [c.strip() for c in VIEWS[name].split(",")]
        df.select(*columns).createOrReplaceTempView(f"{prefix}_{name}")
    for f in [*(n for f in functions for n in NEEDS.get(f, [])), *functions]:
        body = FUNCTIONS[f].format(**{v: f"{prefix}_{v}" for v in VIEWS})
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {f}{body}")
