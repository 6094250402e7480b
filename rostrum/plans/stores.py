"""Stored recordings that are replaced one by one, and SQL functions called from the text of a query."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from rostrum.functions import sql
from rostrum.operators import identity as D
from rostrum.operators import passages as P
from rostrum.operators import search as S
from rostrum.plans.identity import _RESOLVED, resolved
from rostrum.plans.readmodels import PASSAGES
from rostrum.plans.registry import query
from rostrum.plans.search import _POST
from rostrum.sources import staging
from rostrum.sources.store import Recordings


def _store(df, key, buckets=16):
    spark = df.sparkSession
    held = Recordings(spark, f"{staging.shared_dir(spark)}/recordings-{uuid.uuid4().hex}", key, buckets)
    held.load(df)
    return held


# A second delivery: every fifth conversation comes again with its even turns said twice, every fifteenth of them as it was, and
# every thirty-fifth one has lost its lines.
_AGAIN = "(SELECT conv_id, turn, role, CASE WHEN conv_id % 5 = 0 AND conv_id % 15 <> 0 AND turn % 2 = 0 THEN text || ' ' || text ELSE text END AS text FROM conversations WHERE conv_id % 35 <> 0)"


def delivered(t):
    """The conversations that come again, with their new lines, and their keys."""
    c = t("conversations").filter("conv_id % 5 = 0")
    keys = c.select("conv_id").distinct()
    text = F.when((F.col("conv_id") % 15 != 0) & (F.col("turn") % 2 == 0), F.concat("text", F.lit(" "), "text")).otherwise(F.col("text"))
    return c.filter("conv_id % 35 <> 0").withColumn("text", text), keys


def _lines(c):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return c.select(F.col("conv_id").alias("video_id"), (F.row_number().over(w) - 1).cast("long").alias("idx"), "text", F.col("text").alias("text_raw"))


@query("S10_bulk_load", f"SELECT conv_id AS video_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS idx, text, text AS text_raw FROM {_AGAIN}")
def bulk_load(t):
    """All recordings are loaded; then those that come again replace their own rows, and what is stored is read back."""
    store = _store(_lines(t("conversations")), "video_id")
    again, keys = delivered(t)
    store.replace(_lines(again), keys.withColumnRenamed("conv_id", "video_id"))
    return store.read()


@query("I26_rebuild_one_recording", PASSAGES.format(_AGAIN))
def rebuild(t):
    """Passages of all recordings are stored; those of the recordings that come again are built anew, with other boundaries, and the rest stays."""
    build = lambda c: P.build(c, "conv_id", "turn", "role", "text")
    store = _store(build(t("conversations")), "conv_id")
    again, keys = delivered(t)
    store.replace(build(again), keys)
    return store.read()


# Every fiftieth customer sits on a board, an order is a meeting of the board of its priority, and its customer is on the roster.
PEOPLE = """people AS (SELECT c_custkey AS person_id, CASE WHEN c_custkey % 3 = 0 THEN 'board' ELSE 'public' END AS kind, 'Name' || c_custkey % 40 AS surname, CASE WHEN c_custkey % 7 > 0 THEN c_name END AS full_name FROM customer),
videos AS (SELECT o_orderkey::VARCHAR AS video_id, o_orderkey AS meeting_id, o_orderpriority AS body, o_orderdate::DATE AS upload_date FROM orders),
roster AS (SELECT o_orderkey AS meeting_id, o_custkey AS person_id FROM orders WHERE o_orderkey % 2 = 0),
terms AS (SELECT o_custkey AS person_id, o_orderpriority AS body, min(o_orderdate)::DATE AS first_seen, max(o_orderdate)::DATE AS last_seen FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1, 2),
said AS (SELECT o_orderkey, 'NAME' || (o_custkey + CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE o_orderkey END) % 45 AS nm FROM orders)"""


def board(t):
    """The tables of boards, their members and meetings."""
    k = F.col("c_custkey")
    o = t("orders").withColumn("day", F.to_date(F.col("o_orderdate").cast("timestamp")))
    people = t("customer").select(k.alias("person_id"), F.when(k % 3 == 0, "board").otherwise("public").alias("kind"), F.concat(F.lit("Name"), k % 40).alias("surname"), F.when(k % 7 > 0, F.col("c_name")).alias("full_name"))
    videos = o.select(F.col("o_orderkey").cast("string").alias("video_id"), F.col("o_orderkey").alias("meeting_id"), F.col("o_orderpriority").alias("body"), F.col("day").alias("upload_date"))
    roster = o.filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("meeting_id"), F.col("o_custkey").alias("person_id"))
    terms = o.filter("o_orderstatus <> 'P'").groupBy(F.col("o_custkey").alias("person_id"), F.col("o_orderpriority").alias("body")).agg(F.min("day").alias("first_seen"), F.max("day").alias("last_seen"))
    return {"people": people, "videos": videos, "roster": roster, "terms": terms}


_MATCH = "kind = 'board' AND lower(surname) = lower(nm)"


@query("D1_scalar_functions", f"""WITH {PEOPLE},
f AS (SELECT o_orderkey, nm,
  NOT EXISTS (SELECT 1 FROM people WHERE {_MATCH})
  OR EXISTS (SELECT 1 FROM roster r JOIN people p ON p.person_id = r.person_id WHERE r.meeting_id = o_orderkey AND lower(p.surname) = lower(nm))
  OR EXISTS (SELECT 1 FROM videos x JOIN terms b ON b.body = x.body JOIN people p ON p.person_id = b.person_id WHERE x.meeting_id = o_orderkey AND lower(p.surname) = lower(nm) AND x.upload_date BETWEEN b.first_seen - 120 AND b.last_seen + 400) AS supported,
  coalesce((SELECT arg_min(full_name, person_id) FROM people WHERE {_MATCH} AND full_name IS NOT NULL), nm) AS shown FROM said)
SELECT * FROM f""")
def scalar_functions(t):
    """name_supported and display_name, called from SQL for the name said at each meeting."""
    spark = t("orders").sparkSession
    sql.register(spark, "names", ["name_supported", "display_name"], **board(t))
    said = F.concat(F.lit("NAME"), (F.col("o_custkey") + F.when(F.col("o_orderkey") % 5 == 0, 0).otherwise(F.col("o_orderkey"))) % 45)
    t("orders").select("o_orderkey", said.alias("nm")).createOrReplaceTempView("names_said")
    return spark.sql("SELECT o_orderkey, nm, name_supported(CAST(o_orderkey AS STRING), nm) AS supported, display_name(nm) AS shown FROM names_said")


_SAID = "that the and for"


@query("D2_bm25_function", f"""WITH {_POST.replace('FROM benchmark', f"FROM (SELECT 1 AS item_id, '{_SAID}' AS text)")},
r AS (SELECT id, round(score, 6) AS score FROM bm) SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM r QUALIFY rank <= 50""")
def bm25_function(t):
    """The ranking as a table function of a text, over staged postings."""
    spark, index = t("documents").sparkSession, S.build_index(t("documents").select("doc_id", "text"), "doc_id", "text")
    sql.register(spark, "index", ["bm25"], postings=index.terms, frequencies=index.df, corpus=index.stats)
    return spark.sql(f"SELECT id, score, rank FROM bm25('{_SAID}', 50)")


@query("D2_passage_speaker_function", f"""WITH {_RESOLVED},
p AS (SELECT conv_id, turn // 4 * 4 AS lo FROM conversations GROUP BY 1, 2)
SELECT conv_id, lo, arg_max(method, (CASE method WHEN 'override' THEN 1 WHEN 'label' THEN 2 WHEN 'self' THEN 3 WHEN 'read_aloud' THEN 3 WHEN 'chair' THEN 5 WHEN 'llm' THEN 6 WHEN 'voice' THEN 7 ELSE 8 END, -idx)) AS name_basis,
  arg_max(method IN ('override', 'label'), (CASE method WHEN 'override' THEN 1 WHEN 'label' THEN 2 WHEN 'self' THEN 3 WHEN 'read_aloud' THEN 3 WHEN 'chair' THEN 5 WHEN 'llm' THEN 6 WHEN 'voice' THEN 7 ELSE 8 END, -idx)) AS name_human
FROM p JOIN rs ON rs.video_id = conv_id AND idx BETWEEN lo AND lo + 3 WHERE name_text IS NOT NULL GROUP BY 1, 2""")
def passage_speaker_function(t):
    """How sure the name of each passage of four lines is, by a lateral call for each passage."""
    spark = t("conversations").sparkSession
    named = resolved(t).select(F.col("video_id").cast("string").alias("video_id"), F.col("idx").cast("long").alias("idx"), F.col("name_text").alias("name"), F.col("method").isin("override", "label").alias("human"), F.col("method").alias("basis"), D.method_rank(F.col("method")).alias("rank"))
    sql.register(spark, "speech", ["passage_speaker"], named_lines=named)
    t("conversations").select("conv_id", (F.floor(F.col("turn") / 4) * 4).cast("long").alias("lo")).distinct().createOrReplaceTempView("speech_passages")
    return spark.sql("SELECT p.conv_id, p.lo, s.name_basis, s.name_human FROM speech_passages p, LATERAL passage_speaker(CAST(p.conv_id AS STRING), p.lo, p.lo + 3) s")
