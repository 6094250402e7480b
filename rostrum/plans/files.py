"""File sources and sinks, written from the tables and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from rostrum.operators import intervals as I
from rostrum.plans.registry import query
from rostrum.sources import files, staging


def _path(spark, name):
    return f"{staging.shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _seconds():
    return F.unix_micros(F.col("ts").cast("timestamp")) / 1e6


@query("S8_turns_json", """SELECT user_id::VARCHAR AS video_id, epoch_us(ts) / 1e6 AS start, epoch_us(ts) / 1e6 + event_id % 30 AS "end", event_type AS speaker FROM events""")
def turns_json(t):
    """The turns of each recording as a JSON document, one in four with fields that the reader doesn't know, read by the reader."""
    e = t("events")
    at = _seconds()
    turn = F.struct(at.alias("start"), (at + F.col("event_id") % 30).alias("end"), F.col("event_type").alias("speaker"))
    docs = e.groupBy(F.col("user_id").cast("string").alias("video_id")).agg(F.collect_list(turn).alias("turns"))  # a recording's turns
    path = _path(e.sparkSession, "turns")
    docs.withColumn("model", F.when(F.col("video_id").cast("long") % 4 == 0, "m1")).write.json(path)
    return files.diarization(e.sparkSession, path)


@query("S9_unit_vectors", """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: (x * (vec_id % 5))::FLOAT) AS v FROM embeddings WHERE vec_id % 5 > 0)
SELECT vec_id, round(list_sum(list_transform(v, lambda x: x::DOUBLE * x::DOUBLE)), 2) AS was, 1.0 AS now, round(v[1] / sqrt(list_sum(list_transform(v, lambda x: x::DOUBLE * x::DOUBLE))), 3) + 0 AS first FROM v""")
def unit_vectors(t):
    """Centroids of any length, some of them zero, at length one; zero ones go."""
    scaled = t("embeddings").withColumn("embedding", F.transform("embedding", lambda x: (x * (F.col("vec_id") % 5)).cast("float")))
    square = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    v = files.unit_vectors(scaled.withColumn("was", square("embedding")), "embedding")
    return v.select("vec_id", F.round("was", 2).alias("was"), F.round(square("embedding"), 3).alias("now"), (F.round(F.col("embedding")[0].cast("double"), 3) + 0).alias("first"))


@query("S11_truncate_and_reload", "SELECT doc_id, source FROM documents WHERE lang <> 'en'")
def truncate_and_reload(t):
    """A table is written, then written again whole: what there was is gone."""
    d, spark = t("documents").select("doc_id", "source", "lang"), t("documents").sparkSession
    path = _path(spark, "reloaded")
    for keep in ("lang = 'en'", "lang <> 'en'"):
        d.filter(keep).drop("lang").write.mode("overwrite").parquet(path)
    return files.table(spark, path, ["doc_id", "source"])


@query("S14_backup_and_restore", "SELECT l_orderkey, l_linenumber, l_quantity, l_shipdate, l_returnflag FROM lineitem")
def backup(t):
    """Rows as compressed JSON lines, and restored after they have been counted."""
    rows = t("lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_shipdate", "l_returnflag")
    path = _path(rows.sparkSession, "backup")
    files.write_json_lines(rows, path)
    return files.restore_json_lines(rows.sparkSession, path, rows, rows.count())


@query("S19_silence_points", "SELECT round(value, 4) AS at, count(*) AS n FROM events WHERE event_type <> 'click' GROUP BY 1")
def silence_points(t):
    """The log of a silence detector as text, read by its marker; lines of other kinds, and one without a number, don't count."""
    e = t("events")
    shown = F.format_string("%.4f", F.round("value", 4))
    log = F.when(F.col("event_type") == "click", F.concat(F.lit("[detect] silence_start: "), shown)).otherwise(F.concat(F.lit("  [detect] silence_duration: 1.5 | silence_end:  "), shown, F.lit(" ")))
    path = _path(e.sparkSession, "silences")
    e.select(log.alias("value")).union(e.limit(1).select(F.lit("silence_end: none"))).write.text(path)
    return files.silences(e.sparkSession, path).groupBy("at").agg(F.count("*").alias("n"))


@query("V21_lost_speech", """
WITH sp AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS s, epoch_us(ts) / 1e6 + 600 * (1 + event_id % 9) AS e FROM events),
cuts AS (SELECT user_id, s AS x FROM sp UNION SELECT user_id, e FROM sp), w AS (SELECT user_id, s + 300 AS s, s + 300 + 60 * (1 + event_id % 39) AS e FROM sp WHERE event_id % 3 > 0),
every AS (SELECT user_id, x FROM cuts UNION SELECT user_id, s FROM w UNION SELECT user_id, e FROM w),
pieces AS (SELECT user_id, x AS a, lead(x) OVER (PARTITION BY user_id ORDER BY x) AS b FROM every),
bare AS (SELECT * FROM pieces p WHERE b IS NOT NULL AND EXISTS (SELECT 1 FROM sp WHERE sp.user_id = p.user_id AND sp.s <= p.a AND sp.e >= p.b) AND NOT EXISTS (SELECT 1 FROM w WHERE w.user_id = p.user_id AND w.s <= p.a AND w.e >= p.b)),
runs AS (SELECT user_id, min(a) AS a, max(b) AS b FROM (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY a) AS g FROM (SELECT *, CASE WHEN a = lag(b) OVER (PARTITION BY user_id ORDER BY a) THEN 0 ELSE 1 END AS f FROM bare)) GROUP BY user_id, g)
SELECT user_id, count(*) FILTER (b - a >= 30) AS holes, round(coalesce(sum(b - a) FILTER (b - a >= 30), 0), 2) AS lost, round(100 * coalesce(sum(b - a) FILTER (b - a >= 30), 0) / max(total), 2) AS percent
FROM runs JOIN (SELECT user_id, sum(e - s) AS total FROM sp GROUP BY 1) USING (user_id) GROUP BY 1 HAVING count(*) FILTER (b - a >= 30) > 0""")
def lost_speech(t):
    """Speech of each recording that no words cover, in holes of thirty seconds or more, and its share of all speech."""
    i = F.col("event_id")
    speech = t("events").select("user_id", i, _seconds().alias("s"), (_seconds() + 600 * (i % 9 + 1)).alias("e"))
    words = speech.filter("event_id % 3 > 0").select("user_id", (F.col("s") + 300).alias("_s"), (F.col("s") + 300 + 60 * (1 + i % 39)).alias("e")).withColumnRenamed("_s", "s")
    holes = I.uncovered(speech.select("user_id", "s", "e"), words, ["user_id"], "s", "e", 30.0)
    total = speech.groupBy("user_id").agg(F.sum(F.col("e") - F.col("s")).alias("total"))
    lost = F.sum(F.col("e") - F.col("s"))
    return holes.join(total, "user_id").groupBy("user_id").agg(F.count("*").alias("holes"), F.round(lost, 2).alias("lost"), F.round(100 * lost / F.max("total"), 2).alias("percent"))


HONORIFICS = r"(?i)^(mr|mrs|ms|dr|hon)\.?\s"


@query("V12_ambiguous_surnames", """
WITH bt AS (SELECT DISTINCT o_custkey AS person_id, o_orderpriority AS body FROM orders WHERE o_totalprice > 300000),
p AS (SELECT c_custkey AS person_id, CASE WHEN c_custkey % 20 = 0 THEN CASE c_custkey % 3 WHEN 0 THEN 'Mr. ' WHEN 1 THEN 'dr ' ELSE 'Mrsmith ' END ELSE '' END || c_name AS full_name FROM customer)
SELECT 'surname_unambiguous' AS check_name, person_id, string_agg(body, ' | ' ORDER BY body) AS found FROM bt GROUP BY 2 HAVING count(*) > 1
UNION ALL SELECT 'full_name_is_a_name', person_id, full_name FROM p WHERE regexp_matches(full_name, '(?i)^(mr|mrs|ms|dr|hon)\\.?\\s')""")
def ambiguous(t):
    """Two checks on people: members of more than one board, and full names that carry an honorific."""
    k = F.col("c_custkey")
    bodies = t("orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("person_id"), F.col("o_orderpriority").alias("body")).distinct()
    shared = bodies.groupBy("person_id").agg(F.array_join(F.array_sort(F.collect_list("body")), " | ").alias("found"), F.count("*").alias("n")).filter("n > 1")
    title = F.when(k % 20 == 0, F.when(k % 3 == 0, "Mr. ").when(k % 3 == 1, "dr ").otherwise("Mrsmith ")).otherwise("")
    titled = t("customer").select(k.alias("person_id"), F.concat(title, "c_name").alias("found")).filter(F.col("found").rlike(HONORIFICS))
    return shared.select(F.lit("surname_unambiguous").alias("check_name"), "person_id", "found").unionByName(titled.select(F.lit("full_name_is_a_name").alias("check_name"), "person_id", "found"))
