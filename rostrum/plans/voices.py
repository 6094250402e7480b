"""Voices of meetings: an order is a meeting of the board of its priority, and its line items are voices."""

from __future__ import annotations

from pyspark.sql import functions as F

from rostrum.operators import voices as V
from rostrum.plans.registry import query
from rostrum.plans.stores import PEOPLE, board

# Voices have a cluster, names from four producers, and a stored name of an earlier stage.
_VOICES = f"""{PEOPLE},
v AS (SELECT l_orderkey::VARCHAR AS video_id, 'S' || l_linenumber AS label, max(l_partkey) AS p, max(l_suppkey) AS s, count(*) AS votes FROM lineitem GROUP BY 1, 2),
named AS (SELECT video_id, label, p % 60 AS cluster, CASE WHEN p % 4 < 3 THEN 'Name' || p % 60 % 45 END AS name FROM v),
board_names AS (SELECT DISTINCT lower(surname) AS s FROM people WHERE kind = 'board'),
seats AS (SELECT video_id, lower(surname) AS s FROM videos JOIN roster USING (meeting_id) JOIN people USING (person_id)
  UNION SELECT video_id, lower(surname) FROM terms JOIN people USING (person_id) JOIN videos USING (body) WHERE upload_date BETWEEN first_seen - 120 AND last_seen + 400)"""
_OK = "(lower({0}.name) NOT IN (SELECT s FROM board_names) OR EXISTS (SELECT 1 FROM seats WHERE seats.video_id = {0}.video_id AND seats.s = lower({0}.name)))"


def voices(t):
    """video_id, label, p, s, votes."""
    label = F.concat(F.lit("S"), "l_linenumber")
    return t("lineitem").groupBy(F.col("l_orderkey").cast("string").alias("video_id"), label.alias("label")).agg(F.max("l_partkey").alias("p"), F.max("l_suppkey").alias("s"), F.count("*").alias("votes"))


def named(t):
    """video_id, label, cluster, name."""
    p = F.col("p")
    return voices(t).select("video_id", "label", (p % 60).alias("cluster"), F.when(p % 4 < 3, F.concat(F.lit("Name"), p % 60 % 45)).alias("name"))


_CANDIDATES = """c AS (SELECT video_id, label, votes, 'human' AS source, 1 AS place, 'Name' || s % 45 AS name FROM v WHERE p % 17 = 0 UNION ALL SELECT video_id, label, votes, 'anchor', 2, 'Name' || p % 40 FROM v WHERE p % 3 = 0
  UNION ALL SELECT video_id, label, votes, 'commenter', 3, 'Name' || (40 + s % 5) FROM v WHERE p % 5 = 0 UNION ALL SELECT video_id, label, votes, 'cluster', 4, 'Name' || p % 60 % 45 FROM v)"""


@query("I9_precedence_merge", f"""WITH {_VOICES}, {_CANDIDATES},
b AS (SELECT * FROM c WHERE source = 'human' OR {_OK.format('c')} QUALIFY row_number() OVER (PARTITION BY video_id, label ORDER BY place, votes DESC, name) = 1)
SELECT video_id, label, name, source FROM b QUALIFY lower(name) NOT IN (SELECT s FROM board_names) OR row_number() OVER (PARTITION BY video_id, lower(name) ORDER BY place, votes DESC, label) = 1""")
def precedence(t):
    """The name of each voice by the best supported source, one voice for each seat."""
    v, p, s = voices(t), F.col("p"), F.col("s")
    name = lambda n: F.concat(F.lit("Name"), n).alias("name")
    of = lambda source, keep, n: v.filter(keep).select("video_id", "label", "votes", F.lit(source).alias("source"), name(n))
    c = of("human", "p % 17 = 0", s % 45).union(of("anchor", "p % 3 = 0", p % 40)).union(of("commenter", "p % 5 = 0", s % 5 + 40)).union(of("cluster", F.lit(True), p % 60 % 45))
    return V.merged(c, board(t))


@query("I10_ownership_upsert", f"""WITH {_VOICES},
old AS (SELECT video_id, label, cluster, 'Old' || cluster AS name, CASE cluster % 3 WHEN 0 THEN 'chair' WHEN 1 THEN 'llm' END AS source FROM named WHERE cluster % 7 <> 0),
new AS (SELECT video_id, label, cluster + 1 AS cluster, name FROM named WHERE cluster % 5 <> 0), human AS (SELECT video_id, label FROM named WHERE cluster % 11 = 0),
j AS (SELECT coalesce(o.video_id, n.video_id) AS video_id, coalesce(o.label, n.label) AS label, o.video_id IS NOT NULL AS was, n.video_id IS NOT NULL AS now, o.cluster AS oc, n.cluster AS nc, o.name AS oname, n.name AS nname, o.source FROM old o FULL JOIN new n ON o.video_id = n.video_id AND o.label = n.label),
k AS (SELECT *, now AND (NOT was OR source IS NULL OR (video_id, label) IN (SELECT (video_id, label) FROM human)) AS mine FROM j)
SELECT video_id, label, CASE WHEN now THEN nc ELSE oc END AS cluster, CASE WHEN mine THEN nname ELSE oname END AS name, CASE WHEN NOT mine THEN source END AS source FROM k""")
def ownership(t):
    """Stored names after a stage that owns those without a source."""
    n, c = named(t), F.col("cluster")
    old = n.filter("cluster % 7 <> 0").select("video_id", "label", "cluster", F.concat(F.lit("Old"), c).alias("name"), F.when(c % 3 == 0, "chair").when(c % 3 == 1, "llm").alias("source"))
    return V.upserted(old, n.filter("cluster % 5 <> 0").withColumn("cluster", c + 1), n.filter("cluster % 11 = 0"))


@query("I11_retraction", f"""WITH {_VOICES}, gone AS (SELECT video_id, label FROM named WHERE cluster % 6 = 0 AND cluster % 4 <> 0)
SELECT n.video_id, n.label, g.label IS NULL AS kept, CASE WHEN g.label IS NULL THEN cluster END AS cluster FROM named n LEFT JOIN gone g ON g.video_id = n.video_id AND g.label = n.label""")
def retraction(t):
    """Voices that are held out lose their names and clusters, unless people labelled them."""
    n = named(t)
    kept, lines = V.retracted(n, n.select("video_id", F.lit(0).alias("idx"), "label", "cluster"), n.filter("cluster % 6 = 0"), n.filter("cluster % 4 = 0"))
    return lines.join(kept.select("video_id", "label", F.lit(True).alias("k")), ["video_id", "label"], "left").select("video_id", "label", F.col("k").isNotNull().alias("kept"), "cluster")


_PICKS = f"""picks AS (SELECT cluster, name FROM (SELECT cluster, name, count(*) AS n FROM named WHERE name IS NOT NULL GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY n DESC, name) = 1),
shown AS (SELECT h.* FROM (SELECT DISTINCT video_id, cluster, picks.name FROM named JOIN picks USING (cluster)) h WHERE {_OK.format('h')})"""


@query("I18_guarded_majority", f"WITH {_VOICES}, {_PICKS} SELECT * FROM shown")
def guarded_majority(t):
    """The name of a cluster in the recordings that support it."""
    return V.voice_names(named(t), board(t))


@query("V9_terms_respected", f"""WITH {_VOICES}, {_PICKS}, one AS (
SELECT DISTINCT 'terms' AS check_name, n.video_id, n.label, n.name FROM named n JOIN people p ON p.kind = 'board' AND lower(p.surname) = lower(n.name) JOIN videos x ON x.video_id = n.video_id
WHERE NOT EXISTS (SELECT 1 FROM terms b WHERE b.person_id = p.person_id AND x.upload_date BETWEEN b.first_seen - 120 AND b.last_seen + 400) AND cluster % 11 <> 0),
two AS (SELECT DISTINCT 'body', s.video_id, s.cluster::VARCHAR, s.name FROM shown s JOIN people p ON p.kind = 'board' AND lower(p.surname) = lower(s.name) JOIN videos x ON x.video_id = s.video_id WHERE NOT EXISTS (SELECT 1 FROM terms b WHERE b.person_id = p.person_id AND b.body = x.body)),
three AS (SELECT 'supported', n.video_id, n.label, n.name FROM named n WHERE name IS NOT NULL AND cluster % 11 <> 0 AND NOT {_OK.format('n')})
SELECT * FROM one UNION ALL SELECT * FROM two UNION ALL SELECT * FROM three""")
def terms_respected(t):
    """Three checks: members outside of their terms, on boards that they never sat on, and names that nothing supports."""
    n, b = named(t), board(t)
    human = n.filter("cluster % 11 = 0")
    as_rows = lambda name, df, label: df.select(F.lit(name).alias("check_name"), "video_id", F.col(label).cast("string").alias("label"), "name")
    bare = V.supported(n.filter("name is not null and cluster % 11 <> 0"), b).filter("not supported")
    return as_rows("terms", V.out_of_term(n, human, b), "label").union(as_rows("body", V.off_body(n, V.voice_names(n, b), b), "cluster")).union(as_rows("supported", bare, "label"))


@query("I5_chair_by_elimination", f"""WITH {_VOICES},
seat AS (SELECT DISTINCT video_id, 'Name' || cluster AS name FROM named WHERE cluster % 2 = 0), votes AS (SELECT video_id, label, 'Name' || cluster AS name FROM named WHERE cluster % 3 = 0),
gavels AS (SELECT video_id, label, p % 7 AS n FROM v), free AS (SELECT video_id, min(name) AS name FROM seat WHERE (video_id, name) NOT IN (SELECT (video_id, name) FROM votes) GROUP BY 1 HAVING count(*) = 1),
best AS (SELECT * FROM gavels WHERE (video_id, label) NOT IN (SELECT (video_id, label) FROM votes) QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY n DESC, label DESC) = 1)
SELECT video_id, label, name FROM free JOIN best USING (video_id) WHERE n >= 3""")
def chair(t):
    """The one seat without a voice, and the unnamed voice that runs procedure."""
    n = named(t).withColumn("name", F.concat(F.lit("Name"), "cluster"))
    return V.chairs(n.filter("cluster % 3 = 0"), voices(t).select("video_id", "label", (F.col("p") % 7).alias("n")), n.filter("cluster % 2 = 0").select("video_id", "name"))


@query("I17_reader_view", f"""WITH {PEOPLE},
lines AS (SELECT l_orderkey::VARCHAR AS video_id, l_linenumber AS idx, max(l_partkey) AS p FROM lineitem GROUP BY 1, 2),
res AS (SELECT video_id, idx, 'Name' || p % 45 AS said, CASE WHEN p % 3 = 0 THEN p % 200 + 1 END AS person_id, CASE p % 4 WHEN 0 THEN 'override' WHEN 1 THEN 'label' WHEN 2 THEN 'self' ELSE 'cluster' END AS method, p % 13 = 0 AS contested FROM lines WHERE p % 7 > 0),
pending AS (SELECT DISTINCT video_id, 2 AS lo, 4 AS hi FROM lines WHERE video_id::BIGINT % 10 = 0),
shown AS (SELECT lower(surname) AS s, arg_min(full_name, person_id) AS full_name FROM people WHERE kind = 'board' AND full_name IS NOT NULL GROUP BY 1)
SELECT l.video_id, l.idx, CASE WHEN pe.kind = 'board' THEN coalesce(pe.surname, said) ELSE coalesce(pe.full_name, said) END AS name, method AS basis, coalesce(method IN ('override', 'label'), false) AS human,
  coalesce(contested, false) OR EXISTS (SELECT 1 FROM pending p WHERE p.video_id = l.video_id AND l.idx BETWEEN lo AND hi) AS contested, coalesce(pe.full_name, shown.full_name, said) AS display_name
FROM lines l LEFT JOIN res ON res.video_id = l.video_id AND res.idx = l.idx LEFT JOIN people pe USING (person_id) LEFT JOIN shown ON s = lower(said)""")
def reader_view(t):
    """Who is shown to have said each line, on what basis, and whether that is in doubt."""
    lines = t("lineitem").groupBy(F.col("l_orderkey").cast("string").alias("video_id"), F.col("l_linenumber").alias("idx")).agg(F.max("l_partkey").alias("p"))
    p = F.col("p")
    method = F.when(p % 4 == 0, "override").when(p % 4 == 1, "label").when(p % 4 == 2, "self").otherwise("cluster")
    resolved = lines.filter("p % 7 > 0").select("video_id", "idx", F.concat(F.lit("Name"), p % 45).alias("name"), F.when(p % 3 == 0, p % 200 + 1).alias("person_id"), method.alias("method"), (p % 13 == 0).alias("contested"))
    pending = lines.filter(F.col("video_id").cast("long") % 10 == 0).select("video_id", F.lit(2).alias("lo"), F.lit(4).alias("hi")).distinct()
    return V.reader_view(lines, resolved, pending, board(t)["people"])


@query("I12_claims_per_run", f"""WITH {PEOPLE},
seats AS (SELECT video_id, lower(surname) AS s FROM videos JOIN roster USING (meeting_id) JOIN people USING (person_id)
  UNION SELECT video_id, lower(surname) FROM terms JOIN people USING (person_id) JOIN videos USING (body) WHERE upload_date BETWEEN first_seen - 120 AND last_seen + 400),
board_names AS (SELECT DISTINCT lower(surname) AS s FROM people WHERE kind = 'board'),
lines AS (SELECT l_orderkey::VARCHAR AS video_id, l_linenumber AS idx, max(l_partkey) % 3 AS k, (l_orderkey * 3 + max(l_partkey) % 3) % 60 AS cluster FROM lineitem GROUP BY l_orderkey, l_linenumber),
vo AS (SELECT DISTINCT video_id, k, cluster, 'L' || k AS label, video_id::BIGINT + k AS n FROM lines),
ids AS (SELECT video_id, label, cluster, 'Name' || cluster % 45 AS name, CASE n % 3 WHEN 0 THEN 'llm' WHEN 1 THEN 'chair' END AS source FROM vo WHERE n % 4 > 0),
named AS (SELECT video_id, cluster, name FROM ids), {_PICKS},
heard AS (SELECT DISTINCT vo.video_id, vo.label, shown.name, n FROM vo JOIN shown USING (video_id, cluster)),
clu AS (SELECT video_id, label, name FROM heard h WHERE NOT (n % 5 = 0 AND n % 10 / 10.0 < 0.7) AND NOT EXISTS (SELECT 1 FROM ids i WHERE i.video_id = h.video_id AND i.name = h.name AND i.label <> h.label)),
c AS (SELECT video_id, label, 'Lab' || n % 9 AS name, 'label' AS method FROM vo WHERE n % 7 = 0 UNION ALL SELECT video_id, label, name, coalesce(source, 'voice') FROM ids UNION ALL SELECT *, 'cluster' FROM clu),
runs AS (SELECT video_id, 'L' || k AS label, min(idx) AS lo, max(idx) AS hi FROM (SELECT *, idx - row_number() OVER (PARTITION BY video_id, k ORDER BY idx) AS g FROM lines) GROUP BY video_id, k, g)
SELECT video_id, label, lo, hi, name, method FROM c JOIN runs USING (video_id, label) UNION ALL SELECT DISTINCT video_id, NULL, 2, 4, 'Human', 'override' FROM lines WHERE video_id::BIGINT % 9 = 0""")
def claims_per_run(t):
    """What five producers have decided, as claims on runs of lines, with the two vetoes on clusters' names."""
    rows = t("lineitem").groupBy("l_orderkey", "l_linenumber").agg((F.max("l_partkey") % 3).alias("k"))
    o, k = F.col("l_orderkey"), F.col("k")
    lines = rows.select(o.cast("string").alias("video_id"), F.col("l_linenumber").cast("long").alias("idx"), F.concat(F.lit("L"), k).alias("label"), ((o * 3 + k) % 60).alias("cluster"), (o + k).alias("n"))
    n = F.col("n")
    vo = lines.select("video_id", "label", "cluster", "n").distinct()
    ids = vo.filter("n % 4 > 0").select("video_id", "label", "cluster", F.concat(F.lit("Name"), F.col("cluster") % 45).alias("name"), F.when(n % 3 == 0, "llm").when(n % 3 == 1, "chair").alias("source"))
    names = V.voice_names(ids, board(t))
    affinity = vo.filter("n % 5 = 0").join(names, ["video_id", "cluster"]).select("video_id", "label", "name", (n % 10 / 10.0).alias("similarity"))
    labels = vo.filter("n % 7 = 0").select("video_id", "label", F.concat(F.lit("Lab"), n % 9).alias("name"))
    whole = lambda v: F.lit(v).cast("long")
    overrides = lines.filter(F.col("video_id").cast("long") % 9 == 0).select("video_id", whole(2).alias("lo"), whole(4).alias("hi"), F.lit("Human").alias("name")).distinct()
    return V.backfilled(lines, overrides, labels, ids, names, affinity)
