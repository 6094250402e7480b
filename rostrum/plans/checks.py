"""Checks and parsers over tables with planted violations: no result is empty by construction."""

from __future__ import annotations

from pyspark.sql import functions as F

from rostrum.functions import text as T
from rostrum.operators import checks as C
from rostrum.operators import identity as D
from rostrum.operators import intervals as I
from rostrum.operators import parsers, redaction
from rostrum.operators import records as R
from rostrum.operators import subjects as S
from rostrum.plans.identity import _RESOLVED, claims, resolved
from rostrum.plans.registry import query
from rostrum.plans.subjects import _MEMBERS, members

# The same resolution before the late claims came in.
_EARLIER = _RESOLVED.replace("AS js(j))", "AS js(j) WHERE NOT (j = 1 AND turn % 3 = 0))")


@query("V20_resolution_is_current", f"""
WITH {_RESOLVED}, old AS (SELECT * FROM (WITH {_EARLIER} SELECT video_id, idx, name_text, method FROM rs))
SELECT video_id, idx, CASE WHEN o.method IS NULL THEN 'missing' WHEN n.method IS NULL THEN 'extra' ELSE 'changed' END AS state FROM (SELECT video_id, idx, name_text, method FROM rs) n FULL JOIN old o USING (video_id, idx)
WHERE o.method IS NULL OR n.method IS NULL OR o.method <> n.method OR o.name_text IS DISTINCT FROM n.name_text""")
def resolution_is_current(t):
    """A stored resolution from before the late claims against a fresh one."""
    lines = t("conversations").select(F.col("conv_id").alias("video_id"), F.col("turn").alias("idx"))
    stored = D.resolve(lines, claims(t).filter("not (id % 10 = 1 and start_idx % 3 = 0)"))
    return C.drift(stored, resolved(t), ["video_id", "idx"], ["name_text", "method"])


@query("V11_rollup_is_current", f"""
WITH {_MEMBERS}, st AS (SELECT slug, id FROM mem WHERE id % 50 <> 0 UNION ALL SELECT 'bolts', -p_partkey FROM part WHERE p_partkey % 97 = 0)
SELECT *, 'missing' AS state FROM (SELECT slug, id FROM mem EXCEPT SELECT slug, id FROM st) UNION ALL SELECT *, 'extra' FROM (SELECT slug, id FROM st EXCEPT SELECT slug, id FROM mem)""")
def rollup_is_current(t):
    """A stored roll-up that lacks some members and holds items which are gone."""
    gone = t("part").filter("p_partkey % 97 = 0").select(F.lit("bolts").alias("slug"), (-F.col("p_partkey")).alias("id"))
    stored = members(t).select("slug", "id").filter("id % 50 <> 0").unionByName(gone)
    return C.drift(stored, members(t), ["slug", "id"])


def _live(t, tables):
    """table_name, column_name, type of each column of the tables."""
    rows = [(name, f.name, f.dataType.simpleString()) for name in tables for f in t(name).schema]
    return t(tables[0]).sparkSession.createDataFrame(rows, "table_name string, column_name string, type string")


def _declared(t, rows):
    return t("region").sparkSession.createDataFrame(rows, "table_name string, column_name string, type string")


_COLUMNS = [("nation", "n_nationkey", "int"), ("nation", "n_name", "string"), ("nation", "n_comment", "string"), ("labels", "doc_id", "bigint"), ("labels", "quality", "double"), ("labels", "toxic", "int")]
_DECLARED_SQL = f"d(table_name, column_name, type) AS (VALUES {', '.join(map(str, _COLUMNS))}), l AS (" + " UNION ALL ".join(
    f"SELECT '{n}' AS table_name, column_name, CASE column_type WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' ELSE lower(column_type) END AS type FROM (DESCRIBE {n})" for n in ("nation", "labels")
) + ")"


@query("U8_schema_drift", f"""
WITH {_DECLARED_SQL} SELECT *, 'missing' AS state FROM (SELECT table_name, column_name FROM d EXCEPT SELECT table_name, column_name FROM l) UNION ALL SELECT *, 'extra' FROM (SELECT table_name, column_name FROM l EXCEPT SELECT table_name, column_name FROM d)""")
def schema_drift(t):
    """Columns that tables lack or have beyond their declaration."""
    return C.drift(_live(t, ["nation", "labels"]), _declared(t, _COLUMNS), ["table_name", "column_name"])


@query("V17_schema_matches", f"""
WITH {_DECLARED_SQL} SELECT table_name, column_name, CASE WHEN l.type IS NULL THEN 'missing' WHEN d.type IS NULL THEN 'extra' ELSE 'changed' END AS state FROM l FULL JOIN d USING (table_name, column_name) WHERE l.type IS DISTINCT FROM d.type""")
def schema_matches(t):
    """The same with types; one column is declared with another type."""
    return C.drift(_live(t, ["nation", "labels"]), _declared(t, _COLUMNS), ["table_name", "column_name"], ["type"])


@query("V16_speaker_agrees", """
WITH r AS (SELECT conv_id, role, min(turn) AS start_idx, max(turn) AS end_idx FROM (SELECT conv_id, role, turn, turn - row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS g FROM conversations) GROUP BY conv_id, role, g),
p AS (SELECT conv_id, start_idx, end_idx, CASE (conv_id + start_idx) % 9 WHEN 0 THEN 'nobody' WHEN 1 THEN NULL ELSE role END AS speaker FROM r)
SELECT p.*, (SELECT count(*) FROM conversations c WHERE c.conv_id = p.conv_id AND c.turn BETWEEN p.start_idx AND p.end_idx AND c.role IS DISTINCT FROM p.speaker) AS lines_off FROM p WHERE speaker IS NULL OR speaker = 'nobody'""")
def speaker_agrees(t):
    """Passages that name another speaker than their lines; every ninth is spoilt, and every ninth has lost its name."""
    c = t("conversations").select("conv_id", "turn", "role")
    spoilt = F.when((F.col("conv_id") + F.col("start_idx")) % 9 == 0, "nobody").when((F.col("conv_id") + F.col("start_idx")) % 9 != 1, F.col("role"))
    passages = I.islands(c, ["conv_id", "role"], "turn").select("conv_id", "start_idx", "end_idx", spoilt.alias("speaker"))
    return C.disagreeing(c, passages, ["conv_id"], "turn", "start_idx", "end_idx", "role", "speaker")


_MARK = f"'{redaction.MARKER}'"


def _lines(t):
    return t("conversations").select("conv_id", "turn", "text")


@query("V19_published_is_derived", f"""
WITH c AS (SELECT conv_id, turn, text, CASE WHEN turn % 3 = 0 THEN replace(text, substr(text, 5, 9), {_MARK}) ELSE text END AS due FROM conversations)
SELECT conv_id, turn FROM (SELECT *, CASE (conv_id + turn) % 5 WHEN 0 THEN text WHEN 1 THEN replace(due, 'e', '') ELSE due END AS published FROM c) WHERE published <> due""")
def published_is_derived(t):
    """Published lines that aren't their raw text with the applied spans replaced: stale ones and ones edited by hand."""
    c = _lines(t)
    span = F.substring("text", 5, 9).alias("span")
    spans = c.select("conv_id", "turn", F.lit(1).alias("id"), span, F.when(F.col("turn") % 3 == 0, "applied").otherwise("proposed").alias("status"))
    due = redaction.republished(c, spans.filter("status = 'applied'"), ["conv_id", "turn"], "text", "id", "span").withColumnRenamed("published", "due")
    k = (F.col("conv_id") + F.col("turn")) % 5
    stored = due.withColumn("published", F.when(k == 0, F.col("text")).when(k == 1, F.replace("due", F.lit("e"), F.lit(""))).otherwise(F.col("due")))
    return stored.filter("published <> due").select("conv_id", "turn")


@query("Z17_apply_and_revert", f"""
WITH c AS (SELECT conv_id, turn, text, substr(text, 5, 9) AS a, substr(text, 20, 6) AS b FROM conversations)
SELECT conv_id, turn, replace(replace(text, a, {_MARK}), b, {_MARK}) AS applied, CASE WHEN turn % 2 = 0 THEN replace(text, b, {_MARK}) ELSE replace(replace(text, a, {_MARK}), b, {_MARK}) END AS reverted,
  CASE WHEN turn % 2 = 0 THEN replace(text, b, {_MARK}) ELSE replace(replace(text, a, {_MARK}), b, {_MARK}) END <> replace(replace(text, a, {_MARK}), b, {_MARK}) AS reindex FROM c""")
def apply_and_revert(t):
    """Two spans of each line are applied, one that its raw text lacks isn't, the first of every other line is reverted; lines that change are indexed anew."""
    key = ["conv_id", "turn"]
    c = _lines(t)
    each = F.array(*[F.struct(F.lit(i).alias("id"), s.alias("span")) for i, s in ((1, F.substring("text", 5, 9)), (2, F.substring("text", 20, 6)), (3, F.concat("text", F.lit("#"))))])
    spans = c.select(*key, "text", F.explode(each).alias("s")).select(*key, "text", "s.*").filter((F.length("span") > 0) & F.contains("text", "span")).drop("text")
    applied = redaction.republished(c, spans, key, "text", "id", "span").withColumnRenamed("published", "applied")
    both = redaction.republished(applied, spans.filter("not (id = 1 and turn % 2 = 0)"), key, "text", "id", "span").withColumnRenamed("published", "reverted")
    return both.select(*key, "applied", "reverted", (F.col("applied") != F.col("reverted")).alias("reindex"))


@query("Z19_stranded_redactions", f"""
WITH s AS (SELECT conv_id, turn, substr(text, 5, 12) AS span FROM conversations WHERE turn % 2 = 0 AND length(text) > 20),
p AS (SELECT c.conv_id, c.turn // 3 AS no, string_agg(CASE WHEN span IS NOT NULL AND c.conv_id % 4 <> 0 THEN replace(text, span, {_MARK}) ELSE text END, ' ' ORDER BY c.turn) AS text FROM conversations c LEFT JOIN s ON s.conv_id = c.conv_id AND s.turn = c.turn GROUP BY 1, 2)
SELECT s.conv_id, s.turn, span FROM s JOIN p ON p.conv_id = s.conv_id AND p.no = s.turn // 3 WHERE contains(p.text, span)""")
def stranded_redactions(t):
    """Applied spans that the indexed passages still show; every fourth conversation wasn't indexed again."""
    c = _lines(t)
    spans = c.filter((F.col("turn") % 2 == 0) & (F.length("text") > 20)).select("conv_id", "turn", F.lit(1).alias("id"), F.substring("text", 5, 12).alias("span"))
    lines = redaction.republished(c, spans, ["conv_id", "turn"], "text", "id", "span")
    indexed = F.when(F.col("conv_id") % 4 == 0, F.col("text")).otherwise(F.col("published"))
    no = F.floor(F.col("turn") / 3).alias("no")
    passages = lines.groupBy("conv_id", no).agg(F.array_join(F.array_sort(F.collect_list(F.struct("turn", indexed.alias("x"))))["x"], " ").alias("passage"))
    return redaction.stranded(passages, spans.withColumn("no", no), ["conv_id", "no"], "passage", "span").join(spans.select("conv_id", "turn", no, "span"), ["conv_id", "no", "span"]).select("conv_id", "turn", "span").distinct()


_ROLES = ["Mayor N1", "Dr. n2", "the Clerk", "N3", "Speaker", "Ms. Stranger"]


@query("T56_quote_gate", f"""
WITH c AS (SELECT conv_id, turn, text, [{', '.join(map(repr, _ROLES))}][((conv_id + turn) % 6 + 1)::INT] AS name, CASE turn % 4 WHEN 0 THEN substr(text, 3, 20) WHEN 1 THEN substr(text, 3, 8) WHEN 2 THEN upper(substr(text, 3, 20)) ELSE substr(text, 10, 15) END AS quote, ((conv_id * 3 + turn) % 10) / 10 AS confidence FROM conversations)
SELECT conv_id, turn, CASE name WHEN 'Mayor N1' THEN 'N1' WHEN 'Dr. n2' THEN 'N2' ELSE name END AS name FROM c WHERE name NOT IN ('the Clerk', 'Speaker') AND length(quote) >= 12 AND contains(text, quote) AND confidence >= 0.7""")
def quote_gate(t):
    """Names given to lines by quotes: folded against known people, without vague roles, loose quotes and doubt."""
    v, i = F.col("conv_id"), F.col("turn")
    quote = F.when(i % 4 == 0, F.substring("text", 3, 20)).when(i % 4 == 1, F.substring("text", 3, 8)).when(i % 4 == 2, F.upper(F.substring("text", 3, 20))).otherwise(F.substring("text", 10, 15))
    name = F.element_at(F.array(*map(F.lit, _ROLES)), ((v + i) % 6 + 1).cast("int"))
    given = t("conversations").select("conv_id", "turn", name.alias("name"), quote.alias("quote"), ((v * 3 + i) % 10 / 10).alias("confidence"))
    known = t("region").sparkSession.createDataFrame([(n.lower(), n) for n in ("N1", "N2", "N3", "N4")], "folded string, spelling string")
    return C.quoted_names(given, t("conversations"), F.broadcast(known), ["conv_id", "turn"], "text")


@query("P19_projection_split", "SELECT conv_id, turn, text, CASE WHEN turn < 2 THEN role END AS role FROM conversations")
def projection(t):
    """The head of each conversation has all columns, its continuation the text only."""
    c = t("conversations").select("conv_id", "turn", "role", "text")
    return C.continuation(c, F.col("turn") < 2, ["conv_id", "turn", "text"])


@query("T17_item_disambiguation", """
SELECT p_partkey AS mention_id, p_partkey * 10 + [0, 1, 2, 0][p_partkey % 4 + 1] AS item_id, ['only', 'title', 'section', 'ambiguous'][p_partkey % 4 + 1] AS how FROM part""")
def disambiguation(t):
    """Codes of one item, of three that differ in their titles, in their sections, and in nothing."""
    k = F.col("p_partkey")
    mentions = t("part").select(k.alias("mention_id"), k.alias("k"), F.concat("p_name", F.lit(" a b")).alias("title"), F.lit("s").alias("section"))
    tails = [" b c", " a b", " a c"]
    by_title = F.when(k % 4 == 1, F.element_at(F.array(*map(F.lit, tails)), F.col("seq") + 1))
    titles = F.when(by_title.isNotNull(), F.concat("p_name", by_title)).otherwise(F.concat(F.lit("other "), "p_name"))
    section = F.when((k % 4 == 2) & (F.col("seq") < 2), "x").otherwise("s")
    items = t("part").withColumn("seq", F.explode(F.array(*map(F.lit, range(3))))).filter((k % 4 != 0) | (F.col("seq") == 0))
    items = items.select(k.alias("k"), (k * 10 + F.col("seq")).alias("item_id"), "seq", titles.alias("item_title"), section.alias("item_section"))
    return R.disambiguate(mentions, items, ["k"])


@query("T11_spoken_numbers_read", """
SELECT p_partkey, 'about ' || ((p_partkey % 9 + 1) * 1000 + (p_partkey % 8 + 1) * 100 + (p_partkey % 7 + 2) * 10 + p_partkey % 5 + 1) || '.' || (p_partkey % 10) || ' in ' || (1900 + (p_partkey % 8 + 2) * 10 + p_partkey % 9 + 1) || ' for the 2' || ['1st', '2nd', '3rd', '4th'][p_partkey % 4 + 1] || ' time' AS read FROM part""")
def numbers(t):
    """Numbers said in words, with a decimal, a year and an ordinal, read back."""
    k = F.col("p_partkey")
    pick = lambda words, i: F.element_at(F.array(*map(F.lit, words)), i.cast("int"))
    ones = "one two three four five six seven eight nine".split()
    tens = "ten twenty thirty forty fifty sixty seventy eighty ninety".split()
    said = F.concat_ws(" ", F.lit("about"), pick(ones, k % 9 + 1), F.lit("thousand"), pick(ones, k % 8 + 1), F.lit("hundred and"), pick(tens, k % 7 + 2), pick(ones, k % 5 + 1), F.lit("point"), pick(["zero", *ones], k % 10 + 1),
                       F.lit("in nineteen"), pick(tens, k % 8 + 2), pick(ones, k % 9 + 1), F.lit("for the twenty"), pick(["first", "second", "third", "fourth"], k % 4 + 1), F.lit("time"))
    return parsers.numbers_read(t("part").select("p_partkey", said.alias("said")), "said", "read").select("p_partkey", "read")


@query("T51_sentences", r"""
SELECT c_custkey, no, CASE no WHEN 0 THEN 'Mr. ' || c_name || ' spoke.' ELSE 'Then J. Doe of St. Mary left!' END AS sentence FROM customer, (SELECT unnest(range(0, 3)) AS no) WHERE no <= c_custkey % 3""")
def sentences(t):
    """Sentences of texts with abbreviations and initials."""
    text = F.concat(F.lit("Mr. "), F.col("c_name"), F.lit(" spoke."), F.repeat(F.lit(" Then J. Doe of St. Mary left!"), (F.col("c_custkey") % 3).cast("int")))
    return parsers.sentences(t("customer").select("c_custkey", text.alias("text")), "c_custkey", "text")


@query("V3_spans_tile", """
WITH s AS (SELECT conv_id, min(turn) - CASE WHEN turn // 3 % 4 = 1 AND conv_id % 2 = 0 THEN 1 ELSE 0 END AS start_idx, max(turn) - CASE WHEN (conv_id + turn // 3) % 7 = 3 THEN 1 ELSE 0 END AS end_idx FROM conversations GROUP BY conv_id, turn // 3),
b AS (SELECT *, (SELECT max(x.end_idx) FROM s x WHERE x.conv_id = s.conv_id AND (x.start_idx < s.start_idx OR x.start_idx = s.start_idx AND x.end_idx < s.end_idx)) AS upto FROM s)
SELECT conv_id, start_idx, end_idx, 'unordered' AS issue FROM b WHERE end_idx < start_idx UNION ALL SELECT conv_id, start_idx, end_idx, 'overlap' FROM b WHERE start_idx <= upto UNION ALL SELECT conv_id, start_idx, end_idx, 'hole' FROM b WHERE start_idx > upto + 1""")
def spans_tile(t):
    """Spans of three lines, some begun too early and some ended too early."""
    no = F.floor(F.col("turn") / 3)
    g = t("conversations").groupBy("conv_id", no.alias("no")).agg(F.min("turn").alias("s"), F.max("turn").alias("e"))
    early = F.when((F.col("no") % 4 == 1) & (F.col("conv_id") % 2 == 0), 1).otherwise(0)
    short = F.when((F.col("conv_id") + F.col("no")) % 7 == 3, 1).otherwise(0)
    return C.tiling(g.select("conv_id", (F.col("s") - early).alias("start_idx"), (F.col("e") - short).alias("end_idx")), ["conv_id"], "start_idx", "end_idx")


@query("V18_redaction_gone", f"""
WITH r AS (SELECT conv_id, turn, text AS raw, CASE turn % 5 WHEN 0 THEN 'zz9' || turn WHEN 1 THEN substr(text, 5, 2) ELSE substr(text, 5, 12) END AS span, CASE WHEN (conv_id + turn) % 6 = 0 THEN text || '.' ELSE text END AS before FROM conversations WHERE length(text) > 20),
p AS (SELECT *, CASE WHEN (conv_id + turn) % 4 = 0 THEN raw ELSE replace(raw, span, {_MARK}) END AS published FROM r)
SELECT conv_id, turn, 'gone_from_transcript' AS issue FROM p WHERE contains(published, span) UNION ALL SELECT conv_id, turn, 'unfindable' FROM p WHERE NOT contains(raw, span)
UNION ALL SELECT conv_id, turn, 'span_is_plausible' FROM p WHERE length(span) NOT BETWEEN 3 AND 40 UNION ALL SELECT conv_id, turn, 'raw_preserved' FROM p WHERE before <> raw""")
def redaction_gone(t):
    """Applied redactions of which some were never published, some aren't in their line, some are too short, and some lines changed since."""
    key = ["conv_id", "turn"]
    c = _lines(t).filter("length(text) > 20")
    i, both = F.col("turn"), F.col("conv_id") + F.col("turn")
    span = F.when(i % 5 == 0, F.concat(F.lit("zz9"), i)).when(i % 5 == 1, F.substring("text", 5, 2)).otherwise(F.substring("text", 5, 12))
    spans = c.select(*key, F.lit(1).alias("id"), span.alias("span"), F.when(both % 6 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text")).alias("before"))
    lines = redaction.republished(c, spans.filter(both % 4 != 0), key, "text", "id", "span")
    return C.redaction_issues(spans, lines, key, "text", "published")


@query("Z12_curate_cascade", """
WITH d(slug, decision) AS (VALUES (1, 'dropped'), (2, 'kept'), (3, 'dropped'))
SELECT 'subject' AS kind, r_name AS name, coalesce(decision, 'proposed') AS status FROM region LEFT JOIN d ON slug = r_regionkey
UNION ALL SELECT 'term', n_name, CASE WHEN n_nationkey % 3 = 0 THEN 'live' ELSE coalesce(decision, 'proposed') END FROM nation LEFT JOIN d ON slug = n_regionkey""")
def cascade(t):
    """Decisions on subjects reach their proposed terms and leave live ones alone."""
    decisions = t("region").sparkSession.createDataFrame([(1, "dropped"), (2, "kept"), (3, "dropped")], "slug int, decision string")
    s = t("region").select(F.col("r_regionkey").alias("slug"), "r_name", F.lit("proposed").alias("status"))
    n = t("nation").select(F.col("n_regionkey").alias("slug"), F.col("n_name").alias("phrase"), F.when(F.col("n_nationkey") % 3 == 0, "live").otherwise("proposed").alias("status"))
    s, n = S.curated(s, n, F.broadcast(decisions))
    return s.select(F.lit("subject").alias("kind"), F.col("r_name").alias("name"), "status").unionByName(n.select(F.lit("term").alias("kind"), F.col("phrase").alias("name"), "status"))


@query("Y2_tree_walk", """
WITH RECURSIVE s AS (SELECT 's' || s_suppkey AS id, 'n' || s_nationkey AS parent, s_suppkey % 10 AS items FROM supplier),
n AS (SELECT 'n' || n_nationkey AS id, 'r' || n_regionkey AS parent, coalesce((SELECT sum(items) FROM s WHERE s.parent = 'n' || n_nationkey), 0)::BIGINT AS items FROM nation),
e AS (SELECT * FROM s UNION ALL SELECT * FROM n UNION ALL SELECT 'r' || r_regionkey, NULL, coalesce((SELECT sum(items) FROM n WHERE n.parent = 'r' || r_regionkey), 0)::BIGINT FROM region),
w AS (SELECT id, 0 AS depth, lpad((999999999 - items)::VARCHAR, 9, '0') || ':' || id AS path FROM e WHERE parent IS NULL UNION ALL SELECT e.id, w.depth + 1, w.path || '/' || lpad((999999999 - items)::VARCHAR, 9, '0') || ':' || e.id FROM e JOIN w ON e.parent = w.id)
SELECT id, depth, path FROM w""")
def tree_walk(t):
    """Regions, nations and suppliers as a tree, walked by their sums of items."""
    k = lambda p, c: F.concat(F.lit(p), F.col(c))
    s = t("supplier").select(k("s", "s_suppkey").alias("id"), k("n", "s_nationkey").alias("parent"), (F.col("s_suppkey") % 10).alias("items"))
    summed = lambda df: df.groupBy(F.col("parent").alias("id")).agg(F.sum("items").alias("items"))
    n = t("nation").select(k("n", "n_nationkey").alias("id"), k("r", "n_regionkey").alias("parent")).join(summed(s), "id", "left").fillna(0, ["items"])
    r = t("region").select(k("r", "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent")).join(summed(n), "id", "left").fillna(0, ["items"])
    return S.walk(s.unionByName(n).unionByName(r), 3)


@query("T49_dissenters", """
SELECT c_custkey, unnest(['Lee', 'Wu-Ng ' || c_custkey, 'Mary Anderson'][1:(c_custkey % 4)::INT]) AS name FROM customer WHERE c_custkey % 4 > 0""")
def dissenters(t):
    """Outcome sentences without a dissenter, with one, two and three."""
    k = F.col("c_custkey")
    ng = F.concat(F.lit("Wu-Ng "), k)
    said = F.when(k % 4 == 0, F.lit("Motion carried 5-0")).when(k % 4 == 1, F.lit("Motion carried 4-1, Lee voting nay.")).when(k % 4 == 2, F.concat(F.lit("Approved 3-2 (Lee and "), ng, F.lit(" dissenting)")))
    said = said.otherwise(F.concat(F.lit("Motion failed 2 - 3; Lee, "), ng, F.lit(", and Mary Anderson voting no")))
    return t("customer").select("c_custkey", F.explode(T.dissenters(said)).alias("name"))
