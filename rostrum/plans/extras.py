"""Record parsing, assignment, answers and display shaping."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from rostrum.operators import identity as D
from rostrum.operators import intervals as I
from rostrum.operators import parsers, places
from rostrum.operators import records as R
from rostrum.operators import search as S
from rostrum.operators import vectors as V
from rostrum.plans.identity import _RESOLVED, resolved
from rostrum.plans.registry import query


@query("T12_agenda_parser", """
SELECT s_nationkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS no, 'C' || (s_suppkey % 100) AS code, CASE WHEN row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) % 2 = 1 THEN 'consent' ELSE 'regular' END AS section, s_name || ' wrapped title' AS title, 'approve' AS recommendation FROM supplier""")
def agenda(t):
    """Agendas written out of suppliers, one for each nation, and parsed again."""
    w = Window.partitionBy("s_nationkey").orderBy("s_suppkey")
    head = F.when(F.row_number().over(w) % 2 == 1, "CONSENT").otherwise("Regular:")
    block = F.concat_ws("\n", head, F.concat(F.lit("C"), F.col("s_suppkey") % 100, F.lit("  "), F.col("s_name")), F.lit("Page 2 of 9"), F.lit(" wrapped   title"), F.lit("Recommendation: approve"))
    files = t("supplier").select("s_nationkey", "s_suppkey", block.alias("b")).groupBy("s_nationkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", "b"))), lambda x: x["b"]), "\n").alias("text"))
    return R.agenda_items(files, "s_nationkey", "text")


@query("T32_sentence_case", "SELECT p_partkey, upper(substr(p_name, 1, 1)) || lower(substr(p_name, 2)) AS title FROM part")
def sentence_case(t):
    return t("part").select("p_partkey", F.concat(F.upper(F.substring("p_name", 1, 1)), F.lower(F.substring("p_name", 2, 2**31 - 1))).alias("title"))


@query("T39_edit_offsets", """
SELECT p_partkey, strpos(p_name, 'ring') - 1 AS start, strpos(p_name, 'ring') + 3 AS "end", 'ring' AS was, 'band' AS now FROM part WHERE contains(p_name, 'ring')""")
def edit_offsets(t):
    at = F.locate("ring", F.col("p_name")).cast("long")
    return t("part").filter(F.contains("p_name", F.lit("ring"))).select("p_partkey", (at - 1).alias("start"), (at + 3).alias("end"), F.lit("ring").alias("was"), F.lit("band").alias("now"))


@query("T52_spoken_form", r"SELECT p_partkey, replace(replace(p_brand, '#', ' number '), 'Brand', 'brand') || ' costs ' || floor(p_retailprice)::BIGINT || ' dollars' AS said FROM part")
def spoken_form(t):
    said = parsers.corrected(F.col("p_brand"), [("#", " number "), ("Brand", "brand")])
    return t("part").select("p_partkey", F.concat(said, F.lit(" costs "), F.floor("p_retailprice"), F.lit(" dollars")).alias("said"))


@query("T55_daily_token", "SELECT event_id, CASE WHEN user_id % 10 <> 0 THEN substr(sha256('key' || user_id || chr(10) || strftime(ts, '%Y-%m-%d')), 1, 32) END AS asker FROM events")
def daily_token(t):
    """A keyed digest that changes each day; null where the caller is blind."""
    body = F.concat(F.lit("key"), F.col("user_id"), F.lit("\n"), F.date_format("ts", "yyyy-MM-dd"))
    return t("events").select("event_id", F.when(F.col("user_id") % 10 != 0, F.substring(F.sha2(body.cast("binary"), 256), 1, 32)).alias("asker"))


@query("T53_word_redline")
def redline(t):
    """Word differences of neighbouring part names by a longest common subsequence; tested against difflib."""
    w = Window.partitionBy("p_brand").orderBy("p_partkey")
    pairs = t("part").select("p_partkey", "p_name", F.lag("p_name").over(w).alias("was")).filter("was is not null")

    @F.pandas_udf("string")
    def diff(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([" ".join(f"{k}:{x}" for k, x in R.word_diff(p.split(), q.split())) for p, q in zip(a, b, strict=True)])

    return pairs.select("p_partkey", diff("was", "p_name").alias("diff"))


@query("I2_average_linkage")
def linkage(t):
    """Voices of each label agglomerated at a cosine distance; tested against the dense version."""
    v = t("embeddings").select(F.col("label").cast("long").alias("k"), F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return V.linked(v, "k", 0.8).withColumnRenamed("id", "vec_id")


@query("I4_one_to_one_assignment")
def assignment(t):
    """Voices and names of each supplier by votes; tested against all permutations."""
    votes = t("lineitem").groupBy("l_suppkey", F.col("l_returnflag").alias("voice"), F.col("l_linenumber").alias("name")).agg(F.count("*").alias("n"))
    return R.assign(votes, "l_suppkey", "voice", "name", "n")


@query("J8_claims_lateral", f"WITH {_RESOLVED} SELECT video_id, count(*) AS lines, count(*) FILTER (contested) AS contested FROM rs GROUP BY 1")
def claims_lateral(t):
    return resolved(t).groupBy("video_id").agg(F.count("*").alias("lines"), F.count_if("contested").alias("contested"))


@query("Z6_resolve_one", f"WITH {_RESOLVED} SELECT idx, name_text FROM rs WHERE video_id = 5")
def resolve_one(t):
    return resolved(t).filter("video_id = 5").select("idx", "name_text")


@query("I15_person_linking", "SELECT s_suppkey, c_custkey FROM supplier JOIN customer ON lower(replace(s_name, 'Supplier', 'Customer')) = lower(c_name)")
def linking(t):
    k = F.lower(F.replace("s_name", F.lit("Supplier"), F.lit("Customer"))).alias("k")
    return t("supplier").select("s_suppkey", k).join(t("customer").select("c_custkey", F.lower("c_name").alias("k")), "k").select("s_suppkey", "c_custkey")


@query("I24_range_validation", "SELECT o.conv_id, o.lo, o.hi FROM (SELECT conv_id, min(turn) AS lo, max(turn) + conv_id % 2 AS hi FROM conversations GROUP BY 1) o WHERE EXISTS (SELECT 1 FROM conversations c WHERE c.conv_id = o.conv_id AND c.turn = o.hi)")
def range_validation(t):
    c = t("conversations")
    o = c.groupBy("conv_id").agg(F.min("turn").alias("lo"), (F.max("turn") + F.first("conv_id") % 2).alias("hi"))
    return o.join(c.select("conv_id", F.col("turn").alias("hi")), ["conv_id", "hi"], "left_semi").select("conv_id", "lo", "hi")


@query("V10_rail_is_people", "SELECT role, count(*) AS n FROM conversations WHERE role NOT IN ('user', 'assistant') GROUP BY 1 ORDER BY n DESC LIMIT 40")
def rail(t):
    return t("conversations").filter(~F.col("role").isin("user", "assistant")).groupBy("role").agg(F.count("*").alias("n")).orderBy(F.desc("n")).limit(40)


@query("V15_overrides_in_range", f"WITH {_RESOLVED} SELECT id, end_idx FROM cl WHERE method = 'override' AND NOT EXISTS (SELECT 1 FROM conversations c WHERE c.conv_id = cl.video_id AND c.turn = cl.end_idx)")
def overrides(t):
    from rostrum.plans.identity import claims

    lines = t("conversations").select(F.col("conv_id").alias("video_id"), F.col("turn").alias("end_idx"))
    return claims(t).filter("method = 'override'").join(lines, ["video_id", "end_idx"], "left_anti").select("id", "end_idx")


@query("Y5_outcome_tally", "SELECT l_returnflag AS outcome, count(*) AS n FROM lineitem GROUP BY 1")
def tally(t):
    return t("lineitem").groupBy(F.col("l_returnflag").alias("outcome")).agg(F.count("*").alias("n"))


@query("Y6_moments", """
SELECT user_id, count(*) AS moments FROM (SELECT user_id, CASE WHEN epoch(ts) - lag(epoch(ts) + value) OVER (PARTITION BY user_id ORDER BY ts) < 1500 THEN 0 ELSE 1 END AS b FROM events) WHERE b = 1 GROUP BY 1""")
def moments(t):
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    w = Window.partitionBy("user_id").orderBy("ts")
    new = F.when(at - F.lag(at + F.col("value")).over(w) < 1500, 0).otherwise(1)
    return t("events").select("user_id", new.alias("b")).filter("b = 1").groupBy("user_id").agg(F.count("*").alias("moments"))


@query("Y8_clip_end", """
SELECT conv_id, max(least(c, 45)) AS "end" FROM (SELECT conv_id, turn, sum(turn * 9 + 5) OVER (PARTITION BY conv_id ORDER BY turn) AS c FROM conversations) WHERE c <= 45 OR turn = 0 GROUP BY 1""")
def clip_end(t):
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = t("conversations").select("conv_id", "turn", F.sum(F.col("turn") * 9 + 5).over(w).alias("c"))
    return c.filter("c <= 45 or turn = 0").groupBy("conv_id").agg(F.max(F.least(F.col("c"), F.lit(45))).alias("end"))


@query("Y9_who_was_heard", "SELECT conv_id, string_agg(role, ' and ' ORDER BY f) AS who FROM (SELECT conv_id, role, min(turn) AS f FROM conversations GROUP BY 1, 2) GROUP BY 1")
def heard(t):
    f = t("conversations").groupBy("conv_id", "role").agg(F.min("turn").alias("f"))
    names = F.transform(F.array_sort(F.collect_list(F.struct("f", "role"))), lambda x: x["role"])
    return f.groupBy("conv_id").agg(F.array_join(names, " and ").alias("who"))


@query("Y10_page_letters", """
SELECT l_orderkey, l_suppkey, CASE WHEN n <= 26 THEN chr((64 + n)::INT) ELSE chr((64 + (n - 1) // 26)::INT) || chr((65 + (n - 1) % 26)::INT) END AS letter FROM (SELECT l_orderkey, l_suppkey, dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey) AS n FROM lineitem) GROUP BY ALL""")
def page_letters(t):
    w = Window.partitionBy("l_orderkey").orderBy("l_suppkey")
    lines = t("lineitem").select("l_orderkey", "l_suppkey")
    again = F.col("l_suppkey").eqNullSafe(F.lag("l_suppkey").over(w)) & (F.row_number().over(w) > 1)
    r = places.dealt(lines, lines.count(), "l_orderkey").select("*", F.dense_rank().over(w).alias("n"), again.alias("again")).filter("not again")
    two = F.concat(F.chr(64 + F.floor((F.col("n") - 1) / 26)), F.chr(65 + (F.col("n") - 1) % 26))
    return r.select("l_orderkey", "l_suppkey", F.when(F.col("n") <= 26, F.chr(64 + F.col("n"))).otherwise(two).alias("letter"))


@query("Y11_line_at", """
SELECT user_id, coalesce(arg_max(event_id, ts) FILTER (ts <= TIMESTAMP '2024-01-03'), -1) AS line FROM events GROUP BY 1""")
def line_at(t):
    seen = F.col("ts") <= F.expr("timestamp_ntz '2024-01-03 00:00:00'")
    return t("events").groupBy("user_id").agg(F.coalesce(F.max_by(F.when(seen, F.col("event_id")), F.when(seen, F.col("ts"))), F.lit(-1)).alias("line"))


@query("Y12_transcript_rows", """
SELECT conv_id, turn, sum(b) OVER (PARTITION BY conv_id ORDER BY turn) AS row_no FROM (SELECT conv_id, turn, CASE WHEN turn // 3 IS DISTINCT FROM lag(turn // 3) OVER w OR role IS DISTINCT FROM lag(role) OVER w THEN 1 ELSE 0 END AS b FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))""")
def transcript_rows(t):
    c = t("conversations").withColumn("item", F.floor(F.col("turn") / 3))
    return I.turns(c, ["conv_id"], "turn", ["item", "role"]).select("conv_id", "turn", F.col("turn_no").alias("row_no"))


@query("Z11_status_guard", "SELECT n_nationkey, CASE WHEN n_regionkey = 0 THEN n_name ELSE upper(n_name) || '!' END AS label FROM nation")
def status_guard(t):
    return t("nation").select("n_nationkey", F.when(F.col("n_regionkey") == 0, F.col("n_name")).otherwise(F.concat(F.upper("n_name"), F.lit("!"))).alias("label"))


@query("Z14_character_budget", """
SELECT conv_id, turn, (sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) - length(text)) // 2000 AS chunk FROM conversations""")
def budget(t):
    w = Window.partitionBy("conv_id").orderBy("turn")
    n = F.length("text").cast("long")
    return t("conversations").select("conv_id", "turn", F.floor((F.sum(n).over(w) - n) / 2000).alias("chunk"))


@query("Z18_queue_page", "SELECT conv_id, turn, strpos(text, 'th') AS at FROM conversations WHERE turn > 0 ORDER BY conv_id, turn LIMIT 30 OFFSET 30")
def queue_page(t):
    rows = t("conversations").filter("turn > 0").select("conv_id", "turn", F.locate("th", F.col("text")).cast("long").alias("at"))
    return S.page(rows, [F.asc("conv_id"), F.asc("turn")], 30, 30)


@query("Z33_word_chunks", r"SELECT doc_id, unnest(range(0, greatest(len(string_split_regex(trim(text), '\s+')) // 200 + 1, 1))) AS chunk FROM documents")
def word_chunks(t):
    n = F.size(F.split(F.trim("text"), r"\s+"))
    return t("documents").select("doc_id", F.explode(F.sequence(F.lit(0), F.floor(n / 200))).alias("chunk"))


@query("Z30_evidence_pack", """
SELECT c.conv_id, c.role, count(*) AS lines, max(CASE WHEN l.quality = 1 THEN 1 ELSE 0 END) AS labelled FROM conversations c LEFT JOIN labels l ON l.doc_id = c.conv_id GROUP BY 1, 2""")
def evidence_pack(t):
    j = t("conversations").join(t("labels").select(F.col("doc_id").alias("conv_id"), "quality"), "conv_id", "left")
    return j.groupBy("conv_id", "role").agg(F.count("*").alias("lines"), F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("labelled"))


@query("Z44_ordinary_words", "SELECT DISTINCT split_part(p_name, ' ', 2) AS word FROM part WHERE rtrim(split_part(p_name, ' ', 2), 's') IN ('ring', 'bolt', 'widget')")
def ordinary(t):
    word = F.get(F.split("p_name", " "), F.lit(1))
    return t("part").select(word.alias("word")).distinct().filter(F.regexp_replace("word", "s+$", "").isin("ring", "bolt", "widget"))


@query("Z40_sentence_citations", r"SELECT conv_id, turn, regexp_extract_all('A [' || turn || '] b [' || (turn + 1) || '].', '\[(\d+)\]', 1)[2]::BIGINT AS last FROM conversations")
def sentence_citations(t):
    s = F.concat(F.lit("A ["), F.col("turn"), F.lit("] b ["), F.col("turn") + 1, F.lit("]."))
    return t("conversations").select("conv_id", "turn", F.element_at(F.regexp_extract_all(s, F.lit(r"\[(\d+)\]"), F.lit(1)), 2).cast("long").alias("last"))


@query("X6_back_pressure", "SELECT count(*) >= 100 AS stop FROM orders WHERE o_orderstatus = 'P'")
def back_pressure(t):
    return t("orders").filter("o_orderstatus = 'P'").agg((F.count("*") >= 100).alias("stop"))


@query("I7_anchor_growth")
def anchor_growth(t):
    """Names spread from seed voices (the first of each label) to voices that resemble them; tested on planted voices."""
    v = t("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")
    seeds = v.groupBy("label").agg(F.min("id").alias("id")).select("id", F.concat(F.lit("P"), "label").alias("name"))
    return D.grow_anchors(v.select("id", "v"), seeds, assign=0.3, promote=0.5)


@query("T35_letters_in_a_run", r"""
WITH m AS (SELECT conv_id, turn, regexp_matches(text, '(?i) the | der | la ') AS mark FROM conversations)
SELECT conv_id, letter, min(turn) AS start_idx, max(turn) AS end_idx FROM (SELECT conv_id, turn, sum(CASE WHEN mark THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS letter FROM m) WHERE letter > 0 GROUP BY 1, 2""")
def letters_in_run(t):
    mark = F.col("text").rlike(r"(?i) the | der | la ").cast("int")
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = t("conversations").select("conv_id", "turn", F.sum(mark).over(w).alias("letter")).filter("letter > 0")
    return c.groupBy("conv_id", "letter").agg(F.min("turn").alias("start_idx"), F.max("turn").alias("end_idx"))


@query("Y7_reference_numbers", """
SELECT l_orderkey, l_partkey, dense_rank() OVER (PARTITION BY l_orderkey ORDER BY f, l_partkey) AS no FROM (SELECT l_orderkey, l_partkey, min(l_linenumber) AS f FROM lineitem GROUP BY 1, 2)""")
def reference_numbers(t):
    f = t("lineitem").groupBy("l_orderkey", "l_partkey").agg(F.min("l_linenumber").alias("f"))
    return f.select("l_orderkey", "l_partkey", F.dense_rank().over(Window.partitionBy("l_orderkey").orderBy("f", "l_partkey")).alias("no"))


@query("Y4_spine_groups", """
SELECT l_orderkey, g, min(l_linenumber) AS first, count(*) AS n FROM (SELECT *, sum(b) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, l_extendedprice) AS g FROM (
  SELECT *, CASE WHEN l_returnflag IS DISTINCT FROM lag(l_returnflag) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, l_extendedprice) THEN 1 ELSE 0 END AS b FROM lineitem)) GROUP BY 1, 2""")
def spine_groups(t):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    new = (~F.col("l_returnflag").eqNullSafe(F.lag("l_returnflag").over(w)) | (F.row_number().over(w) == 1)).cast("long")
    rows = t("lineitem").withColumn("b", new).withColumn("g", F.sum("b").over(w))
    return rows.groupBy("l_orderkey", "g").agg(F.min("l_linenumber").alias("first"), F.count("*").alias("n"))


@query("Z4_reground_titles", """
SELECT p_partkey FROM part WHERE trim(replace(p_name, 'red', '')) IS DISTINCT FROM p_name""")
def reground(t):
    return t("part").filter(~F.trim(F.replace("p_name", F.lit("red"), F.lit(""))).eqNullSafe(F.col("p_name"))).select("p_partkey")


@query("Z9_relabel_group", """
SELECT vec_id, CASE WHEN label = 3 THEN 'renamed' ELSE 'L' || label END AS name FROM embeddings WHERE label <> 4""")
def relabel(t):
    e = t("embeddings").select("vec_id", "label")
    moved = e.filter("label = 3").select("vec_id", F.lit("renamed").alias("name"))
    rest = e.join(moved.select("vec_id"), "vec_id", "left_anti").filter("label <> 4")
    return rest.select("vec_id", F.concat(F.lit("L"), "label").alias("name")).unionByName(moved)


@query("Z34_change_classes", r"""
SELECT kind, count(*) AS n FROM (SELECT CASE WHEN lower(was) = lower(now) THEN 'cosmetic' WHEN regexp_replace(was, '\d+', '#', 'g') = regexp_replace(now, '\d+', '#', 'g') THEN 'number' ELSE 'changed' END AS kind
  FROM (SELECT c_name AS was, CASE WHEN c_custkey % 3 = 0 THEN upper(c_name) WHEN c_custkey % 3 = 1 THEN 'Customer#' || c_custkey ELSE 'Client' END AS now FROM customer)) GROUP BY 1""")
def change_classes(t):
    k = F.col("c_custkey") % 3
    now = F.when(k == 0, F.upper("c_name")).when(k == 1, F.concat(F.lit("Customer#"), "c_custkey")).otherwise("Client")
    plain = lambda c: F.regexp_replace(c, r"\d+", "#")
    c = t("customer").select(F.col("c_name").alias("was"), now.alias("now"))
    kind = F.when(F.lower("was") == F.lower("now"), "cosmetic").when(plain("was") == plain("now"), "number").otherwise("changed")
    return c.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@query("Z35_clip_sample", """
SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR)) AS rn FROM documents WHERE contains(text, 'the') AND doc_id NOT IN (SELECT doc_id FROM labels)) WHERE rn <= 3""")
def clip_sample(t):
    d = t("documents").filter(F.contains("text", F.lit("the"))).select("source", "doc_id").join(t("labels").select("doc_id"), "doc_id", "left_anti")
    return I.top(d, ["source"], [F.md5(F.col("doc_id").cast("string").cast("binary"))], 3).select("source", "doc_id")


@query("Z36_fact_recovery", r"""
SELECT doc_id, len(list_distinct(regexp_extract_all(text, '\d+'))) AS facts, len(list_filter(list_distinct(regexp_extract_all(text, '\d+')), lambda x: contains(replace(text, '-', ''), x))) AS found FROM documents""")
def fact_recovery(t):
    facts = F.array_distinct(F.regexp_extract_all("text", F.lit(r"(\d+)"), F.lit(1)))
    d = t("documents").select("doc_id", facts.alias("f"), F.replace("text", F.lit("-"), F.lit("")).alias("r"))
    return d.select("doc_id", F.size("f").cast("long").alias("facts"), F.size(F.filter("f", lambda x: F.contains(F.col("r"), x))).cast("long").alias("found"))
