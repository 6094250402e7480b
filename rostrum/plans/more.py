"""Further operators of the inventory: record keeping, claims, redaction queues, checks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rostrum.functions import text as T
from rostrum.operators import intervals as I
from rostrum.operators import redaction
from rostrum.operators import search as S
from rostrum.plans.registry import query
from rostrum.sources import files


@query("S2_text_without_nul", "SELECT page_id, length(replace(html, chr(1), '')) AS n FROM pages")
def without_nul(t):
    return files.without_nul(t("pages"), "html").select("page_id", F.length("html").cast("long").alias("n"))


@query("S7_pruned_scan", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 48")
def pruned_scan(t):
    return t("lineitem").select("l_orderkey", "l_quantity").filter("l_quantity > 48")


@query("S13_json_rows", "SELECT o_orderkey, '{\"key\":' || o_orderkey || ',\"status\":\"' || o_orderstatus || '\"}' AS json FROM orders")
def json_rows(t):
    return t("orders").select("o_orderkey", F.to_json(F.struct(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"))).alias("json"))


@query("S17_answer_citations", """
SELECT c.conv_id, string_agg(c.conv_id || ':' || c.turn, ';' ORDER BY c.turn) AS cites FROM conversations c GROUP BY 1""")
def answer_citations(t):
    c = t("conversations")
    cites = F.array_sort(F.collect_list(F.struct("turn", "conv_id")))
    return c.groupBy("conv_id").agg(F.array_join(F.transform(cites, lambda x: F.concat_ws(":", x["conv_id"].cast("string"), x["turn"].cast("string"))), ";").alias("cites"))


@query("P2_filters_on_ranked_head", """
SELECT doc_id, place FROM (SELECT doc_id, lang, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS place FROM documents QUALIFY place <= 200) WHERE lang = 'de'""")
def ranked_head(t):
    head = t("documents").select("doc_id", "lang", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(200)
    w = Window.orderBy(F.desc("n_chars"), "doc_id")
    return head.withColumn("place", F.row_number().over(w)).filter("lang = 'de'").select("doc_id", "place")  # over the 200 rows of the head


@query("P6_existence_flags", """
SELECT o_orderkey, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 40) AS large FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)""")
def existence(t):
    g = t("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg((F.max("l_quantity") > 40).alias("large"))
    return t("orders").select("o_orderkey").join(g, "o_orderkey")


@query("P11_membership", "SELECT count(*) AS n FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_brand = 'Brand#4')")
def array_membership(t):
    return t("lineitem").join(t("part").filter("p_brand = 'Brand#4'"), F.col("l_partkey") == F.col("p_partkey"), "left_semi").agg(F.count("*").alias("n"))


@query("P13_canonical_name", """
SELECT c_custkey, coalesce((SELECT max(upper(p_brand)) FROM part WHERE lower(p_brand) = 'brand#' || (c_custkey % 40)), c_name) AS name FROM customer""")
def canonical(t):
    known = t("part").groupBy(F.lower("p_brand").alias("k")).agg(F.max(F.upper("p_brand")).alias("b"))
    own = t("customer").withColumn("k", F.concat(F.lit("brand#"), F.col("c_custkey") % 40))
    return own.join(known, "k", "left").select("c_custkey", F.coalesce("b", "c_name").alias("name"))


@query("P16_procedural_lines", r"""
SELECT conv_id, turn, len(string_split_regex(trim(text), '\s+')) <= 4 AND regexp_matches(lower(text), '^(the|and|of)?[a-z .]*$') AS procedural FROM conversations""")
def procedural(t):
    return t("conversations").select("conv_id", "turn", ((F.size(F.split(F.trim("text"), r"\s+")) <= 4) & F.lower("text").rlike(r"^(the|and|of)?[a-z .]*$")).alias("procedural"))


@query("J9_one_row_statistics", "SELECT doc_id, round(n_chars / a, 6) AS relative FROM documents, (SELECT avg(n_chars) AS a FROM documents)")
def one_row(t):
    d = t("documents").select("doc_id", "n_chars")
    return d.crossJoin(F.broadcast(d.agg(F.avg("n_chars").alias("a")))).select("doc_id", F.round(F.col("n_chars") / F.col("a"), 6).alias("relative"))


@query("J11_token_query_join", r"""
WITH w AS (SELECT DISTINCT conv_id, turn, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM conversations)
SELECT slug, count(*) AS n FROM (SELECT slug, conv_id, turn FROM w JOIN (VALUES ('a', 'the'), ('a', 'of'), ('b', 'la'), ('b', 'de')) q(slug, term) USING (term) GROUP BY 1, 2, 3 HAVING count(*) = 2) GROUP BY 1""")
def token_join(t):
    c = t("conversations").select("conv_id", "turn", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("term"))
    q = c.sparkSession.createDataFrame([("a", "the"), ("a", "of"), ("b", "la"), ("b", "de")], "slug string, term string")
    hit = c.join(F.broadcast(q), "term").groupBy("slug", "conv_id", "turn").agg(F.count("*").alias("k")).filter("k = 2")
    return hit.groupBy("slug").agg(F.count("*").alias("n"))


@query("J16_general_interval_join", """
SELECT o_custkey, count(*) AS n FROM orders JOIN lineitem ON l_suppkey = o_custkey AND l_shipdate BETWEEN o_orderdate AND o_orderdate + INTERVAL 30 DAY GROUP BY 1""")
def interval_join(t):
    o = t("orders").select("o_custkey", "o_orderdate", (F.col("o_orderdate") + F.expr("interval 30 days")).alias("until"))
    j = t("lineitem").select("l_suppkey", "l_shipdate").join(o, (F.col("l_suppkey") == F.col("o_custkey")) & F.col("l_shipdate").between(F.col("o_orderdate"), F.col("until")))
    return j.groupBy("o_custkey").agg(F.count("*").alias("n"))


@query("W7_candidate_ranking", """
SELECT o_orderkey, n_nationkey FROM (SELECT o_orderkey, n_nationkey, row_number() OVER (PARTITION BY o_orderkey ORDER BY n_regionkey = o_custkey % 5 DESC, n_nationkey) AS rn FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey % 5 = c_nationkey % 5) WHERE rn = 1""")
def candidates(t):
    o = t("orders").join(t("customer"), F.col("c_custkey") == F.col("o_custkey")).withColumn("k", F.col("c_nationkey") % 5)
    j = o.join(F.broadcast(t("nation").withColumn("k", F.col("n_nationkey") % 5)), "k")
    return I.top(j, ["o_orderkey"], [(F.col("n_regionkey") == F.col("o_custkey") % 5).desc(), F.asc("n_nationkey")]).select("o_orderkey", "n_nationkey")


@query("K1_top_by_score", "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 50")
def top_by_score(t):
    return t("documents").select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(50)


@query("K7_cursor_fields", """
SELECT 40 AS "offset", least(20, greatest(count(*) - 40, 0)) AS returned, count(*) > 60 AS truncated, CASE WHEN count(*) > 60 THEN 60 END AS next_offset, count(*) AS total FROM documents WHERE lang = 'es'""")
def cursor(t):
    n = F.count("*")
    return t("documents").filter("lang = 'es'").agg(
        F.lit(40).alias("offset"), F.least(F.lit(20), F.greatest(n - 40, F.lit(0))).alias("returned"), (n > 60).alias("truncated"), F.when(n > 60, 60).alias("next_offset"), n.alias("total")
    )


@query("K14_review_queue", "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_suppkey LIMIT 20")
def review_queue(t):
    return t("lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "l_suppkey").limit(20)


@query("T26_implausible_segmentations", """
SELECT conv_id FROM conversations GROUP BY 1 HAVING count(*) FILTER (turn % 3 = 2) < 1 OR count(*) FILTER (turn % 3 = 2) > greatest(1, count(*) // 3)""")
def implausible(t):
    g = t("conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.count_if(F.col("turn") % 3 == 2).alias("k"))
    return g.filter("k < 1 or k > greatest(1, n div 3)").select("conv_id")


@query("T27_day_groups", """
SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderpriority AS kind, count(*) AS n, bool_and(c = 1) AS sure FROM (SELECT *, count(*) OVER (PARTITION BY o_orderdate, o_orderpriority, o_orderstatus) AS c FROM orders) GROUP BY 1, 2""")
def day_groups(t):
    c = t("orders").withColumn("c", F.count("*").over(Window.partitionBy("o_orderdate", "o_orderpriority", "o_orderstatus")))
    return c.groupBy(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.col("o_orderpriority").alias("kind")).agg(F.count("*").alias("n"), F.bool_and(F.col("c") == 1).alias("sure"))


@query("T45_answer_scrub", """
SELECT conv_id, turn, CASE WHEN regexp_matches(substr(text, 5, 24), '[a-z]{3}') THEN replace(text, substr(text, 5, 24), '[redacted]') ELSE text END AS answer FROM conversations WHERE length(text) > 40""")
def scrub(t):
    span = F.substring("text", 5, 24)
    return t("conversations").filter(F.length("text") > 40).select("conv_id", "turn", F.when(span.rlike("[a-z]{3}"), F.replace("text", span, F.lit(redaction.MARKER))).otherwise(F.col("text")).alias("answer"))


@query("F5_arrays", "SELECT doc_id, len(string_split(text, ' ')) AS n, list_contains(string_split(text, ' '), 'the') AS the FROM documents")
def arrays(t):
    return t("documents").select("doc_id", F.size(F.split("text", " ")).cast("long").alias("n"), F.array_contains(F.split("text", " "), "the").alias("the"))


@query("F7_cosine", """
SELECT a.vec_id, round(1 - list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS distance FROM embeddings a, embeddings b WHERE b.vec_id = 0""")
def cosine_distance(t):
    q = t("embeddings").filter("vec_id = 0").select(F.lit(0).alias("qid"), F.col("embedding").alias("q"))
    got = S.dense(t("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), q)
    return got.select(F.col("id").alias("vec_id"), F.round(1 - F.col("score"), 6).alias("distance"))


@query("F11_covering_turn", """
SELECT e.event_id, max(w.lo) AS turn_start FROM events e LEFT JOIN (SELECT DISTINCT user_id, floor(epoch(ts) / 86400)::BIGINT * 86400 AS lo FROM events WHERE event_type = 'click') w ON w.user_id = e.user_id AND epoch(e.ts) BETWEEN w.lo AND w.lo + 86400 GROUP BY 1""")
def covering(t):
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    w = t("events").filter("event_type = 'click'").select("user_id", (F.floor(at / 86400) * 86400).alias("lo")).distinct().withColumn("hi", F.col("lo") + 86400)
    e = t("events").select("event_id", "user_id", at.alias("at"))
    return I.containing(e, w, ["user_id"], "at", "lo", "hi").groupBy("event_id").agg(F.max("lo").alias("turn_start"))


@query("I1_roster_per_recording", """
WITH p AS (SELECT DISTINCT o_custkey AS k, o_orderpriority AS who FROM orders WHERE o_orderstatus = 'P')
SELECT c_custkey AS k, who FROM customer JOIN p ON k = c_custkey UNION SELECT c_custkey, o_orderpriority FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_custkey NOT IN (SELECT k FROM p)""")
def roster(t):
    o = t("orders").select(F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("who"), "o_orderstatus")
    published = o.filter("o_orderstatus = 'P'").select("k", "who").distinct()
    known = t("customer").select(F.col("c_custkey").alias("k"))
    rest = o.join(published.select("k").distinct(), "k", "left_anti").select("k", "who").distinct()
    return published.unionByName(rest).join(known, "k", "left_semi")


@query("I23_split_person_pairs", """
SELECT a.p_name AS a, b.p_name AS b, count(*) AS n FROM (SELECT DISTINCT p_brand, p_name FROM part) a JOIN (SELECT DISTINCT p_brand, p_name FROM part) b ON a.p_brand = b.p_brand AND a.p_name < b.p_name AND levenshtein(a.p_name, b.p_name) <= 4 GROUP BY 1, 2""")
def split_pairs(t):
    p = t("part").select("p_brand", "p_name").distinct()
    q = p.select("p_brand", F.col("p_name").alias("b"))
    j = p.join(q, "p_brand").filter("p_name < b").filter(F.levenshtein("p_name", "b") <= 4)
    return j.groupBy(F.col("p_name").alias("a"), "b").agg(F.count("*").alias("n"))


@query("I25_incremental_refresh", """
SELECT c.conv_id, c.turn FROM conversations c WHERE md5(CASE WHEN c.turn % 3 = 1 THEN upper(c.text) ELSE c.text END) <> md5(c.text)""")
def incremental(t):
    c = t("conversations")
    old = c.select("conv_id", "turn", F.md5(F.col("text").cast("binary")).alias("was"))
    new = c.select("conv_id", "turn", F.md5(F.when(F.col("turn") % 3 == 1, F.upper("text")).otherwise(F.col("text")).cast("binary")).alias("now"))
    return old.join(new, ["conv_id", "turn"]).filter("was <> now").select("conv_id", "turn")


@query("V7_stranded_claims", "SELECT event_id FROM events WHERE event_type = 'signup' AND ts < TIMESTAMP '2024-01-30' - INTERVAL 6 HOUR AND value > 90")
def stranded_claims(t):
    return t("events").filter("event_type = 'signup' and value > 90").filter(F.col("ts") < F.expr("timestamp_ntz '2024-01-30' - interval 6 hours")).select("event_id")


@query("V13_labels_honoured", "SELECT doc_id FROM labels WHERE quality = 0 AND doc_id IN (SELECT doc_id FROM documents WHERE n_chars > 1000)")
def labels_honoured(t):
    return t("labels").filter("quality = 0").join(t("documents").filter("n_chars > 1000"), "doc_id", "left_semi").select("doc_id")


@query("Z3_codes_per_meeting", "SELECT l_orderkey, string_agg(DISTINCT l_partkey::VARCHAR, ',' ORDER BY l_partkey::VARCHAR) AS codes FROM lineitem GROUP BY 1")
def codes(t):
    g = t("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set(F.col("l_partkey").cast("string"))).alias("c"))
    return g.select("l_orderkey", F.array_join("c", ",").alias("codes"))


@query("Z5_runs_lookup", """
WITH r AS (SELECT conv_id, role, min(turn) AS s, max(turn) AS e FROM (SELECT conv_id, role, turn, turn - row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS g FROM conversations) GROUP BY conv_id, role, g)
SELECT c.conv_id, c.turn, r.s, r.e FROM conversations c JOIN r ON r.conv_id = c.conv_id AND c.turn BETWEEN r.s AND r.e AND r.role = c.role""")
def runs_lookup(t):
    c = t("conversations").select("conv_id", "turn", "role")
    runs = I.islands(c, ["conv_id", "role"], "turn").select("conv_id", "role", F.col("start_idx").alias("s"), F.col("end_idx").alias("e"))
    return I.containing(c, runs, ["conv_id", "role"], "turn", "s", "e", "inner").select("conv_id", "turn", "s", "e")


@query("Z7_reference_matrices", "SELECT label, count(*) AS n, round(sum(embedding[1]), 5) AS first FROM embeddings GROUP BY 1")
def reference(t):
    return t("embeddings").groupBy("label").agg(F.count("*").alias("n"), F.round(F.sum(F.get("embedding", F.lit(0)).cast("double")), 5).alias("first"))


@query("Z15_proposals_without_duplicates", """
SELECT DISTINCT conv_id, turn, substr(text, 5, 6) AS span FROM conversations WHERE length(text) > 20 AND (conv_id, substr(text, 5, 6)) NOT IN (SELECT conv_id, substr(text, 5, 6) FROM conversations WHERE turn = 0)""")
def proposals(t):
    c = t("conversations").select("conv_id", "turn", "text", F.substring("text", 5, 6).alias("span"))
    old = c.filter("turn = 0").select("conv_id", "span")
    return c.filter(F.length("text") > 20).join(old, ["conv_id", "span"], "left_anti").select("conv_id", "turn", "span").distinct()


@query("Z16_detector_disagreement", r"""
SELECT doc_id FROM documents WHERE regexp_matches(text, '\+1 \(\d{3}\)') AND doc_id NOT IN (SELECT doc_id FROM labels)""")
def disagreement(t):
    hit = redaction.candidates(t("documents"), "text", [r"\+1 \(\d{3}\)"])
    return hit.select("doc_id").join(t("labels"), "doc_id", "left_anti")


@query("Z21_disagreement_lanes", """
SELECT l_orderkey, l_suppkey FROM (SELECT l_orderkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY l_shipdate DESC, l_linenumber) AS rn FROM lineitem WHERE l_returnflag = 'R') WHERE rn = 1 AND (l_orderkey, l_suppkey) NOT IN (SELECT l_orderkey, l_suppkey FROM lineitem WHERE l_returnflag = 'A')""")
def lanes(t):
    li = t("lineitem").select("l_orderkey", "l_suppkey", "l_returnflag")
    record = li.filter("l_returnflag = 'A'").select("l_orderkey", "l_suppkey")
    return li.filter("l_returnflag = 'R'").select("l_orderkey", "l_suppkey").distinct().join(record, ["l_orderkey", "l_suppkey"], "left_anti")


@query("Z32_redate_undated", """
SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 4 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END, '2000-02-03') AS date FROM orders""")
def redate(t):
    known = F.when(F.col("o_orderkey") % 4 != 0, F.date_format("o_orderdate", "yyyy-MM-dd"))
    return t("orders").select("o_orderkey", F.coalesce(known, T.title_date(F.lit("Meeting 2/3/2000"))).alias("date"))


@query("Z41_target_rank", """
SELECT vec_id AS id, rank FROM (SELECT vec_id, row_number() OVER (ORDER BY round(list_inner_product(embedding::DOUBLE[], (SELECT embedding FROM embeddings WHERE vec_id = 7)::DOUBLE[]), 6) DESC, vec_id) AS rank FROM embeddings QUALIFY rank <= 200) WHERE vec_id IN (7, 11, 13, 17, 19)""")
def target_rank(t):
    q = t("embeddings").filter("vec_id = 7").select(F.lit(0).alias("qid"), F.col("embedding").alias("q"))
    got = S.dense(t("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), q)
    return S.ranked(got.withColumn("score", F.round("score", 6)), 200).filter(F.col("id").isin(7, 11, 13, 17, 19)).select("id", "rank")


@query("X5_state_transitions", """
SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 5 THEN 'failed' WHEN o_orderstatus = 'O' THEN 'claimable' WHEN o_orderstatus = 'P' THEN 'running' ELSE 'done' END AS state FROM orders""")
def transitions(t):
    k, s = F.col("o_orderkey"), F.col("o_orderstatus")
    return t("orders").select("o_orderkey", F.when(k % 6 == 5, "failed").when(s == "O", "claimable").when(s == "P", "running").otherwise("done").alias("state"))
