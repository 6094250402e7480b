"""Read models: digests, cases, appearances, outlines, queues."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rostrum.functions import text as T
from rostrum.operators import intervals as I
from rostrum.operators import passages as P
from rostrum.plans.registry import query


@query("A10_ordered_json", """
SELECT l_orderkey, to_json(list({'no': l_linenumber, 'part': l_partkey} ORDER BY l_linenumber, l_partkey)) AS items FROM lineitem GROUP BY 1""")
def ordered_json(t):
    item = F.struct(F.col("l_linenumber").alias("no"), F.col("l_partkey").alias("part"))
    return t("lineitem").groupBy("l_orderkey").agg(F.to_json(F.array_sort(F.collect_list(item))).alias("items"))


@query("A19_meeting_digest", """
SELECT l_orderkey, count(*) AS items, count(*) FILTER (l_returnflag = 'A') AS passed, count(*) FILTER (l_returnflag = 'R') AS refused, count(*) FILTER (l_returnflag = 'N' AND l_linestatus = 'O') AS continued, sum(l_quantity) AS seconds FROM lineitem GROUP BY 1""")
def digest(t):
    f = F.col("l_returnflag")
    return t("lineitem").groupBy("l_orderkey").agg(F.count("*").alias("items"), F.count_if(f == "A").alias("passed"), F.count_if(f == "R").alias("refused"), F.count_if((f == "N") & (F.col("l_linestatus") == "O")).alias("continued"), F.sum("l_quantity").alias("seconds"))


@query("A20_continued_cases", """
SELECT l_partkey, count(*) FILTER (l_returnflag = 'N') AS continuances, count(*) AS appearances, min(l_shipdate) AS first, max(l_shipdate) AS last FROM lineitem GROUP BY 1 HAVING count(*) FILTER (l_returnflag = 'N') >= 3""")
def continued_cases(t):
    g = t("lineitem").groupBy("l_partkey").agg(F.count_if(F.col("l_returnflag") == "N").alias("continuances"), F.count("*").alias("appearances"), F.min("l_shipdate").alias("first"), F.max("l_shipdate").alias("last"))
    return g.filter("continuances >= 3")


@query("A24_speaker_census", "SELECT conv_id, role, count(*) AS n FROM conversations GROUP BY 1, 2")
def census(t):
    return t("conversations").groupBy("conv_id", "role").agg(F.count("*").alias("n"))


@query("A25_case_read_model", """
SELECT l_partkey, count(*) AS appearances, count(*) FILTER (l_returnflag = 'N') AS continuances, arg_max(l_returnflag, (l_shipdate, l_orderkey, l_linenumber)) FILTER (l_returnflag <> 'N') AS terminal FROM lineitem GROUP BY 1""")
def case_model(t):
    done = F.col("l_returnflag") != "N"
    last = F.max_by(F.when(done, F.col("l_returnflag")), F.when(done, F.struct("l_shipdate", "l_orderkey", "l_linenumber")))
    return t("lineitem").groupBy("l_partkey").agg(F.count("*").alias("appearances"), F.count_if(~done).alias("continuances"), last.alias("terminal"))


@query("A27_name_diff", """
SELECT coalesce(a.k, b.k) AS k, coalesce(a.n, 0) AS was, coalesce(b.n, 0) AS now FROM (SELECT l_suppkey AS k, count(*) AS n FROM lineitem WHERE l_linenumber < 4 GROUP BY 1) a FULL JOIN (SELECT l_suppkey AS k, count(*) AS n FROM lineitem WHERE l_linenumber > 2 GROUP BY 1) b ON a.k = b.k""")
def name_diff(t):
    c = lambda keep, n: t("lineitem").filter(keep).groupBy(F.col("l_suppkey").alias("k")).agg(F.count("*").alias(n))
    return c("l_linenumber < 4", "was").join(c("l_linenumber > 2", "now"), "k", "full").select("k", F.coalesce("was", F.lit(0)).alias("was"), F.coalesce("now", F.lit(0)).alias("now"))


@query("A31_corroborated", r"""
WITH w AS (SELECT DISTINCT conv_id, turn, unnest(regexp_extract_all(text, '[A-Z][a-z]{4,}')) AS name FROM conversations)
SELECT conv_id, name, count(*) AS lines FROM w GROUP BY 1, 2 HAVING count(*) > 1""")
def corroborated(t):
    names = F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"([A-Z][a-z]{4,})"), F.lit(1))))
    return t("conversations").select("conv_id", names.alias("name")).groupBy("conv_id", "name").agg(F.count("*").alias("lines")).filter("lines > 1")


@query("A34_facts_row", """
SELECT (SELECT count(*) FROM orders) AS orders, (SELECT count(*) FROM customer) AS people, (SELECT count(DISTINCT l_partkey) FROM lineitem) AS cases, (SELECT round(sum(o_totalprice), 0) FROM orders) AS total""")
def facts(t):
    row = t("orders").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 0).alias("total"))
    return row.crossJoin(t("customer").agg(F.count("*").alias("people"))).crossJoin(t("lineitem").agg(F.countDistinct("l_partkey").alias("cases")))  # one row each


@query("J14_support_guard", """
SELECT c_custkey, (c_mktsegment <> 'BUILDING' OR c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') OR EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = c_nationkey AND s_acctbal > 9000)) AS supported FROM customer""")
def support_guard(t):
    roster = t("orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("r", F.lit(True))
    term = t("supplier").filter("s_acctbal > 9000").select(F.col("s_nationkey").alias("c_nationkey")).distinct().withColumn("s", F.lit(True))
    j = t("customer").join(roster, "c_custkey", "left").join(term, "c_nationkey", "left")
    return j.select("c_custkey", ((F.col("c_mktsegment") != "BUILDING") | F.col("r").isNotNull() | F.col("s").isNotNull()).alias("supported"))


@query("J18_line_to_passage", """
WITH p AS (SELECT conv_id, turn AS s, turn + 3 AS e, conv_id * 100 + turn AS pid FROM conversations WHERE turn % 3 = 0)
SELECT c.conv_id, c.turn, min(pid) AS pid FROM conversations c LEFT JOIN p ON p.conv_id = c.conv_id AND c.turn BETWEEN s AND e GROUP BY 1, 2""")
def line_to_passage(t):
    p = t("conversations").filter("turn % 3 = 0").select("conv_id", F.col("turn").alias("s"), (F.col("turn") + 3).alias("e"), (F.col("conv_id") * 100 + F.col("turn")).alias("pid"))
    held = I.containing(t("conversations").select("conv_id", "turn"), p, ["conv_id"], "turn", "s", "e")
    return held.groupBy("conv_id", "turn").agg(F.min("pid").alias("pid"))


@query("J19_json_containment", """
SELECT event_id FROM events WHERE (props->>'k')::BIGINT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)""")
def json_containment(t):
    keys = t("nation").filter("n_regionkey = 1").select(F.col("n_nationkey").cast("long").alias("k"))
    return t("events").withColumn("k", F.from_json("props", "k bigint")["k"]).join(F.broadcast(keys), "k", "left_semi").select("event_id")


@query("W4_count_beside_distinct", """
SELECT o_custkey, o_orderkey, n FROM (SELECT o_custkey, o_orderkey, count(*) OVER (PARTITION BY o_custkey) AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rn FROM orders) WHERE rn = 1""")
def count_beside(t):
    rows = t("orders").withColumn("n", F.count("*").over(Window.partitionBy("o_custkey")))
    return I.top(rows, ["o_custkey"], [F.desc("o_orderdate"), F.asc("o_orderkey")]).select("o_custkey", "o_orderkey", "n")


@query("W5_distinct_on", """
SELECT DISTINCT ON (l_partkey) l_partkey, l_orderkey FROM lineitem ORDER BY l_partkey, l_shipdate DESC, l_orderkey, l_linenumber""")
def distinct_on(t):
    rows = t("lineitem").select("l_partkey", "l_orderkey", "l_shipdate", "l_linenumber")
    return I.top(rows, ["l_partkey"], [F.desc("l_shipdate"), F.asc("l_orderkey"), F.asc("l_linenumber")]).select("l_partkey", "l_orderkey")


@query("W13_interval_merge", """
WITH e AS (SELECT l_suppkey AS k, epoch(l_shipdate)::BIGINT // 86400 AS s, epoch(l_shipdate)::BIGINT // 86400 + l_linenumber AS f FROM lineitem),
m AS (SELECT *, max(f) OVER (PARTITION BY k ORDER BY s, f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM e),
r AS (SELECT *, sum(CASE WHEN s - b <= 0 THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY s, f ROWS UNBOUNDED PRECEDING) AS g FROM m)
SELECT k, min(s) AS s, max(f) AS f, count(*) AS n FROM r GROUP BY k, g""")
def interval_merge(t):
    day = F.floor(F.unix_timestamp(F.col("l_shipdate").cast("timestamp")) / 86400).cast("long")
    e = t("lineitem").select(F.col("l_suppkey").alias("k"), day.alias("s"), (day + F.col("l_linenumber")).alias("f"))
    return I.merged(e, ["k"], "s", "f", 0)


_SPANS = """rows AS (SELECT user_id AS k, event_id, event_type AS who, epoch_us(ts) / 1e6 / 3600 AS s, epoch_us(ts) / 1e6 / 3600 + 0.5 AS e FROM events),
nos AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY s, e, who, event_id) AS i FROM rows)"""


@query("W14_utterance_groups", f"""
WITH RECURSIVE {_SPANS},
run(k, event_id, i, no, opened, who, e) AS (
  SELECT k, event_id, i, 0, s, who, e FROM nos WHERE i = 1
  UNION ALL
  SELECT k, event_id, i, CASE WHEN fresh THEN no + 1 ELSE no END, CASE WHEN fresh THEN s ELSE opened END, who, e FROM (
    SELECT nos.*, run.no, run.opened, nos.who <> run.who OR nos.s - run.e >= 2.0 OR run.e - run.opened >= 30.0 AS fresh FROM run JOIN nos ON nos.k = run.k AND nos.i = run.i + 1))
SELECT k AS user_id, event_id, no::BIGINT AS group_no FROM run""")
def utterance_groups(t):
    """Events of a user as utterances, in hours: groups end at another type, a gap or after the cap."""
    e = t("events").select("user_id", "event_type", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 / 3600).alias("s"))
    e = e.withColumn("e", F.col("s") + 0.5)
    return P.group_utterances(e.select("user_id", "event_id", "event_type", "s", "e"), "user_id", "s", "e", "event_type").select("user_id", "event_id", "group_no")


@query("F12_silence_windows", f"""
WITH RECURSIVE turns AS (SELECT user_id AS k, event_id, epoch_us(ts) / 1e6 / 600 AS s, epoch_us(ts) / 1e6 / 600 + event_id % 60 AS e, epoch_us(ts) / 1e6 / 600 + event_id % 7 AS z FROM events),
ends AS (SELECT k, max(e) AS duration FROM turns GROUP BY 1),
fresh AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY k ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 0.4 THEN 0 ELSE 1 END AS f FROM turns),
stretch AS (SELECT k, greatest(min(s) - 0.25, 0) AS a, least(max(e) + 0.25, max(duration)) AS b FROM (SELECT *, sum(f) OVER (PARTITION BY k ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM fresh) JOIN ends USING (k) GROUP BY k, g),
quiet AS (SELECT k, a, b, list_sort(list(z)) AS q FROM stretch JOIN turns USING (k) WHERE z BETWEEN a AND b GROUP BY 1, 2, 3),
run(k, a, b, q, start, cut) AS (
  SELECT stretch.k, stretch.a, stretch.b, coalesce(q, []), NULL::DOUBLE, stretch.a FROM stretch LEFT JOIN quiet USING (k, a, b)
  UNION ALL
  SELECT k, a, b, q, cut, CASE WHEN len(near) > 0 THEN near[len(near) // 2 + 1] ELSE cut + 24.0 END
  FROM (SELECT *, list_filter(q, lambda x: x >= cut + 12.0 AND x <= cut + 24.0) AS near FROM run WHERE b - cut > 24.0)),
rests AS (SELECT k, a, b, max(cut) AS start FROM run GROUP BY 1, 2, 3)
SELECT k AS user_id, round(start, 4) AS start, round(cut, 4) AS "end" FROM run WHERE start IS NOT NULL UNION ALL SELECT k, round(start, 4), round(b, 4) FROM rests WHERE b - start > 0.2""")
def silence_windows(t):
    """Stretches of a user's events, in units of ten minutes, cut at the middle one of the moments that could be silences."""
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 / 600
    turns = t("events").select("user_id", "event_id", at.alias("s"), (at + F.col("event_id") % 60).alias("e"), (at + F.col("event_id") % 7).alias("at"))
    speech = I.merged(turns, ["user_id"], "s", "e", 0.4).select("user_id", F.col("s").alias("start"), F.col("e").alias("end"))
    ends = turns.groupBy("user_id").agg(F.max("e").alias("duration"))
    found = P.windows(speech.join(ends, "user_id"), turns, "user_id")
    return found.select("user_id", F.round("start", 4).alias("start"), F.round("end", 4).alias("end"))


#: Passages of the lines {} (conv_id, turn, role, text).
PASSAGES = r"""
WITH RECURSIVE l AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, coalesce(role, 'Unidentified') AS who, coalesce(text, '') AS body, len(regexp_extract_all(coalesce(text, ''), '\S+')) AS n FROM {}),
run(conv_id, i, no, opens, who, short, words) AS (
  SELECT conv_id, i, 0, i, who, n < 12, n FROM l WHERE i = 1
  UNION ALL
  SELECT conv_id, i, CASE WHEN fresh THEN no + 1 ELSE no END, CASE WHEN fresh THEN i ELSE opens END, CASE WHEN fresh THEN own ELSE who END, CASE WHEN fresh THEN n < 12 ELSE short END, CASE WHEN fresh THEN n ELSE words + n END
  FROM (SELECT run.conv_id, l.i, l.n, l.who AS own, run.no, run.opens, run.who, run.short, run.words, run.words >= 140 OR CASE WHEN run.short THEN l.n >= 12 ELSE l.who <> run.who END AS fresh FROM run JOIN l ON l.conv_id = run.conv_id AND l.i = run.i + 1)),
p AS (SELECT run.conv_id, run.no, run.i, run.opens, l.turn, l.who, l.body, run.short, lag(l.who) OVER (PARTITION BY run.conv_id, run.no ORDER BY run.i) AS was, max(run.words) OVER (PARTITION BY run.conv_id, run.no) AS total FROM run JOIN l ON l.conv_id = run.conv_id AND l.i = run.i),
g AS (SELECT conv_id, min(turn) AS start_idx, max(turn) AS end_idx, bool_or(short) OR max(total) < 35 AS exchange, arg_min(who, i) AS who, string_agg(body, ' ' ORDER BY i) AS plain, string_agg(CASE WHEN was = who THEN body ELSE who || ': ' || body END, ' ' ORDER BY i) AS named FROM p GROUP BY conv_id, no)
SELECT conv_id, start_idx, end_idx, CASE WHEN exchange THEN '(exchange)' ELSE who END AS speaker, CASE WHEN exchange THEN named ELSE plain END AS text FROM g WHERE len(regexp_extract_all(CASE WHEN exchange THEN named ELSE plain END, '\S+')) >= 12"""


@query("W15_passages", PASSAGES.format("conversations"))
def passages(t):
    """Passages of conversations with the running word caps."""
    return P.build(t("conversations"), "conv_id", "turn", "role", "text")


@query("W18_age_of_claims", """
SELECT o_orderkey, date_diff('day', o_orderdate::DATE, DATE '2002-01-01') AS days FROM orders WHERE o_orderstatus = 'P' AND o_orderdate < DATE '2002-01-01' - INTERVAL 700 DAY""")
def ages(t):
    days = F.date_diff(F.lit("2002-01-01").cast("date"), F.to_date("o_orderdate"))
    return t("orders").filter("o_orderstatus = 'P'").select("o_orderkey", days.cast("long").alias("days")).filter("days > 700")


@query("Z1_passage_floor", r"""
SELECT conv_id, turn FROM conversations WHERE len(string_split_regex(trim(text), '\s+')) - length(role) // 4 >= 60""")
def passage_floor(t):
    return t("conversations").filter(F.size(F.split(F.trim("text"), r"\s+")) - F.floor(F.length("role") / 4) >= 60).select("conv_id", "turn")


@query("Z10_evidence_lines", r"""
SELECT conv_id, turn, regexp_matches(text, '(?i)\bthis is\b|\bthat the\b') AS self, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS previous FROM conversations""")
def evidence(t):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return t("conversations").select("conv_id", "turn", F.col("text").rlike(r"(?i)\bthis is\b|\bthat the\b").alias("self"), F.lag("turn").over(w).alias("previous"))


@query("Z20_time_window_overlap", """
SELECT event_id FROM events WHERE epoch(ts) + value * 60 >= epoch(TIMESTAMP '2024-01-10') AND epoch(ts) <= epoch(TIMESTAMP '2024-01-11')""")
def time_window(t):
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    lo, hi = 1_704_844_800, 1_704_931_200
    return t("events").filter((at + F.col("value") * 60 >= lo) & (at <= hi)).select("event_id")


@query("Z23_name_state", """
SELECT c_custkey, CASE WHEN c_custkey % 13 = 0 THEN 'several' WHEN c_acctbal < 0 THEN 'unknown' WHEN c_nationkey < 5 THEN 'confirmed' WHEN c_nationkey < 10 THEN 'weak' ELSE 'inferred' END AS state FROM customer""")
def name_state(t):
    state = F.when(F.col("c_custkey") % 13 == 0, "several").when(F.col("c_acctbal") < 0, "unknown").when(F.col("c_nationkey") < 5, "confirmed").when(F.col("c_nationkey") < 10, "weak").otherwise("inferred")
    return t("customer").select("c_custkey", state.alias("state"))


@query("Z25_items_by_id", "SELECT p_partkey, p_name FROM part WHERE p_partkey IN (3, 5, 8, 13, 21, 999999)")
def items_by_id(t):
    return t("part").filter(F.col("p_partkey").isin(3, 5, 8, 13, 21, 999999)).select("p_partkey", "p_name")


@query("Z26_item_outline", r"""
SELECT conv_id, turn, array_to_string(list_slice(string_split_regex(trim(text), '\s+'), 1, 12), ' ') AS head FROM conversations""")
def outline(t):
    return t("conversations").select("conv_id", "turn", T.first_words(F.col("text"), 12).alias("head"))


@query("Z27_deep_links", """
SELECT event_id, 'https://example.org/v?t=' || floor(value)::BIGINT || CASE WHEN ceil(value * 1.5) > floor(value) THEN '&e=' || ceil(value * 1.5)::BIGINT ELSE '' END AS link FROM events""")
def deep_links(t):
    s, e = F.floor("value"), F.ceil(F.col("value") * 1.5)
    return t("events").select("event_id", F.concat(F.lit("https://example.org/v?t="), s, F.when(e > s, F.concat(F.lit("&e="), e)).otherwise("")).alias("link"))


@query("Z29_pipeline_gates", """
SELECT count(*) FILTER (o_orderstatus = 'P') AS pending, count(*) FILTER (o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)) AS unfolded FROM orders""")
def gates(t):
    folded = t("lineitem").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("f", F.lit(True))
    return t("orders").join(folded, "o_orderkey", "left").agg(F.count_if(F.col("o_orderstatus") == "P").alias("pending"), F.count_if(F.col("f").isNull()).alias("unfolded"))


@query("Z37_recent_questions", "SELECT event_id, user_id FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id LIMIT 30")
def recent(t):
    return t("events").filter("event_type = 'error'").orderBy(F.desc("ts"), "event_id").limit(30).select("event_id", "user_id")


@query("Z38_continuations", """
SELECT conv_id, turn, coalesce(turn - lag(turn) OVER w <= 2 AND role = lag(role) OVER w, false) AS continued FROM conversations WHERE role <> 'system' WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def continuations(t):
    w = Window.partitionBy("conv_id").orderBy("turn")
    same = (F.col("turn") - F.lag("turn").over(w) <= 2) & (F.col("role") == F.lag("role").over(w))
    return t("conversations").filter("role <> 'system'").select("conv_id", "turn", F.coalesce(same, F.lit(False)).alias("continued"))


@query("Z43_line_context", """
SELECT a.conv_id, a.turn, lag(length(text)) OVER (PARTITION BY a.conv_id ORDER BY a.turn) AS before, a.turn // 3 AS phase FROM conversations a""")
def line_context(t):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return t("conversations").select("conv_id", "turn", F.lag(F.length("text").cast("long")).over(w).alias("before"), F.floor(F.col("turn") / 3).alias("phase"))
