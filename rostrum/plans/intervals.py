"""Interval joins, runs, windows: queries over conversations (as utterances) and lineitem (as agenda items)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rostrum.operators import intervals as I
from rostrum.plans.registry import query

# Utterances: the turns of a conversation.  Spans: of each conversation, three turns from
# every fourth turn on (so that turn 3, 7, ... lies in a hole), and one that overlaps them.
SPANS = """
spans AS (
  SELECT conv_id, turn AS start_idx, least(turn + 2, m) AS end_idx, conv_id * 100 + turn AS span_id
  FROM (SELECT conv_id, turn, max(turn) OVER (PARTITION BY conv_id) AS m FROM conversations) WHERE turn % 4 = 0)"""


def spans(t):
    w = Window.partitionBy("conv_id")
    c = t("conversations").select("conv_id", "turn", F.max("turn").over(w).alias("m")).filter("turn % 4 = 0")
    return c.select("conv_id", F.col("turn").alias("start_idx"), F.least(F.col("turn") + 2, "m").alias("end_idx"), (F.col("conv_id") * 100 + F.col("turn")).alias("span_id"))


@query("W2_islands", """
SELECT conv_id, role, min(turn) AS start_idx, max(turn) AS end_idx, count(*) AS n FROM (
  SELECT conv_id, role, turn, turn - row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS g FROM conversations)
GROUP BY conv_id, role, g""")
def islands(t):
    return I.islands(t("conversations"), ["conv_id", "role"], "turn")


@query("W3_gaps", f"""WITH {SPANS}
SELECT conv_id, gap_start, gap_end FROM (
  SELECT conv_id, end_idx + 1 AS gap_start, lead(start_idx) OVER (PARTITION BY conv_id ORDER BY start_idx, end_idx) - 1 AS gap_end FROM spans)
WHERE gap_end >= gap_start""")
def span_gaps(t):
    return I.gaps(spans(t), ["conv_id"], "start_idx", "end_idx")


@query("J2_interval_containment", f"""WITH {SPANS}
SELECT c.conv_id, c.turn, s.span_id FROM conversations c LEFT JOIN spans s
  ON s.conv_id = c.conv_id AND c.turn BETWEEN s.start_idx AND s.end_idx""")
def containment(t):
    points = t("conversations").select("conv_id", "turn")
    return I.containing(points, spans(t), ["conv_id"], "turn", "start_idx", "end_idx").select("conv_id", "turn", "span_id")


_WIDE = """
wide AS (SELECT l_suppkey AS k, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) AS id,
  epoch(l_shipdate)::BIGINT // 86400 AS s, epoch(l_shipdate)::BIGINT // 86400 + l_quantity::BIGINT AS e FROM lineitem)"""


def wide(t):
    day = F.floor(F.unix_timestamp(F.col("l_shipdate").cast("timestamp")) / 86400).cast("long")
    w = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    return t("lineitem").select(F.col("l_suppkey").alias("k"), F.row_number().over(w).alias("id"), day.alias("s"), (day + F.col("l_quantity").cast("long")).alias("e"))


@query("J3_overlap_pairs", f"""WITH {_WIDE}
SELECT a.k, a.id AS id_a, b.id AS id_b FROM wide a JOIN wide b ON a.k = b.k AND a.id < b.id AND a.s <= b.e AND b.s <= a.e""")
def overlaps(t):
    return I.overlapping_pairs(wide(t), ["k"], "id", "s", "e")


@query("J4_as_of_then_containment", f"""WITH {SPANS}
SELECT conv_id, turn, CASE WHEN end_idx >= turn THEN span_id END AS span_id FROM (
  SELECT c.conv_id, c.turn, s.span_id, s.end_idx, row_number() OVER (PARTITION BY c.conv_id, c.turn ORDER BY s.start_idx DESC) AS rn
  FROM conversations c LEFT JOIN spans s ON s.conv_id = c.conv_id AND s.start_idx <= c.turn) WHERE rn = 1""")
def as_of(t):
    points = t("conversations").select("conv_id", "turn")
    return I.as_of(points, spans(t), ["conv_id"], "turn", "start_idx", "end_idx", "span_id").select("conv_id", "turn", "span_id")


@query("J5_bulk_key_lookup", """
SELECT c.conv_id, c.turn, c.role FROM conversations c JOIN (VALUES (0, 0), (1, 1), (2, 0), (3, 9999)) k(conv_id, turn)
  ON c.conv_id = k.conv_id AND c.turn = k.turn""")
def key_lookup(t):
    c = t("conversations")
    keys = c.sparkSession.createDataFrame([(0, 0), (1, 1), (2, 0), (3, 9999)], "conv_id long, turn long")
    return c.join(F.broadcast(keys), ["conv_id", "turn"]).select("conv_id", "turn", "role")


@query("J6_span_to_ordered_lines", f"""WITH {SPANS}
SELECT s.span_id, string_agg(c.role || ':' || c.turn, ',' ORDER BY c.turn) AS lines, count(*) AS n FROM spans s JOIN conversations c
  ON c.conv_id = s.conv_id AND c.turn BETWEEN s.start_idx AND s.end_idx GROUP BY s.span_id""")
def ordered_lines(t):
    held = I.containing(t("conversations").select("conv_id", "turn", "role"), spans(t), ["conv_id"], "turn", "start_idx", "end_idx", "inner")
    lines = F.array_sort(F.collect_list(F.struct("turn", "role")))
    text = F.array_join(F.transform(lines, lambda x: F.concat_ws(":", x["role"], x["turn"].cast("string"))), ",")
    return held.groupBy("span_id").agg(text.alias("lines"), F.count("*").alias("n"))


@query("J7_lateral_top1", f"""WITH {SPANS}
SELECT s.span_id, x.turn, x.n_chars FROM spans s, LATERAL (
  SELECT c.turn, length(c.text) AS n_chars FROM conversations c WHERE c.conv_id = s.conv_id AND c.turn BETWEEN s.start_idx AND s.end_idx
  ORDER BY length(c.text) DESC, c.turn LIMIT 1) x""")
def longest_in_span(t):
    c = t("conversations").select("conv_id", "turn", F.char_length("text").cast("long").alias("n_chars"))
    held = I.containing(c, spans(t), ["conv_id"], "turn", "start_idx", "end_idx", "inner")
    return I.top(held, ["span_id"], [F.desc("n_chars"), F.asc("turn")]).select("span_id", "turn", "n_chars")


@query("J12_previous_line", """
SELECT a.conv_id, a.turn, b.role AS previous_role FROM conversations a LEFT JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn - 1""")
def previous_line(t):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return t("conversations").select("conv_id", "turn", F.lag("role").over(w).alias("previous_role"))


@query("J13_semi_and_anti", """
SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS has_closed,
  NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS without_orders FROM customer""")
def semi_anti(t):
    o = t("orders").groupBy("o_custkey").agg(F.max((F.col("o_orderstatus") == "F").cast("int")).alias("f"))
    j = t("customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    return j.select("c_custkey", (F.coalesce("f", F.lit(0)) == 1).alias("has_closed"), F.col("o_custkey").isNull().alias("without_orders"))


@query("J15_temporal_validity", """
WITH terms AS (SELECT o_custkey, min(o_orderdate::DATE) AS first_seen, max(o_orderdate::DATE) AS last_seen FROM orders GROUP BY 1)
SELECT c_custkey, count(*) AS n FROM customer JOIN terms ON o_custkey = c_custkey JOIN events ON user_id = c_custkey
WHERE ts::DATE BETWEEN first_seen - 120 AND last_seen + 1200 GROUP BY 1""")
def temporal_validity(t):
    terms = t("orders").groupBy("o_custkey").agg(F.min(F.to_date("o_orderdate")).alias("first_seen"), F.max(F.to_date("o_orderdate")).alias("last_seen"))
    days = t("events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("k"))  # events of a day stand or fall together
    j = t("customer").join(terms, F.col("c_custkey") == F.col("o_custkey")).join(days, F.col("user_id") == F.col("c_custkey"))
    j = j.filter(F.col("day").between(F.date_sub("first_seen", 120), F.date_add("last_seen", 1200)))
    return j.groupBy("c_custkey").agg(F.sum("k").alias("n"))


@query("J17_full_merge_least_greatest", """
SELECT coalesce(a.y, b.y) AS y, least(a.lo, b.lo) AS lo, greatest(a.hi, b.hi) AS hi FROM
 (SELECT strftime(o_orderdate, '%Y-%m') AS y, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders WHERE month(o_orderdate) < 9 GROUP BY 1) a FULL JOIN
 (SELECT strftime(l_shipdate, '%Y-%m') AS y, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem WHERE month(l_shipdate) > 3 GROUP BY 1) b ON a.y = b.y""")
def full_merge(t):
    def lane(df, day, value, keep):
        y = F.date_format(day, "yyyy-MM").alias("y")
        return df.filter(keep).groupBy(y).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))

    a = lane(t("orders"), "o_orderdate", "o_totalprice", F.month("o_orderdate") < 9).alias("a")
    b = lane(t("lineitem"), "l_shipdate", "l_extendedprice", F.month("l_shipdate") > 3).alias("b")
    return a.join(b, F.col("a.y") == F.col("b.y"), "full").select(F.coalesce("a.y", "b.y").alias("y"), F.least("a.lo", "b.lo").alias("lo"), F.greatest("a.hi", "b.hi").alias("hi"))


@query("J21_nearest_moment", """
WITH p AS (SELECT user_id, event_id, epoch_us(ts) AS at FROM events),
q AS (SELECT user_id, epoch_us(TIMESTAMP '2024-01-15 12:00:00') AS at FROM (SELECT DISTINCT user_id FROM events))
SELECT user_id, event_id, off FROM (SELECT q.user_id, p.event_id, abs(p.at - q.at) AS off,
  row_number() OVER (PARTITION BY q.user_id ORDER BY abs(p.at - q.at), p.event_id) AS rn FROM q JOIN p USING (user_id)) WHERE rn = 1""")
def nearest_moment(t):
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    off = F.abs(at - F.unix_micros(F.lit("2024-01-15 12:00:00").cast("timestamp")))
    best = F.min(F.struct(off.alias("off"), "event_id"))
    return t("events").groupBy("user_id").agg(best.alias("b")).select("user_id", "b.event_id", "b.off")


@query("W8_neighbours", """
SELECT o_orderkey, lag(o_orderkey) OVER w AS previous_key, lead(o_orderkey) OVER w AS next_key FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def neighbours(t):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return t("orders").select("o_orderkey", F.lag("o_orderkey").over(w).alias("previous_key"), F.lead("o_orderkey").over(w).alias("next_key"))


@query("W9_distinct_in_window", """
SELECT DISTINCT o_custkey, (SELECT count(DISTINCT b.o_orderstatus) FROM orders b WHERE b.o_custkey = a.o_custkey) AS n_status FROM orders a""")
def distinct_in_window(t):
    n = F.size(F.collect_set("o_orderstatus").over(Window.partitionBy("o_custkey"))).cast("long")
    return t("orders").select("o_custkey", n.alias("n_status")).distinct()


@query("W10_spread_cap", """
SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rn FROM documents) WHERE rn <= 3""")
def spread_cap(t):
    d = t("documents").select("doc_id", "source", "n_chars")
    return I.top(d, ["source"], [F.desc("n_chars"), F.asc("doc_id")], 3).select("doc_id", "source")


_APPEAR = """
e AS (SELECT user_id AS k, epoch(ts) AS s, epoch(ts) + value AS f FROM events)"""


def stretches(t):
    s = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return t("events").select(F.col("user_id").alias("k"), s.alias("s"), (s + F.col("value")).alias("f"))


@query("W11_merge_runs", f"""WITH {_APPEAR},
m AS (SELECT *, max(f) OVER (PARTITION BY k ORDER BY s, f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM e),
r AS (SELECT *, sum(CASE WHEN s - b <= 3600 THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY s, f ROWS UNBOUNDED PRECEDING) AS run FROM m)
SELECT k, round(min(s), 3) AS s, round(max(f), 3) AS f, count(*) AS n FROM r GROUP BY k, run""")
def merge_runs(t):
    return I.merged(stretches(t), ["k"], "s", "f", 3600).select("k", F.round("s", 3).alias("s"), F.round("f", 3).alias("f"), "n")


@query("W12_turns", """
SELECT conv_id, turn, sum(c) OVER (PARTITION BY conv_id ORDER BY turn) AS turn_no FROM (
  SELECT conv_id, turn, CASE WHEN role IS DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn) THEN 1 ELSE 0 END AS c FROM conversations)""")
def turn_numbers(t):
    return I.turns(t("conversations"), ["conv_id"], "turn", ["role"]).select("conv_id", "turn", "turn_no")


@query("W16_neighbourhood_count", """
SELECT conv_id, turn, count(*) OVER (PARTITION BY conv_id, role ORDER BY turn RANGE BETWEEN 6 PRECEDING AND 6 FOLLOWING) AS n FROM conversations""")
def neighbourhood(t):
    w = Window.partitionBy("conv_id", "role").orderBy("turn").rangeBetween(-6, 6)
    return t("conversations").select("conv_id", "turn", F.count("*").over(w).alias("n"))


@query("W17_letters", """
SELECT conv_id, role, chr((65 + (dense_rank() OVER (PARTITION BY conv_id ORDER BY f) - 1) % 26)::INT) AS letter FROM (
  SELECT conv_id, role, min(turn) AS f FROM conversations GROUP BY 1, 2)""")
def letters(t):
    first = t("conversations").groupBy("conv_id", "role").agg(F.min("turn").alias("f"))
    n = F.dense_rank().over(Window.partitionBy("conv_id").orderBy("f"))
    return first.select("conv_id", "role", F.chr(65 + (n - 1) % 26).alias("letter"))


@query("W6_stratified_md5_sample", """
SELECT y, o_orderkey FROM (SELECT year(o_orderdate) AS y, o_orderkey, row_number() OVER (PARTITION BY year(o_orderdate) ORDER BY md5(o_orderkey::VARCHAR)) AS rn FROM orders) WHERE rn <= 5""")
def md5_sample(t):
    o = t("orders").select(F.year("o_orderdate").cast("long").alias("y"), "o_orderkey")
    return I.top(o, ["y"], [F.md5(F.col("o_orderkey").cast("string").cast("binary"))], 5)


@query("F10_uncovered", f"""WITH {_APPEAR},
sp AS (SELECT k, floor(s / 7200) * 7200 AS s, floor(s / 7200) * 7200 + 7200 AS f FROM e GROUP BY ALL),
o AS (SELECT k, s, f, max(f) OVER (PARTITION BY k ORDER BY s, f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM sp),
r AS (SELECT *, sum(CASE WHEN s <= b THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY s, f ROWS UNBOUNDED PRECEDING) AS g FROM o),
a AS (SELECT k, min(s) AS s, max(f) AS f FROM r GROUP BY k, g),
wo AS (SELECT k, s, f, max(f) OVER (PARTITION BY k ORDER BY s, f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM e),
wr AS (SELECT *, sum(CASE WHEN s <= b THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY s, f ROWS UNBOUNDED PRECEDING) AS g FROM wo),
w AS (SELECT k, min(s) AS s, max(f) AS f FROM wr GROUP BY k, g),
j AS (SELECT a.k, a.s, a.f, w.s AS ws, w.f AS we, row_number() OVER (PARTITION BY a.k, a.s ORDER BY w.s) AS rn,
  lead(w.s) OVER (PARTITION BY a.k, a.s ORDER BY w.s) AS nx FROM a JOIN w ON w.k = a.k AND w.s <= a.f AND w.f >= a.s),
h AS (SELECT k, s, ws AS f FROM j WHERE rn = 1 UNION ALL SELECT k, we, coalesce(nx, f) FROM j)
SELECT k, round(sum(f - s), 2) AS seconds, count(*) AS holes FROM h WHERE f - s >= 2 GROUP BY k""")
def holes(t):
    e = stretches(t)
    speech = e.select("k", (F.floor(F.col("s") / 7200) * 7200.0).alias("s")).withColumn("f", F.col("s") + 7200.0)
    got = I.uncovered(speech, e, ["k"], "s", "f", 2.0)
    return got.groupBy("k").agg(F.round(F.sum(F.col("f") - F.col("s")), 2).alias("seconds"), F.count("*").alias("holes"))


@query("F9_overlap_seconds", f"""WITH {_APPEAR},
p AS (SELECT k, s, f, row_number() OVER (PARTITION BY k ORDER BY s, f) AS i FROM e)
SELECT a.k, round(sum(least(a.f, b.f) - greatest(a.s, b.s)), 3) AS seconds FROM p a JOIN p b ON a.k = b.k AND a.i < b.i AND a.s <= b.f AND b.s <= a.f GROUP BY a.k""")
def overlap_seconds(t):
    p = stretches(t).withColumn("i", F.row_number().over(Window.partitionBy("k").orderBy("s", "f")))
    b = p.select("k", F.col("s").alias("s2"), F.col("f").alias("f2"), F.col("i").alias("i2"))
    j = p.join(b, "k").filter("i < i2 and s <= f2 and s2 <= f")
    return j.groupBy("k").agg(F.round(F.sum(F.least("f", "f2") - F.greatest("s", "s2")), 3).alias("seconds"))
