"""Sources, predicates, aggregations, sorts and set operations on the relational tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rostrum.functions import text as T
from rostrum.operators import aggregates as A
from rostrum.operators import intervals as I
from rostrum.plans.registry import query

# --- sources and sinks -----------------------------------------------------------------------


@query("S3_upsert_keeps_fetched", """
SELECT coalesce(o.p_partkey, n.p_partkey) AS p_partkey, coalesce(n.p_name, o.p_name) AS p_name, coalesce(o.p_size, n.p_size) AS p_size
FROM (SELECT p_partkey, p_name, CASE WHEN p_partkey % 2 = 0 THEN p_size END AS p_size FROM part WHERE p_size < 30) o
FULL JOIN (SELECT p_partkey, upper(p_name) AS p_name, -1 AS p_size FROM part WHERE p_size >= 10) n USING (p_partkey)""")
def upsert(t):
    p = t("part").select("p_partkey", "p_name", "p_size")
    old = p.filter("p_size < 30").withColumn("p_size", F.when(F.col("p_partkey") % 2 == 0, F.col("p_size")))
    new = p.filter("p_size >= 10").withColumn("p_name", F.upper("p_name")).withColumn("p_size", F.lit(-1))
    return A.upsert(old, new, ["p_partkey"], keep=["p_size"])


@query("S4_work_list", """
SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderkey DESC LIMIT 25""")
def work_list(t):
    return t("orders").filter("o_orderstatus = 'P'").select("o_orderkey").orderBy(F.desc("o_orderkey")).limit(25)


@query("S5_catalogue_lines", """
SELECT id, title, secs FROM (SELECT split_part(l, chr(9), 1) AS id, split_part(l, chr(9), 2) AS title, TRY_CAST(split_part(l, chr(9), 3) AS DOUBLE) AS secs, row_number() OVER (PARTITION BY split_part(l, chr(9), 1) ORDER BY tab) AS rn
  FROM (SELECT p_size AS tab, p_brand || chr(9) || p_name || chr(9) || CASE WHEN p_partkey % 7 = 0 THEN 'NA' ELSE p_retailprice::VARCHAR END AS l FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, p_size ORDER BY p_partkey) AS k FROM part) WHERE k = 1)
  WHERE TRY_CAST(split_part(l, chr(9), 3) AS DOUBLE) IS NOT NULL) WHERE rn = 1""")
def catalogue(t):
    p = I.top(t("part"), ["p_brand", "p_size"], [F.asc("p_partkey")])
    line = F.concat_ws("\t", "p_brand", "p_name", F.when(F.col("p_partkey") % 7 == 0, "NA").otherwise(F.col("p_retailprice").cast("string")))
    cells = p.select(F.col("p_size").alias("tab"), F.split(line, "\t").alias("c"))
    rows = cells.select("tab", F.get("c", F.lit(0)).alias("id"), F.get("c", F.lit(1)).alias("title"), F.get("c", F.lit(2)).try_cast("double").alias("secs"))
    return I.top(rows.filter("secs is not null"), ["id"], [F.asc("tab")]).select("id", "title", "secs")


@query("S6_kind_filter", """
SELECT p_partkey FROM part WHERE p_retailprice >= 950 AND p_type IN ('ECONOMY', 'SMALL')""")
def kind_filter(t):
    return t("part").filter((F.col("p_retailprice") >= 950) & F.col("p_type").isin("ECONOMY", "SMALL")).select("p_partkey")


@query("S12_subtitle_clock", """
SELECT event_id, printf('%02d:%02d:%02d,%03d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) AS clock FROM (SELECT event_id, round(value * 1000)::BIGINT * 37 AS ms FROM events)""")
def subtitle_clock(t):
    ms = F.round(F.col("value") * 1000).cast("long") * 37
    return t("events").select("event_id", T.clock_of(ms / 1000, comma=True).alias("clock"))


@query("S15_scoped_subset", """
SELECT l_orderkey, l_linenumber, l_partkey, NULL::BIGINT AS l_suppkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')""")
def scoped_subset(t):
    kept = t("orders").filter("o_orderstatus = 'P'")
    rows = t("lineitem").join(kept, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", F.lit(None).cast("long").alias("l_suppkey"))


@query("S16_capped_log", """
SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY date_trunc('hour', ts) ORDER BY ts, event_id) AS rn FROM events WHERE event_type = 'error') WHERE rn <= 2""")
def capped_log(t):
    e = t("events").filter("event_type = 'error'").select("event_id", "ts", F.date_trunc("hour", "ts").alias("h"))
    return I.top(e, ["h"], [F.asc("ts"), F.asc("event_id")], 2).select("event_id")


@query("S18_first_seen_terms", """
SELECT lower(p_name) AS term, min(p_partkey) AS first FROM part GROUP BY 1""")
def first_seen_terms(t):
    return t("part").groupBy(F.lower("p_name").alias("term")).agg(F.min("p_partkey").alias("first"))


# --- predicates ----------------------------------------------------------------------------------


@query("P1_conjunctive_filter", """
SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '2-HIGH' AND o_orderdate >= '1997-01-01' AND o_totalprice < 300000""")
def conjunction(t):
    wanted = {"o_orderstatus": "F", "o_orderpriority": "2-HIGH", "o_custkey": None}
    keep = F.lit(True)
    for c, v in wanted.items():
        keep = keep & (F.col(c) == v) if v is not None else keep  # an absent argument is no predicate
    return t("orders").filter(keep & (F.col("o_orderdate") >= "1997-01-01") & (F.col("o_totalprice") < 300000)).select("o_orderkey")


@query("P3_effective_date", """
SELECT o_orderkey, coalesce(CASE WHEN o_orderstatus = 'F' THEN strftime(o_orderdate, '%Y-%m-%d') END, CASE WHEN o_orderkey % 2 = 0 THEN '1999-01-01' END, '') AS d FROM orders""")
def effective_date(t):
    d = F.coalesce(F.when(F.col("o_orderstatus") == "F", F.date_format("o_orderdate", "yyyy-MM-dd")), F.when(F.col("o_orderkey") % 2 == 0, "1999-01-01"), F.lit(""))
    return t("orders").select("o_orderkey", d.alias("d"))


@query("P4_past_and_upcoming", """
SELECT strftime(o_orderdate, '%Y-%m-%d') <= '1998-06-30' AS past, count(*) AS n FROM orders GROUP BY 1""")
def past(t):
    return t("orders").groupBy((F.date_format("o_orderdate", "yyyy-MM-dd") <= "1998-06-30").alias("past")).agg(F.count("*").alias("n"))


@query("P5_month_prefix", """
SELECT count(*) AS n FROM orders WHERE strftime(o_orderdate, '%Y-%m-%d') LIKE '1998-07-%'""")
def month_prefix(t):
    return t("orders").filter(F.date_format("o_orderdate", "yyyy-MM-dd").startswith("1998-07-")).agg(F.count("*").alias("n"))


@query("P7_regex_predicates", """
SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)the') AND NOT regexp_matches(text, '(?i)with')""")
def regex_predicates(t):
    return t("documents").filter(F.col("text").rlike("(?i)the") & ~F.col("text").rlike("(?i)with")).select("doc_id")


@query("P8_any_like", """
SELECT p_partkey FROM part WHERE lower(p_name) LIKE '%ring%' OR lower(p_name) LIKE 'blue%'""")
def any_like(t):
    n = F.lower("p_name")
    return t("part").filter(n.contains("ring") | n.startswith("blue")).select("p_partkey")


@query("P9_identifier", r"""
SELECT l_partkey, regexp_matches(trim(x), '^[A-Za-z]{1,5}[ -][0-9]{1,3}([ -][0-9]{1,6})?$') AS is_id FROM (SELECT DISTINCT l_partkey, CASE l_partkey % 3 WHEN 0 THEN 'R-' WHEN 1 THEN 'PDE 26 ' ELSE '' END || l_partkey AS x FROM lineitem)""")
def identifiers(t):
    k = F.col("l_partkey")
    x = F.concat(F.when(k % 3 == 0, "R-").when(k % 3 == 1, "PDE 26 ").otherwise(""), k)
    return t("lineitem").select("l_partkey").distinct().select("l_partkey", T.is_identifier(x).alias("is_id"))


@query("P10_code_equality", """
SELECT p_partkey FROM part WHERE upper(replace(replace(p_brand, '-', ''), ' ', '')) = 'BRAND#7' OR p_name = 'red widget'""")
def code_equality(t):
    return t("part").filter((T.code_key(F.col("p_brand")) == "BRAND#7") | (F.col("p_name") == "red widget")).select("p_partkey")


@query("P15_substantive_lines", r"""
SELECT conv_id, turn, len(string_split_regex(trim(text), '\s+')) > 40 AND turn > 0 AS substantive FROM conversations""")
def substantive(t):
    return t("conversations").select("conv_id", "turn", ((F.size(F.split(F.trim("text"), r"\s+")) > 40) & (F.col("turn") > 0)).alias("substantive"))


@query("P17_coverage_floor", """
SELECT source, count(*) FILTER (n_chars >= 2000) AS extracted, count(*) AS n FROM documents GROUP BY 1""")
def coverage_floor(t):
    return t("documents").groupBy("source").agg(F.count_if(F.col("n_chars") >= 2000).alias("extracted"), F.count("*").alias("n"))


@query("P18_identifiable_voice", r"""
SELECT conv_id, role, sum(len(string_split_regex(trim(text), '\s+'))) AS words FROM conversations GROUP BY 1, 2 HAVING sum(len(string_split_regex(trim(text), '\s+'))) >= 30 AND count(*) >= 2""")
def identifiable(t):
    words = F.sum(F.size(F.split(F.trim("text"), r"\s+")))
    g = t("conversations").groupBy("conv_id", "role").agg(words.alias("words"), F.count("*").alias("n"))
    return g.filter("words >= 30 and n >= 2").select("conv_id", "role", "words")


# --- joins of dimensions ------------------------------------------------------------------------


@query("J1_equi_chain", """
SELECT r_name, n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""")
def equi_chain(t):
    j = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    j = j.join(F.broadcast(t("nation")), F.col("c_nationkey") == F.col("n_nationkey"), "left")  # 25 and 5 rows
    j = j.join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return j.groupBy("r_name", "n_name").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("J20_sticky_link", """
SELECT l_orderkey, l_partkey FROM (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN l_partkey % 50 = 0 THEN 0 ELSE 1 END, l_quantity DESC, l_partkey) AS rn FROM lineitem) WHERE rn = 1""")
def sticky_link(t):
    current = (F.col("l_partkey") % 50 != 0).cast("int")  # the current link stays while it is a candidate
    return I.top(t("lineitem").select("l_orderkey", "l_partkey", "l_quantity"), ["l_orderkey"], [current, F.desc("l_quantity"), F.asc("l_partkey")]).select("l_orderkey", "l_partkey")


@query("J22_citation_resolution", """
SELECT c.o_custkey, count(*) AS cited, count(*) FILTER (l.k IS NULL) AS missing FROM orders c LEFT JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_quantity > 25) l ON l.k = c.o_orderkey GROUP BY 1""")
def citation_resolution(t):
    known = t("lineitem").filter("l_quantity > 25").select(F.col("l_orderkey").alias("k")).distinct()
    j = t("orders").join(known, F.col("o_orderkey") == F.col("k"), "left")
    return j.groupBy("o_custkey").agg(F.count("*").alias("cited"), F.count_if(F.col("k").isNull()).alias("missing"))


@query("J23_name_join", """
SELECT a.p_partkey FROM part a JOIN (SELECT DISTINCT lower(p_name) AS n FROM part WHERE p_size < 5) b ON lower(a.p_name) = b.n""")
def name_join(t):
    names = t("part").filter("p_size < 5").select(F.lower("p_name").alias("n")).distinct()
    return t("part").join(names, F.lower("p_name") == F.col("n"), "left_semi").select("p_partkey")


# --- aggregations ---------------------------------------------------------------------------------


@query("A1_conditional_counts", """
SELECT l_shipdate::DATE AS day, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS returned, min(l_quantity) AS lo, max(l_quantity) FILTER (l_linestatus = 'F') AS hi FROM lineitem GROUP BY 1""")
def conditional_counts(t):
    return t("lineitem").groupBy(F.to_date("l_shipdate").alias("day")).agg(
        F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.min("l_quantity").alias("lo"), F.max(F.when(F.col("l_linestatus") == "F", F.col("l_quantity"))).alias("hi")
    )


@query("A2_filter_with_exists", """
SELECT c_mktsegment, count(*) FILTER (EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)) AS large, count(*) AS n FROM customer GROUP BY 1""")
def filter_with_exists(t):
    flag = t("orders").filter("o_totalprice > 450000").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("f", F.lit(True))
    return t("customer").join(flag, "c_custkey", "left").groupBy("c_mktsegment").agg(F.count("f").alias("large"), F.count("*").alias("n"))


@query("A3_count_distinct", """
SELECT event_type, count(DISTINCT user_id) AS people, count(DISTINCT user_id) FILTER (value > 50) AS active FROM events GROUP BY 1""")
def count_distinct(t):
    return t("events").groupBy("event_type").agg(F.countDistinct("user_id").alias("people"), F.countDistinct(F.when(F.col("value") > 50, F.col("user_id"))).alias("active"))


@query("A4_month_histogram", """
SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS scheduled, count(*) FILTER (o_orderstatus = 'F') AS recorded, count(*) FILTER (o_orderdate < '1998-01-01') AS past FROM orders GROUP BY 1""")
def month_histogram(t):
    return t("orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(
        F.count("*").alias("scheduled"), F.count_if(F.col("o_orderstatus") == "F").alias("recorded"), F.count_if(F.col("o_orderdate") < "1998-01-01").alias("past")
    )


@query("A5_having", """
SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) FILTER (l_returnflag = 'N') >= 15""")
def having(t):
    g = t("lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "N").alias("k"))
    return g.filter("k >= 15").select("l_partkey", "n")


@query("A6_percent_zero_guard", """
SELECT user_id, round(100.0 * count(*) FILTER (event_type = 'purchase' AND value > 20) / nullif(count(*) FILTER (event_type = 'purchase'), 0)) AS pct FROM events GROUP BY 1""")
def percent(t):
    bought = F.col("event_type") == "purchase"
    return t("events").groupBy("user_id").agg(A.percent(F.count_if(bought & (F.col("value") > 20)), F.count_if(bought)).alias("pct"))


@query("A7_share_of_total", """
SELECT lang, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM documents GROUP BY 1""")
def share(t):
    g = t("documents").groupBy("lang").agg(F.count("*").alias("n"))
    return g.crossJoin(F.broadcast(g.agg(F.sum("n").alias("_all")))).select("lang", "n", F.round(F.col("n") / F.col("_all"), 6).alias("share"))


@query("A8_mode_with_ties", """
SELECT o_custkey, o_orderpriority, n FROM (SELECT o_custkey, o_orderpriority, count(*) AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC, o_orderpriority) AS rn FROM orders GROUP BY 1, 2) WHERE rn = 1""")
def mode(t):
    return A.mode(t("orders"), ["o_custkey"], "o_orderpriority", [F.asc("o_orderpriority")])


@query("A9_ordered_string", """
SELECT conv_id, string_agg(role, '>' ORDER BY turn) AS path FROM conversations GROUP BY 1""")
def ordered_string(t):
    return t("conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]), ">").alias("path"))


@query("A11_scalar_counts", """
SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS orders, coalesce((SELECT round(sum(o_totalprice), 2) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F'), 0) AS closed FROM customer""")
def scalar_counts(t):
    g = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"), F.round(F.sum(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))), 2).alias("closed"))
    return t("customer").select("c_custkey").join(g, "c_custkey", "left").select("c_custkey", F.coalesce("orders", F.lit(0)).alias("orders"), F.coalesce("closed", F.lit(0.0)).alias("closed"))


@query("A14_reach", """
SELECT l_partkey, count(DISTINCT l_orderkey) AS meetings, count(DISTINCT l_suppkey) AS bodies FROM lineitem GROUP BY 1""")
def reach(t):
    return t("lineitem").groupBy("l_partkey").agg(F.countDistinct("l_orderkey").alias("meetings"), F.countDistinct("l_suppkey").alias("bodies"))


@query("A15_daily_arrivals", """
SELECT ts::DATE AS day, count(*) AS arrived, count(*) FILTER (event_type = 'purchase') AS kept, count(*) FILTER (event_type = 'error') AS failed, count(DISTINCT CASE WHEN user_id % 10 <> 0 THEN user_id END) AS people, count(*) FILTER (user_id % 10 = 0) AS blind, sum(round(value * 10000)::BIGINT)::BIGINT / (10000::DOUBLE * count(value)) AS mean FROM events GROUP BY 1""")
def daily_arrivals(t):
    kind = F.col("event_type")
    asker = F.when(F.col("user_id") % 10 != 0, F.col("user_id"))
    return t("events").groupBy(F.to_date("ts").alias("day")).agg(
        F.count("*").alias("arrived"), F.count_if(kind == "purchase").alias("kept"), F.count_if(kind == "error").alias("failed"), F.countDistinct(asker).alias("people"), F.count_if(asker.isNull()).alias("blind"), (F.sum(F.round(F.col("value") * 10000).cast("long")) / (F.lit(10000.0) * F.count("value"))).alias("mean")
    )


@query("A16_facets", """
SELECT 'lang' AS facet, lang AS value, count(*) AS n FROM documents GROUP BY 2 UNION ALL SELECT * FROM (SELECT 'source', source, count(*) FROM documents GROUP BY 2 HAVING count(*) >= 45 ORDER BY 3 DESC, 2 LIMIT 10)""")
def facets(t):
    of = lambda c: t("documents").groupBy(F.col(c).alias("value")).agg(F.count("*").alias("n")).select(F.lit(c).alias("facet"), "value", "n")
    return of("lang").unionByName(of("source").filter("n >= 45").orderBy(F.desc("n"), "value").limit(10))


@query("A21_priority", """
SELECT l_suppkey, count(*) AS lines, count(DISTINCT l_orderkey) AS meetings, count(*) * count(DISTINCT l_orderkey) AS priority FROM lineitem GROUP BY 1""")
def priority(t):
    g = t("lineitem").groupBy("l_suppkey").agg(F.count("*").alias("lines"), F.countDistinct("l_orderkey").alias("meetings"))
    return g.withColumn("priority", F.col("lines") * F.col("meetings"))


@query("A22_share_and_floor", """
SELECT l_suppkey, l_returnflag FROM (SELECT l_suppkey, l_returnflag, count(*) AS n, sum(count(*)) OVER (PARTITION BY l_suppkey) AS total FROM lineitem GROUP BY 1, 2) WHERE n >= 20 AND n >= 0.35 * total""")
def share_and_floor(t):
    g = t("lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.count("*").alias("n"))
    return g.withColumn("total", F.sum("n").over(Window.partitionBy("l_suppkey"))).filter("n >= 20 and n >= 0.35 * total").select("l_suppkey", "l_returnflag")


@query("A23_coherence_ratio", """
SELECT l_partkey, round(count(DISTINCT l_suppkey) / count(DISTINCT l_orderkey), 6) AS ratio FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_orderkey) >= 8 AND count(DISTINCT l_suppkey) / count(DISTINCT l_orderkey) > 0.9""")
def coherence(t):
    g = t("lineitem").groupBy("l_partkey").agg(F.countDistinct("l_suppkey").alias("a"), F.countDistinct("l_orderkey").alias("b"))
    return g.filter("b >= 8 and a / b > 0.9").select("l_partkey", F.round(F.col("a") / F.col("b"), 6).alias("ratio"))


@query("A29_cluster_metrics", """
SELECT label, round(max(n) / sum(n), 6) AS purity, count(*) AS parts FROM (SELECT label, vec_id % 7 AS g, count(*) AS n FROM embeddings GROUP BY 1, 2) GROUP BY 1""")
def cluster_metrics(t):
    g = t("embeddings").groupBy("label", (F.col("vec_id") % 7).alias("g")).agg(F.count("*").alias("n"))
    return g.groupBy("label").agg(F.round(F.max("n") / F.sum("n"), 6).alias("purity"), F.count("*").alias("parts"))


@query("A30_precision_recall", """
SELECT quality AS name, round(count(*) FILTER (toxic = 1) / nullif(count(*), 0), 6) AS precision FROM labels GROUP BY 1""")
def precision(t):
    return t("labels").groupBy(F.col("quality").alias("name")).agg(F.round(F.try_divide(F.count_if(F.col("toxic") == 1), F.count("*")), 6).alias("precision"))


@query("A32_duplicate_groups", """
SELECT md5(text) AS h, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1""")
def duplicate_groups(t):
    g = t("documents").groupBy(F.md5(F.col("text").cast("binary")).alias("h")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))
    return g.filter("n > 1")


@query("A33_totals", """
SELECT count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS done, round(sum(o_totalprice) / 3600, 4) AS hours, round(100 * count(*) FILTER (o_orderstatus = 'F') / count(*), 4) AS pct FROM orders""")
def totals(t):
    done = F.count_if(F.col("o_orderstatus") == "F")
    return t("orders").agg(F.count("*").alias("n"), done.alias("done"), F.round(F.sum("o_totalprice") / 3600, 4).alias("hours"), F.round(100 * done / F.count("*"), 4).alias("pct"))


@query("A35_element_median", """
SELECT lang, n_chars AS q FROM (SELECT lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents) WHERE i = n // 2""")
def element_median(t):
    return A.element_quantile(t("documents"), ["lang"], "n_chars", 0.5)


# --- order, pages, sets ------------------------------------------------------------------------------


@query("K3_sort_policies", """
SELECT o_orderkey, rn FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderstatus = 'F' DESC, o_orderstatus = 'P' DESC, o_orderdate DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 50""")
def sort_policies(t):
    top = t("orders").orderBy((F.col("o_orderstatus") == "F").desc(), (F.col("o_orderstatus") == "P").desc(), F.desc("o_orderdate"), "o_orderkey").limit(50)
    w = Window.orderBy((F.col("o_orderstatus") == "F").desc(), (F.col("o_orderstatus") == "P").desc(), F.desc("o_orderdate"), "o_orderkey")
    return top.select("o_orderkey", F.row_number().over(w).alias("rn"))  # over the 50 rows of the page


@query("K6_window_over_lists", """
WITH r AS (SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id, turn) - 1 AS i FROM conversations)
SELECT conv_id, count(*) AS total, count(*) FILTER (i >= 30 AND i < 55) AS returned FROM r GROUP BY 1""")
def window_over_lists(t):
    """Turns 30 to 54 of all lists in order: entries outside the window stay, with nothing returned."""
    lo, hi = 30, 55
    c = t("conversations").select("conv_id", "turn")
    head = c.orderBy("conv_id", "turn").limit(hi)
    place = F.row_number().over(Window.orderBy("conv_id", "turn")) - 1  # over the rows up to the window's end
    part = head.withColumn("i", place).filter(F.col("i") >= lo).groupBy("conv_id").agg(F.count("*").alias("part"))
    totals = c.groupBy("conv_id").agg(F.count("*").alias("total"))
    return totals.join(part, "conv_id", "left").select("conv_id", "total", F.coalesce("part", F.lit(0)).alias("returned"))


@query("K9_budgeted_prefix", """
SELECT conv_id, turn FROM (SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS s FROM conversations) WHERE s <= 1500""")
def budgeted_prefix(t):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return t("conversations").withColumn("s", F.sum(F.length("text")).over(w)).filter("s <= 1500").select("conv_id", "turn")


@query("K8_character_window", """
SELECT doc_id, substr(text, 101, 200) AS part, length(text) AS total FROM documents""")
def character_window(t):
    return t("documents").select("doc_id", F.substring("text", 101, 200).alias("part"), F.length("text").cast("long").alias("total"))


@query("K10_head_and_tail", """
SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS a, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS b FROM conversations) WHERE a <= 1 OR b <= 2""")
def head_and_tail(t):
    w = Window.partitionBy("conv_id")
    c = t("conversations").withColumn("a", F.row_number().over(w.orderBy("turn"))).withColumn("b", F.row_number().over(w.orderBy(F.desc("turn"))))
    return c.filter("a <= 1 or b <= 2").select("conv_id", "turn")


@query("K11_top_notable", """
SELECT l_orderkey, l_linenumber, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber, l_partkey) AS rn FROM lineitem WHERE l_returnflag = 'R') WHERE rn <= 2""")
def top_notable(t):
    r = t("lineitem").filter("l_returnflag = 'R'").select("l_orderkey", "l_linenumber", "l_quantity", "l_partkey")
    return I.top(r, ["l_orderkey"], [F.desc("l_quantity"), F.asc("l_linenumber"), F.asc("l_partkey")], 2).select("l_orderkey", "l_linenumber", "l_quantity")


@query("K12_longest_samples", """
SELECT conv_id, role, turn FROM (SELECT conv_id, role, turn, row_number() OVER (PARTITION BY conv_id, role ORDER BY length(text) DESC, turn) AS rn FROM conversations) WHERE rn = 1""")
def longest_samples(t):
    return I.top(t("conversations"), ["conv_id", "role"], [F.length("text").desc(), F.asc("turn")]).select("conv_id", "role", "turn")


@query("K13_queue_order", """
SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' ORDER BY CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderdate END DESC NULLS LAST, o_totalprice DESC, o_orderkey LIMIT 5""")
def queue_order(t):
    day = F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderdate"))
    return t("orders").filter("o_orderstatus = 'P'").orderBy(day.desc_nulls_last(), F.desc("o_totalprice"), "o_orderkey").limit(5).select("o_orderkey")


@query("K15_best_spelling", """
SELECT p_brand, arg_max(p_name, (p_size, length(p_name), p_partkey)) AS name FROM part GROUP BY 1""")
def best_spelling(t):
    return t("part").groupBy("p_brand").agg(F.max_by("p_name", F.struct("p_size", F.length("p_name"), "p_partkey")).alias("name"))


@query("U1_symmetric_difference", """
WITH a AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_quantity > 49), b AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_discount > 0.09)
SELECT k, 'a' AS side FROM (SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL SELECT k, 'b' FROM (SELECT k FROM b EXCEPT SELECT k FROM a)""")
def symmetric(t):
    k = lambda c: t("lineitem").filter(c).select(F.col("l_partkey").alias("k"))
    return A.symmetric_difference(k("l_quantity > 49"), k("l_discount > 0.09"))


@query("U2_except_then_union", """
(SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') UNION SELECT c_custkey FROM customer WHERE c_acctbal < 0""")
def except_union(t):
    o = lambda s: t("orders").filter(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("k"))
    return o("F").subtract(o("P")).union(t("customer").filter("c_acctbal < 0").select("c_custkey")).distinct()


@query("U3_union_all", """
SELECT s_suppkey AS k, 'supplier' AS kind FROM supplier UNION ALL SELECT c_custkey, 'customer' FROM customer""")
def union_all(t):
    return t("supplier").select(F.col("s_suppkey").alias("k"), F.lit("supplier").alias("kind")).unionByName(t("customer").select(F.col("c_custkey").alias("k"), F.lit("customer").alias("kind")))


@query("U4_distinct", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def distinct(t):
    return t("lineitem").select("l_returnflag", "l_linestatus").distinct()


# --- scalars -------------------------------------------------------------------------------------------


@query("F1_dates", """
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d, strftime(o_orderdate, '%Y') AS y, (o_orderdate::DATE - 120) AS lo, (o_orderdate::DATE + 400) AS hi FROM orders""")
def dates(t):
    d = F.to_date("o_orderdate")
    return t("orders").select("o_orderkey", F.date_format(d, "yyyy-MM-dd").alias("d"), F.date_format(d, "yyyy").alias("y"), F.date_sub(d, 120).alias("lo"), F.date_add(d, 400).alias("hi"))


@query("F2_math", """
SELECT l_orderkey, l_linenumber, l_partkey, round(ln(l_quantity + 1), 6) AS a, abs(l_discount - 0.05) > 0.02 AS far, least(l_quantity, 10) AS lo, greatest(l_quantity, 40) AS hi, coalesce(nullif(l_tax, 0), -1) AS tax FROM lineitem""")
def math(t):
    c = F.col
    return t("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.round(F.log(c("l_quantity") + 1), 6).alias("a"), (F.abs(c("l_discount") - 0.05) > 0.02).alias("far"),
        F.least(c("l_quantity"), F.lit(10.0)).alias("lo"), F.greatest(c("l_quantity"), F.lit(40.0)).alias("hi"), F.coalesce(F.nullif(c("l_tax"), F.lit(0.0)), F.lit(-1.0)).alias("tax"),
    )


@query("F3_clock_round_trip", """
SELECT event_id, floor(value)::BIGINT % 100000 * 1.0 AS seconds FROM events""")
def clock_round_trip(t):
    return t("events").select("event_id", T.seconds_of(T.clock_of(F.floor("value").cast("double"))).alias("seconds"))


@query("F4_strings", """
SELECT c_custkey, upper(c_mktsegment) AS u, replace(c_name, '#', ' ') AS r, length(c_name) AS n, strpos(c_name, '#') AS p, trim('  ' || c_name || ' ') AS tr, substr(c_name, 1, 4) AS l FROM customer""")
def strings(t):
    n = F.col("c_name")
    return t("customer").select("c_custkey", F.upper("c_mktsegment").alias("u"), F.replace(n, F.lit("#"), F.lit(" ")).alias("r"), F.length(n).cast("long").alias("n"), F.locate("#", n).cast("long").alias("p"), F.trim(F.concat(F.lit("  "), n, F.lit(" "))).alias("tr"), F.left(n, F.lit(4)).alias("l"))


@query("F6_json", """
SELECT (props->>'k')::BIGINT AS k, count(*) AS n FROM events GROUP BY 1""")
def json_fields(t):
    return t("events").groupBy(F.from_json("props", "k bigint")["k"].alias("k")).agg(F.count("*").alias("n"))


@query("F8_top3_mean", """
SELECT l_partkey, round(avg(l_extendedprice), 4) AS m FROM (SELECT l_partkey, l_extendedprice, row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice DESC) AS rn FROM lineitem) WHERE rn <= 3 GROUP BY 1""")
def top3_mean(t):
    return I.top(t("lineitem").select("l_partkey", "l_extendedprice"), ["l_partkey"], [F.desc("l_extendedprice")], 3).groupBy("l_partkey").agg(F.round(F.avg("l_extendedprice"), 4).alias("m"))
