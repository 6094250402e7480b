"""Subjects: membership by phrases, roll-up over a tree, read models by year."""

from __future__ import annotations

from pyspark.sql import functions as F

from rostrum.operators import subjects as S
from rostrum.plans.registry import query

# A small tree over part names: theme -> subject -> sub-subject.
TREE = [("goods", None, None), ("rings", "goods", r"(?i)\bring\b"), ("red_rings", "rings", r"(?i)^red\b"), ("bolts", "goods", r"(?i)\bbolt\b")]
_MEMBERS = r"""
own AS (SELECT 'rings' AS slug, p_partkey AS id FROM part WHERE regexp_matches(p_name, '(?i)\bring\b') UNION ALL SELECT 'red_rings', p_partkey FROM part WHERE regexp_matches(p_name, '(?i)^red\b') UNION ALL SELECT 'bolts', p_partkey FROM part WHERE regexp_matches(p_name, '(?i)\bbolt\b')),
fit AS (SELECT * FROM own WHERE slug <> 'red_rings' OR id IN (SELECT id FROM own WHERE slug = 'rings')),
mem AS (SELECT DISTINCT slug, id FROM fit UNION SELECT 'rings', id FROM fit WHERE slug = 'red_rings' UNION SELECT 'goods', id FROM fit)"""


def members(t):
    return S.membership(t("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text")), TREE)


@query("A17_subject_rollup", f"""WITH {_MEMBERS}
SELECT slug, strftime(l_shipdate, '%Y') AS year, count(*) AS items, count(DISTINCT l_orderkey) AS meetings, count(*) FILTER (l_returnflag = 'A') AS decided, count(*) FILTER (l_returnflag = 'N') AS continued FROM mem JOIN lineitem ON l_partkey = id GROUP BY 1, 2""")
def rollup(t):
    items = t("lineitem").select(F.col("l_partkey").alias("id"), "l_orderkey", "l_returnflag", F.date_format("l_shipdate", "yyyy").alias("year"))
    j = items.join(members(t), "id")
    flag = lambda v: F.count_if(F.col("l_returnflag") == v)
    return j.groupBy("slug", "year").agg(F.count("*").alias("items"), F.countDistinct("l_orderkey").alias("meetings"), flag("A").alias("decided"), flag("N").alias("continued"))


@query("U6_membership", f"WITH {_MEMBERS} SELECT slug, id FROM mem")
def membership(t):
    return members(t)


@query("A18_subject_strip", f"""WITH {_MEMBERS}, y AS (SELECT DISTINCT year(l_shipdate) AS year FROM lineitem),
c AS (SELECT slug, year(l_shipdate) AS year, count(*) AS n FROM mem JOIN lineitem ON l_partkey = id GROUP BY 1, 2)
SELECT s.slug, string_agg(coalesce(n, 0)::VARCHAR, ',' ORDER BY y.year) AS strip FROM (SELECT DISTINCT slug FROM mem) s CROSS JOIN y LEFT JOIN c ON c.slug = s.slug AND c.year = y.year GROUP BY 1""")
def strip(t):
    years = F.year("l_shipdate").alias("year")
    counts = t("lineitem").select(F.col("l_partkey").alias("id"), years).join(members(t), "id").groupBy("slug", "year").agg(F.count("*").alias("n"))
    span = t("lineitem").select(years).distinct()
    cells = counts.select("slug").distinct().crossJoin(F.broadcast(span)).join(counts, ["slug", "year"], "left")  # subjects x years
    ordered = F.array_sort(F.collect_list(F.struct("year", F.coalesce("n", F.lit(0)).alias("n"))))
    return cells.groupBy("slug").agg(F.array_join(F.transform(ordered, lambda x: x["n"].cast("string")), ",").alias("strip"))


_YEARS = "c AS (SELECT o_custkey AS k, year(o_orderdate)::INT AS y, count(*) AS n FROM orders GROUP BY 1, 2)"


@query("Y1_shortest_window", f"""WITH {_YEARS}, z AS (SELECT k, sum(n) AS total FROM c GROUP BY 1), w AS (SELECT a.k, a.y AS lo, b.y AS hi FROM c a JOIN c b ON a.k = b.k AND a.y <= b.y JOIN c m ON m.k = a.k AND m.y BETWEEN a.y AND b.y JOIN z ON z.k = a.k GROUP BY a.k, a.y, b.y HAVING sum(m.n) >= 0.8 * max(z.total))
SELECT k, lo, hi FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY hi - lo, lo) AS rn FROM w) WHERE rn = 1""")
def shortest_window(t):
    counts = t("orders").groupBy(F.col("o_custkey").alias("k"), F.year("o_orderdate").alias("y")).agg(F.count("*").alias("n"))
    return S.shortest_window(counts, "k", "y", "n", 0.8)


@query("Y3_year_month_grid", """
WITH m AS (SELECT year(o_orderdate)::INT AS y, month(o_orderdate)::INT AS month, count(*) AS n FROM orders GROUP BY 1, 2), g AS (SELECT unnest(range((SELECT min(y) FROM m), (SELECT max(y) + 1 FROM m)))::INT AS y)
SELECT g.y, r.month::INT AS month, coalesce(n, 0) AS n FROM g CROSS JOIN (SELECT unnest(range(1, 13)) AS month) r LEFT JOIN m ON m.y = g.y AND m.month = r.month""")
def year_grid(t):
    from rostrum.operators.aggregates import grid

    counts = t("orders").groupBy(F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("month")).agg(F.count("*").alias("n"))
    return grid(counts, "y", "n").select("y", "month", "n")


@query("U5_tree_descent", """
WITH RECURSIVE e AS (SELECT 'r' || r_regionkey AS id, NULL AS parent FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier),
d AS (SELECT id, id AS root, 0 AS depth FROM e WHERE parent IS NULL UNION ALL SELECT e.id, d.root, d.depth + 1 FROM e JOIN d ON e.parent = d.id) SELECT id, root, depth FROM d""")
def tree_descent(t):
    k = lambda p, c: F.concat(F.lit(p), F.col(c))
    none = F.lit(None).cast("string")
    e = t("region").select(k("r", "r_regionkey").alias("id"), none.alias("parent"))
    e = e.unionByName(t("nation").select(k("n", "n_nationkey").alias("id"), k("r", "n_regionkey").alias("parent")))
    e = e.unionByName(t("supplier").select(k("s", "s_suppkey").alias("id"), k("n", "s_nationkey").alias("parent")))
    return S.descent(e, 3)


@query("Z13_subject_coverage", f"""WITH {_MEMBERS} SELECT count(DISTINCT id) AS named, (SELECT count(*) FROM part) AS n FROM mem""")
def subject_coverage(t):
    named = members(t).agg(F.countDistinct("id").alias("named"))
    return named.crossJoin(F.broadcast(t("part").agg(F.count("*").alias("n"))))


@query("J10_theta_titles", r"""
SELECT s.slug, count(*) AS n FROM (VALUES ('a', '(?i)ring'), ('b', '(?i)^blue')) s(slug, rx) JOIN part ON regexp_matches(p_name, s.rx) GROUP BY 1""")
def theta(t):
    flat = [("a", None, "(?i)ring"), ("b", None, "(?i)^blue")]
    return S.membership(t("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text")), flat).groupBy("slug").agg(F.count("*").alias("n"))
