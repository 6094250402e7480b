"""Retrieval queries: documents as passages, benchmark items as queries, embeddings as vectors."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rostrum.functions import text as T
from rostrum.operators import parsers
from rostrum.operators import search as S
from rostrum.operators import vectors as V
from rostrum.plans.registry import query

_TOK = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"
_POST = rf"""
post AS (SELECT doc_id AS id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_TOK.format('text')}) AS term FROM documents) GROUP BY 1, 2),
len AS (SELECT id, sum(tf) AS len FROM post GROUP BY 1),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY 1),
st AS (SELECT count(*) AS n_docs, avg(len) AS avgdl FROM len),
q AS (SELECT DISTINCT item_id AS qid, unnest({_TOK.format('text')}) AS term FROM benchmark),
bm AS (SELECT qid, post.id, sum(ln((n_docs - df + 0.5) / (df + 0.5) + 1) * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * len / avgdl))) AS score
  FROM q JOIN dfs USING (term) JOIN post USING (term) JOIN len ON len.id = post.id, st GROUP BY 1, 2)"""


def _index(t):
    return S.build_index(t("documents").select("doc_id", "text"), "doc_id", "text")


def _queries(t):
    return S.query_terms(t("benchmark"), "item_id", "text")


@query("A12_bm25_statistics", f"""WITH {_POST}
SELECT term, df, n_docs, round(avgdl, 6) AS avgdl FROM dfs, st WHERE df >= 3""")
def bm25_statistics(t):
    index = _index(t)
    return index.df.filter("df >= 3").crossJoin(F.broadcast(index.stats)).select("term", "df", "n_docs", F.round("avgdl", 6).alias("avgdl"))


@query("T1_postings", rf"""
SELECT doc_id AS id, count(DISTINCT term) AS terms, count(*) AS tokens FROM (SELECT doc_id, unnest({_TOK.format('text')}) AS term FROM documents) GROUP BY 1""")
def posting_counts(t):
    return S.postings(t("documents"), "doc_id", "text").groupBy("id").agg(F.count("*").alias("terms"), F.sum("tf").alias("tokens"))


@query("A13_bm25_top", f"""WITH {_POST}
SELECT qid, id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, id) AS rank FROM bm) WHERE rank <= 10""")
def bm25_top(t):
    scored = S.bm25(_index(t), _queries(t)).withColumn("score", F.round("score", 6))
    return S.ranked(scored, 10)


@query("I27_bm25_refresh_equals_rebuild", rf"""
WITH post AS (SELECT doc_id AS id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_TOK.format("CASE WHEN source = 'src3' THEN reverse(text) ELSE text END")}) AS term FROM documents WHERE source <> 'src7') GROUP BY 1, 2)
SELECT term, count(*) AS df FROM post GROUP BY 1""")
def bm25_refresh(t):
    docs = t("documents").select("doc_id", "text", "source")
    after = docs.filter("source <> 'src7'").withColumn("text", F.when(F.col("source") == "src3", F.reverse("text")).otherwise(F.col("text")))
    changed = docs.filter("source in ('src3', 'src7')").select(F.col("doc_id").alias("id"))
    return S.refreshed(_index(t), after, changed, "doc_id", "text").df


_DENSE = """
qv AS (SELECT vec_id AS qid, embedding AS q FROM embeddings WHERE vec_id % 20 = 0),
dn AS (SELECT qid, vec_id AS id, list_inner_product(q::DOUBLE[], embedding::DOUBLE[]) AS score FROM embeddings, qv)"""


def _vectors(t):
    v = t("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return v, v.filter("id % 20 = 0").select(F.col("id").alias("qid"), F.col("v").alias("q"))


@query("K2_vector_top", f"""WITH {_DENSE}
SELECT qid, id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, id) AS rank FROM dn) WHERE rank <= 10""")
def vector_top(t):
    return V.exact(*_vectors(t), 10)


@query("K2_vector_index")
def vector_index(t):
    """The same search by an index of cells; its recall against the exact one is tested."""
    v, q = _vectors(t)
    index = V.build(v)
    return V.search(index, q, 40, V.probes_for(index, q, 40))


@query("T4_cover_density", rf"""
WITH q AS (SELECT qid, term FROM (SELECT item_id AS qid, unnest(list_distinct({_TOK.format('text')}[1:3])) AS term FROM benchmark)), k AS (SELECT qid, count(*) AS k FROM q GROUP BY 1),
w AS (SELECT doc_id AS id, {_TOK.format('text')} AS w FROM documents), p AS (SELECT id, unnest(w) AS term, unnest(range(len(w))) AS pos FROM w),
o AS (SELECT qid, id, term, pos FROM p JOIN q USING (term)),
b AS (SELECT e.qid, e.id, e.term, e.pos, x.term AS other, max(x.pos) AS last, max(x.pos) FILTER (x.pos < e.pos) AS before FROM o e JOIN o x ON x.qid = e.qid AND x.id = e.id AND x.pos <= e.pos GROUP BY 1, 2, 3, 4, 5),
c AS (SELECT qid, id, pos, min(last) AS lo, max(before) FILTER (other = term) AS was FROM b JOIN k USING (qid) GROUP BY qid, id, term, pos HAVING count(*) = max(k)),
v AS (SELECT c.qid, c.id, c.pos, c.lo, count(*) AS n FROM c JOIN o ON o.qid = c.qid AND o.id = c.id AND o.pos BETWEEN c.lo AND c.pos WHERE was IS NULL OR was < lo GROUP BY 1, 2, 3, 4),
s AS (SELECT qid, id, count(*) AS covers, round(sum(0.1::DOUBLE / (1 + (pos - lo) - (n - 1))), 6) AS score FROM v GROUP BY 1, 2)
SELECT qid, id, covers, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM s QUALIFY rank <= 20""")
def cover_density(t):
    """Of the documents that hold the first three words of an item, those where the words stand densest."""
    asked = t("benchmark").select(F.col("item_id").alias("qid"), F.explode(F.array_distinct(F.slice(T.tokens(F.col("text")), 1, 3))).alias("term"))
    return S.ranked(S.dense_covers(t("documents"), "doc_id", "text", asked).withColumn("score", F.round("score", 6)), 20)


# Addresses are keys of one thread wherever they occur; topics are curated patterns.
_KEYS = {"mail": r"[A-Za-z0-9._]+@[A-Za-z0-9.]+\.[a-z]+", "phone": r"\+1 \(\d{3}\) \d{3}-\d{4}"}
TOPICS = {"licences": r"(?i)apache license|general public license|mit license|creative commons", "that-and": r"(?i)\bthat and\b", "with-the": r"(?i)\bwith.{0,12}\bthe for\b", "for-as": r"(?i)\bfor as\b"}
_TOPIC_SQL = "(VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in TOPICS.items()) + ") AS topics(key, rx)"


def _thread_keys(rows, id_):
    """id, kind, key of the texts: addresses, and the topics that they touch."""
    keys = parsers.thread_keys(rows, id_, "text", _KEYS).select(F.col(id_).alias("id"), "kind", "key")
    topics = F.array_compact(F.array(*[F.when(F.col("text").rlike(v), F.lit(k)) for k, v in TOPICS.items()]))
    return keys.unionByName(rows.select(F.col(id_).alias("id"), F.lit("topic").alias("kind"), F.explode(topics).alias("key")))


def _keys_sql(table, id_):
    each = [f"SELECT {id_} AS id, '{kind}' AS kind, unnest(list_distinct(regexp_extract_all(text, '{rx}'))) AS key FROM {table}" for kind, rx in _KEYS.items()]
    return " UNION ALL ".join([*each, f"SELECT {id_}, 'topic', key FROM {table} JOIN {_TOPIC_SQL} ON regexp_matches(text, rx)"])


def _threads_sql(asked, cut=" QUALIFY row_number() OVER (PARTITION BY kind, key ORDER BY id) <= 200"):
    return f"""tk AS ({_keys_sql('documents', 'doc_id')}), short AS (SELECT * FROM tk{cut}), asked AS ({asked}),
met AS (SELECT asked.id AS qid, short.id, min(kind || ':' || key) AS f FROM short JOIN asked USING (kind, key) GROUP BY 1, 2),
thr AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY f, id) AS rank FROM met)"""


@query("T8_thread_retrieval", f"""WITH {_threads_sql("SELECT * FROM tk WHERE id % 20 = 0")}
SELECT qid, id, rank FROM thr""")
def threads(t):
    """Documents that share an address or a topic with every twentieth one."""
    keys = _thread_keys(t("documents"), "doc_id")
    return S.thread_hits(keys, keys.filter("id % 20 = 0").withColumnRenamed("id", "qid"), 200)


def _lists_sql(threads):
    return f"""{_POST},
qv AS (SELECT item_id AS qid, embedding AS q FROM benchmark JOIN embeddings ON vec_id = item_id),
dn AS (SELECT qid, vec_id AS id, round(list_inner_product(q::DOUBLE[], embedding::DOUBLE[]), 6) AS score FROM embeddings, qv),
lex AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, id) AS rank FROM bm QUALIFY rank <= 300),
sem AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM dn QUALIFY rank <= 300),
{threads},
fu AS (SELECT qid, id, sum(1.0 / (60 + rank)) AS score, min((l, rank)) AS f FROM (
  SELECT qid, id, 0 AS l, rank FROM lex UNION ALL SELECT qid, id, 1, rank FROM sem UNION ALL SELECT qid, id, 2, rank FROM thr) GROUP BY 1, 2)"""


_LISTS = _lists_sql(_threads_sql(_keys_sql("benchmark", "item_id")))


def _lists(t, most=200):
    lex = S.ranked(S.bm25(_index(t), _queries(t)).withColumn("score", F.round("score", 6)), 300)
    v, _ = _vectors(t)
    q = t("benchmark").join(t("embeddings"), F.col("vec_id") == F.col("item_id")).select(F.col("item_id").alias("qid"), F.col("embedding").alias("q"))
    asked = _thread_keys(t("benchmark"), "item_id").withColumnRenamed("id", "qid")
    return lex, V.exact(v, q, 300), S.thread_hits(_thread_keys(t("documents"), "doc_id"), asked, most)


@query("T6_reciprocal_rank_fusion", f"""WITH {_lists_sql(_threads_sql(_keys_sql('benchmark', 'item_id'), ''))}
SELECT qid, id, round(score, 9) AS score FROM fu""")
def fusion(t):
    """The best 300 by words and by vectors, and all that share a key with the item."""
    return S.fused(_lists(t, None)).select("qid", "id", F.round("score", 9).alias("score"))


@query("T7_hybrid_search", f"""WITH {_LISTS},
hd AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, f, id) AS rank FROM fu QUALIFY rank <= 600),
att AS (SELECT hd.*, source, sem.score AS sim, qid IN (SELECT qid FROM lex UNION SELECT qid FROM thr) AS lexical FROM hd JOIN documents ON doc_id = hd.id LEFT JOIN sem USING (qid, id) WHERE lang = 'en'),
sl AS (SELECT *, row_number() OVER (PARTITION BY qid, source ORDER BY rank) AS s FROM att QUALIFY s <= 2),
ok AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank) AS place FROM sl WHERE sim IS NULL OR sim >= CASE WHEN lexical THEN 0 ELSE 0.55 END)
SELECT qid, id, source, place FROM ok WHERE place <= 10""")
def hybrid_search(t):
    lex, sem, thr = _lists(t)
    attributes = t("documents").select(F.col("doc_id").alias("id"), "source", "lang")
    return S.hybrid(lex, sem, thr, attributes, F.col("lang") == "en", "source", spread=2, limit=10).select("qid", "id", "source", "place")


@query("T3_loosened_search", f"""WITH {_POST},
ab AS (SELECT qid, term, df, row_number() OVER (PARTITION BY qid ORDER BY df, term) AS k FROM q JOIN dfs USING (term), st WHERE length(term) >= 3 AND df <= 0.2 * n_docs QUALIFY k <= 8),
fl AS (SELECT qid, term, least(greatest(n - 1, 1), greatest((n + 1) // 2, 1)) AS floor FROM (SELECT *, count(*) OVER (PARTITION BY qid) AS n FROM ab))
SELECT qid, id, count(*) AS matched, max(floor) AS floor FROM fl JOIN post USING (term) GROUP BY 1, 2 HAVING count(*) >= max(floor)""")
def loosened_search(t):
    index = _index(t)
    return S.loosened(index.terms, _queries(t), index.stats.select("n_docs"))


@query("T2_all_terms", rf"""
WITH post AS (SELECT DISTINCT doc_id AS id, unnest({_TOK.format('text')}) AS term FROM documents)
SELECT id FROM post WHERE term IN ('the', 'and', 'of') AND id NOT IN (SELECT id FROM post WHERE term = 'with') GROUP BY id HAVING count(*) = 3""")
def all_terms(t):
    words = F.array_distinct(T.tokens(F.col("text")))
    has = lambda w: F.array_contains("w", w)
    return t("documents").select(F.col("doc_id").alias("id"), words.alias("w")).filter(has("the") & has("and") & has("of") & ~has("with")).select("id")


@query("T5_phrase", r"""
SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)\bof\s+the\b')""")
def phrase(t):
    return t("documents").filter(F.col("text").rlike(T.phrase_pattern("of the"))).select("doc_id")


@query("U7_first_seen_dedupe", f"""WITH {_LISTS}
SELECT qid, id, min((l, rank)).l AS list, min((l, rank)).rank AS rank FROM (SELECT qid, id, 0 AS l, rank FROM lex UNION ALL SELECT qid, id, 1 AS l, rank FROM sem) AS x GROUP BY qid, id""".replace("min((l, rank)).l AS list, min((l, rank)).rank AS rank", "min(l * 1000000 + rank) // 1000000 AS list, min(l * 1000000 + rank) % 1000000 AS rank"))
def first_seen(t):
    lex, sem, _ = _lists(t)
    both = lex.select("qid", "id", F.lit(0).cast("long").alias("list"), F.col("rank").cast("long").alias("rank")).unionByName(sem.select("qid", "id", F.lit(1).cast("long").alias("list"), F.col("rank").cast("long").alias("rank")))
    return both.groupBy("qid", "id").agg(F.min(F.struct("list", "rank")).alias("f")).select("qid", "id", "f.list", "f.rank")


@query("A28_precision_and_mrr", f"""WITH {_POST},
rk AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, id) AS rank FROM bm QUALIFY rank <= 100),
rl AS (SELECT qid, rank, contains(lower(d.text), lower(array_to_string(string_split(b.text, ' ')[1:8], ' '))) AS hit FROM rk JOIN documents d ON d.doc_id = rk.id JOIN benchmark b ON b.item_id = rk.qid)
SELECT round(avg(p), 6) AS p10, round(avg(m), 6) AS mrr FROM (SELECT qid, count(*) FILTER (hit AND rank <= 10) / 10.0 AS p, coalesce(1.0 / min(rank) FILTER (hit), 0) AS m FROM rl GROUP BY 1)""")
def retrieval_metrics(t):
    rank = S.ranked(S.bm25(_index(t), _queries(t)).withColumn("score", F.round("score", 6)), 100)
    d = t("documents").select(F.col("doc_id").alias("id"), F.lower("text").alias("dt"))
    b = t("benchmark").select(F.col("item_id").alias("qid"), F.lower(F.substring_index("text", " ", 8)).alias("bt"))
    hit = rank.join(d, "id").join(b, "qid").withColumn("hit", F.contains("dt", "bt"))
    each = hit.groupBy("qid").agg(
        (F.count_if(F.col("hit") & (F.col("rank") <= 10)) / 10.0).alias("p"), F.coalesce(1.0 / F.min(F.when(F.col("hit"), F.col("rank"))), F.lit(0.0)).alias("m")
    )
    return each.agg(F.round(F.avg("p"), 6).alias("p10"), F.round(F.avg("m"), 6).alias("mrr"))


@query("K4_page_with_total", """
SELECT doc_id, n_chars, count(*) OVER () AS total FROM documents WHERE lang = 'en' ORDER BY n_chars DESC, doc_id LIMIT 20 OFFSET 40""")
def page_with_total(t):
    rows = t("documents").filter("lang = 'en'").select("doc_id", "n_chars")
    total = rows.agg(F.count("*").alias("total"))
    return S.page(rows, [F.desc("n_chars"), F.asc("doc_id")], 40, 20).crossJoin(F.broadcast(total))


@query("K5_page_without_total", """
SELECT doc_id, (SELECT count(*) FROM (SELECT 1 FROM documents WHERE lang = 'fr' LIMIT 21 OFFSET 20)) > 20 AS truncated
FROM (SELECT doc_id FROM documents WHERE lang = 'fr' ORDER BY doc_id LIMIT 20 OFFSET 20)""")
def page_without_total(t):
    ahead = S.page(t("documents").filter("lang = 'fr'").select("doc_id"), [F.asc("doc_id")], 20, 21)
    more = ahead.agg((F.count("*") > 20).alias("truncated"))
    return ahead.orderBy("doc_id").limit(20).crossJoin(F.broadcast(more))
