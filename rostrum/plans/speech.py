"""Transcripts: words that are heard wrong, parts that are made again, names that are said."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rostrum.operators import lexicon as L
from rostrum.operators import names as N
from rostrum.operators import repair
from rostrum.plans.registry import query

_TOK = r"regexp_extract_all(lower(text), '[a-z]{4,}')"
# Words by their counts in the record (documents) and in speech (conversations); ordinary is what stands in every twentieth document.
_WORDS = f"""
written AS (SELECT word, count(*) AS n FROM (SELECT unnest({_TOK}) AS word FROM documents) GROUP BY 1),
spoken AS (SELECT word, count(*) AS n FROM (SELECT unnest({_TOK}) AS word FROM conversations) GROUP BY 1),
ordinary AS (SELECT word FROM (SELECT doc_id, unnest(list_distinct({_TOK})) AS word FROM documents) GROUP BY 1 HAVING count(*) * 20 > (SELECT count(*) FROM documents))"""


def _likeness(a, b):
    return f"1 - levenshtein({a}, {b}) / greatest(length({a}), length({b}))"


def _sound_sql(w):
    for was, now in L.SPELLINGS:
        w = f"replace({w}, '{was}', '{now}')"
    fold = lambda c: f"translate({c}, '{L.LETTERS}', '{L.STANDS_FOR}')"
    body = fold(f"regexp_replace(substr({w}, 2), '[aeiou]', '', 'g')")
    for c in "bcdfghjklmnpqrstvwxyzi":
        body = f"regexp_replace({body}, '{c}+', '{c}', 'g')"
    return f"{fold(f'substr({w}, 1, 1)')} || {body}"


def _words(rows):
    return rows.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{4,})"), F.lit(1))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def _ordinary(docs):
    each = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{4,})"), F.lit(1)))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    total = docs.agg(F.count("*").alias("total"))  # one row
    return each.crossJoin(F.broadcast(total)).filter("n * 20 > total").select("word")


@query("T38_never_right", f"""WITH {_WORDS},
a AS (SELECT word AS term, n AS n_written, {_sound_sql('word')} AS key FROM written WHERE n >= 3 AND word NOT IN (SELECT word FROM ordinary) AND word NOT IN (SELECT word FROM spoken)),
b AS (SELECT word AS said, n AS c, {_sound_sql('word')} AS key FROM spoken WHERE word NOT IN (SELECT word FROM ordinary) AND word NOT IN (SELECT word FROM written)),
p AS (SELECT term, n_written, said, c, row_number() OVER (PARTITION BY term ORDER BY c DESC, said) AS r FROM a JOIN b USING (key) WHERE abs(length(term) - length(said)) <= 4 AND {_likeness('term', 'said')} >= 0.6 AND NOT (c > 20 AND c > 10 * n_written))
SELECT term, n_written, sum(c)::BIGINT AS heard, string_agg(CASE WHEN r <= 5 THEN said || ':' || c END, ', ' ORDER BY r) AS variants FROM p GROUP BY 1, 2 HAVING sum(c) >= 2""")
def never_right(t):
    """Words of the documents that no conversation has, with what sounds like them there."""
    return L.never_right(_words(t("documents")), _words(t("conversations")), _ordinary(t("documents")))


@query("T38_near_misses", f"""WITH {_WORDS},
targets AS (SELECT word FROM written WHERE n >= 10 AND length(word) >= 7),
p AS (SELECT spoken.word, spoken.n, targets.word AS target, {_likeness('spoken.word', 'targets.word')} AS score FROM spoken JOIN targets ON spoken.word[1] = targets.word[1] AND abs(length(spoken.word) - length(targets.word)) <= 3
  WHERE spoken.word NOT IN (SELECT word FROM targets))
SELECT word, n, target, round(score, 6) AS score FROM p WHERE score >= 0.85 QUALIFY row_number() OVER (PARTITION BY word ORDER BY score DESC, target) = 1""")
def near_misses(t):
    """Words of conversations that are a letter or two away from a common long word of the documents."""
    targets = _words(t("documents")).filter((F.col("n") >= 10) & (F.length("word") >= 7)).select("word")
    return L.near_misses(_words(t("conversations")), targets).withColumn("score", F.round("score", 6))


# Every twentieth event opens a gap in its user's record; up to two words, one outside, and a segment are heard there again.
_REPAIR = """
w AS (SELECT user_id, event_id AS id, epoch_us(ts) / 1e6 AS s, epoch_us(ts) / 1e6 + value * 60 AS e FROM events),
sg AS (SELECT user_id, id, s, s + 3600 + id % 7 * 600 AS e FROM w WHERE id % 3 = 0),
g AS (SELECT user_id, id AS gap, s, s + 3600 * (1 + id % 5) AS e FROM w WHERE id % 20 = 0),
nw AS (SELECT user_id, gap, gap * 10 + k + 1000000 AS id, s + k * 1800 - 3 AS s, s + k * 1800 + 1 AS e FROM (SELECT *, unnest(range(gap // 20 % 4)) AS k FROM g)),
ns AS (SELECT user_id, gap, gap * 10 + 9000000 AS id, s + 10 AS s, s + 20 AS e FROM g),
got AS (SELECT nw.* FROM nw JOIN g USING (user_id, gap) WHERE (nw.s + nw.e) / 2 BETWEEN g.s - 0.75 AND g.e + 0.75),
act AS (SELECT * FROM g WHERE gap IN (SELECT gap FROM got)),
"""


def _kept(rows):
    return f"SELECT {rows}.id, {rows}.user_id, {rows}.s, {rows}.e FROM {rows} WHERE NOT EXISTS (SELECT 1 FROM act WHERE act.user_id = {rows}.user_id AND ({rows}.s + {rows}.e) / 2 BETWEEN act.s - 0.75 AND act.e + 0.75)"


@query("Z31_retranscription_swap", f"""WITH {_REPAIR}
out AS (SELECT 'word' AS kind, * FROM ({_kept('w')}) UNION ALL SELECT 'word', id, user_id, s, e FROM got UNION ALL SELECT 'segment', * FROM ({_kept('sg')})
  UNION ALL SELECT 'segment', ns.id, ns.user_id, ns.s, ns.e FROM ns JOIN act USING (user_id, gap) WHERE (ns.s + ns.e) / 2 BETWEEN act.s - 0.75 AND act.e + 0.75)
SELECT kind, id, user_id, floor(s)::BIGINT AS start, floor(e)::BIGINT AS "end" FROM out""")
def retranscribed(t):
    """Words and segments of all users after the gaps in which something was heard again."""
    at, i = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6, F.col("id")
    words = t("events").select("user_id", F.col("event_id").alias("id"), at.alias("start"), (at + F.col("value") * 60).alias("end"))
    segments = words.filter("id % 3 = 0").withColumn("end", F.col("start") + 3600 + i % 7 * 600)
    gaps = words.filter("id % 20 = 0").select("user_id", i.alias("gap"), "start", (F.col("start") + 3600 * (1 + i % 5)).alias("end"))
    k, gap = F.col("k"), F.col("gap")
    count = (F.floor(gap / 20) % 4).cast("int")
    said = gaps.filter(count > 0).withColumn("k", F.explode(F.sequence(F.lit(0), count - 1)))
    new_words = said.select("user_id", "gap", (gap * 10 + k + 1_000_000).alias("id"), (F.col("start") + k * 1800 - 3).alias("_s"), (F.col("start") + k * 1800 + 1).alias("end")).withColumnRenamed("_s", "start")
    new_segments = gaps.select("user_id", "gap", (gap * 10 + 9_000_000).alias("id"), (F.col("start") + 10).alias("_s"), (F.col("start") + 20).alias("end")).withColumnRenamed("_s", "start")
    out = repair.swapped(words, segments, new_words, new_segments, gaps, "user_id")
    both = [df.select(F.lit(kind).alias("kind"), "id", "user_id", F.floor("start").alias("start"), F.floor("end").alias("end")) for kind, df in zip(("word", "segment"), out, strict=True)]
    return both[0].unionByName(both[1])


# What is said at each order of a customer: introductions, the podium form, prompts, letters, queues, and lines without a name.
_FIRST, _LAST = "Ann Ron Nancy Élan Uh Pat".split(), "Oakley McBride Starkey O'Neil Hazelwood Mariano".split()
_SAID = [
    "Good evening. My name is {n} and I live here.",
    "Uh {n}, 6400 Madison Street, and I have been sworn.",
    "Please state your name and address. My name is  {n}.",
    "The next email is from {n}. My name is {n}, I am writing to you.",
    "{n}, 12 Oak Avenue.",
    "my name is Um {n} St. James",
    "Thank you. {n}, followed by {m}. And then Okay {n} and {m}.",
    "I spoke with {n} yesterday.",
    "And {m}.",
    "Next up we have Mr. Chairman {m}",
    "We have heard {l} before.",
    "Nothing from the next individual, Clerk {n}, Commissioner.",
]
_NAMED = {"{n}": "f || ' ' || l", "{m}": "'Nancy ' || l", "{l}": "l"}


def _list(words):
    return "[" + ", ".join(_q(w) for w in words) + "]"


def _q(pattern):
    return "'" + pattern.replace("'", "''") + "'"


def _line_sql(text):
    out = "'" + text.replace("'", "''") + "'"
    for mark, value in _NAMED.items():
        out = f"replace({out}, '{mark}', {value})"
    return out


_LINES = f"""
o AS (SELECT o_custkey AS rec, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS idx, {_list(_FIRST)}[o_orderkey % {len(_FIRST)} + 1] AS f, {_list(_LAST)}[o_custkey % {len(_LAST)} + 1] AS l FROM orders),
lines AS (SELECT rec, idx, CASE WHEN rec % 3 = 0 OR idx < 4 THEN 'V1' ELSE 'V' || o_orderkey % 3 END AS label, trim(regexp_replace(CASE o_orderkey % {len(_SAID)} {' '.join(f'WHEN {i} THEN {_line_sql(x)}' for i, x in enumerate(_SAID))} END, '\\s+', ' ', 'g')) AS text FROM o)"""


def said_lines(t):
    """rec, idx, label, text."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    pick = lambda words, key: F.get(F.array(*[F.lit(x) for x in words]), (F.col(key) % len(words)).cast("int"))
    o = t("orders").select(F.col("o_custkey").alias("rec"), "o_orderkey", (F.row_number().over(w) - 1).cast("long").alias("idx"), pick(_FIRST, "o_orderkey").alias("f"), pick(_LAST, "o_custkey").alias("l"))
    text = pick(_SAID, "o_orderkey")
    for mark, value in (("{n}", F.concat_ws(" ", "f", "l")), ("{m}", F.concat(F.lit("Nancy "), "l")), ("{l}", F.col("l"))):
        text = F.replace(text, F.lit(mark), value)
    label = F.when((F.col("rec") % 3 == 0) | (F.col("idx") < 4), "V1").otherwise(F.concat(F.lit("V"), F.col("o_orderkey") % 3))
    return o.select("rec", "idx", label.alias("label"), N.squeezed(text).alias("text"))


def _in(words):
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


_NAME = f"CASE WHEN regexp_extract(text, {_q(N.SAYS)}, 1) <> '' THEN regexp_extract(text, {_q(N.SAYS)}, 1) WHEN regexp_matches(text, {_q(N.SWORN)}) THEN regexp_extract(text, {_q(N.PODIUM)}, 1) END"
_FOUND = f"""named AS (SELECT *, CASE WHEN length(nm) >= 4 AND len(string_split(nm, ' ')) <= 3 THEN nm END AS name FROM (SELECT *, {_NAME} AS nm FROM lines))"""


@query("T34_names_in_lines", f"""WITH {_LINES}, {_FOUND},
parts AS (SELECT rec, idx, part, unnest(range(len(part))) AS i FROM (SELECT rec, idx, string_split_regex(text, {_q(N.QUEUE_SPLIT)}) AS part FROM lines WHERE regexp_matches(text, {_q(N.QUEUE_CUE)}) OR regexp_matches(text, {_q(N.QUEUE_BARE)}))),
c AS (SELECT rec, idx, i, k, string_split_regex(n, '\\s+') AS tk FROM (SELECT rec, idx, i, unnest(regexp_extract_all(part[i + 1], {_q(N.QUEUE_NAME)})) AS n, unnest(range(len(regexp_extract_all(part[i + 1], {_q(N.QUEUE_NAME)})))) AS k FROM parts)),
a AS (SELECT rec, idx, i, k, CASE WHEN p IS NULL OR p = 0 THEN [] ELSE tk[p:] END AS tk FROM (SELECT *, list_position(list_transform(tk, lambda x: lower(x) NOT IN {_in(N.FILLERS)}), true) AS p FROM c)),
b AS (SELECT rec, idx, i, k, CASE WHEN p IS NULL OR p = 0 THEN [] ELSE tk[1:len(tk) - p + 1] END AS tk FROM (SELECT *, list_position(list_transform(list_reverse(tk), lambda x: lower(x) NOT IN {_in(N.NO_LAST)}), true) AS p FROM a)),
d AS (SELECT rec, idx, i, k, array_to_string(tk, ' ') AS n, len(tk) AS words FROM b WHERE len(tk) BETWEEN 1 AND 3 AND length(array_to_string(tk, ' ')) >= 4 AND lower(tk[1]) NOT IN {_in(N.NO_FIRST)} AND lower(tk[1]) NOT IN {_in(N.TITLES)} AND len(list_filter(tk, lambda x: NOT regexp_matches(x, '^\\p{{Lu}}\\p{{L}}+$'))) = 0),
e AS (SELECT rec, idx, i, CASE WHEN i = 0 THEN arg_max(n, k) FILTER (words >= 2) ELSE arg_min(n, k) END AS n FROM d GROUP BY 1, 2, 3),
q AS (SELECT rec, idx, string_agg(n, ', ' ORDER BY i) AS queue FROM e WHERE n IS NOT NULL GROUP BY 1, 2)
SELECT rec, idx, name, queue FROM named LEFT JOIN q USING (rec, idx) WHERE name IS NOT NULL OR queue IS NOT NULL""")
def names_in_lines(t):
    """The names that lines say of their speakers, and the queues that they read out."""
    lines = said_lines(t).select("rec", "idx", N.said_name(F.col("text")).alias("name"), F.nullif(F.array_join(N.queued(F.col("text")), ", "), F.lit("")).alias("queue"))
    return lines.filter("name is not null or queue is not null")


@query("I13_self_claims", f"""WITH {_LINES}, {_FOUND},
runs AS (SELECT *, idx - row_number() OVER (PARTITION BY rec, label ORDER BY idx) AS run, count(*) OVER (PARTITION BY rec, label ORDER BY idx RANGE BETWEEN 6 PRECEDING AND 6 FOLLOWING) AS near FROM named),
r AS (SELECT *, min(idx) OVER w AS run_lo, max(idx) OVER w AS run_hi, bool_or(regexp_matches(text, {_q(N.READING_RUN)})) OVER w AS reads FROM runs WINDOW w AS (PARTITION BY rec, label, run)),
held AS (SELECT DISTINCT rec, 'V1' AS label, 'mariano' AS known FROM lines WHERE rec % 4 = 0),
letters AS (SELECT DISTINCT rec, 5 AS lo, 7 AS hi FROM lines WHERE rec % 5 = 0),
m AS (SELECT r.*, lo, hi, known, CASE WHEN regexp_matches(text, {_q(N.READING)}) OR reads THEN 'read_aloud' WHEN regexp_matches(CASE WHEN regexp_matches(text, {_q(N.SAYS)}) THEN regexp_extract(text, {_q('^(.*?)' + N.SAYS)}, 1) ELSE '' END, {_q(N.PROMPTED)}) THEN 'prompted'
  WHEN known IS NOT NULL AND NOT contains(lower(name), known) THEN 'board_voice' WHEN near >= 4 THEN 'self' ELSE 'self_weak' END AS method,
  (SELECT count(*) FROM lines x WHERE x.rec = r.rec AND contains(lower(x.text), lower(string_split(r.name, ' ')[-1]))) AS heard
  FROM r LEFT JOIN held USING (rec, label) LEFT JOIN letters ON letters.rec = r.rec AND r.idx BETWEEN lo AND hi WHERE name IS NOT NULL)
SELECT rec, idx, label, name, method, CASE WHEN method = 'read_aloud' THEN coalesce(lo, idx) ELSE run_lo END AS lo, CASE WHEN method = 'read_aloud' THEN coalesce(hi, idx) ELSE run_hi END AS hi, method IN ('self', 'self_weak') AND heard > 1 AS corroborated FROM m""")
def self_claims(t):
    """What becomes of each self-introduction, by the guards in their order; every fourth customer's first voice is known as a board member's."""
    lines = said_lines(t)
    recs = lines.select("rec").distinct()
    held = recs.filter("rec % 4 = 0").select("rec", F.lit("V1").alias("label"), F.lit("Mariano").alias("name"))
    letters = recs.filter("rec % 5 = 0").select("rec", F.lit(5).cast("long").alias("lo"), F.lit(7).cast("long").alias("hi"))
    return N.self_claims(lines, held, letters)
