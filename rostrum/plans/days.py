"""A day's recordings as items: four conversations are a day, and some of their lines propose where an item begins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rostrum.functions import text as T
from rostrum.operators import segments as G
from rostrum.plans.registry import query

_SHAPE = "(length(p) >= 4 OR (regexp_matches(p, '^\\d+$') AND length(p) >= 2) OR (regexp_matches(p, '^[^a-z]*[A-Z][^a-z]*$') AND length(p) >= 2))"
_SUBJECT = f"(regexp_matches(p, '^[A-Za-z0-9'']+$') AND lower(p) NOT IN ({', '.join(repr(w) for w in G.GENERIC)}) AND {_SHAPE})"
_SPOKEN = "(contains(hay, lower(p)) OR (ends_with(lower(p), 's') AND contains(hay, lower(p)[1:length(p) - 1])))"
_DAYS = rf"""
lines AS (SELECT conv_id // 4 AS day, row_number() OVER (PARTITION BY conv_id // 4 ORDER BY conv_id, turn) - 1 AS line, conv_id AS rec, turn AS idx, text FROM conversations),
two AS (SELECT *, unnest([0, 1]) AS no FROM lines WHERE (rec + idx) % 3 = 1 AND day % 6 <> 5),
marks AS (SELECT day, line, no, CASE WHEN no = 1 THEN 'late' WHEN idx % 2 = 0 THEN 'consent' ELSE 'regular' END AS phase,
  CASE WHEN idx % 4 = 3 THEN NULL ELSE 'Public Hearing: ' || array_to_string(string_split(text, ' ')[1:3], ' ') || ' UNSAID zoning -' || CASE WHEN idx % 3 = 1 THEN ' X99 and R-0' || idx % 10 ELSE '' END END AS title, ' R' || idx AS code FROM two),
codes AS (SELECT DISTINCT day, 'R' || idx AS code FROM lines WHERE idx % 2 = 0 AND day % 6 <> 4),
n AS (SELECT day, count(*) AS n FROM lines GROUP BY 1),
best AS (SELECT * FROM marks QUALIFY row_number() OVER (PARTITION BY day, line ORDER BY no) = 1),
heads AS (SELECT n.day, 0 AS line, coalesce(phase, 'other') AS phase, title, code FROM n LEFT JOIN (SELECT * FROM best QUALIFY row_number() OVER (PARTITION BY day ORDER BY line) = 1) f ON f.day = n.day WHERE f.line IS NULL OR f.line > 0),
starts AS (SELECT day, line, phase, title, code FROM best UNION ALL SELECT * FROM heads),
spans AS (SELECT starts.*, coalesce(lead(line) OVER (PARTITION BY starts.day ORDER BY line), n) - 1 AS last FROM starts JOIN n USING (day)),
held AS (SELECT l.day, s.line, l.line AS pos, rec, idx, text FROM lines l JOIN spans s ON s.day = l.day AND l.line BETWEEN s.line AND s.last),
texts AS (SELECT day, line, regexp_replace(lower(string_agg(coalesce(text, ''), ' ' ORDER BY pos)), '[^a-z0-9'' ]+', ' ', 'g') AS hay FROM held GROUP BY 1, 2),
chunks AS (SELECT day, line, rec, min(pos) AS pos, min(idx) AS start_idx, max(idx) AS end_idx FROM held GROUP BY 1, 2, 3),
pieces AS (SELECT day, line, hay, regexp_extract_all(coalesce(title, ''), '([A-Za-z0-9'']+|[^A-Za-z0-9'']+)') AS ps FROM spans JOIN texts USING (day, line)),
ground AS (SELECT day, line, list_filter(ps, lambda p: {_SUBJECT}) AS own, list_filter(ps, lambda p: {_SUBJECT} AND {_SPOKEN}) AS kept,
  regexp_replace(trim(regexp_replace(array_to_string(list_transform(ps, lambda p: CASE WHEN {_SUBJECT} AND NOT {_SPOKEN} THEN '' ELSE p END), ''), '\s+', ' ', 'g')), '^[ ,/:;-]+|[ ,/:;-]+$', '', 'g') AS rest FROM pieces),
told AS (SELECT day, line, CASE WHEN len(kept) >= 2 THEN rest END AS search_title, CASE WHEN len(own) > 0 THEN len(kept) / len(own) ELSE 0 END AS coverage FROM ground),
segs AS (SELECT c.day, c.line, c.rec, row_number() OVER (PARTITION BY c.day, c.line ORDER BY c.pos) - 1 AS part, row_number() OVER (PARTITION BY c.day, c.rec ORDER BY c.pos) - 1 AS seq, start_idx, end_idx, s.phase, s.title, codes.code, search_title, coverage
  FROM chunks c JOIN spans s USING (day, line) JOIN told USING (day, line) LEFT JOIN codes ON codes.day = c.day AND codes.code = trim(s.code)),
found AS (SELECT day, rec, seq, unnest(list_transform(regexp_extract_all(coalesce(title, ''), '{G.CODE}'), lambda c: regexp_extract(c, '[A-Z]+') || regexp_extract(c, '\d+')::INT)) AS code, unnest(range(len(regexp_extract_all(coalesce(title, ''), '{G.CODE}')))) AS k FROM segs),
reads AS (SELECT rec, seq, arg_min(code, k) AS code FROM found JOIN codes USING (day, code) GROUP BY 1, 2)"""


def day_lines(t):
    c = t("conversations")
    day = F.floor(F.col("conv_id") / 4)
    w = Window.partitionBy(day).orderBy("conv_id", "turn")
    return c.select(day.alias("day"), (F.row_number().over(w) - 1).cast("long").alias("line"), F.col("conv_id").alias("rec"), F.col("turn").alias("idx"), "text")


def proposals(lines):
    i = F.col("idx")
    marks = lines.filter("(rec + idx) % 3 = 1 and day % 6 <> 5").withColumn("no", F.explode(F.array(F.lit(0), F.lit(1))))
    tail = F.when(i % 3 == 1, F.concat(F.lit(" X99 and R-0"), i % 10)).otherwise("")
    title = F.concat(F.lit("Public Hearing: "), F.array_join(F.slice(F.split("text", " "), 1, 3), " "), F.lit(" UNSAID zoning -"), tail)
    phase = F.when(F.col("no") == 1, "late").when(i % 2 == 0, "consent").otherwise("regular")
    return marks.select("day", "line", "no", phase.alias("phase"), F.when(i % 4 != 3, title).alias("title"), F.concat(F.lit(" R"), i).alias("code"))


def published(lines):
    return lines.filter("idx % 2 = 0 and day % 6 <> 4").select("day", F.concat(F.lit("R"), "idx").alias("code")).distinct()


def _segments(t):
    lines = day_lines(t)
    return G.assembled(lines, proposals(lines), published(lines))


@query("T25_segment_assembly", f"WITH {_DAYS} SELECT day, line, rec, part, seq, start_idx, end_idx, phase, title, code FROM segs")
def assembly(t):
    """Spans of a day from proposed boundaries, split by recording, with codes of the day's list only."""
    return _segments(t).drop("search_title", "coverage")


@query("T24_title_grounding", f"WITH {_DAYS} SELECT day, line, search_title, round(coverage, 6) AS coverage FROM told")
def grounding(t):
    """Titles without the subject words that their span doesn't say."""
    return _segments(t).filter("part = 0").select("day", "line", "search_title", F.round("coverage", 6).alias("coverage"))


@query("T22_code_in_title", f"WITH {_DAYS} SELECT rec, seq, code FROM reads")
def code_in_title(t):
    """The first code in a segment's title that is published for its day."""
    return G.code_in(_segments(t), published(day_lines(t)), ["rec", "seq"])


@query("Z2_span_binding", f"""WITH {_DAYS},
pub AS (SELECT day, code, substr(code, 2)::BIGINT AS seq, day * 1000 + substr(code, 2)::BIGINT AS item_id FROM codes), lists AS (SELECT day, max(seq) AS last, count(*) AS codes FROM pub GROUP BY 1),
b AS (SELECT s.day, s.rec, s.seq, coalesce(a.item_id, o.item_id) AS item_id FROM segs s LEFT JOIN pub a ON a.day = s.day AND a.code = s.code LEFT JOIN reads r ON r.rec = s.rec AND r.seq = s.seq LEFT JOIN pub o ON o.day = s.day AND o.code = r.code)
SELECT b.*, CASE WHEN item_id IS NULL THEN coalesce(last, -1) + row_number() OVER (PARTITION BY b.day, item_id IS NULL ORDER BY rec, seq) END AS new_seq, CASE WHEN item_id IS NOT NULL THEN 'bound' WHEN codes IS NULL THEN 'phase' ELSE 'unmatched' END AS kind FROM b LEFT JOIN lists ON lists.day = b.day""")
def binding(t):
    """The published item of each segment by its code or its title's, or a new one."""
    seq = F.substring("code", 2, 9).cast("long")
    items = published(day_lines(t)).select("day", "code", seq.alias("seq"), (F.col("day") * 1000 + seq).alias("item_id"))
    return G.bound(_segments(t), items)


@query("T48_quote_around_match", r"""
WITH m AS (SELECT doc_id, text, regexp_extract(text, '(?s)^(.*?)(\bthis\b)', 1) AS b FROM documents WHERE regexp_matches(text, '\bthis\b')),
q AS (SELECT doc_id, b, regexp_replace(regexp_extract(b, '(?s)([^.]*)$', 1) || 'this' || regexp_extract(substr(text, length(b) + 5), '(?s)^([^.]*\.?)', 1), '^\s+|\s+$', '', 'g') AS w FROM m)
SELECT doc_id, CASE WHEN NOT contains(b, '.') AND regexp_matches(w, '^\p{Ll}') THEN '…' ELSE '' END || CASE WHEN length(w) > 240 THEN regexp_replace(w[1:240], '\s+$', '') || '…' ELSE w END AS quote FROM q""")
def quotes(t):
    """The sentence around a word, at most 240 characters of it."""
    return t("documents").filter(F.col("text").rlike(r"\bthis\b")).select("doc_id", T.quote(F.col("text"), r"\bthis\b").alias("quote"))
