"""Minutes and their dispositions: documents composed of the line items of each order, read again by the parser."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rostrum.operators import minutes as M
from rostrum.plans.registry import query

# The outcome lines that stand under an item, by the part: whole sentences, wrapped ones, ones without an end, subsidiary motions, fragments,
# more lines than a sentence may have, motions over the consent agenda, and furniture inside of a sentence.
_OUTCOMES = [
    "Approved the item.",
    "Approved to continue the item\nto a later day (1:02:03)\nwith   staff. (12:30)\nNot a part.",
    "Denied the petition (0:15)",
    "Approved to receive and file documents submitted by staff.",
    "Approved\n" + "\n".join(f"line {i} of many" for i in range(1, 11)),
    "withdrawn.",
    "Approved the Consent Agenda with the exception of C-1 and C 3,\nwhich were withdrawn, C02 which was pulled and noted, C4 which were denied.",
    "Adopted the ordinance as\nPage 3 of 17\n4 of 17\namended.\nTabled the rest.",
    "Approved the Rezoning Consent which included P1, P2 and C1.",
    "Continued the item\nC9 is named in a wrapped line\nFiscal Impact: none\nAdopted.",
]
_ORDER = "l_linenumber, l_partkey, l_linestatus, l_returnflag"
_VALUES = ", ".join("'" + x.replace("\n", "' || chr(10) || '") + "'" for x in _OUTCOMES)
_DOCS = f"""
rows AS (SELECT l_orderkey AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ORDER}) AS seq, CASE l_linestatus WHEN 'O' THEN 'C' WHEN 'F' THEN 'P' ELSE 'R' END || l_linenumber AS code,
  CASE l_linestatus WHEN 'O' THEN 'Consent' WHEN 'F' THEN 'Public Hearings' ELSE 'Regular' END AS section, 'ITEM ' || l_partkey % 3 || ' of ' || l_returnflag AS title, l_linenumber, l_partkey FROM lineitem),
docs AS (SELECT id, string_agg(code || ' ' || title || chr(10) || CASE WHEN l_linenumber % 5 = 0 THEN '' ELSE 'Recommendation: adopt' || chr(10) END || [{_VALUES}][l_partkey % {len(_OUTCOMES)} + 1], chr(10) ORDER BY seq) AS text FROM rows GROUP BY 1)"""


def items(t):
    """id, item_id, seq, code, section, title, and the lines of each item's part of the minutes."""
    status = lambda o, f, other: F.when(F.col("l_linestatus") == "O", o).when(F.col("l_linestatus") == "F", f).otherwise(other)
    seq = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*_ORDER.split(", ")))
    part = F.col("l_partkey").cast("int") % len(_OUTCOMES)
    body = F.get(F.array(*[F.lit(x) for x in _OUTCOMES]), part)
    field = F.when(F.col("l_linenumber") % 5 == 0, "").otherwise("Recommendation: adopt\n")
    rows = t("lineitem").select(F.col("l_orderkey").alias("id"), seq.alias("seq"), F.concat(status("C", "P", "R"), "l_linenumber").alias("code"), status("Consent", "Public Hearings", "Regular").alias("section"), F.concat(F.lit("ITEM "), F.col("l_partkey") % 3, F.lit(" of "), F.col("l_returnflag")).alias("title"), F.concat(field, body).alias("body"))
    return rows.withColumn("item_id", F.col("id") * 100 + F.col("seq"))


def documents(t):
    """id, text: the minutes of each order."""
    part = F.concat("code", F.lit(" "), "title", F.lit("\n"), "body")
    return items(t).groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", part.alias("part")))), lambda x: x["part"]), "\n").alias("text"))


_BULK = "regexp_matches(x, '(?i)Public Hearing Consent|Rezoning Consent|\\bConsent Agenda\\b')"
_PARSED = rf"""
lines AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY k) AS i, x FROM (SELECT id, k, trim(regexp_replace(x, '\s{{2,}}', ' ', 'g')) AS x FROM (SELECT id, unnest(string_split(text, chr(10))) AS x, unnest(range(len(string_split(text, chr(10))))) AS k FROM docs))
  WHERE x <> '' AND NOT regexp_matches(x, '{M.FURNITURE}')),
kinds AS (SELECT *, regexp_matches(x, '{M.ITEM}') AS item, regexp_extract(x, '{M.ITEM}', 1) || regexp_extract(x, '{M.ITEM}', 2) AS c, regexp_extract(x, '{M.ITEM}', 3) AS h, regexp_matches(x, '{M.FIELD}') AS field, regexp_matches(x, '{M.HEADING}') AS begins,
  regexp_matches(x, '{M.VERB}') AND regexp_matches(x, '^[A-Z]') AS verb, {_BULK} AS bulk FROM lines),
run(id, i, items, code, heading, after, open, n, target, out_item, out_code, out_heading, out) AS (
  SELECT id, 0, 0, NULL::VARCHAR, NULL::VARCHAR, false, '', 0, NULL::INT, NULL::INT, NULL::VARCHAR, NULL::VARCHAR, NULL::VARCHAR FROM docs
  UNION ALL
  SELECT id, i + 1, CASE WHEN NOT takes AND item THEN items + 1 ELSE items END, CASE WHEN NOT takes AND item THEN c ELSE code END, CASE WHEN NOT takes AND item THEN h ELSE heading END,
    CASE WHEN takes THEN after WHEN item THEN false WHEN field THEN true ELSE after END, CASE WHEN takes THEN open || ' ' || x WHEN starts THEN x ELSE '' END, CASE WHEN takes THEN n + 1 WHEN starts THEN 1 ELSE 0 END,
    CASE WHEN takes THEN target WHEN starts AND NOT bulk AND after THEN items END, CASE WHEN n > 0 AND NOT takes THEN target END, CASE WHEN n > 0 AND NOT takes AND target IS NOT NULL THEN code END,
    CASE WHEN n > 0 AND NOT takes AND target IS NOT NULL THEN heading END, CASE WHEN n > 0 AND NOT takes THEN open END
  FROM (SELECT *, coalesce(NOT takes AND NOT item AND NOT field AND verb, false) AS starts FROM (
    SELECT run.*, kinds.x, kinds.item, kinds.c, kinds.h, kinds.field, kinds.verb, kinds.bulk,
      coalesce(n > 0 AND NOT ends_with(regexp_replace(rtrim(open), '{M.OFFSET}', ''), '.') AND n < {M.MOST_LINES} AND NOT kinds.field AND NOT kinds.begins, false) AS takes
    FROM run LEFT JOIN kinds ON kinds.id = run.id AND kinds.i = run.i + 1 WHERE kinds.id IS NOT NULL OR run.n > 0))),
found AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY i) - 1 AS no, out_item AS item, out_code AS code, out_heading AS heading, out AS sentence FROM run WHERE out IS NOT NULL)"""


@query("T14_minutes_sentences", f"""WITH RECURSIVE {_DOCS}, {_PARSED}
SELECT * FROM found""")
def sentences(t):
    """The outcome sentences of minutes, each with the item it stands under."""
    return M.sentences(documents(t))


_CODES = r"list_transform(regexp_extract_all({}, '\b([A-Z]{{1,3}}\s?-?\s?\d{{1,3}})\b', 1), lambda c: regexp_extract(c, '[A-Z]+') || regexp_extract(c, '\d+')::INT)"


def _outcome_sql(x):
    from rostrum.functions.text import OUTCOME_RULES

    return f"CASE WHEN {x} IS NULL OR trim({x}) = '' THEN NULL " + " ".join(f"WHEN regexp_matches({x}, '{p}') THEN '{n}'" for n, p in OUTCOME_RULES) + " ELSE 'other' END"


_SUB = " OR ".join("regexp_matches(sentence, '{}')".format(p.replace("'", "''")) for p in M.SUBSIDIARY)
_EXCEPTION = r"'(?i)\bwith the exception\b|\bexcept\b'"


@query("T18_bulk_disposition", rf"""WITH RECURSIVE {_DOCS}, {_PARSED},
s AS (SELECT id, no, sentence, CASE WHEN regexp_matches(sentence, '(?i)Public Hearing Consent|Rezoning Consent') THEN 'public hearings' ELSE 'consent' END AS section, {_CODES.format('sentence')} AS named,
  regexp_matches(sentence, '{M.INCLUDED}') AS listed, string_split_regex(sentence, {_EXCEPTION})[1] AS lead
  FROM found WHERE item IS NULL AND regexp_matches(sentence, '(?i)Public Hearing Consent|Rezoning Consent|\bConsent Agenda\b') AND NOT ({_SUB})),
p AS (SELECT *, string_split_regex(substr(sentence, length(lead) + 1), '{M.TREATED}') AS parts FROM s WHERE NOT listed),
g AS (SELECT id, no, section, k, parts[k] AS head, string_split_regex(parts[k + 1], '{M.TREATMENT_ENDS}')[1] AS treatment FROM (SELECT *, unnest(range(1, len(parts))) AS k FROM p)),
a AS (SELECT id, no, section, unnest(list_distinct(named)) AS code, {_outcome_sql('sentence')} AS outcome, 'included' AS source, 0 AS k FROM s WHERE listed
  UNION ALL SELECT id, no, section, unnest(list_distinct({_CODES.format('head')})), {_outcome_sql('trim(treatment)')}, 'exception', k FROM g WHERE NOT contains(lower(treatment), 'pull')),
own AS (SELECT id, id * 100 + seq AS item_id, seq, code, lower(section) AS own FROM rows),
picked AS (SELECT a.*, item_id, own FROM a JOIN own USING (id, code) QUALIFY row_number() OVER (PARTITION BY id, no, k, code, source ORDER BY CASE WHEN own = section THEN 0 ELSE 1 END, seq, item_id) = 1),
every AS (SELECT id, no, item_id, outcome, source, k FROM picked WHERE source = 'exception' OR own = section
  UNION ALL SELECT s.id, no, item_id, {_outcome_sql('lead')}, 'consent', 1000000 FROM s JOIN own ON own.id = s.id AND own.own = s.section AND NOT list_contains(named, own.code) WHERE NOT listed)
SELECT id, item_id, outcome, source FROM every QUALIFY row_number() OVER (PARTITION BY id, item_id ORDER BY no, k) = 1""")
def bulk(t):
    """What motions over a whole section say of its items, with their exceptions and lists."""
    found = M.sentences(documents(t))
    return M.disposed(found.filter("item is null"), items(t))
