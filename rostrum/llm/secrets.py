"""Secret scans through a trigram inverted index.

From each rule's regular expression a Boolean query over lower-case trigrams is derived: an
OR of ANDs that every match must satisfy.  ``postings`` is the inverted index, restricted
to the trigrams that the rules ask for; ``candidates`` intersects the postings of each
conjunction; ``scan`` verifies the rule's regular expression on the whole text of its
candidates only.  A rule without mandatory trigrams has no query and scans every text.

All of it is DataFrame functions.  The candidate table is narrow (an id and rule names); it
is broadcast when a count shows that it is below ``BROADCAST_ROWS``, and joined by a
shuffle beyond that.  Spans are code points, end exclusive, leftmost and non-overlapping
within a rule: the gaps between matches (``split``) and the matches (``regexp_extract_all``)
give the positions.

Edge cases: null text counts as empty and has no spans; a null id is a key like any other;
rows with the same id share candidates, which verification settles; an empty table gives
an empty result; extra columns stay as they are, whatever their names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rostrum.llm import shared

#: Candidate rows up to which they are broadcast (about 50 bytes each).
BROADCAST_ROWS = 1_000_000
#: Strings at most that a part of a pattern is expanded to.
MAX_STRINGS = 64


@dataclass(frozen=True)
class Rule:
    name: str
    pattern: str  # Java and Python syntax alike
    least: int = 0  # characters at least of the group
    group: int = 0


# The kinds of secrets and their patterns.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("hosted", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("webtoken", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*"),
)
RULES = BASE + MORE


# --- Boolean trigram queries ----------------------------------------------------------


Query = frozenset  # of frozensets of trigrams: an OR of ANDs; the empty AND is "anything"
ANY: Query = frozenset([frozenset()])


def _least(q: Query) -> Query:
    """Without conjunctions that another one implies."""
    return frozenset(c for c in q if not any(d < c for d in q))


def _both(a: Query, b: Query) -> Query:
    out = _least(frozenset(x | y for x, y in product(a, b)))
    return out if len(out) <= MAX_STRINGS else a


def _of(strings: set[str]) -> Query:
    return _least(frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings))


def trigram_query(pattern: str) -> Query:
    """The OR of ANDs of lower-case trigrams that every match of ``pattern`` contains."""
    from re import _parser

    def walk(items) -> tuple[set[str] | None, Query]:
        """All strings that the sequence matches, if few; and its query."""
        run: set[str] | None = {""}  # the strings that the part since the last gap matches
        whole, query = True, ANY
        for op, arg in items:
            own, own_query = one(str(op), arg)
            if own is not None and len(run) * len(own) <= MAX_STRINGS:
                run = {a + b for a in run for b in own}
                continue
            query = _both(_both(query, _of(run)), own_query if own is None else ANY)
            run, whole = (own if own is not None else {""}), False
        return (run, _of(run)) if whole else (None, _both(query, _of(run)))

    def one(op: str, arg) -> tuple[set[str] | None, Query]:
        if op == "LITERAL":
            return {chr(arg).lower()}, ANY
        if op == "IN":
            chars: set[str] = set()
            for kind, x in arg:
                if str(kind) == "LITERAL":
                    chars.add(chr(x).lower())
                elif str(kind) == "RANGE" and x[1] - x[0] < 10:
                    chars |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
                else:
                    return None, ANY
            return (chars, ANY) if len(chars) <= 10 else (None, ANY)
        if op == "SUBPATTERN":
            return walk(arg[-1])
        if op == "BRANCH":
            parts = [walk(x) for x in arg[1]]
            if all(s is not None for s, _ in parts):
                return set().union(*(s for s, _ in parts)), ANY
            return None, _least(frozenset().union(*(q for _, q in parts)))
        if op in ("MAX_REPEAT", "MIN_REPEAT"):
            low, high, item = arg
            strings, q = walk(item)
            if strings is not None and (low, high) == (0, 1):
                return strings | {""}, ANY
            if strings is not None and low == high == 1:
                return strings, ANY
            return None, (q if low else ANY)
        if op in ("AT", "ASSERT", "ASSERT_NOT"):
            return {""}, ANY
        return None, ANY

    return walk(_parser.parse(pattern, re.ASCII))[1]


# --- index, candidates, verification ------------------------------------------------------


def _key() -> Column:
    return F.coalesce(F.col("doc_id").cast("string"), F.lit(""))


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """The inverted index for ``trigrams``: a row (trigram, key) for each text that holds one."""
    low = F.lower(F.col("text"))
    held = F.filter(F.array(*[F.lit(t) for t in trigrams]), lambda t: F.contains(F.col("low"), t))
    return docs.select(_key().alias("key"), low.alias("low")).select("key", F.explode(held).alias("trigram"))


def candidates(index: DataFrame, queries: dict[str, Query]) -> DataFrame:
    """Rows (key, rules): the rules whose trigram query the postings of the key satisfy."""
    sets = index.groupBy("key").agg(F.collect_set("trigram").alias("held"))  # no more than the trigrams asked for

    def holds(q: Query) -> Column:
        ways = [F.size(F.array_intersect("held", F.array(*[F.lit(t) for t in sorted(c)]))) == len(c) for c in sorted(q, key=sorted)]
        out = ways[0]
        for w in ways[1:]:
            out = out | w
        return out

    rules = F.array_compact(F.array(*[F.when(holds(q), F.lit(name)) for name, q in queries.items()]))
    return sets.select("key", rules.alias("rules")).filter(F.size("rules") > 0)


def _spans(rule: Rule, no: int, text: Column) -> Column:
    """The rule's spans in a text: array of (start, no, end), start and end in code points."""
    if rule.group:
        found = F.arrays_zip(
            F.split(text, rule.pattern, -1).alias("gap"),
            F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)).alias("m"),
            F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)).alias("g"),
        )
    else:
        whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
        found = F.arrays_zip(F.split(text, rule.pattern, -1).alias("gap"), whole.alias("m"), whole.alias("g"))
    none = F.array().cast("array<struct<start:int,no:int,end:int>>")

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + F.char_length(x["gap"])
        end = start + F.char_length(x["m"])
        hit = F.struct(start.alias("start"), F.lit(no).alias("no"), end.alias("end"))
        return F.struct(
            F.coalesce(end, state["at"]).alias("at"),
            F.when(F.char_length(x["g"]) >= max(rule.least, 1), F.concat(state["out"], F.array(hit))).otherwise(state["out"]).alias("out"),
        )

    all_of = F.aggregate(found, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda s: s["out"])
    return F.when(F.regexp_like(text, F.lit(rule.pattern)), all_of).otherwise(none)


def _found(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """row (all columns of ``docs``), text and hits; names of the input can't clash with these."""
    queries = {r.name: q for r in rules if frozenset() not in (q := trigram_query(r.pattern))}
    none = F.array().cast("array<struct<start:int,no:int,end:int>>")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce("text", F.lit("")).alias("text"), _key().alias("key"))
    if queries:
        index = postings(docs, sorted({t for q in queries.values() for c in q for t in c}))
        able, _ = shared.stage(candidates(index, queries), "secret-candidates")
        few = able.count() <= BROADCAST_ROWS
        rows = rows.join(F.broadcast(able) if few else able, "key", "left")
    spans = [_spans(r, i, F.col("text")) for i, r in enumerate(rules)]
    parts = [F.when(F.array_contains("rules", r.name), own).otherwise(none) if r.name in queries else own for r, own in zip(rules, spans, strict=True)]
    return rows.select("row", "text", F.array_sort(F.concat(*parts)).alias("hits"))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, name: str = "hits") -> DataFrame:
    """``docs`` with the column ``name``, in the place of one so called: array of (start, no, end) sorted, ``no`` the rule's place in ``rules``."""
    kept = [F.col("row")[c].alias(c) for c in docs.columns if c != name]
    return _found(docs, rules).select(*kept, F.col("hits").alias(name))


def listed(hits: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """kind:start:end of each hit, comma-joined."""
    names = F.array(*[F.lit(r.name) for r in rules])
    return F.array_join(F.transform(hits, lambda h: F.concat_ws(":", F.get(names, h["no"]), h["start"].cast("string"), h["end"].cast("string"))), ",")


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, marker: str = "[secret]") -> DataFrame:
    """``docs`` with the spans that ``scan`` finds replaced by ``marker``; spans that overlap become one.

    All other columns are as they were, whatever their names.
    """
    text = F.col("text")

    def step(state: Column, h: Column) -> Column:
        fresh = h["start"] >= state["at"]
        piece = F.substring(text, state["at"] + 1, h["start"] - state["at"])
        return F.struct(
            F.greatest(state["at"], h["end"]).alias("at"),
            F.when(fresh, F.concat(state["out"], piece, F.lit(marker))).otherwise(state["out"]).alias("out"),
        )

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    whole = F.aggregate("hits", start, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.char_length(text))))
    own = F.col("row")["text"]
    clean = F.when(F.size("hits") > 0, whole).otherwise(own)
    return _found(docs, rules).select(*[(clean if c == "text" else F.col("row")[c]).alias(c) for c in docs.columns])
