"""Published minutes: outcome sentences by a fold over a document's lines, and what they dispose of.

One fold over a document's lines, in Arrow batches, carries the item at hand and the sentence that is still open, as lines wrap and the
next item may begin before a sentence has ended.  Documents are rows, so that the work is dealt by document; a fold's state is the
document's own sentences.  What a line is, is found once for lines that come again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rostrum.functions import text as T

# How lines begin, what is furniture, codes, and which section a sentence names.
ITEM = r"^([A-Z]{1,3})\s?-?\s?(\d{1,3})\s+(\S.*)$"
HEADING = r"^[A-Z]{1,3}\s?-?\s?\d{1,3}\s+(?:[^a-z\s]|$)"
FIELD = r"(?i)^(File\s*Number|Me\s?m\w*|Comm\.?\s*Dist\.?|Recommendation|Fiscal Impact|Contact)\b"
VERB = r"^(?:(?i:Approved|Adopted|Continued|Denied|Withdrawn|Tabled|Received|No action|Deferred|Postponed|Failed|Pulled|Heard))\b"
FURNITURE = r"(?i)^((BCC|PC)?\s*(Agenda|Minutes)?\s*Page \d+( of \d+)?|\d{1,3}\s+of\s+\d{1,3})\s*$"
OFFSET = r"\s*\(\d{1,2}:\d{2}(?::\d{2})?\)\s*$"
CODE = r"\b([A-Z]{1,3}\s?-?\s?\d{1,3})\b"
SECTIONS = (("public hearings", r"(?i)Public Hearing Consent|Rezoning Consent"), ("consent", r"(?i)\bConsent Agenda\b"))
SUBSIDIARY = (
    r"(?i)\breceive\s+and\s+filed?\b.*\b(?:submitted|presented)\s+by\b",
    r"(?i)\breceive\s+and\s+filed?\b.*\bfrom\s+(?:Mr|Ms|Mrs|Dr|Pastor)\b",
    r"(?i)\b(?:receive\s+and\s+file|accept)\s+(?:the\s+)?ex\s?parte'?\s+forms?\b",
    r"(?i)\bhear\s+(?:\w+\s+)*(?:emergenc|walk[\s-]?on|add[\s-]?on)",
    r"(?i)\bhear\s+the\s+item\s+as\s+a\s+regular\s+agenda\s+item",
    r"(?i)\bto\s+reconsider\s+the\s+item\b",
    r"(?i)\bto\s+adjourn\b",
)
INCLUDED = r"(?i)which included|included Agenda item"
EXCEPT = r"(?i)\bwith the exception\b|\bexcept\b"
TREATED, TREATMENT_ENDS = r"(?i)\bwhich (?:were|was)\b", r"(?i)\band Agenda\b|\band noted\b"

#: Lines of an open sentence at most.
MOST_LINES = 8
#: Lines whose kinds a task keeps, and documents that it folds at a time.
KNOWN, PART = 50_000, 1000


def code_of(text: Column) -> Column:
    """A code's letters and its number without leading zeros."""
    part = lambda i: F.regexp_extract(text, r"([A-Z]{1,3})\s?-?\s?(\d{1,3})", i)
    return F.concat(part(1), part(2).cast("int").cast("string"))


def codes_in(text: Column) -> Column:
    """The codes that a text names, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(CODE), F.lit(1)), code_of)


def section_of(text: Column) -> Column:
    """The section that a sentence disposes of, null if it names none."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(SECTIONS):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    return out


def subsidiary(text: Column) -> Column:
    """Whether a motion decides nothing about its item."""
    out = F.lit(False)
    for pattern in SUBSIDIARY:
        out = out | text.rlike(pattern)
    return out


def _python(pattern: str) -> re.Pattern:
    """A pattern of this module as Java reads it: classes of ASCII, and lines that end at the separators of Unicode too."""
    return re.compile(pattern.replace("$", r"(?=[\x85\u2028\u2029]?\Z)").replace(".*", r"[^\n\r\x85\u2028\u2029]*"), re.ASCII)


_BREAK, _BLANKS = re.compile(r"\r\n|\r|\n"), re.compile(r"\s{2,}", re.ASCII)
_ITEM, _HEADING, _FIELD, _VERB, _FURNITURE, _OFFSET = map(_python, (ITEM, HEADING, FIELD, VERB, FURNITURE, OFFSET))
_SECTIONS = [_python(p) for _, p in SECTIONS]


def _kind(raw: str) -> tuple | None:
    """line, its item's code and heading or none, field, begins, verb, bulk; nothing for furniture and empty lines."""
    x = _BLANKS.sub(" ", raw).strip(" ")
    if not x or _FURNITURE.search(x):
        return None
    item = _ITEM.search(x)
    own = (item[1] + str(int(item[2])), item[3]) if item else None
    verb = "A" <= x[0] <= "Z" and _VERB.search(x) is not None
    return x, own, _FIELD.search(x) is not None, _HEADING.search(x) is not None, verb, any(p.search(x) for p in _SECTIONS)


def _sentences_of(text: str | None, known: dict[str, tuple | None]) -> list[tuple]:
    """item, code, heading, sentence of a document, in order; ``known`` has the kinds of lines."""
    out: list[tuple] = []
    items, at, after, open_, target = 0, (None, None), False, [], None

    def close() -> None:
        out.append((target, *(at if target is not None else (None, None)), " ".join(open_)))

    for raw in _BREAK.split(text or ""):
        if raw not in known:
            if len(known) >= KNOWN:
                known.clear()
            known[raw] = _kind(raw)
        kind = known[raw]
        if kind is None:
            continue
        line, own, field, begins, verb, bulk = kind
        if open_:
            # an offset may be a line of its own, after the one that ends
            if len(open_) < MOST_LINES and not field and not begins and not _OFFSET.sub("", " ".join(open_[-2:]).rstrip(" ")).endswith("."):
                open_.append(line)
                continue
            close()
        open_, target = [], None
        if own:
            items, at, after = items + 1, own, False
        elif field:
            after = True
        elif verb:
            open_, target = [line], items if after and not bulk else None
    if open_:
        close()
    return out


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, tuple | None] = {}
    for b in batches:
        for first in range(0, b.num_rows, PART):
            part = b.slice(first, PART)
            found = [(row, no, *s) for row, text in enumerate(part.column(1).to_pylist()) for no, s in enumerate(_sentences_of(text, known))]
            row, no, item, code, heading, sentence = zip(*found, strict=True) if found else [()] * 6
            ids = part.column(0).take(pa.array(row, pa.int32()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(no, pa.int32()), pa.array(item, pa.int32()), *(pa.array(c, pa.string()) for c in (code, heading, sentence))], names=["id", "no", "item", "code", "heading", "sentence"])


def sentences(docs: DataFrame) -> DataFrame:
    """id, no, item, code, heading, sentence of the documents (id, text): the outcome sentences in order.

    ``item`` is the number of the item's occurrence in the document; it is null, with code and heading, for a sentence that names a section
    or that follows no item's fields.  A sentence begins with a capital verb of outcome; it takes up the lines after it until it ends
    with a full stop, an offset in brackets aside, until a field or the next item begins, or until it has ``MOST_LINES`` lines.
    """
    schema = f"id {docs.schema['id'].dataType.simpleString()}, no int, item int, code string, heading string, sentence string"
    return docs.select("id", "text").mapInArrow(_folded, schema)


def agreement(heading: Column, title: Column) -> Column:
    """How many words two texts begin with alike."""
    a, b = T.tokens(heading), T.tokens(title)
    both = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    differs = F.array_position(both, F.lit(False))
    return F.when(differs == 0, F.size(both)).otherwise(differs - 1).cast("int")


def chosen(found: DataFrame, items: DataFrame) -> DataFrame:
    """id, item_id, sentence, outcome: of each item's sentences the one that decides it.

    ``found`` as of ``sentences``, ``items`` (id, item_id, seq, code, section, title).  Subsidiary motions go; motions that name
    other published codes and not the item's own count only if there are no others; the last refusal is taken, or else the last.  An
    item that shares its code with others is the one whose title agrees in two words or more and in more than the next; else the first by seq.
    """
    codes = items.groupBy("id").agg(F.collect_set("code").alias("published"))  # a meeting's codes
    own = found.filter("item is not null").filter(~subsidiary(F.col("sentence"))).join(codes, "id")
    named = F.array_intersect(codes_in(F.col("sentence")), F.col("published"))
    other = (F.size(named) > 0) & ~F.array_contains(named, F.col("code"))
    outcome = T.outcome(F.col("sentence"))
    ranked = own.select("id", "item", "code", "heading", "no", "sentence", outcome.alias("outcome"), F.struct((~other).alias("own"), F.coalesce(outcome.isin("denied", "withdrawn"), F.lit(False)).alias("refused"), F.col("no")).alias("place"))
    best = ranked.groupBy("id", "item", "code", "heading").agg(F.max_by(F.struct("sentence", "outcome"), "place").alias("best"))
    agree = agreement(F.col("heading"), F.col("title"))
    pairs = best.join(items, ["id", "code"]).withColumn("agree", agree)
    w = Window.partitionBy("id", "item").orderBy(F.desc("agree"), "seq", "item_id")
    first = Window.partitionBy("id", "item").orderBy("seq", "item_id")
    pairs = pairs.withColumn("r", F.row_number().over(w)).withColumn("next", F.lead("agree").over(w)).withColumn("f", F.row_number().over(first))
    sure = F.max(F.when((F.col("r") == 1) & F.col("next").isNotNull(), (F.col("agree") >= 2) & (F.col("agree") > F.col("next")))).over(Window.partitionBy("id", "item"))
    taken = pairs.withColumn("sure", F.coalesce(sure, F.lit(False))).filter(F.when(F.col("sure"), F.col("r") == 1).otherwise(F.col("f") == 1))
    # a code that comes twice: the later occurrence stands
    last = Window.partitionBy("id", "item_id").orderBy(F.desc("item"))
    return taken.withColumn("l", F.row_number().over(last)).filter("l = 1").select("id", "item_id", "best.sentence", "best.outcome")


def disposed(bulk: DataFrame, items: DataFrame) -> DataFrame:
    """id, item_id, outcome, source: what sentences about a whole section (id, no, sentence) say of its items.

    A sentence that lists what it includes disposes of the listed items of its section.  Any other disposes of all of its section but for
    the codes that it names, and these are what the words after them say, each up to its own "which were"; what is pulled is
    left to its own line.  The first sentence that reaches an item counts; subsidiary motions reach none.
    """
    s = bulk.select("id", "no", "sentence", section_of(F.col("sentence")).alias("section")).filter(F.col("section").isNotNull() & ~subsidiary(F.col("sentence")))
    s = s.withColumn("named", F.array_distinct(codes_in(F.col("sentence")))).withColumn("listed", F.col("sentence").rlike(INCLUDED))
    lead = F.get(F.split("sentence", EXCEPT), F.lit(0))
    s = s.withColumn("lead", lead).withColumn("parts", F.split(F.substring(F.col("sentence"), F.length(lead) + 1, F.length("sentence")), TREATED))
    # a sentence's parts, each with the words that hold its codes and those that tell the outcome; the rest of the section has no code
    claim = lambda k, source, head, said: F.struct(k.alias("k"), F.lit(source).alias("source"), head.alias("head"), said.alias("said"))
    treatment = lambda i: F.trim(F.get(F.split(F.get(F.col("parts"), i + 1), TREATMENT_ENDS), F.lit(0)))
    told = F.when(F.size("parts") > 1, F.transform(F.sequence(F.lit(0), F.size("parts") - 2), lambda i: claim(i, "exception", F.get(F.col("parts"), i), treatment(i))))
    told = F.filter(told, lambda c: ~F.contains(F.lower(c["said"]), F.lit("pull")))
    rest = F.array(claim(F.lit(10**6), "consent", F.lit(None).cast("string"), F.col("lead")))
    claims = F.when(F.col("listed"), F.array(claim(F.lit(0), "included", F.col("sentence"), F.col("sentence")))).otherwise(F.when(F.size("parts") > 1, F.concat(told, rest)).otherwise(rest))
    s = s.select("id", "no", "section", "named", F.explode(claims).alias("c"))
    codes = F.when(F.col("c.source") == "consent", F.array(F.lit(None).cast("string"))).otherwise(F.array_distinct(codes_in(F.col("c.head"))))
    s = s.select("id", "no", "section", "named", "c.k", "c.source", T.outcome(F.col("c.said")).alias("outcome"), F.explode(codes).alias("told"))

    same = items.select("id", "item_id", "seq", "code", F.lower("section").alias("own"))
    reached = s.join(same, "id").filter(F.when(F.col("told").isNotNull(), F.col("told") == F.col("code")).otherwise((F.col("section") == F.col("own")) & ~F.array_contains("named", F.col("code"))))
    # a code of several items is the one in the section, or else the first
    by_code = Window.partitionBy("id", "no", "k", "told", "source", F.when(F.col("told").isNull(), F.col("item_id"))).orderBy(F.when(F.col("own") == F.col("section"), 0).otherwise(1), "seq", "item_id")
    every = reached.withColumn("r", F.row_number().over(by_code)).filter("told is null or r = 1 and (source = 'exception' or own = section)")
    w = Window.partitionBy("id", "item_id").orderBy("no", "k")
    return every.select("id", "item_id", "outcome", "source", F.row_number().over(w).alias("r")).filter("r = 1").drop("r")
