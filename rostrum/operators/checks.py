"""Checks of derived tables: each returns the rows that violate it, and none where all is well."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def drift(stored: DataFrame, fresh: DataFrame, key: list[str], values: list[str] | None = None) -> DataFrame:
    """key, state: 'missing' in ``stored``, 'extra' there, or 'changed' in a value; a key is unique on each side."""
    of = lambda df, name: df.select(*key, F.struct(F.lit(1).alias("_there"), *(values or [])).alias(name))
    both = of(stored, "_was").join(of(fresh, "_now"), key, "full")
    state = F.when(F.col("_was").isNull(), "missing").when(F.col("_now").isNull(), "extra").when(F.col("_was") != F.col("_now"), "changed")
    return both.withColumn("state", state).filter("state is not null").select(*key, "state")


def disagreeing(lines: DataFrame, spans: DataFrame, key: list[str], idx: str, start: str, end: str, of_line: str, of_span: str) -> DataFrame:
    """key, start, end, span's value, lines_off: spans whose value isn't that of all their lines; two nulls agree."""
    other = lines.select(*key, F.col(idx).alias("_at"), F.col(of_line).alias("_line"))
    held = spans.join(other, key).filter(F.col("_at").between(F.col(start), F.col(end)))
    off = F.count_if(~F.col("_line").eqNullSafe(F.col(of_span))).alias("lines_off")
    return held.groupBy(*key, start, end, of_span).agg(off).filter("lines_off > 0")


# Titles before a name, and roles that name nobody.
HONORIFICS = "mayor chair councilmember commissioner supervisor president director doctor dr mr mrs ms".split()
VAGUE_ROLES = "speaker clerk staff caller resident applicant secretary unknown".split()


def folded_name(name: Column) -> Column:
    """A name in lower case without leading honorifics and "the"."""
    lead = rf"^(?:(?:the|{'|'.join(HONORIFICS)})\b\.?\s*)+"
    return F.trim(F.regexp_replace(F.lower(F.trim(name)), lead, ""))


def quoted_names(claims: DataFrame, lines: DataFrame, known: DataFrame, key: list[str], text: str, shortest: int = 12, sure: float = 0.7) -> DataFrame:
    """key, name: claims (name, quote, confidence) that hold up, under the known spelling of their name.

    The quote stands verbatim in its line and has ``shortest`` characters, the confidence is ``sure`` or more, and the
    name isn't a role that names nobody.  ``known`` has one row for each folded name: folded, spelling.
    """
    held = claims.join(lines.select(*key, F.col(text).alias("_text")), key).withColumn("folded", folded_name(F.col("name")))
    good = held.filter((F.length("quote") >= shortest) & F.contains("_text", "quote") & (F.col("confidence") >= sure))
    good = good.filter(~F.col("folded").isin(*VAGUE_ROLES) & (F.col("folded") != ""))
    return good.join(known, "folded", "left").select(*key, F.coalesce("spelling", F.trim("name")).alias("name"))


def continuation(rows: DataFrame, first: Column, keep: list[str]) -> DataFrame:
    """Rows in which only the columns ``keep`` have values, but on the first page."""
    return rows.select(*[F.col(c) if c in keep else F.when(first, F.col(c)).alias(c) for c in rows.columns])


def tiling(spans: DataFrame, key: list[str], start: str, end: str) -> DataFrame:
    """key, start, end, issue: spans of a key that end before they start ('unordered'), share an index with an earlier one ('overlap') or leave one out before them ('hole')."""
    earlier = Window.partitionBy(*key).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    s, e, upto = F.col(start), F.col(end), F.max(end).over(earlier)
    issues = F.array(F.when(e < s, "unordered"), F.when(s <= upto, "overlap"), F.when(s > upto + 1, "hole"))
    return spans.withColumn("issues", F.array_compact(issues)).select(*key, start, end, F.explode("issues").alias("issue"))


def redaction_issues(applied: DataFrame, lines: DataFrame, key: list[str], raw: str, published: str, shortest: int = 3, longest: int = 40) -> DataFrame:
    """key, issue: applied redactions (span, before) that are still shown, that their raw line lacks, whose span is no plausible one, or whose raw line has changed since."""
    j = applied.join(lines.select(*key, F.col(raw).alias("_raw"), F.col(published).alias("_published")), key)
    size = F.length("span")
    found = F.array(
        F.when(F.contains("_published", "span"), "gone_from_transcript"),
        F.when(~F.contains("_raw", "span"), "unfindable"),
        F.when((size < shortest) | (size > longest), "span_is_plausible"),
        F.when(~F.col("before").eqNullSafe(F.col("_raw")), "raw_preserved"),
    )
    return j.select(*key, F.explode(F.array_compact(found)).alias("issue"))
