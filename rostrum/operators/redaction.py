"""Reversible redaction: candidates, protected spans, verification, republication from raw text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARKER = "[redacted]"


def candidates(rows: DataFrame, text: str, patterns: list[str]) -> DataFrame:
    """Rows whose text holds any of the patterns."""
    return rows.filter(F.col(text).rlike("|".join(f"(?:{p})" for p in patterns)))


def protected(rows: DataFrame, published: DataFrame, id_: str, text: str, pattern: str) -> DataFrame:
    """id, found, skip: a line is skipped only if every address in it is published."""
    found = lambda df: df.select(id_, F.explode(F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))).alias("a"))
    known = found(published).select("a").distinct().withColumn("known", F.lit(True))
    held = found(rows).join(known, "a", "left")
    return held.groupBy(id_).agg(F.count("*").alias("found"), F.bool_and(F.coalesce("known", F.lit(False))).alias("skip"))


def verified(spans: DataFrame, lines: DataFrame, key: list[str], idx: str, text: str) -> DataFrame:
    """key, idx, line: the span's own line if it holds it, else the only line that does, else null; spans in no line go."""
    others = lines.select(*key, F.col(idx).alias("_at"), F.col(text).alias("_text"))
    hits = spans.filter(F.length("span") > 0).join(others, key).filter(F.contains("_text", "span"))
    own = F.bool_or(F.col("_at") == F.col(idx))
    line = F.when(own, F.col(idx)).when(F.count("*") == 1, F.min("_at"))
    return hits.groupBy(*key, idx, "span").agg(line.alias("line")).drop("span")


def republished(lines: DataFrame, spans: DataFrame, key: list[str], raw: str, order: str, span: str, marker: str = MARKER) -> DataFrame:
    """Lines with ``published``: the raw text with each applied span replaced, in the order of the spans."""
    all_of = spans.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(order, span))).alias("_s"))
    replaced = F.aggregate(F.coalesce("_s", F.array().cast(all_of.schema["_s"].dataType)), F.col(raw), lambda t, s: F.replace(t, s[span], F.lit(marker)))
    return lines.join(all_of, key, "left").withColumn("published", replaced).drop("_s")


def stranded(lines: DataFrame, spans: DataFrame, key: list[str], published: str, span: str) -> DataFrame:
    """Applied spans that their published line still shows."""
    return spans.join(lines, key).filter(F.contains(published, span)).select(*key, span)
