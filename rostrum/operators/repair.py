"""Parts of a transcript that are made again: what lies in a gap goes, and what was heard there now takes its place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Seconds by which a gap reaches over its ends, and of a block of time.
EDGE, BLOCK = 0.75, 600.0


def _middle() -> Column:
    return (F.col("start") + F.col("end")) / 2


def _inside(rows: DataFrame, gaps: DataFrame, key: str, how: str) -> DataFrame:
    """``rows`` whose middle is, or isn't, in a gap of their recording; both meet by blocks of time."""
    block = lambda c: F.floor(c / BLOCK)
    low, high = F.col("start") - EDGE, F.col("end") + EDGE
    spread = gaps.select(F.col(key).alias("_k"), low.alias("_lo"), high.alias("_hi"), F.explode(F.sequence(block(low), block(high))).alias("_b"))
    placed = rows.withColumn("_m", _middle()).withColumn("_at", block(F.col("_m")))
    on = (F.col(key) == F.col("_k")) & (F.col("_at") == F.col("_b")) & F.col("_m").between(F.col("_lo"), F.col("_hi"))
    return placed.join(spread, on, how).drop("_m", "_at")


def heard_again(new: DataFrame, gaps: DataFrame, key: str) -> DataFrame:
    """The new rows (gap, start, end) whose middle is in their own gap (gap, start, end)."""
    own = gaps.select(key, "gap", (F.col("start") - EDGE).alias("_lo"), (F.col("end") + EDGE).alias("_hi"))
    return new.join(own, [key, "gap"]).filter(_middle().between(F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")


def swapped(words: DataFrame, segments: DataFrame, new_words: DataFrame, new_segments: DataFrame, gaps: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Words and segments (key, start, end, ...) after the gaps (key, gap, start, end) in which words were heard again.

    A gap without a new word changes nothing, its new segments included.  New rows have the columns of the old ones and ``gap``.
    """
    got = heard_again(new_words, gaps, key)
    active = gaps.join(got.select(key, "gap").distinct(), [key, "gap"], "left_semi")
    of = lambda old, new: _inside(old, active, key, "left_anti").unionByName(new.drop("gap"))
    return of(words, got), of(segments, heard_again(new_segments, active, key))
