"""Interval and run operators over ordered sequences.

All of them partition by a key (a recording) and order inside it; interval joins are equi-joins
on the key with a residual range condition, so that adaptive execution can split a hot key.
Both ends of an index interval are inclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rostrum.operators import places


def islands(rows: DataFrame, key: list[str], idx: str) -> DataFrame:
    """Runs of consecutive ``idx`` per key: key, start_idx, end_idx, n."""
    w = Window.partitionBy(*key).orderBy(idx)
    grouped = rows.select(*key, idx).distinct().withColumn("_run", F.col(idx) - F.row_number().over(w))
    runs = grouped.groupBy(*key, "_run").agg(F.min(idx).alias("start_idx"), F.max(idx).alias("end_idx"), F.count("*").alias("n"))
    return runs.drop("_run")


def gaps(spans: DataFrame, key: list[str], start: str, end: str) -> DataFrame:
    """Holes between one span and the next of its key: key, gap_start, gap_end."""
    w = Window.partitionBy(*key).orderBy(start, end)
    after = spans.select(*key, (F.col(end) + 1).alias("gap_start"), (F.lead(start).over(w) - 1).alias("gap_end"))
    return after.filter("gap_end >= gap_start")


def containing(points: DataFrame, spans: DataFrame, key: list[str], idx: str, start: str, end: str, how: str = "left") -> DataFrame:
    """Each point with the spans of its key that hold it."""
    s = spans.withColumnsRenamed({k: f"_{k}" for k in key})
    on = [F.col(k) == F.col(f"_{k}") for k in key]
    return points.join(s, [*on, F.col(idx).between(F.col(start), F.col(end))], how).drop(*[f"_{k}" for k in key])


def overlapping_pairs(spans: DataFrame, key: list[str], id_: str, start: str, end: str, width: int = 64) -> DataFrame:
    """Pairs (id_a < id_b) of one key's spans that share an index.

    Spans meet in blocks of ``width`` indexes, which should be about a span's length, so that a key's spans are not all
    held against each other; a pair is made in the block of its later start only.
    """
    block = lambda c: F.floor(c / F.lit(width)).cast("long")
    blocks = F.explode(F.sequence(block(F.col(start)), block(F.greatest(start, end)))).alias("_block")
    dealt = spans.filter(F.col(start).isNotNull() & F.col(end).isNotNull()).select(*key, F.col(id_), F.col(start), F.col(end), blocks)
    a = dealt.select(*key, "_block", F.col(id_).alias("id_a"), F.col(start).alias("_s"), F.col(end).alias("_e"))
    b = dealt.select(*key, "_block", F.col(id_).alias("id_b"), F.col(start).alias("_s2"), F.col(end).alias("_e2"))
    pairs = a.join(b, [*key, "_block"]).filter("id_a < id_b and _s <= _e2 and _s2 <= _e")
    return pairs.filter(F.col("_block") == block(F.greatest("_s", "_s2"))).select(*key, "id_a", "id_b")


def as_of(points: DataFrame, spans: DataFrame, key: list[str], idx: str, start: str, end: str, value: str) -> DataFrame:
    """Each point with ``value`` of the last span that starts at or before it, null where that span has ended.

    One union and one window over the key: no range join.
    """
    p = points.withColumn("_at", F.col(idx)).withColumn("_order", F.lit(1))
    s = spans.select(*key, F.col(start).alias("_at"), F.lit(0).alias("_order"), F.struct(F.col(end).alias("end"), F.col(value).alias("value")).alias("_span"))
    w = Window.partitionBy(*key).orderBy("_at", "_order").rowsBetween(Window.unboundedPreceding, 0)
    both = p.unionByName(s, allowMissingColumns=True).withColumn("_last", F.last("_span", ignorenulls=True).over(w))
    out = both.filter("_order = 1").withColumn(value, F.when(F.col("_last.end") >= F.col(idx), F.col("_last.value")))
    return out.drop("_at", "_order", "_span", "_last")


def merged(rows: DataFrame, key: list[str], start: str, end: str, slack: float = 0.0) -> DataFrame:
    """Intervals of a key joined where the next starts within ``slack`` of the furthest end so far."""
    w = Window.partitionBy(*key).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    flagged = rows.select(*key, start, end, F.when(F.col(start) - before <= slack, 0).otherwise(1).alias("_new"))
    runs = flagged.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*key, "_run").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n")).drop("_run")


def uncovered(speech: DataFrame, words: DataFrame, key: list[str], start: str, end: str, least: float) -> DataFrame:
    """Parts of (merged) ``speech`` of at least ``least`` (more than 0) that no interval of ``words`` covers: key, start, end.

    One sweep over the ends of all intervals, which are dealt by key in tasks of bounded size: a part runs while speech is open and no word
    is, and ends at a word even if that takes no time.
    """
    known = F.col(start).isNotNull() & F.col(end).isNotNull()

    def ends(rows: DataFrame, says: int, has: int) -> DataFrame:
        point = lambda at, by: F.struct(F.col(at).alias("at"), F.lit(says * by).alias("says"), F.lit(has * by).alias("has"))
        return rows.filter(known).select(*key, F.explode(F.array(point(start, 1), point(end, -1))).alias("_p")).select(*key, "_p.*")

    points = places.dealt(ends(speech, 1, 0).unionByName(ends(words, 0, 1)), 2 * (speech.count() + words.count()), *key)
    w = Window.partitionBy(*key).orderBy("at")
    upto = w.rangeBetween(Window.unboundedPreceding, 0)
    points = points.select(*key, "at", (F.col("has") != 0).alias("word"), F.lead("at").over(w).alias("next"), ((F.sum("says").over(upto) > 0) & (F.sum("has").over(upto) == 0)).alias("hole"))
    new = F.when(F.col("hole") & ~F.col("word") & F.coalesce(F.lag("hole").over(w), F.lit(False)), 0).otherwise(1)
    runs = points.select(*key, "at", "next", "hole", new.alias("_new")).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("hole")
    holes = runs.groupBy(*key, "_run").agg(F.min("at").alias(start), F.max("next").alias(end)).drop("_run")
    return holes.filter(F.col(end) - F.col(start) >= least)


def turns(rows: DataFrame, key: list[str], idx: str, same: list[str]) -> DataFrame:
    """Rows numbered by turn: a turn ends where any of ``same`` changes."""
    w = Window.partitionBy(*key).orderBy(idx)
    changed = F.lit(False)
    for c in same:
        changed = changed | ~F.col(c).eqNullSafe(F.lag(c).over(w))
    first = F.row_number().over(w) == 1
    return rows.withColumn("_new", (first | changed).cast("int")).withColumn("turn_no", F.sum("_new").over(w)).drop("_new")


def top(rows: DataFrame, key: list[str], order: list[Column], k: int = 1) -> DataFrame:
    """The first ``k`` rows of each key."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k).drop("_rn")
