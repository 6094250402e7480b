"""Order within groups of any size: places, running values and cuts with a running reset, split over tasks.

Rows are sorted once in ranges of (group, order); what a range needs of those before it is one row for each group
and range.  So one recording may hold any share of the rows.  Cuts whose next one depends on the last one are a chain of
successors: each row's successor is found as if a cut began there, and the chain is followed by doubling its steps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rostrum.sources import staging

#: Doublings of a chain at most: it may have two to the power of this many cuts.
MAX_ROUNDS = 40


def numbered(rows: DataFrame, group: list[str], order: list[str], name: str = "places") -> DataFrame:
    """``rows`` with part and pos, from 0 in the order within its group; staged.  Ties are in the order of arrival."""
    wide = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [*group, *order, "_tie"]
    tied = rows.withColumn("_tie", F.monotonically_increasing_id())
    ranged = tied.repartitionByRange(wide, *by).sortWithinPartitions(*by).drop("_tie").select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("_seq"))
    ranged, _ = staging.stage(ranged, name)
    counts = ranged.groupBy("part", *group).agg(F.count("*").alias("_n"), F.min("_seq").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("part", *group, "_first", F.coalesce(before, F.lit(0)).alias("_before"))
    placed = ranged.join(counts, ["part", *group])
    return placed.select(*rows.columns, "part", (F.col("_seq") - F.col("_first") + F.col("_before")).alias("pos"))


def running(rows: DataFrame, group: list[str], value: Column, out: str, sums: bool = False) -> DataFrame:
    """``rows`` (part, pos) with the maximum, or sum, of ``value`` from the group's first row up to each."""
    fn = F.sum if sums else F.max
    given = rows.withColumn("_v", value)
    tops = given.groupBy("part", *group).agg(fn("_v").alias("_top"))
    before = fn("_top").over(Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    tops = tops.select("part", *group, before.alias("_before"))
    within = fn("_v").over(Window.partitionBy("part", *group).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    both = given.withColumn("_within", within).join(tops, ["part", *group])
    zero = F.lit(0)
    held = F.coalesce(F.col("_within"), zero) + F.coalesce(F.col("_before"), zero) if sums else F.greatest("_within", "_before")
    return both.select(*rows.columns, held.alias(out))


def neighbour(rows: DataFrame, group: list[str], columns: dict[str, str], step: int) -> DataFrame:
    """``rows`` (pos) with columns of the row ``step`` places on, by new names; null where there is none."""
    other = rows.select(*group, (F.col("pos") - step).alias("pos"), *[F.col(c).alias(n) for c, n in columns.items()])
    return rows.join(other, [*group, "pos"], "left")


def first_at_least(rows: DataFrame, group: list[str], value: str, least: Column, width: float) -> DataFrame:
    """group, pos, found: for each row the place of the first row of the group whose ``value`` is ``least`` or more.

    ``value`` never falls with pos.  It is cut in blocks of ``width``: the answer is in the block of ``least``, or else the first
    place of the next block that has one.
    """
    block = lambda c: F.floor(c / F.lit(float(width)))
    held = rows.select(*group, F.col(value).cast("double").alias("_x"), F.lit(0).alias("_asks"), "pos")
    asked = rows.select(*group, least.cast("double").alias("_x"), F.lit(1).alias("_asks"), "pos")
    both = held.unionByName(asked).withColumn("_b", block(F.col("_x")))
    place = F.when(F.col("_asks") == 0, F.col("pos"))
    within = F.min(place).over(Window.partitionBy(*group, "_b").orderBy(F.desc("_x"), "_asks").rowsBetween(Window.unboundedPreceding, 0))
    blocks = both.groupBy(*group, "_b").agg(F.min(place).alias("_least"))
    later = F.min("_least").over(Window.partitionBy(*group).orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select(*group, "_b", later.alias("_later"))
    return both.withColumn("_in", within).filter("_asks = 1").join(blocks, [*group, "_b"]).select(*group, "pos", F.coalesce("_in", "_later").alias("found"))


def chain(links: DataFrame, group: list[str], starts: DataFrame) -> DataFrame:
    """group, pos: ``starts`` and all that their successors lead to; ``links`` (group, pos, next) with a null next at an end.

    Each round doubles the steps of the links and the part of each chain that is known, so that a chain of n cuts takes log2(n) rounds.
    """
    spark = links.sparkSession
    keys = [*group, "pos"]
    jumps, _ = staging.stage(links.filter("next is not null").select(*keys, F.col("next").cast("long").alias("next")), "cut-links")
    known, _ = staging.stage(starts.select(*keys), "cut-starts")
    for _ in range(MAX_ROUNDS):
        # one table for each round: the cuts that it finds, without a next one, and the links of twice the steps
        fresh = known.join(jumps, keys).select(*group, F.col("next").alias("pos"), F.lit(None).cast("long").alias("next"))
        on = jumps.select(*group, F.col("pos").alias("next"), F.col("next").alias("_then"))
        twice = jumps.join(on, [*group, "next"]).select(*keys, F.col("_then").alias("next"))
        after, path = staging.stage(fresh.unionByName(twice), "cut-round")  # stays, as the result reads its cuts
        cuts, jumps = after.filter("next is null").select(*keys), after.filter("next is not null")
        if not cuts.limit(1).count():
            staging.drop(spark, path)
            return known
        known = known.unionByName(cuts)
    raise RuntimeError(f"a chain has more than 2 ** {MAX_ROUNDS} cuts")


#: Rows of a task where ``dealt`` deals them.
ROWS = 500_000


def dealt(rows: DataFrame, n: int, *key: str) -> DataFrame:
    """``rows``, about ``n`` of them, by key in as many tasks as keep each at some ``ROWS``: more rows make more tasks, not larger ones."""
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(width, -(-n // ROWS)), *key)
