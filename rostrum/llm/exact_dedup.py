"""Exact duplicates by distributed most-significant-digit radix partitioning.

A normalised text is read as the byte string ``<length><UTF-8 bytes>``, so that the texts
of one group always end together.  Each round takes the next ``stride`` bytes as the digit
of all texts still in doubt and splits their groups by it.  A text leaves as soon as its
group is a singleton or has ended; equality is therefore decided by the bytes themselves
and never by a digest.  Strides grow fourfold, so the number of rounds is logarithmic in
the longest text, and only texts that still share a whole prefix move again.

A group's count and survivor come from a partially aggregated ``groupBy``: a group that
holds a third of all rows reaches its reducer as one row per map task.  The counts go back in a merge join, but for
groups of so many rows that there can be few of them: these are broadcast, and their rows dealt evenly.
Groups are named by numbers of their own, never by an id.

Edge cases: a null text is an empty one, and all empty texts are one group; repeated rows
and repeated ids are members like any others; an empty table gives an empty result; extra
columns are ignored by ``exact_groups`` and kept by ``keep_one``.  Letters other than A-Z keep their case.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rostrum.llm import shared

#: Bytes in the first digit, and the factor by which digits grow.
FIRST_STRIDE, GROWTH = 64, 4
#: Bytes at most of the digits that are broadcast.
HOT_BYTES = 32 << 20

OUT = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


def exact_groups(docs: DataFrame, first_stride: int = FIRST_STRIDE, growth: int = GROWTH) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    ``keep_id`` is the largest id among the texts that are equal after lower-casing A-Z.
    Of rows that repeat the surviving id itself, all are marked kept.
    """
    spark = docs.sparkSession
    body = F.encode(shared.fold_ascii_col(F.coalesce(F.col("text"), F.lit(""))), "UTF-8")
    rows = docs.select("doc_id", body.alias("rest")).select(
        "doc_id",
        F.octet_length("rest").cast("long").alias("grp"),  # the length is the leading digit
        "rest",
        F.sha2("rest", 256).alias("text_sha256"),
    )
    done: list[DataFrame] = []
    stride, last = first_stride, None
    while True:
        digit = F.substring("rest", 1, stride)
        groups = rows.groupBy("grp", digit.alias("digit")).agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("top")).filter("n > 1")
        # staged, so that a group keeps its number, which is its name in the next round
        groups, groups_path = shared.stage(groups.withColumn("next", F.monotonically_increasing_id()), "radix-groups")
        held = groups.agg(F.sum("n"), F.sum(F.col("n") * F.octet_length("digit"))).first()
        # a merge join at every size: the groups grow with the input, so that sending them holds for small tables only
        split = shared.join_counted(rows.withColumn("digit", digit), groups.withColumn("size", F.col("n")), ["grp", "digit"], held[0] or 0, (held[1] or 0) // HOT_BYTES, "merge")
        ended = F.octet_length("rest") <= stride
        result = split.select(
            "doc_id",
            F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("top")).alias("keep_id"),
            F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
            "text_sha256",
            F.col("next").alias("grp"),
            # what is left to compare; null once the group is a singleton or has ended
            F.when(F.col("size").isNotNull() & ~ended, F.substring("rest", stride + 1, 2**31 - 1 - stride)).alias("rest"),
        )
        table, path = shared.stage(result, "radix")
        shared.drop(spark, groups_path)
        if last:
            shared.drop(spark, last)
        done.append(table.filter("rest is null"))
        if not table.filter("rest is not null").limit(1).count():
            break
        # the finished rows are set apart, so that this round's texts can be dropped
        done[-1], _ = shared.stage(done[-1].drop("rest", "grp"), "radix-done")
        rows = table.filter("rest is not null").select("doc_id", "grp", "rest", "text_sha256")
        stride, last = stride * growth, path
    found = reduce(DataFrame.unionByName, [d.select("doc_id", "keep_id", "group_size", "text_sha256") for d in done])
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id"))).select(*OUT)


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents without exact copies, with all columns of ``docs``, whatever their names.

    Of equal texts the row with the largest id stays, or one of those rows per repetition of that id; null ids
    are the least.  A row is told from others with its id by its text.
    """
    gone = exact_groups(docs).filter("not kept").select("doc_id", "text_sha256").distinct()
    own = F.sha2(F.encode(shared.fold_ascii_col(F.coalesce(F.col("text"), F.lit(""))), "UTF-8"), 256)
    return shared.without(docs, gone, {"doc_id": F.col("doc_id"), "text_sha256": own})
