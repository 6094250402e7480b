"""Aggregations with a stated tie-break, conditional counts and read-model helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mode(rows: DataFrame, key: list[str], value: str, ties: list[Column]) -> DataFrame:
    """key, value, n: the most frequent value of each key; ``ties`` order values that are equally frequent."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*key, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*key).orderBy(F.desc("n"), *ties)
    return counts.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def percent(part: Column, whole: Column) -> Column:
    """Whole percent, null if there is nothing to share."""
    return F.round(F.try_divide(100 * part, whole))


def element_quantile(rows: DataFrame, key: list[str], value: str, share: float) -> DataFrame:
    """key, q: the element at place floor(n * share) of the sorted values (from 0)."""
    w = Window.partitionBy(*key)
    ranked = rows.withColumn("_i", F.row_number().over(w.orderBy(value)) - 1).withColumn("_n", F.count("*").over(w))
    return ranked.filter(F.col("_i") == F.floor(F.col("_n") * share)).select(*key, F.col(value).alias("q"))


def grid(counts: DataFrame, years: str, value: str) -> DataFrame:
    """Every year of the span with every month, zero where nothing happened; ``counts``: year, month, value."""
    span = counts.agg(F.min(years).alias("lo"), F.max(years).alias("hi"))
    cells = span.select(F.explode(F.sequence("lo", "hi")).alias(years)).withColumn("month", F.explode(F.sequence(F.lit(1), F.lit(12))))
    return cells.join(counts, [years, "month"], "left").withColumn(value, F.coalesce(value, F.lit(0)))


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows that only one side has, with ``side``."""
    return a.subtract(b).withColumn("side", F.lit("a")).unionByName(b.subtract(a).withColumn("side", F.lit("b")))


def upsert(old: DataFrame, new: DataFrame, key: list[str], keep: list[str]) -> DataFrame:
    """``old`` with the rows of ``new``; columns in ``keep`` are never overwritten once they hold a value."""
    o, n = old.alias("o"), new.alias("n")
    joined = o.join(n, [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in key], "full")
    pick = lambda c: F.coalesce(f"o.{c}", f"n.{c}") if c in keep or c in key else F.coalesce(f"n.{c}", f"o.{c}")
    return joined.select(*[pick(c).alias(c) for c in old.columns])
