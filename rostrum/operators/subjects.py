"""Subject membership by phrases, unions up a tree, and windows over yearly counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def membership(items: DataFrame, tree: Sequence[tuple[str, str | None, str | None]]) -> DataFrame:
    """slug, id: which items (id, text) belong to which subject.

    ``tree``: (slug, parent, pattern or None), parents before children; a small table that is
    given by people.  One pass tests all patterns; a child's item must be its parent's where the parent
    has a pattern of its own; then an item belongs to every ancestor too.
    """
    pattern = {s: p for s, _, p in tree}
    parent = {s: p for s, p, _ in tree}

    def chain(slug: str | None) -> list[str]:
        return [slug, *chain(parent[slug])] if slug else []

    def holds(slug: str):
        return F.col("text").rlike(pattern[slug])

    fits = {}
    for slug, p in pattern.items():
        if p:
            fits[slug] = holds(slug) if not (parent[slug] and pattern[parent[slug]]) else holds(slug) & fits[parent[slug]]
    all_of = F.array_distinct(F.flatten(F.array(*[F.when(c, F.array(*[F.lit(s) for s in chain(slug)])).otherwise(F.array().cast("array<string>")) for slug, c in fits.items()])))
    return items.select(F.explode(all_of).alias("slug"), "id")


def descent(edges: DataFrame, depth: int) -> DataFrame:
    """id, root, depth for a tree (id, parent) of at most ``depth`` levels."""
    level = edges.filter("parent is null").select("id", F.col("id").alias("root"), F.lit(0).alias("depth"))
    out = level
    for d in range(1, depth):
        up = level.select(F.col("id").alias("parent"), "root")
        level = edges.join(up, "parent").select("id", "root", F.lit(d).alias("depth"))
        out = out.unionByName(level)
    return out


def shortest_window(counts: DataFrame, key: str, year: str, n: str, share: float) -> DataFrame:
    """key, lo, hi: the shortest run of years with at least ``share`` of a key's total; the first of equals."""
    total = counts.withColumn("_all", F.sum(n).over(Window.partitionBy(key)))
    upto = Window.partitionBy(key).orderBy(year).rowsBetween(Window.unboundedPreceding, 0)
    run = total.withColumn("_to", F.sum(n).over(upto))
    a = run.select(key, F.col(year).alias("lo"), (F.col("_to") - F.col(n)).alias("_before"))
    b = run.select(key, F.col(year).alias("hi"), "_to", "_all")
    fit = a.join(b, key).filter((F.col("lo") <= F.col("hi")) & (F.col("_to") - F.col("_before") >= share * F.col("_all")))
    best = F.min(F.struct((F.col("hi") - F.col("lo")).alias("w"), "lo", "hi"))
    return fit.groupBy(key).agg(best.alias("b")).select(key, "b.lo", "b.hi")


def walk(edges: DataFrame, depth: int) -> DataFrame:
    """id, depth, path of a tree (id, parent, items) of at most ``depth`` levels: in the order of ``path`` it is walked depth first, children with most items first, ties by id."""
    step = F.concat(F.lpad((F.lit(10**9 - 1) - F.col("items")).cast("string"), 9, "0"), F.lit(":"), F.col("id"))
    level = edges.filter("parent is null").select("id", F.lit(0).alias("depth"), step.alias("path"))
    out = level
    for d in range(1, depth):
        up = level.select(F.col("id").alias("parent"), F.col("path").alias("_up"))
        level = edges.join(up, "parent").select("id", F.lit(d).alias("depth"), F.concat("_up", F.lit("/"), step).alias("path"))
        out = out.unionByName(level)
    return out


def curated(subjects: DataFrame, terms: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Subjects (slug, status) and terms (slug, phrase, status) after decisions (slug, decision), which pass on to those terms that are still proposed."""
    s = subjects.join(decisions, "slug", "left").withColumn("status", F.coalesce("decision", "status")).drop("decision")
    after = F.when(F.col("status") == "proposed", F.coalesce("decision", "status")).otherwise(F.col("status"))
    return s, terms.join(decisions, "slug", "left").withColumn("status", after).drop("decision")
