"""Who spoke: claim resolution by rank, support guards, cluster majorities, affinity, components."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rostrum.operators import vectors as V

# The methods of a claim and their ranks.
METHOD_RANK = {"override": 1, "label": 2, "self": 3, "self_weak": 3, "read_aloud": 3, "rollcall": 4, "chair": 5, "llm": 6, "voice": 7, "cluster": 8}


def method_rank(method: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, rank in METHOD_RANK.items():
        out = F.when(method == name, rank).otherwise(out)
    return out


def resolve(lines: DataFrame, claims: DataFrame, supported: Column | None = None) -> DataFrame:
    """video_id, idx, name_text, method, contested: the claim that wins each line.

    ``lines``: video_id, idx.  ``claims``: id, video_id, start_idx, end_idx, name_text (null
    detaches), method, corroborated.  A corroborated claim of rank 7 or 8 is promoted by
    one; then the narrowest span wins, then the newest id.  A line is contested if other
    names claim it, where read-aloud claims are compared among themselves only.  A detach
    wins as a null name.  ``supported`` guards the name that is emitted.
    """
    c = claims.withColumn("rank", method_rank(F.col("method")))
    c = c.withColumn("rank", F.col("rank") - (F.col("corroborated") & (F.col("rank") >= 7)).cast("int"))
    c = c.select("id", F.col("video_id").alias("_v"), "start_idx", "end_idx", "name_text", "method", "rank")
    held = lines.join(c, (F.col("video_id") == F.col("_v")) & F.col("idx").between(F.col("start_idx"), F.col("end_idx"))).drop("_v")
    w = Window.partitionBy("video_id", "idx")
    aloud = F.col("method") == "read_aloud"
    names = lambda keep: F.size(F.collect_set(F.when(keep, F.lower("name_text"))).over(w))
    held = held.withColumn("_aloud", names(aloud)).withColumn("_said", names(~aloud))
    best = held.withColumn("_rn", F.row_number().over(w.orderBy("rank", F.col("end_idx") - F.col("start_idx"), F.desc("id")))).filter("_rn = 1")
    out = best.withColumn("contested", F.when(aloud, F.col("_aloud") > 1).otherwise(F.col("_said") > 1))
    if supported is not None:
        out = out.filter(F.col("name_text").isNull() | supported)
    return out.select("video_id", "idx", "name_text", "method", "contested")


def cluster_majority(labels: DataFrame, cluster: str, name: str) -> DataFrame:
    """cluster, name, n: the name that most labels of a cluster carry; ties by name."""
    g = labels.filter(F.col(name).isNotNull()).groupBy(cluster, name).agg(F.count("*").alias("n"))
    w = Window.partitionBy(cluster).orderBy(F.desc("n"), name)
    return g.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def cosine(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def affinity(voices: DataFrame, group: str, k: int = 3) -> DataFrame:
    """id, similarity: mean of the ``k`` nearest other voices of the same group (id, v, group).

    The nearest are found in blocks of vectors, so that pairs of voices stay inside a task.  A voice without another one in its group
    has no row, and one that can't be compared a null.
    """
    rows = voices.select(F.col(group).alias("cell"), "id", "v").filter("cell is not null")
    able = rows.filter("v is not null")
    best = V.in_blocks(able, able.select("cell", F.col("id").alias("qid"), F.col("v").alias("q")), k, None, apart=True)
    several = rows.groupBy("cell").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo < hi").select("cell")
    paired = rows.join(several, "cell", "left_semi").select("id").distinct()
    return paired.join(best.groupBy(F.col("qid").alias("id")).agg(F.avg("score").alias("similarity")), "id", "left")


def grow_anchors(voices: DataFrame, seeds: DataFrame, assign: float = 0.70, promote: float = 0.85, rounds: int = 3, k: int = 3) -> DataFrame:
    """id, name, similarity: voices (id, v) given to the person whose references they resemble most.

    ``seeds`` (id, name) are voices that people have named; they always keep their names.  A
    voice's similarity to a person is the mean of its ``k`` best references; from ``promote`` on it
    becomes a reference itself in the next round.  Voices meet the references of each person in blocks.
    """
    own = seeds.join(voices, "id").select("name", F.col("v").alias("r"), F.col("id").alias("rid"))
    asked = voices.filter("v is not null").select(F.col("id").alias("qid"), F.col("v").alias("q"))
    refs, found = own, None
    for _ in range(rounds):
        members = refs.filter("r is not null").select(F.col("name").alias("cell"), F.col("rid").alias("id"), F.col("r").alias("v"))
        queries = members.select("cell").distinct().join(asked).select("cell", "qid", "q")
        near = V.in_blocks(members, queries, k, None, apart=True, by=("cell", "qid"))
        top = near.groupBy(F.col("qid").alias("id"), F.col("cell").alias("name")).agg(F.avg("score").alias("similarity"))
        best = top.withColumn("_rn", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("similarity"), "name"))).filter("_rn = 1").drop("_rn")
        free = best.join(seeds.select("id"), "id", "left_anti").filter(F.col("similarity") >= assign)
        found = _checkpointed(free)
        refs = own.unionByName(found.filter(F.col("similarity") >= promote).join(voices, "id").select("name", F.col("v").alias("r"), F.col("id").alias("rid")))
    return found.unionByName(seeds.select("id", "name", F.lit(1.0).alias("similarity")))


def _checkpointed(df: DataFrame) -> DataFrame:
    spark: SparkSession = df.sparkSession
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or "/tmp/checkpoints"
    path = f"{folder.rstrip('/')}/components-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def components(nodes: DataFrame, edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """id, component: the least id that each node (id) reaches over ``edges`` (a, b).

    Labels spread to neighbours and jump to their label's label, so that long chains shorten by half each round.
    """
    both = _checkpointed(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = _checkpointed(nodes.select("id", F.col("id").alias("component")))
    for _ in range(max_rounds):
        near = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("component").alias("m"))
        spread = labels.join(near, labels["id"] == near["a"], "left").select("id", F.least("component", "m").alias("component"))
        jump = spread.select(F.col("id").alias("component"), F.col("component").alias("up"))
        after = _checkpointed(spread.join(jump, "component", "left").select("id", F.least("component", "up").alias("component")))
        changed = after.join(labels.withColumnRenamed("component", "was"), "id").filter("component != was").limit(1).count()
        labels = after
        if not changed:
            return labels
    raise RuntimeError(f"components have not settled in {max_rounds} rounds")
