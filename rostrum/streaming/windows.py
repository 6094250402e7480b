"""Event-time windows, rate limits and keyed upserts as Structured Streaming transformations.

Each transformation takes a streaming or a batch DataFrame.  ``drain`` runs a stream over all input that
is there (``availableNow``) and gives the result as a table in the shared folder; its
checkpoint stands beside it, so that a stream that is broken off goes on where it was.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def events_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 8) -> DataFrame:
    """A stream over the parquet files of a folder, with the event time as a timestamp."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def counts(events: DataFrame, key: str, size: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """start, key, n, total: tumbling, or with ``slide`` hopping, windows."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    g = events.withWatermark("ts", late).groupBy(w.alias("w"), key).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select(F.col("w.start").alias("start"), key, "n", "total")


def sessions(events: DataFrame, key: str, gap: str, late: str = "1 hour") -> DataFrame:
    """start, key, n: runs of events with gaps under ``gap``."""
    g = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("n"))
    return g.select(F.col("w.start").alias("start"), key, "n")


def over_limit(events: DataFrame, key: str, id_: str, seconds: int, most: int) -> DataFrame:
    """Events that find more than ``most`` of their key's events within the last ``seconds``, themselves included.

    Time is cut into blocks of ``seconds``, so that a key's events are split and a window reaches into the block before only.  That
    block's events come as counts that leave when the window has passed them: sums from a block's beginning, no frame that is counted anew.
    """
    width = seconds * 1_000_000
    own = events.select(F.col(id_).alias("_id"), F.col(key).alias("_key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("_at"))
    own = own.withColumn("_block", F.floor(F.col("_at") / F.lit(width)).cast("long"))
    gone = own.filter("_at is not null").groupBy("_key", "_block", "_at").agg(F.count("*").alias("_left"))
    gone = gone.select("_key", (F.col("_block") + 1).alias("_block"), (F.col("_at") + width).alias("_at"), "_left")
    both = own.withColumn("_own", F.lit(1)).unionByName(gone, allowMissingColumns=True)
    w = Window.partitionBy("_key", "_block")
    upto = w.orderBy("_at")
    so_far, all_of, passed = F.sum("_own").over(upto.rangeBetween(Window.unboundedPreceding, 0)), F.sum("_left").over(w), F.sum("_left").over(upto.rangeBetween(Window.unboundedPreceding, -1))
    n = so_far + F.coalesce(all_of, F.lit(0)) - F.coalesce(passed, F.lit(0))
    counted = both.select("_id", "_key", "_own", n.alias("n")).filter("_own = 1").filter(F.col("n") > most)
    return counted.select(F.col("_id").alias(id_), F.col("_key").alias(key), "n")


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The newest row of each key: what a keyed upsert leaves."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def drain(stream: DataFrame, mode: str = "complete", each: Callable[[DataFrame, int], DataFrame] | None = None) -> DataFrame:
    """All that the stream has now, through ``foreachBatch``; in complete mode the last batch is the result."""
    spark = stream.sparkSession
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or "/tmp/checkpoints"
    base = f"{folder.rstrip('/')}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, no: int) -> None:
        out = each(batch, no) if each else batch
        out.write.mode("overwrite").parquet(f"{base}/out" if mode == "complete" else f"{base}/out/batch={no}")

    query = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{base}/state").foreachBatch(write).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")
