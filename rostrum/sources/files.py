"""Readers and writers for the archive's file formats, on Spark's own sources.

Paths may be of any store that Spark can read; nothing here opens a file on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rostrum.functions import text as T
from rostrum.operators.intervals import top

TURNS = "video_id string, turns array<struct<start:double,end:double,speaker:string>>"
CENTROIDS = "video_id string, local_label string, embedding array<float>"


def table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A parquet table, pruned to the columns asked for."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """id, title, duration from tab-separated lines; malformed lines go, the first line of an id stays.

    Lines are ordered by file and place in it.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"))
    cell = lambda i: F.get(F.split("value", "\t"), F.lit(i))
    rows = lines.select("file", "at", cell(0).alias("id"), cell(1).alias("title"), cell(2).try_cast("double").alias("duration"))
    rows = rows.filter("id <> '' and duration is not null")
    return top(rows, ["id"], [F.asc("file"), F.asc("at")]).select("id", "title", "duration")


def diarization(spark: SparkSession, path: str) -> DataFrame:
    """video_id, start, end, speaker from JSON documents of turns."""
    return spark.read.schema(TURNS).json(path).select("video_id", F.inline("turns"))


def unit_vectors(df: DataFrame, vector: str) -> DataFrame:
    """The vectors at length one; zero vectors go."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return df.withColumn("_norm", norm).filter("_norm > 0").withColumn(vector, F.transform(vector, lambda x: (x / F.col("_norm")).cast("float"))).drop("_norm")


def silences(spark: SparkSession, path: str, marker: str = "silence_end") -> DataFrame:
    """The last token of the lines that hold the marker, as seconds."""
    lines = spark.read.text(path).filter(F.contains("value", F.lit(marker)))
    return lines.select(F.element_at(F.split(F.trim("value"), r"\s+"), -1).try_cast("double").alias("at")).filter("at is not null")


def without_nul(df: DataFrame, column: str) -> DataFrame:
    """Document text without NUL characters."""
    return df.withColumn(column, F.replace(column, F.lit("\0"), F.lit("")))


def merge_manifest(old: DataFrame, new: DataFrame) -> DataFrame:
    """Files by file_id: what is new overwrites, a body that was fetched stays."""
    from rostrum.operators.aggregates import upsert

    return upsert(old, new, ["file_id"], keep=["body_text", "fetched_at"])


def reload_recordings(df: DataFrame, path: str, key: str = "video_id") -> None:
    """Replace the partitions of the recordings in ``df`` and leave the others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def subtitles(utterances: DataFrame) -> DataFrame:
    """One line of text for each utterance of a subtitle file: number, times, text."""
    clock = lambda c: T.clock_of(F.col(c), comma=True)
    block = F.concat_ws("\n", (F.col("idx") + 1).cast("string"), F.concat(clock("start"), F.lit(" --> "), clock("end")), "text", F.lit(""))
    return utterances.select("video_id", "idx", block.alias("value"))


def write_json_lines(df: DataFrame, path: str) -> None:
    """A backup as compressed JSON lines."""
    df.write.mode("overwrite").option("compression", "gzip").json(path)


def restore_json_lines(spark: SparkSession, path: str, like: DataFrame, expected: int) -> DataFrame:
    """A backup, proven to be whole before use."""
    df = spark.read.schema(like.schema).json(path)
    found = df.count()
    if found != expected:
        raise ValueError(f"the backup holds {found} rows, not {expected}")
    return df
