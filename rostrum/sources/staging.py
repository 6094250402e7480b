"""Tables that cut a lineage: parquet under ``spark.checkpoint.dir``, visible to the driver and to every executor."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where the cluster names no checkpoint folder, as in tests.
FALLBACK_DIR = "/tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    return (named or FALLBACK_DIR).rstrip("/")


def stage(df: DataFrame, name: str, partition_by: list[str] | None = None) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder; the reread table and its path.  It survives the loss of executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns), path


def drop(spark: SparkSession, path: str) -> None:
    """Delete a staged table, once its last reader has run."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
