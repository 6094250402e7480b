"""A table of recordings of which single ones are replaced: parquet in buckets of the recordings' keys.

A replacement finds the recordings whose rows differ from those that are stored and rewrites their buckets alone, by dynamic partition
overwrite; the files of the other buckets stay as they are.  What is written comes from a staged table, as a bucket is read
and overwritten.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from rostrum.sources import staging

BUCKET = "key_bucket"


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int")


def _digests(rows: DataFrame, key: str, name: str) -> DataFrame:
    """key, and a digest of its rows that their order doesn't change."""
    own = F.xxhash64(*[F.col(c).cast("string") for c in sorted(rows.columns)])
    return rows.groupBy(key).agg(F.struct(F.count("*"), F.bit_xor(own), F.sum(F.pmod(own, F.lit(1 << 31)))).cast("string").alias(name))


class Recordings:
    """Rows by the column ``key`` in a folder that Spark can read; ``buckets`` is fixed when it is first written."""

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path, key, buckets

    def _write(self, rows: DataFrame, mode: str) -> None:
        given = rows.withColumn(BUCKET, _bucket(self.key, self.buckets)).repartition(BUCKET).sortWithinPartitions(self.key)
        given.write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy(BUCKET).parquet(self.path)

    def load(self, rows: DataFrame) -> None:
        """Write all recordings; what there was goes."""
        self.schema = rows.schema
        self._write(rows, "static")

    def read(self) -> DataFrame:
        """All rows that are stored now."""
        return self._stored().drop(BUCKET)

    def _stored(self) -> DataFrame:
        return self.spark.read.schema(StructType([*self.schema.fields, StructField(BUCKET, IntegerType())])).parquet(self.path)

    def replace(self, rows: DataFrame, keys: DataFrame | None = None) -> DataFrame:
        """Store the rows of some recordings in place of theirs; the keys that had changed.

        ``keys`` (key) names the recordings, also those that have no rows any more; without it they are those of ``rows``.
        """
        key = self.key
        named = (keys if keys is not None else rows).select(key).distinct()
        rows = rows.select(*self.schema.names)
        old = self.read().join(named, key, "left_semi")
        both = named.join(_digests(old, key, "was"), key, "left").join(_digests(rows, key, "now"), key, "left")
        changed, _ = staging.stage(both.filter(~F.col("was").eqNullSafe(F.col("now"))).select(key), "changed-recordings")
        touched = [r[0] for r in changed.select(_bucket(key, self.buckets)).distinct().collect()]  # buckets at most
        if not touched:
            return changed
        stored = self._stored().filter(F.col(BUCKET).isin(touched)).drop(BUCKET)
        after = stored.join(changed, key, "left_anti").unionByName(rows.join(changed, key, "left_semi"))
        after, path = staging.stage(after, "replaced-recordings")
        self._write(after, "dynamic")
        # a bucket that lost its last recording isn't in what was written
        left = {r[0] for r in after.select(_bucket(key, self.buckets)).distinct().collect()}
        for b in set(touched) - left:
            staging.drop(self.spark, f"{self.path}/{BUCKET}={b}")
        staging.drop(self.spark, path)
        return changed
