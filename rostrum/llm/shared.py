"""Helpers that several operators of this subpackage use: staged tables, work sizing, text folding.

A *staged table* is a parquet table written under ``spark.checkpoint.dir``: it cuts the
lineage, survives the loss of an executor, and is visible to the driver and to every
executor.  ``drop`` removes one as soon as its last reader has run.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Used only where the cluster names no checkpoint folder, as in tests.
FALLBACK_DIR = "/tmp/checkpoints"

#: Rows up to which a key isn't hot in any case.
HOT_ROWS = 200

#: A-Z only; every other letter keeps its case.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
_FOLD = str.maketrans(UPPER, LOWER)


def fold_ascii(text: str) -> str:
    """Lower-case A-Z only, in Python."""
    return text.translate(_FOLD)


def fold_ascii_col(col: Column) -> Column:
    """Lower-case A-Z only, in the JVM; for pure ASCII the much faster ``lower`` does the same."""
    return F.when(F.octet_length(col) == F.char_length(col), F.lower(col)).otherwise(F.translate(col, UPPER, LOWER))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = FALLBACK_DIR
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def stage(df: DataFrame, name: str, **options: str) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder; return the reread table and its path."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, path: str) -> None:
    """Delete a staged table."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def join_counted(left: DataFrame, right: DataFrame, on: list[str], rows: int, least: int = 0, strategy: str | None = None) -> DataFrame:
    """Left equi-join with a ``right`` of one row for each key, whose column ``n`` tells how many rows of ``left`` have it.

    ``rows`` is the number of rows of ``left``, or more.  Keys with over a quarter of a task's share of them (and over
    ``least``, for rows so wide that fewer have to be sent) are broadcast: 4 times the shuffle width at most, as
    no more keys can have so many rows; their rows are then dealt evenly.  The others meet in a shuffle, by the
    join hint ``strategy`` also where ``right`` would be small enough to be sent.
    """
    most = max(HOT_ROWS, rows // (4 * partitions(left.sparkSession)), least)
    values = [c for c in right.columns if c not in (*on, "n")]
    of = F.struct(*values)
    hot = right.filter(F.col("n") > most).select(*on, of.alias("__hot"))
    # always 0, but not a constant: the optimizer would turn that into a filter and deal rows by ``on`` alone
    zero = F.when(F.col("n") > most, F.lit(1)).otherwise(F.lit(0)).cast("long").alias("__salt")
    cold = right.filter(F.col("n") <= most).select(*on, zero, of.alias("__cold"))
    if strategy:
        cold = cold.hint(strategy)
    salt = F.when(F.col("__hot").isNull(), F.lit(0)).otherwise(F.monotonically_increasing_id() + 1)
    dealt = left.join(F.broadcast(hot), on, "left").withColumn("__salt", salt).join(cold, [*on, "__salt"], "left")
    found = F.coalesce("__hot", "__cold")
    return dealt.select(*left.columns, *[found[c].alias(c) for c in values])


def without(docs: DataFrame, gone: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """The rows of ``docs`` whose ``keys``, by ``gone``'s names, aren't in ``gone``; nulls are equal.

    The row travels in a struct, so that no column of ``docs`` can clash with a key.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.struct(*[k.alias(name) for name, k in keys.items()]).alias("of"))
    named = gone.select(F.struct(*keys).alias("gone"))
    left = reduce(lambda a, b: a & b, [F.col(f"of.{k}").eqNullSafe(F.col(f"gone.{k}")) for k in keys])
    return rows.join(named, left, "left_anti").select(*[F.col("row")[c].alias(c) for c in docs.columns])


def numbered(rows: DataFrame, group: list[str], order: list[str], name: str) -> tuple[DataFrame, str]:
    """``rows`` with pos (from 0, in the order within its group) and size (of the group), and the path of the staged table.

    Rows are sorted in ranges of (group, order); counts of each group in each range, added up, give the places, so that a
    group of any size is split.  Ties are in the order of arrival.
    """
    by = [*group, *order, "__tie"]
    tied = rows.withColumn("__tie", F.monotonically_increasing_id())  # splits even equal rows
    ranged = tied.repartitionByRange(partitions(rows.sparkSession), *by).sortWithinPartitions(*by).drop("__tie")
    ranged, path = stage(ranged.select("*", F.spark_partition_id().alias("__range"), F.monotonically_increasing_id().alias("__seq")), name)
    counts = ranged.groupBy("__range", *group).agg(F.count(F.lit(1)).alias("__n"), F.min("__seq").alias("__first"))
    w = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))  # a row for each range and group in it
    before = F.coalesce(F.sum("__n").over(w.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("__range", *group, "__first", before.alias("__before"), F.sum("__n").over(w).alias("size"))
    found = ranged.join(counts, ["__range", *group])
    return found.select(*rows.columns, (F.col("__seq") - F.col("__first") + F.col("__before")).alias("pos"), "size"), path


def partitions(spark: SparkSession) -> int:
    """The session's shuffle width: the unit in which work is split."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the ids from which no label is learnt."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def held_out_id(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def tidied(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A batch function that hands unused memory back at its end: the worker lives on for other tasks."""

    @functools.wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # where the C library has it
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped


class Lists:
    """A growing table of lists of tokens, those of words, say; each is known by its place."""

    def __init__(self):
        self.flat, self.at, self.words, self.used = np.zeros(1 << 16, np.int32), np.zeros(1 << 14, np.int64), 0, 0

    def add(self, tokens: np.ndarray, sizes: np.ndarray) -> None:
        self.flat = self._room(self.flat, self.used + len(tokens))
        self.at = self._room(self.at, self.words + len(sizes) + 1)
        self.flat[self.used : self.used + len(tokens)] = tokens
        self.at[self.words + 1 : self.words + 1 + len(sizes)] = self.used + np.cumsum(sizes)
        self.words, self.used = self.words + len(sizes), self.used + len(tokens)

    @staticmethod
    def _room(a: np.ndarray, n: int) -> np.ndarray:
        if n <= len(a):
            return a
        out = np.zeros(max(n, 2 * len(a)), a.dtype)
        out[: len(a)] = a
        return out

    def sizes(self, words: np.ndarray) -> np.ndarray:
        return self.at[words + 1] - self.at[words]

    def of(self, words: np.ndarray) -> np.ndarray:
        """The lists at these places, one after another."""
        start = self.at[words]
        n = self.at[words + 1] - start
        return self.flat[np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())]


# --- word shingles ---------------------------------------------------------------

#: Words are runs of anything but space and the ASCII controls tab to carriage return.
WORD = re.compile(r"[^\x20\x09-\x0D]+")

_ODD = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63]


def mix64(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), elementwise."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Shingler:
    """Distinct word shingles of a text as sorted 64-bit hashes.

    Word hashes are kept between texts in a table of bounded size; a shingle's hash mixes
    those of its words in order.  With fewer words than ``k`` the whole sequence is one
    shingle; without words the set is empty.
    """

    def __init__(self, k: int = 5, limit: int = 100_000):
        import xxhash

        self.k, self.limit, self.seen, self.hash = k, limit, {}, xxhash.xxh3_64_intdigest

    def words(self, text: str | None) -> np.ndarray:
        words = WORD.findall(fold_ascii(text)) if text else []
        seen = self.seen
        try:
            out = [seen[w] for w in words]
        except KeyError:
            if len(seen) > self.limit:
                seen.clear()
            for w in set(words):
                if w not in seen:
                    seen[w] = self.hash(w)
            out = [seen[w] for w in words]
        return np.array(out, dtype=np.uint64)

    def __call__(self, text: str | None) -> np.ndarray:
        h = self.words(text)
        if not len(h):
            return h
        k = min(self.k, len(h))
        with np.errstate(over="ignore"):
            acc = np.full(len(h) - k + 1, k, dtype=np.uint64)
            for j in range(k):
                acc = mix64(acc * np.uint64(_ODD[j % 5]) + h[j : len(h) - k + 1 + j])
        return np.unique(acc)
