"""Importance resampling towards a target corpus, over inverted postings partitioned by hash bucket.

A text's features are its runs of up to ``grams`` words, hashed into ``BUCKETS`` buckets.  A bucket's gain is the
logarithm of its smoothed share in the target over that in the corpus, a document's weight the mean gain of its
features, and documents are drawn without replacement by the weight plus Gumbel noise from a hash of their id.

1. ``postings`` reads each text once, in blocks of bounded size: for each bucket of a block one row with the places of
   the documents that hold it and their counts, so that a document's features leave the task added up.
2. The counts of both corpora are co-grouped by bucket, added up before they move: ``BUCKETS`` rows at most.
3. Posting rows move to their bucket and meet its counts there.  A bucket has a row for each block it occurs in;
   those with more than a task's share of the rows are dealt evenly and get their counts by broadcast.
4. The gain makes each posting a contribution; contributions return to their block and are added up by document.
5. Scores are sorted in ranges, and prefix counts of the ranges give the ranks.

Gains are whole thousandths, so that sums don't depend on an order.  Edge cases: a null text has no words; without features
the weight is 0; a null id is hashed as no digits and comes before all others in ties; rows that repeat an id are documents
of their own, with the same noise; an empty corpus gives an empty result, and an empty target smoothed gains; one text of any
length is a block of its own with ``BUCKETS`` postings at most; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rostrum.llm import shared

#: Hash buckets, words in a feature at most, least words of a document that can be drawn, percent drawn, and the noise's seed.
BUCKETS, GRAMS, LEAST_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, 2024
#: Documents and postings of a block, and characters that are cut into words at a time.
BLOCK_DOCS, BLOCK_POSTINGS, CHARS = 1_500, 400_000, 4_000_000
#: Features whose buckets a worker keeps.
KNOWN = 300_000

#: Words are runs of ASCII letters and digits and of all that isn't ASCII.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

POSTINGS = "block long, bucket int, n long, places array<int>, counts array<int>, ids array<long>, words array<int>"


class Buckets:
    """Buckets of features; those of known ones are kept, in a table that is begun anew when it is full."""

    def __init__(self, buckets: int, grams: int):
        self.buckets, self.grams, self.known = buckets, grams, {}

    def __call__(self, words: list[str], counted: int = 0) -> list[int]:
        """The buckets of all features that don't end in the first ``counted`` words."""
        out: list[int] = []
        known = self.known
        for k in range(1, self.grams + 1):
            first = max(counted - k + 1, 0)
            runs = words[first:] if k == 1 else [" ".join(words[i : i + k]) for i in range(first, len(words) - k + 1)]
            try:
                out += [known[x] for x in runs]
            except KeyError:
                if len(known) > KNOWN:
                    known.clear()
                for x in set(runs):
                    if x not in known:
                        known[x] = zlib.crc32(x.encode()) % self.buckets
                out += [known[x] for x in runs]
        return out


def parts(text: str, grams: int) -> Iterator[tuple[list[str], int]]:
    """The words of a text; those of a long one in parts, each with the last ``grams - 1`` words before it, and their number."""
    tail: list[str] = []
    start = 0
    while start < len(text):
        end = min(start + CHARS, len(text))
        while end < len(text) and all(WORD.match(shared.fold_ascii(c)) for c in text[end - 1 : end + 1]):
            end += 1  # not inside a word
        words = tail + WORD.findall(shared.fold_ascii(text[start:end]))
        yield words, len(tail)
        tail = words[max(len(words) - grams + 1, 0) :] if grams > 1 else []
        start = end


def postings(docs: DataFrame, buckets: int = BUCKETS, grams: int = GRAMS) -> DataFrame:
    """Rows of ``POSTINGS``: of each block one for each bucket, and one without a bucket that has its documents' ids, features and words.

    ``n`` is the number of the bucket's features, or of all features of the block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = Buckets(buckets, grams)
        block = TaskContext.get().partitionId() << 33
        ids: list[int | None] = []
        own: list[np.ndarray] = []
        each: list[np.ndarray] = []
        totals: list[int] = []
        words: list[int] = []
        held = 0

        def close() -> Iterator[pa.RecordBatch]:
            sizes = np.fromiter(map(len, own), np.int64, len(own))
            bucket = np.concatenate(own)
            order = np.argsort(bucket, kind="stable")
            bucket = bucket[order]
            places = np.repeat(np.arange(len(own), dtype=np.int32), sizes)[order]
            counts = np.concatenate(each)[order]
            starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, np.int64)
            k = len(starts)
            offsets = pa.array(np.append(starts, len(bucket)).astype(np.int32))
            sums = np.add.reduceat(counts.astype(np.int64), starts) if k else np.zeros(0, np.int64)
            names = ["block", "bucket", "n", "places", "counts", "ids", "words"]
            none = pa.array([None], pa.list_(pa.int32()))
            head = [pa.array([block]), pa.array([None], pa.int32()), pa.array([sum(totals)]), none, pa.array([totals], pa.list_(pa.int32())), pa.array([ids], pa.list_(pa.int64())), pa.array([words], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(head, names=names)
            body = [pa.array(np.full(k, block)), pa.array(bucket[starts].astype(np.int32)), pa.array(sums), pa.ListArray.from_arrays(offsets, pa.array(places)), pa.ListArray.from_arrays(offsets, pa.array(counts))]
            whole = pa.RecordBatch.from_arrays([*body, pa.nulls(k, pa.list_(pa.int64())), pa.nulls(k, none.type)], names=names)
            for at in range(0, k, 2000):
                yield whole.slice(at, 2000)

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                sums, n, n_words = None, 0, 0
                for part, counted in parts(text.as_py() or "", grams):
                    found = hashed(part, counted)
                    n, n_words = n + len(found), n_words + len(part) - counted
                    if sums is None and n <= buckets:
                        distinct, count = np.unique(np.array(found, np.int64), return_counts=True)
                        sums = distinct, count
                    else:  # a long text, or one of several parts
                        dense = np.bincount(np.array(found, np.int64), minlength=buckets)
                        if sums is not None:
                            np.add.at(dense, *sums)
                        sums = np.flatnonzero(dense), dense[dense > 0]
                distinct, count = sums or (np.zeros(0, np.int64), np.zeros(0, np.int64))
                ids.append(doc_id)
                own.append(distinct)
                each.append(count.astype(np.int32))
                totals.append(n)
                words.append(n_words)
                held += len(distinct)
                if len(ids) >= BLOCK_DOCS or held >= BLOCK_POSTINGS:
                    yield from close()
                    block += 1
                    ids, own, each, totals, words, held = [], [], [], [], [], 0
        if ids:
            yield from close()

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")).mapInArrow(shared.tidied(run), POSTINGS)


def gain(s: Column, t: Column, corpus: int, target: int, buckets: int = BUCKETS) -> Column:
    """Thousandths of the logarithm of a bucket's smoothed share in the target over that in the corpus."""
    ratio = (t + 1).cast("double") * F.lit(float(corpus + buckets)) / ((s + 1).cast("double") * F.lit(float(target + buckets)))
    return F.floor(F.lit(1000.0) * F.log(ratio))


def _sum_blocks(table: pa.Table) -> pa.Table:
    """The contributions of a block's postings, added up by the document's place."""
    places, counts = (table[c].combine_chunks() for c in ("places", "counts"))
    gains = np.repeat(table["gain"].to_numpy(), np.diff(places.offsets.to_numpy()))
    at = places.flatten().to_numpy()
    sums = np.zeros(int(at.max()) + 1, np.int64)
    np.add.at(sums, at, gains * counts.flatten().to_numpy())
    return pa.table({"block": table["block"].slice(0, 1), "sums": pa.array([sums], pa.list_(pa.int64()))})


def weigh(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, grams: int = GRAMS) -> DataFrame:
    """doc_id, n_features, n_words, weight for every row of ``docs``; ``target`` has a column text."""
    spark = docs.sparkSession
    own, _ = shared.stage(postings(docs, buckets, grams), "resample-postings")
    other, other_path = shared.stage(postings(target.select(F.lit(None).alias("doc_id"), target["text"].alias("text")), buckets, grams).select("bucket", "n"), "resample-target")
    sums = own.groupBy("bucket").agg(F.sum("n").alias("s"), F.count(F.lit(1)).alias("rows"))
    met = sums.join(other.groupBy("bucket").agg(F.sum("n").alias("t")), "bucket", "left").filter("bucket is not null")
    totals = [x.filter("bucket is null").agg(F.sum("n")).first()[0] or 0 for x in (own, other)]
    met, _ = shared.stage(met.select("bucket", "s", F.coalesce("t", F.lit(0)).alias("t"), F.col("rows").alias("n")), "resample-buckets")
    shared.drop(spark, other_path)
    lists = own.filter("bucket is not null").select("block", "bucket", "places", "counts")
    # by the bucket also where its counts would be small enough to be sent
    dealt = shared.join_counted(lists, met, ["bucket"], met.agg(F.sum("n")).first()[0] or 0, strategy="shuffle_hash")
    given = dealt.select("block", "places", "counts", gain(F.col("s"), F.col("t"), *totals, buckets).alias("gain"))
    summed = given.groupBy("block").applyInArrow(_sum_blocks, "block long, sums array<long>")
    heads = own.filter("bucket is null").select("block", "ids", F.col("counts").alias("features"), "words")
    each = heads.join(summed, "block", "left").select(F.explode(F.arrays_zip("ids", "features", "words", F.coalesce("sums", F.array().cast("array<long>")).alias("sums"))).alias("d"))
    rows = each.select(F.col("d.ids").alias("doc_id"), F.col("d.features").cast("long").alias("n_features"), F.col("d.words").cast("long").alias("n_words"), F.coalesce("d.sums", F.lit(0)).alias("total"))
    weight = F.when(F.col("n_features") > 0, F.expr("(total - pmod(total, n_features)) div n_features")).otherwise(F.lit(0))
    return rows.select("doc_id", "n_features", "n_words", weight.cast("long").alias("weight"))


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Thousandths of Gumbel noise from the hash of an id."""
    digest = F.sha2(F.encode(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), "UTF-8"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def draw(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, grams: int = GRAMS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank for every row of ``docs``; the rank, from 1, is null for those not drawn.

    Of the documents with ``least_words`` words, ``percent`` of a hundred are drawn, rounded down.
    """
    scored = weigh(docs, target, buckets, grams)
    scored = scored.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)).withColumn("able", F.col("n_words") >= least_words)
    scored = scored.withColumn("minus", -F.col("score"))
    placed, _ = shared.numbered(scored, ["able"], ["minus", "doc_id"], "resample-order")
    drawn = F.col("able") & ((F.col("pos") + 1) * 100 <= F.col("size") * percent)
    return placed.select("doc_id", "n_features", "weight", "score", F.when(drawn, F.col("pos") + 1).alias("rank"))
