"""Quality rules: counts of every whole text, fixed limits, and an isolation forest on what the counts say together.

1. ``measure`` counts words, their characters, symbols, repeated lines, words in repeated passages and kinds of characters,
   one pass in Arrow batches, whole texts at a time.
2. Fixed limits reject texts of under ``LEAST_WORDS`` words and those with over ``MOST_REPEATED`` percent of repeated words.
3. ``fit`` grows ``TREES`` trees of random splits on ratios of the counts.  The method has each tree isolate ``SAMPLE`` documents, which it
   draws from all labelled rows, however many; the draws are made where the rows are, and a tree is grown in a task.  A document that
   few splits set apart has short paths and a high anomaly score.
4. The score from which documents go is calibrated on all labelled rows, by counts of each score added up over ranges of scores: of
   all cuts that lose ``GOOD_LOST`` of the good ones at most, the one that tells bad from good best.

No labelled row is left out.  The forest is a few hundred kilobytes and goes with the task.  Without good and bad labelled rows
only the fixed limits reject.

Edge cases: a null text counts as empty; without words all counts are 0 and the limits reject it; with fewer than five
words nothing is a repeated passage; characters beyond U+FFFF count as signs in the ratios; equal texts have equal
scores, so that ties go or stay together; repeated rows and ids are judged each; an empty table gives an empty result; other columns are
ignored, whatever their names.  A task holds one Arrow batch of texts, and of a text some 60 bytes for each word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rostrum.llm import shared

#: Limits: words at least, percent of words in repeated windows at most, and words of a window.
LEAST_WORDS, MOST_REPEATED, WINDOW = 10, 20, 5
#: Trees, documents of a tree (few, so that junk of one kind doesn't hide itself), share of good labelled rows that may be lost, and the seed.
TREES, SAMPLE, GOOD_LOST, SEED = 200, 64, 0.004, 3
#: A row may be in a tree's draw if its hash is among the least such multiple of ``SAMPLE``; fewer than ``SAMPLE`` such rows don't come about.
AMPLE = 8
#: Documents that are scored at a time.
PART = 1000

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Further counts for the forest only.
MORE = ["n_lines", "n_upper", "n_letters", "n_digits"]

# Characters between words, and those that count as symbols.
SPACES, SYMBOLS = " \t\n\v\f\r", "#*$%&|<>"
WORD = re.compile(r"[^\x20\x09-\x0D]+")

_KINDS: list[np.ndarray] = []


def _kinds() -> np.ndarray:
    """Bits of each code point up to U+FFFF: in a word, symbol, upper case, letter, digit."""
    if not _KINDS:
        table = np.zeros(1 << 16, np.uint8)
        for i in range(1 << 16):
            c = chr(i)
            table[i] = (c not in SPACES) + 2 * (c in SYMBOLS) + 4 * c.isupper() + 8 * c.isalpha() + 16 * c.isdigit()
        _KINDS.append(table)
    return _KINDS[0]


def repeated_words(words: list[str], window: int = WINDOW) -> int:
    """Words in windows that occur twice or more."""
    n = len(words)
    if n <= window:
        return 0
    known: dict[str, int] = {}
    own = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    if len(known) == n:
        return 0
    # windows are numbered by their first words and their last one, so that equal numbers are equal windows
    ids, kinds = own, len(known)
    for k in range(1, window):
        distinct, ids = np.unique(ids[:-1] * kinds + own[k:] if k > 1 else own[:-1] * kinds + own[1:], return_inverse=True)
        if len(distinct) == len(ids):
            return 0  # shorter windows that differ make longer ones that differ
    often = np.bincount(ids)[ids] > 1
    cover = np.zeros(n + 1, np.int64)
    cover[: n - window + 1] += often
    cover[window:] -= often
    return int((np.cumsum(cover) > 0).sum())


def counts_of(text: str | None) -> tuple[int, ...]:
    """``COUNTS`` and ``MORE`` of a text."""
    text = text or ""
    words = WORD.findall(text)
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    kinds = _kinds()[np.minimum(codes, 0xFFFF)]
    # U+FFFF isn't a character, and counts in a word as any code point beyond
    of = np.bincount(kinds, minlength=32)
    total = lambda bit: int(of[[k for k in range(32) if k & bit]].sum())
    lines, seen, again = 0, set(), 0
    for line in text.split("\n"):
        if line.strip(SPACES):
            lines += 1
            again += line in seen
            seen.add(line)
    return len(words), total(1), total(2), again, repeated_words(words), lines, total(4), total(8), total(16)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, PART):
            part = b.slice(at, PART)
            found = np.array([counts_of(t.as_py()) for t in part.column(1)], np.int64).reshape(-1, len(COUNTS + MORE))
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c) for c in found.T.copy())], names=["doc_id", *COUNTS, *MORE])


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, ``COUNTS`` and ``MORE`` of every row."""
    schema = ", ".join(f"{c} long" for c in ["doc_id", *COUNTS, *MORE])
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")).mapInArrow(shared.tidied(_measure), schema)


def failed(n_words, n_repeat_words):
    """Whether the fixed limits reject; of columns or arrays."""
    return (n_words < LEAST_WORDS) | (n_repeat_words * 100 > n_words * MOST_REPEATED)


def ratios(counts: np.ndarray) -> np.ndarray:
    """What the forest looks at, by rows of ``COUNTS`` and ``MORE``: none of it grows with a text's length."""
    words, chars, symbols, _, repeats, lines, upper, letters, digits = counts.T.astype(np.float64)
    n, inside = np.maximum(words, 1), np.maximum(chars, 1)
    return np.stack([chars / n, symbols / n, repeats / n, upper / np.maximum(letters, 1), (chars - letters - digits) / inside, np.log(n / np.maximum(lines, 1))], axis=1)


def mean_path(n: int) -> float:
    """The mean path of an unsuccessful search among ``n``: what a leaf of so many documents adds to its depth."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (float(np.log(n - 1)) + 0.5772156649015329) - 2 * (n - 1) / n


@dataclass(frozen=True)
class Forest:
    """Trees as rows of nodes, the children of node k at 2 k + 1 and 2 k + 2; ``path`` is negative inside of a tree."""

    feature: np.ndarray
    split: np.ndarray
    path: np.ndarray
    sample: int
    cut: float = np.inf

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Anomaly scores between 0 and 1; 0.5 is a mean path."""
        trees = np.arange(len(self.path))
        rows = np.arange(len(x))[:, None]
        node = np.zeros((len(x), len(trees)), np.int32)
        for _ in range(int(self.path.shape[1]).bit_length() - 1):
            on = self.path[trees, node] < 0
            right = x[rows, self.feature[trees, node]] >= self.split[trees, node]
            node = np.where(on, 2 * node + 1 + right, node)
        return 2 ** (-self.path[trees, node].mean(axis=1) / max(mean_path(self.sample), 1e-9))


def grow(x: np.ndarray, trees: int = TREES, sample: int = SAMPLE, seed: int = SEED) -> Forest:
    """A forest of random splits over rows of ``x``."""
    rng = np.random.default_rng(seed)
    sample = min(sample, len(x))
    depth = max(int(np.ceil(np.log2(max(sample, 2)))), 1)
    feature = np.zeros((trees, 2 ** (depth + 1) - 1), np.int32)
    split, path = np.zeros(feature.shape), np.zeros(feature.shape)
    for t in range(trees):
        open_ = [(0, rng.choice(len(x), sample, replace=False), 0)]
        while open_:
            node, rows, at = open_.pop()
            low, high = x[rows].min(axis=0), x[rows].max(axis=0)
            able = np.flatnonzero(high > low)
            if at == depth or not len(able):
                path[t, node] = at + mean_path(len(rows))
                continue
            f = int(rng.choice(able))
            cut = rng.uniform(low[f], high[f])
            right = x[rows, f] >= cut
            feature[t, node], split[t, node], path[t, node] = f, cut, -1
            # a cut at the very least value would leave a side empty
            if right.all():
                split[t, node] = cut = high[f]
                right = x[rows, f] >= cut
            open_ += [(2 * node + 1, rows[~right], at + 1), (2 * node + 2, rows[right], at + 1)]
    return Forest(feature, split, path, sample)


def calibrated(scores: np.ndarray, good: np.ndarray, lost: float = GOOD_LOST) -> float:
    """The score above which documents go: of the cuts that lose a share ``lost`` of the good rows at most, the best.

    The best has the largest difference of the shares of bad and good rows above it, and is the highest such; without both kinds none is.
    """
    if good.all() or not good.any():
        return np.inf
    cuts = np.unique(scores)
    above = lambda s: 1 - np.searchsorted(np.sort(s), cuts, side="right") / len(s)
    bad_gone, good_gone = above(scores[~good]), above(scores[good])
    gain = np.where(good_gone <= lost, bad_gone - good_gone, -1.0)
    best = int(len(cuts) - 1 - np.argmax(gain[::-1]))
    # halfway to the next score
    return float(cuts[best] if best + 1 == len(cuts) else (cuts[best] + cuts[best + 1]) / 2)


def fit(docs: DataFrame, labels: DataFrame) -> Forest | None:
    """A calibrated forest from all labelled rows outside the held-out fifth; None without any."""
    return fitted(measure(docs), labels)


def fitted(counts: DataFrame, labels: DataFrame) -> Forest | None:
    """``fit`` by rows of ``measure``; of an id's rows and labels the least counts."""
    spark = counts.sparkSession
    known = labels.filter(F.col("quality").isin(0, 1) & ~shared.held_out(F.col("doc_id"))).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y"))
    known = known.groupBy("doc_id").agg(F.min("y").alias("y"))
    one = counts.join(known, "doc_id").groupBy("doc_id").agg(F.min(F.struct("y", *COUNTS, *MORE)).alias("of")).select("doc_id", "of.*")
    rows, path = shared.stage(one, "rules-labelled")
    try:
        total = rows.count()
        if not total:
            return None
        forest = grown(rows, total)
        return Forest(forest.feature, forest.split, forest.path, forest.sample, best_cut(scored(rows, forest)))
    finally:
        shared.drop(spark, path)


def _values(part: pa.RecordBatch) -> np.ndarray:
    return np.stack([part.column(c).to_numpy() for c in COUNTS + MORE], axis=1)


def drawn(rows: DataFrame, total: int, trees: int = TREES, sample: int = SAMPLE, seed: int = SEED) -> DataFrame:
    """tree, h, doc_id, x: the ``sample`` of all ``total`` rows (doc_id and counts) with the least hashes of id and tree, for each tree."""
    bar = np.uint64(min(AMPLE * sample / total, 1.0) * (2**64 - 2**12))
    with np.errstate(over="ignore"):
        salts = shared.mix64(np.arange(1, trees + 1, dtype=np.uint64) + np.uint64(seed) * np.uint64(1 << 32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, PART):
                part = b.slice(at, PART)
                ids = part.column("doc_id").to_numpy().astype(np.int64)
                with np.errstate(over="ignore"):
                    h = shared.mix64(shared.mix64(ids.view(np.uint64))[:, None] + salts)
                row, tree = np.nonzero(h <= bar) if total > AMPLE * sample else np.nonzero(np.ones(h.shape, bool))
                x = ratios(_values(part))[row]
                lists = pa.ListArray.from_arrays(np.arange(len(row) + 1, dtype=np.int32) * x.shape[1], pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(tree.astype(np.int32)), pa.array((h[row, tree] >> np.uint64(1)).astype(np.int64)), pa.array(ids[row]), lists], names=["tree", "h", "doc_id", "x"])

    able = rows.mapInArrow(shared.tidied(run), "tree int, h long, doc_id long, x array<double>")
    least = Window.partitionBy("tree").orderBy("h", "doc_id")
    return able.withColumn("place", F.row_number().over(least)).filter(F.col("place") <= sample).drop("place")


def grown(rows: DataFrame, total: int, trees: int = TREES, sample: int = SAMPLE, seed: int = SEED) -> Forest:
    """A forest whose trees draw from all ``total`` rows (doc_id and counts); each tree is grown in a task."""
    sample = min(sample, total)

    def run(key: tuple, table: pa.Table) -> pa.Table:
        order = table.sort_by([("h", "ascending"), ("doc_id", "ascending")])
        own = grow(np.array(order.column("x").to_pylist()), 1, sample, seed + 1 + key[0].as_py())
        return pa.table({"tree": pa.array([key[0].as_py()], pa.int32()), "feature": [own.feature[0].tolist()], "split": [own.split[0].tolist()], "path": [own.path[0].tolist()]})

    found = drawn(rows, total, trees, sample, seed).groupBy("tree").applyInArrow(run, "tree int, feature array<long>, split array<double>, path array<double>")
    got = sorted(found.collect(), key=lambda r: r.tree)  # a few hundred kilobytes, whatever the input
    return Forest(np.array([r.feature for r in got], np.int32), np.array([r.split for r in got]), np.array([r.path for r in got]), sample)


def scored(rows: DataFrame, forest: Forest) -> DataFrame:
    """score, y of the rows (y and counts) that pass the fixed limits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, PART):
                part = b.slice(at, PART)
                own = _values(part)
                passes = ~failed(own[:, 0], own[:, COUNTS.index("n_repeat_words")])
                yield pa.RecordBatch.from_arrays([pa.array(forest.scores(ratios(own[passes]))), part.column("y").filter(pa.array(passes))], names=["score", "y"])

    return rows.select("y", *COUNTS, *MORE).mapInArrow(shared.tidied(run), "score double, y int")


def best_cut(rows: DataFrame, lost: float = GOOD_LOST) -> float:
    """``calibrated`` over rows (score, y) of any number: counts of each score, added up in ranges of scores."""
    spark = rows.sparkSession
    each = rows.groupBy("score").agg(F.sum("y").alias("good"), F.sum(1 - F.col("y")).alias("bad"))
    each, path = shared.stage(each.repartitionByRange(shared.partitions(spark), "score").withColumn("range", F.spark_partition_id()), "rules-scores")
    try:
        all_of = each.agg(F.sum("good"), F.sum("bad")).first()
        if not all_of[0] or not all_of[1]:
            return float(np.inf)
        before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
        sums = each.groupBy("range").agg(F.sum("good").alias("g"), F.sum("bad").alias("b")).select("range", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in "gb"])
        upto = Window.partitionBy("range").orderBy("score").rowsBetween(Window.unboundedPreceding, 0)
        held = each.join(F.broadcast(sums), "range").select("score", (F.col("g") + F.sum("good").over(upto)).alias("good"), (F.col("b") + F.sum("bad").over(upto)).alias("bad"))
        good_gone, bad_gone = 1 - F.col("good") / all_of[0], 1 - F.col("bad") / all_of[1]
        gain = F.when(good_gone <= lost, bad_gone - good_gone).otherwise(-1.0)
        best = held.agg(F.max(F.struct(gain.alias("gain"), "score")).alias("best")).first()["best"]["score"]
        after = each.filter(F.col("score") > best).agg(F.min("score")).first()[0]
        return best if after is None else (best + after) / 2  # halfway to the next score
    finally:
        shared.drop(spark, path)


def judge(counts: DataFrame, forest: Forest | None) -> DataFrame:
    """doc_id, ``COUNTS``, base_failed, score and kept for rows of ``measure``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, PART):
                part = b.slice(at, PART)
                own = _values(part)
                score = np.full(len(own), 0.5) if forest is None else forest.scores(ratios(own))
                base = failed(own[:, 0], own[:, COUNTS.index("n_repeat_words")])
                kept = ~base & (score <= (np.inf if forest is None else forest.cut))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ["doc_id", *COUNTS]), pa.array(base), pa.array(score), pa.array(kept)], names=["doc_id", *COUNTS, "base_failed", "score", "kept"])

    schema = ", ".join(f"{c} long" for c in ["doc_id", *COUNTS]) + ", base_failed boolean, score double, kept boolean"
    return counts.mapInArrow(shared.tidied(run), schema)
