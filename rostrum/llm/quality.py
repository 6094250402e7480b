"""Document quality by Bradley-Terry pairwise ranking.

A document's strength is linear in features of its whole text: shares of character
classes, hashed byte pairs, repetition of words and lines, and lengths.  Preference pairs
(a document of quality 1 beats one of quality 0) are drawn from the labelled training rows,
and the weights minimise the logistic loss on feature differences, as in the Bradley-Terry
model.  The cut is a quantile of the training rows' strengths: the share that is labelled
0.  ``score`` is the logistic of the distance to the cut, shifted so that the cut
itself scores 0.3.

Features are computed on the executors in batches; only the feature rows of a bounded
labelled sample (``max_rows``) reach the driver, where numpy fits a weight vector of fixed
length.  Scoring is one pass over the documents without any shuffle.

Edge cases: null text counts as empty and gets a score like any other; copies
score alike; without labels of both kinds every document scores 0.5; labels with nulls or
for missing documents are not used; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from rostrum.llm import shared

#: Labelled rows at most that the fit looks at; they are chosen by a hash of the id.
MAX_ROWS = 12_000
#: Preference pairs drawn from them.
PAIRS = 60_000
#: The score at the cut.
CUT_SCORE = 0.3

PAIR_BUCKETS = 512
_ENDS_ODD = re.compile(r"[^\w\s]{2,}(?:\s|$)")


def features(text: str | None) -> np.ndarray:
    """The feature vector of one whole text."""
    text = text or ""
    data = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
    n = max(len(data), 1)
    ones = np.bincount(data, minlength=256) / n
    pairs = np.zeros(PAIR_BUCKETS)
    for at in range(0, max(len(data) - 1, 0), 1 << 20):  # long texts in pieces, so that memory stays bounded
        piece = data[at : at + (1 << 20) + 1].astype(np.int64)
        pairs += np.bincount((piece[:-1] * 257 + piece[1:]) * 2654435761 % 4294967291 % PAIR_BUCKETS, minlength=PAIR_BUCKETS)
    words, lines = text.split(), text.split("\n")
    counts = Counter(words)
    m = max(len(words), 1)
    upper = ones[65:91].sum()
    letters = upper + ones[97:123].sum() + ones[128:].sum()
    repeats = sum(a == b for a, b in zip(words, words[1:], strict=False)) / m
    dense = [
        np.log1p(len(data)) / 10,
        np.log1p(len(words)) / 8,
        len(counts) / m,
        max(counts.values(), default=0) / m,
        repeats,
        len(set(lines)) / len(lines),
        len(_ENDS_ODD.findall(text)) / m,
        upper / max(letters, 1e-9),
        letters,
        len(data) / m / 20,
        sum(len(w) <= 2 for w in words) / m,
        float(not words),
    ]
    return np.concatenate([np.sqrt(ones), np.sqrt(pairs / n), dense]).astype(np.float32)


@dataclass(frozen=True)
class Ranker:
    weights: np.ndarray
    cut: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = x @ self.weights - self.cut + np.log(CUT_SCORE / (1 - CUT_SCORE))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit_pairs(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, steps: int = 300, l2: float = 3e-4, seed: int = 7) -> Ranker | None:
    """Bradley-Terry weights from rows ``x`` with labels ``y``; None unless both labels occur."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return None
    scale = x.std(axis=0) + 1e-3
    rng = np.random.default_rng(seed)
    win, lose = rng.choice(good, pairs), rng.choice(bad, pairs)
    z = (x / scale).astype(np.float32)
    w, m, v = np.zeros(x.shape[1]), np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for t in range(1, steps + 1):
        part = slice((t - 1) * 4096 % pairs, (t - 1) * 4096 % pairs + 4096)
        diff = z[win[part]] - z[lose[part]]
        miss = 1 / (1 + np.exp(np.clip(diff @ w, -50, 50)))  # chance that the model gives to the loser
        grad = -(diff * miss[:, None]).mean(axis=0) + l2 * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w -= 0.03 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    weights = w / scale
    return Ranker(weights, float(np.quantile(x @ weights, (y == 0).mean())))


def _featurise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame({"y": b["y"], "x": [features(t).tobytes() for t in b["text"]]})


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Ranker | None:
    """Learn from the labelled rows outside the held-out fifth, ``max_rows`` at most."""
    known = labels.filter(F.col("quality").isin(0, 1) & ~shared.held_out(F.col("doc_id"))).select("doc_id", F.col("quality").cast("int").alias("y"))
    chosen = known.dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # bounded by max_rows
    got = rows.select("y", "text").mapInPandas(_featurise, "y int, x binary").toPandas()
    if not len(got):
        return None
    got = got.sort_values(["x", "y"])  # the order of arrival must not matter
    x = np.frombuffer(b"".join(got["x"]), dtype=np.float32).reshape(len(got), -1)
    return fit_pairs(x, got["y"].to_numpy())


def score(docs: DataFrame, ranker: Ranker | None) -> DataFrame:
    """``docs`` with columns score and predicted appended, in the place of any so called; other columns stay, whatever their names."""
    names = [c for c in docs.columns if c not in ("score", "predicted")]
    # numbered, as names with dots can't be handed to Python
    kept = docs.select(*[F.col(f"`{c}`") for c in names]).toDF(*[f"c{i}" for i in range(len(names))])
    body = f"c{names.index('text')}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 1000):
                part = b.iloc[at : at + 1000]
                s = np.full(len(part), 0.5) if ranker is None else ranker.scores(np.stack([features(t) for t in part[body]]))
                yield part.assign(score=s, predicted=(s >= CUT_SCORE).astype(np.int32))

    schema = StructType([*kept.schema.fields, StructField("score", DoubleType()), StructField("predicted", IntegerType())])
    return kept.mapInPandas(shared.tidied(run), schema).toDF(*names, "score", "predicted")
