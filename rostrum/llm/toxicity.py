"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over the presence of words is trained in numpy from confirmed toxic
documents and unlabelled ones.  The risk is the class-prior-corrected estimator

    R(f) = p * E_P[l(f, 1)] + max(0, E_U[l(f, 0)] - p * E_P[l(f, 0)]),

with the logistic loss l and class prior p; where the second term turns negative, the
step goes against its gradient, so that the classifier can't overfit the positives by
pushing the estimated negative risk below zero.  No row is taken as a negative:
rows labelled 0 are unlabelled text like all others outside the held-out fifth.  The prior
is the toxic share of the labelled training rows, counted over all of them.

Words are runs of letters in lower case; each is hashed, and the fit keeps the
``max_words`` words that tell the toxic rows best from the unlabelled ones.  Only hashed
words of a bounded sample (``max_positive``, ``max_unlabelled``) reach the driver.  Scoring
is one pass over whole texts without any shuffle, and the model has a fixed size.

Edge cases: null and empty texts have no words and score the classifier's offset; copies
score alike; without a toxic training row every document scores 0; labels with
nulls or for missing documents are not used; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from rostrum.llm import shared

#: Rows at most that the fit looks at, chosen by a hash of the id; words that it keeps.
MAX_POSITIVE, MAX_UNLABELLED, MAX_WORDS = 3_000, 6_000, 1_024
#: Training rows in which a word must occur to be kept, and the most that a worker's table of words holds.
MIN_ROWS, CACHE = 3, 400_000
#: Least log-likelihood ratio (against the same rate in both kinds of rows) of a word that is kept.
MIN_RATIO = 6.0

_WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> set[str]:
    """The distinct words of a text: runs of letters, in lower case."""
    return set(_WORD.findall(text.lower())) if text else set()


def code(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "replace"))


@dataclass(frozen=True)
class Detector:
    weights: dict[int, float]
    offset: float

    def score(self, text: str | None, seen: dict[str, float]) -> float:
        """``seen`` keeps the weights of words between texts, within a bound."""
        found: list[float] = []
        for w in words(text):
            x = seen.get(w)
            if x is None:
                if len(seen) > CACHE:
                    seen.clear()
                x = seen[w] = self.weights.get(code(w), 0.0)
            if x:
                found.append(x)
        z = self.offset + sum(sorted(found))
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def choose_words(pos: list[np.ndarray], unl: list[np.ndarray], max_words: int) -> np.ndarray:
    """Codes that occur in the toxic rows far more often than in the unlabelled ones, or far less."""
    p, n_p = np.unique(np.concatenate(pos), return_counts=True)
    u, n_u = np.unique(np.concatenate([*unl, np.zeros(0, p.dtype)]), return_counts=True)
    codes = np.union1d(p, u)
    a, b = np.zeros(len(codes)), np.zeros(len(codes))
    a[np.searchsorted(codes, p)], b[np.searchsorted(codes, u)] = n_p, n_u
    enough = a + b >= MIN_ROWS
    codes, a, b = codes[enough], a[enough], b[enough]
    share = (a + b) / (len(pos) + len(unl))
    with np.errstate(divide="ignore", invalid="ignore"):
        g = np.nan_to_num(a * np.log(a / (share * len(pos)))) + np.nan_to_num(b * np.log(b / (share * max(len(unl), 1))))
    order = np.lexsort((codes, -g))[:max_words]
    return np.sort(codes[order[g[order] >= MIN_RATIO]])


def fit_nnpu(pos: list[np.ndarray], unl: list[np.ndarray], prior: float, max_words: int = MAX_WORDS, steps: int = 400, l2: float = 1e-4, rate: float = 0.05) -> Detector | None:
    """The detector for toxic rows ``pos`` and unlabelled rows ``unl``, each an array of word codes."""
    if not pos or not sum(map(len, pos)):
        return None
    codes = choose_words(pos, unl, max_words)

    def matrix(rows: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(rows), len(codes)), np.float32)
        for i, r in enumerate(rows):
            at = np.searchsorted(codes, r)
            at = at[(at < len(codes))]
            out[i, at[np.isin(codes[at], r)]] = 1
        return out

    xp, xu = matrix(pos), matrix(unl) if unl else np.zeros((1, len(codes)), np.float32)
    w, b = np.zeros(len(codes) + 1), 0.0
    m, v = np.zeros_like(w), np.zeros_like(w)
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -50, 50)))
    w[-1] = np.log(prior / (1 - prior))
    for t in range(1, steps + 1):
        sp, su = sig(xp @ w[:-1] + w[-1]), sig(xu @ w[:-1] + w[-1])
        # l(f, 1) = -log s and l(f, 0) = -log(1 - s): their slopes in f are s - 1 and s
        negative = -np.log(np.maximum(1 - su, 1e-9)).mean() + prior * np.log(np.maximum(1 - sp, 1e-9)).mean()
        up, pp = su / len(su), prior * sp / len(sp)
        if negative >= 0:
            gp, gu = prior * (sp - 1) / len(sp) - pp, up
        else:
            gp, gu = pp, -up
        grad = np.append(gp @ xp + gu @ xu, gp.sum() + gu.sum())
        grad[:-1] += l2 * w[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Detector({int(c): float(x) for c, x in zip(codes, w[:-1], strict=True)}, float(w[-1]))


def encode(text: str | None) -> np.ndarray:
    """The distinct codes of a text, sorted."""
    return np.unique(np.array([code(w) for w in words(text)], dtype=np.uint32))


def _encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame({"p": b["p"], "x": [encode(t).tobytes() for t in b["text"]]})


def fit(docs: DataFrame, labels: DataFrame, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED, max_words: int = MAX_WORDS) -> Detector | None:
    """Learn from confirmed toxic rows and unlabelled text outside the held-out fifth."""
    known = labels.filter(F.col("toxic").isin(0, 1) & ~shared.held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counted = known.agg(F.count("*").alias("n"), F.sum("toxic").alias("k")).first()
    if not counted["k"]:
        return None
    by = (F.xxhash64("doc_id"), "doc_id")
    toxic = known.filter("toxic = 1").select("doc_id", F.lit(1).alias("p")).orderBy(*by).limit(max_positive)
    ids = docs.filter(~shared.held_out(F.col("doc_id"))).select("doc_id").distinct()
    rest = ids.join(known.filter("toxic = 1"), "doc_id", "left_anti").select("doc_id", F.lit(0).alias("p")).orderBy(*by).limit(max_unlabelled)
    rows = docs.select("doc_id", "text").join(F.broadcast(toxic.unionByName(rest)), "doc_id")  # bounded by the two limits
    got = rows.select("p", "text").mapInPandas(_encode, "p int, x binary").toPandas()
    got = got.sort_values(["p", "x"])  # the order of arrival must not matter
    of = lambda k: [np.frombuffer(x, dtype=np.uint32) for x in got["x"][got["p"] == k]]
    prior = min(max(counted["k"] / counted["n"], 1e-4), 0.9)
    return fit_nnpu(of(1), of(0), prior, max_words)


def score(docs: DataFrame, detector: Detector | None) -> DataFrame:
    """``docs`` with columns score and predicted appended, in the place of any so called; other columns stay, whatever their names."""
    names = [c for c in docs.columns if c not in ("score", "predicted")]
    # numbered, as names with dots can't be handed to Python
    kept = docs.select(*[F.col(f"`{c}`") for c in names]).toDF(*[f"c{i}" for i in range(len(names))])
    body = f"c{names.index('text')}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, float] = {}
        for b in batches:
            s = np.array([0.0 if detector is None else detector.score(t, seen) for t in b[body]], dtype=float)
            yield b.assign(score=s, predicted=(s >= 0.5).astype(np.int32))

    schema = StructType([*kept.schema.fields, StructField("score", DoubleType()), StructField("predicted", IntegerType())])
    return kept.mapInPandas(shared.tidied(run), schema).toDF(*names, "score", "predicted")
