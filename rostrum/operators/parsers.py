"""Text to rows: keys, numbers, sentences, citations.  Python runs only where no built-in says it, in Arrow batches."""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def thread_keys(rows: DataFrame, id_: str, text: str, patterns: dict[str, str]) -> DataFrame:
    """id, kind, key: the distinct matches of each kind's pattern."""

    def of(kind: str, pattern: str) -> Column:
        found = F.array_distinct(F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)))
        return F.transform(found, lambda key: F.struct(F.lit(kind).alias("kind"), key.alias("key")))

    kinds = [of(k, p) for k, p in patterns.items()]
    return rows.select(id_, F.explode(F.flatten(F.array(*kinds))).alias("k")).select(id_, "k.kind", "k.key")


def mapped(rows: DataFrame, source: str, target: str, table: dict[str, str], default: str) -> DataFrame:
    """A column translated by a small fixed table."""
    out = F.lit(default)
    for k, v in reversed(table.items()):
        out = F.when(F.col(source) == k, v).otherwise(out)
    return rows.withColumn(target, out)


def corrected(text: Column, pairs: list[tuple[str, str]]) -> Column:
    """Corrections applied one after another."""
    for was, now in pairs:
        text = F.replace(text, F.lit(was), F.lit(now))
    return text


def similarity(rows: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """Ratcliff-Obershelp ratio of two columns."""

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([difflib.SequenceMatcher(None, p, q).ratio() if p is not None and q is not None else None for p, q in zip(x, y, strict=True)])

    return rows.withColumn(out, ratio(a, b))


# Number words.
ONES = {w: i for i, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split())} | {"oh": 0}
TENS = {w: 10 * i for i, w in enumerate("twenty thirty forty fifty sixty seventy eighty ninety".split(), 2)}


def digits_of(said: str | None) -> str | None:
    """Runs of number words as digits: three or more single digits are a string of digits, others add up; 0 stays as said."""
    if said is None:
        return None
    out, run = [], []

    def close() -> None:
        if run:
            if len(run) >= 3 and all(ONES.get(w, 10) < 10 for w in run):
                out.append("".join(str(ONES[w]) for w in run))
            else:
                n = sum(ONES.get(w, TENS.get(w, 0)) for w in run)
                out.extend([str(n)] if n else run)
            run.clear()

    for w in said.split():
        if w.lower() in ONES or w.lower() in TENS:
            run.append(w.lower())
        else:
            close()
            out.append(w)
    close()
    return " ".join(out)


def spoken_numbers(rows: DataFrame, text: str, out: str) -> DataFrame:
    """Spoken numbers of a column as digits."""

    @F.pandas_udf("string")
    def parse(s: pd.Series) -> pd.Series:
        return s.map(digits_of, na_action="ignore")

    return rows.withColumn(out, parse(text))


# Scales and ordinal words.
SCALES = {"thousand": 1_000, "million": 1_000_000, "billion": 1_000_000_000}
ORDINALS = {w: i for i, w in enumerate("first second third fourth fifth sixth seventh eighth ninth tenth eleventh twelfth thirteenth fourteenth fifteenth sixteenth seventeenth eighteenth nineteenth".split(), 1)} | {
    f"{w[:-1]}ieth": n for w, n in TENS.items()
}


def _small(words: list[str], at: int) -> tuple[int | None, int]:
    """A number below 100 at a place, and the place after it."""
    w = words[at] if at < len(words) else ""
    if w in TENS:
        unit = ONES.get(words[at + 1], 0) if at + 1 < len(words) else 0
        return (TENS[w] + unit, at + 2) if 0 < unit < 10 else (TENS[w], at + 1)
    return (ONES[w], at + 1) if w in ONES else (None, at)


def _ordinal(n: int) -> str:
    return f"{n}{'th' if n % 100 in (11, 12, 13) else {1: 'st', 2: 'nd', 3: 'rd'}.get(n % 10, 'th')}"


def _number(words: list[str], at: int) -> tuple[str | None, int]:
    """The longest number at a place as digits, and the place after it."""
    total, group, start, peek = 0, 0, at, lambda i: words[i] if i < len(words) else ""
    least = float("inf")  # scales fall from left to right
    while True:
        small, after = _small(words, at)
        if small is None:
            small, after = (ORDINALS[peek(at)], at + 1) if peek(at) in ORDINALS else (None, at)
            if small is not None and group % 100 == 0:
                return _ordinal(total + group + small), after
            break
        if group % 100:
            break
        group, at = group + small, after
        if peek(at) in ORDINALS and ORDINALS[peek(at)] < 10 and small >= 20 and small % 10 == 0:
            return _ordinal(total + group + ORDINALS[peek(at)]), at + 1
        # two numbers of two digits, the first from 13 to 20: a year
        if not total and group == small and 13 <= small <= 20:
            pair, end = _small(words, at)
            if pair is not None and pair >= 10 and peek(end) not in SCALES and peek(end) != "hundred":
                return f"{small}{pair}", end
        if peek(at) == "hundred" and 0 < group < 100:
            group, at = group * 100, at + 1
            if peek(at) == "and" and (_small(words, at + 1)[0] is not None or peek(at + 1) in ORDINALS):
                at += 1
        if peek(at) in SCALES and SCALES[peek(at)] < least and group:
            least = SCALES[peek(at)]
            total, group, at = total + group * least, 0, at + 1
            if peek(at) == "and" and _small(words, at + 1)[0] is not None:
                at += 1
        elif group % 100:
            break
    if at == start:
        return None, at
    digits = []
    if peek(at) == "point":
        i = at + 1
        while ONES.get(peek(i), 10) < 10:
            digits.append(str(ONES[peek(i)]))
            i += 1
        at = i if digits else at
    return f"{total + group}{'.' if digits else ''}{''.join(digits)}", at


def read_numbers(said: str | None) -> str | None:
    """Number words as digits: scales, hundreds, ordinals, decimals after "point" and years said as two pairs; null stays null."""
    if said is None:
        return None
    own = said.split()
    words, out, at = [w.lower() for w in own], [], 0
    while at < len(words):
        number, after = _number(words, at)
        out.append(own[at] if number is None else number)
        at = at + 1 if number is None else after
    return " ".join(out)


def numbers_read(rows: DataFrame, text: str, out: str) -> DataFrame:
    """Spoken numbers of a column, scales, ordinals, decimals and years included, as digits."""

    @F.pandas_udf("string")
    def read(s: pd.Series) -> pd.Series:
        return s.map(read_numbers, na_action="ignore")

    return rows.withColumn(out, read(text))


_END = re.compile(r"(?<=[.!?])\s+(?=[A-ZÀ-Þ])")
# Abbreviations that end no sentence.
ABBREVIATIONS = frozenset("mr mrs ms dr st vs jr sr inc co dept gov".split())


def sentences_of(text: str) -> list[str]:
    """Sentences; a stop after an abbreviation or an initial ends none."""
    out: list[str] = []
    for piece in _END.split(text.replace("\n", " ")):
        last = out[-1].rsplit(None, 1)[-1].rstrip(".").lower() if out and out[-1].strip() else ""
        if out and out[-1].endswith(".") and (last in ABBREVIATIONS or len(last) == 1):
            out[-1] += " " + piece
        else:
            out.append(piece)
    return [s.strip() for s in out if s.strip()]


def sentences(rows: DataFrame, id_: str, text: str) -> DataFrame:
    """id, no, sentence."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [(i, n, s) for i, t in zip(b[id_], b[text], strict=True) if t for n, s in enumerate(sentences_of(t))]
            yield pd.DataFrame(found, columns=[id_, "no", "sentence"])

    return rows.select(id_, text).mapInPandas(run, f"{id_} long, no long, sentence string")


def checked_citations(rows: DataFrame, seen: DataFrame, key: list[str], scope: list[str], text: str, n: str) -> DataFrame:
    """key, cited, valid, struck: numbers in brackets, ranges as their ends, against the numbers seen in the scope."""
    groups = F.regexp_extract_all(text, F.lit(r"\[([0-9,\s-]+)\]"), F.lit(1))
    numbers = F.transform(F.flatten(F.transform(groups, lambda g: F.split(g, r"[,-]"))), lambda x: F.trim(x).cast("long"))
    each = rows.select(*key, F.explode(F.array_distinct(numbers)).alias(n))
    known = seen.select(*scope, n).distinct().withColumn("_seen", F.lit(1))
    held = each.join(known, [*scope, n], "left")
    return held.groupBy(*key).agg(F.count("*").alias("cited"), F.count("_seen").alias("valid"), F.count_if(F.col("_seen").isNull()).alias("struck"))
