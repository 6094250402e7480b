"""Words that transcripts get wrong: by sound, and by a letter or two.

Words meet by equi-joins only: on a phonetic key, or on what is left of them when letters are dropped.  Counts are added up before
they move, so that a common word is one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Spellings of one sound, and consonants that trade places, with the letter that stands for them.
SPELLINGS = (("ph", "f"), ("ck", "c"), ("gh", ""))
SOUNDS = (("kqszxc", "c"), ("gj", "j"), ("vwf", "f"), ("yi", "i"), ("dt", "t"), ("bp", "p"), ("mn", "n"))
LETTERS = "".join(x for x, _ in SOUNDS)
STANDS_FOR = "".join(y * len(x) for x, y in SOUNDS)

#: Likeness of a mishearing to its word, and of a near miss; letters that lengths may differ in.
HEARD, NEAR = 0.6, 0.85
HEARD_LENGTH, NEAR_LENGTH = 4, 3


def sound(word: Column) -> Column:
    """The first letter and the consonants after it, by sound, without repetitions."""
    w = F.regexp_replace(F.lower(word), "[^a-z]", "")
    for was, now in SPELLINGS:
        w = F.replace(w, F.lit(was), F.lit(now))
    fold = lambda c: F.translate(c, LETTERS, STANDS_FOR)
    body = fold(F.regexp_replace(F.substring(w, 2, 2**31 - 1), "[aeiou]", ""))
    return F.concat(fold(F.substring(w, 1, 1)), F.regexp_replace(body, r"(.)\1+", "$1"))


def likeness(a: Column, b: Column) -> Column:
    """One less the letters to change, in proportion to the longer word."""
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))


def never_right(written: DataFrame, spoken: DataFrame, ordinary: DataFrame, least: int = 3, floor: int = 2) -> DataFrame:
    """term, n_written, heard, variants: words of the record that are never spoken as they are written, and what is said instead.

    ``written`` and ``spoken`` (word, n) in lower case, ``ordinary`` (word).  A variant sounds like the term, is no ordinary word nor one that
    the record has, and isn't said far more often than the term is written.  ``variants`` has the five commonest.
    """
    terms = written.join(ordinary, "word", "left_anti").filter(F.col("n") >= least).join(spoken.select("word"), "word", "left_anti")
    strange = spoken.join(ordinary, "word", "left_anti").join(written.select("word"), "word", "left_anti")
    a = terms.select(F.col("word").alias("term"), F.col("n").alias("n_written"), sound(F.col("word")).alias("key"))
    b = strange.select(F.col("word").alias("said"), F.col("n").alias("c"), sound(F.col("word")).alias("key"))
    near = a.join(b, "key").filter(F.abs(F.length("term") - F.length("said")) <= HEARD_LENGTH).filter(likeness(F.col("term"), F.col("said")) >= HEARD)
    near = near.filter(~((F.col("c") > 20) & (F.col("c") > 10 * F.col("n_written"))))
    rank = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("c"), "said"))
    top = F.when(F.col("rank") <= 5, F.struct("rank", F.concat_ws(":", "said", F.col("c").cast("string")).alias("v")))
    found = near.withColumn("rank", rank).groupBy("term", "n_written").agg(F.sum("c").alias("heard"), F.array_sort(F.collect_list(top)).alias("v"))
    return found.filter(F.col("heard") >= floor).select("term", "n_written", "heard", F.array_join(F.transform("v", lambda x: x["v"]), ", ").alias("variants"))


def _shortened(word: Column, least: float) -> Column:
    """A word, and what is left of it without as many letters as a word so much like it may differ in."""
    most = F.floor((1 - least) * (F.length(word) + NEAR_LENGTH))
    drop = lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))
    none = F.array().cast("array<string>")
    one = F.when(most >= 1, drop(word)).otherwise(none)
    two = F.when(most >= 2, F.flatten(F.transform(one, drop))).otherwise(none)
    three = F.when(most >= 3, F.flatten(F.transform(two, drop))).otherwise(none)
    return F.array_distinct(F.concat(F.array(word), one, two, three))


def near_misses(spoken: DataFrame, targets: DataFrame, floor: int = 1, least: float = NEAR) -> DataFrame:
    """word, n, target, score: words that are said ``floor`` times or more (word, n) and probably mean a target (word), the likeliest.

    A word and its target begin alike.  Two words that differ in k letters have something in common when k letters are dropped from each, so that
    pairs come from an equi-join; words of up to 17 letters are compared in full, longer ones in three letters at most.
    """
    said = spoken.filter(F.col("n") >= floor).join(targets, "word", "left_anti")
    a = said.select("word", "n", F.explode(_shortened(F.col("word"), least)).alias("left"))
    b = targets.select(F.col("word").alias("target"), F.explode(_shortened(F.col("word"), least)).alias("left"))
    same = F.substring("word", 1, 1) == F.substring("target", 1, 1)
    pairs = a.join(b, "left").filter(same).select("word", "n", "target").distinct()
    scored = pairs.withColumn("score", likeness(F.col("word"), F.col("target"))).filter((F.col("score") >= least) & (F.abs(F.length("word") - F.length("target")) <= NEAR_LENGTH))
    w = Window.partitionBy("word").orderBy(F.desc("score"), "target")
    return scored.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
