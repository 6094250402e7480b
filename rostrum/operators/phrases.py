"""Many phrases over many texts: an index by each phrase's rarest word, and a vocabulary on a tree of subjects.

A phrase occurs where its words follow each other, whatever stands between them but letters and digits, in any case.
Texts are compared with a phrase only if they hold its rarest word: candidates come from an equi-join of words,
and the words in order confirm them.  No phrase is tested against all texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rostrum.functions import text as T
from rostrum.operators import places
from rostrum.sources import staging

#: Rows of subjects of texts up to which they are sent to the items; a shuffle join stands beside it.
BROADCAST_ROWS = 100_000
#: Rounds of ``closure`` at most: levels of a tree double each round.
MAX_ROUNDS = 20


def normal(words: Column) -> Column:
    """Words in order, each with a space on both sides."""
    return F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))


def matches(texts: DataFrame, phrases: DataFrame) -> DataFrame:
    """pid, id: which phrases (pid, phrase) occur in which texts (id, text); a phrase without words occurs nowhere.

    The candidates of a phrase are as many as the texts with its rarest word, which has the fewest texts; of words with equally many it is
    the first one by its letters.
    """
    worded = phrases.select("pid", T.tokens(F.col("phrase")).alias("words")).filter(F.size("words") > 0)
    each = worded.select("pid", F.explode(F.array_distinct("words")).alias("word"))
    held = texts.select("id", T.tokens(F.col("text")).alias("words"))
    seen = held.select("id", F.explode(F.array_distinct("words")).alias("word")).join(each.select("word").distinct(), "word", "left_semi")
    seen, _ = staging.stage(seen, "phrase-words")  # read for the counts and for the candidates
    counts = each.join(seen.groupBy("word").agg(F.count("*").alias("n")), "word", "left")
    rarest = counts.groupBy("pid").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word")).alias("r")).filter("r.n > 0")
    able = rarest.select("pid", F.col("r.word").alias("word")).join(worded, "pid").select("word", "pid", normal(F.col("words")).alias("p"))
    candidates = seen.join(able, "word").select("id", "pid", "p")
    return held.select("id", normal(F.col("words")).alias("t")).join(candidates, "id").filter(F.contains("t", "p")).select("pid", "id")


def closure(tree: DataFrame) -> DataFrame:
    """slug, below: each subject of a tree (slug, parent) with itself and all that stands under it.

    Paths double each round; subjects in a circle stand under each other.  A parent that isn't in the tree is none.
    """
    own = tree.select("slug", F.col("slug").alias("below")).distinct()
    known = tree.select(F.col("slug").alias("parent")).distinct()
    steps = tree.filter("parent is not null").join(known, "parent", "left_semi").select(F.col("parent").alias("slug"), F.col("slug").alias("below"))
    pairs, path = staging.stage(own.unionByName(steps).distinct(), "subject-paths")
    n = pairs.count()
    for _ in range(MAX_ROUNDS):
        on = pairs.select(F.col("slug").alias("below"), F.col("below").alias("under"))
        after, after_path = staging.stage(pairs.join(on, "below").select("slug", F.col("under").alias("below")).distinct(), "subject-paths")
        staging.drop(tree.sparkSession, path)
        pairs, path, was, n = after, after_path, n, after.count()
        if n == was:
            return pairs
    raise RuntimeError(f"the tree hasn't settled in {MAX_ROUNDS} rounds")


def subjects_of(items: DataFrame, tree: DataFrame, terms: DataFrame) -> DataFrame:
    """slug, id: the items (id, text) of each subject of a tree (slug, parent) with phrases (slug, phrase, negative).

    An item is a subject's if a phrase of the subject or of one under it occurs, unless one of the subject's own
    negative phrases does; exclusions aren't handed up or down.  Where the parent has phrases of its own, one of
    these has to occur too.  Equal texts have equal subjects, so that each text is looked at once and meets its items at the end.
    """
    texts, _ = staging.stage(items.filter("text is not null").select("text").distinct(), "subject-texts")
    found, _ = staging.stage(_subjects_of_texts(texts.select(F.col("text").alias("id"), "text"), tree, terms).withColumnRenamed("id", "text"), "subjects-of-texts")
    n = found.count()
    small, each = n <= BROADCAST_ROWS, 1 + n // max(texts.count(), 1)
    rows = places.dealt(items.select("id", "text"), each * items.count(), "id")  # so that an item's subjects are told apart in its task
    return rows.join(F.broadcast(found) if small else found, "text").select("slug", "id").distinct()


def _subjects_of_texts(items: DataFrame, tree: DataFrame, terms: DataFrame) -> DataFrame:
    """slug, id: as ``subjects_of``, each item by itself."""
    phrases = terms.select("phrase").distinct().withColumn("pid", F.col("phrase"))
    hits, _ = staging.stage(matches(items, phrases).withColumnRenamed("pid", "phrase"), "subject-hits")
    own = terms.join(hits, "phrase").select("slug", "negative", "id").distinct()
    positive, negative = own.filter("not negative").select("slug", "id"), own.filter("negative").select("slug", "id")
    under = closure(tree).withColumnRenamed("slug", "top").withColumnRenamed("below", "slug")
    found = positive.join(under, "slug").select(F.col("top").alias("slug"), "id").distinct()
    found = found.join(negative, ["slug", "id"], "left_anti")
    strict = terms.filter("not negative").select(F.col("slug").alias("parent")).distinct().withColumn("strict", F.lit(True))
    bound = found.join(tree.select("slug", "parent").distinct(), "slug").join(strict, "parent", "left")
    met = positive.select(F.col("slug").alias("parent"), "id", F.lit(True).alias("met"))
    return bound.join(met, ["parent", "id"], "left").filter("strict is null or met").select("slug", "id").distinct()


def grounded(phrases: DataFrame, items: DataFrame, lines: DataFrame) -> DataFrame:
    """pid, n_items, n_lines, sample: in how many items and lines (id, text) a phrase (pid, phrase) occurs, and the id of the shortest item."""
    hit = matches(items, phrases).join(items.select("id", F.length("text").alias("size")), "id")
    of_items = hit.groupBy("pid").agg(F.count("*").alias("n_items"), F.min_by("id", F.struct("size", "id")).alias("sample"))
    of_lines = matches(lines, phrases).groupBy("pid").agg(F.count("*").alias("n_lines"))
    out = phrases.select("pid").join(of_items, "pid", "left").join(of_lines, "pid", "left")
    return out.select("pid", F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("n_lines", F.lit(0)).alias("n_lines"), "sample")


def triaged(counts: DataFrame, total: DataFrame, least: int = 50, share: int = 20) -> DataFrame:
    """``counts`` (pid, negative, n_items, n_lines) with keep: what occurs, unless a positive phrase occurs in over max(``least``, total / ``share``) items; ``total`` has one row (total)."""
    most = F.greatest(F.lit(least), F.floor(F.col("total") / share))
    keep = (F.col("n_items") + F.col("n_lines") > 0) & (F.col("negative") | (F.col("n_items") <= most))
    return counts.crossJoin(F.broadcast(total)).withColumn("keep", keep).drop("total")


def unmatched(texts: DataFrame, phrases: DataFrame, sample: int) -> DataFrame:
    """id: ``sample`` texts in which no phrase occurs, by the hash of their ids."""
    rest = texts.select("id").join(matches(texts, phrases).select("id").distinct(), "id", "left_anti")
    return rest.orderBy(F.md5(F.col("id").cast("string").cast("binary")), "id").limit(sample)
