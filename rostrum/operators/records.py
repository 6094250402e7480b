"""Published records to rows: agenda lines, bulk motions, item disambiguation, one-to-one assignment."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What the lines of an agenda look like.
SECTION = r"(?i)^(consent|regular|public hearings?|board reports?|call to order|adjourn\w*)\s*:?\s*$"
ITEM = r"^([A-Z]{1,3})\s?-?\s?(\d{1,3})\s+(\S.*)$"
FIELD = r"(?i)^(recommendation|department|contact|fiscal impact|comm\.? dist\.?)\s*:\s*(.*)$"
NOISE = r"(?i)^(page \d+( of \d+)?|agenda|\d+)\s*$"


def agenda_items(files: DataFrame, id_: str, text: str) -> DataFrame:
    """id, no, code, section, title, recommendation: the items of each agenda in order.

    Lines are rows; a running count of item lines says which item a line belongs to, and the
    last section line before an item is its section.  Lines that are no field, section or
    page furniture go on with the title.
    """
    lines = files.select(id_, F.posexplode(F.split(text, "\n")).alias("pos", "raw"))
    lines = lines.withColumn("line", F.trim(F.regexp_replace("raw", r"\s{2,}", " "))).filter((F.col("line") != "") & ~F.col("line").rlike(NOISE))
    w = Window.partitionBy(id_).orderBy("pos")
    is_item, is_section, is_field = (F.col("line").rlike(p) for p in (ITEM, SECTION, FIELD))
    section = F.last(F.when(is_section, F.lower(F.regexp_extract("line", SECTION, 1))), ignorenulls=True).over(w)
    rows = lines.withColumn("no", F.sum(F.when(is_item, 1).otherwise(0)).over(w)).withColumn("section", section)
    # a section line ends the item before it
    rows = rows.withColumn("closed", F.max(F.when(is_section, 1).otherwise(0)).over(Window.partitionBy(id_, "no").orderBy("pos"))).filter("no > 0 and closed = 0")
    kind = F.when(is_item, "item").when(is_field, "field").otherwise("more")
    title = F.when(kind == "item", F.regexp_extract("line", ITEM, 3)).when(kind == "more", F.col("line"))
    first = lambda c: F.max(F.when(kind == "item", c))
    parts = F.array_sort(F.collect_list(F.when(title.isNotNull(), F.struct("pos", title.alias("t")))))
    said = F.max(F.when(F.lower(F.regexp_extract("line", FIELD, 1)) == "recommendation", F.regexp_extract("line", FIELD, 2)))
    code = F.concat(F.regexp_extract("line", ITEM, 1), F.regexp_extract("line", ITEM, 2))
    g = rows.groupBy(id_, "no").agg(first(code).alias("code"), first(F.col("section")).alias("section"), parts.alias("p"), said.alias("recommendation"))
    return g.select(id_, "no", "code", "section", F.array_join(F.transform("p", lambda x: x["t"]), " ").alias("title"), "recommendation")


def leading_words(a: Column, b: Column) -> Column:
    """How many words two titles begin with alike."""
    words = lambda c: F.split(F.lower(F.trim(c)), r"\s+")
    same = F.zip_with(words(a), words(b), lambda x, y: F.coalesce(x == y, F.lit(False)))
    return F.aggregate(same, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, x: F.struct((s["n"] + (s["on"] & x).cast("int")).alias("n"), (s["on"] & x).alias("on")), lambda s: s["n"])


def disambiguate(mentions: DataFrame, items: DataFrame, key: list[str]) -> DataFrame:
    """mention_id, item_id, how: of items with one code, at least two leading title words and a strict lead; else the only one of the section; else the lowest number, marked ambiguous.

    ``mentions``: key, mention_id, title, section.  ``items``: key, item_id, seq, item_title, item_section.
    """
    j = mentions.join(items, key).withColumn("lead", leading_words(F.col("title"), F.col("item_title"))).withColumn("same", F.col("section").eqNullSafe(F.col("item_section")))
    w = Window.partitionBy("mention_id")
    j = j.withColumn("second", F.coalesce(F.lead("lead").over(w.orderBy(F.desc("lead"), "seq")), F.lit(-1))).withColumn("rank", F.row_number().over(w.orderBy(F.desc("lead"), "seq")))
    j = j.withColumn("sections", F.sum(F.col("same").cast("int")).over(w)).withColumn("n", F.count("*").over(w))
    by_title = F.max(F.when((F.col("rank") == 1) & (F.col("lead") >= 2) & (F.col("lead") > F.col("second")), F.col("item_id")))
    by_section = F.max(F.when(F.col("same") & (F.col("sections") == 1), F.col("item_id")))
    lowest = F.min_by("item_id", "seq")
    g = j.groupBy("mention_id").agg(by_title.alias("t"), by_section.alias("s"), lowest.alias("l"), F.max("n").alias("n"))
    how = F.when(F.col("n") == 1, "only").when(F.col("t").isNotNull(), "title").when(F.col("s").isNotNull(), "section").otherwise("ambiguous")
    return g.select("mention_id", F.when(F.col("n") == 1, F.col("l")).otherwise(F.coalesce("t", "s", "l")).alias("item_id"), how.alias("how"))


def best_assignment(votes: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of a one-to-one assignment with the most votes, positive ones only.

    Successive shortest paths on potentials (the published Hungarian method), for the few seats of a meeting.
    """
    n = max(votes.shape)
    cost = np.zeros((n + 1, n + 1))
    cost[1 : votes.shape[0] + 1, 1 : votes.shape[1] + 1] = -votes
    u, v, match = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1, int)
    for i in range(1, n + 1):
        match[0], at = i, 0
        least, way, used = np.full(n + 1, np.inf), np.zeros(n + 1, int), np.zeros(n + 1, bool)
        while match[at]:
            used[at] = True
            row = match[at]
            free = np.flatnonzero(~used[1:]) + 1
            slack = cost[row, free] - u[row] - v[free]
            better = slack < least[free]
            least[free[better]], way[free[better]] = slack[better], at
            to = free[np.argmin(least[free])]
            step = least[to]
            u[match[used]] += step
            v[used] -= step
            least[~used] -= step
            at = to
        while at:
            match[at] = match[way[at]]
            at = way[at]
    out = [(match[j] - 1, j - 1) for j in range(1, n + 1)]
    return sorted((int(i), int(j)) for i, j in out if i < votes.shape[0] and j < votes.shape[1] and votes[i, j] > 0)


def assign(votes: DataFrame, key: str, voice: str, name: str, n: str) -> DataFrame:
    """key, voice, name: one name for a voice and one voice for a name, per meeting (a group of a few rows)."""

    def run(df: pd.DataFrame) -> pd.DataFrame:
        table = df.pivot_table(index=voice, columns=name, values=n, aggfunc="sum", fill_value=0).sort_index().sort_index(axis=1)
        pairs = best_assignment(table.to_numpy(float))
        return pd.DataFrame([(df[key].iloc[0], table.index[i], table.columns[j]) for i, j in pairs], columns=[key, voice, name])

    kinds = dict(votes.dtypes)
    return votes.groupBy(key).applyInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in (key, voice, name)))


def word_diff(a: list[str], b: list[str]) -> list[tuple[str, str]]:
    """('same' | 'gone' | 'new', word) by a longest common subsequence of words."""
    n = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            n[i, j] = n[i + 1, j + 1] + 1 if a[i] == b[j] else max(n[i + 1, j], n[i, j + 1])
    out, i, j = [], 0, 0
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and a[i] == b[j]:
            out.append(("same", a[i]))
            i, j = i + 1, j + 1
        elif j == len(b) or (i < len(a) and n[i + 1, j] >= n[i, j + 1]):
            out.append(("gone", a[i]))
            i += 1
        else:
            out.append(("new", b[j]))
            j += 1
    return out
