"""Names of voices: whose evidence wins, whether a name can be heard at a meeting, and what a reader is shown.

A ``board`` is four tables: people (person_id, kind, surname, full_name), videos (video_id, meeting_id, body, upload_date), roster
(meeting_id, person_id) and terms (person_id, body, first_seen, last_seen).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rostrum.operators import intervals as I

# Days before a term's first sight and after its last one, and gavel lines of a chair at least.
BEFORE, AFTER, GAVELS = 120, 400, 3

Board = dict[str, DataFrame]


def _members(board: Board) -> DataFrame:
    return board["people"].filter("kind = 'board'").select("person_id", F.lower("surname").alias("_s"))


def _merged_days(rows: DataFrame, key: list[str]) -> DataFrame:
    """key, lo, hi: spans of days (lo, hi) of a key joined where they meet."""
    numbered = rows.filter("lo <= hi").groupBy(*key, F.unix_date("lo").alias("lo")).agg(F.max(F.unix_date("hi")).alias("hi"))
    return I.merged(numbered, key, "lo", "hi").select(*key, F.date_from_unix_date("lo").alias("lo"), F.date_from_unix_date("hi").alias("hi"))


def spans(board: Board) -> DataFrame:
    """body, _s, lo, hi: the days on which somebody of a surname can be heard on a board, by terms; spans of one board and surname lie apart.

    Terms that begin on one day are one before they meet, so that a surname has no more of them than there are days.
    """
    named = board["people"].select("person_id", F.lower("surname").alias("_s"))
    days = board["terms"].join(named, "person_id").select("body", "_s", F.date_sub("first_seen", BEFORE).alias("lo"), F.date_add("last_seen", AFTER).alias("hi"))
    return _merged_days(days, ["body", "_s"])


def supported(rows: DataFrame, board: Board) -> DataFrame:
    """``rows`` (video_id, name) with supported: no board member has the name, or the meeting's roster does, or a term on its board spans the day.

    Each test is an equi-join on the distinct names of the recordings; a day meets the few spans of its board and surname, not the terms of all its people.
    """
    asked = rows.filter("name is not null").select("video_id", F.lower("name").alias("_s")).distinct()
    of_board = _members(board).select("_s").distinct().withColumn("_board", F.lit(True))
    named = board["people"].select("person_id", F.lower("surname").alias("_s"))
    seats = board["videos"].select("video_id", "meeting_id").join(board["roster"], "meeting_id").join(named, "person_id").select("video_id", "_s")
    dated = asked.join(board["videos"].select("video_id", "body", "upload_date"), "video_id")
    days = dated.select("body", "_s", "upload_date").distinct().join(spans(board), ["body", "_s"]).filter(F.col("upload_date").between(F.col("lo"), F.col("hi"))).select("body", "_s", "upload_date")
    terms = dated.join(days.distinct(), ["body", "_s", "upload_date"], "left_semi").select("video_id", "_s")
    held = asked.join(seats.unionByName(terms).distinct().withColumn("_seat", F.lit(True)), ["video_id", "_s"], "left").join(of_board, "_s", "left")
    told = held.select("video_id", "_s", (F.col("_board").isNull() | F.col("_seat").isNotNull()).alias("supported"))
    return rows.withColumn("_s", F.lower("name")).join(told, ["video_id", "_s"], "left").select(*rows.columns, "supported")


def merged(candidates: DataFrame, board: Board) -> DataFrame:
    """video_id, label, name, source: the name of each voice from its candidates (video_id, label, name, source, votes).

    People's labels come before anchors, commenters and clusters.  Other names than people's have to be supported, and a board member has one
    voice in a recording: that of the better source, then of more votes, then the first label.
    """
    place = F.array_position(F.array(*[F.lit(s) for s in ("human", "anchor", "commenter", "cluster")]), F.col("source"))
    able = supported(candidates, board).filter("source = 'human' or supported").withColumn("place", place)
    best = able.groupBy("video_id", "label").agg(F.min(F.struct("place", (-F.col("votes")).alias("minus"), "name", "source")).alias("b")).select("video_id", "label", "b.*")
    seated = best.withColumn("_s", F.lower("name")).join(_members(board).select("_s").distinct().withColumn("_board", F.lit(True)), "_s", "left")
    one = F.row_number().over(Window.partitionBy("video_id", F.when(F.col("_board"), F.col("_s")).otherwise(F.concat(F.lit("\0"), "label"))).orderBy("place", "minus", "label"))
    return seated.withColumn("_one", one).filter("_one = 1").select("video_id", "label", "name", "source")


def upserted(stored: DataFrame, decided: DataFrame, labelled: DataFrame) -> DataFrame:
    """Voices (video_id, label, cluster, name, source) after a stage's decisions (video_id, label, cluster, name).

    The stage overwrites names without a source, and those of voices that people have labelled (video_id, label), whose source goes too; any
    other name stays with its source.  The cluster is always new, and new voices have no source.
    """
    key = ["video_id", "label"]
    old = stored.select(*key, *[F.col(c).alias(f"_{c}") for c in ("cluster", "name", "source")], F.lit(True).alias("_old"))
    new = decided.select(*key, "cluster", "name", F.lit(True).alias("_new"))
    both = old.join(new, key, "full").join(labelled.select(*key).distinct().withColumn("_human", F.lit(True)), key, "left")
    mine = F.col("_new").isNotNull() & (F.col("_old").isNull() | F.col("_source").isNull() | F.col("_human").isNotNull())
    return both.select(
        *key,
        F.when(F.col("_new"), F.col("cluster")).otherwise(F.col("_cluster")).alias("cluster"),
        F.when(mine, F.col("name")).otherwise(F.col("_name")).alias("name"),
        F.when(~mine, F.col("_source")).alias("source"),
    )


def retracted(voices: DataFrame, lines: DataFrame, held_out: DataFrame, labelled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Voices (video_id, label, ...) without those held out (video_id, label), and lines (video_id, idx, label, cluster) without their clusters; labelled voices stay."""
    key = ["video_id", "label"]
    gone = held_out.select(*key).distinct().join(labelled.select(*key).distinct(), key, "left_anti")
    cleared = lines.join(gone.withColumn("_gone", F.lit(True)), key, "left")
    return voices.join(gone, key, "left_anti"), cleared.withColumn("cluster", F.when(F.col("_gone").isNull(), F.col("cluster"))).select(*lines.columns)


def voice_names(voices: DataFrame, board: Board) -> DataFrame:
    """video_id, cluster, name: the commonest name of each cluster, in the recordings in which it is supported; of equally common ones the first."""
    named = voices.filter("name is not null and cluster is not null").groupBy("cluster", "name").agg(F.count("*").alias("n"))
    pick = named.groupBy("cluster").agg(F.min(F.struct((-F.col("n")).alias("n"), "name")).alias("p")).select("cluster", "p.name")
    heard = voices.filter("cluster is not null").select("video_id", "cluster").distinct().join(pick, "cluster")
    return supported(heard, board).filter("supported").select("video_id", "cluster", "name")


def chairs(votes: DataFrame, gavels: DataFrame, seats: DataFrame) -> DataFrame:
    """video_id, label, name: the chair of a recording, who is never handed the floor.

    ``votes`` (video_id, label, name) are voices that have names, ``gavels`` (video_id, label, n) procedural lines by voice, ``seats`` (video_id, name)
    the roster.  If exactly one seat has no voice it is that of the unnamed voice with most procedural lines, ``GAVELS`` at least; of equals the last label.
    """
    free = seats.distinct().join(votes.select("video_id", "name"), ["video_id", "name"], "left_anti").groupBy("video_id").agg(F.count("*").alias("n"), F.min("name").alias("name")).filter("n = 1")
    best = gavels.join(votes.select("video_id", "label"), ["video_id", "label"], "left_anti").groupBy("video_id").agg(F.max(F.struct("n", "label")).alias("g")).filter(F.col("g.n") >= GAVELS)
    return free.select("video_id", "name").join(best, "video_id").select("video_id", "g.label", "name")


def reader_view(lines: DataFrame, resolved: DataFrame, pending: DataFrame, people: DataFrame) -> DataFrame:
    """video_id, idx, name, basis, human, contested, display_name for every line (video_id, idx).

    ``resolved`` (video_id, idx, name, person_id, method, contested) names some lines, ``pending`` (video_id, lo, hi) are corrections that wait, and
    contest the lines they cover.  The key is a board member's surname and the full name of anybody else; a name without a person is
    shown as the board member's who has it, if there is one.
    """
    key = ["video_id", "idx"]
    who = people.select("person_id", "kind", "surname", "full_name")
    shown = people.filter("kind = 'board' and full_name is not null").groupBy(F.lower("surname").alias("_s")).agg(F.min_by("full_name", "person_id").alias("_shown"))
    waits = lines.join(pending.select("video_id", "lo", "hi"), "video_id").filter(F.col("idx").between(F.col("lo"), F.col("hi"))).select(*key).distinct().withColumn("_waits", F.lit(True))
    both = lines.select(*key).join(resolved.withColumnRenamed("name", "said"), key, "left").join(who, "person_id", "left").join(waits, key, "left")
    both = both.withColumn("_s", F.lower("said")).join(shown, "_s", "left")
    name = F.when(F.col("kind") == "board", F.coalesce("surname", "said")).otherwise(F.coalesce("full_name", "said"))
    return both.select(
        *key,
        name.alias("name"),
        F.col("method").alias("basis"),
        F.coalesce(F.col("method").isin("override", "label"), F.lit(False)).alias("human"),
        (F.coalesce("contested", F.lit(False)) | F.col("_waits").isNotNull()).alias("contested"),
        F.coalesce("full_name", "_shown", "said").alias("display_name"),
    )


def out_of_term(voices: DataFrame, labelled: DataFrame, board: Board) -> DataFrame:
    """video_id, label, name: voices named as board members on a day in none of their terms, unless people labelled them.

    Of each surname, the members whose terms hold a day are counted: each day on which a member's terms begin or end adds or takes one.
    """
    members = _members(board).distinct()
    all_of = members.groupBy("_s").agg(F.count("*").alias("_all"))
    terms = members.join(board["terms"].select("person_id", F.date_sub("first_seen", BEFORE).alias("lo"), F.date_add("last_seen", AFTER).alias("hi")), "person_id")
    own = _merged_days(terms, ["_s", "person_id"])  # a member's spans lie apart
    turns = own.select("_s", F.col("lo").alias("day"), F.lit(1).alias("d")).unionByName(own.select("_s", F.date_add("hi", 1).alias("day"), F.lit(-1).alias("d")))
    dated = voices.withColumn("_s", F.lower("name")).join(board["videos"].filter("upload_date is not null").select("video_id", F.col("upload_date").alias("day")), "video_id").join(all_of, "_s")
    days = turns.unionByName(dated.select("_s", "day", F.lit(0).alias("d")).distinct()).groupBy("_s", "day").agg(F.sum("d").alias("d"))
    held = days.select("_s", "day", F.sum("d").over(Window.partitionBy("_s").orderBy("day")).alias("_held"))
    out = dated.join(held, ["_s", "day"]).filter("_held < _all")
    return out.join(labelled.select("video_id", "label"), ["video_id", "label"], "left_anti").select("video_id", "label", "name").distinct()


def off_body(voices: DataFrame, names: DataFrame, board: Board) -> DataFrame:
    """video_id, cluster, name of ``names`` (as of ``voice_names``) that belong to members without any term on the recording's board.

    Members of a surname are counted, in all and by board.
    """
    members = _members(board).distinct()
    all_of = members.groupBy("_s").agg(F.count("*").alias("_all"))
    sat = members.join(board["terms"].select("person_id", "body").distinct(), "person_id").groupBy("_s", "body").agg(F.count("*").alias("_sat"))
    shown = voices.select("video_id", "cluster").distinct().join(names, ["video_id", "cluster"]).withColumn("_s", F.lower("name")).join(all_of, "_s").join(board["videos"].select("video_id", "body"), "video_id")
    return shown.join(sat, ["_s", "body"], "left").filter(F.coalesce("_sat", F.lit(0)) < F.col("_all")).select("video_id", "cluster", "name").distinct()


def backfilled(lines: DataFrame, overrides: DataFrame, labels: DataFrame, identities: DataFrame, names: DataFrame, affinity: DataFrame, least: float = 0.70) -> DataFrame:
    """video_id, label, lo, hi, name, method: all that has been decided about who speaks, as claims on contiguous runs of lines.

    ``lines`` (video_id, idx, label, cluster).  Five producers: ``overrides`` (video_id, lo, hi, name) claim their span, without a label;
    ``labels`` (video_id, label, name) and ``identities`` (video_id, label, name, source) each run of their voice, the latter as "llm" or "chair" by
    their source or else as "voice"; and ``names`` (video_id, cluster, name) the runs of each voice in their cluster, as "cluster".  The last is vetoed where
    the voice resembles that person (``affinity``: video_id, label, name, similarity) less than ``least``, and where another voice of the recording is
    already known by the name.
    """
    key = ["video_id", "label"]
    order = F.row_number().over(Window.partitionBy(*key).orderBy("idx"))
    numbered = lines.filter("label is not null").select(*key, "idx").distinct().withColumn("run", F.col("idx") - order)
    runs = numbered.groupBy(*key, "run").agg(F.min("idx").alias("lo"), F.max("idx").alias("hi")).drop("run")
    source = F.when(F.col("source").isin("llm", "chair"), F.col("source")).otherwise("voice")
    known = identities.filter("name is not null")
    heard = lines.filter("label is not null").select(*key, "cluster").distinct().join(names, ["video_id", "cluster"]).select(*key, "name").distinct()
    unlike = affinity.filter(F.col("similarity") < least).select(*key, "name").distinct()
    taken = known.select("video_id", "name", F.col("label").alias("_other")).distinct()
    apart = (heard["video_id"] == taken["video_id"]) & (heard["name"] == taken["name"]) & (heard["label"] != taken["_other"])
    cluster = heard.join(taken, apart, "left_anti").join(unlike, [*key, "name"], "left_anti")
    by_voice = labels.select(*key, "name", F.lit("label").alias("method")).unionByName(known.select(*key, "name", source.alias("method"))).unionByName(cluster.select(*key, "name", F.lit("cluster").alias("method")))
    spans = by_voice.join(runs, key).select(*key, "lo", "hi", "name", "method")
    return overrides.select("video_id", F.lit(None).cast("string").alias("label"), "lo", "hi", "name", F.lit("override").alias("method")).unionByName(spans)
