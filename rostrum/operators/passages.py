"""Utterances, passages and windows: cuts whose next one depends on the last, as chains of successors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rostrum.operators import places
from rostrum.sources import staging

# The caps of a passage, in words, and of an utterance and a window, in seconds.
MAX_WORDS, FLOOR, TURN_WORDS, MIN_INDEXED = 140, 35, 12, 12
GAP, MOST_SECONDS = 2.0, 30.0
WINDOW, PAD, LEAST_WINDOW = 24.0, 0.25, 0.2
#: Words, and seconds, of a block in which a cut is looked up.
WORD_BLOCK, SECOND_BLOCK = 5_000, 3_600


def _words(text: str):
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != ""))


def build(utterances: DataFrame, key: str, idx: str, speaker: str, text: str, least: int = MIN_INDEXED, max_words: int = MAX_WORDS, floor: int = FLOOR, turn_words: int = TURN_WORDS) -> DataFrame:
    """key, start_idx, end_idx, speaker, text of passages with at least ``least`` words.

    A line of at least ``turn_words`` words opens a speaker's passage, which takes the lines of the same speaker until
    the cap is crossed; one that stays under the floor is an exchange.  Short lines gather in an exchange, whose text
    names the speaker wherever it changes.  A line's passage ends where its run of the speaker, or of short
    lines, does, or after the line that brings the words since its start to the cap.
    """
    g = [key]
    rows = utterances.select(key, F.col(idx).cast("long").alias("idx"), F.coalesce(speaker, F.lit("Unidentified")).alias("who"), F.coalesce(text, F.lit("")).alias("body"), _words(text).alias("n"))
    rows = places.numbered(rows, g, ["idx"], "passage-lines").withColumn("short", F.col("n") < turn_words)
    rows = places.running(rows, g, F.col("n"), "upto", sums=True)
    # the first line after this one that can't be in a passage begun here: another speaker, or a line of the other kind
    ahead = places.neighbour(rows, g, {"who": "was", "short": "was_short"}, -1)
    breaks = lambda df, a, b, out: places.running(df, g, F.when(F.coalesce(F.col(a) != F.col(b), F.lit(True)), F.col("pos")).otherwise(F.lit(0)), out)
    runs = breaks(breaks(ahead, "who", "was", "who_run"), "short", "was_short", "kind_run").select(key, "part", "pos", "short", "n", "upto", "who_run", "kind_run")
    runs, runs_path = staging.stage(runs, "passage-runs")  # read for the ends of runs, the caps and the links
    last = lambda c: runs.groupBy(key, c).agg((F.max("pos") + 1).alias(f"{c}_end"))
    crossed = places.first_at_least(runs, g, "upto", F.col("upto") - F.col("n") + max_words, WORD_BLOCK)
    links = runs.join(last("who_run"), [key, "who_run"]).join(last("kind_run"), [key, "kind_run"]).join(crossed, [key, "pos"], "left")
    end = F.when(F.col("short"), F.col("kind_run_end")).otherwise(F.col("who_run_end"))
    found = F.when(F.col("found").isNotNull(), F.greatest("found", "pos") + 1)  # null: the cap isn't reached any more
    cuts = places.chain(links.select(key, "pos", F.least(end, F.coalesce(found, end)).alias("next")), g, rows.filter("pos = 0"))
    staging.drop(utterances.sparkSession, runs_path)
    opened = rows.join(cuts.withColumn("cut", F.lit(True)), [key, "pos"], "left")
    opened = places.running(opened, g, F.when(F.col("cut"), F.col("pos")), "start")
    line = F.struct("pos", "idx", "who", "body", "n", "short")
    whole = opened.groupBy(key, "start").agg(F.array_sort(F.collect_list(line)).alias("l"))  # a passage's lines: bounded by its cap
    first = F.col("l")[0]
    words = F.aggregate("l", F.lit(0), lambda s, x: s + x["n"])
    exchange = first["short"] | (words < floor)
    named = F.transform("l", lambda x, i: F.when((i > 0) & (F.get(F.col("l"), i - 1)["who"] == x["who"]), x["body"]).otherwise(F.concat(x["who"], F.lit(": "), x["body"])))
    joined = F.array_join(F.when(exchange, named).otherwise(F.transform("l", lambda x: x["body"])), " ")
    out = whole.select(key, first["idx"].alias("start_idx"), F.element_at("l", -1)["idx"].alias("end_idx"), F.when(exchange, "(exchange)").otherwise(first["who"]).alias("speaker"), joined.alias("text"))
    return out.filter(_words("text") >= least)


def group_utterances(rows: DataFrame, key: str, start: str, end: str, speaker: str, gap: float = GAP, most: float = MOST_SECONDS) -> DataFrame:
    """``rows`` with group_no, from 0 in each key: a group ends at another speaker, at a gap, and after a row that brings its duration to ``most``.

    Rows are in the order of start, end and speaker; in a run without such a gap an end counts as no earlier than those before it.
    """
    g = [key]
    placed = places.numbered(rows, g, [start, end, speaker], "utterance-rows")
    seen = places.neighbour(placed, g, {speaker: "_who", end: "_end"}, -1)
    fresh = F.col("_end").isNull() | ~F.col("_who").eqNullSafe(F.col(speaker)) | (F.col(start) - F.col("_end") >= gap)
    runs = places.running(seen, g, F.when(fresh, F.col("pos")), "_run")
    runs = places.running(runs, g, F.struct("_run", F.col(end).alias("e")), "_far").withColumn("_far", F.col("_far.e"))
    runs, _ = staging.stage(runs, "utterance-runs")  # read for the ends of runs, the caps and the result
    in_run = [key, "_run"]
    ends = runs.groupBy(*in_run).agg(F.max("pos").alias("_last"))
    crossed = places.first_at_least(runs, in_run, "_far", F.col(start) + most, SECOND_BLOCK)
    links = runs.select(*in_run, "pos").join(crossed, [*in_run, "pos"]).join(ends, in_run)
    following = F.when(F.col("found").isNotNull(), F.greatest("found", "pos") + 1)
    links = links.select(key, "pos", F.when(following <= F.col("_last"), following).alias("next"))
    cuts = places.chain(links, g, runs.filter("pos = _run"))
    flagged = runs.join(cuts.withColumn("_cut", F.lit(1)), [key, "pos"], "left")
    return places.running(flagged, g, F.coalesce("_cut", F.lit(0)), "group_no", sums=True).select(*rows.columns, (F.col("group_no") - 1).alias("group_no"))


def windows(speech: DataFrame, silences: DataFrame, key: str, most: float = WINDOW, pad: float = PAD, least: float = LEAST_WINDOW) -> DataFrame:
    """key, start, end: stretches of speech (key, start, end, duration) in windows of ``most`` seconds at most.

    A stretch is padded, within the recording; while it is too long it is cut at the middle one of the silences (key, at) between half of
    ``most`` and all of it, or else there.  What is left counts from ``least`` seconds on.  A stretch is a row with its own silences,
    so that a recording is dealt by its stretches.
    """
    padded = speech.select(key, F.greatest(F.col("start") - pad, F.lit(0.0)).alias("a"), F.least(F.col("end") + pad, F.col("duration")).alias("b"))
    long, short = padded.filter(F.col("b") - F.col("a") > most), padded.filter(F.col("b") - F.col("a") <= most)
    # silences meet the stretches of their recording that hold them, by blocks of time
    block = lambda c: F.floor(c / SECOND_BLOCK)
    spread = long.withColumn("block", F.explode(F.sequence(block(F.col("a")), block(F.col("b")))))
    held = spread.join(silences.select(key, F.col("at").cast("double").alias("at"), block(F.col("at")).alias("block")), [key, "block"], "left").filter("at is null or (at >= a and at <= b)")
    quiet = held.groupBy(key, "a", "b").agg(F.array_sort(F.collect_list("at")).alias("quiet"))
    whole = long.join(quiet, [key, "a", "b"], "left").withColumn("quiet", F.coalesce("quiet", F.array().cast("array<double>")))

    def step(s, _):
        low, high = s["a"] + most * 0.5, s["a"] + most
        near = F.filter("quiet", lambda x: (x >= low) & (x <= high))
        cut = F.when(F.size(near) > 0, F.get(near, F.floor(F.size(near) / 2).cast("int"))).otherwise(high)
        goes_on = F.col("b") - s["a"] > most
        return F.struct(F.when(goes_on, cut).otherwise(s["a"]).alias("a"), F.when(goes_on, F.concat(s["cuts"], F.array(cut))).otherwise(s["cuts"]).alias("cuts"))

    most_cuts = F.ceil((F.col("b") - F.col("a")) / (most / 2)).cast("int")
    start = F.struct(F.col("a").alias("a"), F.array(F.col("a")).alias("cuts"))
    cuts = whole.select(key, "b", F.aggregate(F.sequence(F.lit(1), most_cuts), start, step)["cuts"].alias("cuts"))
    each = cuts.select(key, "b", "cuts", F.posexplode("cuts").alias("i", "start")).withColumn("next", F.get("cuts", F.col("i") + 1))
    cut = each.filter((F.col("next").isNotNull()) | (F.col("b") - F.col("start") > least)).select(key, "start", F.coalesce("next", "b").alias("end"))
    return cut.unionByName(short.filter(F.col("b") - F.col("a") > least).select(key, F.col("a").alias("start"), F.col("b").alias("end")))
