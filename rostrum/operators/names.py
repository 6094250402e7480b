"""Names that people say: of themselves, at the podium, and in the queue that is read out; and the claims that follow.

All of it is column expressions on a line's text, and windows over a recording's lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What a name looks like, and the words that stand around names.
WORD = r"[A-Z][a-z']+(?:[A-Z][a-z']+)*"
NAME = rf"{WORD}(?:\s+(?:(?:St|Jr|Sr|Dr|Mt)\.|{WORD})){{0,2}}"
QUEUE_NAME = rf"{WORD}(?:\s+{WORD}){{0,2}}"
FILLER = r"(?:(?i:uh|um|er|okay|well|so|hi|hello|yeah|yes|and|thank you)[,.]?\s+)*"
SAYS = rf"(?i:\bmy name is)\s+{FILLER}({NAME})"
PODIUM = rf"^{FILLER}(?:(?i:good (?:morning|afternoon|evening)),?\s+)?{FILLER}({NAME}),\s+(?:\d{{2,6}}\s|\[address removed\])"
SWORN = r"(?i)\b(?:i have been sworn|been duly sworn|i was sworn)\b"
QUEUE_CUE = r"(?i)\bfollowed by\b|\band then\b|\bsigned up\b|\bon (?:the|my) list\b|\bnext (?:person|individual|speaker|up|is|we have)\b|\bfirst (?:person|individual|speaker|three|two)\b"
QUEUE_BARE = r"(?i)^\W*(?:and|then|okay|alright|next|now|uh|um)?[\s,]*[A-Z][a-z']+(?:[A-Z][a-z']+)*(?:\s+[A-Z][a-z']+(?:[A-Z][a-z']+)*){1,2}[\s.?!]*$"
QUEUE_SPLIT = r"(?i)\bfollowed by\b|\band then\b"
PROMPTED = r"(?i)(?:say|state|give|need|with|proceed with)\s+(?:us\s+)?(?:your|the)\s+name|name\s+and\s+address|your\s+name\s+and"
READING = r"(?i)\b(?:email|e-mail|letter|correspondence|comment card)\b[^.]{0,40}\b(?:is )?from\b|\bread (?:it |this )?into the record\b|\bi am writing\b|\bwrites\b"
READING_RUN = r"(?i)(email|letter) is from|next (email|letter)|read (it|this) into the record|i am writing|to whom it may"
TITLES = "clerk chairman chairwoman chair attorney administrator president sheriff mayor county".split()
NO_FIRST = "an a the this that next our your my is was item agenda and to of for mr mrs ms dr".split()
NO_LAST = "and with from for at in on of the a to is was my i we it that said who im live here speaking".split()
FILLERS = "um uh er ah oh so well yes yeah okay ok alright actually right now then next also thank thanks please sorry first and".split()

#: Lines on both sides of a claim in which its voice has to be heard, and how often.
NEAR, COHERENT = 6, 4


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def said_name(text: Column) -> Column:
    """The name that a (squeezed) line says of its speaker: "my name is", or at the podium a name, an address and the oath; null if none.

    It has three words at most and four letters at least.
    """
    own = F.regexp_extract(text, SAYS, 1)
    name = F.when(own != "", own).when(text.rlike(SWORN), F.regexp_extract(text, PODIUM, 1))
    return F.when((F.length(name) >= 4) & (F.size(F.split(name, r"\s+")) <= 3), name)


def before_name(text: Column) -> Column:
    """What a line says before "my name is"; nothing where it doesn't say so."""
    return F.when(text.rlike(SAYS), F.regexp_extract(text, rf"^(.*?){SAYS}", 1)).otherwise("")


def trimmed(name: Column) -> Column:
    """A name without fillers before it and connecting words after it."""
    among = lambda words: lambda t: ~F.lower(t).isin(words)
    tokens = F.split(name, r"\s+")
    first = F.array_position(F.transform(tokens, among(FILLERS)), F.lit(True))
    rest = F.when(first > 0, F.slice(tokens, F.greatest(first, F.lit(1)).cast("int"), F.size(tokens))).otherwise(F.array().cast("array<string>"))
    last = F.array_position(F.transform(F.reverse(rest), among(NO_LAST)), F.lit(True))
    return F.when(last > 0, F.array_join(F.slice(rest, 1, F.greatest(F.size(rest) - last.cast("int") + 1, F.lit(0))), " ")).otherwise("")


def plausible(name: Column) -> Column:
    """Whether a trimmed name can be a person's."""
    tokens = F.split(name, " ")
    return (F.size(tokens) <= 3) & (F.length(name) >= 4) & ~F.lower(F.get(tokens, F.lit(0))).isin(NO_FIRST) & F.forall(tokens, lambda t: t.rlike(r"^\p{Lu}\p{L}+$"))


def queued(text: Column) -> Column:
    """The names that a (squeezed) line reads out, in the order in which they will speak; empty for a line that is no announcement.

    Before the first "followed by" the last full name counts, after each the first name.
    """

    def names(part: Column) -> Column:
        found = F.transform(F.regexp_extract_all(part, F.lit(QUEUE_NAME), F.lit(0)), trimmed)
        return F.filter(found, lambda n: (n != "") & ~F.lower(F.substring_index(n, " ", 1)).isin(TITLES) & plausible(n))

    parts = F.split(text, QUEUE_SPLIT)
    one = F.transform(parts, lambda p, i: F.when(i == 0, F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.filter(names(p), lambda n: F.contains(n, F.lit(" ")))), -1)).otherwise(F.get(names(p), F.lit(0))))
    return F.when(text.rlike(QUEUE_CUE) | text.rlike(QUEUE_BARE), F.array_compact(one)).otherwise(F.array().cast("array<string>"))


def self_claims(lines: DataFrame, held: DataFrame, letters: DataFrame) -> DataFrame:
    """rec, idx, label, name, method, lo, hi, corroborated: what becomes of each line that says its speaker's name.

    ``lines`` (rec, idx, label, text), ``held`` (rec, label, name) board members that voices are known as, ``letters`` (rec, lo, hi) that are read out.
    Methods are tried in this order, which is the decision: "read_aloud" where the line or its run reads somebody's words, over the
    letter or else the line alone; "prompted" where the name was asked for in the same line; "board_voice" where the voice is known as somebody else;
    "self" where the voice has ``COHERENT`` lines within ``NEAR``, and "self_weak". The last two cover the voice's run.  "prompted" and "board_voice" are
    no claims, but why there is none.
    """
    text = squeezed(F.col("text"))
    voice = Window.partitionBy("rec", "label").orderBy("idx")
    rows = lines.select("rec", "idx", "label", text.alias("text"))
    rows = rows.withColumn("run", F.col("idx") - F.row_number().over(voice)).withColumn("near", F.count("*").over(voice.rangeBetween(-NEAR, NEAR)))
    run = Window.partitionBy("rec", "label", "run")
    rows = rows.withColumn("run_lo", F.min("idx").over(run)).withColumn("run_hi", F.max("idx").over(run)).withColumn("reads", F.max(F.col("text").rlike(READING_RUN)).over(run))
    said = rows.withColumn("name", said_name(F.col("text"))).filter("name is not null")
    known = held.groupBy("rec", "label").agg(F.min(F.lower("name")).alias("known"))
    said = said.join(known, ["rec", "label"], "left")
    inside = letters.select(F.col("rec").alias("_r"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"))
    said = said.join(inside, (F.col("rec") == F.col("_r")) & F.col("idx").between(F.col("_lo"), F.col("_hi")), "left")
    said = said.groupBy(*[c for c in said.columns if c not in ("_r", "_lo", "_hi")]).agg(F.min(F.struct("_lo", "_hi")).alias("letter"))
    surname = F.lower(F.element_at(F.split("name", r"\s+"), -1))
    heard = rows.select(F.col("rec").alias("_r"), F.lower("text").alias("_t")).join(said.select("rec", surname.alias("s")).distinct(), (F.col("_r") == F.col("rec")) & F.contains("_t", "s")).groupBy("rec", "s").agg(F.count("*").alias("heard"))
    said = said.withColumn("s", surname).join(heard, ["rec", "s"], "left")
    aloud = F.col("text").rlike(READING) | F.col("reads")
    other = F.col("known").isNotNull() & ~F.contains(F.lower("name"), F.col("known"))
    method = F.when(aloud, "read_aloud").when(before_name(F.col("text")).rlike(PROMPTED), "prompted").when(other, "board_voice").when(F.col("near") >= COHERENT, "self").otherwise("self_weak")
    span = lambda letter, own: F.when(F.col("method") == "read_aloud", F.coalesce(F.col(f"letter.{letter}"), F.col("idx"))).otherwise(F.col(own))
    corroborated = F.col("method").isin("self", "self_weak") & (F.coalesce("heard", F.lit(0)) > 1)
    return said.withColumn("method", method).select("rec", "idx", "label", "name", "method", span("_lo", "run_lo").alias("lo"), span("_hi", "run_hi").alias("hi"), corroborated.alias("corroborated"))
