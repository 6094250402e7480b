"""A day's recordings cut into items: proposed boundaries, titles that were really spoken, and the published items that they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words that name no subject.
GENERIC = (
    "item items meeting board county commission commissioner commissioners public hearing hearings discussion approval approve request regular agenda report reports update updates "
    "presentation order consent motion vote session comment comments staff general business other pasco continued continuance morning afternoon matters"
).split()
CODE = r"(\b[A-Z]{1,3}\s?-?\s?\d{1,3}\b)"


def said(text: Column) -> Column:
    """What titles are looked up in: lower case, with blanks for all but letters, digits and apostrophes."""
    return F.regexp_replace(F.lower(text), r"[^a-z0-9' ]+", " ")


def grounded(title: Column, hay: Column) -> Column:
    """Struct of search_title and coverage: a title without the subject words that weren't ``said``, and the share that was.

    Subject words aren't generic and have four letters, two digits or two capitals.  A plural is said with its singular and the other way
    round.  With fewer than two words left there is no title.
    """
    pieces = F.regexp_extract_all(F.coalesce(title, F.lit("")), F.lit(r"([A-Za-z0-9']+|[^A-Za-z0-9']+)"), F.lit(1))

    def subject(p: Column) -> Column:
        shape = (F.length(p) >= 4) | (p.rlike(r"^\d+$") & (F.length(p) >= 2)) | (p.rlike(r"^[^a-z]*[A-Z][^a-z]*$") & (F.length(p) >= 2))
        return p.rlike(r"^[A-Za-z0-9']+$") & ~F.lower(p).isin(GENERIC) & shape

    def spoken(p: Column) -> Column:
        w = F.lower(p)
        return F.contains(hay, w) | (F.endswith(w, F.lit("s")) & F.contains(hay, F.substring(w, F.lit(1), F.length(w) - 1)))

    total = F.size(F.filter(pieces, subject))
    kept = F.size(F.filter(pieces, lambda p: subject(p) & spoken(p)))
    out = F.array_join(F.transform(pieces, lambda p: F.when(subject(p) & ~spoken(p), "").otherwise(p)), "")
    out = F.regexp_replace(F.trim(F.regexp_replace(out, r"\s+", " ")), r"^[ ,/:;-]+|[ ,/:;-]+$", "")
    return F.struct(F.when(kept >= 2, out).alias("search_title"), F.when(total > 0, kept / total).otherwise(0.0).alias("coverage"))


def assembled(lines: DataFrame, marks: DataFrame, codes: DataFrame) -> DataFrame:
    """day, line, rec, part, seq, start_idx, end_idx, phase, title, code, search_title, coverage: contiguous spans of a day, one row for each recording of a span.

    ``lines`` (day, line, rec, idx, text) with line from 0, ``marks`` (day, line, no, phase, title, code), ``codes`` (day, code).  The first
    proposal for a line counts; a day begins at line 0 with what its first mark says, or as "other".  Titles are
    grounded in the whole span, and a code that the day's list doesn't have is none.
    """
    n = lines.groupBy("day").agg(F.count("*").alias("n"))
    best = marks.groupBy("day", "line").agg(F.min_by(F.struct("phase", "title", "code"), "no").alias("m"))
    first = best.groupBy("day").agg(F.min("line").alias("at"), F.min_by("m", "line").alias("m"))
    other = F.struct(F.lit("other").alias("phase"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("code"))
    heads = n.join(first, "day", "left").filter("at is null or at > 0").select("day", F.lit(0).cast("long").alias("line"), F.coalesce("m", other).alias("m"))
    starts = best.select("day", F.col("line").cast("long").alias("line"), "m").unionByName(heads).join(n, "day").filter("line < n")
    following = F.lead("line").over(Window.partitionBy("day").orderBy("line"))
    spans = starts.select("day", "line", "m", (F.coalesce(following, "n") - 1).alias("to"))
    own = lines.select("day", F.col("line").alias("at"), "rec", "idx", "text")
    # a day's lines and spans are ordered alike: each line is in the span that began last
    both = own.join(spans.select("day", F.col("line").alias("at"), F.col("line").alias("begins")), ["day", "at"], "left")
    held = both.withColumn("line", F.max("begins").over(Window.partitionBy("day").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("at", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"])
    texts = held.groupBy("day", "line").agg(said(F.array_join(ordered, " ")).alias("hay"))  # an item's words
    chunks = held.groupBy("day", "line", "rec").agg(F.min("at").alias("at"), F.min("idx").alias("start_idx"), F.max("idx").alias("end_idx"))
    chunks = chunks.withColumn("part", F.row_number().over(Window.partitionBy("day", "line").orderBy("at")) - 1).withColumn("seq", F.row_number().over(Window.partitionBy("day", "rec").orderBy("at")) - 1)
    valid = codes.select("day", "code", F.lit(True).alias("valid")).distinct()
    told = spans.select("day", "line", "m.phase", "m.title", F.trim("m.code").alias("code")).join(valid, ["day", "code"], "left").withColumn("code", F.when(F.col("valid"), F.col("code"))).drop("valid")
    told = told.join(texts, ["day", "line"]).select("day", "line", "phase", "title", "code", grounded(F.col("title"), F.col("hay")).alias("g")).select("*", "g.*").drop("g")
    return chunks.join(told, ["day", "line"]).select("day", "line", "rec", "part", "seq", "start_idx", "end_idx", "phase", "title", "code", "search_title", "coverage")


def code_in(rows: DataFrame, codes: DataFrame, key: list[str]) -> DataFrame:
    """key, code: the first code in a title (day, title) that the day's list (day, code) has."""
    found = F.regexp_extract_all(F.coalesce("title", F.lit("")), F.lit(CODE), F.lit(1))
    whole = F.transform(found, lambda c: F.concat(F.regexp_extract(c, "([A-Z]+)", 1), F.regexp_extract(c, r"(\d+)", 1).cast("int").cast("string")))
    each = rows.select(*key, "day", F.posexplode(whole).alias("at", "code")).join(codes.select("day", "code").distinct(), ["day", "code"])
    return each.groupBy(*key).agg(F.min_by("code", "at").alias("code"))


def bound(segments: DataFrame, published: DataFrame) -> DataFrame:
    """day, rec, seq, item_id, new_seq, kind: which item each segment of ``assembled`` is.

    ``published`` (day, item_id, seq, code).  A segment is the item of its code, or else of the first published code in its title; any other is
    an item of its own after the day's last, in the order of recordings.  ``kind`` is "bound", "phase" on a day without published codes, or "unmatched".
    """
    coded = published.filter("code is not null").groupBy("day", "code").agg(F.max_by("item_id", "seq").alias("item_id"))
    key = ["day", "rec", "seq"]
    titled = code_in(segments, coded, ["rec", "seq"])
    rows = segments.select(*key, "code").join(titled.select("rec", "seq", F.col("code").alias("read")), ["rec", "seq"], "left")
    own = coded.select("day", "code", F.col("item_id").alias("own"))
    rows = rows.join(own, ["day", "code"], "left").join(coded.select("day", F.col("code").alias("read"), F.col("item_id").alias("other")), ["day", "read"], "left")
    lists = published.groupBy("day").agg(F.max("seq").alias("last"), F.count("code").alias("codes"))
    rows = rows.join(lists, "day", "left").withColumn("item_id", F.coalesce("own", "other"))
    nth = F.row_number().over(Window.partitionBy("day", F.col("item_id").isNull()).orderBy("rec", "seq"))
    free = F.col("item_id").isNull()
    kind = F.when(~free, "bound").when(F.coalesce("codes", F.lit(0)) == 0, "phase").otherwise("unmatched")
    return rows.select(*key, "item_id", F.when(free, F.coalesce("last", F.lit(-1)) + nth).alias("new_seq"), kind.alias("kind"))
