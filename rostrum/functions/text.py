"""Text columns: analysis, identifiers, outcomes, dates, layout.  All of them run in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """The analyser that index and query share: runs of letters and digits, in lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def phrase_pattern(phrase: str) -> str:
    """A case-blind pattern for a phrase at word boundaries, any white space between its words."""
    return r"(?i)\b" + r"\s+".join(re.escape(w) for w in phrase.split()) + r"\b"


def is_identifier(text: Column) -> Column:
    """One to five letters, a separator, one to three digits, and perhaps a third group."""
    return F.trim(text).rlike(r"^[A-Za-z]{1,5}[ -][0-9]{1,3}([ -][0-9]{1,6})?$")


def code_key(text: Column) -> Column:
    """A code without hyphens and spaces, in upper case."""
    return F.upper(F.regexp_replace(text, r"[- ]", ""))


def case_id(text: Column) -> Column:
    """PREFIX-YY-SEQ of the first case number in a text, null if there is none."""
    found = lambda i: F.regexp_extract(text, r"(?i)\b([A-Z]{2,5})[- ]?(\d{2})[- ]?(\d{2,6})\b", i)
    return F.when(found(1) != "", F.concat_ws("-", F.upper(found(1)), found(2), found(3)))


def squeeze(text: Column) -> Column:
    """Runs of blanks to one, no blanks at line ends, at most one empty line."""
    text = F.regexp_replace(text, r"[ \t]+", " ")
    return F.regexp_replace(F.regexp_replace(text, r" +\n", "\n"), r"\n{3,}", "\n\n")


# What an outcome sentence says, in the order in which rules are tried.
OUTCOME_RULES = (
    ("withdrawn", r"(?i)withdr"),
    ("continued", r"(?i)continu|postpon|defer"),
    ("denied", r"(?i)denied|denial"),
    ("denied", r"(?i)motion failed"),
    ("tabled", r"(?i)^\s*tabled"),
    ("no_action", r"(?i)^\s*no action"),
    ("adopted", r"(?i)adopt"),
    ("approved", r"(?i)^\s*approv"),
    ("received", r"(?i)^\s*(received|heard|presented)"),
)


def outcome(text: Column) -> Column:
    """The first rule that holds; 'other' if none does; null for an empty or missing text."""
    out = F.when(text.isNull() | (F.trim(text) == ""), None)
    for name, pattern in OUTCOME_RULES:
        out = out.when(text.rlike(pattern), name)
    return out.otherwise("other")


# Month names.
MONTHS = "january february march april may june july august september october november december".split()


def title_date(title: Column) -> Column:
    """YYYY-MM-DD of a title: numeric month-day-year anywhere, else a month name with day and year; null if impossible."""
    num = lambda i: F.regexp_extract(title, r"(?:^|\D)(\d{1,2})[-/._](\d{1,2})[-/._](\d{4}|\d{2})(?:\D|$)", i)
    word = lambda i: F.regexp_extract(title, rf"(?i)\b({'|'.join(MONTHS)})\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}})", i)
    month_no = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(word(1)))
    m, d, y = F.try_to_number(num(1), F.lit("99")), num(2), num(3)
    year = F.when(F.length(y) == 2, F.concat(F.lit("20"), y)).otherwise(y)
    numeric = F.concat_ws("-", year, F.lpad(num(1), 2, "0"), F.lpad(d, 2, "0"))
    named = F.concat_ws("-", word(3), F.lpad(month_no.cast("string"), 2, "0"), F.lpad(word(2), 2, "0"))
    text = F.when(num(1) != "", numeric).when(word(1) != "", named)
    return F.date_format(F.try_to_date(text, "yyyy-MM-dd"), "yyyy-MM-dd")


def seconds_of(clock: Column) -> Column:
    """Seconds of "1:06:30", "06:30" or "30"."""
    return F.aggregate(F.split(clock, ":"), F.lit(0.0), lambda s, x: s * 60 + x.cast("double"))


def clock_of(seconds: Column, comma: bool = False) -> Column:
    """HH:MM:SS, with ,mmm for subtitles."""
    ms = F.round(seconds * 1000).cast("long")
    parts = [F.floor(ms / 3_600_000), F.floor(ms / 60_000) % 60, F.floor(ms / 1000) % 60]
    if comma:
        return F.format_string("%02d:%02d:%02d,%03d", *[p.cast("long") for p in parts], (ms % 1000).cast("long"))
    return F.format_string("%02d:%02d:%02d", *[p.cast("long") for p in parts])


def occurrences(text: Column, span: Column) -> Column:
    """How often a span occurs, by the difference in length without it."""
    return F.when(F.length(span) > 0, ((F.length(text) - F.length(F.replace(text, span, F.lit("")))) / F.length(span)).cast("long")).otherwise(F.lit(0).cast("long"))


def first_words(text: Column, n: int) -> Column:
    return F.array_join(F.slice(F.split(F.trim(text), r"\s+"), 1, n), " ")


def dissenters(sentence: Column) -> Column:
    """The names before "voting nay", "voting no", "dissenting" or "opposed" in an outcome sentence, after its tally; an empty array if there are none."""
    names = F.regexp_extract(sentence, r"(?i)\d+\s*-\s*\d+[,;:]?\s*\(?(.+?)\s+(?:voting (?:nay|no)|dissenting|opposed)\b", 1)
    return F.filter(F.split(names, r"(?i)\s*,\s*and\s+|\s*,\s*|\s+and\s+"), lambda n: n != "")


def quote(text: Column, pattern: str, most: int = 240) -> Column:
    """The sentence around the first match of a pattern, at most ``most`` characters and an ellipsis; with an ellipsis before a text's fragment.

    A sentence reaches from one full stop to the next; without a match the text's beginning is quoted.
    """
    before, match = F.regexp_extract(text, rf"(?s)^(.*?)({pattern})", 1), F.regexp_extract(text, rf"(?s)^(.*?)({pattern})", 2)
    lead = F.regexp_extract(before, r"(?s)([^.]*)$", 1)
    rest = F.substring(text, F.length(before) + F.length(match) + 1, F.length(text))
    tail = F.regexp_extract(rest, r"(?s)^([^.]*\.?)", 1)
    whole = F.regexp_replace(F.concat(lead, match, tail), r"^\s+|\s+$", "")
    cut = F.when(F.length(whole) > most, F.concat(F.regexp_replace(F.substring(whole, 1, most), r"\s+$", ""), F.lit("…"))).otherwise(whole)
    fragment = ~F.contains(before, F.lit(".")) & whole.rlike(r"^\p{Ll}")
    found = F.when(fragment, F.concat(F.lit("…"), cut)).otherwise(cut)
    return F.when(text.rlike(f"(?s){pattern}"), found).otherwise(F.substring(text, 1, most))
