"""Main text of web pages by nearest-URL page differencing.

Pages of one host are put in the order of their URL paths.  A page's partner is the
neighbour in that order whose path shares the longer prefix with its own (the one before, if
equal); it is most likely made from the same template.  Both pages are cut into text
lines, the lines are aligned by a longest common subsequence, and shared lines are deleted.

Differencing alone deletes what two articles share and keeps boilerplate that differs, so
markup takes part: each line knows whether it stands in an article or main element, and
whether in an element that is never article text (menus, headers, footers, sidebars, notices,
adverts, forms, comments).  Class and id values tell by their whole words or known compounds,
and a main element, or an article if the page has no other, counts inside of one so named.
Lines that are never article text go whatever the partner has.  Inside an article, shared lines
that are nothing but links go; other shared lines stay, as pages of one host may well quote the same passage.
Outside of articles all shared lines go, and on a page with an article the other lines as well.

The parse is one pass.  Partners are found from narrow keys in ranges of (host, path, id):
each range also gets copies of the rows just before and after it, so that a host with a third of
all pages is split like any other.  A page's lines move once, compressed, to the place of its key; from there
their 64-bit hashes go to the page that it is partner of.  Collisions of hashes are left out of account.

Malformed markup never raises: comments, declarations and elements without an end reach to the
end of the page, and unknown declarations are comments.

Edge cases: null html counts as empty and gives an empty text; a page without a partner (a
host of one page) is judged by markup alone; rows that repeat id, url and html are one page, with
a result for each row; pages with one text and different ids partner each other and keep their articles; urls that can't be parsed, or null, are one host; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rostrum.llm import shared

# HTML element names and common class or id words by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead title tr ul".split())
HIDDEN = frozenset("script style noscript template head title iframe object svg canvas select textarea button datalist audio video math".split())
NEVER = frozenset("nav header footer aside menu dialog search".split())
ARTICLE = frozenset("article main".split())
NEVER_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog alertdialog menu menubar".split())
NEVER_WORDS = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo promotion recommended related replies respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split())
# words that may stand beside those in a compound, as in site-header or comments-section
NEVER_BESIDE = frozenset("area articles bar block bottom box button buttons container global group inline items links list main page posts primary secondary section site slot stories top wrap wrapper".split())
CLOSES_P = BLOCK - frozenset("body html head td th tr tbody thead tfoot".split())


def marks_never(name: str) -> bool:
    """Whether a class or id names an element that is never article text: all of its parts have to.

    A part alone doesn't tell: has-sidebar, no-comments and header-fixed stand on wrappers of whole pages.
    """
    parts = [x for x in name.lower().replace("_", "-").split("-") if x and not x.isdecimal()]
    return any(x in NEVER_WORDS for x in parts) and all(x in NEVER_WORDS or x in NEVER_BESIDE for x in parts)


class _Lines(HTMLParser):
    """Text lines of a page: (text, inside an article, never article text, in an article inside of such an element, all in links).

    The page is fed whole, so that what has no end ends with the page.
    """

    # How comments end in HTML.
    COMMENT_END = re.compile(r"--!?>")
    COMMENT_EMPTY = re.compile(r"<!---?>")

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[tuple[str, bool, bool, bool, bool]] = []
        # name, article, never, hidden, never by a class, id or form, and an article inside of that
        self.open: list[tuple[str, bool, bool, bool, bool, bool]] = []
        self.held: list[str] = []
        self.where: tuple[bool, bool, bool, bool, bool] | None = None  # what held of the place where the line's text began
        self.plain = False  # whether the line at hand has text outside of links

    def _now(self) -> tuple[bool, bool, bool, bool, bool]:
        return self.open[-1][1:] if self.open else (False,) * 5

    def flush(self) -> None:
        if self.held:
            text = " ".join("".join(self.held).split())
            linked, self.plain = not self.plain, False
            self.held.clear()
            # hidden text is never held: an element that is open by now may be, as an unclosed script, and tells nothing of the line
            (article, never, _, named, doubt), self.where = self.where or self._now(), None
            if text:
                self.out.append((text, article, never or named, doubt, linked))

    def parse_comment(self, i: int, report: int = 1) -> int:
        """The end of a comment; one without an end takes all that is left."""
        end = self.COMMENT_END.search(self.rawdata, i + 4)
        if self.COMMENT_EMPTY.match(self.rawdata, i):
            end = self.COMMENT_EMPTY.match(self.rawdata, i)
        return end.end() if end else len(self.rawdata)

    def parse_bogus_comment(self, i: int, report: int = 1) -> int:
        """A declaration, marked section or instruction is passed over up to the next sign for greater, or to the end."""
        end = self.rawdata.find(">", i + 2)
        return end + 1 if end >= 0 else len(self.rawdata)

    parse_pi = parse_bogus_comment

    def parse_starttag(self, i: int) -> int:
        """The end of a tag; one that the page's end cuts short is no text."""
        end = super().parse_starttag(i)
        return end if end >= 0 else len(self.rawdata)

    def parse_endtag(self, i: int) -> int:
        end = super().parse_endtag(i)
        return end if end >= 0 else len(self.rawdata)

    def parse_html_declaration(self, i: int) -> int:
        return self.parse_bogus_comment(i)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCK:
            self.end_line()
        elif tag == "br":
            self.held.append(" ")
        if tag in VOID:
            return
        if tag in CLOSES_P:
            self._close_p()
        own = {k: v or "" for k, v in attrs}
        article, never, hidden, named, doubt = self._now()
        main = tag == "main" or own.get("role") == "main"
        starts = main or tag in ARTICLE or own.get("role") == "article"
        if starts and named:  # a wrapper's name doesn't undo the article in it; comments are articles too, though
            named, doubt = False, not main
        by_name = tag == "form" or (tag not in ("body", "html", *ARTICLE) and any(map(marks_never, f"{own.get('class', '')} {own.get('id', '')}".split())))
        # an article's own heading block is part of it
        aside = tag in NEVER or own.get("role") in NEVER_ROLES
        gone = tag in HIDDEN or "hidden" in own or own.get("aria-hidden") == "true" or "display:none" in own.get("style", "").replace(" ", "").lower()
        if not gone and not hidden and tag not in BLOCK and (aside or by_name):
            self.flush()
        self.open.append((tag, article or starts, never or aside, hidden or gone, named or by_name, doubt))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCK:
            self.end_line()
        elif tag == "br":
            self.held.append(" ")

    def end_line(self) -> None:
        """Blocks end the line, but for those in hidden elements."""
        if not self._now()[2]:
            self.flush()

    def _close_p(self) -> None:
        """An open paragraph ends where another block begins; inline elements left open in it end too."""
        for i in range(len(self.open) - 1, -1, -1):
            name = self.open[i][0]
            if name == "p":
                self.flush()
                del self.open[i:]
                return
            if name in BLOCK or name in HIDDEN:
                return

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self.end_line()
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                outer = self.open[i - 1] if i else (tag, *(False,) * 5)
                self.end_line() if tag in BLOCK or (self.open[i][2] or self.open[i][4]) != (outer[2] or outer[4]) else None
                del self.open[i:]
                return
            if self.open[i][0] in BLOCK and tag not in BLOCK:
                return  # an inline element that isn't open in this block

    def handle_data(self, data: str) -> None:
        now = self._now()
        if not now[2]:
            self.held.append(data)
            if self.where is None and not data.isspace():
                self.where = now
            self.plain = self.plain or not (data.isspace() or any(x[0] == "a" for x in self.open))


Line = tuple[str, bool, bool, bool]


def lines_of(html: str | None) -> list[Line]:
    """Text lines of a page in order: (text, inside an article, never article text, all in links).

    An article inside of an element named as never article text counts if the page has no other.
    """
    parser = _Lines()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    other = any(article and not never and not doubt for _, article, never, doubt, _ in parser.out)
    return [(text, article, never or (doubt and other), linked) for text, article, never, doubt, linked in parser.out]


def marks_of(lines: list[str]) -> np.ndarray:
    """64-bit hashes that stand for the lines in a comparison."""
    import xxhash

    return np.array([xxhash.xxh3_64_intdigest(t) for t in lines], np.uint64)


def shared_lines(a: list, b: list) -> set[int]:
    """Places in ``a`` of the lines of a longest common subsequence with ``b`` (bit-parallel)."""
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    hi_a, hi_b = len(a), len(b)
    while hi_a > lo and hi_b > lo and a[hi_a - 1] == b[hi_b - 1]:
        hi_a, hi_b = hi_a - 1, hi_b - 1
    out = {*range(lo), *range(hi_a, len(a))}
    in_a = set(a[lo:hi_a])
    inner_b = [x for x in b[lo:hi_b] if x in in_a]  # other lines can't match
    in_b = set(inner_b)
    inner_a = [i for i in range(lo, hi_a) if a[i] in in_b]
    m = len(inner_b)
    if not m:
        return out
    places: dict = {}
    for j, x in enumerate(inner_b):
        places[x] = places.get(x, 0) | 1 << j
    full, v, rows = (1 << m) - 1, (1 << m) - 1, []
    for i in inner_a:
        u = v & places[a[i]]
        v = ((v + u) | (v - u)) & full
        rows.append(v)
    # zeros of row i below bit j count the common subsequence of the first i + 1 and j lines
    j = m
    zeros = lambda r, k: k - (r & ((1 << k) - 1)).bit_count()
    for at in range(len(inner_a) - 1, -1, -1):
        before = rows[at - 1] if at else full
        while j and zeros(rows[at], j - 1) == zeros(rows[at], j):
            j -= 1
        if not j:
            break
        if zeros(before, j) < zeros(rows[at], j):
            out.add(inner_a[at])
            j -= 1
    return out


def main_text(lines: list[Line], partner: list[int] | None) -> str:
    """The lines that are article text, joined by line breaks; ``partner`` has the marks of the partner's lines."""
    has_article = any(article and not never for _, article, never, _ in lines)
    common = shared_lines(marks_of([x[0] for x in lines]).tolist(), partner) if partner else set()
    keep = [
        text
        for i, (text, article, never, linked) in enumerate(lines)
        if not never and ((article and not (linked and i in common)) or (not has_article and i not in common))
    ]
    return "\n".join(keep)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def packed(lines: list[Line]) -> bytes:
    """A page's lines as bytes: their number, their marks, their flags, and the compressed texts."""
    texts = [x[0] for x in lines]
    flags = bytes(a + 2 * n + 4 * k for _, a, n, k in lines)
    return len(lines).to_bytes(4, "big") + marks_of(texts).tobytes() + flags + zlib.compress("\n".join(texts).encode())


def unpacked(page: bytes) -> list[Line]:
    n = int.from_bytes(page[:4], "big")
    flags, texts = page[4 + 8 * n : 4 + 9 * n], zlib.decompress(page[4 + 9 * n :]).decode().split("\n")
    return [(t, bool(f & 1), bool(f & 2), bool(f & 4)) for t, f in zip(texts, flags, strict=bool(n))]


def _marks(page: Column) -> Column:
    """The marks in a packed page."""
    n = F.conv(F.hex(F.substring(page, 1, 4)), 16, 10).cast("int")
    return F.substring(page, F.lit(5), n * 8)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 500):
            part = b.slice(at, 500)
            pages = pa.array([packed(lines_of(h.as_py())) for h in part.column(2)], pa.binary())
            yield pa.RecordBatch.from_arrays([*part.columns[:2], pages], names=["id", "hash", "page"])


def common_prefix(a: Column, b: Column) -> Column:
    """Characters that two strings begin with alike, by halving steps."""
    most = F.least(F.char_length(a), F.char_length(b))
    halves = F.sequence(F.floor(F.log2(F.greatest(most, F.lit(1)))).cast("int"), F.lit(0), F.lit(-1))

    def step(n: Column, i: Column) -> Column:
        on = n + F.call_function("shiftleft", F.lit(1), i)
        return F.when((on <= most) & (F.substring(a, F.lit(1), on) == F.substring(b, F.lit(1), on)), on).otherwise(n)

    return F.aggregate(halves, F.lit(0), step)


def partners(pages: DataFrame) -> DataFrame:
    """id, hash, page_id, url, repeats, and of the page at the nearest URL of the host: partner, partner_hash, partner_id.

    Rows that repeat id, url and html are one page.  The last three are null on a host of one page.
    """
    spark = pages.sparkSession
    rows = pages.select(*page_key(pages), F.col("page_id").cast("long").alias("page_id"), "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = rows.groupBy(*rows.columns).agg(F.count("*").alias("repeats"))
    # ranges of the order, by Spark's own sampling; staged, so that they can't change
    order = ["host", "path", "id", "hash"]
    narrow = rows.repartitionByRange(shared.partitions(spark), *order).withColumn("range", F.spark_partition_id())
    narrow, _ = shared.stage(narrow, "page-order")
    page = F.struct(*order, "page_id")
    ends = narrow.groupBy("range").agg(F.min(page).alias("first"), F.max(page).alias("last"))  # a row for each range
    by_range = Window.orderBy("range")
    ends = ends.select(F.lag("last").over(by_range).alias("before"), F.lead("first").over(by_range).alias("after"), "range")
    copies = ends.select("range", F.explode(F.array_compact(F.array("before", "after"))).alias("k")).select("range", "k.*", F.lit(True).alias("copy"))
    dealt = narrow.withColumn("copy", F.lit(False)).unionByName(copies, allowMissingColumns=True)
    w = Window.partitionBy("range").orderBy(*order)
    both = dealt.select("*", F.lag(page).over(w).alias("p"), F.lead(page).over(w).alias("q")).filter("not copy")
    shares = lambda side: F.when(F.col(f"{side}.host") == F.col("host"), common_prefix(F.col("path"), F.col(f"{side}.path"))).otherwise(-1)
    chosen = both.withColumn("cp", shares("p")).withColumn("cq", shares("q"))
    best = F.when((F.col("cp") < 0) & (F.col("cq") < 0), None).when(F.col("cp") >= F.col("cq"), F.col("p")).otherwise(F.col("q"))
    chosen = chosen.withColumn("best", best)
    return chosen.select("id", "hash", "page_id", "url", "repeats", F.col("best.id").alias("partner"), F.col("best.hash").alias("partner_hash"), F.col("best.page_id").alias("partner_id"))


def page_key(pages: DataFrame) -> list[Column]:
    """The columns id and hash: the id (null: the least long) and a hash of url and html tell rows apart."""
    return [F.coalesce(pages["page_id"].cast("long"), F.lit(-(2**63))).alias("id"), F.xxhash64(pages["url"], pages["html"]).alias("hash")]


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and partner_id for every page."""
    pairs, _ = shared.stage(partners(pages), "page-partners")
    parsed = pages.select(*page_key(pages), pages["html"].alias("html")).mapInArrow(shared.tidied(_parse), "id long, hash long, page binary")
    # one shuffle, read for the pages and for the marks that their partners ask for
    parsed = parsed.repartition("id", "hash").dropDuplicates(["id", "hash"])
    asked = pairs.filter("partner is not null").select(F.col("partner").alias("id"), F.col("partner_hash").alias("hash"), F.col("id").alias("for_id"), F.col("hash").alias("for_hash"))
    marks = parsed.hint("merge").join(asked, ["id", "hash"]).select(F.col("for_id").alias("id"), F.col("for_hash").alias("hash"), _marks(F.col("page")).alias("marks"))
    joined = parsed.hint("merge").join(pairs, ["id", "hash"]).join(marks, ["id", "hash"], "left")

    def difference(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [main_text(unpacked(p), None if m is None else np.frombuffer(m, np.uint64).tolist()) for p, m in zip(b["page"], b["marks"], strict=True)]
            yield b.drop(columns=["page", "marks"]).assign(text=texts)

    found = joined.select("page_id", "url", "partner_id", "repeats", "page", "marks").mapInPandas(difference, "page_id long, url string, partner_id long, repeats long, text string")
    return found.withColumn("copy", F.explode(F.sequence(F.lit(1), "repeats"))).select("page_id", "url", "text", "partner_id")
