"""SimHash fingerprints, and all fingerprints within a Hamming radius by permuted block tables.

A text's terms are its word shingles (a text with fewer words is one term); each occurrence
has weight one, so a distinct term weighs its count.  Every term hashes to ``BITS`` bits and
votes on each: the fingerprint's bit is set where the set bits have more than half of the
votes.  Votes are counted natively in one aggregation: two lanes of 32 bits are packed into
a long, which holds the counts of any text that a string can be.

``within`` cuts fingerprints into ``blocks`` blocks.  Two fingerprints that differ in at
most r bits agree on at least ``blocks`` - r whole blocks; for every choice of that many
blocks there is a table keyed by them, so an equi-join per table finds every pair.  A pair
is emitted by the first of its tables only.

Edge cases: null text counts as empty; a text without words has no terms and an all-zero
fingerprint; equal texts have equal fingerprints; rows that repeat id and text are one document, with a
result for each row; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rostrum.llm import shared

#: Words in a term, and bits of a fingerprint.
WORDS, BITS = 5, 128
#: Hamming radius of the search, and blocks of its tables.
RADIUS, BLOCKS = 6, 8
_MASK = 0x0000000100000001


def terms(text: Column, k: int = WORDS) -> Column:
    """Array of the hashes of a text's terms."""
    words = F.filter(F.split(shared.fold_ascii_col(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    codes = F.transform(words, lambda w: F.xxhash64(w))

    def shingles(c: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(c) - k, F.lit(0)))
        return F.transform(starts, lambda i: F.xxhash64(*[F.get(c, i + j) for j in range(k)]))

    def of(c: Column) -> Column:
        return F.when(F.size(c) > 0, shingles(c)).otherwise(F.array().cast("array<bigint>"))

    # the codes are bound once: a lambda would work out an outer expression again for every shingle
    return F.get(F.transform(F.array(codes), of), F.lit(0))


def fingerprints(rows: DataFrame, keys: list[str], text: str = "text", k: int = WORDS) -> DataFrame:
    """``keys`` and the fingerprint as two longs, hi and lo, for each distinct combination of ``keys``.

    Rows that are already dealt by some of the keys aren't shuffled.
    """
    words = rows.select(*keys, terms(F.coalesce(F.col(text), F.lit("")), k).alias("t"))
    each = words.select(*keys, F.explode_outer("t").alias("h0")).withColumn("h1", F.when(F.col("h0").isNotNull(), F.xxhash64("h0")))
    # the sum of v_s counts bit s in its lower and bit s + 32 in its upper lane
    packed = [F.sum(F.shiftright(F.col(f"h{w}"), s).bitwiseAND(F.lit(_MASK))).alias(f"v{w}_{s}") for w in range(BITS // 64) for s in range(32)]
    counts = each.groupBy(*keys).agg(F.count("h0").alias("n"), *packed)

    def bit(w: int, b: int) -> Column:
        votes = F.shiftright(F.col(f"v{w}_{b % 32}"), 32 * (b // 32)).bitwiseAND(F.lit(0xFFFFFFFF))
        return F.when(votes * 2 > F.col("n"), F.lit(1 << b if b < 63 else -(1 << 63))).otherwise(F.lit(0)).cast("long")

    word = lambda w: sum((bit(w, b) for b in range(1, 64)), bit(w, 0))
    return counts.select(*keys, word(0).alias("hi"), word(1).alias("lo"))


def hexadecimal(longs: list[Column]) -> Column:
    """The bits of longs as lower-case hexadecimal digits."""
    return F.lower(F.concat(*[F.lpad(F.hex(x), 16, "0") for x in longs]))


def distance(a: list[Column], b: list[Column]) -> Column:
    """Bits in which two lists of longs differ."""
    apart = [F.bit_count(x.bitwiseXOR(y)) for x, y in zip(a, b, strict=True)]
    return sum(apart[1:], apart[0])


def likeness(a: list[Column], b: list[Column]) -> Column:
    """Estimated cosine of two texts' term vectors, from 0 to 1: 1 for equal fingerprints, 0 from half of the bits on."""
    return F.greatest(F.cos(F.lit(3.141592653589793) * distance(a, b) / BITS), F.lit(0.0))


def block_bounds(blocks: int) -> list[tuple[int, int, int]]:
    """For each block its long, its lowest bit there, and its bits."""
    out = []
    for word, own in enumerate((blocks - blocks // 2, blocks // 2)):
        cuts = [64 * i // own for i in range(own + 1)]
        out += [(word, lo, hi - lo) for lo, hi in zip(cuts, cuts[1:], strict=False)]
    return out


def within(prints: DataFrame, queries: DataFrame | None = None, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """Pairs of distinct fingerprints that differ in at most ``radius`` bits: a_hi, a_lo, b_hi, b_lo, distance, b_rows.

    ``prints`` and ``queries`` have columns hi and lo; ``b_rows`` is how many rows of ``prints`` have b.  Without
    ``queries`` each pair comes once, a < b; with them, a is a query and b any print, its own among them.
    """
    bounds = block_bounds(blocks)
    tables = list(combinations(range(blocks), blocks - radius))

    def bits(side: str, i: int) -> Column:
        word, low, n = bounds[i]
        return F.shiftrightunsigned(F.col(f"{side}_{('hi', 'lo')[word]}"), low).bitwiseAND(F.lit((1 << n) - 1))

    def key(side: str, no: int) -> Column:
        out = F.lit(no).cast("long")
        for i in tables[no]:
            out = F.shiftleft(out, bounds[i][2]) + bits(side, i)
        return out

    def keyed(df: DataFrame, side: str, *more: str) -> DataFrame:
        cols = [f"{side}_hi", f"{side}_lo", *more]
        return df.select(*cols, F.posexplode(F.array(*[key(side, no) for no in range(len(tables))])).alias(f"{side}_no", "key"))

    own = lambda df, side: df.groupBy(F.col("hi").alias(f"{side}_hi"), F.col("lo").alias(f"{side}_lo"))
    left = keyed(own(prints if queries is None else queries, "a").count(), "a")
    right = keyed(own(prints, "b").agg(F.count("*").alias("b_rows")), "b", "b_rows").drop("b_no")
    a, b = ([F.col(f"{side}_{x}") for x in ("hi", "lo")] for side in "ab")
    near = distance(a, b)
    # the blocks that agree, as the bits of a number; the first table of a pair is that of the lowest ones
    agree = [F.when(bits("a", i) == bits("b", i), F.lit(1 << i)).otherwise(F.lit(0)) for i in range(blocks)]
    rest, first = sum(agree[1:], agree[0]), F.lit(0)
    for _ in range(blocks - radius):
        low = rest.bitwiseAND(-rest)
        first, rest = first + low, rest - low
    masks = F.array(*[F.lit(sum(1 << i for i in t)) for t in tables])
    # both sides grow with the data: neither is broadcast
    pairs = left.hint("merge").join(right.hint("merge"), "key").filter(near <= radius)
    if queries is None:
        pairs = pairs.filter((a[0] < b[0]) | ((a[0] == b[0]) & (a[1] < b[1])))
    return pairs.filter(F.get(masks, F.col("a_no")) == first).select("a_hi", "a_lo", "b_hi", "b_lo", near.alias("distance"), "b_rows")


# --- edited texts --------------------------------------------------------------------------


def row_key(docs: DataFrame) -> list[Column]:
    """The columns id and hash: the id (null: the least long) and a hash of the text tell rows apart."""
    return [F.coalesce(docs["doc_id"].cast("long"), F.lit(-(2**63))).alias("id"), F.xxhash64(F.coalesce(docs["text"], F.lit(""))).alias("hash")]


def order_of(docs: DataFrame) -> DataFrame:
    """id, hash, doc_id, n_chars, repeats, next_id, next_hash: the next document by descending id, after the last the first.

    Null ids come last; documents with one id are in the order of their hashes; rows that repeat both are one document.
    Documents are dealt to ranges by Spark's sampling; a range learns only the first row of the next.
    """
    spark = docs.sparkSession
    n = F.char_length(F.coalesce(docs["text"], F.lit(""))).cast("long")
    rows = docs.select(*row_key(docs), docs["doc_id"].cast("long").alias("doc_id"), n.alias("n_chars"))
    narrow = rows.groupBy("id", "hash").agg(F.max("doc_id").alias("doc_id"), F.max("n_chars").alias("n_chars"), F.count("*").alias("repeats"))
    by = [F.col("id").desc(), F.col("hash")]
    ranged = narrow.repartitionByRange(shared.partitions(spark), *by).withColumn("range", F.spark_partition_id())
    ranged, _ = shared.stage(ranged, "simhash-order")
    own = Window.partitionBy("range").orderBy(*by)
    heads = ranged.withColumn("no", F.row_number().over(own)).filter("no = 1").select("range", "id", "hash").orderBy("range").collect()  # a row for each range
    after = [(h["range"], *heads[(i + 1) % len(heads)][1:]) for i, h in enumerate(heads)]
    after = F.broadcast(spark.createDataFrame(after, "range int, first_id long, first_hash long"))  # as many rows as ranges
    ahead = [F.coalesce(F.lead(c).over(own), F.col(f"first_{c}")).alias(f"next_{c}") for c in ("id", "hash")]
    return ranged.join(after, "range").select("id", "hash", "doc_id", "n_chars", "repeats", *ahead)


def with_next(docs: DataFrame, order: DataFrame) -> DataFrame:
    """id, hash, text and head of every document: as much of the next document's start as an edit takes.

    A text moves once, to the place of its key.  From there its start, a third of a text on average, goes to
    the place of the document before.
    """
    # one shuffle, read for the texts and for their starts
    texts = docs.select(*row_key(docs), F.coalesce(docs["text"], F.lit("")).alias("text")).repartition("id", "hash").dropDuplicates(["id", "hash"])
    asked = order.select(F.col("next_id").alias("id"), F.col("next_hash").alias("hash"), F.col("id").alias("for_id"), F.col("hash").alias("for_hash"), F.floor(F.col("n_chars") / 3).cast("int").alias("cut"))
    heads = texts.hint("merge").join(asked, ["id", "hash"]).select(F.col("for_id").alias("id"), F.col("for_hash").alias("hash"), F.substring("text", F.lit(1), F.col("cut")).alias("head"))
    return texts.join(heads, ["id", "hash"], "left")


def edited(text: Column, head: Column) -> Column:
    """The text with its last third replaced by the start of the following text."""
    n = F.char_length(text)
    return F.concat(F.substring(text, F.lit(1), n - F.floor(n / 3).cast("int")), F.coalesce(head, F.lit("")))
