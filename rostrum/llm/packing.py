"""Packing of documents into training sequences along a space-filling curve.

1. ``vectorise`` tokenises every whole text and projects its hashed token counts (a signed
   random vector of ``DIMENSIONS`` values belongs to every token) onto a few dimensions.
2. The projections are cut into cells at quantiles of the corpus, and a document's key is the
   index of its cell on the Hilbert curve through all cells.
3. Documents are range-sorted by (key, id), so that a hot cell, such as that of many copies,
   is split by id; prefix sums of token counts in each range and over the ranges (one
   row each) give every document its place in one stream of tokens.
4. The stream is cut every ``length`` tokens: neighbours on the curve share sequences, and no
   token is padding.  The rest at the end is cut into sequences of powers of two.

Only ids, keys and counts are sorted; token ids are written once and meet their offsets in
one join.  Edge cases: null text counts as empty; a document always has its end token, so
it has a piece; repeated rows are packed as often as they occur; an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rostrum.llm import shared

#: Tokens in a sequence, and the id that ends a document.
LENGTH, END = 4096, 2
#: Dimensions of the curve, and bits of a cell's place on each.
DIMENSIONS, CELL_BITS = 4, 5
#: Characters of text that are encoded at a time, characters of known words a worker keeps, and those added for each word.
CHARS, ROOM, WORD_ROOM = 3_000_000, 24_000_000, 20

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def projection(vocabulary: int, dimensions: int = DIMENSIONS, seed: int = 11) -> np.ndarray:
    """A signed vector for every token."""
    return np.random.default_rng(seed).choice(np.array([-1.0, 1.0], np.float32), (vocabulary, dimensions))


#: Bits of a dimension in a packed vector, and tokens whose packed vectors may be added up.
LANE = 16
LANE_TOKENS = (1 << LANE - 1) - 1


def packed_projection(table: np.ndarray) -> np.ndarray:
    """The signed vectors of four dimensions at most as whole numbers: a lane for each, with 0 for -1 and 2 for 1."""
    lanes = (table + 1).astype(np.int64) << (LANE * np.arange(table.shape[1], dtype=np.int64))
    return lanes.sum(axis=1).view(np.uint64)


def project(ids: np.ndarray, packed: np.ndarray, dimensions: int) -> np.ndarray:
    """The sum of the vectors of tokens, four of them in one addition."""
    out = np.full(dimensions, -len(ids), np.int64)
    for at in range(0, len(ids), LANE_TOKENS):
        total = int(packed[ids[at : at + LANE_TOKENS]].sum())
        out += [total >> LANE * d & (1 << LANE) - 1 for d in range(dimensions)]
    return out.astype(np.float32)


# The normaliser and the cuts that words may be shared under.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_CUT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}


class Encoder:
    """Token ids of texts; the tokenizer's model is asked once for each word, and known words are kept.

    This holds for tokenizers that drop white space and never merge across it, so that a text's ids are
    those of its chunks in order; the definition tells, and by any other one texts are encoded whole.  Texts of
    plain Latin letters, digits and signs are cut into words by the tokenizer's own pattern; of other texts, and
    of those with a special token, so are the plain chunks, and each other chunk is encoded by the whole
    tokenizer.  Long texts are cut at white space, so that only ids grow with a text.  The table of known words is
    begun anew when it is full.
    """

    # the letters, and of the other signs those that are neither a letter, a number nor white space, below U+0180;
    # U+0130 isn't one, as its lower case is two code points
    LETTERS = "a-z\u00aa\u00b5\u00ba\u00df-\u00f6\u00f8-\u012f\u0131-\u017f"

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        known = json.loads(definition)
        cuts = (known.get("pre_tokenizer") or {}).get("pretokenizers", [])
        self.by_word = known.get("normalizer") == _NORMALIZER and cuts == [_CUT, _BYTES] and not known.get("post_processor")
        self.tokenizer = Tokenizer.from_str(definition)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        signs = "".join(re.escape(chr(c)) for c in range(0x21, 0x7F) if not chr(c).isalnum())
        self.latin = re.compile(f"[A-Z\u00c0-\u00d6\u00d8-\u00de{self.LETTERS}0-9{signs} \t-\r]*").fullmatch
        self.words = re.compile(f"[{self.LETTERS}]+|[0-9]|'s|'t|'re|'ve|'m|'ll|'d|[{signs}]+").findall
        # bytes as the letters that stand for them: printable ones for themselves, the others from U+0100 on
        shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
        self.letters = {b: 0x100 + i for i, b in enumerate(b for b in range(256) if b not in shown)}
        self._clear()

    def _clear(self) -> None:
        self.places: dict[str, int] = {}
        self.tokens, self.held = shared.Lists(), 0

    def _plain(self, text: str) -> bool:
        return self.latin(text) is not None and not any(s in text for s in self.special)

    def _units(self, text: str) -> list[str]:
        """A text's words; a chunk that isn't plain is a unit with a space before it."""
        if self._plain(text):
            return self.words(text.lower())
        out: list[str] = []
        for chunk in text.replace("\n", " ").split(" "):
            if self._plain(chunk):
                out += self.words(chunk.lower())
            else:
                out.append(" " + chunk)
        return out

    def _learn(self, units: list[str]) -> None:
        whole = iter(self.tokenizer.encode_batch_fast([u for u in units if u[0] == " "], add_special_tokens=False))
        shown = (u if u[0] == " " or u.isascii() else u.encode().decode("latin-1").translate(self.letters) for u in units)
        cut = self.tokenizer.model.tokenize
        ids = [next(whole).ids if u[0] == " " else [t.id for t in cut(u)] for u in shown]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        self.tokens.add(np.fromiter(chain.from_iterable(ids), np.int32, int(sizes.sum())), sizes)
        self.places.update(zip(units, range(len(self.places), len(self.places) + len(units)), strict=True))
        self.held += sum(map(len, units)) + WORD_ROOM * len(units)

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        if self.held > ROOM:
            self._clear()
        units: list[str] = []
        ends = [0]
        for t in texts:
            units += self._units(t)
            ends.append(len(units))
        found = pa.array(units, pa.large_string()).dictionary_encode()
        distinct = found.dictionary.to_numpy(zero_copy_only=False).tolist()
        if new := [u for u in distinct if u not in self.places]:
            self._learn(new)
        words = np.array([self.places[u] for u in distinct], np.int64)[found.indices.to_numpy()]
        bounds = np.append(0, np.cumsum(self.tokens.sizes(words)))[ends]
        ids = self.tokens.of(words)
        return [ids[start:end] for start, end in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        if not self.by_word:
            return [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
        out: list[list[np.ndarray]] = [[] for _ in texts]
        part, owners, held = [], [], 0
        for owner, text in enumerate(texts):
            for piece in pieces_of(text or "", CHARS):
                part.append(piece)
                owners.append(owner)
                held += len(piece)
                if held >= CHARS:
                    for o, x in zip(owners, self._encode(part), strict=True):
                        out[o].append(x)
                    part, owners, held = [], [], 0
        for o, x in zip(owners, self._encode(part), strict=True):
            out[o].append(x)
        return [x[0] if len(x) == 1 else np.concatenate(x) for x in out]


def pieces_of(text: str, size: int) -> Iterator[str]:
    """The text in pieces of at most ``size`` characters, cut at spaces and line breaks only; longer where there is none."""
    start = 0
    while len(text) - start > size:
        at = max(text.rfind(" ", start, start + size), text.rfind("\n", start, start + size))
        if at <= start:
            at = min((i for i in (text.find(" ", start + 1), text.find("\n", start + 1)) if i > 0), default=len(text))
        yield text[start:at]
        start = at
    yield text[start:]


#: In a worker: the encoder of the definition at hand.
_ENCODERS: dict[str, Encoder] = {}


def encoder_of(definition: str) -> Encoder:
    """The worker's encoder, which keeps its words from task to task."""
    if definition not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[definition] = Encoder(definition)
    return _ENCODERS[definition]


def vectorise(docs: DataFrame, definition: str, vocabulary: int, dimensions: int = DIMENSIONS, end: int = END) -> DataFrame:
    """doc_id, ids (little-endian, two or four bytes each), n and the projected coordinates c0, c1, ..."""
    width = np.dtype("<u2") if vocabulary <= 1 << 16 else np.dtype("<u4")
    names = [f"c{i}" for i in range(dimensions)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, table = encoder_of(definition), projection(vocabulary, dimensions)
        lanes = packed_projection(table) if dimensions * LANE <= 64 else None
        for b in batches:
            at = 0
            while at < b.num_rows:
                texts, held = [], 0
                while at + len(texts) < b.num_rows and held < CHARS:
                    texts.append(b.column(1)[at + len(texts)].as_py())
                    held += len(texts[-1] or "")
                ids, coords, n = [], [], []
                for x in encoder(texts):
                    v = np.bincount(x, minlength=vocabulary).astype(np.float32) @ table if lanes is None else project(x, lanes, dimensions)
                    coords.append(v / max(float(np.sqrt(len(x))), 1.0))
                    ids.append(np.append(x, end).astype(width).tobytes())
                    n.append(len(x) + 1)
                c = np.array(coords, np.float32).reshape(-1, dimensions)
                columns = [b.column(0).slice(at, len(texts)), pa.array(ids, pa.binary()), pa.array(n, pa.int64()), *(pa.array(c[:, i]) for i in range(dimensions))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "n", *names])
                at += len(texts)

    schema = "doc_id long, ids binary, n long, " + ", ".join(f"{c} float" for c in names)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(shared.tidied(run), schema)


def hilbert(cells: np.ndarray, bits: int = CELL_BITS) -> np.ndarray:
    """Indexes on the Hilbert curve of rows of cell coordinates (Skilling's transposition)."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the rotations and reflections of the higher bits
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            t = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ t)
            x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> b & 1)
    return key


def keyed(vectors: DataFrame, dimensions: int = DIMENSIONS, bits: int = CELL_BITS) -> DataFrame:
    """``vectors`` with the Hilbert key of its cell; cells are bounded by quantiles of the corpus."""
    names = [f"c{i}" for i in range(dimensions)]
    shares = [i / (1 << bits) for i in range(1, 1 << bits)]
    cuts = vectors.agg(*[F.percentile_approx(c, shares, 1000).alias(c) for c in names]).first()
    bounds = [np.array(cuts[c] or [0.0], np.float32) for c in names]

    @F.pandas_udf("long")
    def key(*columns: pd.Series) -> pd.Series:
        cells = np.stack([np.searchsorted(b, c.to_numpy(), side="right") for b, c in zip(bounds, columns, strict=True)], axis=1)
        return pd.Series(hilbert(np.minimum(cells, (1 << bits) - 1), bits))

    return vectors.withColumn("key", key(*names))


def tail_cuts(total: int, length: int) -> list[int]:
    """Starts, in the stream, of the sequences after the last full one: powers of two, large ones first."""
    at, rest = total - total % length, total % length
    starts = []
    while rest:
        size = 1 << (rest.bit_length() - 1)
        starts.append(at)
        at, rest = at + size, rest - size
    return starts


def pack(docs: DataFrame, definition: str, vocabulary: int, length: int = LENGTH, end: int = END) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    vectors, _ = shared.stage(vectorise(docs, definition, vocabulary, end=end).withColumn("row", F.monotonically_increasing_id()), "pack-vectors")
    narrow = keyed(vectors.select("row", "doc_id", "n", *[f"c{i}" for i in range(DIMENSIONS)])).select("row", "doc_id", "n", "key")
    wide = shared.partitions(spark)
    ranged = narrow.repartitionByRange(wide, "key", "doc_id", "row").withColumn("range", F.spark_partition_id())
    ranged, _ = shared.stage(ranged, "pack-order")
    in_range = Window.partitionBy("range").orderBy("key", "doc_id", "row").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("range").agg(F.sum("n").alias("n")).orderBy("range").collect()  # a row for each range
    base, total = [], 0
    for s in sums:
        base.append((s["range"], total))
        total += s["n"]
    if not base:
        return spark.createDataFrame([], PIECES)
    bases = F.broadcast(spark.createDataFrame(base, "range int, base long"))  # as many rows as ranges
    placed = ranged.withColumn("before", F.coalesce(F.sum("n").over(in_range), F.lit(0))).join(bases, "range")
    placed = placed.select("row", (F.col("base") + F.col("before")).alias("at"))
    full, tail = total // length, np.array(tail_cuts(total, length), np.int64)
    width = np.dtype("<u2") if vocabulary <= 1 << 16 else np.dtype("<u4")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc_id, ids, at in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                x = np.frombuffer(ids.as_py(), width).astype("<u4")
                start = 0
                while start < len(x):
                    here = at + start
                    if here < full * length:
                        seq, offset = divmod(here, length)
                        room = length - offset
                    else:
                        k = int(np.searchsorted(tail, here, side="right")) - 1
                        seq, offset = full + k, here - int(tail[k])
                        room = (int(tail[k + 1]) if k + 1 < len(tail) else total) - here
                    take = min(room, len(x) - start)
                    out.append((doc_id, start, take, zlib.crc32(x[start : start + take].tobytes()), len(x), seq, offset))
                    start += take
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            columns = list(zip(*out, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    return vectors.select("row", "doc_id", "ids").join(placed, "row").select("doc_id", "ids", "at").mapInArrow(shared.tidied(cut), PIECES)


def read_definition(path: str) -> tuple[str, int]:
    """A tokenizer's definition and the size of its vocabulary."""
    from pathlib import Path

    text = Path(path).read_text(encoding="utf-8")
    known = json.loads(text)
    ids = [*known["model"]["vocab"].values(), *(t["id"] for t in known.get("added_tokens", []))]
    return text, max(ids) + 1
