"""Byte-level BPE encoding and decoding with a given rank table.

Texts are cut by the tokenizer's pattern.  Spark higher-order functions fold the ranked
merges over arrays of byte tokens of distinct words: a word's state is one array whose elements hold the
rank of a token's pair with the next one, its place and the token, so that the least element
is the leftmost pair of least rank; each step merges it.  Ranks come from a literal map: a table
by rows of left tokens, packed into each other, in which a lookup is two array accesses.

1. ``_cut``: a task cuts its texts and keeps a running dictionary of the words it has met.  It
   passes on rows of at most about ``ROW_WORDS`` new words, in their first state, with the documents that
   need them, as indexes into the dictionary.
2. The new words of every row are folded.
3. ``_documents``: the next step of the same task keeps the dictionary's tokens, puts each document's
   tokens together and decodes them by concatenating the binary pieces.

Nothing is shuffled, broadcast or collected, and a word is folded once in a task.  A dictionary is
begun anew beyond ``DICTIONARY`` words, so that a task's memory is bounded but for a single text's own size.

A fold costs the square of a word's length.  Words of over ``LONG_WORD`` bytes (the cut
leaves only unbroken runs of that length) are merged with a heap instead, by the same ranks.

Edge cases: null text counts as empty and has no tokens; bytes that are no valid text can't
occur in a string column; repeated rows give repeated rows; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rostrum.llm import shared

#: New words in a row, words in a task's dictionary, and bytes from which a word is merged with a heap.
ROW_WORDS, DICTIONARY, LONG_WORD = 20_000, 500_000, 4_096
#: Characters of text in a row.
ROW_CHARS = 2_000_000
#: An element of a state: the pair's rank from bit 30 on, the token's place from bit 16 on, and the token.
TOKEN_BITS, PLACE_BITS, RANK_BITS = 16, 14, 17
#: From this number on, an element's pair isn't in the table.
NONE = 1 << (TOKEN_BITS + PLACE_BITS + RANK_BITS)

_ROW = "fresh boolean, words array<array<bigint>>, long array<array<int>>, docs array<struct<doc_id:bigint,used:binary>>"


@dataclass(frozen=True)
class Ranks:
    """A rank table: ``pieces[i]`` are the bytes of token i."""

    pieces: tuple[bytes, ...]
    pattern: str

    @classmethod
    def read(cls, path: str, pattern: str | None = None) -> Ranks:
        """From a file with lines of a piece in base64 and its rank, 0 upwards."""
        if pattern is None:
            from public_tokenizers import PATTERN as pattern  # noqa: N811
        with open(path, "rb") as lines:
            found = {int(rank): base64.b64decode(piece) for piece, rank in map(bytes.split, lines)}
        return cls(tuple(found[i] for i in range(len(found))), pattern)

    @cached_property
    def rank(self) -> dict[bytes, int]:
        return {p: i for i, p in enumerate(self.pieces)}

    @cached_property
    def one(self) -> np.ndarray:
        """The token of each byte."""
        return np.array([self.rank[bytes([i])] for i in range(256)], dtype=np.int64)

    @cached_property
    def pairs(self) -> dict[tuple[int, int], int]:
        """For each pair of tokens that together are a token: that token."""
        rank, out = self.rank, {}
        for piece, i in rank.items():
            for cut in range(1, len(piece)):
                a, b = rank.get(piece[:cut]), rank.get(piece[cut:])
                if a is not None and b is not None:
                    out[a, b] = i
        return out

    def merge(self, ids: list[int]) -> list[int]:
        """Ranked merges of one word with a heap and linked neighbours."""
        n, pairs = len(ids), self.pairs
        ids, ahead, behind = list(ids), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(ids, ids[1:], strict=False)) if (r := pairs.get((a, b))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = ahead[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue  # one of the two has been merged since
            ids[i], ids[j] = r, -1
            ahead[i] = ahead[j]
            if ahead[i] < n:
                behind[ahead[i]] = i
            for x, y in ((behind[i], i), (i, ahead[i])):
                if x >= 0 and y < n and (s := pairs.get((ids[x], ids[y]))) is not None:
                    heapq.heappush(heap, (s, x, ids[x], ids[y]))
        return [t for t in ids if t >= 0]


@dataclass(frozen=True)
class PairMap:
    """The literal rank map: from pairs of tokens to tokens.

    The row of a left token begins at ``rows[left]`` of ``slots``; the right token's slot in it holds, for a pair
    that is in the map, the left token and the pair's token.  Rows lie in each other's gaps.  Token ``edge``, one
    more than there are, has no pairs.
    """

    rows: np.ndarray
    slots: np.ndarray

    @classmethod
    def of(cls, ranks: Ranks) -> PairMap:
        n = len(ranks.pieces)
        if n >= 1 << TOKEN_BITS:
            raise ValueError(f"more than {(1 << TOKEN_BITS) - 1} tokens")
        keys = np.array([(a, b, t) for (a, b), t in ranks.pairs.items()], np.int64).reshape(-1, 3)
        keys = keys[np.lexsort((keys[:, 1], keys[:, 0]))]
        starts = np.flatnonzero(np.r_[True, np.diff(keys[:, 0]) != 0]) if len(keys) else []
        own = np.split(keys, starts[1:]) if len(keys) else []
        free, rows = np.ones(len(keys) * 4 + 8 * (n + 4096), bool), np.zeros(n + 1, np.int64)
        slots = np.full(len(free), ((1 << TOKEN_BITS) - 1) << RANK_BITS, np.int64)
        window = 4096
        for row in sorted(own, key=len, reverse=True):  # the fullest rows first, each at the first place that fits
            right, at = row[:, 1], 0
            while True:
                fits = free[right[0] + at : right[0] + at + window].copy()
                for b in right[1:]:
                    fits &= free[b + at : b + at + window]
                    if not fits.any():
                        break
                if fits.any():
                    at += int(fits.argmax())
                    break
                at += window
                if at + window + n >= len(free):
                    raise ValueError("the table is too small")
            free[right + at] = False
            slots[right + at] = row[:, 0] << RANK_BITS | row[:, 2]
            rows[row[0, 0]] = at
        end = int(np.flatnonzero(~free).max(initial=-1)) + 1
        rows[n] = end  # the edge's row is behind all others
        return cls(rows, slots[: end + n + 1])

    @property
    def edge(self) -> int:
        return len(self.rows) - 1

    def of_bytes(self, tokens: np.ndarray) -> np.ndarray:
        """Ranks of pairs of neighbours, as ``rank`` gives them; 0 behind the last."""
        if not len(tokens):
            return np.zeros(0, np.int64)
        return np.append(self.slots[self.rows[tokens[:-1]] + tokens[1:]] ^ tokens[:-1] << RANK_BITS, 0)

    def literal(self) -> Callable[[Column, Column], Column]:
        """``rank(left, right)``: the token that a pair merges to, or a number of more than RANK_BITS bits."""
        of = lambda x: F.from_json(F.lit(json.dumps(x.tolist(), separators=(",", ":"))), "array<bigint>")  # noqa: E731  parsed once, by constant folding
        rows, slots = of(self.rows), of(self.slots)
        # the left token cancels out where it is the slot's owner
        return lambda a, b: F.get(slots, (F.get(rows, a.cast("int")) + b).cast("int")).bitwiseXOR(F.shiftleft(a, RANK_BITS))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fold(state: Column, rank: Callable[[Column, Column], Column]) -> Column:
    """The state of a word after all merges; edges stand before its first and behind its last token."""
    token, low = F.lit((1 << TOKEN_BITS) - 1), F.lit((1 << TOKEN_BITS + PLACE_BITS) - 1)
    place, up = F.lit(((1 << PLACE_BITS) - 1) << TOKEN_BITS), TOKEN_BITS + PLACE_BITS
    n = F.size(state)

    def merge(s: Column, least: Column, p: Column) -> Column:
        """With the tokens at p and p + 1, counted from 1, as one token."""
        before, own = F.get(s, p - 2), F.shiftright(least, up)
        left = F.shiftleft(rank(before.bitwiseAND(token), own), up) + before.bitwiseAND(low)
        merged = F.shiftleft(rank(own, F.get(s, p + 1).bitwiseAND(token)), up) + least.bitwiseAND(place) + own
        return F.concat(F.slice(s, F.lit(1), p - 2), F.array(left, merged), F.slice(s, p + 2, n))

    def step(s: Column, _: Column) -> Column:
        def of(least: Column) -> Column:
            merged = _let(F.array_position(s, least).cast("int"), lambda p: merge(s, least, p))
            return F.when(least < NONE, merged).otherwise(s)

        return _let(F.array_min(s), of)

    # n - 3 merges at most: two edges, and a token is left
    return F.when(n > 3, F.aggregate(F.sequence(F.lit(1), n - 3), state, step)).otherwise(state)


def tokens_of(states: Column) -> Column:
    """The tokens of folded words, without edges."""
    return F.transform(states, lambda s: F.transform(F.slice(s, F.lit(2), F.size(s) - 2), lambda x: x.bitwiseAND(F.lit((1 << TOKEN_BITS) - 1)).cast("int")))


def states_of(words: list[bytes], one: np.ndarray, table: PairMap) -> pa.ListArray:
    """The first states of words: an edge, the byte tokens with their pairs' ranks, an edge."""
    size = np.array([len(w) for w in words], np.int64)
    start = np.cumsum(size) - size
    flat = one[np.frombuffer(b"".join(words), np.uint8)]
    nothing = (1 << RANK_BITS + TOKEN_BITS) - 1  # the greatest rank
    ranks = table.of_bytes(flat)
    ranks[(start + size - 1)[size > 0]] = nothing  # a word's last token has no pair
    place = np.arange(len(flat)) - np.repeat(start, size) + 1
    out = np.full(len(flat) + 2 * len(words), nothing << TOKEN_BITS + PLACE_BITS | table.edge, np.int64)
    inner = np.arange(len(flat)) + 2 * np.repeat(np.arange(len(words)), size) + 1
    out[inner] = ranks << TOKEN_BITS + PLACE_BITS | place << TOKEN_BITS | flat
    offsets = np.zeros(len(words) + 1, np.int32)
    np.cumsum(size + 2, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(out))


class Cutter:
    """Cuts texts by the pattern.  Texts of Latin letters, which the standard library's engine cuts twice as fast, go there."""

    # The members below U+02B0 of the classes of letters, of numbers and of white space.
    LETTER, NUMBER, SPACE = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u02af", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be", r"\t-\r \x85\xa0"

    def __init__(self, pattern: str):
        import regex

        self.any = regex.compile(pattern).findall
        self.latin = re.compile("[\x00-\x1b\x20-\u02af]*").fullmatch
        own = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{self.SPACE}{self.LETTER}{self.NUMBER}]")
        for name, members in ((r"\p{L}", f"[{self.LETTER}]"), (r"\p{N}", f"[{self.NUMBER}]"), (r"\s", f"[{self.SPACE}]"), (r"\S", f"[^{self.SPACE}]")):
            own = own.replace(name, members)
        # a pattern with other classes than these is left to the general engine
        self.fast = re.compile(own).findall if "\\" not in own.replace(self.SPACE, "") else None

    def __call__(self, text: str) -> list[str]:
        return self.fast(text) if self.fast and self.latin(text) else self.any(text)


def _cut(ranks: Ranks, table: PairMap):
    """Arrow batches of documents -> rows of new words and of documents as places in the task's dictionary."""
    one = ranks.one

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = Cutter(ranks.pattern)
        words: dict[str, int] = {}
        fresh, sent, docs, held = True, 0, [], 0

        def row() -> pa.RecordBatch:
            nonlocal fresh, sent, held
            new = [w.encode() for w in islice(words, sent, None)]
            long = [i for i, w in enumerate(new) if len(w) > LONG_WORD]
            done = [[sent + i, *ranks.merge(one[np.frombuffer(new[i], np.uint8)].tolist())] for i in long]  # place, tokens
            for i in long:
                new[i] = b""
            each = [
                pa.array([fresh]),
                _one_list(states_of(new, one, table)),
                _one_list(pa.array(done, pa.list_(pa.int32()))),
                _one_list(pa.StructArray.from_arrays([pa.array([d for d, _ in docs], pa.int64()), pa.array([u for _, u in docs], pa.binary())], ["doc_id", "used"])),
            ]
            fresh, sent, held = False, len(words), 0
            docs.clear()
            return pa.RecordBatch.from_arrays(each, names=["fresh", "words", "long", "docs"])

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = text.as_py() or ""
                own, find = [], words.setdefault
                for w in cut(text):
                    own.append(find(w, len(words)))
                docs.append((doc_id, np.array(own, np.int32).tobytes()))
                held += len(text)
                if held >= ROW_CHARS or len(words) - sent >= ROW_WORDS:
                    yield row()
                if len(words) > DICTIONARY:
                    if docs:
                        yield row()
                    words.clear()
                    fresh, sent = True, 0
        if docs:
            yield row()

    return run


def _one_list(values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _documents(ranks: Ranks):
    """Rows with folded words -> a row for each document: its tokens and the decoded bytes' digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, known, long = np.array(ranks.pieces, dtype=object), shared.Lists(), {}
        for b in batches:
            for row in range(b.num_rows):
                if b.column(0)[row].as_py():
                    known, long = shared.Lists(), {}
                words, done, docs = (b.column(i)[row].values for i in (1, 2, 3))
                known.add(words.flatten().to_numpy(zero_copy_only=False), words.value_lengths().to_numpy(zero_copy_only=False))
                long |= {x[0]: np.array(x[1:], np.int32) for x in done.to_pylist()}
                n, ids, decoded = [], [], []
                for used in docs.field("used"):
                    places = np.frombuffer(used.as_buffer(), np.int32)
                    if long and not long.keys().isdisjoint(places.tolist()):
                        got = np.concatenate([long[w] if w in long else known.of(np.array([w])) for w in places.tolist()])
                    else:
                        got = known.of(places)
                    n.append(len(got))
                    ids.append(got.astype("<u4").tobytes())
                    decoded.append(hashlib.sha256(b"".join(pieces[got].tolist())).hexdigest())
                out = [docs.field("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays(out, names=["doc_id", "n_tokens", "ids", "decoded_sha256"])

    return run


def encode(docs: DataFrame, ranks: Ranks) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit) and the digest of the decoded bytes."""
    table = PairMap.of(ranks)
    rank = table.literal()
    cut = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(shared.tidied(_cut(ranks, table)), _ROW)
    folded = cut.select("fresh", tokens_of(F.transform("words", lambda w: fold(w, rank))).alias("words"), "long", "docs")
    return folded.mapInArrow(shared.tidied(_documents(ranks)), "doc_id long, n_tokens long, ids binary, decoded_sha256 string")
