"""Near duplicates: a multi-index Hamming join of b-bit minhash signatures, confirmed on full sets.

A text's set is its distinct five-word shingles, as 64-bit hashes.  Its signature has
``CHUNKS`` chunks of ``WIDTH`` slots, each the low ``b`` = 16 bits of a minhash.  The
signature distance is the number of slots that differ.  By the pigeonhole principle, two
signatures at a distance of at most 2 * CHUNKS - 1 have a chunk with one error at most; for
each chunk the index enumerates the places of that error, so the pair shares a key.  Pairs
that share a key are candidates up to the distance ``FAR``.  A pair with similarity 0.75 shares
no key with a probability of 7.1e-9, and is farther apart than FAR with one of 1.1e-10.

What each stage does:

1. ``profiles``: sets, their digests and signatures, one pass over the texts.  Texts with
   equal sets are one class and go on as a number; numbers follow the order of the least ids.
2. ``candidate_groups``: keys that two classes or more share are found by a partially
   aggregated count; their members are compared in blocks inside a task, and only a spanning
   forest of each block's pairs within the distance leaves it: rows grow with the members,
   not with the pairs.  Components of those edges are the candidate groups.
3. ``links``: the sets of the groups' members are compared exactly, again in blocks with a
   spanning forest of the links.  Components of the links are the result.

A key or group with many members is dealt to pairs of blocks of bounded size, so that no
task holds all of it, and every pair of its members still meets in exactly one task.

Edge cases: null text counts as empty; a text without words is linked with nothing; with
fewer than five words the whole sequence is one shingle; repeated rows are members of one
class, and rows that repeat an id with another text are told apart by their texts; null ids come after all
others in choosing the least; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rostrum.llm import shared
from rostrum.llm.graph import components

CHUNKS, WIDTH = 14, 4
#: Slots that may differ in a candidate pair: the loss by this distance has to stay far below that by the keys.
FAR = 36
#: Similarity of linked texts, in per cent.
PERCENT = 75
#: Signatures, and shingles, in a block of a task.
BLOCK_SIGNATURES, BLOCK_SHINGLES = 2_000, 500_000
#: Members up to which their ids are broadcast to find their texts again (16 bytes each).
BROADCAST_ROWS = 1_000_000

_SLOTS = CHUNKS * WIDTH
_RNG = np.random.default_rng(20_240_601)
_XOR = _RNG.integers(1, 2**63, _SLOTS, dtype=np.uint64)
_MUL = _RNG.integers(1, 2**63, _SLOTS, dtype=np.uint64) | np.uint64(1)


def signature(hashes: np.ndarray) -> np.ndarray:
    """The slots of a set that is not empty."""
    least = np.full(_SLOTS, np.uint64(2**64 - 1))
    with np.errstate(over="ignore"):
        for at in range(0, len(hashes), 4096):
            part = (hashes[at : at + 4096, None] ^ _XOR) * _MUL
            least = np.minimum(least, (part ^ (part >> np.uint64(29))).min(axis=0))
        return (shared.mix64(least) & np.uint64(0xFFFF)).astype(np.uint16)


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shingles = shared.Shingler()
    for b in batches:
        n, digest, sig = [], [], []
        for text in b.column(2):
            s = shingles(text.as_py())
            n.append(len(s))
            digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
            sig.append(signature(s).tobytes() if len(s) else None)
        columns = [b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "n_shingles", "set_id", "sig"])


def text_hash(text: Column) -> Column:
    """Tells apart rows that repeat an id with another text."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def profiles(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_shingles, set_id (digest of the set) and sig of every text; the last two null without words."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash(docs["text"]).alias("text_hash"), docs["text"].alias("text"))
    return rows.mapInArrow(shared.tidied(_profile), "doc_id long, text_hash long, n_shingles long, set_id binary, sig binary")


# --- blocks and spanning forests -----------------------------------------------------------


def blocked(rows: DataFrame, group: str, blocks: str, by: str) -> DataFrame:
    """Each row once for every pair of blocks (i <= j) of its group that its own block is in.

    ``blocks`` is the number of blocks of the row's group; ``mine`` tells the row's block.
    """
    mine = F.pmod(F.xxhash64(by), F.col(blocks)).cast("int")
    rows = rows.withColumn("mine", mine)
    other = F.explode(F.sequence(F.lit(0), (F.col(blocks) - 1).cast("int")))
    rows = rows.select("*", other.alias("other"))
    return rows.withColumn("i", F.least("mine", "other")).withColumn("j", F.greatest("mine", "other")).drop("other")


Edges = tuple[np.ndarray, np.ndarray]


def _spanning(groups: Iterable[tuple[int, int, Iterator[tuple[int, np.ndarray]]]]) -> Edges:
    """A spanning forest of pairs: for each group its first row, its size, and pairs (x, ys) counted from that row."""
    left, right = [], []
    for start, size, pairs in groups:
        root = list(range(size))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for x, ys in pairs:
            for y in ys.tolist():
                p, q = find(x), find(y)
                if p != q:
                    root[max(p, q)] = min(p, q)
                    left.append(start + x)
                    right.append(start + y)
    return np.array(left, np.int64), np.array(right, np.int64)


def forest(rows: DataFrame, group: str, column: str, near: Callable[[pa.Array, np.ndarray, np.ndarray], Edges]) -> DataFrame:
    """Edges (a, b) of nodes: for each (group, i, j) a spanning forest of its near pairs.

    ``near`` gets the values of ``column`` for whole groups, and where each begins and ends, and returns the
    places of the ends of edges.  In a pair of two blocks all near pairs across and within count
    alike; the forest is the smaller for it.
    """
    keys = [group, "i", "j"]
    wide = shared.partitions(rows.sparkSession)
    dealt = rows.select(*keys, "node", column).repartition(wide, *keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def edges(t: pa.Table) -> tuple[pa.RecordBatch, pa.Table]:
            """Of all groups but the last, which may go on."""
            key = np.stack([t.column(k).to_numpy() for k in keys], axis=1)
            starts = np.r_[0, np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1]
            whole = t.slice(0, int(starts[-1]))
            ends = starts[1:]
            starts, many = starts[:-1], np.diff(starts) > 1
            x, y = near(whole.column(column).combine_chunks(), starts[many], ends[many]) if many.any() else (np.zeros(0, np.int64),) * 2
            node = whole.column("node").to_numpy()
            pairs = np.unique(np.stack([node[x], node[y]], axis=1), axis=0)  # pairs share several keys
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"]), t.slice(int(ends[-1]) if len(ends) else 0)

        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            if all(held[0].column(i)[0] == b.column(i)[b.num_rows - 1] for i in range(3)):
                continue  # still one group
            out, rest = edges(pa.Table.from_batches(held))
            held = rest.to_batches()
            yield out
        if held:
            last = pa.Table.from_batches(held)
            stop = pa.table({c: pa.nulls(1, last.schema.field(c).type) if c not in keys else pa.array([-1], last.schema.field(c).type) for c in last.column_names}, schema=last.schema)
            yield edges(pa.concat_tables([last, stop]))[0]

    return dealt.mapInArrow(shared.tidied(run), "a long, b long")


# --- candidates -------------------------------------------------------------------------------


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, node) for each chunk and place of its error."""
    with np.errstate(over="ignore"):
        for b in batches:
            if not b.num_rows:
                continue
            sig = _slots(b.column(1)).reshape(-1, CHUNKS, WIDTH).astype(np.uint64)
            for c in range(CHUNKS):
                for drop in range(WIDTH):
                    key = np.full(len(sig), np.uint64(c * WIDTH + drop))
                    for k in range(WIDTH):
                        if k != drop:
                            key = key << np.uint64(16) | sig[:, c, k]
                    key = shared.mix64(key).view(np.int64)  # one to one: three slots and the place fill 54 bits
                    yield pa.RecordBatch.from_arrays([pa.array(key), b.column(0)], names=["key", "node"])


def _slots(signatures: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(signatures.to_pylist()), np.uint16).reshape(-1, _SLOTS)


def _near_signatures(signatures: pa.Array, starts: np.ndarray, ends: np.ndarray) -> Edges:
    """Pairs within the distance: groups of two all at once, larger ones row by row."""
    sig = _slots(signatures)
    two = starts[ends - starts == 2]
    two = two[(sig[two] != sig[two + 1]).sum(axis=1) <= FAR]
    more = ends - starts > 2

    def pairs(start: int, end: int) -> Iterator[tuple[int, np.ndarray]]:
        for x in range(start, end - 1):
            yield x - start, np.flatnonzero((sig[x + 1 : end] != sig[x]).sum(axis=1) <= FAR) + x + 1 - start

    a, b = _spanning((s, e - s, pairs(s, e)) for s, e in zip(starts[more].tolist(), ends[more].tolist(), strict=True))
    return np.r_[two, a], np.r_[two + 1, b]


def candidate_groups(classes: DataFrame) -> DataFrame:
    """Rows (node, component) of the classes (node, sig) that some signature within the distance links."""
    keyed = classes.select("node", "sig").mapInArrow(shared.tidied(_keys), "key long, node long")
    shared_keys = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    members = keyed.join(shared_keys, "key")
    members = members.withColumn("blocks", F.ceil(F.col("n") / BLOCK_SIGNATURES)).join(classes, "node")
    return components(forest(blocked(members, "key", "blocks", "node"), "key", "sig", _near_signatures))


# --- exact links --------------------------------------------------------------------------------


def _near_sets(hashes: pa.Array, starts: np.ndarray, ends: np.ndarray) -> Edges:
    """Linked pairs of sets, by an inverted list of a group's shingles."""

    def pairs(start: int, end: int) -> Iterator[tuple[int, np.ndarray]]:
        sets = [np.frombuffer(s.as_buffer(), np.uint64) for s in hashes.slice(start, end - start)]
        sizes = np.array([len(s) for s in sets])
        owner = np.repeat(np.arange(len(sets)), sizes)
        flat = np.concatenate(sets)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        first = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]])
        last = np.r_[first[1:], len(flat)]
        heads = flat[first]
        for x, s in enumerate(sets[:-1]):
            at = np.searchsorted(heads, s)
            lo, hi = first[at], last[at]
            n = hi - lo
            hit = owner[np.repeat(hi - np.cumsum(n), n) + np.arange(n.sum())]
            both = np.bincount(hit[hit > x], minlength=len(sets))
            yield x, np.flatnonzero((100 * both >= PERCENT * (sizes + sizes[x] - both)) & (both > 0))

    return _spanning((s, e - s, pairs(s, e)) for s, e in zip(starts.tolist(), ends.tolist(), strict=True))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shingles = shared.Shingler()
    for b in batches:
        for at in range(0, b.num_rows, 500):
            part = b.slice(at, 500)
            hashes = pa.array([shingles(t.as_py()).tobytes() for t in part.column(3)], pa.binary())
            yield pa.RecordBatch.from_arrays([*part.columns[:3], hashes], names=["node", "component", "blocks", "hashes"])


def links(docs: DataFrame, groups: DataFrame, classes: DataFrame) -> DataFrame:
    """Edges (a, b) that span the linked members of each candidate group (node, component)."""
    members = groups.join(classes, "node").select("node", "component", "doc_id", "text_hash", "n_shingles")
    total = members.groupBy("component").agg(F.sum("n_shingles").alias("total"), F.count("*").alias("n"))
    rows = groups.count()
    members = shared.join_counted(members, total, ["component"], rows)
    members = members.withColumn("blocks", F.ceil(F.col("total") / BLOCK_SHINGLES)).select("node", "component", "blocks", "doc_id", "text_hash")
    members, _ = shared.stage(members, "near-members")
    # a row that repeats both has the same text: one of them has to do, and equal ones do no harm
    texts = docs.select(F.col("doc_id").cast("long").alias("__id"), text_hash(docs["text"]).alias("__hash"), docs["text"].alias("text"))
    same = F.col("__id").eqNullSafe(F.col("doc_id")) & (F.col("__hash") == F.col("text_hash"))
    found = texts.join(F.broadcast(members) if rows <= BROADCAST_ROWS else members, same)
    sets = found.select("node", "component", "blocks", "text").mapInArrow(shared.tidied(_sets), "node long, component long, blocks long, hashes binary")
    return forest(blocked(sets, "component", "blocks", "node"), "component", "hashes", _near_sets)


def near_groups(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept, and text_hash, which tells rows with one id apart."""
    spark = docs.sparkSession
    seen, _ = shared.stage(profiles(docs), "near-profiles")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("least")
    classes = seen.filter("set_id is not null").groupBy("set_id").agg(least, F.min("sig").alias("sig"), F.min("n_shingles").alias("n_shingles"), F.count("*").alias("n"))
    # nodes are numbers in the order of the classes' least ids, so that a component's least node has its least id
    order = ["least", "set_id"]
    classes = classes.repartitionByRange(shared.partitions(spark), *order).sortWithinPartitions(*order)
    classes = classes.select(F.monotonically_increasing_id().alias("node"), "set_id", "least.doc_id", "least.text_hash", "sig", "n_shingles", "n")
    classes, _ = shared.stage(classes, "near-classes")
    groups, groups_path = shared.stage(candidate_groups(classes.select("node", "sig")), "near-groups")
    found, found_path = shared.stage(components(links(docs, groups, classes)), "near-links")
    shared.drop(spark, groups_path)
    # the least member's id, and the number of rows of each set
    sizes = found.groupBy("component").agg(F.count("*").alias("n"))
    ids = classes.select(F.col("node").alias("component"), F.col("doc_id").alias("component_id")).join(sizes, "component")
    named = shared.join_counted(found, ids, ["component"], found.count()).select("node", "component_id")
    of_set = classes.select("node", "set_id", "doc_id", "n").join(named.withColumn("linked", F.lit(True)), "node", "left")
    of_set = of_set.select("set_id", F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.lit(True).alias("has_set"), "n")
    of_set, _ = shared.stage(of_set, "near-sets")
    shared.drop(spark, found_path)
    out = shared.join_counted(seen.drop("sig"), of_set, ["set_id"], seen.count())
    component = F.when(F.col("has_set"), F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "text_hash")


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents without near copies, with all columns of ``docs``, whatever their names: of each group the rows with the least id stay."""
    gone = near_groups(docs).filter("not kept").select("doc_id", "text_hash").distinct()
    return shared.without(docs, gone, {"doc_id": F.col("doc_id").cast("long"), "text_hash": text_hash(F.col("text"))})
