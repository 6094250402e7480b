"""A Merkle manifest of a dataset: leaves by row, trees by source, proofs for every row.

``H`` is the lower-case hex SHA-256 of its inputs, concatenated; digests go in as hex text.  A leaf is H of a
row's fields, each ``-`` if null and else its UTF-8 byte count, ``:`` and the value.  The leaves of a source stand
in the order of their ids; three consecutive nodes become their H, level by level, until one is left, the
subroot; subroots in the order of their sources (null first, then by bytes) become the root likewise.

Three is a power of the block size, so that trees can be cut in aligned buckets of ``3 ** LEVELS`` leaves:

1. Spark hashes the rows and puts them in order in ranges; prefix counts of the ranges give each leaf its place,
   and so a source with a third of all rows is split like any other.
2. Executors run a DuckDB engine over the Arrow batches of whole buckets: each level is a query with an
   ordered ``string_agg`` and ``sha256``.  A bucket's root leaves the task.
3. Spark combines the roots of the buckets, and the subroots, level by level, and hands the siblings down again: each
   node has three children at most, so that no key is hot.
4. Each bucket's outer proof meets its leaves in one shuffle; the same engine finds the inner siblings of each leaf
   and folds the leaf, or the one that is claimed in its place, up to the root.

A bucket is a few hundred kilobytes and a task holds ``ROWS`` rows and a bucket at a time, without spilling to a
local folder.  Tables under the shared folder cut the lineage; those that the result reads stay.

Edge cases: null ids come first in their source, and rows that repeat an id stand in the order of their
leaves; repeated rows are leaves like any others; a source of one row has its leaf as subroot; an empty table has the root H of
nothing and no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rostrum.llm import shared

#: Children of a node, levels of a bucket, and its leaves.
WAYS, LEVELS = 3, 7
BUCKET = WAYS**LEVELS
#: Leaves that a task holds at a time, besides a bucket; its engine's memory.
ROWS, MEMORY = 16_000, "512MB"
#: Hex digits of a digest.
DIGEST = 64
#: The root of no rows.
NOTHING = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


@dataclass(frozen=True)
class Manifest:
    """``leaves`` (tree, doc_id, leaf, claimed, pos, size), ``subroots`` (tree, subroot, size) and ``outer`` (tree, bucket, path) are staged."""

    leaves: DataFrame
    subroots: DataFrame
    outer: DataFrame
    root: str


def leaf(fields: dict[str, Column]) -> Column:
    """H of the fields."""
    each = []
    for f in fields.values():
        text = f.cast("string")
        each.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.encode(F.concat(*each), "UTF-8"), 256)


def levels_of(size: Column) -> Column:
    """Levels of a bucket: all of them, but for a source that ends in it before."""
    out = F.lit(0)
    for k in range(LEVELS):
        out = out + (size > WAYS**k).cast("int")
    return out


def _buckets(batches: Iterator[pa.RecordBatch], first: int) -> Iterator[pa.Table]:
    """Whole buckets, about ``ROWS`` rows at a time, numbered by a column b; each begins with the row whose ``slot`` is ``first``."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def numbered(table: pa.Table) -> pa.Table:
        return table.append_column("b", pa.array(np.cumsum(table["slot"].to_numpy() == first)))

    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < ROWS:
            continue
        table = pa.Table.from_batches(held)
        starts = np.flatnonzero(table["slot"].to_numpy() == first)
        end = int(starts[-1])
        if end:
            yield numbered(table.slice(0, end))
        held, rows = table.slice(end).combine_chunks().to_batches(), table.num_rows - end
    if rows:
        yield numbered(pa.Table.from_batches(held))


def _engine():
    import duckdb

    return duckdb.connect(":memory:", config={"threads": 1, "memory_limit": MEMORY, "temp_directory": ""})


#: All nodes of the buckets: level, bucket, place, levels above, digest.
_NODES = f"""
    CREATE OR REPLACE TEMP TABLE nodes AS WITH RECURSIVE up(level, b, i, above, h) AS (
        SELECT 0, b, slot::BIGINT, levels, leaf FROM leaves
        UNION ALL
        SELECT level + 1, b, i // {WAYS}, above - 1, sha256(string_agg(h, '' ORDER BY i)) FROM up WHERE above > 0 GROUP BY level, b, i // {WAYS}, above
    ) SELECT * FROM up
"""
#: Siblings of one run, with the node's own digest among them.
_RUNS = f"""
    CREATE OR REPLACE TEMP TABLE runs AS
    SELECT level, b, i // {WAYS} AS run, string_agg(h, '' ORDER BY i) AS s FROM nodes WHERE above > 0 GROUP BY level, b, i // {WAYS}
"""


def _step(level: int) -> str:
    """A level of every leaf's path: siblings go to its proof, and its fold becomes the node above."""
    place = f"((slot // {WAYS**level}) % {WAYS}) * {DIGEST}"
    left, right = f"substr(s, 1, {place})", f"substr(s, {place} + {DIGEST + 1})"
    return f"""
        CREATE OR REPLACE TEMP TABLE paths AS
        SELECT p.* EXCLUDE (proof, fold), CASE WHEN s IS NULL THEN proof ELSE proof || {left} || {right} END AS proof,
               CASE WHEN s IS NULL THEN fold ELSE sha256({left} || fold || {right}) END AS fold
        FROM paths p LEFT JOIN runs r ON r.level = {level} AND r.b = p.b AND r.run = p.slot // {WAYS ** (level + 1)}
    """


def _bucket_roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    con = _engine()
    for table in _buckets(batches, 0):
        con.register("leaves", table)
        con.execute(_NODES)
        found = con.sql("SELECT any_value(tree) AS tree, any_value(bucket) AS bucket, any_value(size) AS size, any_value(h) AS h FROM leaves JOIN nodes USING (b) WHERE slot = 0 AND above = 0 GROUP BY b")
        yield from found.to_arrow_table().cast(pa.schema([("tree", pa.string()), ("bucket", pa.int64()), ("size", pa.int64()), ("h", pa.string())])).to_batches()
        con.unregister("leaves")
    con.close()


def _fold_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each bucket the first row has its outer path, and the others its leaves."""
    con = _engine()
    schema = pa.schema([("tree", pa.string()), ("doc_id", pa.int64()), ("leaf", pa.string()), ("subroot", pa.string()), ("proof", pa.string()), ("folded_root", pa.string())])
    for table in _buckets(batches, -1):
        con.register("leaves_and_paths", table)
        con.execute("CREATE OR REPLACE TEMP TABLE outers AS SELECT b, path, leaf AS subroot FROM leaves_and_paths WHERE slot < 0")
        con.execute("CREATE OR REPLACE TEMP TABLE leaves AS SELECT * FROM leaves_and_paths WHERE slot >= 0")
        con.execute(_NODES)
        con.execute(_RUNS)
        con.execute("CREATE OR REPLACE TEMP TABLE paths AS SELECT b, slot::BIGINT AS slot, tree, doc_id, leaf, coalesce(claimed, leaf) AS fold, '' AS proof FROM leaves")
        for level in range(LEVELS):
            con.execute(_step(level))
        # outer siblings are left and right ones of each level, with a colon between
        above = f"sha256(split_part(x, ':', 1) || f || split_part(x, ':', 2))"
        found = con.sql(f"""
            SELECT tree, doc_id, leaf, subroot, proof || replace(array_to_string(path, ''), ':', '') AS proof,
                   list_reduce(path, lambda f, x: {above}, fold) AS folded_root FROM paths JOIN outers USING (b)
        """)
        yield from found.to_arrow_table().cast(schema).to_batches(ROWS)
        con.unregister("leaves_and_paths")
    con.close()


def climb(nodes: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """The runs (tree, j, above, run) of each level above ``nodes`` (tree, i, n, h), and the trees' tops (tree, h) by their level."""
    runs, tops = [], []
    while True:
        tops.append(nodes.filter("n = 1").select("tree", "h"))
        if not nodes.filter("n > 1").limit(1).count():
            return runs, tops
        ordered = F.transform(F.array_sort(F.collect_list(F.struct("i", "h"))), lambda x: x["h"])  # three at most
        up = nodes.filter("n > 1").groupBy("tree", F.floor(F.col("i") / WAYS).alias("j")).agg(F.array_join(ordered, "").alias("run"), F.ceil(F.first("n") / WAYS).alias("above"))
        up, _ = shared.stage(up, "merkle-level")
        runs.append(up)
        nodes = up.select("tree", F.col("j").alias("i"), F.col("above").alias("n"), F.sha2("run", 256).alias("h"))


def descend(runs: list[DataFrame], tops: list[DataFrame]) -> DataFrame:
    """tree, i, path for each node that ``climb`` began with; ``tops`` (tree, path) are what stands above the trees."""
    ended = [t.select("tree", F.lit(0).cast("long").alias("i"), "path") for t in tops]
    paths = ended[-1]
    for up, top in zip(reversed(runs), reversed(ended[:-1]), strict=True):
        own = up.join(paths.withColumnRenamed("i", "j"), ["tree", "j"])
        each = own.withColumn("k", F.explode(F.sequence(F.lit(0), (F.length("run") / DIGEST).cast("int") - 1)))
        left = F.substring(F.col("run"), F.lit(1), F.col("k") * DIGEST)
        right = F.substring(F.col("run"), (F.col("k") + 1) * DIGEST + 1, F.length("run"))
        path = F.concat(F.array(F.concat(left, F.lit(":"), right)), F.col("path"))
        paths = each.select("tree", (F.col("j") * WAYS + F.col("k")).alias("i"), path.alias("path")).unionByName(top)
    return paths


def build(docs: DataFrame, fields: tuple[str, ...] = FIELDS, by: str = "source", claimed: Column | None = None) -> Manifest:
    """The manifest of ``docs``: trees by the column ``by``, leaves in the order of doc_id.

    ``claimed`` is a leaf that ``proofs`` folds instead of the row's own, null for that one.
    """
    columns = {f: docs[f"`{f}`"] for f in fields}
    # names of trees sort as their sources: null first
    tree = F.when(docs[f"`{by}`"].isNull(), "").otherwise(F.concat(F.lit("="), docs[f"`{by}`"].cast("string")))
    own = leaf(columns)
    other = F.lit(None).cast("string") if claimed is None else F.when(claimed != own, claimed)
    rows = docs.select(tree.alias("tree"), docs["doc_id"].cast("long").alias("doc_id"), own.alias("leaf"), other.alias("claimed"))
    rows, rows_path = shared.stage(rows, "merkle-rows")
    rows, _ = shared.numbered(rows, ["tree"], ["doc_id", "leaf"], "merkle-leaves")
    shared.drop(docs.sparkSession, rows_path)
    place = F.floor(F.col("pos") / BUCKET)
    leaves = rows.select("*", place.alias("bucket"), (F.col("pos") % BUCKET).cast("int").alias("slot"), levels_of(F.col("size")).alias("levels"))
    dealt = leaves.select("tree", "bucket", "slot", "size", "levels", "leaf").repartition("tree", "bucket").sortWithinPartitions("tree", "bucket", "slot")
    found = dealt.mapInArrow(shared.tidied(_bucket_roots), "tree string, bucket long, size long, h string")
    roots, _ = shared.stage(found, "merkle-roots")
    runs, tops = climb(roots.select("tree", F.col("bucket").alias("i"), F.ceil(F.col("size") / BUCKET).alias("n"), "h"))
    subroots = tops[0]
    for t in tops[1:]:
        subroots = subroots.unionByName(t)
    sizes = roots.filter("bucket = 0").select("tree", F.col("size").alias("leaves"))
    subroots, _ = shared.numbered(subroots.join(sizes, "tree"), [], ["tree"], "merkle-subroots")
    outer_runs, outer_tops = climb(subroots.select(F.lit("").alias("tree"), F.col("pos").alias("i"), F.col("size").alias("n"), "h"))
    top = outer_tops[-1].first()
    above = descend(outer_runs, [t.select("tree", F.array().cast("array<string>").alias("path")) for t in outer_tops])
    above = subroots.select("tree", F.col("pos").alias("i")).join(above.drop("tree"), "i").select("tree", "path")
    paths = descend(runs, [t.join(above, "tree").select("tree", "path") for t in tops])
    outer, _ = shared.stage(paths.withColumnRenamed("i", "bucket").join(subroots.select("tree", F.col("h").alias("subroot")), "tree"), "merkle-outer")
    return Manifest(leaves, subroots.select("tree", F.col("h").alias("subroot"), F.col("leaves").alias("size")), outer, top["h"] if top else NOTHING)


def proofs(manifest: Manifest, whole: bool = True) -> DataFrame:
    """doc_id, leaf, subroot, root, proof, folded_root, verified for every leaf.

    ``proof`` has the siblings level by level, left to right, or only their SHA-256 unless ``whole``;
    ``folded_root`` comes from the claimed leaf, or its own, and the original siblings.
    """
    none = F.lit(None)
    heads = manifest.outer.select("tree", "bucket", F.lit(-1).alias("slot"), none.cast("int").alias("levels"), none.cast("long").alias("doc_id"), F.col("subroot").alias("leaf"), none.cast("string").alias("claimed"), "path")
    rows = manifest.leaves.select("tree", "bucket", "slot", "levels", "doc_id", "leaf", "claimed", none.cast("array<string>").alias("path"))
    dealt = heads.unionByName(rows).repartition("tree", "bucket").sortWithinPartitions("tree", "bucket", "slot")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _fold_leaves(batches)

    found = dealt.mapInArrow(shared.tidied(fold), "tree string, doc_id long, leaf string, subroot string, proof string, folded_root string")
    proof = F.col("proof") if whole else F.sha2("proof", 256)
    return found.select("doc_id", "leaf", "subroot", F.lit(manifest.root).alias("root"), proof.alias("proof"), "folded_root", (F.col("folded_root") == manifest.root).alias("verified"))
