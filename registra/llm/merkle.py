"""Merkle manifest of a dataset: one hash per row, a tree per source, a tree over the sources, and proofs of single rows.

Every three consecutive nodes of a level become the hash of their concatenated hashes, until one node is left. Nodes are cut
into aligned blocks of 3**LEVELS: a block's tree needs no node outside the block, so one row of a table is one block, and the
blocks' roots are the next table's nodes. A proof is a leaf's path inside its block followed by the path its block has in
the tables above.

The tree is persistent. `PersistentBlock` never changes a node: a tampered leaf makes a new version, which copies only the
leaf's ancestors inside the block and shares all others with the original; above the block the version goes on along the
block's path. Comparing its root with the original one verifies the leaf.

Defined cases: a null value is written as `-`, so it differs from an empty one; a null key or source sorts first; rows with
one key are in the order of their hashes, and repeated rows are leaves of their own; a null key is not tampered with; an
empty table gives an empty table; columns that are not named do not count.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from registra.operators.held import held

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
FAN = 3
#: Levels of a block: it has up to 3**6 = 729 nodes.
LEVELS = 6

_PATH = "array<struct<left:string,right:string>>"


def digest(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def leaf_hash(values: dict[str, Column]) -> Column:
    """Hash of a row's values, each with its length, in the order given."""
    written = []
    for value in values.values():
        text = value.cast("string")
        written.append(F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)))
    return F.sha2(F.concat(*written), 256)


class PersistentBlock:
    """A block's tree, whose versions share what a changed leaf does not reach."""

    def __init__(self, leaves: list[str], levels: int) -> None:
        self.nodes = [leaves]
        for _ in range(levels):
            below = self.nodes[-1]
            self.nodes.append([digest(*below[i : i + FAN]) for i in range(0, len(below), FAN)])

    def path(self, leaf: int) -> list[tuple[str, str]]:
        """What stands left and right of a leaf and its ancestors in their runs, joined."""
        out = []
        for below in self.nodes[:-1]:
            first = leaf - leaf % FAN
            out.append(("".join(below[first:leaf]), "".join(below[leaf + 1 : first + FAN])))
            leaf //= FAN
        return out

    def version(self, leaf: int, value: str) -> list[str]:
        """The copied nodes of a version with another leaf, from the leaf to the root; all others are the original's."""
        copied = [value]
        for left, right in self.path(leaf):
            copied.append(digest(left, copied[-1], right))
        return copied

    @property
    def root(self) -> str:
        return self.nodes[-1][0]


def _positions(rows: DataFrame, tree: Column, order: list[Column], name: str) -> DataFrame:
    """`rows` with `tree` and `position`, gapless from 0 in each tree. Sorted over all tasks, so a hot tree is in many."""
    sorted_rows = rows.withColumn("tree", tree).orderBy(F.col("tree").asc_nulls_first(), *order)
    placed = held(sorted_rows.withColumn("at", F.monotonically_increasing_id()), name)
    placed = placed.withColumn("part", F.shiftrightunsigned("at", 33))
    # One row for each task that a tree is in.
    stretch = placed.groupBy("tree", "part").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = held(stretch.select("tree", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift")), f"{name}_offsets")
    there = offsets.select(F.col("tree").alias("of"), F.col("part").alias("in"), "shift")
    joined = placed.join(there, (F.col("part") == F.col("in")) & F.col("tree").eqNullSafe(F.col("of")))
    return joined.withColumn("position", F.col("at") + F.col("shift")).drop("at", "part", "of", "in", "shift")


def _blocks(nodes: DataFrame, sizes: DataFrame, levels: int, name: str) -> DataFrame:
    """One row a block: `tree`, `block`, `levels` and its `nodes`, at most FAN**levels, in order."""
    width = FAN**levels
    needed = sum((F.col("size") > FAN**i).cast("int") for i in range(levels))
    fields = [c for c in nodes.columns if c not in ("tree", "position")]
    grouped = nodes.groupBy("tree", F.expr(f"position DIV {width}").alias("block")).agg(F.array_sort(F.collect_list(F.struct("position", *fields))).alias("nodes"))
    return held(grouped.join(sizes.select("tree", needed.alias("levels")), "tree").select("tree", "block", "levels", "nodes"), name)


def _hashes(block: dict) -> list[str]:
    return [node["leaf"] for node in block["nodes"]]


def _each(found: Iterator[pa.RecordBatch], rows: int = 16) -> Iterator[list[dict]]:
    """A few blocks at a time, as Python values."""
    for batch in found:
        for low in range(0, batch.num_rows, rows):
            yield batch.slice(low, rows).to_pylist()


def _roots(blocks: DataFrame, name: str) -> DataFrame:
    """The blocks' roots as nodes of the next table: `tree`, `position`, `leaf`."""

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _each(found):
            roots = [PersistentBlock(_hashes(b), b["levels"]).root for b in some]
            yield pa.RecordBatch.from_arrays(
                [pa.array([b["tree"] for b in some], pa.int64()), pa.array([b["block"] for b in some], pa.int64()), pa.array(roots, pa.string())],
                names=["tree", "position", "leaf"],
            )

    return held(blocks.mapInArrow(batches, "tree bigint, position bigint, leaf string"), name)


def _paths(blocks: DataFrame, above: DataFrame | None) -> DataFrame:
    """`tree`, `block` (a node's position) and `path` to the top for every node; `above` has the blocks' own paths."""

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _each(found):
            trees, places, paths = [], [], []
            for b in some:
                block = PersistentBlock(_hashes(b), b["levels"])
                for i, node in enumerate(b["nodes"]):
                    trees.append(b["tree"])
                    places.append(node["position"])
                    own = [{"left": left, "right": right} for left, right in block.path(i)]
                    paths.append(own + (b["path"] or []))
            kind = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
            yield pa.RecordBatch.from_arrays([pa.array(trees, pa.int64()), pa.array(places, pa.int64()), pa.array(paths, kind)], names=["tree", "block", "path"])

    with_path = blocks.withColumn("path", F.lit(None).cast(_PATH)) if above is None else blocks.join(above, ["tree", "block"])
    return held(with_path.mapInArrow(batches, f"tree bigint, block bigint, path {_PATH}"), "paths")


class Forest:
    """All trees over one table of nodes, in tables of blocks from the leaves up."""

    def __init__(self, nodes: DataFrame, sizes: DataFrame, levels: int, name: str) -> None:
        width = FAN**levels
        self.tables = [_blocks(nodes, sizes, levels, name)]
        most = sizes.agg(F.coalesce(F.max("size"), F.lit(0)).alias("n")).first()["n"]
        self.roots = _roots(self.tables[0], f"{name}_roots")
        while most > width:
            most = -(-most // width)
            sizes = sizes.withColumn("size", F.expr(f"(size + {width - 1}) DIV {width}"))
            self.tables.append(_blocks(self.roots, sizes, levels, name))
            self.roots = _roots(self.tables[-1], f"{name}_roots")

    def above(self, tops: DataFrame | None) -> DataFrame | None:
        """`tree`, `block` and `path` of the blocks at the bottom; `tops` has the paths of the trees' roots."""
        out = tops
        for blocks in reversed(self.tables[1:]):
            out = _paths(blocks, out)
        return out


def tampered_text(key: str = "doc_id", text: str = "text") -> Column:
    """The text without line ends where the key's CRC-32 is even."""
    even = F.crc32(F.col(key).cast("string").cast("binary")) % 2 == 0
    return F.when(even, F.replace(F.col(text), F.lit("\n"), F.lit(""))).otherwise(F.col(text))


def manifest(docs: DataFrame, tampered: Column, columns: tuple[str, ...] = COLUMNS, levels: int = LEVELS) -> DataFrame:
    """A row for every row of `docs`: its key, `leaf`, `subroot`, `root`, `proof_sha256`, `folded_root` and `verified`.

    The first column is the key and the second the source; `tampered` replaces the last one in the version that is verified.
    """
    key, source = columns[:2]
    values = {c: F.col(f"`{c}`") for c in columns}
    changed = leaf_hash({**values, columns[-1]: tampered})
    leaves = held(docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{source}`").cast("string").alias("source"), leaf_hash(values).alias("leaf"), changed.alias("changed")), "leaves")
    names = _positions(leaves.select("source").distinct(), F.lit(0).cast("long"), [F.col("source").asc_nulls_first()], "sources")
    names = held(names.select(F.col("source").alias("of"), F.col("position").alias("number")), "numbers")
    numbered = leaves.join(names, F.col("source").eqNullSafe(F.col("of"))).select("key", "leaf", "changed", "number")
    placed = _positions(numbered, F.col("number"), [F.col("key").asc_nulls_first(), F.col("leaf")], "rows").drop("number")
    sizes = held(placed.groupBy("tree").agg(F.count("*").alias("size")), "sizes")
    forest = Forest(placed.select("tree", "position", "leaf", "changed", "key"), sizes, levels, "blocks")
    # A tree's root is its only node; the roots are the leaves of one more tree.
    subroots = forest.roots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("position"), "leaf")
    count = subroots.count()
    one = docs.sparkSession.createDataFrame([(0, count)], "tree long, size long")
    top = Forest(subroots, one, levels, "tops")
    found = top.roots.select("leaf").first()
    root = found["leaf"] if found else ""
    tops = _paths(top.tables[0], top.above(None))
    bottom = forest.above(tops.select(F.col("block").alias("tree"), F.lit(0).cast("long").alias("block"), "path"))
    shown = forest.roots.select("tree", F.col("leaf").alias("subroot"))
    kind = leaves.schema["key"].dataType.simpleString()

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            key_type = batch.schema.field("nodes").type.value_type.field("key").type
            for some in _each(pa.Table.from_batches([batch]).to_batches(), 1):
                (b,) = some
                block, above = PersistentBlock(_hashes(b), b["levels"]), [(s["left"], s["right"]) for s in b["path"]]
                proofs, folded = [], []
                for i, node in enumerate(b["nodes"]):
                    proofs.append(digest(*[side for pair in (*block.path(i), *above) for side in pair]))
                    value = block.version(i, node["changed"])[-1]
                    for left, right in above:
                        value = digest(left, value, right)
                    folded.append(value)
                n = len(folded)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([x["key"] for x in b["nodes"]], key_type),
                        pa.array(_hashes(b)),
                        pa.array([b["subroot"]] * n),
                        pa.array([root] * n),
                        pa.array(proofs),
                        pa.array(folded),
                        pa.array([f == root for f in folded]),
                    ],
                    names=["key", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"],
                )

    proven = forest.tables[0].join(bottom, ["tree", "block"]).join(shown, "tree")
    schema = f"key {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return proven.mapInArrow(batches, schema).withColumnRenamed("key", key)
