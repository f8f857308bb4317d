"""Prefix trie of conversations: every distinct sequence of first turns is a node, with what a shared cache of it would save.

A turn's id is the 16-byte digest of its role and text, big-endian as it stands; a conversation is the string of its turns' ids.
Equal conversations become one sequence. The sequences are sorted over all tasks and cut into parts; each part is an adaptive
radix tree (`radix_tree`), and a node of the trie is emitted at every byte depth that is a whole number of turns, inside
compressed paths too. A node that a neighbouring part also has is a prefix of both sequences at the border, so its depth is at
most what they have in common. These open nodes leave their part with partial sums and are summed over the parts, each also into
its open ancestors; all others are final where they are made. A part has a bounded number of turns, or one sequence.

Member lists are hashed as a stream of stretches of at most `STRETCH` conv_ids, however many conversations are equal.

Defined cases: null roles and texts are empty; turns with one number are in the order of their digests, null numbers first;
repeated rows are turns of their own; rows without conv_id belong to no conversation; a conversation's ids, not its texts, have to
fit into one row; an empty table gives an empty table; only the columns named are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from registra.llm.radix_tree import Node, RadixTree
from registra.operators.held import held

#: Bytes of a turn's id.
WIDTH = 16
#: Every so many conv_ids share a stem, whose first turns the others may begin with.
FAMILY = 20
MOST_SHARED = 4
#: conv_ids (by value) that one stretch of a member list spans.
STRETCH = 1 << 16
#: Turns of one part, about.
PART_TURNS = 100_000

_WORD = r"[^\x20\x09-\x0D]+"
_NO_MEMBERS = sha256(b"").hexdigest()
_COUNTS = ("n_convs", "n_children", "n_leaves", "saved_tokens")


def turns(rows: DataFrame) -> DataFrame:
    """`conv_id` and its `turns` in order, each with its id and its number of words."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    written = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    turn = F.struct(
        F.col("turn").isNotNull().alias("numbered"),
        F.col("turn"),
        F.unhex(F.md5(written)).alias("id"),
        F.regexp_count(text, F.lit(_WORD)).alias("words"),
    )
    listed = rows.filter("conv_id IS NOT NULL").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return listed.select("conv_id", F.transform("turns", lambda t: F.struct(t["id"].alias("id"), t["words"].alias("words"))).alias("turns"))


def rebuilt(listed: DataFrame) -> DataFrame:
    """Every conversation with the first turns of its family's stem in place of its own."""
    shared = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST_SHARED).cast("int")
    stems = listed.filter(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("stem"), F.slice("turns", 1, MOST_SHARED - 1).alias("first"))
    own = listed.withColumn("stem", F.col("conv_id") - F.col("conv_id") % FAMILY).withColumn("shared", shared)
    none = F.slice("turns", 1, 0)
    first = F.slice(F.coalesce("first", none), F.lit(1), F.col("shared"))
    rest = F.slice("turns", F.col("shared") + 1, F.size("turns"))
    return own.join(stems, "stem", "left").select("conv_id", F.concat(first, rest).alias("turns"))


def _hash_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows arrive sorted by sequence and stretch; one row a sequence leaves."""
    current, known, digest, n = None, None, None, 0
    names = ["key", "words", "conv_id", "n", "ends"]

    def done(words_type: pa.DataType) -> pa.RecordBatch:
        words, first = known
        columns = [pa.array([current], pa.binary()), pa.array([words], words_type), pa.array([first], pa.int64()), pa.array([n], pa.int64()), pa.array([digest.hexdigest()])]
        return pa.RecordBatch.from_arrays(columns, names=names)

    for batch in batches:
        kind, out = batch.schema.field("words").type, []
        for row in batch.to_pylist():
            if row["key"] != current:
                if current is not None:
                    out.append(done(kind))
                current, known, digest, n = row["key"], (row["words"], row["first"]), sha256(), 0
            digest.update(("," if n else "").encode() + row["members"].encode())
            n += row["n"]
        if out:
            yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]
    if current is not None:
        yield done(kind)


def sequences(conversations: DataFrame) -> DataFrame:
    """One row a distinct sequence: `key`, the `words` of its turns, its least conv_id, their number and the hash of all."""
    keyed = conversations.select(
        "conv_id",
        F.concat(F.unhex(F.lit("")), F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["id"])), ""))).alias("key"),
        F.transform("turns", lambda t: t["words"]).alias("words"),
    )
    members = F.array_sort(F.collect_list("conv_id"))
    stretches = keyed.groupBy("key", F.floor(F.col("conv_id") / STRETCH).alias("stretch")).agg(
        F.first("words").alias("words"),
        F.min("conv_id").alias("first"),
        F.count("*").alias("n"),
        F.array_join(members.cast("array<string>"), ",").alias("members"),
    )
    schema = "key binary, words array<int>, conv_id bigint, n bigint, ends string"
    columns = stretches.select("key", "stretch", "words", "first", "n", "members")
    return columns.repartition("key").sortWithinPartitions("key", "stretch").mapInArrow(_hash_members, schema)


class Part:
    """The nodes of one part's sorted sequences. `left` and `right`: turns in common with the neighbouring parts."""

    def __init__(self, rows: list[dict], left: int, right: int) -> None:
        self.rows, self.left, self.right = rows, left, right
        self.out: list[list] = []
        self.tree = RadixTree()
        for i, row in enumerate(rows):
            self.tree.insert(row["key"], i)

    def nodes(self) -> list[list]:
        """(open, prefix, conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, words, ends) of each node.

        `prefix` is an open node's own, else that of an open parent.
        """
        # Each entry: node, byte depth of its parent, children still to visit, and what the visited ones add up to.
        stack = [self._entry(self.tree.root, -1)]
        while True:
            node, above, end, waiting, sums = stack[-1]
            child = next(waiting, None)
            if child is not None:
                stack.append(self._entry(child[1], end))
                continue
            stack.pop()
            found = self._emit(node, above, end, sums)
            if not stack:
                return self.out
            self._add(stack[-1][4], found)

    def _entry(self, node: Node, above: int) -> tuple:
        return node, above, above + 1 + len(node.prefix), node.items(), {"n": 0, "conv": None, "low": None, "high": None, "kids": [], "count": 0, "leaves": 0, "saved": 0}

    @staticmethod
    def _add(sums: dict, found: dict) -> None:
        sums["conv"] = found["conv"] if sums["conv"] is None else min(sums["conv"], found["conv"])
        sums["low"] = found["low"] if sums["low"] is None else min(sums["low"], found["low"])
        sums["high"] = found["high"] if sums["high"] is None else max(sums["high"], found["high"])
        for name in ("n", "count", "leaves", "saved"):
            sums[name] += found[name]
        sums["kids"].extend(found["kids"])

    def _emit(self, node: Node, above: int, end: int, sums: dict) -> dict:
        """Nodes at whole turns between the parent's last byte and this node's, deepest first."""
        if node.value is not None:
            row = self.rows[node.value]
            self._add(sums, {"n": row["n"], "conv": row["conv_id"], "low": node.value, "high": node.value, "kids": [], "count": 0, "leaves": 0, "saved": 0})
        if sums["low"] is None:
            return sums
        any_row = self.rows[sums["low"]]
        for depth in range(end // WIDTH, max(above, -1) // WIDTH, -1):
            words = any_row["words"][depth - 1] if depth else 0
            ends = self.rows[node.value]["ends"] if node.value is not None and depth * WIDTH == end else None
            is_open = depth == 0 or (depth <= self.left and sums["low"] == 0) or (depth <= self.right and sums["high"] == len(self.rows) - 1)
            prefix = any_row["key"][: depth * WIDTH] if is_open else None
            for kid in sums["kids"]:
                kid[1 if is_open else 4] = prefix if is_open else sums["conv"]
            if is_open:
                row = [True, prefix, sums["conv"], depth, None, sums["n"], sums["count"], sums["leaves"], sums["saved"], words, ends]
                sums |= {"kids": [], "count": 0, "leaves": 0, "saved": 0}
            else:
                saved = sums["saved"] + (sums["n"] - 1) * words
                leaves = sums["leaves"] if sums["count"] else 1
                row = [False, None, sums["conv"], depth, None, sums["n"], sums["count"], leaves, saved, words, ends or _NO_MEMBERS]
                sums |= {"kids": [row], "count": 1, "leaves": leaves, "saved": saved}
            self.out.append(row)
        return sums


_NODES = "open boolean, prefix binary, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, words bigint, ends_sha256 string"


def _part_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows arrive sorted by part and key."""
    kinds = [pa.bool_(), pa.binary(), *[pa.int64()] * 8, pa.string()]
    names = [field.split()[0] for field in _NODES.split(", ")]
    current, rows = None, []

    def done() -> Iterator[pa.RecordBatch]:
        found = Part(rows, rows[0]["left"], rows[0]["right"]).nodes()
        for low in range(0, len(found), 10_000):
            columns = zip(*found[low : low + 10_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    for batch in batches:
        for row in batch.to_pylist():
            if row["part"] != current:
                if rows:
                    yield from done()
                current, rows = row["part"], []
            rows.append(row)
    if rows:
        yield from done()


def _turns_in_common(a: Column, b: Column) -> Column:
    """Whole turns that two sequences begin with."""
    most = F.least(F.octet_length(a), F.octet_length(b)) / WIDTH

    def differs(i: Column) -> Column:
        return F.substring(a, i * WIDTH + 1, F.lit(WIDTH)) != F.substring(b, i * WIDTH + 1, F.lit(WIDTH))

    places = F.transform(F.sequence(F.lit(0), F.greatest(most.cast("int") - 1, F.lit(0))), differs)
    first = F.array_position(places, True)
    return F.when(most < 1, F.lit(0)).when(first > 0, first - 1).otherwise(most.cast("int")).cast("int")


def _borders(parts: DataFrame) -> DataFrame:
    """`part`, `left` and `right`: turns that its outermost sequences have in common with the neighbouring parts'. One row a part is sorted in one task."""
    ends = parts.groupBy("part").agg(F.min("key").alias("first"), F.max("key").alias("last"))
    order = Window.partitionBy(F.lit(0)).orderBy("part")
    near = ends.select("part", "first", "last", F.lag("last").over(order).alias("before"), F.lead("first").over(order).alias("after"))
    left, right = _turns_in_common(F.col("before"), F.col("first")), _turns_in_common(F.col("last"), F.col("after"))
    return near.select("part", F.coalesce(left, F.lit(0)).alias("left"), F.coalesce(right, F.lit(0)).alias("right"))


def _closed(partial: DataFrame) -> DataFrame:
    """Open nodes with their sums over all parts and over the open nodes below them."""
    sums = [F.sum(c).alias(c) for c in _COUNTS]
    nodes = held(partial.groupBy("prefix", "depth", "words").agg(F.min("conv_id").alias("conv_id"), *sums, F.max("ends_sha256").alias("ends_sha256")), "open")
    parent = F.substring("prefix", F.lit(1), ((F.col("depth") - 1) * WIDTH).cast("int"))
    kids = nodes.filter("depth > 0").groupBy(parent.alias("prefix")).agg(F.count("*").alias("open_children"))
    counted = nodes.join(kids, "prefix", "left").withColumn("n_children", F.col("n_children") + F.coalesce("open_children", F.lit(0)))
    own_leaves = F.col("n_leaves") + F.when(F.col("n_children") == 0, 1).otherwise(0)
    own_saved = F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("words")
    counted = held(counted.withColumn("n_leaves", own_leaves).withColumn("saved_tokens", own_saved).drop("open_children"), "counted")
    upwards = counted.select(F.explode(F.sequence(F.lit(0).cast("long"), "depth")).alias("up"), "prefix", "n_leaves", "saved_tokens")
    summed = upwards.groupBy(F.substring("prefix", F.lit(1), (F.col("up") * WIDTH).cast("int")).alias("prefix")).agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    whole = counted.drop("n_leaves", "saved_tokens").join(summed, "prefix")
    above = whole.select(F.col("prefix").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    own = F.when(F.col("depth") > 0, parent)
    closed = whole.withColumn("parent", own).join(above, "parent", "left")
    return held(closed.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_NO_MEMBERS))).drop("parent"), "closed")


def trie(rows: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """A row for every node of the trie over the rebuilt conversations of `rows` (`conv_id`, `turn`, `role`, `text`)."""
    found = held(sequences(rebuilt(held(turns(rows), "turns"))), "sequences")
    size = found.agg(F.coalesce(F.sum(F.size("words") + 1), F.lit(0)).alias("n")).first()["n"]
    parts = held(found.repartitionByRange(-(-size // part_turns) or 1, "key").withColumn("part", F.spark_partition_id()), "parts")
    placed = parts.join(_borders(parts), "part").select("part", "key", "words", "conv_id", "n", "ends", "left", "right")
    nodes = held(placed.repartition("part").sortWithinPartitions("part", "key").mapInArrow(_part_nodes, _NODES), "nodes")
    closed = _closed(nodes.filter("open"))
    out = ("conv_id", "depth", "parent_conv_id", *_COUNTS, "ends_sha256")
    inside = nodes.filter("NOT open AND prefix IS NULL").select(*out)
    # Children of open nodes learn their parent's least conv_id.
    above = closed.select("prefix", F.col("conv_id").alias("above"))
    below = nodes.filter("NOT open AND prefix IS NOT NULL").join(above, "prefix").withColumn("parent_conv_id", F.col("above"))
    return inside.unionByName(below.select(*out)).unionByName(closed.select(*out))
