"""SimHash near-duplicates: 64-bit fingerprints of 3-word shingles, searched with BK-trees of integer Hamming distances.

Distinct fingerprints are dealt to shards so that any two within the radius of 2 share one: of four 16-bit bands at most
two can differ, so each pair of bands that agrees is a shard. A task builds a shard's BK-tree, children keyed by their
distance to the parent, and a probe follows only edges within the radius. Trees stay in the task that owns the shard:
a broadcast would need a bound on the number of fingerprints. Exact copies share a fingerprint and enter once. A shard
of more than `SHARD_LIMIT` fingerprints is resolved without a tree: fingerprints within 2 bits share one that is at
most 1 bit from both, so each is joined under itself and its 32 one-bit neighbours, in groups of at most 33.

Defined cases: null, empty and blank texts have fingerprint zero and link like any other; a null doc_id takes part, and
`component_id` is null only where the whole component has none; repeated rows share a component; an empty table gives an
empty result; ties go to the smallest doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from registra.llm.components import components
from registra.llm.joins import join_by_size
from registra.llm.words import WHITE_SPACE, find_words, text_slices
from registra.operators.held import held

SHINGLE = 3
RADIUS = 2
SEED = 42
#: Fingerprints that one BK-tree holds at most; larger shards take the exact neighbour join instead.
SHARD_LIMIT = 2000
#: Shingles hashed at a time.
BLOCK = 1 << 15

_BANDS = [0xFFFF << (16 * i) for i in range(4)]
#: Every pair of bands, as a signed mask.
MASKS = [((a | b) ^ (1 << 63)) - (1 << 63) for i, a in enumerate(_BANDS) for b in _BANDS[i + 1 :]]


def fingerprint(spaced: bytes, start: np.ndarray, end: np.ndarray) -> int:
    """Fingerprint of the words `spaced[start[i]:end[i]]`, which have one space between neighbours."""
    if not len(start):
        return 0
    size = min(SHINGLE, len(start))
    shingles = len(start) - size + 1
    first, last = start[:shingles], end[size - 1 :]
    set_bits = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for low in range(0, shingles, BLOCK):
        places = zip(first[low : low + BLOCK].tolist(), last[low : low + BLOCK].tolist(), strict=True)
        hashes = np.array([digest(spaced[a:b], SEED) for a, b in places], dtype="<u8")
        set_bits += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_bits > shingles, bitorder="little").tobytes(), "little", signed=True)


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[int] = []
        for _, _, bounds, data in text_slices(batch.column(1)):
            words = find_words(bounds, data, WHITE_SPACE, lower=True)
            spaced, start, end = words.spaced()
            for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
                out.append(fingerprint(spaced, start[a:b], end[a:b]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.int64())], names=["doc_id", "bits"])


def fingerprints(docs: DataFrame, key: Column, text: Column) -> DataFrame:
    """`doc_id` (the key) and `bits` (the fingerprint as a signed long) of every row."""
    rows = docs.select(key.alias("doc_id"), text.cast("string").alias("text"))
    return rows.mapInArrow(_fingerprint_batches, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, bits long")


class BKTree:
    """A metric tree over integers: a node's children are keyed by their Hamming distance to it."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def within(self, value: int, radius: int) -> list[int]:
        """Indices of the values at most `radius` bits from `value`."""
        found, waiting = [], [0] if self.values else []
        while waiting:
            at = waiting.pop()
            distance = (self.values[at] ^ value).bit_count()
            if distance <= radius:
                found.append(at)
            waiting.extend(
                child for edge, child in self.children[at].items() if distance - radius <= edge <= distance + radius
            )
        return found

    def add(self, value: int) -> None:
        self.values.append(value)
        self.children.append({})
        at, new = 0, len(self.values) - 1
        while at != new:
            at = self.children[at].setdefault((self.values[at] ^ value).bit_count(), new)


def _shard_links(values: list[int], radius: int) -> Iterator[tuple[int, int]]:
    """Enough links for the components of a shard: each value to the roots of the groups it touches."""
    tree, parent = BKTree(), []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, value in enumerate(values):
        touched = {root(j) for j in tree.within(value, radius)}
        tree.add(value)
        parent.append(i)
        for j in touched:
            parent[j] = i
            yield value, values[j]


def _tree_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (mask, part, bits) arrive sorted by shard; a shard may go on in the next batch."""
    unsigned = (1 << 64) - 1
    held_key, held_bits = None, []

    def links(values: list[int]) -> pa.RecordBatch:
        found = list(_shard_links([v & unsigned for v in values], RADIUS))
        pairs = np.array(found, dtype=np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    for batch in batches:
        mask, part, bits = (batch.column(i).to_numpy() for i in range(3))
        if not len(bits):
            continue
        cuts = np.flatnonzero((mask[1:] != mask[:-1]) | (part[1:] != part[:-1])) + 1
        for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), len(bits)], strict=True):
            key = (int(mask[low]), int(part[low]))
            if key != held_key:
                if len(held_bits) > 1:
                    yield links(held_bits)
                held_key, held_bits = key, []
            held_bits.extend(bits[low:high].tolist())
    if len(held_bits) > 1:
        yield links(held_bits)


def links(distinct: DataFrame, limit: int = SHARD_LIMIT) -> DataFrame:
    """Links (`a`, `b`) between the distinct fingerprints in `bits` whose closure is that of all pairs within the radius."""
    shards = distinct.select(
        F.explode(
            F.array(*[F.struct(F.lit(i).alias("mask"), F.col("bits").bitwiseAND(F.lit(m)).alias("part")) for i, m in enumerate(MASKS)])
        ).alias("shard"),
        "bits",
    ).select("shard.mask", "shard.part", "bits")
    sizes = shards.groupBy("mask", "part").agg(F.count("*").alias("size")).filter("size > 1")
    shared = held(shards.join(sizes, ["mask", "part"]), "shards")
    small = shared.filter(F.col("size") <= limit).select("mask", "part", "bits")
    by_tree = (
        small.repartition("mask", "part").sortWithinPartitions("mask", "part", "bits").mapInArrow(_tree_batches, "a long, b long")
    )
    free = [[bit for bit in range(64) if not m >> bit & 1] for m in MASKS]
    near = F.array(
        *[
            F.array(F.col("bits"), *[F.col("bits").bitwiseXOR(F.lit(((1 << bit) ^ (1 << 63)) - (1 << 63))) for bit in bits])
            for bits in free
        ]
    )
    neighbours = shared.filter(F.col("size") > limit).select("mask", "bits", F.explode(F.get(near, F.col("mask"))).alias("near"))
    least = neighbours.groupBy("mask", "near").agg(F.min("bits").alias("b"), F.count("*").alias("n")).filter("n > 1")
    by_neighbour = neighbours.join(least, ["mask", "near"]).filter("bits <> b").select(F.col("bits").alias("a"), "b")
    return by_tree.unionByName(by_neighbour)


def near_duplicates(prints: DataFrame, limit: int = SHARD_LIMIT) -> DataFrame:
    """`bits` and `component_id` (the smallest doc_id reachable) for every distinct fingerprint of (`doc_id`, `bits`)."""
    nodes = held(prints.groupBy("bits").agg(F.min("doc_id").alias("doc_id")), "fingerprints")
    roots = components(links(nodes, limit), F.col("a"), F.col("b"))
    grouped = nodes.join(roots, nodes.bits == roots.node, "left").select(
        "bits", "doc_id", F.coalesce("root", "bits").alias("root")
    )
    least = grouped.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return grouped.join(least, "root").select("bits", "component_id")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = SHARD_LIMIT) -> DataFrame:
    """One row of `docs` for each group: the smallest key (null last), of rows with that key any one."""
    rows = held(docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("at")), "rows")
    own = F.col(f"row.`{key}`")
    order = F.struct(own.isNull().alias("missing"), own.alias("key"), F.col("at"))
    prints = held(fingerprints(rows, order, F.col(f"row.`{text}`")), "prints")
    stay = held(near_duplicates(prints, limit).select(F.col("component_id.at").alias("at")).distinct(), "stay")
    return join_by_size(rows, stay, ["at"], 16 * stay.count()).select("row.*")
