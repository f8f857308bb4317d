"""The trie against a plain count of all prefixes."""

import collections
import random
import re
import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from registra.llm import prefix_trie
from registra.llm.queries import JOBS
from registra.llm.radix_tree import Direct, Few, Indexed, RadixTree
from tests.llm.conftest import SF

SCHEMA = "conv_id long, turn long, role string, text string, stem string, words long, part long"


def plain(rows):
    """Rows of (conv_id, turn, role, text); equal turn numbers in no conversation."""
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    members = collections.defaultdict(list)
    for c in sorted(whole):
        for d in range(len(whole[c]) + 1):
            members[tuple(whole[c][:d])].append(c)
    out, saved, leaves, children = [], collections.Counter(), collections.Counter(), collections.Counter()
    for node, found in members.items():
        if node:
            children[node[:-1]] += 1
    for node, found in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            saved[node[:d]] += (len(found) - 1) * words
            leaves[node[:d]] += not children[node]
    for node, found in members.items():
        ends = ",".join(str(c) for c in found if tuple(whole[c]) == node)
        parent = members[node[:-1]][0] if node else None
        out.append((found[0], len(node), parent, len(found), children[node], leaves[node], saved[node], sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(df):
    columns = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


@pytest.mark.parametrize("width", [1, 2, 5])
def test_radix_tree(width):
    rng = random.Random(width)
    keys = {bytes(rng.choice((0, 7, rng.randrange(256))) for _ in range(width * rng.randrange(4))) for _ in range(3000)}
    tree = RadixTree()
    for i, key in enumerate(rng.sample(sorted(keys), len(keys))):
        tree.insert(key, i)
        assert tree.get(key) == i
    assert tree.get(b"\1" * 40) is None
    seen, waiting = [], [(tree.root, b"")]
    while waiting:
        node, before = waiting.pop()
        if node.value is not None:
            seen.append(before + node.prefix)
        bytes_, children = zip(*node.items()) if node.below else ((), ())
        assert list(bytes_) == sorted(bytes_)
        waiting.extend((child, before + node.prefix + bytes([b])) for b, child in zip(bytes_, children))
    assert sorted(seen) == sorted(keys)


def test_layouts_grow():
    layout, kinds = Few(), []
    for byte in random.Random(1).sample(range(256), 256):
        layout = layout.put(byte, byte)
        kinds.append(type(layout))
    assert kinds == [Few] * 16 + [Indexed] * 32 + [Direct] * 208 and layout.get(77) == 77


def conversations(rng, n):
    texts = ["hi", "hi there", "what is it", "", "so\tbe it\n", "a b c d e"]
    out = []
    for c in range(n):
        for t in range(rng.choice((0, 1, 2, 3, 5, 9))):
            out.append((c, None if t == 0 and c % 13 == 0 else t, rng.choice(("user", None)), rng.choice((*texts, None))))
    copies = rng.sample(range(1000, 1100), 30)
    return out + [(c, t, "user", f"copy {t}") for c in copies for t in range(30)]


@pytest.mark.parametrize("part_turns", [1, 7, 200, prefix_trie.PART_TURNS])
def test_part_sizes_do_not_show(spark, part_turns):
    rows = conversations(random.Random(4), 120)
    frame = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)
    assert found(prefix_trie.trie(frame, part_turns)) == plain(rows)


def test_edge_cases(spark):
    rows = [(None, 1, "user", "x"), (5, 1, "user", "only"), (-3, 2, None, None), (20, 1, "user", "w " * 100_000), (21, 1, "user", "w " * 100_000), (7, 1, "user", "twice"), (7, 1, "user", "twice")]
    frame = spark.createDataFrame([(*r, None, None, None) for r in rows], SCHEMA)
    assert found(prefix_trie.trie(frame, 3)) == plain([(c, t, r, x) for c, t, r, x in rows if c is None or c >= 0] + [rows[2]])
    assert prefix_trie.trie(frame.filter("false")).collect() == []


def test_long_conversations_and_many_copies(spark):
    long = [(c, t, "user", f"turn {t}" if c < 70 else f"{c} {t}") for c in (40, 60, 80) for t in range(600)]
    frame = spark.createDataFrame([(*r, None, None, None) for r in long], SCHEMA)
    copies = spark.range(200_000, 270_000, 20).select(F.col("id").alias("conv_id"), F.lit(1).cast("long").alias("turn"), F.lit("user").alias("role"), F.lit("same").alias("text"))
    got = found(prefix_trie.trie(frame.select("conv_id", "turn", "role", "text").unionByName(copies), 500))
    assert got == plain(long + [(c, 1, "user", "same") for c in range(200_000, 270_000, 20)])


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(JOBS["op13_prefix_trie"](spark, SF)) == plain(rows)
