"""Mixtures and shards."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from registra.llm import mixing, sharding


def water_filling(sizes, weights, most):
    """Clamp and share again until none is above its stop."""
    total, clamped = sum(sizes), set()
    while True:
        left = total - sum(most * sizes[i] for i in clamped)
        weight = sum(w for i, w in enumerate(weights) if i not in clamped)
        targets = [most * s if i in clamped else weights[i] * left / weight for i, s in enumerate(sizes)]
        above = {i for i, t in enumerate(targets) if t > most * sizes[i] + 1e-9} - clamped
        if not above:
            return targets
        clamped |= above


@pytest.mark.parametrize("seed", range(4))
def test_targets_are_the_fixed_point(spark, seed):
    rng = random.Random(seed)
    sizes = [rng.choice([0, 1, 5, 40, 1000, 10**9]) for _ in range(rng.randint(1, 12))]
    names = [f"s{i:02d}" for i in range(len(sizes) - 1)] + [None]
    frame = spark.createDataFrame(list(zip(names, sizes)), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(frame).collect()}
    expected = water_filling(sizes, [1 + i % 3 for i in range(len(sizes))], 3)
    for name, target in zip(names, expected):
        assert got[name] == pytest.approx(target, rel=1e-9, abs=1e-6)


def test_mixture_comes_near_its_targets(spark, documents):
    rows = mixing.measured(documents)
    plan = mixing.plan_mixture(rows.select("source", "size", "place"))
    mixed = mixing.mix(rows, plan).select("row.doc_id", "source", "size", "target", "times").collect()
    by_source = collections.defaultdict(list)
    for r in mixed:
        assert 0 <= r.times <= 3
        by_source[r.source].append(r)
    for found in by_source.values():
        assert abs(sum(r.size * r.times for r in found) - found[0].target) <= max(r.size for r in found) / 2 + 1e-6
    again = mixing.mix(rows, mixing.plan_mixture(rows.select("source", "size", "place"))).select("row.doc_id", "times").collect()
    assert sorted((r.doc_id, r.times) for r in mixed) == sorted((r.doc_id, r.times) for r in again)


def test_mixture_edge_cases(edge_docs, no_docs):
    rows = mixing.measured(edge_docs)
    mixed = mixing.mix(rows, mixing.plan_mixture(rows.select("source", "size", "place"))).select("row", F.col("times").alias("taken")).collect()
    assert len(mixed) == edge_docs.count() and all(r.taken <= 3 and r.row.row == "x" for r in mixed)
    rows = mixing.measured(no_docs)
    assert mixing.mix(rows, mixing.plan_mixture(rows.select("source", "size", "place"))).count() == 0


def assigned(docs, **options):
    return sharding.assign_shards(sharding.prepared(docs), **options).select("row.*", F.col("row.text").alias("t"), F.col("shard").alias("in_shard"), F.col("slot").alias("in_slot")).collect()


def well_formed(found, total, shards=8):
    counts = collections.Counter(r.in_shard for r in found)
    assert sorted(counts.get(s, 0) for s in range(shards)) == sorted((total - s + shards - 1) // shards for s in range(shards))
    for s in range(shards):
        assert sorted(r.in_slot for r in found if r.in_shard == s) == list(range(counts.get(s, 0)))


def test_groups_share_a_shard(spark):
    rng = random.Random(1)
    texts = [f"text {rng.randint(0, 150)}" for _ in range(400)] + [f"own {i}" for i in range(401)]
    found = assigned(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    well_formed(found, 801)
    shards = collections.defaultdict(set)
    for r in found:
        shards[r.t].add(r.in_shard)
    assert sum(len(s) > 1 for s in shards.values()) <= 2


def test_a_group_larger_than_a_shard_fills_whole_shards(spark):
    texts = ["hot" if i % 3 else f"own {i}" for i in range(900)]
    found = assigned(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    well_formed(found, 900)
    assert len({r.in_shard for r in found if r.t == "hot"}) <= 7
    well_formed(assigned(spark.createDataFrame([(i, "hot") for i in range(50)], "doc_id long, text string")), 50)


def test_shards_of_edge_cases(edge_docs, no_docs):
    found = assigned(edge_docs.drop("shard"))
    well_formed(found, edge_docs.count())
    # Null and empty texts are equal ones.
    assert len({r.in_shard for r in found if not r.t}) <= 2
    assert assigned(no_docs.drop("shard")) == []


def test_grants_keep_every_shard_within_its_room():
    for seed in range(300):
        rng = random.Random(seed)
        size = rng.randint(2, 8)
        wishes = {(i, j): rng.choice([0, 1, 2, 10, 10**9]) for i in range(size) for j in range(size) if i != j and rng.random() < 0.6}
        room = [rng.choice([0, 0, 1, 5, 10**8]) for _ in range(size)]
        grants = sharding.granted(wishes, room)
        assert all(0 <= grants[pair] <= n for pair, n in wishes.items())
        for shard in range(size):
            enters = sum(n for (_, to), n in grants.items() if to == shard)
            assert enters - sum(n for (source, _), n in grants.items() if source == shard) <= room[shard]


def simple_packing(sizes, room):
    """Large groups first, each into the fullest shard that holds it; how many fit nowhere."""
    room, cut = list(room), 0
    for n in sorted(sizes, reverse=True):
        able = [s for s in range(len(room)) if room[s] >= n]
        if able:
            room[min(able, key=lambda s: room[s])] -= n
        else:
            cut += 1
            for _ in range(n):
                room[max(range(len(room)), key=lambda s: room[s])] -= 1
    return cut


@pytest.mark.parametrize("alone", [0, 0.1])
def test_hardly_a_group_is_cut_when_few_rows_are_alone(spark, alone):
    rng = random.Random(11)
    sizes = [min(120, int(2 / rng.random() ** 0.8)) for _ in range(300)]
    texts = [f"group {g}" for g, n in enumerate(sizes) for _ in range(n)]
    texts += [f"own {i}" for i in range(int(len(texts) * alone / (1 - alone)))]
    rng.shuffle(texts)
    found = assigned(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    well_formed(found, len(texts))
    shards = collections.defaultdict(set)
    for r in found:
        shards[r.t].add(r.in_shard)
    cut = sum(len(s) > 1 for s in shards.values())
    print("cut", cut, "of", len(sizes))
    assert cut <= simple_packing(sizes, [(len(texts) - s + 7) // 8 for s in range(8)]) + 1


def test_packing_fills_no_shard_beyond_its_room():
    for seed in range(300):
        rng = random.Random(seed)
        sizes = collections.Counter(rng.choice([2, 2, 3, 5, 40, 700]) for _ in range(rng.randint(1, 300)))
        members = sum(size * n for size, n in sizes.items())
        spare = rng.choice([0, 0, 3, members])
        room = [(members + spare - s + 7) // 8 for s in range(8)]
        plan, cuts = sharding.pack(sizes, room)
        used = collections.Counter()
        for size, runs in plan.items():
            assert sum(n for n, _ in runs) == sizes[size]
            for n, parts in runs:
                assert sum(m for _, m in parts) == size
                for shard, m in parts:
                    used[shard] += n * m
        assert all(used[s] <= room[s] for s in range(8)) and cuts < 8
