"""SimHash groups, substring removal and benchmark decontamination."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from registra.llm import components, decontaminate, simhash, substring


def fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def least_reachable(values):
    """Smallest index reachable over values at most two bits apart."""
    own = list(range(len(values)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(values):
            for j, b in enumerate(values):
                if own[j] < own[i] and (a ^ b).bit_count() <= 2:
                    own[i], changed = own[j], True
    return own


def test_fingerprints_and_one_of_each(edge_docs, no_docs):
    got = simhash.fingerprints(edge_docs, F.col("text"), F.col("text")).collect()
    assert len(got) == edge_docs.count()
    for r in got:
        assert r.bits & (1 << 64) - 1 == fingerprint(r.doc_id)
    kept = simhash.one_of_each(edge_docs)
    assert kept.columns == edge_docs.columns
    rows = kept.collect()
    groups = collections.defaultdict(list)
    for r in edge_docs.collect():
        groups[fingerprint(r.text)].append(r.doc_id)
    assert sorted(r.doc_id for r in rows) == sorted(min(x for x in ids if x is not None) for ids in groups.values())
    assert simhash.one_of_each(no_docs).count() == 0


@pytest.mark.parametrize("limit", [1, 3, 2000])
def test_groups_of_close_fingerprints(spark, limit):
    rng = random.Random(2)
    values = [rng.getrandbits(64) for _ in range(40)]
    for _ in range(80):
        value = rng.choice(values)
        for bit in rng.sample(range(64), rng.randint(0, 3)):
            value ^= 1 << bit
        values.append(value)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    prints = spark.createDataFrame(list(enumerate(signed)), "doc_id long, bits long")
    got = {r.bits: r.component_id for r in simhash.near_duplicates(prints, limit).collect()}
    assert [got[v] for v in signed] == least_reachable(values)


def test_bk_tree():
    rng = random.Random(4)
    values = [rng.getrandbits(12) for _ in range(300)]
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    for v in values[:40]:
        assert sorted(tree.within(v, 2)) == [i for i, x in enumerate(values) if (x ^ v).bit_count() <= 2]


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 90), (90, 100), (7, 7)], "x long, y long")
    got = {r.node: r.root for r in components.components(links, F.col("x"), F.col("y")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 90: 90, 100: 90}
    assert components.components(links.limit(0), F.col("x"), F.col("y")).count() == 0


def removed(texts):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = collections.Counter(tuple(w[i : i + 35]) for w in words for i in range(len(w) - 34))
    out = []
    for w in words:
        gone = {i + k for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for k in range(35)}
        out.append((len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [1, 1 << 15])
def test_substring_removal(spark, edge_docs, no_docs, monkeypatch, hot):
    monkeypatch.setattr(substring, "HOT_ANCHOR", hot)
    rng = random.Random(9)
    passage = [f"p{i}" for i in range(70)]

    def noise(n):
        return [f"n{rng.randint(0, 10**6)}" for _ in range(n)]

    texts = [r.text for r in edge_docs.select("text").collect()]
    texts += [" ".join([*noise(rng.randint(0, 40)), *passage[rng.randint(0, 20) : rng.randint(40, 70)], *noise(rng.randint(0, 40))]) for _ in range(40)]
    texts += [" ".join(passage[:20] * 5), " ".join(noise(34)), "  ".join(passage), " ".join(passage), " ".join([*noise(50), *passage[:34]])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.removals(docs).collect()}
    assert [got[i] for i in range(len(texts))] == removed(texts)
    assert substring.removals(edge_docs).count() == edge_docs.count()
    assert substring.removals(no_docs).count() == 0


def test_factors_name_their_source(spark):
    shared = " ".join(f"s{i}" for i in range(60))
    docs = spark.createDataFrame([(1, "a b c " + shared), (2, shared + " d e f")], "doc_id long, text string")
    _, found = substring.factors(docs)
    cleaned = {r.kept: [tuple(s) for s in r.spans] for r in substring.cleaned_texts(docs, found).collect()}
    assert set(cleaned) == {"a b c", "d e f"}
    (a, b, source), = cleaned["a b c"]
    (c, d, other), = cleaned["d e f"]
    assert (a, b, c, d) == (3, 63, 0, 60) and source != other


def contaminated(texts, items):
    def words(t):
        return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())

    phrases = collections.defaultdict(set)
    for name, t in items:
        w = words(t)
        for i in range(max(0, len(w) - 10) + 1 if w else 0):
            phrases[tuple(w[i : i + 10])].add(name)
    out = []
    for t in texts:
        w, hit, names = words(t), set(), set()
        for size in {len(p) for p in phrases}:
            for i in range(len(w) - size + 1):
                if found := phrases.get(tuple(w[i : i + size])):
                    hit |= set(range(i, i + size))
                    names |= found
        out.append((len(w), len(hit), sorted(str(n) for n in names if n is not None)))
    return out


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_decontamination(spark, edge_docs, edge_rows, no_docs, block_bytes):
    rng = random.Random(6)
    prose = edge_rows[5][1].split()
    items = [(i, " ".join(prose[i : i + rng.randint(1, 25)])) for i in range(0, 60, 4)] + [(None, prose[0]), (70, ""), (71, None), (72, "one"), (72, "one"), (73, "Not there at all")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(edge_docs, benchmark, block_bytes=block_bytes).collect()
    assert len(got) == len(edge_rows)
    found = sorted((r.n_words, sum(h.end - h.start for h in r.hits), r.items) for r in got)
    assert found == sorted(contaminated([r[1] for r in edge_rows], items))
    assert all(h.end <= k.start for r in got for h, k in zip(r.hits, r.hits[1:])) and {r.row.row for r in got} == {"x"}
    assert decontaminate.contamination(no_docs, benchmark).count() == 0
    assert decontaminate.contamination(edge_docs, benchmark.limit(0)).filter(F.size("hits") > 0).count() == 0


def test_fm_index_against_search():
    rng = np.random.default_rng(8)
    symbols = rng.integers(0, 4, 400)
    symbols[-1] = 0
    order = decontaminate.suffix_array(symbols)
    assert sorted(order.tolist()) == list(range(400))
    index = decontaminate.FMIndex(symbols)
    for size in (1, 2, 3, 5):
        phrases = rng.integers(1, 6, (60, size))
        low, high = index.search(phrases)
        for phrase, a, b in zip(phrases, low, high):
            expected = [i for i in range(400 - size + 1) if (symbols[i : i + size] == phrase).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == expected
