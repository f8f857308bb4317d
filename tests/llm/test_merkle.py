"""The manifest against a plain computation of the same trees."""

import zlib
from hashlib import sha256

import pytest

from registra.llm import merkle
from registra.llm.queries import JOBS
from tests.llm.conftest import SF


def hashed(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(values):
    return hashed(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def climb(nodes):
    """All levels of a tree, from its leaves to its root."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([hashed(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def steps(levels, at):
    """The run of each level that holds a node's ancestor, and the ancestor's place in it."""
    for nodes in levels[:-1]:
        first = at - at % 3
        yield nodes[first : first + 3], at - first
        at //= 3


def plain(rows):
    """Rows of (doc_id, source, lang, n_chars, text)."""
    sources = {}
    for row in rows:
        sources.setdefault(row[1], []).append((row[0] is not None, row[0] or 0, leaf(row), row))
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for name in names:
        sources[name].sort(key=lambda x: x[:3])
        trees.append(climb([x[2] for x in sources[name]]))
    top = climb([t[-1][0] for t in trees])
    root, out = top[-1][0] if trees else "", []
    for number, name in enumerate(names):
        for at, (_, _, own, row) in enumerate(sources[name]):
            changed = list(row)
            if row[0] is not None and row[4] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0:
                changed[4] = row[4].replace("\n", "")
            value, siblings = leaf(changed), []
            for run, place in (*steps(trees[number], at), *steps(top, number)):
                siblings += run[:place] + run[place + 1 :]
                value = hashed(*run[:place], value, *run[place + 1 :])
            out.append((row[0], own, trees[number][-1][0], root, hashed(*siblings), value, value == root))
    return out


def found(df):
    return sorted((tuple(r) for r in df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)


def test_versions_share_what_they_do_not_touch():
    block = merkle.PersistentBlock([hashed(str(i)) for i in range(20)], 3)
    before = [list(level) for level in block.nodes]
    copied = block.version(7, hashed("x"))
    other = merkle.PersistentBlock([hashed("x") if i == 7 else hashed(str(i)) for i in range(20)], 3)
    assert block.nodes == before and len(copied) == 4 and copied[-1] == other.root != block.root
    assert [level[7 // 3**i] for i, level in enumerate(other.nodes)] == copied


@pytest.mark.parametrize("levels", [1, 2, merkle.LEVELS])
def test_block_sizes_do_not_show(spark, levels):
    rows = [(i, None if i % 11 == 0 else "abé"[i % 3], "en", i, f"line {i}\nof {i % 4}" if i % 5 else None) for i in range(130)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    got = found(merkle.manifest(docs, merkle.tampered_text(), levels=levels))
    assert got == sorted(plain(rows), key=str)
    assert {r[6] for r in got} == {True, False}


def test_many_sources(spark):
    rows = [(i, f"s{i}", "en", i, f"{i}\n") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert found(merkle.manifest(docs, merkle.tampered_text(), levels=2)) == sorted(plain(rows), key=str)


def test_edge_cases(spark, edge_docs, edge_rows, no_docs):
    rows = [(r[0], r[3], r[2], r[4], r[1]) for r in edge_rows]
    assert found(merkle.manifest(edge_docs, merkle.tampered_text())) == sorted(plain(rows), key=str)
    assert merkle.manifest(no_docs, merkle.tampered_text()).collect() == []


def test_query(spark, documents):
    rows = [tuple(r) for r in documents.select(*merkle.COLUMNS).collect()]
    assert found(JOBS["op12_merkle"](spark, SF)) == sorted(plain(rows), key=str)
