"""Token files: blocks, groups and files against plain copies of their ids."""

import io
import os
import subprocess
import sys
import tracemalloc
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from registra.llm import context_coder, token_file
from registra.llm.queries import JOBS
from tests.llm.conftest import SF

PATH = public_tokenizers.path("word_bpe_49k.json")


def expected(rows):
    """Rows of (doc_id, text) by the library, one text at a time."""
    library, start, out = Tokenizer.from_file(PATH), 0, []
    for key, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((key, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    return out


def skewed(n, distinct, seed=3):
    rng = np.random.default_rng(seed)
    return (rng.zipf(1.3, n) * 7919 % distinct).astype(np.int64)


@pytest.mark.parametrize("ids", [[], [0], [65535] * 3, [2] * 9000, range(5000), skewed(3000, 65536), skewed(30000, 700)])
def test_blocks_come_back(ids):
    ids = np.array(list(ids), dtype=np.int64)
    lengths = context_coder.block_lengths(len(ids))
    assert lengths.sum() == len(ids) and lengths.max(initial=0) <= context_coder.BLOCK
    coded = context_coder.encode(ids, lengths)
    assert (context_coder.decode([c for _, c in coded], lengths, [k for k, _ in coded]) == ids).all()


def test_a_block_needs_no_other():
    ids = skewed(20000, 900)
    lengths = context_coder.block_lengths(len(ids))
    coded = context_coder.encode(ids, lengths)
    for i in (0, 3, len(lengths) - 1):
        start = int(lengths[:i].sum())
        assert (context_coder.decode([coded[i][1]], lengths[i : i + 1], [coded[i][0]]) == ids[start : start + lengths[i]]).all()


def test_predictable_ids_take_little_room():
    ids = np.tile(skewed(60, 4000), 60)
    coded = context_coder.encode(ids, context_coder.block_lengths(len(ids)))
    assert sum(len(c) for _, c in coded) * 8 < 2 * len(ids)


def test_a_small_group_takes_few_steps():
    """What is left for a file's last group is coded in shorter blocks, full groups in whole ones."""
    none = np.zeros(0, dtype=np.int64)
    for n, longest in ((900, 900), (20000, 1000), (token_file.GROUP_BLOCKS * 1500, 1500)):
        ids = skewed(n, 900)
        group = token_file.pack_group(ids, none, none, none)
        blocks = int.from_bytes(group[:4], "little")
        assert max(int.from_bytes(group[16 + 12 * i : 20 + 12 * i], "little") for i in range(blocks)) == longest
        assert (next(token_file.read_groups(io.BytesIO(b"tokens01" + group)))[0] == ids).all()


def test_damage_is_found():
    ids = skewed(9000, 500)
    keys = np.arange(90)
    whole = b"tokens01" + token_file.pack_group(ids, keys, keys * 0, np.full(90, 100))
    assert (next(token_file.read_groups(io.BytesIO(whole)))[0] == ids).all()
    for damaged in (whole[:-1], whole[:20], b"x" + whole[1:], whole[:30] + bytes([whole[30] ^ 1]) + whole[31:], whole[:-500] + bytes([whole[-500] ^ 4]) + whole[-499:]):
        with pytest.raises(ValueError):
            list(token_file.read_groups(io.BytesIO(damaged)))


def test_words_as_the_library_does():
    texts = ["It's A tèst, l'Été\x0b42 don't  'S", "ΣΑΣ İstanbul ﬁn é ́x a b c　d", "x" * 5000 + " y", "", "a<|endoftext|>b", "<|endof text|>", "日本語   text", "HELLO hello", "\x00 \x1c\x1d a\x85b", "x=\u0338y a,\u0338 É1ß÷×é,ñ-2 ǅȸɐ İ,A «é» e\u0301,\u0301 l'été-12.5%"]
    encoder, library = token_file.WordEncoder(PATH), Tokenizer.from_file(PATH)
    for group in [texts, *[[t] for t in texts]]:
        data = [t.encode() for t in group]
        bounds = np.cumsum([0, *map(len, data)])
        ids, counts = encoder.slice(bounds, np.frombuffer(b"".join(data), dtype=np.uint8))
        want = [library.encode(t, add_special_tokens=False).ids for t in group]
        assert ids.tolist() == sum(want, []) and counts.tolist() == [len(w) for w in want]


def test_documents_that_cross_groups(spark, monkeypatch, tmp_path):
    """A writer with small groups: documents go on from one to the next."""
    monkeypatch.setattr(token_file, "GROUP_IDS", 700)
    writer = token_file._Writer(f"file://{tmp_path}")
    ids, counts = skewed(5000, 300), np.array([1, 2500, 499, 1, 1999])
    writer.add(ids[:2501], np.array([5, 6]), np.array([True, False]), counts[:2])
    writer.add(ids[2501:], np.array([7, 8, 9]), np.zeros(3, dtype=bool), counts[2:])
    writer.close()
    monkeypatch.undo()
    files = spark.createDataFrame([(writer.name, 10)], "file string, start long")
    got = [tuple(r) for r in token_file.read_files(files, str(tmp_path)).collect()]
    cuts = [0, *np.cumsum(counts).tolist()]
    want = [(k, 10 + a, b - a, zlib.crc32(ids[a:b].astype("<u4").tobytes())) for k, a, b in zip([None, 6, 7, 8, 9], cuts, cuts[1:])]
    assert got == want


def test_edge_cases(spark, edge_docs, edge_rows, no_docs):
    got = sorted((tuple(r) for r in token_file.round_trip(edge_docs, PATH, 2).collect()), key=lambda r: r[1])
    assert [r[1] for r in got] == np.cumsum([0, *[r[2] for r in got]])[:-1].tolist()
    assert [r[0] is not None for r in got] == sorted(r[0] is not None for r in got)
    keys = [r[0] for r in got if r[0] is not None]
    assert keys == sorted(keys)
    want = expected([(r[0], r[1]) for r in edge_rows])
    assert sorted((str(r[0]), *r[2:]) for r in got) == sorted((str(r[0]), *r[2:]) for r in want)
    assert token_file.round_trip(no_docs, PATH, 2).collect() == []


def test_query(spark, documents):
    rows = sorted((r.doc_id, r.text) for r in documents.select("doc_id", "text").collect())
    assert sorted(tuple(r) for r in JOBS["op11_token_file"](spark, SF).collect()) == sorted(expected(rows))


def test_a_group_is_coded_in_little_memory():
    """Tables of a full group and what its digits are gathered in stay small next to an executor's memory."""
    ids = skewed(token_file.GROUP_IDS, 40000).astype(np.uint16)
    lengths = context_coder.block_lengths(len(ids))
    tracemalloc.start()
    try:
        coded = context_coder.encode(ids, lengths)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(coded) == len(lengths) and peak < 200 << 20


def test_texts_are_encoded_in_little_memory():
    """A batch of texts needs room for a part of them at a time, whatever its rows hold."""
    pick = np.random.default_rng(3)
    texts = [" ".join(f"w{n:x}" for n in pick.integers(0, 1 << 18, 600).tolist()) for _ in range(1000)]
    encoder = token_file.WordEncoder(PATH)
    tracemalloc.start()
    try:
        ids, counts = encoder.batch(pa.array(texts), 2)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(counts) == len(texts) and int(counts.sum()) == len(ids)
    assert peak < 200 << 20, peak


def test_latin_letters_as_the_library_does():
    """Each letter that goes to the model without the library's normaliser, alone and inside a word."""
    letters = [chr(c) for c in range(0xC0, 0x250)]
    words = [w for c in letters for w in (c, f"x{c}y", f"A{c}{c}", f"{c},{c}", f"1{c}'")]
    encoder, library = token_file.WordEncoder(PATH), Tokenizer.from_file(PATH)
    ids, counts = encoder.batch(pa.array(words), 2)
    want = [[*library.encode(w, add_special_tokens=False).ids, 2] for w in words]
    assert ids.tolist() == sum(want, []) and counts.tolist() == [len(w) for w in want]


def test_a_worker_does_not_grow():
    """Encoders one after another, as in a worker that is kept for many tasks: the library starts no threads, each of which would keep memory."""
    code = f"""
import os
import pyarrow as pa
from registra.llm.token_file import WordEncoder
before = len(os.listdir("/proc/self/task"))
for n in range(2):
    WordEncoder({PATH!r}).batch(pa.array(["don't " * 9 + f"\u3042{{n}} {{i}}" for i in range(2000)]), 2)
print(len(os.listdir("/proc/self/task")) - before)
"""
    free = {k: v for k, v in os.environ.items() if k not in ("TOKENIZERS_PARALLELISM", "RAYON_NUM_THREADS", "RAYON_RS_NUM_THREADS")}
    done = subprocess.run([sys.executable, "-c", code], env=free, cwd=Path(__file__).parents[2], capture_output=True, text=True, timeout=60, check=True)
    assert done.stdout.strip() == "0"
