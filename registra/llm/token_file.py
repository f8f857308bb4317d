"""Token-ID output: documents as ids of a public vocabulary, in binary files of range-coded blocks (`context_coder`).

A file is a run of groups. A group holds blocks of at most `context_coder.BLOCK` ids, each with its number of ids, its coded
length and a CRC-32 of its ids, then the key and the number of ids of each document that ends in the group, and a CRC-32 of
all that. Documents may go on from block to block and group to group. Any block is decoded without the others.

The texts are encoded by the `tokenizers` library, the distinct words of a task once: these vocabularies never join what
white space parts, which `WordEncoder` checks. Documents are sorted by key over all tasks; a task writes one file to the
shared folder under a name of its own and reports it when it is closed, so a repeated attempt leaves no doubt which file
counts. Offsets are sums over files.

Defined cases: a null or empty text is its end id alone; a null key sorts first; documents with one key are in the order of
their texts' hashes, repeated rows next to each other; an empty table writes no file and reads back as an empty table; only
the columns named are read.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain, compress

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from registra.llm import context_coder
from registra.llm.words import WHITE_SPACE, Words, find_words, text_slices
from registra.operators.held import held, run_folder

#: Ids of one group at most, and of one file about.
GROUP_IDS = 1024 * context_coder.BLOCK
FILE_IDS = 1 << 23
#: Blocks that a group should have, if that leaves each at least so many ids.
GROUP_BLOCKS, LEAST_BLOCK = 512, 1024
#: Bytes of text encoded at a time: words take many times their own size while they are told apart.
TEXT_BYTES = 1 << 20
#: Words remembered by a task; beyond that it starts a new table, which only costs time.
REMEMBERED = 1 << 21
#: Longer words are not told apart by their hash and not remembered.
REMEMBERED_BYTES = 64

_MAGIC = b"tokens01"
_GROUP = "<IIQ"


# Kinds of bytes inside words: ASCII letters, digits, other ASCII, letters of the Latin blocks C0 to 24F (two bytes each), all else.
_LETTER, _DIGIT, _OTHER, _LATIN, _OPEN = range(1, 6)
_KIND = np.array([_OPEN if b >= 0x80 or b == 0x27 else _LETTER if chr(b).isalpha() else _DIGIT if chr(b).isdigit() else _OTHER for b in range(256)], dtype=np.uint8)


# The byte-level pre-tokeniser's sign for each byte: itself if it can be seen, else one from 100 on.
_SEEN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_SIGNS = np.arange(256, dtype="<u2")
_SIGNS[[b for b in range(256) if b not in _SEEN]] = np.arange(0x100, 0x200 - len(_SEEN))


def _joined(found: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
    return np.fromiter(chain.from_iterable(found), dtype=np.uint16, count=int(lengths.sum())), lengths


def cut_words(words: Words) -> tuple[Words, np.ndarray]:
    """Words cut further where the vocabulary's pre-tokeniser cuts too, between letters, single digits and other ASCII; and which are all letters.

    Words with an apostrophe, or with characters that are neither ASCII nor Latin letters, stay whole: what they join or
    cut is left to the library.
    """
    data = words.data
    kind = _KIND[data]
    lead = np.flatnonzero((data[:-1] >= 0xC3) & (data[:-1] <= 0xC9))
    after = data[lead + 1]
    # Not the signs D7 and F7, nor the letter 130, whose lower case has a mark after the letter.
    latin = (data[lead] != 0xC3) | ((after != 0x97) & (after != 0xB7))
    latin &= ((data[lead] != 0xC4) | (after != 0xB0)) & ((data[lead] != 0xC9) | (after < 0x90))
    latin = lead[latin]
    kind[latin] = kind[latin + 1] = _LATIN
    open_bytes = np.concatenate([[0], np.cumsum(kind == _OPEN)])
    whole = open_bytes[words.end] > open_bytes[words.start]
    kind[kind == _LATIN] = _LETTER
    edge = np.zeros(len(data), dtype=bool)
    edge[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
    # No cut inside whole words nor in white space.
    inside = np.zeros(len(data) + 1, dtype=np.int8)
    inside[words.start[~whole]] += 1
    inside[words.end[~whole]] -= 1
    edge &= np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    edge[words.start] = False
    cuts = np.flatnonzero(edge)
    start = np.sort(np.concatenate([words.start, cuts]))
    end = np.sort(np.concatenate([words.end, cuts]))
    letters = np.concatenate([[0], np.cumsum(kind == _LETTER, dtype=np.int32)])
    return Words(data, words.bounds, np.searchsorted(start, words.bounds), start, end), letters[end] - letters[start] == end - start


class WordEncoder:
    """Ids of one task's texts: each distinct word goes to the library once."""

    def __init__(self, path: str) -> None:
        # The library's own threads keep memory that grows from task to task, next to one task a core.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        if self.encode(["A b,\t\nç12.-a"])[0] != sum(self.encode(["a", "b", ",", "ç", "1", "2", ".-", "a"]), []):
            raise ValueError(f"{path}: this vocabulary does not encode words on their own")
        spelt = ["latin", "ñandú", "ǅɏǰ", "ßÿ"]
        if self.encode(spelt) != self._of_letters([w.encode() for w in spelt]):
            raise ValueError(f"{path}: this vocabulary does not spell words by the bytes of their lower-case letters")
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        if self.size > context_coder.IDS:
            raise ValueError(f"{path}: {self.size} ids are more than 16 bits hold")
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._forget()

    def _forget(self) -> None:
        self.hashes, self.number = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        self.start, self.ids = np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.uint16)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _of_letters(self, words: list[bytes]) -> list[list[int]]:
        """Ids of words of ASCII and Latin letters: what the normaliser and the pre-tokeniser make of them goes to the library's model at once."""
        lowered = np.frombuffer(b"\n".join(words).decode().lower().encode(), dtype=np.uint8)
        signs = _SIGNS[lowered].tobytes().decode("utf-16-le")
        tokenize = self.tokenizer.model.tokenize
        return [[t.id for t in tokenize(w)] for w in signs.split(chr(_SIGNS[0x0A]))] if words else []

    def _words(self, words: list[bytes], letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words and the number of each; `letters` marks those of `_of_letters`, without upper-case ASCII ones."""
        marks = letters.tolist()
        some = iter(self._of_letters(list(compress(words, marks))))
        rest = iter(self.encode([w.decode() for w, m in zip(words, marks, strict=True) if not m]))
        return _joined([next(some) if m else next(rest) for m in marks])

    def _remember(self, hashes: np.ndarray, words: list[bytes], letters: np.ndarray) -> None:
        """Take in new words, in ascending order of their hashes."""
        ids, lengths = self._words(words, letters)
        number = np.arange(len(words)) + len(self.start) - 1
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(lengths)])
        self.ids = np.concatenate([self.ids, ids])
        # Both sides are in order: each new word goes behind the lower ones of both.
        at = np.searchsorted(self.hashes, hashes) + np.arange(len(hashes))
        old = np.ones(len(self.hashes) + len(hashes), dtype=bool)
        old[at] = False
        every, numbers = np.empty(len(old), dtype=np.uint64), np.empty(len(old), dtype=np.int64)
        every[at], numbers[at] = hashes, number
        every[old], numbers[old] = self.hashes, self.number
        self.hashes, self.number = every, numbers

    def _known(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of words, and whether each is remembered."""
        if not len(self.hashes):
            return np.zeros(len(hashes), dtype=np.int64), np.zeros(len(hashes), dtype=bool)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return self.number[at], self.hashes[at] == hashes

    def slice(self, bounds: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts one after another, and the number of each text's."""
        raw = data.tobytes()
        if any(name in raw for name in self.special):
            # Special strings are found before words are; such slices go to the library whole.
            return _joined(self.encode([raw[a:b].decode() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]))
        # A-Z are lower-cased first, as the normaliser would do.
        words, letters = cut_words(find_words(bounds, data, WHITE_SPACE, lower=True))
        if not len(words):
            return np.zeros(0, dtype=np.uint16), np.zeros(len(bounds) - 1, dtype=np.int64)
        sizes = words.end - words.start
        long = np.flatnonzero(sizes > REMEMBERED_BYTES)
        distinct, first, back = np.unique(words.hashes(), return_index=True, return_inverse=True)
        if len(self.hashes) > REMEMBERED:
            self._forget()
        new = np.flatnonzero(~self._known(distinct)[1] & (sizes[first] <= REMEMBERED_BYTES))
        folded = words.data.tobytes()

        def spelt(places: np.ndarray) -> list[bytes]:
            return [folded[a:b] for a, b in zip(words.start[places].tolist(), words.end[places].tolist(), strict=True)]

        self._remember(distinct[new], spelt(first[new]), letters[first[new]])
        number = self._known(distinct)[0][back]
        ids = self.ids
        if len(self.start) > 1:
            start, counts = self.start[:-1][number], np.diff(self.start)[number]
        else:
            start, counts = number.copy(), number.copy()
        if len(long):
            found, lengths = _joined(self.encode([w.decode() for w in spelt(long)]))
            start[long], counts[long] = len(ids) + np.cumsum(lengths) - lengths, lengths
            ids = np.concatenate([ids, found])
        upto = np.concatenate([[0], np.cumsum(counts)])
        places = np.arange(int(upto[-1])) + np.repeat(start - upto[:-1], counts)
        return ids[places], np.diff(upto[words.first])

    def batch(self, column: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a column's texts, each followed by the end id, and the number of each text's."""
        parts, counts = [np.zeros(0, dtype=np.uint16)], [np.zeros(0, dtype=np.int64)]
        for _, _, bounds, data in text_slices(column, TEXT_BYTES):
            ids, lengths = self.slice(bounds, data)
            parts.append(np.insert(ids, np.cumsum(lengths), end))
            counts.append(lengths + 1)
        return np.concatenate(parts), np.concatenate(counts)


def _uri(folder: str) -> str:
    return folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"


def tokenised(docs: DataFrame, path: str, end: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`doc_id`, `place` (a hash of the text), `n_tokens` and `ids`, 16-bit little-endian numbers with the end id."""

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(path)
        for batch in found:
            for low in range(0, batch.num_rows, 1000):
                rows = batch.slice(low, 1000)
                ids, counts = encoder.batch(rows.column(2), end)
                raw, cuts = ids.astype("<u2").tobytes(), (2 * np.cumsum(counts)).tolist()
                blobs = [raw[a:b] for a, b in zip([0, *cuts[:-1]], cuts, strict=True)]
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(counts), pa.array(blobs, pa.binary())], names=["doc_id", "place", "n_tokens", "ids"])

    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(body).alias("place"), body.alias("text"))
    return rows.mapInArrow(batches, "doc_id bigint, place bigint, n_tokens bigint, ids binary")


def pack_group(ids: np.ndarray, keys: np.ndarray, null: np.ndarray, counts: np.ndarray) -> bytes:
    """A group: its ids in coded blocks, and the documents that end in it."""
    # A small group has shorter blocks: the coder's time goes by steps, however few blocks advance together.
    block = min(max(-(-len(ids) // GROUP_BLOCKS), LEAST_BLOCK), context_coder.BLOCK)
    lengths = context_coder.block_lengths(len(ids), block)
    coded = context_coder.encode(ids, lengths)
    table = np.zeros(len(coded), dtype=[("ids", "<u4"), ("bytes", "<u4"), ("check", "<u4")])
    table["ids"], table["bytes"], table["check"] = lengths, [len(c) for _, c in coded], [check for check, _ in coded]
    documents = np.zeros(len(keys), dtype=[("key", "<i8"), ("null", "u1"), ("ids", "<u8")])
    documents["key"], documents["null"], documents["ids"] = keys, null, counts
    head = table.tobytes() + documents.tobytes()
    payload = b"".join(c for _, c in coded)
    return struct.pack(_GROUP, len(coded), len(keys), len(payload)) + head + struct.pack("<I", zlib.crc32(head)) + payload


def read_groups(stream) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and documents (`key`, `null`, `ids`) of each group of a file; raises ValueError where it is damaged."""

    def exactly(size: int) -> bytes:
        content = stream.read(size)
        if len(content) != size:
            raise ValueError("a file is cut short")
        return content

    if exactly(len(_MAGIC)) != _MAGIC:
        raise ValueError("not a token file")
    while head := stream.read(struct.calcsize(_GROUP)):
        if len(head) != struct.calcsize(_GROUP):
            raise ValueError("a file is cut short")
        blocks, documents, size = struct.unpack(_GROUP, head)
        kinds = [("ids", "<u4"), ("bytes", "<u4"), ("check", "<u4")], [("key", "<i8"), ("null", "u1"), ("ids", "<u8")]
        content = exactly(12 * blocks + 17 * documents)
        if struct.unpack("<I", exactly(4))[0] != zlib.crc32(content):
            raise ValueError("a group's tables do not match their check sum")
        table = np.frombuffer(content, dtype=kinds[0], count=blocks)
        found = np.frombuffer(content, dtype=kinds[1], count=documents, offset=12 * blocks)
        payload = exactly(size)
        cuts = np.cumsum(table["bytes"], dtype=np.int64).tolist()
        pieces = [payload[a:b] for a, b in zip([0, *cuts[:-1]], cuts, strict=True)]
        yield context_coder.decode(pieces, table["ids"].astype(np.int64), table["check"].tolist()), found


class _Writer:
    """Cuts a task's documents into groups of a file that is opened with the first one."""

    def __init__(self, folder: str) -> None:
        self.system, path = fs.FileSystem.from_uri(folder)
        self.system.create_dir(path, recursive=True)
        self.name = f"{uuid.uuid4().hex}.tokens"
        self.out = self.system.open_output_stream(f"{path}/{self.name}")
        self.out.write(_MAGIC)
        self.ids: list[np.ndarray] = []
        self.documents: list[tuple[np.ndarray, ...]] = []
        self.waiting = 0

    def add(self, ids: np.ndarray, keys: np.ndarray, null: np.ndarray, counts: np.ndarray) -> None:
        """Documents with all their ids; their number counts where they end, in the last group with one of their ids."""
        self.ids.append(ids)
        self.documents.append((keys, null, counts, self.waiting + np.cumsum(counts)))
        self.waiting += len(ids)
        while self.waiting >= GROUP_IDS:
            self._group(GROUP_IDS)

    def _group(self, size: int) -> None:
        ids = np.concatenate(self.ids)
        keys, null, counts, ends = (np.concatenate(x) for x in zip(*self.documents, strict=True))
        here = int(np.searchsorted(ends, size, side="right"))
        self.out.write(pack_group(ids[:size], keys[:here], null[:here], counts[:here]))
        self.ids, self.waiting = [ids[size:]], len(ids) - size
        self.documents = [(keys[here:], null[here:], counts[here:], ends[here:] - size)]

    def close(self) -> None:
        if self.waiting:
            self._group(self.waiting)
        self.out.close()


def write_files(tokens: DataFrame, folder: str) -> DataFrame:
    """Write `tokens` (of `tokenised`) in ascending order of keys. One row a file: `file`, `first` (its first key), `start` and `n_tokens`."""
    total = tokens.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n")).first()["n"]
    home = _uri(folder)

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, first, n = None, None, 0
        for batch in found:
            if not batch.num_rows:
                continue
            if writer is None:
                writer, first = _Writer(home), batch.select(["doc_id", "place", "at"]).slice(0, 1).to_pylist()[0]
            for low in range(0, batch.num_rows, 1000):
                rows = batch.slice(low, 1000)
                ids = np.frombuffer(b"".join(rows.column("ids").to_pylist()), dtype="<u2").astype(np.uint16)
                key = rows.column("doc_id")
                counts = rows.column("n_tokens").to_numpy()
                writer.add(ids, key.fill_null(0).to_numpy(), key.is_null().to_numpy(zero_copy_only=False), counts)
                n += int(counts.sum())
        if writer is not None:
            writer.close()
            kind = pa.struct([("doc_id", pa.int64()), ("place", pa.int64()), ("at", pa.int64())])
            yield pa.RecordBatch.from_arrays([pa.array([writer.name]), pa.array([first], kind), pa.array([n], pa.int64())], names=["file", "first", "n_tokens"])

    order = [F.col(c).asc_nulls_first() for c in ("doc_id", "place", "at")]
    rows = tokens.withColumn("at", F.monotonically_increasing_id()).repartitionByRange(max(1, -(-total // FILE_IDS)), *order)
    written = held(
        rows.sortWithinPartitions(*order).mapInArrow(batches, "file string, first struct<doc_id:bigint,place:bigint,at:bigint>, n_tokens bigint"), "files"
    )
    # One row a file is what a single task sums here.
    before = Window.partitionBy(F.lit(0)).orderBy(F.col("first").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    return written.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_files(files: DataFrame, folder: str) -> DataFrame:
    """Documents of written files: `doc_id`, `start` (ids of all documents before it), `n_tokens` and `ids_crc32`."""
    home = _uri(folder)

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = fs.FileSystem.from_uri(home)
        for batch in found:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with system.open_input_stream(f"{path}/{name}") as stream:
                    begun, check = 0, 0
                    for ids, documents in read_groups(stream):
                        raw, at = ids.astype("<u4").tobytes(), 0
                        starts, checks = [], []
                        for count in documents["ids"].tolist():
                            end = at + count - begun
                            starts.append(start)
                            checks.append(zlib.crc32(raw[4 * at : 4 * end], check))
                            start, at, begun, check = start + count, end, 0, 0
                        # What is left belongs to a document that goes on in the next group.
                        check = zlib.crc32(raw[4 * at :], check)
                        begun += len(ids) - at
                        keys = pa.array(documents["key"].astype(np.int64), mask=documents["null"].astype(bool))
                        columns = [keys, pa.array(starts, pa.int64()), pa.array(documents["ids"].astype(np.int64)), pa.array(checks, pa.int64())]
                        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32"])
                    if begun:
                        raise ValueError(f"{name}: a document has no end")

    # Each file is a task of its own.
    numbered = files.select("file", "start").repartition(max(1, files.count()), "file")
    return numbered.mapInArrow(batches, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def round_trip(docs: DataFrame, path: str, end: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` as token files in the run's folder, read back (`read_files`)."""
    folder = f"{run_folder(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    tokens = held(tokenised(docs, path, end, key, text), "tokenised")
    return read_files(held(write_files(tokens, folder), "starts"), folder)
