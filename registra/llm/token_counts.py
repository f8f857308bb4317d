"""Token counts of every prefix of a text under a byte-level BPE vocabulary, by dynamic programming over prefixes.

A pre-tokeniser cuts a text into pieces that are encoded on their own, so the count of a prefix is the count of the whole
pieces before it plus the count of a prefix of one piece. Inside a piece the encoding of every prefix is extended from
shorter ones: the last token of a prefix is the one vocabulary entry that ends there and that merging could have left
standing next to the last token of what precedes it. Each prefix then costs a few table lookups, and truncation
("tokens of the first k characters") and budget ("how many characters fit into n tokens") are read from the table
without encoding anything again. Counts equal those of the `tokenizers` library, special strings included.

Defined cases: a null or empty text has no tokens; texts of any length are cut as a stream and long pieces cost linear
time; repeated rows are counted one by one; an empty table gives an empty table; only the columns named are read.
"""

from __future__ import annotations

import json
import sys
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pieces (and pairs of tokens) remembered by a task; beyond that it starts a new table, which only costs time.
REMEMBERED = 1 << 19
#: Longer pieces are not remembered.
REMEMBERED_LENGTH = 64

# The byte-level pre-tokeniser's published pattern.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
CUT_CONTRACTIONS = ("'re", "'ve", "'ll")


def _byte_letters() -> dict[str, int]:
    """Byte-level vocabularies write each byte as a printable character: itself, or 256 and up in order for the rest."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


@dataclass
class Vocabulary:
    """Tokens by their bytes, and for each token the merges along its right and left edge."""

    #: Finds tokens by their last byte (bytes are written as the characters of the same number).
    ends: ahocorasick.Automaton
    merged: dict[tuple[int, int], int]
    right_edge: list[tuple[tuple[int, float], ...]]
    left_edge: list[tuple[tuple[int, float], ...]]
    special: tuple[str, ...]
    together: dict[int, bool] = field(default_factory=dict)

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        model, letters = content["model"], _byte_letters()
        if model["type"] != "BPE" or model.get("ignore_merges") or content.get("normalizer") is not None:
            raise ValueError(f"{path}: only plain byte-level BPE is supported")
        spelt = {name: bytes(letters[c] for c in name) for name in model["vocab"] if all(c in letters for c in name)}
        number = model["vocab"]
        merged, made_of = {}, {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            whole = number[a + b]
            merged[number[a], number[b]] = rank
            made_of.setdefault(whole, (number[a], number[b], rank))
        size = max(number.values()) + 1

        def edge(token: int, side: int) -> tuple[tuple[int, float], ...]:
            # Each part on that edge, with the rank of the merge that swallows it.
            parts, swallowed = [], float("inf")
            while True:
                parts.append((token, swallowed))
                if token not in made_of:
                    return tuple(parts)
                *halves, swallowed = made_of[token]
                token = halves[side]

        ends = ahocorasick.Automaton()
        for name, i in number.items():
            if name in spelt and (i in made_of or len(spelt[name]) == 1):
                ends.add_word(spelt[name].decode("latin-1"), (i, len(spelt[name])))
        ends.make_automaton()
        return cls(
            ends,
            merged,
            [edge(i, 1) for i in range(size)],
            [edge(i, 0) for i in range(size)],
            tuple(t["content"] for t in content.get("added_tokens", [])),
        )

    def stand_together(self, a: int, b: int) -> bool:
        """Whether merging the bytes of `a` and `b` in order of rank ends with exactly these two tokens.

        It does unless some part on a's right edge and some part on b's left edge would have merged with each other
        before either was swallowed by its own token; of equal merges the left one comes first.
        """
        for x, swallowed_x in self.right_edge[a]:
            for y, swallowed_y in self.left_edge[b]:
                rank = self.merged.get((x, y))
                if rank is not None and rank < swallowed_x and rank <= swallowed_y:
                    return False
        return True

    def prefixes(self, piece: bytes) -> list[int]:
        """Token count of every prefix of a piece, from none of its bytes to all."""
        together, n = self.together, len(piece)
        if len(together) > REMEMBERED:
            together.clear()
        counts, last = [0] * (n + 1), [-1] * (n + 1)
        # Every token that ends at a place, longest first: the first one that fits is the last token of that prefix.
        for place, (token, size) in self.ends.iter(piece.decode("latin-1")):
            end = place + 1
            if last[end] >= 0:
                continue
            start = end - size
            if start:
                pair = last[start] << 32 | token
                fits = together.get(pair)
                if fits is None:
                    fits = together[pair] = self.stand_together(last[start], token)
                if not fits:
                    continue
            counts[end], last[end] = counts[start] + 1, token
        return counts


class PrefixCounter:
    """Prefix tables of one task's texts: pieces seen before are looked up."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        self.seen: dict[str, bytes] = {}
        #: The last entry of each table in `seen`.
        self.totals: dict[str, int] = {}
        self.pieces = regex.compile(PIECES)
        self.gaps = regex.compile(r"\p{White_Space}{2,}")
        self.special = regex.compile("|".join(map(regex.escape, vocabulary.special))) if vocabulary.special else None

    def piece(self, piece: str) -> bytes:
        """Counts (as 32-bit numbers) of the first 1, 2, ... characters of a piece."""
        known = self.seen.get(piece)
        if known is not None:
            return known
        counts = np.asarray(self.vocabulary.prefixes(piece.encode())[1:], dtype=np.int32)
        if not piece.isascii():
            widths = np.array([len(c.encode()) for c in piece])
            counts = counts[np.cumsum(widths) - 1]
        if piece in CUT_CONTRACTIONS:
            # Cut after two characters, the quote and the letter are pieces of their own.
            counts[1] = 2
        table = counts.tobytes()
        if len(piece) <= REMEMBERED_LENGTH:
            if len(self.seen) >= REMEMBERED:
                self.seen.clear()
                self.totals.clear()
            self.seen[piece], self.totals[piece] = table, int(counts[-1])
        return table

    def total(self, piece: str) -> int:
        """Tokens of a whole piece."""
        known = self.totals.get(piece)
        return int.from_bytes(self.piece(piece)[-4:], sys.byteorder) if known is None else known

    def ordinary(self, part: str) -> np.ndarray:
        """Token counts of the first 1, 2, ... characters of a text without special strings."""
        get, new = self.seen.get, self.piece
        tables = [get(piece) or new(piece) for piece in self.pieces.findall(part)]
        flat = np.frombuffer(b"".join(tables), dtype=np.int32)
        lengths = np.fromiter(map(len, tables), dtype=np.int64, count=len(tables)) // 4
        whole = flat[np.cumsum(lengths) - 1]
        counts = flat + np.repeat(np.cumsum(whole) - whole, lengths)
        for gap in self.gaps.finditer(part):
            # A prefix that ends inside a gap has the gap's part as one piece; followed by a word the gap is cut otherwise.
            before = counts[gap.start() - 1] if gap.start() else 0
            inside = np.frombuffer(self.piece(gap.group()), dtype=np.int32)
            if gap.end() < len(part):
                counts[gap.start() : gap.end()] = before + inside
        return counts

    def table(self, text: str) -> np.ndarray:
        """Token counts of the first 0, 1, 2, ... characters of a text; the last one is the text's own count."""
        out, total, plain, at = [np.zeros(1, dtype=np.int64)], 0, "", 0
        for match in self.special.finditer(text) if self.special else ():
            plain, name = text[at : match.start()], match.group()
            if plain:
                out.append(total + self.ordinary(plain))
            # Cut inside its name, a special string is ordinary text.
            cut = [total + int(self.ordinary(plain + name[:k])[-1]) for k in range(1, len(name))]
            total += (int(self.ordinary(plain)[-1]) if plain else 0) + 1
            out.append(np.array([*cut, total], dtype=np.int64))
            at = match.end()
        if at < len(text):
            out.append(total + self.ordinary(text[at:]))
        return np.concatenate(out)

    def within(self, text: str, budget: int) -> tuple[int, int]:
        """Tokens of a text, and characters of its longest prefix with at most `budget` tokens (`longest_prefix`).

        Whole pieces are added up. Prefixes are told apart only near the piece that goes beyond the budget: one that ends
        two pieces later holds that piece whole, and one that ends there holds all that is two pieces before whole.
        """
        if self.special and self.special.search(text):
            table = self.table(text)
            return int(table[-1]), longest_prefix(table, budget)
        pieces, get, new = self.pieces.findall(text), self.totals.get, self.total
        counts = [get(piece) or new(piece) for piece in pieces]
        tokens = sum(counts)
        if tokens <= budget:
            return tokens, len(text)
        upto = list(accumulate(counts))
        over = bisect_right(upto, budget)
        first = max(0, over - 3)
        start, before = sum(map(len, pieces[:first])), upto[first - 1] if first else 0
        return tokens, start + longest_prefix(self.table("".join(pieces[first : over + 3])), budget - before)


def tokens_in_prefix(table: np.ndarray, characters: int) -> int:
    """Tokens of the first `characters` characters of the text a table belongs to."""
    return int(table[min(characters, len(table) - 1)])


def longest_prefix(table: np.ndarray, budget: int) -> int:
    """Characters of the longest prefix with at most `budget` tokens (counts may fall as a prefix grows)."""
    return int(np.flatnonzero(table <= budget)[-1]) if budget >= 0 else 0


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))


def prefix_tables(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`doc_id` and `prefix_tokens`: element k + 1 is the token count of the text's first k characters."""

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PrefixCounter(Vocabulary.load(path))
        for batch in found:
            for i in range(batch.num_rows):
                tables = pa.array([counter.table(batch.column(1)[i].as_py() or "")], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), tables], names=["doc_id", "prefix_tokens"])

    rows = _rows(docs, key, text)
    return rows.mapInArrow(batches, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, prefix_tokens array<bigint>")


def token_counts(docs: DataFrame, path: str, budget: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`doc_id`, `n_bytes`, `n_tokens` and `budget_chars`, the length of the longest prefix within `budget` tokens.

    `path` names a vocabulary file that every worker can open.
    """

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PrefixCounter(Vocabulary.load(path))
        for batch in found:
            tokens, fitting = [], []
            for cell in batch.column(1):
                n, characters = counter.within(cell.as_py() or "", budget)
                tokens.append(n)
                fitting.append(characters)
            columns = [batch.column(0), batch.column(2), pa.array(tokens, pa.int64()), pa.array(fitting, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_tokens", "budget_chars"])

    rows = _rows(docs, key, text).select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(batches, f"doc_id {kind}, n_bytes bigint, n_tokens bigint, budget_chars bigint")
