"""Benchmark decontamination: an FM-index per training shard, searched backwards for the test phrases.

A task cuts its documents into shards. A shard's words become symbols: one for each word the test items use, a separator for
all others. Runs between separators that are shorter than the shortest phrase cannot hold one and are left out; the
rest is indexed: suffix array by prefix doubling, Burrows-Wheeler transform, wavelet matrix for ranks, and every few suffix
positions kept. All phrases are searched at once, last word first, by wavelet ranks; occurrences are located by stepping
back to a kept position; their spans are merged into removal spans. Phrases are windows of `WINDOW` consecutive item
words, or the whole of a shorter item.

The test set goes to the workers in blocks of bounded size, one pass over the documents each, so it may grow too.

Defined cases: null, empty and wordless texts and items have no words and never match; repeated rows are searched one by
one; repeated or null item_ids count once each by their text form (null ones are never named); an empty table on
either side gives documents without hits; ties cannot occur; columns of the documents are carried in a struct.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from registra.llm.words import NOT_ALPHANUMERIC, Words, find_words, text_slices
from registra.operators.held import held

WINDOW = 10
#: Bytes of test items sent to the workers at once.
BLOCK_BYTES = 4 << 20
#: Every so many-th position of a shard is kept for locating.
KEPT = 8


@dataclass
class Phrases:
    """Test phrases over the words of the items: `symbols` are sorted word hashes; phrases of one length per matrix."""

    symbols: np.ndarray
    by_length: dict[int, np.ndarray]
    #: Per length, the item of each (phrase, item) pair, ordered by phrase, and where each phrase's pairs start.
    items: dict[int, tuple[np.ndarray, np.ndarray]]
    names: list[str]

    @classmethod
    def of(cls, names: list[str], texts: list[str | None], window: int = WINDOW) -> Phrases:
        rows = []
        for low, high, bounds, data in text_slices(pa.array(texts, pa.large_string())):
            words = find_words(bounds, data, NOT_ALPHANUMERIC, lower=True)
            hashes = words.hashes()
            for i in range(high - low):
                rows.append((low + i, hashes[words.first[i] : words.first[i + 1]]))
        symbols = np.unique(np.concatenate([h for _, h in rows])) if rows else np.zeros(0, np.uint64)
        found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for item, hashes in rows:
            if len(hashes):
                size = min(window, len(hashes))
                places = np.searchsorted(symbols, hashes) + 1
                view = np.lib.stride_tricks.sliding_window_view(places, size)
                found.setdefault(size, []).append((view, np.full(len(view), item)))
        by_length, items = {}, {}
        for size, parts in found.items():
            phrases, of = np.unique(np.concatenate([v for v, _ in parts]), axis=0, return_inverse=True)
            pairs = np.unique(np.stack([of.ravel(), np.concatenate([i for _, i in parts])], axis=1), axis=0)
            by_length[size] = phrases
            items[size] = (pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(phrases) + 1)))
        return cls(symbols, by_length, items, names)


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Suffixes in order, by prefix doubling. Each separator (0) is smaller than all words and different from the others."""
    n = len(symbols)
    separators = np.flatnonzero(symbols == 0)
    rank = symbols + len(separators)
    rank[separators] = np.arange(len(separators))
    order = np.argsort(rank, kind="stable")
    width = 1
    new = np.concatenate([[True], rank[order][1:] != rank[order][:-1]])
    while True:
        group = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        rank[order] = group
        alone = new & np.concatenate([new[1:], [True]])
        open_places = np.flatnonzero(~alone)
        if not len(open_places):
            return order
        # Only suffixes still tied are sorted further, by what follows their common part.
        tied = order[open_places]
        following = np.where(tied + width < n, rank[np.minimum(tied + width, n - 1)] + 1, 0)
        finer = np.lexsort((following, group[open_places]))
        order[open_places] = tied[finer]
        sorted_following = following[finer]
        same = (group[open_places][1:] == group[open_places][:-1]) & (sorted_following[1:] == sorted_following[:-1])
        new[open_places] = np.concatenate([[True], ~same])
        width *= 2


class WaveletMatrix:
    """Ranks of symbols: `rank(symbol, place)` is how often a symbol occurs before a place, for whole arrays at once."""

    def __init__(self, values: np.ndarray, bits: int) -> None:
        self.bits = bits
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        for level in range(bits - 1, -1, -1):
            bit = (values >> level & 1).astype(bool)
            self.ones.append(np.concatenate([[0], np.cumsum(bit, dtype=np.int64)]))
            self.zeros.append(int(len(bit) - self.ones[-1][-1]))
            values = np.concatenate([values[~bit], values[bit]])

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        start = np.zeros_like(place)
        for level, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            bit = (symbol >> (self.bits - 1 - level) & 1).astype(bool)
            start = np.where(bit, zeros + ones[start], start - ones[start])
            place = np.where(bit, zeros + ones[place], place - ones[place])
        return place - start


class FMIndex:
    """Backward search and location over a sequence of symbols (0 separates)."""

    def __init__(self, symbols: np.ndarray) -> None:
        order = suffix_array(symbols)
        self.transform = symbols[order - 1]
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(symbols))])
        self.ranks = WaveletMatrix(self.transform, max(int(symbols.max()).bit_length(), 1))
        # Kept are every few positions and all that follow a separator, so that no step back crosses one.
        kept = (order % KEPT == 0) | (self.transform == 0)
        self.kept_before = np.concatenate([[0], np.cumsum(kept)])
        self.kept = kept
        self.positions = order[kept]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of suffixes that start with each phrase (rows of equal length), found from the last word to the first."""
        low = np.zeros(len(phrases), dtype=np.int64)
        high = np.full(len(phrases), len(self.transform), dtype=np.int64)
        asked = np.arange(len(phrases))
        known = phrases.max(axis=1) + 1 < len(self.smaller)
        high[~known] = 0
        asked = asked[known]
        for column in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[asked, column]
            base = self.smaller[symbol]
            low[asked] = base + self.ranks.rank(symbol, low[asked])
            high[asked] = base + self.ranks.rank(symbol, high[asked])
            asked = asked[low[asked] < high[asked]]
        return low, np.maximum(high, low)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes, by steps back to a kept position."""
        position, steps = np.empty(len(rows), dtype=np.int64), 0
        waiting, rows = np.arange(len(rows)), rows.copy()
        while len(waiting):
            at = rows[waiting]
            here = self.kept[at]
            position[waiting[here]] = self.positions[self.kept_before[at[here]]] + steps
            waiting, at = waiting[~here], at[~here]
            symbol = self.transform[at]
            rows[waiting] = self.smaller[symbol] + self.ranks.rank(symbol, at)
            steps += 1
        return position


def shard_symbols(words: Words, hashes: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """The shard's sequence of symbols and, for each, its word's number; -1 for separators."""
    shortest = min(phrases.by_length)
    place = np.searchsorted(phrases.symbols, hashes)
    place[place == len(phrases.symbols)] = 0
    known = phrases.symbols[place] == hashes
    starts_text = np.zeros(len(hashes) + 1, dtype=bool)
    starts_text[words.first] = True
    first = np.flatnonzero(known & (np.concatenate([[True], ~known[:-1]]) | starts_text[:-1]))
    last = np.flatnonzero(known & (np.concatenate([~known[1:], [True]]) | starts_text[1:])) + 1
    long = last - first >= shortest
    first, size = first[long], (last - first)[long]
    # Each run is followed by one separator.
    ends = np.cumsum(size + 1)
    symbols = np.zeros(int(ends[-1]) if len(ends) else 0, dtype=np.int64)
    number = np.full(len(symbols), -1, dtype=np.int64)
    offset = np.repeat(first - (ends - size - 1), size)
    inside = np.ones(len(symbols), dtype=bool)
    inside[ends - 1] = False
    places = np.flatnonzero(inside)
    number[places] = places + offset
    symbols[places] = place[number[places]] + 1
    return symbols, number


def search_shard(words: Words, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Occurrences in a shard as arrays (first word, length in words, item): one entry for each item with the phrase."""
    nothing = np.zeros(0, dtype=np.int64)
    if not phrases.by_length or not len(words):
        return nothing, nothing, nothing
    symbols, number = shard_symbols(words, words.hashes(), phrases)
    if not len(symbols):
        return nothing, nothing, nothing
    index = FMIndex(symbols)
    starts, lengths, items = [], [], []
    for size, rows in phrases.by_length.items():
        low, high = index.search(rows)
        count = high - low
        phrase = np.repeat(np.arange(len(rows)), count)
        suffix = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
        at = number[index.locate(suffix)]
        of, first = phrases.items[size]
        pairs = first[phrase + 1] - first[phrase]
        starts.append(np.repeat(at, pairs))
        lengths.append(np.full(int(pairs.sum()), size))
        items.append(of[np.arange(int(pairs.sum())) - np.repeat(np.cumsum(pairs) - pairs, pairs) + np.repeat(first[phrase], pairs)])
    return np.concatenate(starts), np.concatenate(lengths), np.concatenate(items)


def _merged(start: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """Union of spans, as spans in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(set(zip(start.tolist(), end.tolist(), strict=True))):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_FOUND = "n_words bigint, hits array<struct<start:bigint,end:bigint>>, items array<string>"


def _pass(docs: DataFrame, phrases: Phrases) -> DataFrame:
    """One pass for one block of items over (`row`, `body`); adds what it found to `passes`."""
    shared = docs.sparkSession.sparkContext.broadcast(phrases)

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        for batch in found:
            counts, spans, names = [], [], []
            for low, high, bounds, data in text_slices(batch.column("body")):
                words = find_words(bounds, data, NOT_ALPHANUMERIC, lower=True)
                counts.append(words.counts())
                start, length, item = search_shard(words, block)
                text = np.searchsorted(words.first, start, side="right") - 1
                order = np.argsort(text, kind="stable")
                cut = np.searchsorted(text[order], np.arange(high - low + 1))
                for i in range(high - low):
                    rows = order[cut[i] : cut[i + 1]]
                    begin = start[rows] - words.first[i]
                    spans.append([{"start": a, "end": b} for a, b in _merged(begin, begin + length[rows])] if len(rows) else [])
                    named = sorted({block.names[k] for k in set(item[rows].tolist())} - {None}) if len(rows) else []
                    names.append(named)
            columns = [batch.column("row"), pa.array(np.concatenate([np.zeros(0, np.int64), *counts]), pa.int64())]
            columns += [pa.array(spans, _SPANS), pa.array(names, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "n_words", "hits", "items"])

    return docs.select("row", "body").mapInArrow(batches, f"row {docs.schema['row'].dataType.simpleString()}, {_FOUND}")


def contamination(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """`docs` as a struct `row`, with `n_words`, merged removal spans `hits` (word numbers, end exclusive) and `items`."""
    tests = benchmark.select(F.col(item).cast("string").alias("item"), F.col(item_text).alias("text"))
    volume = tests.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-volume // block_bytes))
    block = F.pmod(F.xxhash64("text"), F.lit(blocks))
    found = None
    for number in range(blocks):
        # A block is a bounded share of the items; what an earlier pass found is written and carried along.
        rows = tests.filter(block == number).collect() if blocks > 1 else tests.collect()
        phrases = Phrases.of([r["item"] for r in rows], [r["text"] for r in rows])
        if found is None:
            source = docs.select(F.struct("*").alias("row"))
            found = _pass(source.select("row", F.col(f"row.`{text}`").cast("string").alias("body")), phrases)
            continue
        before = held(found, "contamination").select(F.struct("row", "hits", "items").alias("row"))
        again = _pass(before.select("row", F.col(f"row.row.`{text}`").cast("string").alias("body")), phrases)
        ordered = F.array_sort(F.concat("row.hits", "hits"))
        merged = F.aggregate(
            ordered,
            F.array().cast("array<struct<start:bigint,end:bigint>>"),
            lambda done, x: F.when(
                (F.size(done) > 0) & (x["start"] <= F.get(done, F.size(done) - 1)["end"]),
                F.concat(
                    F.slice(done, F.lit(1), F.size(done) - 1),
                    F.array(
                        F.struct(
                            F.get(done, F.size(done) - 1)["start"].alias("start"),
                            F.greatest(F.get(done, F.size(done) - 1)["end"], x["end"]).alias("end"),
                        )
                    ),
                ),
            ).otherwise(F.concat(done, F.array(x))),
        )
        found = again.select(
            F.col("row.row").alias("row"), "n_words", merged.alias("hits"), F.array_sort(F.array_union("row.items", "items")).alias("items")
        )
    return found
