"""Substring dedup by relative Lempel-Ziv parsing: runs of 35 words that start anywhere else are removed.

A document is parsed against indexed blocks of reference text: a factor is a stretch that goes on word by word as one
stretch of the reference does. Words are places in one address space (a text's base address plus the word's number), so
"goes on" means the reference address grows by one. Equal stretches meet in a block because each window of 35 words is
filed under its anchor, the least hash of its 18-word runs, which depends on its words only; consecutive windows with one
anchor are a fragment. Anchors that occur at a single place hold no repeat and are dropped first. A task sorts its block's
windows into an index, looks each fragment's windows up, and extends factors greedily; windows that straddle a boundary
between factors are looked up like all others, so none is lost. Factors of 35 words or more are the spans to remove.

Anchors filed under by more than `HOT_ANCHOR` fragments (a passage in very many documents) are not gathered in a block:
their windows are counted by a partial aggregate instead, which finds the same factors. Exact copies are represented by
one text. Identities of windows are 128 bits, of texts 96 bits.

Defined cases: null, empty and blank texts have no words and lose none; texts under 35 words lose none; of exact copies all
lose all (each window also starts in another copy), repeated rows likewise; a null doc_id is carried; an empty table
gives an empty table; ties between sources go to the lowest address; only the columns named are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from registra.llm.words import WHITE_SPACE, Words, find_words, mix, rolling, sliding_minimum, text_slices, windows_inside
from registra.operators.held import held

WINDOW = 35
#: Words of an anchor; a window holds WINDOW - ANCHOR + 1 of them.
ANCHOR = 18
#: Fragments under one anchor that a block gathers at most.
HOT_ANCHOR = 1 << 15

#: A text's base address is its hash, cut so that adding a word's number cannot overflow.
ADDRESSES = (1 << 62) - 1

_KEY = ("k1", "k2")
_SECOND = np.uint64(0xA0761D6478BD642F)


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(F.col(key).alias("doc_id"), body.alias("text"), F.xxhash64(body).alias("k1"), F.crc32(body.cast("binary")).alias("k2"))


def _address(place: str) -> Column:
    return F.col("k1").bitwiseAND(F.lit(ADDRESSES)) + F.col(place)


def _fragments(words: Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fragments of a slice: number of the first window's first word, windows, anchor."""
    at = windows_inside(words.first, WINDOW)
    if not len(at):
        return at, at, np.zeros(0, dtype=np.int64)
    anchor, found_at = (x[at] for x in sliding_minimum(rolling(hashes, ANCHOR), WINDOW - ANCHOR + 1))
    # One occurrence of the anchor each: a text that repeats itself has fragments of one anchor at several places.
    begins = np.concatenate([[True], (found_at[1:] != found_at[:-1]) | (at[1:] != at[:-1] + 1)])
    places = np.flatnonzero(begins)
    return at[places], np.diff(np.append(places, len(at))), anchor[places].view(np.int64)


def _list(values: pa.Array, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), values)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per text: word count, digest of its words, and its fragments' anchors and places."""
    for batch in batches:
        counts, digests, anchors, places, sizes = [], [], [], [], []
        for _, _, bounds, data in text_slices(batch.column(1)):
            words = find_words(bounds, data, WHITE_SPACE)
            at, _, anchor = _fragments(words, words.hashes())
            text = np.searchsorted(words.first, at, side="right") - 1
            spaced, start, end = words.spaced()
            for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
                digests.append(hashlib.sha256(spaced[start[a] : end[b - 1]] if b > a else b"").hexdigest())
            counts.append(words.counts())
            anchors.append(anchor)
            places.append(at - words.first[text])
            sizes.append(np.bincount(text, minlength=len(bounds) - 1))
        flat = pa.StructArray.from_arrays([pa.array(_concat(anchors)), pa.array(_concat(places))], names=["anchor", "place"])
        columns = [batch.column(0), batch.column(2), batch.column(3), pa.array(_concat(counts)), pa.array(digests), _list(flat, _concat(sizes))]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "k1", "k2", "n_words", "whole_sha256", "anchors"])


def _concat(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([np.zeros(0, dtype=np.int64), *parts])


def _payload(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fragments with repeated anchors, with their windows' identities. Columns: text, k1, k2, places, hot."""
    for batch in batches:
        wanted, hot = batch.column(3), batch.column(4)
        for low, high, bounds, data in text_slices(batch.column(0)):
            words = find_words(bounds, data, WHITE_SPACE)
            hashes = words.hashes()
            at, size, anchor = _fragments(words, hashes)
            text = np.searchsorted(words.first, at, side="right") - 1
            chosen, heat = [], []
            for i in range(high - low):
                marks = np.asarray(wanted[low + i].as_py(), dtype=np.int64)
                heats = np.asarray(hot[low + i].as_py(), dtype=bool)
                order = np.argsort(marks)
                a, b = np.searchsorted(text, [i, i + 1])
                chosen.append(a + np.searchsorted(at[a:b] - words.first[i], marks[order]))
                heat.append(heats[order])
            picked = _concat(chosen).astype(np.int64)
            if not len(picked):
                continue
            start, count = at[picked], size[picked]
            window = np.repeat(start, count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
            first = rolling(hashes, WINDOW)[window].view(np.int64)
            second = rolling(mix(hashes ^ _SECOND), WINDOW)[window].view(np.int64)
            rows = pa.array(low + text[picked])
            columns = [pa.array(anchor[picked]), pa.array(np.concatenate(heat)), batch.column(1).take(rows), batch.column(2).take(rows)]
            columns += [pa.array(start - words.first[text[picked]]), _list(pa.array(first), count), _list(pa.array(second), count)]
            yield pa.RecordBatch.from_arrays(columns, names=["anchor", "hot", "k1", "k2", "place", "first", "second"])


def _factor_block(block: pa.Table) -> pa.RecordBatch:
    """Index a block's windows and factor its fragments: rows (k1, k2, start, windows, reference address)."""
    offsets = block["first"].combine_chunks().offsets.to_numpy()
    count = np.diff(offsets).astype(np.int64)
    first = block["first"].combine_chunks().flatten().to_numpy()
    second = block["second"].combine_chunks().flatten().to_numpy()
    k1, k2, place = (block[c].to_numpy() for c in ("k1", "k2", "place"))
    fragment = np.repeat(np.arange(len(count)), count)
    inside = np.arange(len(first)) - np.repeat(np.cumsum(count) - count, count)
    start = place[fragment] + inside
    address = (k1 & ADDRESSES)[fragment] + start
    order = np.lexsort((address, second, first))
    same = (first[order][1:] == first[order][:-1]) & (second[order][1:] == second[order][:-1])
    group = np.concatenate([[0], np.cumsum(~same)])
    begins = np.flatnonzero(np.concatenate([[True], ~same]))
    ends = np.append(begins[1:], len(order)) - 1
    lowest, highest = address[order][begins], address[order][ends]
    repeated = np.zeros(len(first), dtype=bool)
    repeated[order] = (lowest != highest)[group]
    source = np.empty(len(first), dtype=np.int64)
    source[order] = np.where(address[order] != lowest[group], lowest[group], highest[group])
    at = np.flatnonzero(repeated)
    goes_on = (at[1:] == at[:-1] + 1) & (fragment[at][1:] == fragment[at][:-1]) & (source[at][1:] == source[at][:-1] + 1)
    heads = np.flatnonzero(np.concatenate([[True], ~goes_on])) if len(at) else np.zeros(0, dtype=np.int64)
    head = at[heads]
    windows = np.diff(np.append(heads, len(at)))
    return pa.RecordBatch.from_arrays(
        [pa.array(k1[fragment[head]]), pa.array(k2[fragment[head]]), pa.array(start[head]), pa.array(windows), pa.array(source[head])],
        names=["k1", "k2", "start", "windows", "source"],
    )


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fragments arrive sorted by anchor; a block ends where an anchor does."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        anchor = batch.column(0).to_numpy()
        changes = np.flatnonzero(anchor[1:] != anchor[:-1]) + 1
        last = int(changes[-1]) if len(changes) else 0
        if waiting and len(anchor) and waiting[-1].column(0)[-1].as_py() != anchor[0]:
            yield _factor_block(pa.Table.from_batches(waiting))
            waiting = []
        if last:
            yield _factor_block(pa.Table.from_batches([*waiting, batch.slice(0, last)]))
            waiting = []
        if batch.num_rows > last:
            waiting.append(batch.slice(last))
    if waiting:
        yield _factor_block(pa.Table.from_batches(waiting))


def _hot_factors(fragments: DataFrame) -> DataFrame:
    """Factors of one window each, for anchors too frequent for a block."""
    pair = F.arrays_zip("first", "second")
    windows = fragments.select("k1", "k2", "place", F.posexplode(pair).alias("number", "window")).select(
        "k1", "k2", (F.col("place") + F.col("number")).alias("start"), "window.first", "window.second"
    )
    addressed = windows.withColumn("address", _address("start"))
    known = (
        addressed.groupBy("first", "second").agg(F.min("address").alias("low"), F.max("address").alias("high")).filter("low <> high")
    )
    found = addressed.join(known, ["first", "second"])
    source = F.when(F.col("address") != F.col("low"), F.col("low")).otherwise(F.col("high"))
    return found.select("k1", "k2", "start", F.lit(1).cast("long").alias("windows"), source.alias("source"))


def factors(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Parse a corpus against itself.

    Returns the sketch of every row (doc_id, k1, k2, n_words, whole_sha256, copies) and the factors of each text that has
    any: k1, k2, and `found`, an array of (start, windows, source).
    """
    keyed = _keyed(docs, key, text)
    kind = keyed.schema["doc_id"].dataType.simpleString()
    sketch = held(
        keyed.mapInArrow(
            _sketch,
            f"doc_id {kind}, k1 bigint, k2 bigint, n_words bigint, whole_sha256 string, anchors array<struct<anchor:bigint,place:bigint>>",
        ),
        "sketch",
    )
    filed = sketch.select("k1", "k2", F.explode("anchors").alias("a")).select("k1", "k2", "a.anchor", "a.place")
    address = _address("place")
    repeated = held(
        filed.groupBy("anchor")
        .agg(F.min(address).alias("low"), F.max(address).alias("high"), F.count("*").alias("n"))
        .filter("low <> high")
        .select("anchor", (F.col("n") > HOT_ANCHOR).alias("hot")),
        "anchors",
    )
    copies = sketch.groupBy(*_KEY).agg(F.min("doc_id").alias("chosen"), F.count("*").alias("copies"))
    marked = filed.join(repeated, "anchor")
    places = marked.groupBy(*_KEY).agg(F.collect_set(F.struct("place", "hot")).alias("marks"))
    marks = held(places.join(copies, list(_KEY)).select(*_KEY, "chosen", "marks"), "marks")
    chosen = keyed.join(marks, list(_KEY)).filter(F.col("doc_id").eqNullSafe(F.col("chosen")))
    fragments = held(
        chosen.select("text", "k1", "k2", "marks.place", "marks.hot").mapInArrow(
            _payload, "anchor bigint, hot boolean, k1 bigint, k2 bigint, place bigint, first array<bigint>, second array<bigint>"
        ),
        "fragments",
    )
    in_blocks = (
        fragments.filter("NOT hot")
        .select("anchor", "k1", "k2", "place", "first", "second")
        .repartition("anchor")
        .sortWithinPartitions("anchor")
        .mapInArrow(_blocks, "k1 bigint, k2 bigint, start bigint, windows bigint, source bigint")
    )
    parsed = in_blocks.unionByName(_hot_factors(fragments.filter("hot")))
    found = parsed.groupBy(*_KEY).agg(F.collect_set(F.struct("start", "windows", "source")).alias("found"))
    return sketch.drop("anchors").join(copies.drop("chosen"), list(_KEY)), held(found.join(copies.drop("copies"), list(_KEY)), "factors")


def spans_of(found: list[dict]) -> list[tuple[int, int, int]]:
    """Factors as spans of words (start, end, source address), a factor that goes on in the next fragment as one."""
    out: list[tuple[int, int, int]] = []
    for start, windows, source in sorted((f["start"], f["windows"], f["source"]) for f in found):
        if out and out[-1][1] - WINDOW + 1 == start and out[-1][2] + start - out[-1][0] == source:
            out[-1] = (out[-1][0], start + windows + WINDOW - 1, out[-1][2])
        else:
            out.append((start, start + windows + WINDOW - 1, source))
    return out


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        removed, kept, spans = [], [], []
        for low, high, bounds, data in text_slices(batch.column(0)):
            words = find_words(bounds, data, WHITE_SPACE)
            spaced, start, end = words.spaced()
            for i in range(high - low):
                a, b = int(words.first[i]), int(words.first[i + 1])
                own = spans_of(batch.column(3)[low + i].as_py())
                cover = np.zeros(b - a + 1, dtype=np.int64)
                np.add.at(cover, [s for s, _, _ in own], 1)
                np.add.at(cover, [e for _, e, _ in own], -1)
                stays = np.cumsum(cover[:-1]) == 0
                edge = np.diff(np.concatenate([[False], stays, [False]]).astype(np.int8))
                runs = zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True)
                kept.append(b" ".join(spaced[start[a + x] : end[a + y - 1]] for x, y in runs).decode())
                removed.append(int(b - a - stays.sum()))
                spans.append([{"start": s, "end": e, "source": r} for s, e, r in own])
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("source", pa.int64())]))
        columns = [batch.column(1), batch.column(2), pa.array(removed, pa.int64()), pa.array(kept, pa.string()), pa.array(spans, kind)]
        yield pa.RecordBatch.from_arrays(columns, names=["k1", "k2", "n_removed", "kept", "spans"])


def cleaned_texts(docs: DataFrame, found: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each text with factors, once: k1, k2, n_removed, `kept` (words left, joined by spaces) and merged `spans`."""
    chosen = _keyed(docs, key, text).join(found, list(_KEY)).filter(F.col("doc_id").eqNullSafe(F.col("chosen")))
    # Rows alike in doc_id and text are one text.
    return chosen.select("text", "k1", "k2", "found").dropDuplicates(list(_KEY)).mapInArrow(
        _remove, "k1 bigint, k2 bigint, n_removed bigint, kept string, spans array<struct<start:bigint,end:bigint,source:bigint>>"
    )


def removals(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, n_removed and kept_sha256, the digest of the words left, joined by spaces."""
    sketch, found = factors(docs, key, text)
    cleaned = held(
        cleaned_texts(docs, found, key, text).select("k1", "k2", "n_removed", F.sha2("kept", 256).alias("kept_sha256")), "removals"
    )
    # Each window of a text with copies also starts in a copy.
    whole = (F.col("copies") > 1) & (F.col("n_words") >= WINDOW)
    return sketch.join(cleaned, list(_KEY), "left").select(
        "doc_id",
        "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "whole_sha256")).alias("kept_sha256"),
    )
