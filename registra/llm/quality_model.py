"""Quality classifier: n-gram indicators scaled by class log-count ratios, and a linear hinge-loss model on top.

Features are hashed to a fixed number of places: byte trigrams, words and word pairs, present or absent, and levels of a
text's length and of words that follow themselves. Class counts of
every feature cover all labelled training rows and are summed in Spark; the ratio of their smoothed shares, as a logarithm,
scales the indicators, and each document's vector has length 1. The hinge-loss model is fitted by dual coordinate descent
on a bounded sample of labelled rows (`SAMPLE_ROWS`, those with the lowest hash of their key); a part of the sample the
descent does not see turns margins into probabilities with a logistic curve. Scoring is one pass over whole texts; the model
is two arrays of `PLACES` numbers.

Defined cases: a null or empty text has the levels of an empty text as its only features; labels of one key are averaged, and
null labels or keys teach nothing; without labels of both classes every score is the share of good labels (0.5 without
any); repeated rows are scored one by one; an empty table gives an empty table; only the columns named are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from registra.llm.joins import join_by_size
from registra.llm.words import WHITE_SPACE, find_words, mix, rolling, text_slices, windows_inside
from registra.operators.held import held

#: Places that features are hashed to.
PLACES = 1 << 17
#: Labelled rows the hinge-loss model is fitted on, at most. Class counts cover all of them.
SAMPLE_ROWS = 4096
#: One in so many sample rows is kept for the logistic curve.
CURVE_SHARE = 4
EPOCHS = 20
COST = 4.0
SMOOTHING = 1.0

_TEXTS = 64
_SHIFT = np.uint64(64 - PLACES.bit_length() + 1)


def features(bounds: np.ndarray, data: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Distinct places of each text, some texts at a time: first text, places, and where each text's places start."""
    words = find_words(bounds, data, WHITE_SPACE)
    hashes = words.hashes()
    wide = data.astype(np.uint64)
    trigrams = (wide[:-2] << np.uint64(16) | wide[1:-1] << np.uint64(8) | wide[2:]) if len(wide) > 2 else wide[:0]
    trigrams = (mix(trigrams + np.uint64(1)) >> _SHIFT).astype(np.int64)
    single = (mix(hashes ^ np.uint64(0x51)) >> _SHIFT).astype(np.int64)
    double = (rolling(hashes, 2) >> _SHIFT).astype(np.int64) if len(hashes) else single
    pairs = windows_inside(words.first, 2)
    pair_first = np.searchsorted(pairs, words.first)
    # How long a text is and how often a word follows itself, by powers of two: two more indicators a text.
    again = np.concatenate([[0], np.cumsum(hashes[pairs] == hashes[pairs + 1])]) if len(pairs) else np.zeros(1, dtype=np.int64)
    repeats = again[pair_first[1:]] - again[pair_first[:-1]]
    levels = np.stack([np.frexp(words.counts())[1], 64 + np.frexp(repeats)[1], 128 + 16 * repeats // np.maximum(words.counts(), 1)])
    levels = (mix(levels.astype(np.uint64) + np.uint64(1 << 32)) >> _SHIFT).astype(np.int64)
    for low in range(0, len(bounds) - 1, _TEXTS):
        high = min(low + _TEXTS, len(bounds) - 1)
        present = np.zeros((high - low, PLACES), dtype=bool)
        for i in range(low, high):
            own = present[i - low]
            own[levels[:, i]] = True
            own[trigrams[bounds[i] : max(bounds[i + 1] - 2, bounds[i])]] = True
            own[single[words.first[i] : words.first[i + 1]]] = True
            own[double[pairs[pair_first[i] : pair_first[i + 1]]]] = True
        flat = np.flatnonzero(present)
        yield low, flat & (PLACES - 1), np.searchsorted(flat, np.arange(high - low + 1) * PLACES)


@dataclass
class Model:
    """`value` is ratio times weight, `ratio` scales a text's vector to length 1; the curve is 1/(1+exp(-(a*margin+b)))."""

    value: np.ndarray
    ratio: np.ndarray
    bias: float
    slope: float
    shift: float

    def margins(self, places: np.ndarray, first: np.ndarray) -> np.ndarray:
        sums = [np.concatenate([[0.0], np.cumsum(x[places])]) for x in (self.value, self.ratio**2)]
        total, square = (s[first[1:]] - s[first[:-1]] for s in sums)
        return total / np.sqrt(np.maximum(square, 1e-12)) + self.bias

    def scores(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.shift, -500, 500)))


def descend(rows: list[np.ndarray], ratio: np.ndarray, good: np.ndarray, epochs: int = EPOCHS, cost: float = COST) -> tuple[np.ndarray, float]:
    """Weights and bias of the hinge-loss model: one dual variable at a time, in a seeded order, within its box."""
    weight, bias = np.zeros(len(ratio)), 0.0
    dual = np.zeros(len(rows))
    norms = [np.sqrt(max(float((ratio[r] ** 2).sum()), 1e-12)) for r in rows]
    sign = np.where(good, 1.0, -1.0)
    box = np.full(len(rows), cost)
    order = np.random.default_rng(7)
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(rows)):
            x = ratio[rows[i]] / norms[i]
            gradient = sign[i] * (float(weight[rows[i]] @ x) + bias) - 1
            # A vector has length 1, and the bias is one more feature of value 1.
            new = min(max(dual[i] - gradient / 2, 0.0), box[i])
            step = (new - dual[i]) * sign[i]
            if step:
                weight[rows[i]] += step * x
                bias += step
                dual[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return weight, bias


def logistic_curve(margins: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the probability of a good text, by Newton steps; targets are smoothed so that both stay finite."""
    n1, n0 = good.sum(), (~good).sum()
    target = np.where(good, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    slope, shift = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(slope * margins + shift, -500, 500)))
        error, spread = p - target, np.maximum(p * (1 - p), 1e-12)
        gradient = np.array([(error * margins).sum() + 1e-6 * slope, error.sum()])
        curve = np.array([[(spread * margins**2).sum() + 1e-6, (spread * margins).sum()], [(spread * margins).sum(), spread.sum() + 1e-9]])
        step = np.linalg.solve(curve, gradient)
        step *= min(1.0, 5.0 / max(float(np.abs(step).max()), 1e-12))
        slope, shift = slope - float(step[0]), shift - float(step[1])
        if np.abs(step).max() < 1e-7:
            break
    return max(slope, 1e-3), shift


def _class_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((2, PLACES), dtype=np.int64)
    for batch in batches:
        good = np.asarray(batch.column(1)).astype(bool)
        for row, _, bounds, data in text_slices(batch.column(0)):
            for low, places, first in features(bounds, data):
                label = np.repeat(good[row + low : row + low + len(first) - 1], np.diff(first))
                for side in (0, 1):
                    counts[side] += np.bincount(places[label == bool(side)], minlength=PLACES)
    place = np.flatnonzero(counts.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(counts[0][place]), pa.array(counts[1][place])], names=["place", "bad", "good"])


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[np.ndarray] = []
        for _, _, bounds, data in text_slices(batch.column(0)):
            for _, places, first in features(bounds, data):
                rows.extend(np.split(places.astype(np.int32), first[1:-1]))
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.int32())), batch.column(1), batch.column(2)], names=["places", "good", "turn"])


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "label") -> Model:
    """Fit on the rows of `docs` that `labels` (key, label 0 or 1) covers."""
    known = labels.select(F.col(key).alias("key"), F.col(label).alias("label")).dropna()
    known = held(known.groupBy("key").agg((F.avg("label") >= 0.5).alias("good")), "labels")
    texts = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    total = known.agg(F.count("*").alias("n"), F.count_if("good").alias("good")).first()
    labelled = join_by_size(texts, known, ["key"], 32 * total["n"])
    counted = labelled.select("text", "good").mapInArrow(_class_counts, "place bigint, bad bigint, good bigint")
    # At most one row for each of the places comes back.
    summed = counted.groupBy("place").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).toPandas()
    counts = np.full((2, PLACES), SMOOTHING)
    counts[0][summed["place"]] += summed["bad"]
    counts[1][summed["place"]] += summed["good"]
    share = counts / counts.sum(axis=1, keepdims=True)
    ratio = np.log(share[1] / share[0]).astype(np.float32)
    nothing = np.zeros(PLACES, dtype=np.float32)
    if not 0 < total["good"] < total["n"]:
        odds = np.log((total["good"] + 1) / (total["n"] - total["good"] + 1))
        return Model(nothing, ratio, 0.0, 1.0, float(odds))
    turn = F.xxhash64("key")
    chosen = known.orderBy(turn, "key").limit(SAMPLE_ROWS)
    vectors = held(
        join_by_size(texts, chosen, ["key"], 32 * SAMPLE_ROWS)
        .select("text", "good", turn.alias("turn"))
        .mapInArrow(_vectors, "places array<int>, good boolean, turn bigint"),
        "sample",
    )

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, good, order = [], [], []
        for batch in batches:
            rows.extend(np.asarray(r.values) for r in batch.column(0))
            good.append(np.asarray(batch.column(1)).astype(bool))
            order.append(np.asarray(batch.column(2)))
        sides, turns = np.concatenate(good), np.concatenate(order)
        sort = np.argsort(turns, kind="stable")
        rows, sides = [rows[i] for i in sort], sides[sort]
        curve = np.arange(len(rows)) % CURVE_SHARE == 0
        if len({*sides[curve].tolist()}) < 2 or len({*sides[~curve].tolist()}) < 2:
            curve[:] = False
        wide = ratio.astype(np.float64)
        weight, bias = descend([r for r, c in zip(rows, curve, strict=True) if not c], wide, sides[~curve])
        seen = curve if curve.any() else ~curve
        own = [r for r, c in zip(rows, seen, strict=True) if c]
        model = Model(wide * weight, wide, bias, 1.0, 0.0)
        slope, shift = logistic_curve(model.margins(np.concatenate(own), np.concatenate([[0], np.cumsum([len(r) for r in own])])), sides[seen])
        value = pa.array([(wide * weight).astype(np.float32)], pa.list_(pa.float32()))
        yield pa.RecordBatch.from_arrays([value, *[pa.array([x]) for x in (bias, slope, shift)]], names=["value", "bias", "slope", "shift"])

    # The sample is bounded: one task fits it, and PLACES numbers come back.
    row = vectors.coalesce(1).mapInArrow(fitted, "value array<float>, bias double, slope double, shift double").first()
    if row is None:
        return Model(nothing, ratio, 0.0, 1.0, 0.0)
    return Model(np.asarray(row["value"], dtype=np.float32), ratio, row["bias"], row["slope"], row["shift"])


def scores(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`doc_id` and `score` (probability of label 1) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in found:
            out = [np.zeros(0)]
            for _, _, bounds, data in text_slices(batch.column(1)):
                out.extend(own.scores(own.margins(places, first)) for _, places, first in features(bounds, data))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(out))], names=["doc_id", "score"])

    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(batches, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")
