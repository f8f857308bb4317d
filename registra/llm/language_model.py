"""A bigram language model with interpolated modified Kneser-Ney smoothing, counted in Spark and scored from mapped arrays.

Tokens are words by their 64-bit hash, plus one end per text. A first pass counts tokens; the sorted hashes are the
vocabulary and a word's place is its number. A second pass counts bigrams: each task merges its own, and sends sorted runs
to the part of their context, where they are summed. A part holds a bounded number of tokens: parts grow in number with
the corpus and a frequent context is spread over several by its next word. From the parts come the contexts' totals and
their numbers of words seen once, twice and more, the words' continuation counts, and counts of counts for the
discounts. Parts are sorted key arrays in the shared folder; scoring tasks map them and look up sorted, distinct keys.

p(w|u) = max(c(uw) - D(c), 0) / c(u) + g(u) p1(w), p1(w) = max(k(w) - D'(k), 0) / K + g' / (V + 1), where k counts contexts,
g is the mass the discounts free, and an unknown word has k = 0. A context never seen has g = 1.

Defined cases: null, empty and blank texts are one end; repeated rows count as often as they occur; without training rows
all probabilities are 1 over the one unknown word; an empty table gives an empty table; ties cannot occur; only the
columns named are read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from registra.llm.sorted_arrays import SortedArrays, write_part
from registra.llm.words import WHITE_SPACE, find_words, mix, text_slices
from registra.operators.held import held, run_folder

#: Tokens per part of the bigram table, and per share of one context.
PART_TOKENS = 2_000_000
#: Words per part of the word tables.
PART_WORDS = 2_000_000
#: Distinct keys a counting task gathers before it sends them on.
GATHERED = 3_000_000
#: Bytes of text scored together.
SCORED_BYTES = 8 << 20

#: The end of a text as a word hash, and the start as a context number (words are numbered from 1).
END = np.uint64(0x5851F42D4C957F2D)
START = 0


def _tokens(bounds: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a slice's tokens with an end after each text, and where each text's tokens start."""
    words = find_words(bounds, data, WHITE_SPACE, lower=True)
    texts = len(bounds) - 1
    first = words.first + np.arange(texts + 1)
    tokens = np.full(len(words) + texts, END, dtype=np.uint64)
    tokens[np.arange(len(words)) + words.text_of_word()] = words.hashes()
    return tokens, first


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with their counts added up."""
    if not keys:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    begins = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, dtype=np.int64)
    return key[begins], np.add.reduceat(count, begins) if len(begins) else count


class _Gathering:
    """Counts of a task, handed on whenever they hold many distinct keys."""

    def __init__(self) -> None:
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.size = 0

    def add(self, keys: np.ndarray) -> bool:
        found, count = np.unique(keys, return_counts=True)
        self.keys.append(found)
        self.counts.append(count)
        self.size += len(found)
        if self.size > GATHERED:
            self.keys, self.counts = ([x] for x in _summed(self.keys, self.counts))
            self.size = len(self.keys[0])
        return 2 * self.size > GATHERED

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        out = _summed(self.keys, self.counts)
        self.__init__()
        return out


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    gathered = _Gathering()

    def rows() -> pa.RecordBatch:
        keys, counts = gathered.take()
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], names=["word", "n"])

    for batch in batches:
        for _, _, bounds, data in text_slices(batch.column(0)):
            if gathered.add(_tokens(bounds, data)[0]):
                yield rows()
    yield rows()


@dataclass
class Vocabulary:
    """The word table: parts by ranges of hashes. `first` are the parts' first hashes, `offset` their first numbers."""

    folder: str
    first: np.ndarray
    offset: np.ndarray
    tokens: int
    words: int

    def numbers(self, hashes: np.ndarray, table: SortedArrays) -> tuple[np.ndarray, np.ndarray]:
        """Numbers (0 if unknown) and training counts of sorted, distinct hashes (signed)."""
        number, count = np.zeros(len(hashes), dtype=np.int64), np.zeros(len(hashes), dtype=np.int64)
        part = np.searchsorted(self.first, hashes, side="right") - 1
        for p in np.unique(part[part >= 0]).tolist():
            rows = np.flatnonzero(part == p)
            place, there = table.find(p, hashes[rows])
            rows, place = rows[there], place[there]
            number[rows] = self.offset[p] + place + 1
            count[rows] = table.values(p, "count", place)
        return number, count


def _vocabulary(counts: DataFrame, folder: str) -> Vocabulary:
    size = counts.agg(F.count("*").alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in found if b.num_rows]
        if not parts:
            return
        table = pa.Table.from_batches(parts)
        keys, part = table["word"].to_numpy(), TaskContext.get().partitionId()
        write_part(folder, part, keys, count=table["n"].to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array(keys[:1]), pa.array([len(keys)])], names=["part", "first", "size"])

    parts = 1 + size["v"] // PART_WORDS
    written = counts.repartitionByRange(parts, "word").sortWithinPartitions("word").mapInArrow(batches, "part bigint, first bigint, size bigint")
    # One row a part comes back.
    rows = sorted(held(written, "vocabulary").collect(), key=lambda r: r["first"])
    first = np.full(1 + max((r["part"] for r in rows), default=-1), np.iinfo(np.int64).max)
    offset = np.zeros(len(first), dtype=np.int64)
    before = 0
    for r in rows:
        first[r["part"]], offset[r["part"]], before = r["first"], before, before + r["size"]
    # Ranges without words take the next range's place, so that a search over `first` never lands there.
    return Vocabulary(folder, np.minimum.accumulate(first[::-1])[::-1], offset, size["n"], size["v"])


def _shares(keys: np.ndarray, context_counts: np.ndarray, parts: int) -> np.ndarray:
    """Part of each bigram key: by its context, and for frequent contexts by its word as well."""
    context, word = keys >> 32, keys & 0xFFFFFFFF
    shares = 1 + context_counts // PART_TOKENS
    return (mix((context * 1_000_003 + word % shares).astype(np.uint64)) % np.uint64(parts)).astype(np.int64)


def _pairs(tokens: np.ndarray, first: np.ndarray, vocabulary: Vocabulary, table: SortedArrays) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per token: its bigram key, its number, its training count, and its context's training count (0 for the start)."""
    distinct, back = np.unique(tokens.view(np.int64), return_inverse=True)
    numbers, counts = vocabulary.numbers(distinct, table)
    number, count = numbers[back], counts[back]
    context = np.concatenate([[START], number[:-1]])
    before = np.concatenate([[0], count[:-1]])
    starts = first[:-1]
    context[starts], before[starts] = START, 0
    # Unknown contexts get a number of their own, which no part holds.
    unknown = (context == 0) & ~np.isin(np.arange(len(number)), starts)
    context[unknown] = vocabulary.words + 1
    return context << 32 | number, number, count, before


def _packed(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """A sorted run as bytes: steps between keys and counts, by byte planes, compressed."""
    steps = np.diff(keys, prepend=0)
    planes = np.stack([steps, counts]).astype("<i8").view(np.uint8).reshape(-1, 8).T
    return len(keys).to_bytes(8, "little") + pa.compress(np.ascontiguousarray(planes).tobytes(), codec="zstd", asbytes=True)


def _unpacked(run: bytes) -> tuple[np.ndarray, np.ndarray]:
    size = int.from_bytes(run[:8], "little")
    planes = np.frombuffer(pa.decompress(run[8:], decompressed_size=16 * size, codec="zstd", asbytes=True), dtype=np.uint8)
    steps, counts = np.ascontiguousarray(planes.reshape(8, -1).T).view("<i8").reshape(2, size)
    return np.cumsum(steps), counts


def _discounts(counts_of_counts: list[int]) -> np.ndarray:
    """Discounts for counts of 0, 1, 2 and more, from how many keys were counted 1, 2, 3 and 4 times."""
    n1, n2, n3, n4 = (max(n, 1) for n in counts_of_counts)
    y = n1 / (n1 + 2 * n2)
    return np.array([0.0, *np.clip([1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3], 0.05, [0.95, 1.95, 2.95])])


@dataclass
class Model:
    """What a scoring task needs besides the mapped arrays."""

    vocabulary: Vocabulary
    bigrams: str
    parts: int
    filled: np.ndarray
    statistics: str
    ranges: np.ndarray
    discounts: np.ndarray
    unknown: float


def fit(training: DataFrame, text: str = "text") -> Model:
    """Count `training` and write the model's arrays to the shared folder."""
    spark = training.sparkSession
    home = f"{run_folder(spark)}/model-{uuid.uuid4().hex}"
    if "://" not in home and not home.startswith("file:"):
        home = f"file://{home}"
    texts = training.select(F.col(text).cast("string").alias("text"))
    counted = texts.mapInArrow(_count_words, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    vocabulary = _vocabulary(held(counted, "words"), f"{home}/words")
    parts = 1 + vocabulary.tokens // PART_TOKENS

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, gathered, shares = SortedArrays(vocabulary.folder), _Gathering(), {}

        def runs() -> pa.RecordBatch:
            keys, counts = gathered.take()
            heads = np.flatnonzero(np.concatenate([[True], keys[1:] >> 32 != keys[:-1] >> 32])) if len(keys) else np.zeros(0, np.int64)
            frequency = np.array([shares.get(int(u), 0) for u in (keys[heads] >> 32).tolist()], dtype=np.int64)
            part = _shares(keys, np.repeat(frequency, np.diff(np.append(heads, len(keys)))), parts)
            order = np.argsort(part, kind="stable")
            cuts = np.searchsorted(part[order], np.arange(parts + 1))
            own = [p for p in range(parts) if cuts[p] < cuts[p + 1]]
            blobs = [_packed(keys[rows], counts[rows]) for rows in (order[cuts[p] : cuts[p + 1]] for p in own)]
            return pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(blobs, pa.binary())], names=["part", "run"])

        for batch in batches:
            for _, _, bounds, data in text_slices(batch.column(0), SCORED_BYTES):
                keys, _, _, before = _pairs(*_tokens(bounds, data), vocabulary, table)
                often = before >= PART_TOKENS
                shares.update(zip((keys[often] >> 32).tolist(), before[often].tolist(), strict=True) if often.any() else ())
                if gathered.add(keys):
                    yield runs()
        yield runs()

    def sum_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows arrive sorted by part. Out: kind 0 contexts (total, words seen once, twice, more), 1 words' contexts, 2 counts of counts, 3 the part."""
        waiting: list[bytes] = []
        current = None

        def finish() -> Iterator[pa.RecordBatch]:
            runs = [_unpacked(r) for r in waiting]
            keys, counts = _summed([k for k, _ in runs], [c for _, c in runs])
            write_part(f"{home}/pairs", current, keys, count=counts.astype(np.min_scalar_type(int(counts.max(initial=0)))))
            if not len(keys):
                return
            context, word = keys >> 32, keys & 0xFFFFFFFF
            heads = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
            columns = [np.add.reduceat(x, heads) for x in (counts, counts == 1, counts == 2, counts > 2)]
            yield _statistic(0, context[heads], *columns)
            yield _statistic(1, *np.unique(word, return_counts=True))
            yield _statistic(2, np.array([0]), *[np.array([(counts == k).sum()]) for k in (1, 2, 3, 4)])
            yield _statistic(3, np.array([current]))

        for batch in batches:
            for part, run in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if part != current:
                    if waiting:
                        yield from finish()
                    current, waiting = part, []
                waiting.append(run)
        if waiting:
            yield from finish()

    schema = "kind bigint, id bigint, a bigint, b bigint, c bigint, d bigint"
    runs = texts.mapInArrow(count_pairs, "part bigint, run binary")
    partial = runs.repartition("part").sortWithinPartitions("part").mapInArrow(sum_parts, schema)
    # Written, because parts are: a later look at the sums must not count again.
    sums = held(partial, "sums")
    ids = held(sums.groupBy("kind", "id").agg(*[F.sum(c).alias(c) for c in "abcd"]), "statistics")
    seen = ids.filter("kind = 2").select(*"abcd").first()
    discounts = _discounts([seen[c] for c in "abcd"] if seen else [0] * 4)
    words = ids.filter("kind = 1")
    kept = words.agg(F.coalesce(F.sum("a"), F.lit(0)), *[F.count_if(F.col("a") == k) for k in (1, 2, 3, 4)], F.count_if(F.col("a") > 2)).first()
    lower = _discounts(list(kept[1:5]))
    distinct = kept[0]
    freed = float(lower[1] * kept[1] + lower[2] * kept[2] + lower[3] * kept[5]) / distinct if distinct else 1.0
    unknown = freed / (vocabulary.words + 1)
    # One number a part comes back.
    filled = np.array(sorted(r["id"] for r in ids.filter("kind = 3").select("id").collect()), dtype=np.int64)
    ranges = _write_statistics(ids, discounts, lower, distinct, unknown, vocabulary, f"{home}/statistics")
    return Model(vocabulary, f"{home}/pairs", parts, filled, f"{home}/statistics", ranges, discounts, unknown)


def _statistic(kind: int, ids: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
    filled = [*columns, *[np.zeros(len(ids))] * (4 - len(columns))]
    arrays = [np.full(len(ids), kind), ids, *filled]
    return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in arrays], names=["kind", "id", "a", "b", "c", "d"])


def _write_statistics(
    ids: DataFrame, upper: np.ndarray, lower: np.ndarray, distinct: int, unknown: float, vocabulary: Vocabulary, folder: str
) -> np.ndarray:
    """Per number: a word's own probability p1, and a context's total and freed mass. Returns the parts that have any."""
    size = PART_WORDS
    parts = 1 + (vocabulary.words + 1) // size
    freed = upper[1] * F.col("b") + upper[2] * F.col("c") + upper[3] * F.col("d")
    of_context = ids.filter("kind = 0").select("id", F.col("a").alias("total"), (freed / F.col("a")).alias("freed"))
    k = F.col("a")
    discount = F.when(k == 1, F.lit(float(lower[1]))).when(k == 2, F.lit(float(lower[2]))).otherwise(F.lit(float(lower[3])))
    of_word = ids.filter("kind = 1").select("id", ((k - discount) / F.lit(float(max(distinct, 1))) + F.lit(unknown)).alias("own"))
    both = of_word.join(of_context, "id", "full").select(
        F.floor(F.col("id") / size).cast("long").alias("part"),
        "id",
        F.coalesce("own", F.lit(unknown)).alias("own"),
        F.coalesce("total", F.lit(0)).alias("total"),
        F.coalesce("freed", F.lit(1.0)).alias("freed"),
    )

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = [b for b in found if b.num_rows]
        if not filled:
            return
        rows = pa.Table.from_batches(filled)
        part = rows["part"].to_numpy()
        for p in np.unique(part).tolist():
            own = rows.slice(int(np.searchsorted(part, p)), int((part == p).sum()))
            write_part(folder, p, own["id"].to_numpy(), **{c: own[c].to_numpy() for c in ("own", "total", "freed")})
            yield pa.RecordBatch.from_arrays([pa.array([p])], names=["part"])

    written = both.repartitionByRange(parts, "part").sortWithinPartitions("part", "id").mapInArrow(batches, "part bigint")
    return np.array(sorted(r["part"] for r in held(written, "written").collect()), dtype=np.int64)


class Scorer:
    """Scores of one task's texts."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.words = SortedArrays(model.vocabulary.folder)
        self.pairs = SortedArrays(model.bigrams)
        self.statistics = SortedArrays(model.statistics)

    def _statistic(self, ids: np.ndarray, names: tuple[str, ...], missing: tuple[float, ...]) -> list[np.ndarray]:
        """Values of numbers, through their distinct ones."""
        distinct, back = np.unique(ids, return_inverse=True)
        out = [np.full(len(distinct), m, dtype=np.float64) for m in missing]
        part = distinct // PART_WORDS
        for p in np.intersect1d(part, self.model.ranges).tolist():
            rows = np.flatnonzero(part == p)
            place, there = self.statistics.find(p, distinct[rows])
            for values, name in zip(out, names, strict=True):
                values[rows[there]] = self.statistics.values(p, name, place[there])
        return [values[back] for values in out]

    def score(self, bounds: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Per text: tokens, known tokens, base score and score (log10)."""
        model, vocabulary = self.model, self.model.vocabulary
        tokens, first = _tokens(bounds, data)
        keys, number, count, before = _pairs(tokens, first, vocabulary, self.words)
        distinct, at, back = np.unique(keys, return_index=True, return_inverse=True)
        part = _shares(distinct, before[at], model.parts)
        seen = np.zeros(len(distinct), dtype=np.int64)
        for p in np.intersect1d(part, model.filled).tolist():
            rows = np.flatnonzero(part == p)
            place, there = self.pairs.find(p, distinct[rows])
            seen[rows[there]] = self.pairs.values(p, "count", place[there])
        (own,) = self._statistic(number[at], ("own",), (model.unknown,))
        own[number[at] == 0] = model.unknown
        total, freed = self._statistic(distinct >> 32, ("total", "freed"), (0.0, 1.0))
        left = seen - model.discounts[np.minimum(seen, 3)]
        chance = np.where(total > 0, left / np.maximum(total, 1), 0.0) + np.where(total > 0, freed, 1.0) * own
        base = np.log10((count + 1) / (vocabulary.tokens + vocabulary.words + 1))
        starts = first[:-1]
        return np.diff(first), np.add.reduceat((count > 0).astype(np.int64), starts), np.add.reduceat(base, starts), np.add.reduceat(np.log10(chance)[back], starts)


def scores(rows: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_tokens, n_known, train_tokens, base_score, score and perplexity."""

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in found:
            for low, high, bounds, data in text_slices(batch.column(1), SCORED_BYTES):
                n, known, base, score = scorer.score(bounds, data)
                ids = batch.column(0).slice(low, high - low)
                columns = [ids, pa.array(n), pa.array(known), pa.array(np.full(len(n), model.vocabulary.tokens)), pa.array(base), pa.array(score)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    chosen = rows.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = chosen.schema["doc_id"].dataType.simpleString()
    return chosen.mapInArrow(
        batches, f"doc_id {kind}, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    ).withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def fold(key: Column, folds: int) -> Column:
    """crc32 of a key's text form, modulo `folds`; a null key is in none."""
    return F.crc32(key.cast("string").cast("binary")) % folds
