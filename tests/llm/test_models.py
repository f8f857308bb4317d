"""Quality classifier, language model and token counts."""

import collections
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from registra.llm import language_model, quality_model, token_counts
from registra.llm.queries import JOBS
from tests.llm.conftest import SF


def test_quality_on_held_out_rows(spark, database):
    got = {r.doc_id: r for r in JOBS["op1_quality_model"](spark, SF).collect()}
    assert len(got) == database.execute("SELECT count(*) FROM documents").fetchone()[0]
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    labels = [(got[i], q) for i, q in database.execute("SELECT doc_id, quality FROM labels").fetchall() if got[i].held_out]
    good, bad = [r.score for r, q in labels if q], [r.score for r, q in labels if not q]
    assert np.mean([g > b for g in good for b in bad]) > 0.9
    assert np.mean([r.predicted == q for r, q in labels]) > 0.85


def test_quality_edge_cases(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(5, 1), (5, 1), (7, 0), (3, 1), (10, 0), (None, 1), (9, None)], "doc_id long, label int")
    model = quality_model.fit(edge_docs, labels)
    got = quality_model.scores(edge_docs, model).collect()
    assert len(got) == edge_docs.count() and all(0 <= r.score <= 1 for r in got)
    assert quality_model.scores(no_docs, model).count() == 0
    one_sided = quality_model.fit(edge_docs, labels.filter("label = 1"))
    assert {r.score > 0.5 for r in quality_model.scores(edge_docs, one_sided).collect()} == {True}
    nothing = quality_model.fit(edge_docs, labels.limit(0))
    assert {round(r.score, 6) for r in quality_model.scores(edge_docs, nothing).collect()} == {0.5}


def test_ratios_and_descent_against_plain_python(spark, database):
    """Class counts, their log ratios, one fit and the scores, with dictionaries and dense loops."""
    rows = database.execute("SELECT doc_id, text, quality FROM documents JOIN labels USING (doc_id) WHERE text IS NOT NULL ORDER BY doc_id LIMIT 40").fetchall()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, label int")
    model = quality_model.fit(docs, labels)
    sets = {}
    for i, text, _ in rows:
        data = np.frombuffer(text.encode(), dtype=np.uint8)
        ((_, places, _),) = quality_model.features(np.array([0, len(data)]), data)
        sets[i] = sorted(set(places.tolist()))
    counts = [collections.Counter(p for i, _, q in rows if q == side for p in sets[i]) for side in (0, 1)]
    smooth, places = float(quality_model.SMOOTHING), quality_model.PLACES
    totals = [sum(c.values()) + smooth * places for c in counts]
    ratio = {p: math.log((counts[1][p] + smooth) / totals[1]) - math.log((counts[0][p] + smooth) / totals[0]) for found in sets.values() for p in found}
    assert all(abs(model.ratio[p] - r) < 1e-5 for p, r in ratio.items())

    # One fit: its hinge loss is as low as that of a plain descent carried on for long.
    vectors = [np.array(sets[i], dtype=np.int64) for i, _, _ in rows]
    wide, sign = model.ratio.astype(np.float64), np.array([1.0 if q else -1.0 for _, _, q in rows])
    dense = [{**{p: wide[p] for p in v.tolist()}} for v in vectors]
    for x in dense:
        length = math.sqrt(sum(value * value for value in x.values()))
        for p in x:
            x[p] /= length

    def objective(weight, bias):
        margins = [sum(weight.get(p, 0.0) * value for p, value in x.items()) + bias for x in dense]
        return (sum(w * w for w in weight.values()) + bias * bias) / 2 + quality_model.COST * sum(max(0.0, 1 - y * m) for y, m in zip(sign, margins))

    weight, bias = quality_model.descend(vectors, wide, sign > 0)
    plain, plain_bias, dual = {}, 0.0, [0.0] * len(dense)
    for _ in range(300):
        for i, x in enumerate(dense):
            margin = sum(plain.get(p, 0.0) * value for p, value in x.items()) + plain_bias
            new = min(max(dual[i] - (sign[i] * margin - 1) / 2, 0.0), quality_model.COST)
            step, dual[i] = (new - dual[i]) * sign[i], new
            if step:
                plain_bias += step
                for p, value in x.items():
                    plain[p] = plain.get(p, 0.0) + step * value
    assert objective({p: weight[p] for p in np.flatnonzero(weight).tolist()}, bias) <= 1.02 * objective(plain, plain_bias)

    # A score is the curve of the ratio-scaled vector's margin; the model holds single-precision numbers.
    got = {r.doc_id: r.score for r in quality_model.scores(docs, model).collect()}
    for (i, _, _), x in zip(rows, dense):
        length = math.sqrt(sum(ratio[p] ** 2 for p in sets[i]))
        margin = sum(float(model.value[p]) for p in sets[i]) / length + model.bias
        assert abs(got[i] - 1 / (1 + math.exp(-(model.slope * margin + model.shift)))) < 1e-3


def test_features_are_distinct_and_whole():
    text = "ab ab ab c" * 200
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    ((low, places, first),) = quality_model.features(np.array([0, len(data)]), data)
    assert low == 0 and first.tolist() == [0, len(places)] and len(set(places.tolist())) == len(places)


def test_descent_separates():
    rng = np.random.default_rng(3)
    ratio = np.concatenate([np.full(50, 1.0), np.full(50, -1.0)])
    rows = [np.unique(rng.choice(50, 8) + (0 if i % 3 else 50)) for i in range(90)]
    good = np.arange(90) % 3 != 0
    weight, bias = quality_model.descend(rows, ratio, good)
    margins = np.array([(ratio[r] * weight[r]).sum() / math.sqrt(len(r)) + bias for r in rows])
    assert ((margins > 0) == good).all()


def reference_scores(texts, training):
    """Interpolated modified Kneser-Ney over dictionaries; `training` are indices."""
    tokens = [[*(t or "").encode().lower().split(), None] for t in texts]
    seen, pairs = collections.Counter(), collections.Counter()
    for i in training:
        seen.update(tokens[i])
        pairs.update(zip([0, *tokens[i]], tokens[i]))
    contexts, continued = collections.defaultdict(lambda: [0, 0, 0, 0]), collections.Counter()
    for (u, w), c in pairs.items():
        contexts[u][0] += c
        contexts[u][min(c, 3)] += 1
        continued[w] += 1

    def discounts(values):
        return language_model._discounts([sum(v == k for v in values) for k in (1, 2, 3, 4)])

    upper, lower = discounts(pairs.values()), discounts(continued.values())
    total, size = sum(seen.values()), len(seen)
    freed = sum(lower[min(k, 3)] for k in continued.values()) / len(pairs) if pairs else 1.0
    out = []
    for row in tokens:
        base = score = 0.0
        for u, w in zip([0, *row], row):
            base += math.log10((seen[w] + 1) / (total + size + 1))
            own = (continued[w] - lower[min(continued[w], 3)]) / len(pairs) if w in continued else 0.0
            p = own + freed / (size + 1)
            if u in contexts:
                c, (n, *classes) = pairs.get((u, w), 0), contexts[u]
                p = max(c - upper[min(c, 3)], 0) / n + sum(d * k for d, k in zip(upper[1:], classes)) / n * p
            score += math.log10(p)
        out.append((len(row), sum(seen[w] > 0 for w in row), total, base, score))
    return out


@pytest.mark.parametrize("small_parts", [False, True])
def test_language_model(spark, edge_docs, monkeypatch, small_parts):
    if small_parts:
        monkeypatch.setattr(language_model, "PART_TOKENS", 50)
        monkeypatch.setattr(language_model, "PART_WORDS", 40)
        monkeypatch.setattr(language_model, "GATHERED", 300)
    texts = [r.text for r in edge_docs.select("text").collect()]
    numbered = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    training = [i for i in range(len(texts)) if i % 4 != 1]
    model = language_model.fit(numbered.filter("doc_id % 4 <> 1"))
    got = {r.doc_id: r for r in language_model.scores(numbered, model).collect()}
    for i, (n, known, total, base, score) in enumerate(reference_scores(texts, training)):
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(score, rel=1e-6)
        assert r.perplexity == pytest.approx(10 ** (-score / n), rel=1e-6)


def test_language_model_without_training(spark, no_docs, edge_docs):
    model = language_model.fit(no_docs)
    assert {(r.score, r.base_score, r.n_known) for r in language_model.scores(edge_docs, model).collect()} == {(0.0, 0.0, 0)}
    assert language_model.scores(no_docs, model).count() == 0


def test_language_model_beats_unigrams_on_held_out(spark):
    got = JOBS["op3_language_model"](spark, SF).filter("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert got.s > got.b


PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_every_prefix_has_the_librarys_count():
    library, counter = Tokenizer.from_file(PATH), token_counts.PrefixCounter(token_counts.Vocabulary.load(PATH))
    rng = random.Random(11)
    pieces = ["a", "the", "ing", " ", "  ", "\n", "'", "'s", "'re", "'ll", "'v", "!", "??", "12", "é", "日本", "🎉", "<|endoftext|>", "<|endo", "|>", " world", "\r\n", "\x1c", "\x85", "Ⅷ", "aaaa", "====", " \n ", "\t\t", " 's"]
    for _ in range(900):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 12)))
        table = counter.table(text).tolist()
        assert table == [len(library.encode(text[:k], add_special_tokens=False).ids) for k in range(len(text) + 1)], text
        for budget in (0, 1, 3):
            longest = token_counts.longest_prefix(np.array(table), budget)
            assert table[longest] <= budget and all(n > budget for n in table[longest + 1 :])
        for budget in range(table[-1] + 2):
            assert counter.within(text, budget) == (table[-1], token_counts.longest_prefix(np.array(table), budget)), (text, budget)


def test_token_counts(spark, edge_docs, no_docs, documents):
    library = Tokenizer.from_file(PATH)
    for docs in (edge_docs, documents):
        got = token_counts.token_counts(docs, PATH, 20).collect()
        texts = [r.text or "" for r in docs.select("text").collect()]
        assert sorted((r.n_bytes, r.n_tokens) for r in got) == sorted((len(t.encode()), len(e.ids)) for t, e in zip(texts, library.encode_batch(texts, add_special_tokens=False)))
    tables = token_counts.prefix_tables(edge_docs.filter("length(text) < 100"), PATH).collect()
    assert all(r.prefix_tokens[0] == 0 and token_counts.tokens_in_prefix(np.array(r.prefix_tokens), 10**9) == r.prefix_tokens[-1] for r in tables)
    assert token_counts.token_counts(no_docs, PATH, 20).count() == 0
