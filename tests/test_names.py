import random

import duckdb
import numpy as np
import pytest

from pyspark.sql import functions as F

from registra.functions import similarity
from registra.functions.similarity import similarities
from registra.operators import names
from tests.samples import est, registry, rows, siren, siret


def random_names(count, seed=5, alphabet="ABCDE É"):
    pick = random.Random(seed)
    return ["".join(pick.choice(alphabet) for _ in range(pick.randint(0, 12))) for _ in range(count)]


def reference_scores(left, right):
    con = duckdb.connect()
    con.execute("create table t (i integer, a varchar, b varchar)")
    con.executemany("insert into t values (?, ?, ?)", list(zip(range(len(left)), left, right)))
    return np.array([r[0] for r in con.execute("select jaro_winkler_similarity(a, b) from t order by i").fetchall()])


def test_similarity_equals_an_independent_implementation():
    left = random_names(3000) + ["MARTHA", "A", "", "X" * 300, "AB" * 40]
    right = random_names(3000, seed=6) + ["MARHTA", "A", "", "X" * 299 + "Y", "BA" * 40]
    scores = similarities(np.array(left, dtype=object), np.array(right, dtype=object))
    assert np.allclose(scores, reference_scores(left, right), atol=1e-12)


def test_places_as_bits_match_as_matrices_do():
    pick = random.Random(9)
    left, right = (["".join(pick.choice("AB") for _ in range(pick.choice((0, 1, 31, 62, 63, 64)))) for _ in range(2000)] for _ in "ab")
    sides = [part for side in (left, right) for part in similarity._matrix([name.encode() for name in side])]
    for words, matrix in zip(similarity._matched_words(*sides), similarity._matched_matrix(*sides)):
        assert np.array_equal(words, matrix)
    longer = ["AB" * n for n in (31, 32, 33, 40)] * 4
    others = [name for name in ("BA" * 16, "A" * 64, "BA" * 33, "B") for _ in range(4)]
    scores = similarities(np.array(longer, dtype=object), np.array(others, dtype=object))
    assert np.allclose(scores, reference_scores(longer, others), atol=1e-12)


def test_ceiling_is_never_below_the_score(spark):
    pairs = spark.createDataFrame(list(zip(random_names(2000, 1), random_names(2000, 2))), "one string, other string")
    described = names._described(names._described(pairs, "one").toDF("one", "other", "a", "head_a", "sig_a"), "other")
    common = F.size(F.array_intersect("a", "bytes"))
    ceiling = names._ceiling(common, F.size("a"), F.size("bytes"), F.col("head_a"), F.col("head"))
    least = names._least_jaro(F.col("score"))
    found = described.filter("one <> '' AND other <> ''").withColumn("score", names.name_similarity(F.col("one"), F.col("other")))
    jaro = (common / F.size("a") + common / F.size("bytes") + 1) / 3
    checked = found.select((ceiling >= F.col("score") - names.SLACK).alias("high"), ((common == 0) | (jaro >= least - names.SLACK)).alias("enough"), (common == 0).alias("none"), "score")
    for r in checked.collect():
        assert r.high and r.enough and (not r.none or r.score == 0)


@pytest.fixture(scope="module")
def searched(spark):
    pick = random.Random(11)
    base = ["ALPHA CONSEIL", "ALPHA CONSEILS", "BETA TRANSPORT", "GAMMA", "ALPHA", "BETA TRANSPORTS REUNIS", "DELTA SA"]
    establishments, units = [], []
    for n in range(1, 121):
        name = pick.choice(base) + pick.choice(["", " SAS", " NORD", " SUD"])
        units.append((siren(n), name if n % 9 else "", None if n % 9 else f"NOM {n}", None))
        establishments += [est(n, k, pick.choice("AF"), zip_code=f"7500{pick.randint(1, 3)}") for k in range(1, pick.randint(2, 4))]
    r = registry(spark, establishments, units=units)
    lines = [(i, pick.choice(base)[::-1][:6] + pick.choice(base), f"7500{i % 4}" if i % 3 else "") for i in range(60)]
    lines += [(100, "SA", ""), (101, "SAS", "75001"), (102, None, ""), (103, "ALPHA CONSEIL", "75002")]
    return r, establishments, units, spark.createDataFrame(lines, "id long, nom string, cp string")


def brute_force(establishments, units, lines, limit):
    import re

    form = re.compile(r"\b(SAS|SARL|SA|SNC|EURL|SASU|SCI|GIE|EI)\b")
    named = {u[0]: u[1] or u[2] for u in units}
    found = []
    for i, name, cp in lines:
        clean = form.sub("", (name or "").strip().upper()).strip()
        if len((name or "").strip()) < 3 or len(clean) < 3:
            continue
        texts = [form.sub("", named[e[1]].upper()).strip() for e in establishments]
        base = reference_scores([clean] * len(texts), texts)
        best = {}
        for e, score in zip(establishments, base):
            total = round(min(1.0, score + (0.05 if cp and e[8] == cp else 0.0)), 10)
            key = (-total, e[0])
            if e[1] not in best or key < best[e[1]]:
                best[e[1]] = key
        for rank, (score, code) in enumerate(sorted(best.values())[:limit], start=1):
            found.append((i, rank, code, round(-score, 4)))
    return sorted(found, key=repr)


@pytest.mark.parametrize(("runs", "per_run", "limit"), [(4, 16, 3), (1, 1, 3), (4, 16, 1), (2, 3, 7)])
def test_search_equals_brute_force(spark, searched, monkeypatch, runs, per_run, limit):
    monkeypatch.setattr(names, "RARE_SEQUENCES", runs)
    monkeypatch.setattr(names, "NAMES_PER_SEQUENCE", per_run)
    r, establishments, units, lines = searched
    queries = names.prepare_queries(lines, "id", "nom", "cp")
    found = names.search_names(queries, r, limit)
    expected = brute_force(establishments, units, [tuple(x) for x in lines.collect()], limit)
    assert rows(found, "row_id", "rank", "siret", "score_similarite") == expected


def test_wide_candidates(spark, searched):
    r, _, _, lines = searched
    found = names.search_names(names.prepare_queries(lines, "id", "nom", "cp"), r)
    wide = names.candidates_wide(lines, "id", found)
    assert wide.count() == lines.count()
    short = wide.filter("id = 100").first()
    assert short.suggested_siret_1 == "" and short.score_1 is None
    counts = names.search_counts(wide).first()
    assert (counts.lines_with_candidate, counts.lines_without_candidate) == (61, 3) and counts.candidates == 61 * 3
    full = wide.filter("id = 103").first()
    assert full.suggested_denomination_1.startswith("ALPHA CONSEIL") and full.suggested_adresse_1.startswith("1 RUE 7500")


@pytest.mark.parametrize(("country", "first", "expected"), [("fr ", "x", 1), ("France", "", 2), ("DE", "x", 3), (None, "x", 3)])
def test_review_priority(spark, country, first, expected):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(country, first)], "c string, s string")
    assert df.select(names.review_priority(F.col("c"), F.col("s"))).first()[0] == expected
    assert siret(1, 1)[:9] == siren(1)


def test_junk_and_unlike_names_stay_exact(spark):
    rng = np.random.default_rng(4)
    letters = list("abcdefgh ")
    places = ["".join(rng.choice(letters, rng.integers(3, 14))) for _ in range(200)] + ["a" * 20_000, "ab" * 3_000, "aaaaaaaaab", ""]
    queries = ["a" * 5_000, "aaaaaaaaaaaa", "abcabcabcabcab", "hgfe", "b" * 9, "XYZ", "éÉ"]
    table = [(name, f"{i % 7}", f"{i:09d}", f"{i:014d}") for i, name in enumerate(places)]
    frame = spark.createDataFrame(table, "place_name string, postcode string, siren string, siret string")
    distinct = spark.createDataFrame([(q, zip_code) for q in queries for zip_code in ("", "3")], "clean string, zip string")
    floors, scored = names.compared_names(distinct, frame, frame.select("place_name", "siren", "siret"), 3)
    floors = {r.clean: r.floor for r in floors.collect()}
    met = {}
    for r in scored.collect():
        met.setdefault(r.clean, {})[r.place_name] = r.base
    for query in queries:
        scores = similarities(np.array([query] * len(places), dtype=object), np.array(places, dtype=object))
        for zip_code in ("", "3"):
            total = [round(min(1.0, s + (names.POSTCODE_BONUS if zip_code and row[1] == zip_code else 0.0)), names.RANKING_DIGITS) for s, row in zip(scores, table)]
            expected = sorted(zip([-t for t in total], [row[3] for row in table], places))[:3]
            assert all(name in met[query] for _, _, name in expected), (query, zip_code)
            assert -expected[-1][0] >= floors[query] - names.SLACK


def test_few_pairs_are_compared(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("ABCDEFGHIJKLMNOPRSTUVY") for _ in range(rng.randint(3, 9))) for _ in range(300)]
    known = sorted({" ".join(rng.sample(words, 2)) for _ in range(1500)})
    table = [(name, "", f"{i:09d}", f"{i:014d}") for i, name in enumerate(known)]
    frame = spark.createDataFrame(table, "place_name string, postcode string, siren string, siret string")
    asked = [name[:4] + name[5:] for name in known[::10]]
    distinct = spark.createDataFrame([(name, "") for name in set(asked)], "clean string, zip string")
    _, scored = names.compared_names(distinct, frame, frame.select("place_name", "siren", "siret"), 3)
    assert scored.count() < 0.1 * len(set(asked)) * len(known)


def numbered_names(count):
    """Names that differ in a few digits only, as numbered ones do, and the same with two letters swapped."""
    known = [f"CUSTOMER#{n:06d}" for n in range(count)]
    return known, [name[:2] + name[3] + name[2] + name[4:] for name in known[::7]]


def test_numbered_names_leave_few_pairs(spark):
    known, asked = numbered_names(3000)
    table = [(name, f"{i % 5}", f"{i:09d}", f"{i:014d}") for i, name in enumerate(known)]
    frame = spark.createDataFrame(table, "place_name string, postcode string, siren string, siret string")
    distinct = spark.createDataFrame([(q, f"{i % 5}" if i % 2 else "") for i, q in enumerate(asked)], "clean string, zip string")
    floors, scored = names.compared_names(distinct, frame, frame.select("place_name", "siren", "siret"), 3)
    pairs = [tuple(r) for r in scored.select("clean", "place_name").collect()]
    assert len(pairs) < 0.05 * len(asked) * len(known)
    met = {}
    for clean, place in pairs:
        met.setdefault(clean, set()).add(place)
    for i, query in enumerate(asked[:60]):
        scores = similarities(np.array([query] * len(known), dtype=object), np.array(known, dtype=object))
        zip_code = f"{i % 5}" if i % 2 else ""
        total = [round(min(1.0, s + (names.POSTCODE_BONUS if row[1] == zip_code else 0.0)), names.RANKING_DIGITS) for s, row in zip(scores, table)]
        expected = sorted(zip([-t for t in total], [row[3] for row in table], known))[:3]
        assert all(name in met[query] for _, _, name in expected), query


def test_ceilings_know_bytes_in_another_order(spark):
    pairs = spark.createDataFrame(list(zip(random_names(3000, 3, "ABCDEFGHIJ"), random_names(3000, 4, "ABCDEFGHIJ"))), "one string, other string")
    described = names._described(names._described(pairs, "one").toDF("one", "other", "a", "head_a", "sig_a"), "other")
    described = described.withColumn("alone_a", names._alone("head_a", "a")).withColumn("alone", names._alone("head", "bytes"))
    common = F.size(F.array_intersect("a", "bytes"))
    crossed = F.array_intersect("alone_a", "alone") != F.array_intersect("alone", "alone_a")
    ceiling = names._ceiling(common, F.size("a"), F.size("bytes"), F.col("head_a"), F.col("head"), crossed)
    found = described.filter("one <> '' AND other <> ''").withColumn("score", names.name_similarity(F.col("one"), F.col("other")))
    checked = found.select((ceiling >= F.col("score") - names.SLACK).alias("high"), crossed.alias("crossed")).collect()
    assert all(r.high for r in checked) and sum(r.crossed for r in checked) >= 50
