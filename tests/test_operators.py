import random

import pytest
from pyspark.sql import functions as F

from registra.operators import establishments as est
from registra.operators import link_state, scoping
from registra.operators.diff import NO_KEY, ONLY_AFTER, ONLY_BEFORE, changed_rows, run_diff, slice_digests
from registra.operators.history import history_slice, history_summary
from registra.operators.profile import (
    COUNTRY_TERMS, IDENTIFIER_TERMS, name_match, profile_columns, suggested_columns,
)
from registra.operators.succession import best_links, link_profile, links_touching, resolve_successors, with_successor_state
from tests.samples import est as row
from tests.samples import registry, rows, siren, siret


def test_pick_prefers_head_office_even_closed(spark):
    table = registry(spark, [
        row(1, 1, "F", head=True, start="2001-01-01"), row(1, 2, "A", start="2020-01-01"),
        row(2, 1, "A", start="2019-01-01"), row(2, 2, "A", start="2020-01-01"), row(2, 3, "F", start="2023-01-01"),
        row(3, 1, "F"),
        row(4, 1, "A", created="2001-01-01"), row(4, 2, "A", created="2002-01-01"), row(4, 3, "A", start="bad", created="bad"),
    ]).establishments
    assert rows(est.pick_for_siren(table), "siren", "siret", "lookup_mode") == sorted([
        (siren(1), siret(1, 1), est.HEAD_OFFICE),
        (siren(2), siret(2, 2), est.ACTIVE_FALLBACK),
        (siren(4), siret(4, 2), est.ACTIVE_FALLBACK),
    ], key=repr)


def choice(spark, table, own, own_active=False):
    frame = est.active_siblings(table).withColumns(est.sibling_choice(F.lit(own), F.lit(own_active)))
    return rows(frame, "sibling_siret", "sibling_candidates", "sibling_reason")


def test_sibling_choice(spark):
    table = registry(spark, [
        row(1, 1, "A", start="2020-01-01"), row(1, 2, "A", head=True), row(1, 3, "F"), row(1, 2, "A", start="2001-01-01"),
    ]).establishments
    assert choice(spark, table, siret(1, 3)) == [(siret(1, 2), 2, "head office among several active establishments")]
    assert choice(spark, table, siret(1, 2), True) == [(siret(1, 1), 1, "only active establishment of the legal unit")]
    alone = registry(spark, [row(1, 1, "A")]).establishments
    assert choice(spark, alone, siret(1, 1), True)[0][:2] == (siret(1, 1), 1)


@pytest.mark.parametrize(
    ("rows_", "reason"),
    [
        ([row(1, 1, start="2020-01-01"), row(1, 2)], "latest start date among several active establishments"),
        ([row(1, 1, created="2020-01-01"), row(1, 2)], "latest creation date among several active establishments"),
        ([row(1, 1), row(1, 2)], "lowest identifier among several active establishments"),
    ],
)
def test_sibling_reason(spark, rows_, reason):
    assert choice(spark, registry(spark, rows_).establishments, "x") == [(siret(1, 1), 2, reason)]


def test_counts_and_repeated_rows(spark):
    table = registry(spark, [row(1, 1, "A", start="2001-01-01"), row(1, 1, "F", start="2002-01-01"), row(1, 2, None)]).establishments
    assert rows(est.sibling_counts(table), "*") == [(siren(1), 3, 1, 1)]
    assert rows(est.one_per_siret(table), "siret", est.STATE) == sorted([(siret(1, 1), "F"), (siret(1, 2), None)], key=repr)


A, B, C, D = (siret(n, 1) for n in (1, 2, 3, 4))


def best(spark, links):
    return dict(rows(best_links(registry(spark, [row(1, 1)], links=links).links), "predecessor", "successor"))


@pytest.mark.parametrize(
    ("links", "expected"),
    [
        ([(A, C, None, None), (A, B, None, None)], B),
        ([(A, C, "1997-08-01", "true"), (A, D, "2003-04-05", "true"), (A, B, "2011-07-25", "false")], B),
        ([(A, B, "2011-07-25", "false"), (A, C, "2011-07-25", "true")], C),
        ([(A, B, "", "true"), (A, C, "1997-08-01", "false")], C),
        ([(A, None, "2020-01-01", "true"), (A, C, " ", None)], C),
    ],
)
def test_best_link(spark, links, expected):
    assert best(spark, links) == {A: expected} == best(spark, list(reversed(links)))


def walk(spark, edges, states, starts, depth=5):
    links = [(p, s, "2020-01-01", "true") for p, s in edges.items()]
    establishments = [(s, s[:9], state, "false", None, None, "", "", "") for s, state in states.items()]
    r = registry(spark, establishments or [row(9, 1)], links=links)
    start_frame = spark.createDataFrame([(s,) for s in starts], "siret string")
    edge_table = with_successor_state(best_links(r.links), r.establishments)
    return dict(rows(resolve_successors(start_frame, edge_table, depth).filter("outcome = 'found'"), "siret", "successor"))


@pytest.mark.parametrize(
    ("edges", "states", "depth", "expected"),
    [
        ({A: B}, {B: "A"}, 5, {A: B}),
        ({A: B, B: C, C: D}, {B: "F", C: " f ", D: "A"}, 5, {A: D}),
        ({A: B}, {}, 5, {A: B}),
        ({A: B}, {B: None}, 5, {A: B}),
        ({A: B, B: A}, {A: "F", B: "F"}, 5, {}),
        ({A: A}, {A: "A"}, 5, {}),
        ({A: B, B: C}, {B: "F", C: "F"}, 5, {}),
        ({A: B, B: C, C: D}, {B: "F", C: "F", D: "A"}, 2, {}),
        ({}, {}, 5, {}),
    ],
)
def test_walk(spark, edges, states, depth, expected):
    assert walk(spark, edges, states, [A], depth) == expected


def test_a_chain_cut_by_the_bound_is_told_apart(spark):
    edges = spark.createDataFrame([(A, B, False), (B, C, False), (C, D, True)], "predecessor string, successor string, usable boolean")
    starts = spark.createDataFrame([(A,)], "siret string")
    assert [tuple(r) for r in resolve_successors(starts, edges, 2).collect()] == [(A, None, 2, "depth_reached")]
    assert [tuple(r) for r in resolve_successors(starts, edges, 3).collect()] == [(A, D, 3, "found")]


def test_walk_against_a_plain_loop(spark):
    pick = random.Random(7)
    nodes = [siret(n, 1) for n in range(60)]
    edges = {n: pick.choice(nodes[:40]) for n in nodes if pick.random() < 0.9}
    states = {n: pick.choice("AFFF") for n in nodes if pick.random() < 0.9}

    def follow(start):
        seen, at = {start}, start
        for _ in range(5):
            nxt = edges.get(at)
            if nxt is None or nxt in seen:
                return None
            if states.get(nxt, "A") == "A":
                return nxt
            seen.add(nxt)
            at = nxt
        return None

    expected = {n: follow(n) for n in nodes if follow(n)}
    assert walk(spark, edges, states, nodes) == expected


def test_links_touching(spark):
    links = registry(spark, [row(1, 1)], links=[(A, B, "", ""), (B, C, "", ""), (C, A, "", ""), (C, D, "", ""), (None, A, "", "")]).links
    keys = spark.createDataFrame([(A,), (B,)], "siret string")
    found = links_touching(links, keys)
    assert rows(found, "siretEtablissementPredecesseur", "siretEtablissementSuccesseur", "input_match_type") == sorted([
        (A, B, "INPUT_IS_PREDECESSOR_AND_SUCCESSOR"), (B, C, "INPUT_IS_PREDECESSOR"),
        (C, A, "INPUT_IS_SUCCESSOR"), (None, A, "INPUT_IS_SUCCESSOR"),
    ], key=repr)


def test_link_profile(spark):
    same = siret(1, 2)
    links = registry(spark, [row(1, 1)], links=[(A, same, "", "true"), (A, B, "", "true"), (A, C, "", "false"), (B, C, "", "true")]).links
    assert link_profile(links).first().asDict() == {
        "links": 4, "same_siren_links": 1, "other_siren_links": 3, "other_siren_with_continuity": 2, "predecessors": 2,
        "predecessors_with_several_links": 1, "predecessors_with_several_sirens": 1, "max_links": 3,
    }


def test_link_state_merges_like_one_table(spark):
    """Random links, ties, short and null ends: any split merges to what ranking the whole table gives."""
    rng = random.Random(5)
    ends = [A, B, C, D, "12", "123", "12é", None]
    days = ["", None, "2020-01-01", "2021-05-05 "]
    links = [(rng.choice(ends), rng.choice(ends), rng.choice(days), rng.choice(["true", "false", None])) for _ in range(300)]
    table = lambda part: registry(spark, [row(1, 1)], links=part).links
    whole = table(links)
    expected = rows(best_links(whole), "predecessor", "successor")
    assert rows(link_state.best_of(link_state.link_state(whole)), "predecessor", "successor") == expected
    for cuts in ((0, 150), (100, 200)):
        parts = [links[: cuts[0]], links[cuts[0] : cuts[1]], links[cuts[1] :]]
        state = link_state.merged(*[link_state.link_state(table(p)) for p in parts])
        assert rows(link_state.best_of(state), "predecessor", "successor") == expected
        assert link_state.profile_of(state).first() == link_profile(whole).first()
    corrected = [x for x in links if x[0] != A] + [(B, D, "2030-01-01", "true")]
    changed = spark.createDataFrame([(A,), (B,), (B,), (None,)], "predecessor string")
    after = link_state.replaced(link_state.link_state(whole), table(corrected), changed)
    assert rows(after, "*") == rows(link_state.link_state(table(corrected)), "*")


def test_history(spark):
    history = registry(spark, [row(1, 1)], history=[
        (A, siren(1), "2001-01-01", "2002-01-01"), (A, siren(1), "2002-01-02", None),
        (B, siren(2), "2001-01-01", "2002-01-01"), (B, siren(2), "2000-01-01", "2000-12-31"), (C, siren(3), "2001-01-01", " "),
    ]).history
    assert rows(history_summary(history), "*") == sorted([
        (A, 2, "2002-01-02", None), (B, 2, "2001-01-01", "2002-01-01"), (C, 1, "2001-01-01", None),
    ], key=repr)
    assert rows(history_summary(history, has_end=False), "historique_latest_dateFin") == [(None,)] * 3
    keys = spark.createDataFrame([(A,), (A,)], "siret string")
    assert history_slice(history, sirets=keys).count() == 2
    units = spark.createDataFrame([(siren(2),)], "siren string")
    assert history_slice(history, sirens=units).count() == 2


@pytest.mark.parametrize(
    ("country", "expected"),
    [(" FRANCE ", "home"), ("fra", "home"), ("Françé", "home"), (None, "unknown"), ("00", "unknown"), ("", "unknown"), ("DE", "foreign")],
)
def test_country(spark, country, expected):
    df = spark.createDataFrame([(country,)], "c string")
    assert df.select(scoping.country_scope(F.col("c"))).first()[0] == expected


def test_scope(spark):
    lines = spark.createDataFrame(
        [("1", siret(1, 1), "FR"), ("2", "123", "DE"), ("3", siret(1, 1), "DE"), ("4", "0 0", ""), ("5", None, "FR")],
        "ref string, id string, pays string",
    )
    scoped = scoping.with_country_scope(lines, "pays", "id")
    assert rows(scoping.keep_country(scoped), "ref") == [("1",), ("4",), ("5",)]
    assert rows(scoping.keep_country(scoped, True), "ref") == [("1",), ("3",), ("4",), ("5",)]
    kept, missing = scoping.split_missing(lines, "id")
    assert rows(kept, "ref") == [("1",), ("2",), ("3",)] and rows(missing, "ref") == [("4",), ("5",)]
    assert scoping.scope_counts(lines, "pays", "id", True).first().asDict() == {
        "total_rows": 5, "home_rows": 2, "foreign_rows": 2, "unknown_country_rows": 1, "foreign_kept_rows": 1, "missing_rows": 2,
    }
    assert scoping.scope_counts(lines, None, "id").first()["missing_rows"] == 2


def test_column_profile(spark):
    lines = spark.createDataFrame([(siret(1, 1), "FR", "x"), ("bad", "DE", " ")], "`N° SIRET` string, Pays string, note string")
    table = {r.column_name: r for r in profile_columns(lines).collect()}
    assert table["N° SIRET"].valid_identifier_share == 0.5 and table["Pays"].home_country_share == 0.5
    assert table["note"].filled_share == 0.5
    assert suggested_columns(profile_columns(lines)).first().asDict() == {"identifier_column": "N° SIRET", "country_column": "Pays"}
    assert suggested_columns(profile_columns(lines.select("note"))).first().identifier_column is None
    assert name_match("N° SIRET", IDENTIFIER_TERMS) == 2 and name_match("numsiret", IDENTIFIER_TERMS) == 1
    assert name_match("code pays", COUNTRY_TERMS) == 2 and name_match("ville", COUNTRY_TERMS) == 0


def test_run_diff(spark):
    before = spark.createDataFrame([(1, "x", "a"), (2, None, "b"), (3, "z", "c")], "id long, v string, s string")
    after = spark.createDataFrame([(1, "y", "a"), (2, None, "b"), (4, "z", "c")], "id long, v string, s string")
    found = {(r.status, r.column_name): r.changed_rows for r in run_diff(before, after, "id", "s").collect()}
    assert found[("a", "v")] == 1 and found[("b", "v")] == 0
    assert found[("c", ONLY_BEFORE)] == 1 and found[("c", ONLY_AFTER)] == 1


def test_equal_runs_join_no_row(spark):
    columns = "id long, v string, s string"
    lines = [(i, None if i % 5 == 0 else f"v{i % 7}", None if i % 11 == 0 else f"s{i % 3}") for i in range(3_000)]
    before = spark.createDataFrame(lines, columns)
    again = spark.createDataFrame(lines[::-1], columns)
    digests = slice_digests(before, again, "id", ["v", "s"], "s")
    assert digests.filter("not equal").count() == 0
    assert changed_rows(before, "id", digests).count() == changed_rows(again, "id", digests).count() == 0
    found = run_diff(before, again, "id", "s").collect()
    assert {(r.status, r.column_name) for r in found} == {(s, c) for s in (None, "s0", "s1", "s2") for c in ("v", "s", ONLY_BEFORE, ONLY_AFTER)}
    assert all(r.changed_rows == 0 for r in found)
    one = before.withColumn("v", F.when(F.col("id") == 77, "other").otherwise(F.col("v")))
    digests = slice_digests(before, one, "id", ["v", "s"], "s")
    assert 1 <= changed_rows(one, "id", digests).count() < 10
    assert digests.filter("not equal").select("slice").distinct().count() == 1
    assert [tuple(r) for r in run_diff(before, one, "id", "s").filter("changed_rows > 0").collect()] == [(None, "v", 1)]


@pytest.mark.parametrize("slices", [1, 16, 65_536])
def test_run_diff_equals_a_plain_comparison(spark, slices):
    """Values that move between columns, nulls, equal changes in two rows, missing rows and rows without a key."""
    rng = random.Random(slices)

    def cell():
        return rng.choice([None, "", "a", "b"])

    old = {i: (cell(), cell(), rng.choice([None, "p", "q"])) for i in range(400)}
    new = {i: v if rng.random() < 0.8 else (v[1], v[0], rng.choice([v[2], "r"])) for i, v in old.items() if rng.random() < 0.97}
    new |= {i: (cell(), cell(), "p") for i in range(400, 420)}
    columns = "id long, v string, `w.x` string, s string"
    before = spark.createDataFrame([(i, *v) for i, v in old.items()] + [(None, "a", "a", "p")], columns)
    after = spark.createDataFrame([(i, *v) for i, v in new.items()] + [(None, "a", "a", "p")], columns)
    expected = {}
    for i in [*(old.keys() | new.keys())]:
        a, b = old.get(i), new.get(i)
        status = (a and a[2]) or (b and b[2])
        for n, name in enumerate(("v", "w.x", "s")):
            expected[status, name] = expected.get((status, name), 0) + bool(a and b and a[n] != b[n])
        expected[status, ONLY_BEFORE] = expected.get((status, ONLY_BEFORE), 0) + (b is None)
        expected[status, ONLY_AFTER] = expected.get((status, ONLY_AFTER), 0) + (a is None)
    expected["p", ONLY_BEFORE] += 1
    expected["p", ONLY_AFTER] += 1
    assert {(r.status, r.column_name): r.changed_rows for r in run_diff(before, after, "id", "s", slices).collect()} == expected
    keyless = slice_digests(before, after, "id", ["v", "w.x", "s"], "s", slices).filter(F.col("slice") == NO_KEY)
    assert [r.equal for r in keyless.collect()] == [False]
