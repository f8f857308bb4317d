import dataclasses
import random

import pytest
from pyspark.sql import functions as F

from registra import ControlOptions, run_control
from registra.operators import reports, rules, scoping
from registra.operators.establishments import STATE
from registra.plans.control import OVERVIEW_COLUMNS, column_group, with_rules
from registra.schema import LEGAL_UNIT_FIELDS
from registra.sources.registry import registry_from_frames
from registra.sources.sinks import RESULTS, write_results
from tests.samples import est, registry, rows, siren, siret

OTHER = siret(5, 1)


@pytest.fixture(scope="module")
def sample(spark):
    return registry(
        spark,
        [
            est(1, 1, "A", head=True, number="12"), est(1, 2, "F"), est(1, 3, "F", number="9"),
            est(2, 1, "F"), est(2, 2, "F"),                       # nothing active: radiated
            est(3, 1, None),                                       # unknown state
            est(4, 1, "F", head=True), est(4, 2, "A", start="2020-01-01", street="[ nd ]"),
            est(5, 1, "A"),
        ],
        units=[(siren(1), "ALPHA SAS", None, None), (siren(4), None, "REY", "ANA")],
        links=[
            (siret(1, 3), OTHER, "2020-01-01", "true"),            # other legal unit
            (siret(2, 1), siret(1, 1), "2020-01-01", "true"),      # radiated: not followed
        ],
        history=[(siret(1, 1), siren(1), "2001-01-01", None), (siret(4, 1), siren(4), "2001-01-01", "2002-01-01")],
    )


LINES = [
    ("1", siret(1, 1), "active"), ("2", siret(1, 2), "closed, sibling"), ("3", siret(1, 3), "closed, successor"),
    ("4", siret(2, 1), "radiated"), ("5", siret(3, 1), "unknown"), ("6", siren(4), "head office closed"),
    ("7", "123", "invalid"), ("8", siret(8, 1), "absent"), ("9", siren(9), "absent unit"),
    ("10", siret(1, 1) + ".0", "again"), ("11", siren(4) + "00000", "fallback"),
]
COLUMNS = "ref string, siret string, note string"


def lines_frame(spark, lines=LINES):
    return spark.createDataFrame(lines, COLUMNS)


@pytest.fixture(scope="module")
def result(spark, sample):
    return run_control(lines_frame(spark), "siret", sample, ControlOptions(row_id="ref"))


@pytest.fixture(scope="module")
def table(result):
    return {r.row_id: r for r in result.overview.collect()}


def test_statuses(table):
    labels = rules.STATUS_LABELS
    expected = {
        1: rules.ACTIVE, 2: rules.CLOSED, 3: rules.CLOSED, 4: rules.RADIATED, 5: rules.UNKNOWN_STATE, 6: rules.CLOSED,
        7: rules.INVALID, 8: rules.NOT_FOUND, 9: rules.NOT_FOUND, 10: rules.ACTIVE, 11: rules.CLOSED,
    }
    assert {k: r.siret_status for k, r in table.items()} == {k: labels[v] for k, v in expected.items()}
    assert table[5].cleaning_action == "A analyser" and table[4].cleaning_action == "Radiée"


def test_replacements(table):
    assert table[2].siret_remplacement_recommande == siret(1, 1)
    assert table[2].analysis_synthese_remplacement == rules.BY_SIBLING
    assert table[2].analysis_alerte_siren_different == "Non" and table[2].analysis_nb_candidats_remplacement == 1
    assert table[2].analysis_data_applied == rules.REPLACEMENT_DATA
    assert table[2].adresse_reconstituee.startswith("12 ") and table[2].denomination_entreprise == "ALPHA SAS"
    assert table[3].siret_remplacement_recommande == OTHER == table[3].siret_retenu
    assert table[3].analysis_alerte_siren_different == "Oui" and "another legal unit" in table[3].analysis_status_note
    assert table[4].siret_remplacement_recommande == "" == table[4].analysis_alerte_siren_different
    assert table[1].siret_remplacement_recommande == "" and table[1].siret_retenu == siret(1, 1)


def test_unloaded_replacement_shows_nothing(result):
    own_units = dataclasses.replace(result, options=dataclasses.replace(result.options, load_replacements=False))
    row = own_units.overview.filter("row_id = 3").first()
    assert row.analysis_data_applied == rules.REPLACEMENT_NOT_LOADED
    assert (row.siren, row.nic, row.adresse_reconstituee, row.tva_intracom, row.total_etablissements) == ("", "", "", "", None)


def test_replacement_from_another_unit_is_shown_without_legal_data(table):
    row = table[3]
    assert row.analysis_data_applied == rules.REPLACEMENT_DATA and row[STATE] == "A"
    assert (row.siren, row.denomination_entreprise, row.denominationUniteLegale) == ("", "", "")


def test_siren_lines(table):
    assert table[6].siret_remplacement_recommande == siret(4, 2)
    assert table[6].denomination_entreprise == "ANA REY"
    assert "head office used" in table[6].analysis_status_note
    assert "first 9 digits" in table[11].analysis_status_note
    assert table[6].analysis_historique_disponible == "Oui" and table[6].historique_latest_dateFin == "2002-01-01"
    assert table[6].analysis_nd_detecte == "Oui" and table[1].analysis_nd_detecte == "Non"
    assert table[9].analysis_status_note == "Valid SIREN without a usable establishment."


def test_invalid_line(table):
    row = table[7]
    assert (row.cleaning_action, row.analysis_priority, row.siret_format_valide) == ("Invalide", "Haute", False)
    assert row.total_etablissements == 0 and row.analysis_data_applied == rules.OWN_DATA


def test_duplicates(table):
    assert [k for k, r in table.items() if r.siret_doublon_entree == "Oui"] == [1, 10]
    assert sorted(k for k, r in table.items() if r.siren_doublon_entree == "Oui") == [1, 2, 3, 6, 10, 11]


def test_list_columns_do_not_collide(result, table):
    # The list's own column is called `siret`; as the identifier it is shown as siret_entree only.
    assert result.overview.columns[:4] == ["row_id", "ref", "note", "siret_entree"]
    assert table[1].note == "active"
    assert {"siret", "siret_entree"} <= set(result.control_table.columns)
    only = dataclasses.replace(result, options=dataclasses.replace(result.options, list_columns=("note",)))
    assert "ref" not in only.overview.columns
    groups = {f.name: f.metadata.get("group") for f in result.overview.schema}
    assert groups["note"] == "list" and groups["siret_status"] == "analysis" == column_group("analysis_priority")
    assert groups["siren_doublon_entree"] == "format" and groups["siren"] == "registry"
    assert [c for c in OVERVIEW_COLUMNS if c in result.overview.columns] == list(OVERVIEW_COLUMNS)


def test_metrics_and_side_tables(result):
    assert result.metrics.first().asDict() == {
        "total_input_siret": 11, "valid_siret_format": 10, "found_in_sirene": 8, "active": 2, "closed": 4, "radiated": 1,
        "not_found": 2, "invalid_format": 1, "move_candidates": 4, "duplicate_siren": 2, "unknown_state": 1,
    }
    assert rows(result.move_candidates, "row_id", "successeur_potentiel") == sorted(
        [(2, None), (3, OTHER), (6, None), (11, None)], key=repr
    )
    assert result.succession_links.count() == 2 and result.history.count() == 2
    assert result.all_establishments.count() == 8
    assert result.schema_report.filter("source_column is not null").count() > 10
    assert {r.parameter for r in result.run_log.collect()} >= {"input_siret_column", "input_row_count"}
    assert any("absent column" in w for w in result.warnings())


def test_every_line_once_in_any_order_and_split(spark, sample, result):
    compared = ["row_id", "siret_status", "siret_remplacement_recommande", "analysis_status_note"]
    whole = rows(result.overview, *compared)
    assert len(whole) == len(LINES)
    mixed = LINES[:]
    random.Random(3).shuffle(mixed)
    options = ControlOptions(row_id="ref")
    assert rows(run_control(lines_frame(spark, mixed), "siret", sample, options).overview, *compared) == whole
    halves = [run_control(lines_frame(spark, part), "siret", sample, options).overview for part in (LINES[:4], LINES[4:])]
    assert sorted(rows(halves[0], *compared) + rows(halves[1], *compared), key=repr) == whole


def test_without_optional_tables_and_row_id(spark):
    bare = registry(spark, [est(1, 1, "A"), est(1, 2, "F")])
    run = run_control(lines_frame(spark, LINES[:3]), "siret", bare)
    assert run.succession_links is None and run.history is None
    table = {r.ref: r for r in run.overview.collect()}
    assert table["2"].siret_remplacement_recommande == siret(1, 1)
    assert table["2"].analysis_succession_disponible == "Non" and table["2"].historique_records_count is None
    assert "siret_status" in run.control_table.columns
    with pytest.raises(ValueError, match="nowhere"):
        run_control(lines_frame(spark), "nowhere", bare)


def test_history_that_only_knows_legal_units(spark, sample):
    by_unit = spark.createDataFrame([(siren(1), "2001-01-01"), (siren(1), "2002-01-01")], "siren string, dateDebut string")
    known = registry_from_frames(sample.establishments, sample.legal_units, None, by_unit)
    run = run_control(lines_frame(spark), "siret", known, ControlOptions(row_id="ref"))
    row = run.overview.filter("row_id = 1").first()
    assert (row.historique_records_count, row.historique_latest_dateDebut, row.historique_latest_dateFin) == (2, "2002-01-01", "")


def test_hot_identifier_and_registry_rows_out_of_contract(spark, sample):
    lines = [(str(i), siret(1, 2) if i % 3 else "bad", "") for i in range(3000)]
    table = run_control(lines_frame(spark, lines), "siret", sample, ControlOptions(row_id="ref")).overview
    counted = {r.cleaning_action: r["count"] for r in table.groupBy("cleaning_action").count().collect()}
    assert counted == {"Remplacer": 2000, "Invalide": 1000}


def test_closed_without_any_replacement(spark):
    """Cannot come out of a run (such a row is radiated), so the rules get it directly."""
    frame = spark.createDataFrame(
        [(siret(1, 1), siret(1, 1), rules.CLOSED, None, None, 0, None, "SIRET", "SIRET_OK", None)],
        "siret_normalized string, siret string, siret_status string, successor_siret string, sibling_siret string, "
        "sibling_candidates bigint, sibling_reason string, siret_input_type string, siret_validation_route string, matched_mode string",
    )
    row = with_rules(frame).first()
    assert row.cleaning_action == rules.CLOSE and row.analysis_priority == "MEDIUM"
    assert row.analysis_synthese_remplacement == rules.NO_REPLACEMENT and row.analysis_nb_candidats_remplacement == 0
    assert row.analysis_alerte_siren_different is None and row.siret_retenu is None
    assert row.analysis_status_note == "Establishment is closed; no replacement."


def test_result_tables(spark, result, tmp_path):
    missing = spark.createDataFrame([("12", "00", "zero")], COLUMNS)
    scope = scoping.scope_counts(lines_frame(spark).unionByName(missing), None, "siret")
    paths = write_results(result, str(tmp_path), ["ref", "note"], scope, missing)
    assert set(paths) == set(RESULTS)
    read = {n: spark.read.parquet(p) for n, p in paths.items()}
    assert read["siret_overview"].count() == 11
    assert rows(read["anomalies"], "ref", "siret_entree", "Motif") == sorted([
        ("12", "00", scoping.MISSING_REASON), ("7", "123", reports.INVALID_REASON),
        ("8", siret(8, 1), reports.NOT_FOUND_REASON), ("9", siren(9), reports.NOT_FOUND_REASON),
    ], key=repr)
    assert rows(read["siret_a_cloturer"], "row_id", "probleme_siret") == [(4, "radiated"), (5, "radiated")]
    listed = [tuple(r) for r in reports.listing_order(read["doublons"]).select("Motif", "row_id").collect()]
    assert listed[:2] == [(reports.SIRET_DUPLICATE, 1), (reports.SIRET_DUPLICATE, 10)]
    assert sorted(r for m, r in listed if m == reports.SIREN_DUPLICATE) == [1, 2, 3, 6, 10, 11]
    stats = {(r.section, r.indicateur): (r.valeur, r.part_du_total) for r in read["statistiques"].collect()}
    assert stats[("input", "lines in the list")] == (12, 1.0) and stats[("identifiers", "missing")][0] == 1
    assert stats[("status", "radiated")] == (2, 2 / 11) and stats[("input", "distinct duplicate SIREN")] == (2, None)
    assert stats[("attention", "replacement on another SIREN")] == (1, 0.25)
    with pytest.raises(Exception):
        write_results(result, str(tmp_path), ["ref"], scope)


def test_empty_population_gives_zero_shares(spark, sample):
    run = run_control(lines_frame(spark, [("1", siret(1, 1), "")]), "siret", sample, ControlOptions(row_id="ref"))
    scope = scoping.scope_counts(lines_frame(spark, [("1", siret(1, 1), "")]), None, "siret")
    stats = {(r.section, r.indicateur): r.part_du_total for r in reports.statistics_table(run.overview, scope).collect()}
    assert stats[("replacement", "none")] == 0.0


def test_legal_unit_fields_reach_the_overview(result):
    assert set(LEGAL_UNIT_FIELDS) <= set(result.overview.columns)
    assert result.overview.filter(F.col("siren").isNull()).isEmpty()


def test_case_and_suffix_collisions_of_list_columns(spark, result, tmp_path):
    lines = spark.createDataFrame(
        [(siret(1, 1), "a", "b", "c"), (siret(1, 1), "d", "e", "f"), ("99", "x", "y", "z")],
        "id string, SIREN string, siren_entree string, `Nic` string",
    )
    run = run_control(lines, "id", result.registry)
    names = [n.lower() for n in run.overview.columns]
    assert len(names) == len(set(names))
    run.overview.write.parquet(str(tmp_path / "overview"))
    back = spark.read.parquet(str(tmp_path / "overview"))
    for overview in (run.overview, back):
        (bad,) = reports.anomalies_table(overview, ["SIREN", "siren_entree"]).collect()
        assert (bad.siret_entree, bad[2], bad[3]) == ("99", "x", "y")
        duplicates = reports.duplicates_table(overview, ["SIREN", "Nic"])
        assert len({c.lower() for c in duplicates.columns}) == len(duplicates.columns)
        assert {(r[1], r[2]) for r in duplicates.collect()} == {("a", "c"), ("d", "f")}


def test_history_of_an_identifier_the_stock_lacks(spark, result):
    gone = siret(70, 1)
    base = result.registry.history
    period = spark.createDataFrame([(gone, gone[:9], "2001-01-01", "2003-01-01")], "siret string, siren string, dateDebut string, dateFin string")
    registry = dataclasses.replace(result.registry, history=base.unionByName(period, allowMissingColumns=True))
    run = run_control(spark.createDataFrame([(gone,)], "id string"), "id", registry)
    row = run.overview.first()
    assert row.siret_status == rules.STATUS_LABELS[rules.NOT_FOUND]
    assert (row.analysis_historique_disponible, row.historique_latest_dateFin) == ("Oui", "2003-01-01")
    assert run.history.count() == 1
