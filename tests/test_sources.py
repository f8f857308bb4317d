import csv

import pytest

from registra import schema
from registra.sources.registry import RegistryPaths, read_parquet_source, read_registry
from registra.sources.user_list import read_user_list
from tests.samples import rows, siren


def test_names_resolve_whatever_their_spelling():
    resolved = schema.resolve(["SIRET", "siren", "etat_administratif_etablissement", "autre"], schema.ESTABLISHMENTS)
    assert resolved.columns["siret"] == "SIRET"
    assert resolved.columns["etatAdministratifEtablissement"] == "etat_administratif_etablissement"
    assert "nic" in resolved.missing


@pytest.mark.parametrize(
    ("columns", "expected", "source"),
    [
        (["activitePrincipaleEtablissement"], schema.CLASSIFICATION_2008, "activitePrincipaleEtablissement"),
        (["activite_principale_naf25_etablissement"], schema.CLASSIFICATION_2025, "activite_principale_naf25_etablissement"),
        (
            ["activitePrincipaleNAF25Etablissement", "activitePrincipaleEtablissement"],
            schema.CLASSIFICATION_2008, "activitePrincipaleEtablissement",
        ),
        ([], None, None),
    ],
)
def test_activity_classification(columns, expected, source):
    resolved = schema.resolve(["siret", "siren", *columns], schema.ESTABLISHMENTS)
    assert resolved.activity_classification == expected
    assert resolved.columns.get("activitePrincipaleEtablissement") == source


def test_lookup_key_is_required():
    with pytest.raises(ValueError, match="siren"):
        schema.resolve(["siret"], schema.ESTABLISHMENTS)


def test_numeric_identifiers_get_their_zeros_back(spark):
    stored = spark.createDataFrame([(123, 45, 7)], "siret long, siren long, nic int")
    table = schema.canonical(stored, schema.resolve(stored.columns, schema.ESTABLISHMENTS))
    assert rows(table, "siret", "siren", "nic") == [("00000000000123", "000000045", "00007")]
    assert dict(table.dtypes) == {f: "string" for f in schema.ESTABLISHMENTS.fields}
    text = spark.createDataFrame([("1234567890123456", "", "x")], "siret string, siren string, nic string")
    table = schema.canonical(text, schema.resolve(text.columns, schema.ESTABLISHMENTS))
    assert rows(table, "siret", "siren", "nic") == [("1234567890123456", None, None)]


def test_schema_report_lists_every_column(spark):
    resolved = schema.resolve(["siren", "activitePrincipaleNAF25UniteLegale"], schema.LEGAL_UNITS)
    report = {r.field: r for r in schema.schema_report(spark, [resolved]).collect()}
    assert len(report) == len(schema.LEGAL_UNITS.fields)
    assert report["activitePrincipaleUniteLegale"].activity_classification == schema.CLASSIFICATION_2025
    assert report["nomUniteLegale"].source_column is None


def test_paths(spark, tmp_path):
    data = spark.createDataFrame([(siren(1),)], "siren string")
    data.write.parquet(str(tmp_path / "a" / "b"))
    for path in (tmp_path / "a", f"{tmp_path}/a/*"):
        assert read_parquet_source(spark, str(path), "units").count() == 1
    with pytest.raises(ValueError, match="units"):
        read_parquet_source(spark, str(tmp_path / "nowhere"), "units")
    with pytest.raises(ValueError, match="required"):
        read_parquet_source(spark, " ", "units")
    assert read_parquet_source(spark, None, "links", required=False) is None


def test_unusable_optional_table_is_left_out(spark, tmp_path):
    for name, columns in (("e", "siret string, siren string"), ("u", "siren string"), ("l", "other string")):
        spark.createDataFrame([], columns).write.parquet(str(tmp_path / name))
    registry = read_registry(spark, RegistryPaths(*[str(tmp_path / n) for n in ("e", "u", "l")]))
    assert registry.links is None and registry.history is None
    assert any(w.startswith("establishments") for w in registry.warnings())


@pytest.mark.parametrize("separator", [",", ";", "\t", "|"])
def test_csv_list(spark, tmp_path, separator):
    lines = [["id", "pays"], ["007", "FR"], ["  ", " "], ["12", ""]]
    path = tmp_path / "list.csv"
    path.write_text("\n".join(separator.join(line) for line in lines) + "\n", encoding="utf-8")
    assert rows(read_user_list(spark, str(path)), "id", "pays") == [("007", "FR"), ("12", None)]
    plain = read_user_list(spark, str(path), has_header=False)
    assert plain.columns == ["column_1", "column_2"] and plain.count() == 3  # the header is a row here
    # Spark's CSV reader always skips a line of white space only, which the blank tab-separated line is.
    kept = 2 if separator == "\t" else 3
    assert read_user_list(spark, str(path), ignore_blank_rows=False).count() == kept


def test_parquet_list_is_text(spark, tmp_path):
    spark.createDataFrame([(1, None)], "id long, other string").write.parquet(str(tmp_path / "l.parquet"))
    assert dict(read_user_list(spark, str(tmp_path / "l.parquet")).dtypes) == {"id": "string", "other": "string"}


def test_empty_list_is_refused(spark, tmp_path):
    path = tmp_path / "list.csv"
    path.write_text("id,pays\n ,\n", encoding="utf-8")
    with pytest.raises(ValueError, match="no row left"):
        read_user_list(spark, str(path))


@pytest.mark.parametrize(
    ("text", "problem"),
    [
        ("id;b\n1;a\n2;b;EXTRA\n3\n", "1 rows have more than 2 cells"),
        ("id;b\n1;a;\n2;b;\n", "2 rows have more than 2 cells"),
        ("id;b\n1;a;;;\n2;b;c;d\n", "2 rows have more than 2 cells"),
        ('id;b\n"1;2";"a";"x;y"\n', "1 rows have more than 2 cells"),
        ('id;b\n1;"two\nlines"\n', "quote open.*multi_line"),
    ],
)
def test_damaged_csv_is_refused(spark, tmp_path, text, problem):
    path = tmp_path / "list.csv"
    path.write_text(text, encoding="utf-8")
    with pytest.raises(ValueError, match=problem):
        read_user_list(spark, str(path), delimiter=";")


@pytest.mark.parametrize(("text", "problem"), [('id;b\n1;"a\n2;b\n3;c\n', "1 lines leave a quote open$"), ('id;b\n1;"a\nb";c\n2;d\n', "1 rows have more")])
def test_damaged_records_of_many_lines_are_refused(spark, tmp_path, text, problem):
    path = tmp_path / "list.csv"
    path.write_text(text, encoding="utf-8")
    with pytest.raises(ValueError, match=problem):
        read_user_list(spark, str(path), delimiter=";", multi_line=True)


def test_list_is_parsed_once(spark, tmp_path):
    """What is handed on reads the written cells; neither the list nor whole files as values are read again."""
    folder = tmp_path / "list"
    folder.mkdir()
    for part in range(3):
        (folder / f"{part}.csv").write_text(f"_0more;_0RAW\n{part};x\n\n;\n", encoding="utf-8")
    listed = read_user_list(spark, str(folder), delimiter=";")
    assert rows(listed, "_0more", "_0RAW") == [("0", "x"), ("1", "x"), ("2", "x")]
    assert listed.inputFiles() and all(f.endswith(".parquet") for f in listed.inputFiles())
    assert read_user_list(spark, str(folder), delimiter=";", ignore_blank_rows=False).count() == 6


def test_file_without_lines(spark, tmp_path):
    path = tmp_path / "list.csv"
    path.write_text("", encoding="utf-8")
    with pytest.raises(ValueError, match="no row left"):
        read_user_list(spark, str(path))


def test_unclear_delimiter_is_refused(spark, tmp_path, monkeypatch):
    def unclear(*_, **__):
        raise csv.Error

    monkeypatch.setattr(csv.Sniffer, "sniff", unclear)
    path = tmp_path / "list.csv"
    path.write_text("id;b\n1;a\n", encoding="utf-8")
    with pytest.raises(ValueError, match="fit no delimiter"):
        read_user_list(spark, str(path))
    path.write_text("id\n1\n", encoding="utf-8")
    assert rows(read_user_list(spark, str(path)), "id") == [("1",)]


def test_quoted_cells_and_short_rows(spark, tmp_path):
    path = tmp_path / "list.csv"
    path.write_text('id;b\n1;"x;y ""z"" \nline"\n2\n3;5" pipe\n', encoding="utf-8")
    got = rows(read_user_list(spark, str(path), delimiter=";", multi_line=True), "id", "b")
    assert got == [("1", 'x;y "z" \nline'), ("2", None), ("3", '5" pipe')]


def test_storage_is_shared_or_an_error(spark, tmp_path, monkeypatch):
    from registra import session
    from registra.operators import held as holding

    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Cluster:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda name, default: None)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_folder(Cluster())
    monkeypatch.setattr(holding, "_FOLDERS", set())
    monkeypatch.setattr(holding, "shared_folder", lambda _: str(tmp_path))
    assert holding.held(spark.range(3), "numbers").count() == 3
    assert list(tmp_path.glob("registra/*/numbers-*"))
    holding.release()
    assert not list(tmp_path.glob("registra/*"))
