import pytest
from pyspark.sql import functions as F

from registra.functions import identifiers as ids
from registra.functions import naming, text
from tests.samples import luhn_digit, siren, siret

SIREN, SIRET = siren(1), siret(1, 2)
BAD_SIRET = SIRET[:13] + str((int(SIRET[13]) + 1) % 10)


def one(spark, expression, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expression(F.col("v"))).first()[0]


def postal(nic_sum_ok: bool) -> str:
    """An identifier of the postal operator that fails Luhn and passes, or not, the plain sum."""
    for nic in range(1, 99999):
        number = f"{ids.POSTAL_SIREN}{nic:05d}"
        luhn = luhn_digit(number[:13]) == number[13]
        if not luhn and (sum(map(int, number)) % 5 == 0) == nic_sum_ok:
            return number
    raise AssertionError


@pytest.mark.parametrize(
    ("value", "expected"),
    [(None, ""), ("", ""), ("12 34-5", "12345"), ("SIRET: 12345 ", "12345"), ("abc", ""), ("١٢3", "3")],
)
def test_digits(spark, value, expected):
    assert one(spark, text.digits, value) == expected


@pytest.mark.parametrize(
    ("value", "expected"),
    [
        (SIRET, True), (SIREN, True), (BAD_SIRET, False), ("0" * 14, False), ("0", False), ("12abc", False), ("", False),
        (None, False), (ids.POSTAL_SIREN, True), (postal(True), True), (postal(False), False), (postal(True)[:12], False),
    ],
)
def test_key_valid(spark, value, expected):
    assert one(spark, ids.key_valid, value) is expected
    assert one(spark, ids.identifier_valid, value) in (True, False)


def test_sum_rule_is_for_the_postal_operator_only(spark):
    other = next(
        n for n in (f"{SIREN}{k:05d}" for k in range(99999))
        if sum(map(int, n)) % 5 == 0 and luhn_digit(n[:13]) != n[13]
    )
    assert one(spark, ids.key_valid, other) is False


@pytest.mark.parametrize(
    ("value", "kind", "route", "key"),
    [
        (SIRET, "SIRET", "SIRET_OK", SIRET),
        (SIRET + ".0", "SIRET", "SIRET_OK", SIRET),
        (f"{SIRET[:3]} {SIRET[3:9]}-{SIRET[9:]}", "SIRET", "SIRET_OK", SIRET),
        (SIREN, "SIREN", "SIREN_DIRECT", SIREN),
        (BAD_SIRET, "SIREN", "SIREN_FALLBACK_FROM_SIRET", SIREN),
        (SIREN + ".0", "SIREN", "SIREN_FALLBACK_FROM_SIRET", SIREN),
        ("123", "", "INVALID", "123"),
        ("", "", "INVALID", ""),
        (None, "", "INVALID", ""),
        (postal(True), "SIRET", "SIRET_OK", postal(True)),
    ],
)
def test_route(spark, value, kind, route, key):
    df = spark.createDataFrame([(value,)], "ident string")
    row = ids.check_identifiers(df, "ident").first()
    assert (row.siret_input_type, row.siret_validation_route, row.siret_lookup_key) == (kind, route, key)
    assert row.siret_format_ok is (kind != "")
    assert set(ids.VALIDATION_COLUMNS) <= set(row.asDict())


@pytest.mark.parametrize("value", [None, "", "123", "12345678901"])
def test_vat_needs_nine_digits(spark, value):
    assert one(spark, ids.vat_number, value) is None


def test_vat(spark):
    key = (12 + 3 * (int(SIREN) % 97)) % 97
    spaced = f"{SIREN[:3]} {SIREN[3:6]} {SIREN[6:]}"
    assert one(spark, ids.vat_number, spaced) == f"FR{key:02d}{SIREN}"


def test_text_helpers(spark):
    assert one(spark, text.text_or_null, " nan ") is None
    assert one(spark, text.text_or_null, " x ") == "x"
    assert one(spark, text.fold, "  Île-de-FRANCE ÇÉ") == "ile-de-france ce"
    assert one(spark, lambda c: text.search_link("b?q=", c), "A & É") == "b?q=A%20%26%20%C3%89"
    assert one(spark, text.date_or_null, "not a date") is None
    assert one(spark, text.is_true, "Oui ") is True
    assert one(spark, text.is_true, None) is False


def test_company_name_and_address(spark):
    base = {n: None for n in naming.COMPANY_NAMES + naming.PERSON_NAMES}
    schema = ", ".join(f"{n} string" for n in base)

    def name(**given):
        return spark.createDataFrame([tuple({**base, **given}.values())], schema).select(naming.company_name()).first()[0]

    assert name(denominationUniteLegale=" nan ", sigleUniteLegale="SIG") == "SIG"
    assert name(prenom1UniteLegale="Ana", prenom2UniteLegale="nan", nomUniteLegale="Rey") == "Ana Rey"
    assert name() is None
    assert one(spark, naming.without_legal_form, "Sas du Lac SARL") == "DU LAC"
    assert one(spark, naming.without_legal_form, "SASSE") == "SASSE"
