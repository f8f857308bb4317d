"""Company names and addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from registra.functions.text import first_text, joined_text
from registra.schema import ADDRESS_FIELDS

# Order in which legal-unit names are preferred, then the parts of a person's name.
COMPANY_NAMES = (
    "denominationUniteLegale",
    "denominationUsuelle1UniteLegale",
    "denominationUsuelle2UniteLegale",
    "denominationUsuelle3UniteLegale",
    "sigleUniteLegale",
)
PERSON_NAMES = (
    "prenom1UniteLegale",
    "prenom2UniteLegale",
    "prenom3UniteLegale",
    "nomUsageUniteLegale",
    "nomUniteLegale",
)
# Legal forms that carry no meaning when names are compared.
LEGAL_FORMS = ("SAS", "SARL", "SA", "SNC", "EURL", "SASU", "SCI", "GIE", "EI")


def address_line(prefix: str = "") -> Column:
    return joined_text([F.col(f"{prefix}{name}") for name in ADDRESS_FIELDS])


def company_name() -> Column:
    return F.coalesce(
        first_text(F.col(n) for n in COMPANY_NAMES),
        joined_text(F.col(n) for n in PERSON_NAMES),
    )


def without_legal_form(name: Column) -> Column:
    """Upper-case name with legal-form words removed, ready for comparison."""
    pattern = r"\b(" + "|".join(LEGAL_FORMS) + r")\b"
    return F.trim(F.regexp_replace(F.upper(name), pattern, ""))
