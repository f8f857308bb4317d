"""Check-digit validation and routing of SIRET (14 digits) and SIREN (9 digits) identifiers."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from registra.functions.text import digits

# The national postal operator, whose SIRET may also be valid by plain digit sum.
POSTAL_SIREN = "356000000"
POSTAL_SUM_STEP = 5

VALIDATION_COLUMNS = (
    "siret_input",
    "siret_normalized",
    "siret_lookup_key",
    "siret_input_type",
    "siret_validation_route",
    "siret_len_ok",
    "siret_luhn_ok",
    "siret_format_ok",
)


def luhn_valid(number: Column) -> Column:
    """Luhn key; the all-zero placeholder, which passes the arithmetic, is refused."""
    return F.coalesce(number.rlike("^0*[1-9][0-9]*$") & F.call_function("luhn_check", number), F.lit(False))


def _postal_valid(number: Column) -> Column:
    # The first nine digits are fixed, so only the last five are summed. Substrings instead of a lambda
    # over an array keep the stage in generated code.
    head = sum(int(digit) for digit in POSTAL_SIREN)
    total = reduce(add, [F.substring(number, i, 1).try_cast("int") for i in range(10, 15)], F.lit(head))
    return (F.length(number) == 14) & number.startswith(POSTAL_SIREN) & (total % POSTAL_SUM_STEP == 0)


def key_valid(number: Column) -> Column:
    plausible = number.rlike("^0*[1-9][0-9]*$")
    return F.coalesce(plausible & (F.call_function("luhn_check", number) | _postal_valid(number)), F.lit(False))


def identifier_valid(column: Column) -> Column:
    """Whether a raw value holds a valid SIRET or, failing that, a valid SIREN."""
    number = digits(column)
    cut, head = F.substring(number, 1, 14), F.substring(number, 1, 9)
    return ((F.length(cut) == 14) & key_valid(cut)) | ((F.length(head) == 9) & key_valid(head))


def check_identifiers(df: DataFrame, column: str) -> DataFrame:
    """Append the eight validation columns for the identifier in `column`.

    A valid 14-digit key wins; otherwise the first nine digits are tried as a SIREN. Longer input is
    cut to 14 digits. Narrow projections only, no shuffle.
    """
    raw = F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))
    staged = (
        df.withColumn("siret_input", raw)
        .withColumn("_digits", digits(F.col("siret_input")))
        .withColumn("siret_normalized", F.substring("_digits", 1, 14))
        .withColumn("_head", F.substring("_digits", 1, 9))
    )
    number, head = F.col("siret_normalized"), F.col("_head")
    staged = staged.withColumn(
        "siret_input_type",
        F.when((F.length(number) == 14) & key_valid(number), "SIRET")
        .when((F.length(head) == 9) & key_valid(head), "SIREN")
        .otherwise(""),
    )
    kind = F.col("siret_input_type")
    return staged.withColumns(
        {
            "siret_lookup_key": F.when(kind == "SIREN", head).otherwise(number),
            "siret_validation_route": F.when(kind == "SIRET", "SIRET_OK")
            .when((kind == "SIREN") & (F.length("_digits") == 9), "SIREN_DIRECT")
            .when(kind == "SIREN", "SIREN_FALLBACK_FROM_SIRET")
            .otherwise("INVALID"),
            "siret_len_ok": kind != "",
            "siret_luhn_ok": kind != "",
            "siret_format_ok": kind != "",
        }
    ).drop("_digits", "_head")


def vat_number(siren: Column) -> Column:
    """Intra-community VAT number of a nine-digit SIREN, null otherwise."""
    number = digits(siren)
    key = (12 + 3 * (number.try_cast("bigint") % 97)) % 97
    return F.when(F.length(number) == 9, F.format_string("FR%02d%s", key, number))
