"""Which columns of an unknown list hold the identifier and the country."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from registra.functions.identifiers import identifier_valid
from registra.operators.scoping import HOME, country_scope


# Terms that name a role; a column name only settles ties between columns of equal content.
IDENTIFIER_TERMS = ("siret", "siren")
COUNTRY_TERMS = ("pays", "country")


def name_match(name: str, terms: tuple[str, ...]) -> int:
    """2 if a term is a word of the name, 1 if the name contains one, else 0."""
    folded = name.lower()
    if set(re.findall(r"[a-z0-9]+", folded)) & set(terms):
        return 2
    return int(any(term in folded for term in terms))


def profile_columns(df: DataFrame) -> DataFrame:
    """Per column: filled lines, valid identifiers, home-country values and how its name matches; one scan."""
    aggregates = [F.count("*").alias("rows")]
    for i, name in enumerate(df.columns):
        value = F.col(f"`{name}`").cast("string")
        aggregates += [
            F.count_if(value.rlike(r"\S")).alias(f"filled_{i}"),
            F.count_if(identifier_valid(value)).alias(f"valid_{i}"),
            F.count_if(country_scope(value) == HOME).alias(f"home_{i}"),
        ]
    counted = df.agg(*aggregates)

    def share(column: str):
        return F.when(F.col("rows") > 0, F.col(column) / F.col("rows")).otherwise(0.0)

    entries = [
        F.struct(
            F.lit(name).alias("column_name"),
            F.col("rows"),
            share(f"filled_{i}").alias("filled_share"),
            share(f"valid_{i}").alias("valid_identifier_share"),
            share(f"home_{i}").alias("home_country_share"),
            F.lit(name_match(name, IDENTIFIER_TERMS)).alias("identifier_name_match"),
            F.lit(name_match(name, COUNTRY_TERMS)).alias("country_name_match"),
        )
        for i, name in enumerate(df.columns)
    ]
    return counted.select(F.inline(F.array(*entries)))


def suggested_columns(profile: DataFrame) -> DataFrame:
    """The identifier and the country column of a profile: by content, the name deciding ties."""

    def best(share: str, score: str):
        plausible = (F.col(share) > 0) | (F.col(score) > 0)
        return F.max_by("column_name", F.when(plausible, F.struct(share, score)))

    return profile.agg(
        best("valid_identifier_share", "identifier_name_match").alias("identifier_column"),
        best("home_country_share", "country_name_match").alias("country_column"),
    )
