"""Which rows of the list are checked: country scope and missing identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from registra.functions.identifiers import identifier_valid
from registra.functions.text import digits, fold

# Spellings of the home country after folding.
HOME_COUNTRY = ("fr", "fra", "france")

HOME, UNKNOWN, FOREIGN = "home", "unknown", "foreign"
MISSING_REASON = "identifier empty or zero"


def country_scope(country: Column) -> Column:
    folded = fold(country)
    return (
        F.when(folded.isin(*HOME_COUNTRY), HOME)
        .when(folded.rlike("^0*$"), UNKNOWN)
        .otherwise(FOREIGN)
    )


def with_country_scope(df: DataFrame, country_column: str, identifier_column: str) -> DataFrame:
    """Add `country_scope` and whether the row would pass as foreign with a valid identifier."""
    scope = country_scope(F.col(f"`{country_column}`"))
    valid = identifier_valid(F.col(f"`{identifier_column}`"))
    return df.withColumn("country_scope", scope).withColumn(
        "foreign_valid", (F.col("country_scope") == FOREIGN) & valid
    )


def keep_country(df: DataFrame, include_foreign_valid: bool = False) -> DataFrame:
    kept = F.col("country_scope").isin(HOME, UNKNOWN)
    return df.filter(kept | F.col("foreign_valid") if include_foreign_valid else kept)


def is_missing(identifier: Column) -> Column:
    """No digit at all, or zeros only."""
    return digits(identifier).rlike("^0*$")


def split_missing(df: DataFrame, identifier_column: str) -> tuple[DataFrame, DataFrame]:
    """(rows to check, rows set aside with their reason)."""
    missing = is_missing(F.col(f"`{identifier_column}`"))
    return df.filter(~missing), df.filter(missing).withColumn("exclusion_reason", F.lit(MISSING_REASON))


def scope_counts(df: DataFrame, country_column: str | None, identifier_column: str,
                 include_foreign_valid: bool = False) -> DataFrame:
    """Volumes that the statistics report needs, in one pass over the list."""
    missing = is_missing(F.col(f"`{identifier_column}`"))
    if country_column is None:
        return df.agg(
            F.count("*").alias("total_rows"),
            F.count("*").alias("home_rows"),
            F.lit(0).cast("bigint").alias("foreign_rows"),
            F.lit(0).cast("bigint").alias("unknown_country_rows"),
            F.lit(0).cast("bigint").alias("foreign_kept_rows"),
            F.count_if(missing).alias("missing_rows"),
        )
    scoped = with_country_scope(df, country_column, identifier_column)
    scope = F.col("country_scope")
    foreign_kept = F.col("foreign_valid") if include_foreign_valid else F.lit(False)
    kept = scope.isin(HOME, UNKNOWN) | foreign_kept
    return scoped.agg(
        F.count("*").alias("total_rows"),
        F.count_if(scope == HOME).alias("home_rows"),
        F.count_if(scope == FOREIGN).alias("foreign_rows"),
        F.count_if(scope == UNKNOWN).alias("unknown_country_rows"),
        F.count_if(foreign_kept).alias("foreign_kept_rows"),
        F.count_if(kept & missing).alias("missing_rows"),
    )
