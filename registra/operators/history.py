"""Periods of establishments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from registra.sources.pruned import in_ranges_of

SUMMARY = ("historique_records_count", "historique_latest_dateDebut", "historique_latest_dateFin")


def history_slice(history: DataFrame, sirets: DataFrame | None = None, sirens: DataFrame | None = None) -> DataFrame:
    """Periods of the given establishments; by legal unit only when no SIRET set is given."""
    if sirets is not None:
        return in_ranges_of(history, sirets, "siret").join(sirets.select("siret").distinct(), "siret", "left_semi")
    if sirens is None:
        raise ValueError("history_slice needs SIRET or SIREN keys")
    return in_ranges_of(history, sirens, "siren").join(sirens.select("siren").distinct(), "siren", "left_semi")


def history_summary(history: DataFrame, key: str = "siret", has_start: bool = True, has_end: bool = True) -> DataFrame:
    """Number of periods, latest start, latest end.

    An open period (no end) is the current one, so it leaves the latest end empty. A date column the
    table does not have gives null.
    """
    # Maxima of dates, not of text: fixed-width values keep the partial aggregate in a hash table,
    # text would be sorted first. The registry publishes ISO dates, so nothing changes in the output.
    start, end = F.col("dateDebut").try_cast("date"), F.col("dateFin").try_cast("date")
    is_open = F.coalesce(F.trim("dateFin") == "", F.lit(True))
    latest_end = F.when(F.count_if(is_open) == 0, F.max(end)).cast("string")
    return (
        history.filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(
            F.count("*").alias(SUMMARY[0]),
            (F.max(start).cast("string") if has_start else F.lit(None).cast("string")).alias(SUMMARY[1]),
            (latest_end if has_end else F.lit(None).cast("string")).alias(SUMMARY[2]),
        )
    )
