"""Writing results: one table per result."""

from __future__ import annotations

from pyspark.sql import DataFrame

from registra.operators import reports
from registra.plans.control import ControlResult

RESULTS = ("siret_overview", "statistiques", "anomalies", "doublons", "siret_a_cloturer", "params_logs")


def write_results(
    result: ControlResult,
    folder: str,
    list_columns: list[str],
    scope: DataFrame,
    missing_rows: DataFrame | None = None,
    by_country: bool = False,
    foreign_included: bool = False,
    mode: str = "errorifexists",
) -> dict[str, str]:
    """Write the overview, then the tables that follow from it, and return their paths.

    The overview is computed once; the other tables read it back. It is partitioned by status, so the
    status filters of the derived tables only open the partitions they need.
    """
    spark = result.checked.sparkSession
    paths = {name: f"{folder.rstrip('/')}/{name}" for name in RESULTS}
    result.overview.write.mode(mode).partitionBy("siret_status").parquet(paths["siret_overview"])
    overview = spark.read.schema(result.overview.schema).parquet(paths["siret_overview"])
    tables = {
        "statistiques": reports.statistics_table(overview, scope, by_country, foreign_included),
        "anomalies": reports.anomalies_table(overview, list_columns, missing_rows, result.identifier_column),
        "doublons": reports.listing_order(reports.duplicates_table(overview, list_columns)),
        "siret_a_cloturer": reports.to_close_table(overview),
    }
    for name, table in tables.items():
        table.write.mode(mode).parquet(paths[name])
    result.run_log.write.mode("append").parquet(paths["params_logs"])
    return paths
