"""Registry tables in Parquet: establishments, legal units, succession links, history."""

from __future__ import annotations

import dataclasses
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from registra import schema
from registra.schema import PREDECESSOR, Resolution, TableSpec

WILDCARDS = ("*", "?", "[", "{")


@dataclass(frozen=True)
class RegistryPaths:
    """Where the four tables are; links and history may be absent."""

    establishments: str
    legal_units: str
    links: str | None = None
    history: str | None = None


# What ranking, counting and status need; everything else is read once, for the rows kept.
RANKING_FIELDS = (
    "siret",
    "siren",
    "etatAdministratifEtablissement",
    "etablissementSiege",
    "dateDebut",
    "dateCreationEtablissement",
)

#: Column of a copy laid out by ranges (`registra.sources.pruned`); lookups use it and drop it.
KEY_RANGE = "key_range"


@dataclass(frozen=True)
class Registry:
    """Canonical, lazy registry tables. Optional tables are None when not supplied or not usable.

    `siblings` is a second copy of the ranking columns laid out by `siren`, when there is one. `successors` holds the best
    link of each predecessor where a publication keeps it (`registra.operators.link_state`); runs then rank no links.
    """

    establishments: DataFrame
    legal_units: DataFrame
    links: DataFrame | None = None
    history: DataFrame | None = None
    resolutions: tuple[Resolution, ...] = ()
    siblings: DataFrame | None = None
    paths: RegistryPaths | None = None
    successors: DataFrame | None = None

    @property
    def ranking(self) -> DataFrame:
        """Ranking columns of every establishment, for lookups by `siren`."""
        return self.narrow if self.siblings is None else self.siblings

    @property
    def narrow(self) -> DataFrame:
        """Ranking columns of every establishment, with the range of a copy laid out by ranges."""
        laid_out = [c for c in self.establishments.columns if c == KEY_RANGE]
        return self.establishments.select(*RANKING_FIELDS, *laid_out)

    def missing(self, table: TableSpec) -> set[str]:
        """Canonical columns the stored table does not have."""
        return {name for r in self.resolutions if r.table == table for name in r.missing}

    def warnings(self) -> list[str]:
        return [
            f"{r.table.name}: absent column(s) read as empty: {', '.join(r.missing)}"
            for r in self.resolutions
            if r.missing
        ]


def read_parquet_source(spark: SparkSession, path: str | None, label: str, required: bool = True) -> DataFrame | None:
    """A file, a directory searched to any depth, or a wildcard path."""
    path = (path or "").strip().strip("\"'")
    if not path:
        if required:
            raise ValueError(f"{label}: a path is required")
        return None
    reader = spark.read
    if not any(mark in path for mark in WILDCARDS):
        reader = reader.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")
    try:
        return reader.parquet(path)
    except AnalysisException as failure:
        raise ValueError(f"{label}: nothing to read at {path}") from failure


def _canonical(df: DataFrame, table: TableSpec, pad_ids: bool) -> tuple[DataFrame | None, Resolution]:
    resolution = schema.resolve(df.columns, table)
    if table.any_of and not any(name in resolution.columns for name in table.any_of):
        return None, resolution
    return schema.canonical(df, resolution, pad_ids), resolution


def registry_from_frames(
    establishments: DataFrame,
    legal_units: DataFrame,
    links: DataFrame | None = None,
    history: DataFrame | None = None,
    pad_ids: bool = True,
) -> Registry:
    tables: list[DataFrame | None] = []
    resolutions = []
    for df, table in (
        (establishments, schema.ESTABLISHMENTS),
        (legal_units, schema.LEGAL_UNITS),
        (links, schema.LINKS),
        (history, schema.HISTORY),
    ):
        if df is None:
            tables.append(None)
            continue
        projected, resolution = _canonical(df, table, pad_ids)
        tables.append(projected)
        resolutions.append(resolution)
    return Registry(*tables, resolutions=tuple(resolutions))


def read_registry(spark: SparkSession, paths: RegistryPaths, pad_ids: bool = True) -> Registry:
    registry = registry_from_frames(
        read_parquet_source(spark, paths.establishments, "establishments"),
        read_parquet_source(spark, paths.legal_units, "legal units"),
        read_parquet_source(spark, paths.links, "succession links", required=False),
        read_parquet_source(spark, paths.history, "history", required=False),
        pad_ids,
    )
    return dataclasses.replace(registry, paths=paths)


@dataclass(frozen=True)
class RegistryTables:
    """Names of a bucketed copy."""

    prefix: str

    @property
    def establishments(self) -> str:
        return f"{self.prefix}_establishments"

    @property
    def siblings(self) -> str:
        return f"{self.prefix}_siblings"

    @property
    def legal_units(self) -> str:
        return f"{self.prefix}_legal_units"

    @property
    def links(self) -> str:
        return f"{self.prefix}_links"

    @property
    def history(self) -> str:
        return f"{self.prefix}_history"


def save_bucketed(registry: Registry, prefix: str, buckets: int) -> RegistryTables:
    """Write the canonical registry once per publication as tables bucketed on their lookup keys.

    Establishments are kept twice: in full by `siret`, and their few ranking columns by `siren`.
    Joins on these keys then read matching buckets side by side; only the other side is shuffled.
    """
    tables = RegistryTables(prefix)
    ranked = registry.ranking
    plan: Sequence[tuple[DataFrame | None, str, str]] = (
        (registry.establishments, tables.establishments, "siret"),
        (ranked, tables.siblings, "siren"),
        (registry.legal_units, tables.legal_units, "siren"),
        (registry.links, tables.links, PREDECESSOR),
        (registry.history, tables.history, "siret"),
    )
    for df, name, key in plan:
        if df is not None:
            (
                df.repartition(buckets, F.col(key))
                .write.mode("overwrite")
                .bucketBy(buckets, key)
                .sortBy(key)
                .saveAsTable(name)
            )
    return tables


def read_bucketed(spark: SparkSession, tables: RegistryTables) -> Registry:
    """Open a bucketed copy. Its identifiers are canonical, so keys reach the buckets untouched."""

    def optional(name: str) -> DataFrame | None:
        return spark.table(name) if spark.catalog.tableExists(name) else None

    registry = registry_from_frames(
        spark.table(tables.establishments), spark.table(tables.legal_units),
        optional(tables.links), optional(tables.history), pad_ids=False,
    )
    return dataclasses.replace(registry, siblings=spark.table(tables.siblings))


__all__ = [
    "KEY_RANGE",
    "RANKING_FIELDS",
    "Registry",
    "RegistryPaths",
    "RegistryTables",
    "read_bucketed",
    "read_parquet_source",
    "read_registry",
    "registry_from_frames",
    "save_bucketed",
]
