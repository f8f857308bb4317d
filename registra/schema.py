"""Canonical registry schema and tolerant column-name resolution."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Published column names of the national registry files.
ESTABLISHMENT_FIELDS = (
    "siret",
    "siren",
    "nic",
    "etatAdministratifEtablissement",
    "dateCreationEtablissement",
    "dateDebut",
    "dateFin",
    "activitePrincipaleEtablissement",
    "nomenclatureActivitePrincipaleEtablissement",
    "enseigne1Etablissement",
    "denominationUsuelleEtablissement",
    "complementAdresseEtablissement",
    "numeroVoieEtablissement",
    "indiceRepetitionEtablissement",
    "typeVoieEtablissement",
    "libelleVoieEtablissement",
    "codePostalEtablissement",
    "libelleCommuneEtablissement",
    "libelleCommuneEtrangerEtablissement",
    "distributionSpecialeEtablissement",
    "codeCommuneEtablissement",
    "codeCedexEtablissement",
    "libelleCedexEtablissement",
    "paysEtrangerEtablissement",
)
HEAD_OFFICE_FLAG = "etablissementSiege"
LEGAL_UNIT_FIELDS = (
    "siren",
    "etatAdministratifUniteLegale",
    "statutDiffusionUniteLegale",
    "categorieJuridiqueUniteLegale",
    "activitePrincipaleUniteLegale",
    "nomenclatureActivitePrincipaleUniteLegale",
    "denominationUniteLegale",
    "denominationUsuelle1UniteLegale",
    "denominationUsuelle2UniteLegale",
    "denominationUsuelle3UniteLegale",
    "sigleUniteLegale",
    "nomUniteLegale",
    "nomUsageUniteLegale",
    "prenom1UniteLegale",
    "prenom2UniteLegale",
    "prenom3UniteLegale",
)
HISTORY_FIELDS = (
    "siret",
    "siren",
    "nic",
    "dateDebut",
    "dateFin",
    "etatAdministratifEtablissement",
    "complementAdresseEtablissement",
    "numeroVoieEtablissement",
    "indiceRepetitionEtablissement",
    "typeVoieEtablissement",
    "libelleVoieEtablissement",
    "codePostalEtablissement",
    "libelleCommuneEtablissement",
)
PREDECESSOR = "siretEtablissementPredecesseur"
SUCCESSOR = "siretEtablissementSuccesseur"
LINK_FIELDS = (PREDECESSOR, SUCCESSOR, "dateLienSuccession", "transfereSiege", "continuiteEconomique")
ADDRESS_FIELDS = (
    "complementAdresseEtablissement",
    "numeroVoieEtablissement",
    "indiceRepetitionEtablissement",
    "typeVoieEtablissement",
    "libelleVoieEtablissement",
    "distributionSpecialeEtablissement",
    "codePostalEtablissement",
    "libelleCommuneEtablissement",
    "libelleCedexEtablissement",
    "libelleCommuneEtrangerEtablissement",
    "paysEtrangerEtablissement",
)
ID_WIDTHS = {"siret": 14, "siren": 9, "nic": 5, PREDECESSOR: 14, SUCCESSOR: 14}

# Other published names that feed a canonical column, tried after the canonical name.
OTHER_NAMES = {
    "activitePrincipaleEtablissement": ("activitePrincipaleNAF25Etablissement",),
    "activitePrincipaleUniteLegale": ("activitePrincipaleNAF25UniteLegale",),
    PREDECESSOR: ("siretPredecesseur",),
    SUCCESSOR: ("siretSuccesseur",),
}
# Names of the two activity classifications.
CLASSIFICATION_2008 = "NAF rév. 2 (2008)"
CLASSIFICATION_2025 = "NAF 2025"


@dataclass(frozen=True)
class TableSpec:
    name: str
    fields: tuple[str, ...]
    required: tuple[str, ...] = ()
    any_of: tuple[str, ...] = ()


# `any_of`: at least one of these must be present for the optional table to be usable.
ESTABLISHMENTS = TableSpec("establishments", ESTABLISHMENT_FIELDS + (HEAD_OFFICE_FLAG,), ("siret", "siren"))
LEGAL_UNITS = TableSpec("legal_units", LEGAL_UNIT_FIELDS, ("siren",))
LINKS = TableSpec("links", LINK_FIELDS, any_of=(PREDECESSOR, SUCCESSOR))
HISTORY = TableSpec("history", HISTORY_FIELDS, any_of=("siret", "siren"))


@dataclass(frozen=True)
class Resolution:
    """Which stored column feeds which canonical column of one table."""

    table: TableSpec
    available: tuple[str, ...]
    columns: Mapping[str, str] = field(default_factory=dict)

    @property
    def missing(self) -> list[str]:
        return [name for name in self.table.fields if name not in self.columns]

    @property
    def activity_classification(self) -> str | None:
        """Vintage of the activity code in use, None when the table publishes none."""
        for canonical in OTHER_NAMES.keys() & set(self.table.fields):
            if not canonical.startswith("activite"):
                continue
            source = self.columns.get(canonical)
            if source is None:
                return None
            return CLASSIFICATION_2008 if name_token(source) == name_token(canonical) else CLASSIFICATION_2025
        return None


def name_token(name: str) -> str:
    """Comparison form of a column name: case, separators and underscores do not count."""
    return re.sub(r"[^a-z0-9]", "", name.lower())


def resolve(available: Iterable[str], table: TableSpec) -> Resolution:
    available = tuple(available)
    stored = {name_token(name): name for name in available}
    columns = {}
    for canonical in table.fields:
        accepted = (canonical, *OTHER_NAMES.get(canonical, ()))
        source = next((stored[name_token(n)] for n in accepted if name_token(n) in stored), None)
        if source is not None:
            columns[canonical] = source
    absent = [name for name in table.required if name not in columns]
    if absent:
        raise ValueError(
            f"{table.name}: required column(s) {', '.join(absent)} not found; "
            f"the table has {', '.join(available[:20])}"
        )
    return Resolution(table, available, columns)


def padded_id(value: Column, width: int) -> Column:
    """Digits of an identifier, zero-padded on the left when short, kept whole when long."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    return (
        F.when(value.rlike(f"^[0-9]{{{width}}}$"), value)  # nearly every row ends here
        .when(F.length(digits) == 0, F.lit(None))
        .when(F.length(digits) < width, F.lpad(digits, width, "0"))
        .otherwise(digits)
    )


def canonical(df: DataFrame, resolution: Resolution, pad_ids: bool = True) -> DataFrame:
    """Project a stored table onto its canonical columns, all text; absent columns become null.

    `pad_ids=False` keeps string identifiers untouched, so that key filters still reach the Parquet
    scan and a bucketed copy still joins without a shuffle. Use it on a copy that is canonical already.
    """
    types = dict(df.dtypes)
    selected = []
    for name in resolution.table.fields:
        source = resolution.columns.get(name)
        if source is None:
            selected.append(F.lit(None).cast("string").alias(name))
            continue
        value = F.col(f"`{source}`")
        if types[source] != "string":
            value = value.cast("string")
        if name in ID_WIDTHS and pad_ids:
            value = padded_id(value, ID_WIDTHS[name])
        selected.append(value.alias(name))
    return df.select(*selected)


SCHEMA_REPORT = T.StructType(
    [
        T.StructField("table_name", T.StringType(), False),
        T.StructField("field", T.StringType(), False),
        T.StructField("source_column", T.StringType()),
        T.StructField("activity_classification", T.StringType()),
    ]
)


def schema_report(spark: SparkSession, resolutions: Iterable[Resolution]) -> DataFrame:
    """One row per canonical column: where it comes from, null when the table lacks it."""
    rows = [
        (
            r.table.name,
            name,
            r.columns.get(name),
            r.activity_classification if name.startswith("activitePrincipale") else None,
        )
        for r in resolutions
        for name in r.table.fields
    ]
    return spark.createDataFrame(rows, SCHEMA_REPORT)


def filled_counts(df: DataFrame, resolution: Resolution) -> DataFrame:
    """Schema report of one table with the number of rows that carry a value, in one scan."""
    names = resolution.table.fields
    counted = df.agg(*[F.count(F.col(n)).alias(n) for n in names])
    entries = [
        F.struct(
            F.lit(resolution.table.name).alias("table_name"),
            F.lit(n).alias("field"),
            F.lit(resolution.columns.get(n)).cast("string").alias("source_column"),
            F.col(n).alias("filled_rows"),
        )
        for n in names
    ]
    return counted.select(F.inline(F.array(*entries)))
