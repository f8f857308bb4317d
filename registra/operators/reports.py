"""Result tables derived from the overview. Each one is a single pass over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from registra.operators import rules
from registra.operators.scoping import MISSING_REASON

LABEL = rules.STATUS_LABELS
NOT_FOUND_REASON = "identifier not found in the registry"
INVALID_REASON = "identifier fails validation"
SIRET_DUPLICATE, SIREN_DUPLICATE = "SIRET duplicate", "SIREN duplicate"
CLOSED_ISSUE, RADIATED_ISSUE = "closed without replacement", "radiated"


def _has(label: str) -> Column:
    return F.col("siret_status") == label


def _closed_with() -> Column:
    return _has(LABEL[rules.CLOSED]) & (F.col("siret_remplacement_recommande") != "")


def _closed_without() -> Column:
    return _has(LABEL[rules.CLOSED]) & (F.col("siret_remplacement_recommande") == "")


def _eligible() -> Column:
    return F.col("siret_format_valide") & ~_has(LABEL[rules.INVALID])


def _list_columns(overview: DataFrame, wanted: list[str]) -> dict[str, str]:
    """Chosen list columns and the names they have in the overview, where a registry column may bear the same name."""
    known = {f.metadata["list_column"]: f.name for f in overview.schema.fields if "list_column" in f.metadata}
    return {c: known[c] for c in wanted if c in known}


def to_close_table(overview: DataFrame) -> DataFrame:
    issue = F.when(_closed_without(), CLOSED_ISSUE).when(_has(LABEL[rules.RADIATED]), RADIATED_ISSUE)
    return overview.select(issue.alias("probleme_siret"), "*").filter(F.col("probleme_siret").isNotNull())


def anomalies_table(
    overview: DataFrame, list_columns: list[str], missing_rows: DataFrame | None = None,
    identifier_column: str | None = None,
) -> DataFrame:
    """Lines that could not be matched, with the reason, the raw identifier and the chosen list columns."""
    reason = F.when(_has(LABEL[rules.NOT_FOUND]), NOT_FOUND_REASON).when(_has(LABEL[rules.INVALID]), INVALID_REASON)
    chosen = _list_columns(overview, list_columns)
    table = overview.select(reason.alias("Motif"), "siret_entree", *[F.col(f"`{n}`") for n in chosen.values()]).filter(F.col("Motif").isNotNull())
    if missing_rows is None:
        return table
    raw = F.col(f"`{identifier_column}`") if identifier_column else F.lit("")
    set_aside = missing_rows.select(
        (F.col("exclusion_reason") if "exclusion_reason" in missing_rows.columns else F.lit(MISSING_REASON)).alias("Motif"),
        F.coalesce(raw.cast("string"), F.lit("")).alias("siret_entree"),
        *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(name) for c, name in chosen.items()],
    )
    return set_aside.unionByName(table)


def duplicates_table(overview: DataFrame, list_columns: list[str]) -> DataFrame:
    """Duplicate lines by SIRET and by SIREN; a line may appear once for each. Sort with `listing_order`."""
    reasons = F.array_compact(
        F.array(
            F.when(F.col("siret_doublon_entree") == "Oui", SIRET_DUPLICATE),
            F.when(F.col("siren_doublon_entree") == "Oui", SIREN_DUPLICATE),
        )
    )
    key = F.col("identifiant_recherche")
    chosen = [F.col(f"`{name}`") for name in _list_columns(overview, list_columns).values()]
    exploded = overview.filter(_eligible()).select("*", F.explode(reasons).alias("Motif"))
    return exploded.select(
        "Motif",
        *chosen,
        "siret_entree",
        "siret_normalise",
        "identifiant_recherche",
        "siren",
        "siret_doublon_entree",
        "siren_doublon_entree",
        F.when((F.col("Motif") == SIREN_DUPLICATE) & (F.length(key) == 14), F.substring(key, 1, 9))
        .when((F.col("Motif") == SIRET_DUPLICATE) & (F.length(key) != 14), F.col("siret_normalise"))
        .otherwise(key)
        .alias("duplicate_key"),
        "row_id",
    )


def listing_order(duplicates: DataFrame) -> DataFrame:
    """SIRET block before SIREN block, then by key and list order: a range-partitioned sort."""
    return duplicates.orderBy(F.col("Motif") == SIREN_DUPLICATE, "duplicate_key", "row_id")


def _count_columns() -> dict[str, Column]:
    source = F.col("analysis_synthese_remplacement")
    closed = _has(LABEL[rules.CLOSED])
    visible = _has(LABEL[rules.ACTIVE]) | _closed_with()
    masked = F.col("analysis_nd_detecte") == "Oui"
    siren_duplicate = _eligible() & (F.col("siren_doublon_entree") == "Oui")
    known_source = source.isin(rules.BY_SUCCESSION, rules.BY_SIBLING, rules.NO_REPLACEMENT)
    conditions = {
        "duplicate_siret": _eligible() & (F.col("siret_doublon_entree") == "Oui"),
        "duplicate_siren": siren_duplicate,
        "not_found": _has(LABEL[rules.NOT_FOUND]),
        "invalid": _has(LABEL[rules.INVALID]),
        "closed": closed,
        "radiated": _has(LABEL[rules.RADIATED]),
        "active": _has(LABEL[rules.ACTIVE]),
        "by_succession": closed & (source == rules.BY_SUCCESSION),
        "by_sibling": closed & (source == rules.BY_SIBLING),
        "other_source": closed & (source != "") & ~known_source,
        "without_replacement": _closed_without(),
        "with_replacement": _closed_with(),
        "other_siren": _closed_with() & (F.col("analysis_alerte_siren_different") == "Oui"),
        "visible": visible,
        "masked": visible & masked,
        "not_masked": visible & ~masked,
    }
    counts = {name: F.count_if(condition) for name, condition in conditions.items()}
    counts["analysed"] = F.count("*")
    counts["distinct_duplicate_siren"] = F.count_distinct(
        F.when(siren_duplicate, F.substring("identifiant_recherche", 1, 9))
    )
    return counts


# (section, indicator, value, total for the share or None, rule). Names are this report's own.
_COMMON_ROWS = (
    ("input", "duplicate SIRET lines", "duplicate_siret", None, "valid SIRET on more than one analysed line"),
    ("input", "duplicate SIREN lines", "duplicate_siren", None, "legal unit on more than one analysed line"),
    ("input", "distinct duplicate SIREN", "distinct_duplicate_siren", None, "legal units behind the lines above"),
    ("identifiers", "missing", "missing_rows", "base_rows", "no digit, or zeros only"),
    ("identifiers", "total", "base_rows", None, ""),
    ("status", "not found", "not_found", "analysed", "valid but absent from the registry"),
    ("status", "invalid", "invalid", "analysed", "fails validation"),
    ("status", "closed", "closed", "analysed", "closed, legal unit still active elsewhere"),
    ("status", "radiated", "radiated", "analysed", "no active establishment left, or state unknown"),
    ("status", "active", "active", "analysed", "active establishment"),
    ("status", "total", "analysed", None, ""),
    ("replacement", "by succession", "by_succession", "closed", "registry succession link"),
    ("replacement", "by active sibling", "by_sibling", "closed", "active establishment of the same legal unit"),
    ("replacement", "other source", "other_source", "closed", "source outside the two rules"),
    ("replacement", "none", "without_replacement", "closed", "nothing to propose"),
    ("replacement", "total", "closed", None, ""),
    ("attention", "replacement on another SIREN", "other_siren", "with_replacement", "check the link before use"),
    ("masked data", "with marker", "masked", "visible", "active, or closed with replacement; a field is withheld"),
    ("masked data", "without marker", "not_masked", "visible", "active, or closed with replacement; none withheld"),
    ("masked data", "total", "visible", None, ""),
)
_COUNTRY_ROWS = (
    ("country", "home", "home_rows", "total_rows", "country column names the home country"),
    ("country", "foreign", "foreign_rows", "total_rows", "another country, before any inclusion"),
    ("country", "unknown", "unknown_country_rows", "total_rows", "country column empty or zero"),
)
_FOREIGN_KEPT_ROW = ("country", "foreign kept", "foreign_kept_rows", None, "foreign lines kept for a valid identifier")
_COUNTRY_TOTAL = ("country", "total", "total_rows", None, "")


def statistics_table(
    overview: DataFrame, scope: DataFrame, by_country: bool = False, foreign_included: bool = False
) -> DataFrame:
    """Indicators with value and share, from one aggregate over the overview.

    `scope` is the single row of `scoping.scope_counts`. A share is empty for totals and "of which" rows
    and 0.0 when its base is empty.
    """
    base = (
        F.col("home_rows") + F.col("unknown_country_rows") + F.col("foreign_kept_rows")
        if by_country
        else F.col("analysed") + F.col("missing_rows")
    )
    rows = list(_COUNTRY_ROWS if by_country else ())
    if by_country and foreign_included:
        rows.append(_FOREIGN_KEPT_ROW)
    if by_country:
        rows.append(_COUNTRY_TOTAL)
    else:
        rows.append(("input", "lines in the list", "base_rows", "base_rows", "all lines, missing identifiers included"))
    rows.append(("input", "analysed lines", "analysed", "base_rows", "lines with an identifier"))
    rows.extend(_COMMON_ROWS)

    counted = overview.agg(*[column.alias(name) for name, column in _count_columns().items()])
    # Two single rows become one by adding up their columns; a join would have no key.
    counted = counted.unionByName(scope, allowMissingColumns=True)
    counted = counted.agg(*[F.sum(c).alias(c) for c in counted.columns]).withColumn("base_rows", base)
    entries = []
    for position, (section, indicator, value, total, rule) in enumerate(rows, start=1):
        if total is None:
            share = F.lit(None).cast("double")
        else:
            share = F.when(F.col(total) > 0, F.col(value) / F.col(total)).otherwise(0.0)
        entries.append(
            F.struct(
                F.lit(position).alias("position"),
                F.lit(section).alias("section"),
                F.lit(indicator).alias("indicateur"),
                F.col(value).alias("valeur"),
                share.alias("part_du_total"),
                F.lit(rule).alias("regle_metier"),
            )
        )
    return counted.select(F.inline(F.array(*entries)))
