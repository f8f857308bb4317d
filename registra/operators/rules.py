"""Status, replacement and clean-up rules as column expressions.

Each function reads the named columns of the decision frame and returns one column. They hold no state
and cause no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from registra.operators.establishments import ACTIVE_FALLBACK, HEAD_OFFICE, STATE, state_code

INVALID = "INVALID_SIRET_FORMAT"
NOT_FOUND = "NOT_FOUND_IN_SIRENE"
ACTIVE = "ACTIVE"
CLOSED = "CLOSED"
RADIATED = "RADIATED"
UNKNOWN_STATE = "FOUND_UNKNOWN_STATUS"

# Short labels of the result tables.
STATUS_LABELS = {
    ACTIVE: "Actif",
    CLOSED: "Fermé",
    RADIATED: "Radiée",
    UNKNOWN_STATE: "Radiée",
    INVALID: "Invalide",
    NOT_FOUND: "Non trouvé",
}
ACTION_LABELS = {
    INVALID: "Invalide",
    NOT_FOUND: "Non trouvé",
    ACTIVE: "Conserver",
    RADIATED: "Radiée",
    UNKNOWN_STATE: "A analyser",
}
REPLACE, CLOSE = "Remplacer", "A clôturer"
PRIORITY_LABELS = {"HIGH": "Haute", "MEDIUM": "Moyenne", "LOW": "Basse"}
BY_SUCCESSION, BY_SIBLING, NO_REPLACEMENT = "Succession", "Autre SIRET même SIREN", "Aucun"
OWN_DATA = "INPUT_SIRET_DATA"
REPLACEMENT_DATA = "REPLACEMENT_SIRET_DATA"
REPLACEMENT_NOT_LOADED = "NO_DATA_REPLACEMENT_NOT_LOADED"
CLOSED_NO_DATA = "NO_DATA_CLOSED_NO_REPLACEMENT"


def labelled(value: Column, labels: dict[str, str], otherwise: str | None = None) -> Column:
    chain = F.when(F.lit(False), F.lit(None).cast("string"))
    for code, label in labels.items():
        chain = chain.when(value == code, label)
    return chain.otherwise(F.lit(otherwise))


def status_label(status: Column) -> Column:
    return labelled(status, STATUS_LABELS, STATUS_LABELS[RADIATED])


def priority_label(priority: Column) -> Column:
    return labelled(priority, PRIORITY_LABELS, PRIORITY_LABELS["LOW"])


def establishment_status(state: Column) -> Column:
    code = state_code(state)
    return F.when(code == "A", ACTIVE).when(code == "F", CLOSED).otherwise(UNKNOWN_STATE)


def status(format_ok: Column) -> Column:
    """Needs `siret` (matched, else null), the state and the active sibling count."""
    found = establishment_status(F.col(STATE))
    no_active = F.coalesce("total_etablissements_actifs", F.lit(0)) <= 0
    return (
        F.when(~format_ok, INVALID)
        .when(F.col("siret").isNull(), NOT_FOUND)
        .when((found == CLOSED) & no_active, RADIATED)
        .otherwise(found)
    )


def is_closed() -> Column:
    return F.col("siret_status") == CLOSED


def replacement() -> Column:
    """Closed rows only: the succession chain first, else an active sibling."""
    return F.when(is_closed(), F.coalesce("successor_siret", "sibling_siret"))


def has_replacement() -> Column:
    return F.col("siret_remplacement_recommande").isNotNull()


def cleaning_action() -> Column:
    return F.when(is_closed(), F.when(has_replacement(), REPLACE).otherwise(CLOSE)).otherwise(
        labelled(F.col("siret_status"), ACTION_LABELS, ACTION_LABELS[UNKNOWN_STATE])
    )


def replacement_source() -> Column:
    return F.when(
        is_closed(),
        F.when(F.col("successor_siret").isNotNull(), BY_SUCCESSION)
        .when(F.col("sibling_siret").isNotNull(), BY_SIBLING)
        .otherwise(NO_REPLACEMENT),
    )


def succession_available() -> Column:
    return F.when(is_closed(), F.when(F.col("successor_siret").isNotNull(), "Oui").otherwise("Non"))


def candidate_count() -> Column:
    source = F.col("analysis_synthese_remplacement")
    return F.when(source == BY_SIBLING, F.col("sibling_candidates")).when(
        source == NO_REPLACEMENT, F.lit(0).cast("bigint")
    )


def choice_reason() -> Column:
    several = F.col("sibling_candidates") > 1
    return F.when((F.col("analysis_synthese_remplacement") == BY_SIBLING) & several, F.col("sibling_reason"))


def other_siren_alert() -> Column:
    """On the first nine digits, so it also holds when the replacement's data is not loaded."""
    other = F.substring("siret_remplacement_recommande", 1, 9) != F.substring("siret_normalized", 1, 9)
    return F.when(is_closed() & has_replacement(), F.when(other, "Oui").otherwise("Non"))


def priority() -> Column:
    status_code = F.col("siret_status")
    return (
        F.when(status_code.isin(INVALID, NOT_FOUND), "HIGH")
        .when(is_closed(), F.when(has_replacement(), "HIGH").otherwise("MEDIUM"))
        .otherwise("LOW")
    )


def retained_siret() -> Column:
    return F.when(F.col("siret_status") == ACTIVE, F.col("siret")).when(
        is_closed(), F.col("siret_remplacement_recommande")
    )


def lookup_mode() -> Column:
    """How a SIREN was answered; null for SIRET rows."""
    return F.when(
        F.col("siret_input_type") == "SIREN", F.coalesce("matched_mode", F.lit("SIREN_NOT_FOUND"))
    )


def status_note() -> Column:
    """One sentence per fact: route, how a SIREN was answered, status, replacement and its caveats."""
    code, source = F.col("siret_status"), F.col("analysis_synthese_remplacement")
    target, count = F.col("siret_remplacement_recommande"), F.col("analysis_nb_candidats_remplacement")
    route = F.when(
        F.col("siret_validation_route") == "SIREN_FALLBACK_FROM_SIRET",
        "The 14-digit key fails; searched by the first 9 digits.",
    )
    answered = F.when(
        F.col("matched_mode") == HEAD_OFFICE,
        F.concat(F.lit("SIREN given, head office used: "), F.col("siret"), F.lit(".")),
    ).when(
        F.col("matched_mode") == ACTIVE_FALLBACK,
        F.concat(F.lit("SIREN given, no head office, active establishment used: "), F.col("siret"), F.lit(".")),
    )
    fact = (
        F.when(code == INVALID, "Identifier fails validation.")
        .when((code == NOT_FOUND) & (F.col("siret_input_type") == "SIREN"),
              "Valid SIREN without a usable establishment.")
        .when(code == NOT_FOUND, "Valid identifier absent from the registry.")
        .when(code == ACTIVE, "Establishment is active.")
        .when(source == BY_SUCCESSION,
              F.concat(F.lit("Establishment is closed; successor "), target, F.lit(".")))
        .when(source == BY_SIBLING,
              F.concat(F.lit("Establishment is closed; sibling "), target,
                       F.lit(" out of "), count.cast("string"), F.lit(" active.")))
        .when(code == CLOSED, "Establishment is closed; no replacement.")
        .otherwise("Legal unit has no active establishment, or the state is unusual.")
    )
    reason = F.concat(F.lit("Reason: "), F.col("analysis_raison_choix_remplacement"), F.lit("."))
    alert = F.when(
        F.col("analysis_alerte_siren_different") == "Oui",
        "The replacement belongs to another legal unit; check before use.",
    )
    return F.concat_ws(" ", route, answered, fact, reason, alert)


def metric_columns() -> list[Column]:
    code = F.col("siret_status")
    return [
        F.count("*").alias("total_input_siret"),
        F.count_if(F.col("siret_format_ok")).alias("valid_siret_format"),
        F.count_if(~code.isin(INVALID, NOT_FOUND)).alias("found_in_sirene"),
        F.count_if(code == ACTIVE).alias("active"),
        F.count_if(code == CLOSED).alias("closed"),
        F.count_if(code == RADIATED).alias("radiated"),
        F.count_if(code == NOT_FOUND).alias("not_found"),
        F.count_if(code == INVALID).alias("invalid_format"),
        F.count_if((code == CLOSED) & (F.col("total_etablissements_actifs") > 0)).alias("move_candidates"),
        F.count_distinct(F.when(F.col("siren_duplicate"), F.substring("siret_lookup_key", 1, 9))).alias(
            "duplicate_siren"
        ),
        F.count_if(code == UNKNOWN_STATE).alias("unknown_state"),
    ]

