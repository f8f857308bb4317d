"""One entry per operator: the Spark job, and the SQL it is checked against."""

from __future__ import annotations

import dataclasses
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from registra.functions import identifiers as ids
from registra.functions import naming, similarity, text
from registra.operators import establishments as est
from registra.operators import history as hist
from registra.operators import link_state, names, profile, reports, rules, scoping, succession
from registra.operators.diff import run_diff
from registra.operators.held import held, run_folder
from registra.plans.control import ControlOptions, ControlResult, identifier_keys, keys_of_type, run_control
from registra.schema import PREDECESSOR, SUCCESSOR, filled_counts, padded_id
from registra.sources.pruned import read_pruned, save_pruned
from registra.sources.sinks import write_results
from registra.sources.user_list import drop_blank_rows, read_user_list
from workload.derive import list_csv, registry, stage
from workload.oracle import STATUS_LABEL, key_valid, luhn, sql, without_form

Job = Callable[[SparkSession, str], DataFrame]
JOBS: dict[str, Job] = {}
CHECKS: dict[str, str] = {}

LIST_COLUMNS = ["ref", "pays", "siren"]


def query(name: str, check: str | None = None) -> Callable[[Job], Job]:
    def register(job: Job) -> Job:
        JOBS[name] = job
        if check is not None:
            CHECKS[name] = check if check.startswith("WITH ") else sql(check)
        return job

    return register


def bit(flag: Column) -> Column:
    return flag.cast("int")


def blanked(df: DataFrame) -> DataFrame:
    return df.select(
        *[F.coalesce(F.col(c), F.lit("")).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes]
    )


def texted(df: DataFrame, *counts: str) -> DataFrame:
    """Show counts that may be absent as text, like the other absent cells."""
    return df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in counts})


def user_lines(spark: SparkSession, sf: str) -> DataFrame:
    return read_user_list(spark, stage(spark, sf).list_parquet, ignore_blank_rows=False, require_rows=False)


def checked_lines(spark: SparkSession, sf: str) -> DataFrame:
    return ids.check_identifiers(user_lines(spark, sf), "identifiant").withColumn("row_id", F.col("ref").cast("bigint"))


def control(spark: SparkSession, sf: str, **options) -> ControlResult:
    lines, _ = scoping.split_missing(user_lines(spark, sf), "identifiant")
    return run_control(lines, "identifiant", registry(spark, sf), ControlOptions(row_id="ref", **options))


def list_keys(spark: SparkSession, sf: str, kind: str, name: str) -> DataFrame:
    return keys_of_type(identifier_keys(checked_lines(spark, sf)), kind, name)


# ---- sources, projections -------------------------------------------------------------------------


@query(
    "scan_registry",
    """SELECT siret, siren, nic, coalesce(etat, '') AS etat, creation AS date_creation, coalesce(debut, '') AS date_debut, cp AS code_postal
       FROM etab""",
)
def scan_registry(spark, sf):
    e = registry(spark, sf).establishments
    return blanked(
        e.select(
            "siret", "siren", "nic", F.col(est.STATE).alias("etat"),
            F.col("dateCreationEtablissement").alias("date_creation"), F.col("dateDebut").alias("date_debut"),
            F.col("codePostalEtablissement").alias("code_postal"),
        )
    )


@query("read_list", "SELECT ref, identifiant, pays, list_siren AS siren FROM inp")
def read_list(spark, sf):
    return blanked(read_user_list(spark, list_csv(spark, sf)))


@query("header_policy", "SELECT ref AS column_1, identifiant AS column_2, pays AS column_3, list_siren AS column_4 FROM inp")
def header_policy(spark, sf):
    path = f"{run_folder(spark)}/headerless-{uuid.uuid4().hex}"
    user_lines(spark, sf).write.csv(path, header=False)
    return blanked(read_user_list(spark, path, has_header=False))


@query(
    "lenient_date",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 1 THEN '' ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS day FROM orders""",
)
def lenient_date(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    day = F.col("o_orderdate").cast("date").cast("string")
    kind = F.col("o_orderkey") % 3
    given = F.when(kind == 1, F.concat(F.lit("about "), day)).when(kind == 2, F.concat(day, F.lit(" "))).otherwise(day)
    return orders.select("o_orderkey", F.coalesce(text.date_or_null(given).cast("date").cast("string"), F.lit("")).alias("day"))


@query("drop_blank_rows", "SELECT identifiant, pays FROM inp WHERE trim(identifiant) <> '' OR trim(pays) <> ''")
def drop_blank(spark, sf):
    return blanked(drop_blank_rows(user_lines(spark, sf).select("identifiant", "pays")))


_FILLED = {
    "establishments": (
        "etab",
        {
            "siret": ("siret", "siret"), "siren": ("siren", "siren"), "nic": ("nic", "nic"),
            "etatAdministratifEtablissement": ("etatAdministratifEtablissement", "etat"),
            "dateCreationEtablissement": ("date_creation_etablissement", "creation"),
            "dateDebut": ("dateDebut", "debut"),
            "activitePrincipaleEtablissement": ("activitePrincipaleNAF25Etablissement", "cp"),
            "enseigne1Etablissement": ("enseigne1Etablissement", "enseigne"),
            "numeroVoieEtablissement": ("numeroVoieEtablissement", "numero"),
            "typeVoieEtablissement": ("typeVoieEtablissement", "type_voie"),
            "libelleVoieEtablissement": ("libelleVoieEtablissement", "voie"),
            "codePostalEtablissement": ("codePostalEtablissement", "cp"),
            "libelleCommuneEtablissement": ("libelleCommuneEtablissement", "n_name"),
            "etablissementSiege": ("etablissementSiege", "siege"),
        },
    ),
    "legal_units": (
        "ul",
        {
            "siren": ("siren", "siren"),
            "etatAdministratifUniteLegale": ("etat_administratif_unite_legale", "etat_ul"),
            "activitePrincipaleUniteLegale": ("activitePrincipaleUniteLegale", "ape"),
            "denominationUniteLegale": ("denominationUniteLegale", "denom"),
            "denominationUsuelle1UniteLegale": ("denominationUsuelle1UniteLegale", "usuelle1"),
            "sigleUniteLegale": ("sigleUniteLegale", "sigle"),
            "nomUniteLegale": ("nomUniteLegale", "nom"),
            "prenom1UniteLegale": ("prenom1UniteLegale", "prenom1"),
            "prenom2UniteLegale": ("prenom2UniteLegale", "prenom2"),
        },
    ),
    "links": (
        "lnk",
        {
            PREDECESSOR: ("siretPredecesseur", "pred"), SUCCESSOR: ("siretSuccesseur", "succ"),
            "dateLienSuccession": ("dateLienSuccession", "d"), "transfereSiege": ("transfereSiege", "head"),
            "continuiteEconomique": ("continuiteEconomique", "cont"),
        },
    ),
    "history": (
        "hist",
        {
            "siret": ("siret", "siret"), "siren": ("siren", "siren"),
            "dateDebut": ("dateDebut", "debut"), "dateFin": ("dateFin", "fin"),
        },
    ),
}


def _filled_check() -> str:
    from registra import schema

    tables = {t.name: t for t in (schema.ESTABLISHMENTS, schema.LEGAL_UNITS, schema.LINKS, schema.HISTORY)}
    parts = []
    for table, (source, known) in _FILLED.items():
        for name in tables[table].fields:
            stored, column = known.get(name, ("", "NULL"))
            parts.append(
                f"SELECT '{table}' AS table_name, '{name}' AS field, '{stored}' AS source_column, "
                f"count({column}) AS filled_rows FROM {source}"
            )
    return " UNION ALL ".join(parts)


@query("schema_report", _filled_check())
def schema_report(spark, sf):
    r = registry(spark, sf)
    frames = [r.establishments, r.legal_units, r.links, r.history]
    tables = [filled_counts(df, resolution) for df, resolution in zip(frames, r.resolutions)]
    return blanked(tables[0].unionByName(tables[1]).unionByName(tables[2]).unionByName(tables[3]))


@query(
    "canonical_projection",
    f"""SELECT siren, etat_ul AS "etatAdministratifUniteLegale", '' AS "statutDiffusionUniteLegale", ape AS "activitePrincipaleUniteLegale",
        coalesce(denom, '') AS "denominationUniteLegale", coalesce(nom, '') AS "nomUniteLegale" FROM ul""",
)
def canonical_projection(spark, sf):
    return blanked(
        registry(spark, sf).legal_units.select(
            "siren", "etatAdministratifUniteLegale", "statutDiffusionUniteLegale", "activitePrincipaleUniteLegale",
            "denominationUniteLegale", "nomUniteLegale",
        )
    )


@query(
    "pad_ids",
    """SELECT o_orderkey, CASE WHEN length(k) < 14 THEN lpad(k, 14, '0') ELSE k END AS as_siret,
         CASE WHEN length(c) < 9 THEN lpad(c, 9, '0') ELSE c END AS as_siren,
         CASE WHEN length(d) < 5 THEN lpad(d, 5, '0') ELSE d END AS as_nic
       FROM (SELECT o_orderkey, CAST(o_orderkey * 1000003 AS VARCHAR) AS k, CAST(o_custkey AS VARCHAR) AS c,
               strftime(o_orderdate, '%Y%m%d') AS d FROM orders)""",
)
def pad_ids(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    return orders.select(
        "o_orderkey",
        padded_id((F.col("o_orderkey") * 1000003).cast("string"), 14).alias("as_siret"),
        padded_id(F.col("o_custkey").cast("string"), 9).alias("as_siren"),
        padded_id(F.date_format("o_orderdate", "yyyy-MM-dd"), 5).alias("as_nic"),
    )


@query("address_line", "SELECT siret, concat_ws(' ', numero, type_voie, voie, cp, n_name) AS adresse FROM etab")
def address_line(spark, sf):
    return registry(spark, sf).establishments.select("siret", naming.address_line().alias("adresse"))


@query("denomination", "SELECT siren, nom_entreprise AS denomination_entreprise FROM company")
def denomination(spark, sf):
    return registry(spark, sf).legal_units.select("siren", naming.company_name().alias("denomination_entreprise"))


@query(
    "vat_number",
    """SELECT siren, concat('FR', lpad(CAST((12 + 3 * (CAST(siren AS BIGINT) % 97)) % 97 AS VARCHAR), 2, '0'), siren) AS tva FROM unit""",
)
def vat_number(spark, sf):
    return registry(spark, sf).legal_units.select("siren", ids.vat_number(F.col("siren")).alias("tva"))


@query(
    "status_labels",
    f"""SELECT row_id, {STATUS_LABEL.format('status')} AS label, prio AS priority,
        CASE WHEN siret IN (SELECT siret FROM hist) THEN 'Oui' ELSE 'Non' END AS has_history FROM dec""",
)
def status_labels(spark, sf):
    o = control(spark, sf).overview
    return o.select(
        "row_id", F.col("siret_status").alias("label"), F.col("analysis_priority").alias("priority"),
        F.col("analysis_historique_disponible").alias("has_history"),
    )


@query("result_sink", f"SELECT {STATUS_LABEL.format('status')} AS label, count(*) AS lines FROM dec GROUP BY 1")
def result_sink(spark, sf):
    scope = scoping.scope_counts(user_lines(spark, sf), None, "identifiant")
    paths = write_results(control(spark, sf), f"{run_folder(spark)}/results-{uuid.uuid4().hex}", ["ref"], scope)
    written = spark.read.parquet(paths["siret_overview"])
    return written.groupBy(F.col("siret_status").alias("label")).agg(F.count("*").alias("lines"))


@query(
    "run_log",
    """SELECT 'input_siret_column' AS parameter, 'identifiant' AS value
       UNION ALL SELECT 'input_row_count', CAST(count(*) AS VARCHAR) FROM dec""",
)
def run_log(spark, sf):
    return control(spark, sf).run_log.filter(F.col("parameter").startswith("input_"))


@query(
    "history_of_list",
    """SELECT siret, debut, coalesce(fin, '') AS fin FROM hist
       WHERE siret IN (SELECT coalesce(siret, CASE WHEN type = 'SIRET' THEN key END) FROM dec)""",
)
def history_of_list(spark, sf):
    return blanked(control(spark, sf).history.select("siret", F.col("dateDebut").alias("debut"), F.col("dateFin").alias("fin")))


@query(
    "search_link",
    """SELECT siren, concat('https://registry.example/search?q=', url_encode(nom_entreprise)) AS link FROM company""",
)
def search_link(spark, sf):
    units = registry(spark, sf).legal_units
    return units.select("siren", names.candidate_link(naming.company_name(), "https://registry.example/search?q=").alias("link"))


# ---- scoping ----------------------------------------------------------------------------------------


@query("country_split", "SELECT row_id, scope, CAST(scope = 'foreign' AND type <> '' AS INTEGER) AS foreign_valid FROM scoped")
def country_split(spark, sf):
    scoped = scoping.with_country_scope(user_lines(spark, sf), "pays", "identifiant")
    return scoped.select(
        F.col("ref").cast("bigint").alias("row_id"), F.col("country_scope").alias("scope"),
        bit(F.col("foreign_valid")).alias("foreign_valid"),
    )


@query("country_filter", "SELECT row_id, pays, identifiant FROM scoped WHERE scope <> 'foreign' OR type <> ''")
def country_filter(spark, sf):
    scoped = scoping.with_country_scope(user_lines(spark, sf), "pays", "identifiant")
    kept = scoping.keep_country(scoped, include_foreign_valid=True)
    return kept.select(F.col("ref").cast("bigint").alias("row_id"), "pays", "identifiant")


@query(
    "missing_ids",
    "SELECT row_id, identifiant, 'identifier empty or zero' AS reason FROM val WHERE regexp_full_match(digits, '0*')",
)
def missing_ids(spark, sf):
    _, missing = scoping.split_missing(user_lines(spark, sf), "identifiant")
    return missing.select(F.col("ref").cast("bigint").alias("row_id"), "identifiant", F.col("exclusion_reason").alias("reason"))


@query("masked_flag", "SELECT row_id, CASE WHEN nd THEN 'Oui' ELSE 'Non' END AS masked FROM shown")
def masked_flag(spark, sf):
    return control(spark, sf).overview.select("row_id", F.col("analysis_nd_detecte").alias("masked"))


# ---- identifiers and text -----------------------------------------------------------------------


@query("normalize_ids", "SELECT row_id, digits, substr(digits, 1, 14) AS lookup_digits FROM val")
def normalize_ids(spark, sf):
    number = text.digits(F.col("identifiant"))
    return user_lines(spark, sf).select(
        F.col("ref").cast("bigint").alias("row_id"), number.alias("digits"),
        F.substring(number, 1, 14).alias("lookup_digits"),
    )


_ALTERED = """SELECT siret, CAST({0} AS INTEGER) AS own, CAST({1} AS INTEGER) AS siren_ok, CAST({2} AS INTEGER) AS altered
    FROM (SELECT *, concat(left(siret, 13), CAST((CAST(right(siret, 1) AS INTEGER) + 1) % 10 AS VARCHAR)) AS wrong FROM etab)"""


@query("luhn_valid", _ALTERED.format(luhn("siret"), luhn("siren"), luhn("wrong")))
def luhn_valid(spark, sf):
    e = registry(spark, sf).establishments
    wrong = F.concat(F.substring("siret", 1, 13), ((F.substring("siret", 14, 1).cast("int") + 1) % 10).cast("string"))
    return e.select(
        "siret", bit(ids.luhn_valid(F.col("siret"))).alias("own"), bit(ids.luhn_valid(F.col("siren"))).alias("siren_ok"),
        bit(ids.luhn_valid(wrong)).alias("altered"),
    )


@query(
    "key_valid",
    f"""SELECT o_orderkey, CAST({key_valid('postal')} AS INTEGER) AS postal_ok, CAST({key_valid('other')} AS INTEGER) AS other_ok
        FROM (SELECT o_orderkey, concat('356000000', lpad(CAST(o_orderkey % 100000 AS VARCHAR), 5, '0')) AS postal,
          concat('804172633', lpad(CAST(o_orderkey % 100000 AS VARCHAR), 5, '0')) AS other FROM orders)""",
)
def key_valid_job(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    nic = F.lpad((F.col("o_orderkey") % 100000).cast("string"), 5, "0")
    return orders.select(
        "o_orderkey",
        bit(ids.key_valid(F.concat(F.lit("356000000"), nic))).alias("postal_ok"),
        bit(ids.key_valid(F.concat(F.lit("804172633"), nic))).alias("other_ok"),
    )


@query("route_ids", "SELECT row_id, type, route FROM val")
def route_ids(spark, sf):
    return checked_lines(spark, sf).select(
        "row_id", F.col("siret_input_type").alias("type"), F.col("siret_validation_route").alias("route")
    )


@query(
    "validate_ids",
    """SELECT row_id, identifiant AS siret_input, norm AS siret_normalized, key AS siret_lookup_key, type AS siret_input_type,
         route AS siret_validation_route, CAST(type <> '' AS INTEGER) AS siret_len_ok, CAST(type <> '' AS INTEGER) AS siret_luhn_ok,
         CAST(type <> '' AS INTEGER) AS siret_format_ok FROM val""",
)
def validate_ids(spark, sf):
    flags = ("siret_len_ok", "siret_luhn_ok", "siret_format_ok")
    return checked_lines(spark, sf).select(
        "row_id",
        *[bit(F.col(c)).alias(c) if c in flags else F.col(c) for c in ids.VALIDATION_COLUMNS],
    )


@query("fold_text", "SELECT doc_id, md5(strip_accents(lower(trim(text)))) AS folded_md5 FROM documents")
def fold_text(spark, sf):
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    return documents.select("doc_id", F.md5(text.fold(F.col("text"))).alias("folded_md5"))


@query("strip_legal_form", f"SELECT siren, {without_form('denom')} AS clean FROM ul WHERE denom IS NOT NULL")
def strip_legal_form(spark, sf):
    units = registry(spark, sf).legal_units.filter("denominationUniteLegale is not null")
    return units.select("siren", naming.without_legal_form(F.col("denominationUniteLegale")).alias("clean"))


@query(
    "name_similarity",
    """SELECT row_id, round(jaro_winkler_similarity(n.nom, nom_entreprise), 8) AS score,
         round(least(1.0, jaro_winkler_similarity(n.nom, nom_entreprise) + CASE WHEN zip <> '' THEN 0.05 ELSE 0 END), 8) AS with_bonus
       FROM namelist n JOIN ul ON c_custkey = row_id JOIN company USING (siren)""",
)
def name_similarity(spark, sf):
    lines = spark.read.parquet(stage(spark, sf).names_parquet)
    units = registry(spark, sf).legal_units.select("siren", naming.company_name().alias("name"))
    keyed = units.withColumn("row_id", F.substring("siren", 1, 8).cast("bigint") - 30000000)
    score = similarity.name_similarity(F.col("nom"), F.col("name"))
    scored = lines.join(keyed, "row_id").withColumn("raw", score)
    return scored.select(
        "row_id", F.round("raw", 8).alias("score"),
        F.round(similarity.with_postcode_bonus(F.col("raw"), F.col("code_postal") != ""), 8).alias("with_bonus"),
    )


# ---- lookups ----------------------------------------------------------------------------------------


@query("lookup_siret", "SELECT siret, siren, coalesce(etat, '') AS etat, n_name AS commune FROM etab WHERE siret IN (SELECT key FROM val WHERE type = 'SIRET')")
def lookup_siret(spark, sf):
    found = est.by_siret(registry(spark, sf).establishments, list_keys(spark, sf, "SIRET", "siret"))
    return blanked(found.select("siret", "siren", F.col(est.STATE).alias("etat"), F.col("libelleCommuneEtablissement").alias("commune")))


@query("pruned_lookup", "SELECT siret, siren, coalesce(etat, '') AS etat, n_name AS commune FROM etab WHERE siret IN (SELECT key FROM val WHERE type = 'SIRET')")
def pruned_lookup(spark, sf):
    folder = f"{run_folder(spark)}/pruned-{uuid.uuid4().hex}"
    save_pruned(registry(spark, sf), folder)
    # Written: the ranges to open and the lookup both start from them.
    keys = held(list_keys(spark, sf, "SIRET", "siret"), "keys")
    found = est.by_siret(read_pruned(spark, folder).establishments, keys)
    return blanked(found.select("siret", "siren", F.col(est.STATE).alias("etat"), F.col("libelleCommuneEtablissement").alias("commune")))


@query("siblings", "SELECT siret, siren, coalesce(etat, '') AS etat FROM etab WHERE siren IN (SELECT key FROM val WHERE type = 'SIREN')")
def siblings(spark, sf):
    found = est.by_siren(registry(spark, sf).establishments, list_keys(spark, sf, "SIREN", "siren"))
    return blanked(found.select("siret", "siren", F.col(est.STATE).alias("etat")))


@query("legal_units", "SELECT siren, etat_ul AS etat, coalesce(denom, '') AS denomination FROM ul WHERE siren IN (SELECT key FROM val WHERE type = 'SIREN')")
def legal_units(spark, sf):
    found = est.by_siren(registry(spark, sf).legal_units, list_keys(spark, sf, "SIREN", "siren"))
    return blanked(
        found.select(
            "siren", F.col("etatAdministratifUniteLegale").alias("etat"),
            F.col("denominationUniteLegale").alias("denomination"),
        )
    )


@query(
    "links_touching",
    """SELECT pred, succ, d, CASE WHEN p AND s THEN 'INPUT_IS_PREDECESSOR_AND_SUCCESSOR' WHEN p THEN 'INPUT_IS_PREDECESSOR'
         ELSE 'INPUT_IS_SUCCESSOR' END AS match_type
       FROM (SELECT *, pred IN (SELECT key FROM val WHERE type = 'SIRET') AS p, succ IN (SELECT key FROM val WHERE type = 'SIRET') AS s FROM lnk)
       WHERE p OR s""",
)
def links_touching(spark, sf):
    touching = succession.links_touching(registry(spark, sf).links, list_keys(spark, sf, "SIRET", "siret"))
    return touching.select(
        F.col(PREDECESSOR).alias("pred"), F.col(SUCCESSOR).alias("succ"), F.col("dateLienSuccession").alias("d"),
        F.col("input_match_type").alias("match_type"),
    )


@query("history_slice", "SELECT siret, debut, coalesce(fin, '') AS fin FROM hist WHERE siret IN (SELECT key FROM val WHERE type = 'SIRET')")
def history_slice(spark, sf):
    found = hist.history_slice(registry(spark, sf).history, sirets=list_keys(spark, sf, "SIRET", "siret"))
    return blanked(found.select("siret", F.col("dateDebut").alias("debut"), F.col("dateFin").alias("fin")))


@query(
    "enrich_establishment",
    """SELECT row_id, coalesce(s.siret, '') AS siret, coalesce(s.siren, '') AS siren, coalesce(s.etat, '') AS etat, coalesce(nic, '') AS nic,
         coalesce(cp, '') AS code_postal, coalesce(n_name, '') AS commune
       FROM stat s LEFT JOIN etab e ON e.siret = s.siret""",
)
def enrich_establishment(spark, sf):
    t = control(spark, sf).control_table
    return blanked(
        t.select(
            "row_id", "siret", "siren", F.col(est.STATE).alias("etat"), "nic",
            F.col("codePostalEtablissement").alias("code_postal"), F.col("libelleCommuneEtablissement").alias("commune"),
        )
    )


@query(
    "enrich_legal_unit",
    """SELECT row_id, coalesce(s.siren, '') AS siren, coalesce(etat_ul, '') AS etat_ul, coalesce(nom_entreprise, '') AS denomination
       FROM stat s LEFT JOIN ul ON ul.siren = s.siren LEFT JOIN company c ON c.siren = s.siren""",
)
def enrich_legal_unit(spark, sf):
    t = control(spark, sf).control_table
    return blanked(
        t.select(
            "row_id", "siren", F.col("etatAdministratifUniteLegale").alias("etat_ul"),
            F.col("denomination_entreprise").alias("denomination"),
        )
    )


@query(
    "enrich_history",
    """SELECT row_id, coalesce(CAST(h_rows AS VARCHAR), '') AS historique_records_count, coalesce(h_debut, '') AS latest_start, coalesce(h_fin, '') AS latest_end
       FROM stat s LEFT JOIN hsum h ON h.siret = s.siret""",
)
def enrich_history(spark, sf):
    t = texted(control(spark, sf).control_table, "historique_records_count")
    return blanked(
        t.select(
            "row_id", "historique_records_count", F.col("historique_latest_dateDebut").alias("latest_start"),
            F.col("historique_latest_dateFin").alias("latest_end"),
        )
    )


# ---- counts, rankings, succession ---------------------------------------------------------------------


@query("sibling_counts", "SELECT siren, total, actifs, fermes FROM cnt")
def sibling_counts(spark, sf):
    counts = est.sibling_counts(registry(spark, sf).establishments)
    return counts.toDF("siren", "total", "actifs", "fermes")


@query("history_summary", "SELECT siret, h_rows, h_debut, coalesce(h_fin, '') AS h_fin FROM hsum")
def history_summary(spark, sf):
    return blanked(hist.history_summary(registry(spark, sf).history).toDF("siret", "h_rows", "h_debut", "h_fin"))


@query("input_duplicates", "SELECT row_id, CAST(dup_siret AS INTEGER) AS dup_siret, CAST(dup_siren AS INTEGER) AS dup_siren FROM stat")
def input_duplicates(spark, sf):
    s = control(spark, sf).statuses
    return s.select("row_id", bit(F.col("siret_duplicate")).alias("dup_siret"), bit(F.col("siren_duplicate")).alias("dup_siren"))


@query(
    "run_metrics",
    """SELECT count(*) AS total_input_siret, count(*) FILTER (type <> '') AS valid_siret_format,
         count(*) FILTER (siret IS NOT NULL) AS found_in_sirene, count(*) FILTER (status = 'ACTIVE') AS active,
         count(*) FILTER (status = 'CLOSED') AS closed, count(*) FILTER (status = 'RADIATED') AS radiated,
         count(*) FILTER (status = 'NOT_FOUND_IN_SIRENE') AS not_found, count(*) FILTER (status = 'INVALID_SIRET_FORMAT') AS invalid_format,
         count(*) FILTER (status = 'CLOSED' AND actifs > 0) AS move_candidates,
         count(DISTINCT CASE WHEN dup_siren THEN substr(key, 1, 9) END) AS duplicate_siren,
         count(*) FILTER (status = 'FOUND_UNKNOWN_STATUS') AS unknown_state FROM stat""",
)
def run_metrics(spark, sf):
    return control(spark, sf).metrics


@query("pick_for_siren", "SELECT siren, siret, mode FROM pick")
def pick_for_siren(spark, sf):
    return est.pick_for_siren(registry(spark, sf).establishments).select("siren", "siret", F.col("lookup_mode").alias("mode"))


@query(
    "sibling_choice",
    """SELECT row_id, coalesce(sibling, '') AS sibling, coalesce(n, 0) AS candidates, coalesce(reason, '') AS reason
       FROM stat LEFT JOIN sib USING (row_id) WHERE type <> ''""",
)
def sibling_choice(spark, sf):
    r = control(spark, sf)
    per_key = r.matched.select("siret_normalized", "sibling_siret", "sibling_candidates", "sibling_reason")
    joined = r.checked.filter("siret_format_ok").join(per_key, "siret_normalized", "left")
    return blanked(
        joined.select(
            "row_id", F.col("sibling_siret").alias("sibling"), F.col("sibling_candidates").alias("candidates"),
            F.col("sibling_reason").alias("reason"),
        )
    )


@query("best_link", "SELECT pred, succ FROM best")
def best_link(spark, sf):
    return succession.best_links(registry(spark, sf).links).toDF("pred", "succ")


@query(
    "dedup_keys",
    """SELECT siret, debut, coalesce(fin, '') AS fin FROM hist
       QUALIFY row_number() OVER (PARTITION BY siret ORDER BY debut DESC, fin NULLS LAST) = 1""",
)
def dedup_keys(spark, sf):
    periods = registry(spark, sf).history
    kept = est.first_per_key(periods, ["siret"], [F.col("dateDebut").desc_nulls_last(), F.col("dateFin").asc_nulls_last()])
    return blanked(kept.select("siret", F.col("dateDebut").alias("debut"), F.col("dateFin").alias("fin")))


@query(
    "resolve_successor",
    """SELECT start AS siret, coalesce(found, '') AS successor, depth AS hops,
         CASE WHEN found IS NULL THEN 'depth_reached' ELSE 'found' END AS outcome FROM walk WHERE found IS NOT NULL OR depth = 5""",
)
def resolve_successor(spark, sf):
    r = control(spark, sf)
    edges = succession.with_successor_state(succession.best_links(r.registry.links), r.registry.establishments)
    starts = r.matched.filter(rules.is_closed()).select(F.col("siret_normalized").alias("siret"))
    return blanked(succession.resolve_successors(starts, edges))


LINK_PROFILE = """SELECT count(*) AS links, count(*) FILTER (same) AS same_siren_links, count(*) FILTER (NOT same) AS other_siren_links,
    count(*) FILTER (NOT same AND cont) AS other_siren_with_continuity, count(DISTINCT pred) AS predecessors,
    (SELECT count(*) FROM (SELECT pred FROM lnk GROUP BY pred HAVING count(*) > 1)) AS predecessors_with_several_links,
    (SELECT count(*) FROM (SELECT pred FROM lnk GROUP BY pred HAVING count(DISTINCT left(succ, 9)) > 1)) AS predecessors_with_several_sirens,
    (SELECT max(n) FROM (SELECT count(*) AS n FROM lnk GROUP BY pred)) AS max_links
    FROM (SELECT *, left(pred, 9) = left(succ, 9) AS same FROM lnk)"""


@query("link_profile", LINK_PROFILE)
def link_profile(spark, sf):
    return succession.link_profile(registry(spark, sf).links)


def _merged_links(spark: SparkSession, sf: str) -> DataFrame:
    """State of all links, merged from the states of an earlier publication and of the links dated since."""
    links = registry(spark, sf).links
    recent = F.coalesce("dateLienSuccession", F.lit("")) >= "1996-01-01"
    before, since = (link_state.link_state(links.filter(part)) for part in (~recent, recent))
    return link_state.merged(held(before, "links-before"), held(since, "links-since"))


@query("best_link_merged", "SELECT pred, succ FROM best")
def best_link_merged(spark, sf):
    return link_state.best_of(_merged_links(spark, sf)).toDF("pred", "succ")


@query("link_profile_merged", LINK_PROFILE)
def link_profile_merged(spark, sf):
    return link_state.profile_of(_merged_links(spark, sf))


# ---- rules ------------------------------------------------------------------------------------------


@query("status", "SELECT row_id, status, CAST(actifs AS BIGINT) AS active_siblings FROM stat")
def status(spark, sf):
    return control(spark, sf).statuses.select(
        "row_id", F.col("siret_status").alias("status"), F.col("total_etablissements_actifs").alias("active_siblings")
    )


COUNTS = (
    "analysis_nb_candidats_remplacement", "total_etablissements", "total_etablissements_actifs", "total_etablissements_fermes",
    "historique_records_count",
)


def _overview_query(name: str, check: str, columns: dict[str, str]) -> None:
    def job(spark, sf):
        overview = texted(control(spark, sf).overview, *COUNTS)
        return overview.select("row_id", *[F.col(source).alias(alias) for alias, source in columns.items()])

    query(name, check)(job)


_overview_query(
    "replacement", "SELECT row_id, coalesce(repl, '') AS replacement FROM dec",
    {"replacement": "siret_remplacement_recommande"},
)
_overview_query("cleaning_action", "SELECT row_id, action FROM dec", {"action": "cleaning_action"})
_overview_query(
    "replacement_analysis",
    """SELECT row_id, CASE WHEN status = 'CLOSED' THEN CASE WHEN succ IS NULL THEN 'Non' ELSE 'Oui' END ELSE '' END AS succession_available,
         CASE source WHEN 'Autre SIRET même SIREN' THEN CAST(n AS VARCHAR) WHEN 'Aucun' THEN '0' ELSE '' END AS candidates,
         CASE WHEN source = 'Autre SIRET même SIREN' AND n > 1 THEN reason ELSE '' END AS reason, coalesce(source, '') AS source FROM dec""",
    {
        "succession_available": "analysis_succession_disponible", "candidates": "analysis_nb_candidats_remplacement",
        "reason": "analysis_raison_choix_remplacement", "source": "analysis_synthese_remplacement",
    },
)
_overview_query("cross_siren_alert", "SELECT row_id, coalesce(alert, '') AS alert FROM dec", {"alert": "analysis_alerte_siren_different"})
_overview_query("priority", "SELECT row_id, prio AS priority FROM dec", {"priority": "analysis_priority"})
_overview_query("status_note", "SELECT row_id, note FROM noted", {"note": "analysis_status_note"})
_overview_query("retained_siret", "SELECT row_id, coalesce(retained, '') AS retained FROM dec", {"retained": "siret_retenu"})
_overview_query(
    "data_policy",
    """SELECT row_id, applied, coalesce(shown_siren, '') AS siren, coalesce(x_nic, '') AS nic, coalesce(x_etat, '') AS etat,
         adresse, coalesce(nom_entreprise, '') AS denomination, CASE WHEN described THEN CAST(total AS VARCHAR) ELSE '' END AS siblings FROM shown""",
    {
        "applied": "analysis_data_applied", "siren": "siren", "nic": "nic", "etat": est.STATE, "adresse": "adresse_reconstituee",
        "denomination": "denomination_entreprise", "siblings": "total_etablissements",
    },
)


@query(
    "lookup_mode",
    "SELECT row_id, CASE WHEN type = 'SIREN' THEN coalesce(mode, 'SIREN_NOT_FOUND') ELSE '' END AS mode FROM stat",
)
def lookup_mode(spark, sf):
    return blanked(control(spark, sf).control_table.select("row_id", F.col("analysis_lookup_mode").alias("mode")))


_OVERVIEW_CHECK = f"""SELECT row_id, ref, pays, list_siren AS siren_entree, identifiant AS siret_entree, norm AS siret_normalise, key AS identifiant_recherche,
  CAST(type <> '' AS INTEGER) AS siret_format_valide, CASE WHEN dup_siret THEN 'Oui' ELSE 'Non' END AS siret_doublon_entree,
  CASE WHEN dup_siren THEN 'Oui' ELSE 'Non' END AS siren_doublon_entree, {STATUS_LABEL.format('status')} AS siret_status,
  action AS cleaning_action, coalesce(repl, '') AS siret_remplacement_recommande,
  CASE WHEN status = 'CLOSED' THEN CASE WHEN succ IS NULL THEN 'Non' ELSE 'Oui' END ELSE '' END AS analysis_succession_disponible,
  CASE source WHEN 'Autre SIRET même SIREN' THEN CAST(n AS VARCHAR) WHEN 'Aucun' THEN '0' ELSE '' END AS analysis_nb_candidats_remplacement,
  CASE WHEN source = 'Autre SIRET même SIREN' AND n > 1 THEN reason ELSE '' END AS analysis_raison_choix_remplacement,
  coalesce(source, '') AS analysis_synthese_remplacement, coalesce(alert, '') AS analysis_alerte_siren_different,
  CASE WHEN h_rows > 0 THEN 'Oui' ELSE 'Non' END AS analysis_historique_disponible, CASE WHEN nd THEN 'Oui' ELSE 'Non' END AS analysis_nd_detecte,
  prio AS analysis_priority, note AS analysis_status_note, applied AS analysis_data_applied, coalesce(retained, '') AS siret_retenu,
  coalesce(shown_siren, '') AS siren, coalesce(x_nic, '') AS nic, coalesce(nom_entreprise, '') AS denomination_entreprise,
  CASE WHEN shown_siren IS NULL THEN '' ELSE concat('FR', lpad(CAST((12 + 3 * (CAST(shown_siren AS BIGINT) % 97)) % 97 AS VARCHAR), 2, '0'), shown_siren) END AS tva_intracom,
  coalesce(x_etat, '') AS "etatAdministratifEtablissement", coalesce(etat_ul, '') AS "etatAdministratifUniteLegale", adresse AS adresse_reconstituee,
  coalesce(cp, '') AS "codePostalEtablissement", coalesce(n_name, '') AS "libelleCommuneEtablissement", coalesce(x_debut, '') AS "dateDebut", '' AS "dateFin",
  CASE WHEN described THEN CAST(total AS VARCHAR) ELSE '' END AS total_etablissements, CASE WHEN described THEN CAST(actifs AS VARCHAR) ELSE '' END AS total_etablissements_actifs,
  CASE WHEN described THEN CAST(fermes AS VARCHAR) ELSE '' END AS total_etablissements_fermes, CASE WHEN described THEN coalesce(CAST(h_rows AS VARCHAR), '') ELSE '' END AS historique_records_count,
  CASE WHEN described THEN coalesce(h_debut, '') ELSE '' END AS "historique_latest_dateDebut", CASE WHEN described THEN coalesce(h_fin, '') ELSE '' END AS "historique_latest_dateFin",
  coalesce(x_creation, '') AS "dateCreationEtablissement", coalesce('25.' || cp, '') AS "activitePrincipaleEtablissement",
  '' AS "nomenclatureActivitePrincipaleEtablissement", coalesce(enseigne, '') AS "enseigne1Etablissement", '' AS "denominationUsuelleEtablissement",
  '' AS "complementAdresseEtablissement", coalesce(numero, '') AS "numeroVoieEtablissement", '' AS "indiceRepetitionEtablissement",
  coalesce(type_voie, '') AS "typeVoieEtablissement", coalesce(voie, '') AS "libelleVoieEtablissement", '' AS "libelleCommuneEtrangerEtablissement",
  '' AS "distributionSpecialeEtablissement", '' AS "codeCommuneEtablissement", '' AS "codeCedexEtablissement", '' AS "libelleCedexEtablissement",
  '' AS "paysEtrangerEtablissement", '' AS "statutDiffusionUniteLegale", '' AS "categorieJuridiqueUniteLegale", coalesce(ape, '') AS "activitePrincipaleUniteLegale",
  '' AS "nomenclatureActivitePrincipaleUniteLegale", coalesce(denom, '') AS "denominationUniteLegale", coalesce(usuelle1, '') AS "denominationUsuelle1UniteLegale",
  '' AS "denominationUsuelle2UniteLegale", '' AS "denominationUsuelle3UniteLegale", coalesce(sigle, '') AS "sigleUniteLegale", coalesce(nom, '') AS "nomUniteLegale",
  '' AS "nomUsageUniteLegale", coalesce(prenom1, '') AS "prenom1UniteLegale", coalesce(prenom2, '') AS "prenom2UniteLegale", '' AS "prenom3UniteLegale"
  FROM shown"""


@query("overview", _OVERVIEW_CHECK)
def overview(spark, sf):
    table = texted(control(spark, sf).overview, *COUNTS)
    return table.withColumn("siret_format_valide", bit(F.col("siret_format_valide")))


# ---- result tables ----------------------------------------------------------------------------------


def _statistics_check(by_country: bool) -> str:
    rows = []

    def row(section, indicator, value, total):
        share = "NULL" if total is None else f"CASE WHEN {total} > 0 THEN round(CAST({value} AS DOUBLE) / {total}, 6) ELSE 0.0 END"
        rows.append((section, indicator, value, share))

    if by_country:
        row("country", "home", "home", "everything")
        row("country", "foreign", "foreigners", "everything")
        row("country", "unknown", "nowhere", "everything")
        row("country", "foreign kept", "kept", None)
        row("country", "total", "everything", None)
    else:
        row("input", "lines in the list", "base", "base")
    row("input", "analysed lines", "analysed_rows", "base")
    row("input", "duplicate SIRET lines", "d1", None)
    row("input", "duplicate SIREN lines", "d2", None)
    row("input", "distinct duplicate SIREN", "d3", None)
    row("identifiers", "missing", "missing", "base")
    row("identifiers", "total", "base", None)
    for indicator, value in (("not found", "nf"), ("invalid", "inv"), ("closed", "closed"), ("radiated", "rad"), ("active", "act")):
        row("status", indicator, value, "analysed_rows")
    row("status", "total", "analysed_rows", None)
    for indicator, value in (("by succession", "r1"), ("by active sibling", "r2"), ("other source", "0"), ("none", "r3")):
        row("replacement", indicator, value, "closed")
    row("replacement", "total", "closed", None)
    row("attention", "replacement on another SIREN", "alerts", "replaced")
    row("masked data", "with marker", "nd1", "visible")
    row("masked data", "without marker", "visible - nd1", "visible")
    row("masked data", "total", "visible", None)
    selects = [
        f"SELECT {i} AS position, '{s}' AS section, '{n}' AS indicateur, CAST({v} AS BIGINT) AS valeur, {share} AS part_du_total FROM totals"
        for i, (s, n, v, share) in enumerate(rows, start=1)
    ]
    rows_in_scope = "(scope <> 'foreign' OR type <> '')" if by_country else "true"
    totals = f"""WITH totals AS (SELECT *, analysed_rows + missing AS base FROM
        (SELECT count(*) AS analysed_rows, count(*) FILTER (dup_siret) AS d1, count(*) FILTER (dup_siren) AS d2,
          count(DISTINCT CASE WHEN dup_siren THEN substr(key, 1, 9) END) AS d3,
          count(*) FILTER (status = 'NOT_FOUND_IN_SIRENE') AS nf, count(*) FILTER (status = 'INVALID_SIRET_FORMAT') AS inv,
          count(*) FILTER (status = 'CLOSED') AS closed, count(*) FILTER (status IN ('RADIATED', 'FOUND_UNKNOWN_STATUS')) AS rad,
          count(*) FILTER (status = 'ACTIVE') AS act, count(*) FILTER (source = 'Succession') AS r1,
          count(*) FILTER (source = 'Autre SIRET même SIREN') AS r2, count(*) FILTER (source = 'Aucun') AS r3,
          count(*) FILTER (alert = 'Oui') AS alerts, count(repl) AS replaced,
          count(*) FILTER (status = 'ACTIVE' OR repl IS NOT NULL) AS visible,
          count(*) FILTER ((status = 'ACTIVE' OR repl IS NOT NULL) AND nd) AS nd1 FROM shown),
        (SELECT count(*) AS everything, count(*) FILTER (scope = 'home') AS home, count(*) FILTER (scope = 'foreign') AS foreigners,
          count(*) FILTER (scope = 'unknown') AS nowhere, count(*) FILTER (scope = 'foreign' AND type <> '') AS kept,
          count(*) FILTER (regexp_full_match(digits, '0*') AND {rows_in_scope}) AS missing FROM scoped)) """
    text_ = totals + " UNION ALL ".join(selects)
    if by_country:
        # The run only analyses the lines in scope.
        return _nested(text_).replace(
            "analysed AS (SELECT * FROM val WHERE",
            "analysed AS (SELECT * FROM val WHERE (lower(trim(pays)) IN ('fr', 'fra', 'france') OR regexp_full_match(trim(pays), '0*') OR type <> '') AND",
        )
    return _nested(text_)


def _nested(text_: str) -> str:
    """Merge a query that has its own WITH clause into the common one."""
    own = text_.removeprefix("WITH ")
    built = sql(own)
    return built[: len(built) - len(own)].rstrip() + ", " + own


def _statistics(spark, sf, by_country: bool) -> DataFrame:
    lines = user_lines(spark, sf)
    scope = scoping.scope_counts(lines, "pays" if by_country else None, "identifiant", include_foreign_valid=by_country)
    if by_country:
        scoped = scoping.with_country_scope(lines, "pays", "identifiant")
        lines = scoping.keep_country(scoped, include_foreign_valid=True).select(*lines.columns)
    analysed, _ = scoping.split_missing(lines, "identifiant")
    result = run_control(analysed, "identifiant", registry(spark, sf), ControlOptions(row_id="ref"))
    table = reports.statistics_table(result.overview, scope, by_country, foreign_included=by_country)
    return table.select(
        "position", "section", "indicateur", "valeur", F.round("part_du_total", 6).alias("part_du_total")
    )


@query("statistics", _statistics_check(False))
def statistics(spark, sf):
    return _statistics(spark, sf, False)


@query("statistics_by_country", _statistics_check(True))
def statistics_by_country(spark, sf):
    return _statistics(spark, sf, True)


@query(
    "anomalies_table",
    """SELECT 'identifier empty or zero' AS "Motif", identifiant AS siret_entree, ref, pays FROM val WHERE regexp_full_match(digits, '0*')
       UNION ALL SELECT CASE status WHEN 'NOT_FOUND_IN_SIRENE' THEN 'identifier not found in the registry' ELSE 'identifier fails validation' END,
         identifiant, ref, pays FROM stat WHERE status IN ('NOT_FOUND_IN_SIRENE', 'INVALID_SIRET_FORMAT')""",
)
def anomalies_table(spark, sf):
    _, missing = scoping.split_missing(user_lines(spark, sf), "identifiant")
    return reports.anomalies_table(control(spark, sf).overview, ["ref", "pays"], missing, "identifiant")


_DUPLICATE = """SELECT '{0} duplicate' AS "Motif", ref, identifiant AS siret_entree, norm AS siret_normalise, key AS identifiant_recherche,
    CASE WHEN dup_siret THEN 'Oui' ELSE 'Non' END AS siret_doublon_entree, CASE WHEN dup_siren THEN 'Oui' ELSE 'Non' END AS siren_doublon_entree,
    {1} AS duplicate_key FROM stat WHERE {2}"""


@query(
    "duplicates_table",
    _DUPLICATE.format("SIRET", "key", "dup_siret") + " UNION ALL " + _DUPLICATE.format("SIREN", "substr(key, 1, 9)", "dup_siren"),
)
def duplicates_table(spark, sf):
    table = reports.duplicates_table(control(spark, sf).overview, ["ref"])
    return reports.listing_order(table).drop("row_id", "siren")


@query(
    "to_close_table",
    """SELECT CASE WHEN status = 'CLOSED' THEN 'closed without replacement' ELSE 'radiated' END AS probleme_siret, row_id, norm AS siret_normalise, action AS cleaning_action
       FROM dec WHERE (status = 'CLOSED' AND repl IS NULL) OR status IN ('RADIATED', 'FOUND_UNKNOWN_STATUS')""",
)
def to_close_table(spark, sf):
    table = reports.to_close_table(control(spark, sf).overview)
    return table.select("probleme_siret", "row_id", "siret_normalise", "cleaning_action")


@query(
    "move_candidates",
    """SELECT row_id, s.siret, coalesce(b.succ, '') AS successor FROM stat s LEFT JOIN best b ON b.pred = s.key
       WHERE status = 'CLOSED' AND actifs > 0""",
)
def move_candidates(spark, sf):
    return blanked(control(spark, sf).move_candidates.select("row_id", "siret", F.col("successeur_potentiel").alias("successor")))


_COMPARED = ["row_id", "siret_status", "siret_remplacement_recommande", "analysis_synthese_remplacement"]


@query(
    "run_diff",
    f"""SELECT label AS status, changed AS column_name, CAST(count(*) FILTER (differs) AS BIGINT) AS changed_rows FROM (
        SELECT {STATUS_LABEL.format('d.status')} AS label, unnest(['siret_remplacement_recommande', 'analysis_synthese_remplacement', 'siret_status', '(only before)', '(only after)']) AS changed,
          unnest([coalesce(short_repl, '') <> coalesce(d.repl, ''),
                  coalesce(short_source, '') <> coalesce(d.source, ''), false, false, false]) AS differs
        FROM dec d JOIN (SELECT d.row_id, CASE WHEN status = 'CLOSED' THEN coalesce(CASE WHEN hops = 1 THEN succ END, sibling) END AS short_repl,
            CASE WHEN status = 'CLOSED' THEN CASE WHEN hops = 1 THEN 'Succession' WHEN sibling IS NOT NULL THEN 'Autre SIRET même SIREN' ELSE 'Aucun' END END AS short_source
          FROM dec d) USING (row_id)) GROUP BY 1, 2""",
)
def run_diff_job(spark, sf):
    after = control(spark, sf)
    before = dataclasses.replace(after, options=dataclasses.replace(after.options, max_depth=1))
    return run_diff(held(before.overview.select(*_COMPARED), "before"), held(after.overview.select(*_COMPARED), "after"), "row_id", "siret_status")


@query(
    "run_diff_one_row",
    f"""SELECT {STATUS_LABEL.format('d.status')} AS status, changed AS column_name,
          CAST(count(*) FILTER (changed = 'siret_status' AND row_id = (SELECT max(row_id) FROM dec)) AS BIGINT) AS changed_rows
        FROM dec d CROSS JOIN (SELECT unnest(['siret_remplacement_recommande', 'analysis_synthese_remplacement', 'siret_status', '(only before)', '(only after)']) AS changed)
        GROUP BY 1, 2""",
)
def run_diff_one_row(spark, sf):
    """A run against itself with the status of its last line changed: only that line's slice is joined."""
    before = held(control(spark, sf).overview.select(*_COMPARED), "before")
    last = before.agg(F.max("row_id").alias("last"))
    after = before.join(F.broadcast(last), F.col("row_id") == F.col("last"), "left")
    status = F.when(F.col("last").isNotNull(), F.concat("siret_status", F.lit(" (changed)"))).otherwise(F.col("siret_status"))
    return run_diff(before, held(after.withColumn("siret_status", status).drop("last"), "after"), "row_id", "siret_status")


# ---- names and columns --------------------------------------------------------------------------------


def _name_lines(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(stage(spark, sf).names_parquet)


def _candidates(spark: SparkSession, sf: str) -> DataFrame:
    queries = names.prepare_queries(_name_lines(spark, sf), "row_id", "nom", "code_postal")
    return names.search_names(queries, registry(spark, sf))


@query("name_candidates", "SELECT row_id, CAST(rank AS BIGINT) AS rank, siret, denomination, adresse, score_similarite FROM found3")
def name_candidates(spark, sf):
    return _candidates(spark, sf).withColumn("rank", F.col("rank").cast("bigint"))


@query("candidates_wide", "SELECT * FROM wide3")
def candidates_wide(spark, sf):
    return names.candidates_wide(_name_lines(spark, sf), "row_id", _candidates(spark, sf))


@query(
    "candidate_priority",
    """SELECT row_id, CASE WHEN upper(pays) NOT IN ('FR', 'FRA', 'FRANCE') THEN 3 WHEN suggested_siret_1 <> '' THEN 1 ELSE 2 END AS priority FROM wide3""",
)
def candidate_priority(spark, sf):
    wide = names.candidates_wide(_name_lines(spark, sf), "row_id", _candidates(spark, sf))
    return wide.select("row_id", names.review_priority(F.col("pays"), F.col("suggested_siret_1")).alias("priority"))


@query(
    "name_search_counts",
    """SELECT count(*) FILTER (suggested_siret_1 <> '') AS lines_with_candidate, count(*) FILTER (suggested_siret_1 = '') AS lines_without_candidate,
         (SELECT count(*) FROM found3) AS candidates FROM wide3""",
)
def name_search_counts(spark, sf):
    return names.search_counts(names.candidates_wide(_name_lines(spark, sf), "row_id", _candidates(spark, sf)))


def _profile_check() -> str:
    parts = []
    for name, column, id_match, country_match in (
        ("ref", "ref", 0, 0), ("identifiant", "identifiant", 0, 0), ("pays", "pays", 0, 2), ("siren", "list_siren", 2, 0),
    ):
        number = f"regexp_replace({column}, '[^0-9]', '', 'g')"
        parts.append(
            f"""SELECT '{name}' AS column_name, count(*) AS rows, round(count(*) FILTER (trim({column}) <> '') / count(*), 6) AS filled_share,
              round(count(*) FILTER ((length(num) >= 14 AND {key_valid('substr(num, 1, 14)')}) OR (length(num) >= 9 AND {key_valid('substr(num, 1, 9)')})) / count(*), 6) AS valid_identifier_share,
              round(count(*) FILTER (lower(trim({column})) IN ('fr', 'fra', 'france')) / count(*), 6) AS home_country_share,
              {id_match} AS identifier_name_match, {country_match} AS country_name_match FROM (SELECT *, {number} AS num FROM inp)"""
        )
    return " UNION ALL ".join(parts)


@query("profile_columns", _profile_check())
def profile_columns(spark, sf):
    table = profile.profile_columns(user_lines(spark, sf))
    shares = ("filled_share", "valid_identifier_share", "home_country_share")
    return table.select(*[F.round(c, 6).alias(c) if c in shares else F.col(c) for c in table.columns])


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    return overview(spark, sf)
