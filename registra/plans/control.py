"""The control run: list of identifiers in, one overview row per analysed line out.

Everything that needs the registry is decided once per distinct identifier. The list itself is joined a
single time at the end, so an identifier repeated over a third of the list costs one lookup. The order is:
narrow columns of the registry first (match, counts, ranking, status, replacement), then one wide read
for the establishments whose data the overview shows.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timezone
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from registra.functions.identifiers import check_identifiers, vat_number
from registra.functions.naming import address_line, company_name
from registra.functions.text import yes_no
from registra.operators import rules
from registra.operators.establishments import (
    STATE,
    active_siblings,
    by_siren,
    by_siret,
    known_unique,
    one_per_siren,
    one_per_siret,
    pick_for_siren,
    sibling_choice,
    sibling_counts,
)
from registra.operators.held import held
from registra.operators.history import SUMMARY, history_slice, history_summary
from registra.operators.succession import (
    MAX_DEPTH,
    best_links,
    links_touching,
    resolve_successors,
    spread_key,
    with_successor_state,
)
from registra import schema
from registra.schema import ESTABLISHMENT_FIELDS, LEGAL_UNIT_FIELDS, PREDECESSOR, SUCCESSOR
from registra.sources.registry import Registry

COUNTS = ("total_etablissements", "total_etablissements_actifs", "total_etablissements_fermes")
ESTABLISHMENT_DATA = tuple(f for f in ESTABLISHMENT_FIELDS if f not in ("siret", "siren"))
LEGAL_UNIT_DATA = tuple(f for f in LEGAL_UNIT_FIELDS if f != "siren")

# Columns of the overview after the list's own, in order, by the part of the result they belong to.
# Remaining registry fields follow.
OVERVIEW_PARTS = (
    ("list", ("siret_entree",)),
    (
        "format",
        ("siret_normalise", "identifiant_recherche", "siret_format_valide", "siret_doublon_entree", "siren_doublon_entree"),
    ),
    (
        "analysis",
        (
            "siret_status",
            "cleaning_action",
            "siret_remplacement_recommande",
            "analysis_succession_disponible",
            "analysis_nb_candidats_remplacement",
            "analysis_raison_choix_remplacement",
            "analysis_synthese_remplacement",
            "analysis_alerte_siren_different",
            "analysis_historique_disponible",
            "analysis_nd_detecte",
            "analysis_priority",
            "analysis_status_note",
            "analysis_data_applied",
        ),
    ),
    (
        "registry",
        (
            "siret_retenu",
            "siren",
            "nic",
            "denomination_entreprise",
            "tva_intracom",
            "etatAdministratifEtablissement",
            "etatAdministratifUniteLegale",
            "adresse_reconstituee",
            "codePostalEtablissement",
            "libelleCommuneEtablissement",
            "dateDebut",
            "dateFin",
            *COUNTS,
            *SUMMARY,
        ),
    ),
)
OVERVIEW_COLUMNS = tuple(name for _, names in OVERVIEW_PARTS for name in names)
PART_OF = {name: part for part, names in OVERVIEW_PARTS for name in names}
# Overview columns that belong to the line, not to its identifier.
LINE_COLUMNS = {
    "siret_entree": "siret_input",
    "siret_normalise": "siret_normalized",
    "identifiant_recherche": "siret_lookup_key",
    "siret_format_valide": "siret_format_ok",
}
INVALID_NOTE = "Identifier fails validation."
# What a line without a valid identifier shows; it has no row among the decisions.
INVALID_LINE = {
    "siret_doublon_entree": "Non",
    "siren_doublon_entree": "Non",
    "siret_status": rules.STATUS_LABELS[rules.INVALID],
    "cleaning_action": rules.ACTION_LABELS[rules.INVALID],
    "analysis_historique_disponible": "Non",
    "analysis_nd_detecte": "Non",
    "analysis_priority": rules.PRIORITY_LABELS["HIGH"],
    "analysis_status_note": INVALID_NOTE,
    "analysis_data_applied": rules.OWN_DATA,
}
# Identifiers are digits, which a codec that only looks for repeats keeps at a byte each.
COMPRESSION = "zstd"
MASKED_MARK = r"(?i)\[\s*ND\s*\]"


@dataclass(frozen=True)
class ControlOptions:
    """`row_id`: column of the list that numbers its rows; without it one is generated.

    `list_columns`: columns of the list to show, all when None. `load_replacements=False`: show no data of
    replacements from legal units that no line of the list belongs to; a line then depends on the other lines.
    `max_depth`: links followed at most; lines whose chain goes on are marked `depth_reached`.
    """

    row_id: str | None = None
    list_columns: tuple[str, ...] | None = None
    max_depth: int = MAX_DEPTH
    load_replacements: bool = True


def identifier_keys(checked: DataFrame) -> DataFrame:
    """Distinct valid identifiers with how many lines carry them, and the duplicate flags."""
    # Invalid lines are dropped by their count, after the partial aggregate. A filter on the flag would be
    # pushed into the scan and repeat the whole validation there.
    keys = (
        checked.groupBy("siret_normalized", "siret_lookup_key", "siret_input_type", "siret_validation_route")
        .agg(F.count_if("siret_format_ok").alias("line_count"))
        .filter("line_count > 0")
        .withColumn("key_siren", F.substring("siret_lookup_key", 1, 9))
    )
    per_siren = keys.groupBy("key_siren").agg(F.sum("line_count").alias("_siren_lines"))
    return (
        keys.join(per_siren, "key_siren")
        .withColumn("siret_duplicate", (F.col("siret_input_type") == "SIRET") & (F.col("line_count") > 1))
        .withColumn("siren_duplicate", F.col("_siren_lines") > 1)
        .drop("_siren_lines", "key_siren")
    )


def keys_of_type(keys: DataFrame, kind: str, name: str) -> DataFrame:
    return keys.filter(F.col("siret_input_type") == kind).select(F.col("siret_lookup_key").alias(name))


def match(keys: DataFrame, registry: Registry) -> DataFrame:
    """Keys with the establishment that answers them, sibling counts, sibling choice and status."""
    ranked = registry.narrow
    # Written: the siblings wanted and the answers both start from it.
    direct = held(one_per_siret(by_siret(ranked, keys_of_type(keys, "SIRET", "siret"))), "direct", COMPRESSION)
    wanted = direct.select("siren").unionByName(keys_of_type(keys, "SIREN", "siren"))
    siblings = held(by_siren(registry.ranking, wanted), "siblings", COMPRESSION)

    answers = direct.select(
        F.col("siret").alias("siret_lookup_key"), "siret", "siren", STATE, F.lit(None).cast("string").alias("matched_mode")
    ).unionByName(
        pick_for_siren(by_siren(siblings, keys_of_type(keys, "SIREN", "siren"))).select(
            F.col("siren").alias("siret_lookup_key"), "siret", "siren", STATE, F.col("lookup_mode").alias("matched_mode")
        )
    )
    facts = sibling_counts(siblings).join(active_siblings(siblings), "siren", "left")
    facts = facts.withColumnRenamed("siren", "_siren")
    matched = keys.join(answers, "siret_lookup_key", "left").withColumn(
        "_siren", spread_key(F.col("siren"), F.col("siret_normalized"))
    )
    own = F.col("siret_normalized")
    own_active = (F.col("siret") == own) & (F.upper(F.col(STATE)) == "A")
    return (
        matched.join(facts, "_siren", "left")
        .withColumns({c: F.coalesce(F.col(c), F.lit(0).cast("bigint")) for c in COUNTS})
        .withColumns(sibling_choice(own, own_active))
        .drop("_siren", "first_active", "second_active", "active_count")
        .withColumn("siret_status", rules.status(F.lit(True)))
    )


def decide(matched: DataFrame, registry: Registry, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Add the succession result and every rule that follows from it."""
    if registry.links is None or registry.missing(schema.LINKS) & {PREDECESSOR, SUCCESSOR}:
        nothing = F.lit(None).cast("string")
        walked = matched.withColumns({"successor_siret": nothing, "succession_outcome": nothing})
    else:
        starts = matched.filter(rules.is_closed()).select(F.col("siret_normalized").alias("siret"))
        best = best_links(registry.links) if registry.successors is None else registry.successors
        edges = with_successor_state(best, registry.establishments)
        found = resolve_successors(starts, edges, max_depth).select(
            F.col("siret").alias("siret_normalized"),
            F.col("successor").alias("successor_siret"),
            F.col("outcome").alias("succession_outcome"),
        )
        # Only closed ones have a row there; the others need not be shuffled to find that out.
        closed = F.coalesce(rules.is_closed(), F.lit(False))
        walked = matched.filter(closed).join(known_unique(found, "siret_normalized"), "siret_normalized", "left")
        walked = walked.unionByName(matched.filter(~closed), allowMissingColumns=True)
    return with_rules(walked)


def with_rules(walked: DataFrame) -> DataFrame:
    """Rule columns, in dependency order, for a frame that carries status, successor and sibling."""
    return (
        walked.withColumn("siret_remplacement_recommande", rules.replacement())
        .withColumn("analysis_synthese_remplacement", rules.replacement_source())
        .withColumns(
            {
                "cleaning_action": rules.cleaning_action(),
                "analysis_succession_disponible": rules.succession_available(),
                "analysis_nb_candidats_remplacement": rules.candidate_count(),
                "analysis_raison_choix_remplacement": rules.choice_reason(),
                "analysis_alerte_siren_different": rules.other_siren_alert(),
                "analysis_priority": rules.priority(),
                "siret_retenu": rules.retained_siret(),
                "analysis_lookup_mode": rules.lookup_mode(),
            }
        )
        .withColumn("analysis_status_note", rules.status_note())
    )


def _joined(left: DataFrame, right: DataFrame, left_key: Column, right_key: str) -> DataFrame:
    """Left join on a key that may be absent, without gathering the absent ones in one task."""
    keyed = left.withColumn("_key", spread_key(left_key, F.col("siret_normalized")))
    return keyed.join(right.withColumnRenamed(right_key, "_key"), "_key", "left").drop("_key")


def _with_history(frame: DataFrame, registry: Registry, siret: Column) -> DataFrame:
    if registry.history is None:
        return frame.withColumns(
            {
                SUMMARY[0]: F.lit(None).cast("bigint"),
                SUMMARY[1]: F.lit(None).cast("string"),
                SUMMARY[2]: F.lit(None).cast("string"),
            }
        )
    missing = registry.missing(schema.HISTORY)
    dates = {"has_start": "dateDebut" not in missing, "has_end": "dateFin" not in missing}
    if "siret" in missing:
        # The table only knows legal units.
        periods = history_slice(registry.history, sirens=siren_keys(frame))
        return _joined(frame, history_summary(periods, "siren", **dates), F.col("siren"), "siren")
    periods = history_slice(registry.history, sirets=frame.select(siret.alias("siret")).filter("siret is not null"))
    return _joined(frame, history_summary(periods, **dates), siret, "siret")


def history_key() -> Column:
    """Establishment whose history a row shows: the matched one, else the identifier itself when it names one."""
    return F.coalesce("siret", F.when(F.col("siret_input_type") == "SIRET", F.col("siret_lookup_key")))


def own_data(decided: DataFrame, registry: Registry) -> DataFrame:
    """Decisions with the matched establishment's own data, before any substitution."""
    establishments = by_siret(registry.establishments, decided.select("siret").filter("siret is not null"))
    data = known_unique(one_per_siret(establishments).select("siret", *ESTABLISHMENT_DATA), "siret")
    units = known_unique(one_per_siren(by_siren(registry.legal_units, siren_keys(decided))), "siren")
    frame = _joined(decided.drop(*ESTABLISHMENT_DATA), data, F.col("siret"), "siret")
    frame = _joined(frame, units, F.col("siren"), "siren")
    frame = _with_history(frame, registry, history_key())
    return frame.withColumns(
        {
            "adresse_reconstituee": address_line(),
            "denomination_entreprise": company_name(),
            "tva_intracom": vat_number(F.col("siren")),
        }
    )


def shown_data(decided: DataFrame, registry: Registry, load_replacements: bool = True) -> DataFrame:
    """Decisions with the data the overview shows.

    A closed row shows its replacement, an unloaded or absent replacement shows nothing, and a
    replacement from another legal unit carries no legal-unit data. One wide read of the registry.
    """
    closed = rules.is_closed()
    aimed = decided.withColumn(
        "_shown", F.when(closed, F.col("siret_remplacement_recommande")).otherwise(F.col("siret"))
    )
    found = siren_keys(decided)
    wide = by_siret(registry.establishments, aimed.select(F.col("_shown").alias("siret")).filter("siret is not null"))
    if not load_replacements:
        wide = by_siren(wide, found)
    data = one_per_siret(wide).select(
        "siret", F.col("siren").alias("_shown_siren"), F.lit(True).alias("_loaded"), *ESTABLISHMENT_DATA
    )
    data = known_unique(data, "siret")
    frame = _joined(aimed.drop(*ESTABLISHMENT_DATA), data, F.col("_shown"), "siret")

    frame = _with_history(frame, registry, history_key())
    frame = frame.withColumns(
        {
            "analysis_historique_disponible": yes_no(F.coalesce(F.col(SUMMARY[0]), F.lit(0)) > 0),
            "analysis_data_applied": F.when(~closed, rules.OWN_DATA)
            .when(F.col("_shown").isNull(), rules.CLOSED_NO_DATA)
            .when(F.col("_loaded").isNotNull(), rules.REPLACEMENT_DATA)
            .otherwise(rules.REPLACEMENT_NOT_LOADED),
            # The legal unit described; none once the replacement leads to another one.
            "siren": F.when(~closed | (F.col("_shown_siren") == F.col("siren")), F.col("siren")),
        }
    )
    described = ~closed | F.col("siren").isNotNull()
    frame = frame.withColumns({c: F.when(described, F.col(c)) for c in (*COUNTS, *SUMMARY)})

    units = known_unique(one_per_siren(by_siren(registry.legal_units, found)), "siren")
    frame = _joined(frame, units, F.col("siren"), "siren")
    frame = frame.withColumns(
        {
            "adresse_reconstituee": address_line(),
            "denomination_entreprise": company_name(),
            "tva_intracom": vat_number(F.col("siren")),
        }
    )
    masked = ["denomination_entreprise", "adresse_reconstituee", "siren", *ESTABLISHMENT_DATA, *LEGAL_UNIT_DATA]
    return frame.withColumn("analysis_nd_detecte", yes_no(masked_mark(masked))).drop(
        "_shown", "_shown_siren", "_loaded"
    )


def siren_keys(decided: DataFrame) -> DataFrame:
    return decided.select("siren").filter("siren is not null")


def masked_mark(columns: list[str]) -> Column:
    """Whether any column holds the marker of withheld data; the separator keeps columns apart."""
    return F.concat_ws("\u0001", *[F.col(c) for c in columns]).rlike(MASKED_MARK)


def _list_names(columns: list[str], taken: set[str]) -> dict[str, str]:
    """Name each list column has in results: its own, with a suffix for as long as another column has it in any case."""
    used, names = {name.lower() for name in taken}, {}
    for column in columns:
        name = column
        while name.lower() in used:
            name += "_entree"
        used.add(name.lower())
        names[column] = name
    return names


@dataclass(frozen=True)
class ControlResult:
    """Results of a run: lazy, but for the identifier tables that the first result written needs and the count in `run_log`.

    What is decided per distinct identifier is written to the shared folder when it is first asked for, so the
    list itself is read twice only: once for its identifiers and once for the final join. The run log asks for none of it.
    """

    checked: DataFrame
    registry: Registry
    options: ControlOptions
    identifier_column: str
    list_columns: tuple[str, ...]

    @cached_property
    def matched(self) -> DataFrame:
        """What the registry holds per identifier, written: every result but the run log starts from it."""
        keys = held(identifier_keys(self.checked), "keys", COMPRESSION)
        return held(match(keys, self.registry), "matched", COMPRESSION)

    @cached_property
    def decided(self) -> DataFrame:
        """Decisions per identifier, written too: the wide read and the list join start from it."""
        return held(decide(self.matched, self.registry, self.options.max_depth), "decided", COMPRESSION)

    def _on_list(self, decisions: DataFrame) -> DataFrame:
        """Bring per-identifier results back to the lines of the list."""
        keyed = self.checked.withColumn(
            "_key", F.when(F.col("siret_format_ok"), F.col("siret_normalized"))
        ).withColumn("_key", spread_key(F.col("_key"), F.col("row_id")))
        carried = decisions.drop("siret_lookup_key", "siret_input_type", "siret_validation_route", "line_count")
        return keyed.join(carried.withColumnRenamed("siret_normalized", "_key"), "_key", "left").drop("_key")

    def _filled(self, frame: DataFrame) -> DataFrame:
        """Lines without a valid identifier get the decisions that need no lookup."""
        return frame.withColumns(
            {
                "siret_status": F.coalesce("siret_status", F.lit(rules.INVALID)),
                "siret_duplicate": F.coalesce("siret_duplicate", F.lit(False)),
                "siren_duplicate": F.coalesce("siren_duplicate", F.lit(False)),
                **{c: F.when(F.col("siret_status").isNull(), F.lit(0).cast("bigint")).otherwise(F.col(c)) for c in COUNTS},
            }
        )

    @cached_property
    def statuses(self) -> DataFrame:
        """Lines with their status only: no succession walk, no wide read."""
        kept = self.matched.select(
            "siret_normalized", "siret", "siren", STATE, "siret_duplicate", "siren_duplicate", *COUNTS, "siret_status"
        )
        return self._filled(self._on_list(kept))

    @cached_property
    def metrics(self) -> DataFrame:
        return self.statuses.agg(*rules.metric_columns())

    @cached_property
    def control_table(self) -> DataFrame:
        """Lines with their own registry data, before substitution.

        Decisions come from their table where it is written already, else straight from the matches: whoever asks for
        columns that no succession decides then walks no links.
        """
        written = "decided" in self.__dict__
        return self._control_rows(
            self.decided if written else decide(self.matched, self.registry, self.options.max_depth)
        )

    def _control_rows(self, decided: DataFrame) -> DataFrame:
        frame = self._filled(self._on_list(own_data(decided, self.registry)))
        names = _list_names(list(self.list_columns), set(frame.columns))
        return frame.select(
            "row_id",
            *[F.col(f"_list.`{c}`").alias(names[c]) for c in self.list_columns],
            *[c for c in frame.columns if c not in ("row_id", "_list")],
        )

    @cached_property
    def overview(self) -> DataFrame:
        """One row per analysed line, numbered by `row_id`, text columns without nulls.

        Result columns are finished per identifier, so the join with the list carries those only.
        """
        data = shown_data(self.decided, self.registry, self.options.load_replacements)
        rest = [c for c in (*ESTABLISHMENT_DATA, *LEGAL_UNIT_DATA) if c not in OVERVIEW_COLUMNS]
        produced = [*OVERVIEW_COLUMNS, *rest]
        finished = {
            "siret_doublon_entree": yes_no(F.col("siret_duplicate")),
            "siren_doublon_entree": yes_no(F.col("siren_duplicate")),
            "siret_status": rules.status_label(F.col("siret_status")),
            "analysis_priority": rules.priority_label(F.col("analysis_priority")),
        }
        carried = [c for c in produced if c not in LINE_COLUMNS]
        per_key = data.select("siret_normalized", *[finished.get(c, F.col(c)).alias(c) for c in carried])

        frame = self._on_list(per_key)
        types = dict(frame.dtypes)
        shown = [c for c in self.list_columns if c != self.identifier_column]
        if self.options.list_columns is not None:
            shown = [c for c in shown if c in self.options.list_columns]
        names = _list_names(shown, {"row_id", *produced})

        def finish(name: str) -> Column:
            if name in LINE_COLUMNS:
                return F.col(LINE_COLUMNS[name])
            if name in COUNTS:
                return F.when(F.col("siret_format_ok"), F.col(name)).otherwise(F.lit(0).cast("bigint"))
            if types[name] != "string":
                return F.col(name)
            absent = F.lit("")
            if name in INVALID_LINE:
                absent = F.when(F.col("siret_format_ok"), "").otherwise(INVALID_LINE[name])
            return F.coalesce(F.col(name), absent)

        return frame.select(
            "row_id",
            *[_tagged(F.coalesce(F.col(f"_list.`{c}`"), F.lit("")), names[c], "list", list_column=c) for c in shown],
            *[_tagged(finish(c), c, column_group(c)) for c in produced],
        )

    @cached_property
    def move_candidates(self) -> DataFrame:
        """Closed lines whose legal unit is still active, with the best link's successor."""
        wanted = (F.col("siret_status") == rules.CLOSED) & (F.col("total_etablissements_actifs") > 0)
        # Known per identifier: the wide read and the links are cut to those before anything else.
        decided = self.decided.filter(wanted)
        closed = self._control_rows(decided).filter(wanted).withColumn("move_candidate_reason", F.lit("closed while the legal unit keeps an active establishment"))
        if self.registry.links is None:
            return closed
        sources = decided.select(F.col("siret_lookup_key").alias(PREDECESSOR)).distinct()
        # With published best links the join below finds the few it needs.
        published = self.registry.successors
        best = best_links(self.registry.links.join(sources, PREDECESSOR, "left_semi")) if published is None else published
        successors = best.select(F.col("predecessor").alias("siret_lookup_key"), F.col("successor").alias("successeur_potentiel"))
        return closed.join(successors, "siret_lookup_key", "left")

    @cached_property
    def all_establishments(self) -> DataFrame:
        """Every establishment of every legal unit found."""
        return by_siren(self.registry.establishments, siren_keys(self.matched))

    def _siret_keys(self) -> DataFrame:
        return keys_of_type(self.matched, "SIRET", "siret")

    @cached_property
    def succession_links(self) -> DataFrame | None:
        return None if self.registry.links is None else links_touching(self.registry.links, self._siret_keys())

    @cached_property
    def history(self) -> DataFrame | None:
        if self.registry.history is None:
            return None
        return history_slice(self.registry.history, self.matched.select(history_key().alias("siret")).filter("siret is not null"))

    @cached_property
    def run_log(self) -> DataFrame:
        """Parameters of the run, one per row, to append to a log table."""
        paths = {name: path or "" for name, path in vars(self.registry.paths).items()} if self.registry.paths else {}
        values = {
            "execution_timestamp": datetime.now(timezone.utc).isoformat(timespec="seconds"),
            "input_siret_column": self.identifier_column,
            "input_row_count": str(self.checked.count()),
            **paths,
        }
        return self.checked.sparkSession.createDataFrame(list(values.items()), "parameter string, value string")

    @cached_property
    def schema_report(self) -> DataFrame:
        """Where each canonical column comes from."""
        return schema.schema_report(self.checked.sparkSession, self.registry.resolutions)

    def warnings(self) -> list[str]:
        """Absent columns, and optional tables in which nothing was found."""
        found = self.registry.warnings()
        if self.succession_links is not None and self.succession_links.isEmpty():
            found.append("links: no link touches an identifier of the list")
        if self.history is not None and self.history.isEmpty():
            found.append("history: no period for an identifier of the list")
        return found


def column_group(name: str) -> str:
    """Which part of the result a column belongs to, stored as column metadata."""
    return PART_OF.get(name, "registry")


def _tagged(value: Column, name: str, group: str, **more: str) -> Column:
    return value.alias(name, metadata={"group": group, **more})


def run_control(
    lines: DataFrame, identifier_column: str, registry: Registry, options: ControlOptions = ControlOptions()
) -> ControlResult:
    """Check `lines`. Scope them first (registra.operators.scoping) when countries matter."""
    if identifier_column not in lines.columns:
        raise ValueError(f"identifier column not found: {identifier_column}")
    row_id = F.monotonically_increasing_id() if options.row_id is None else F.col(f"`{options.row_id}`").cast("bigint")
    # The list's columns travel in one struct, so they cannot collide with registry names.
    packed = lines.select(
        row_id.alias("row_id"),
        F.struct(*[F.col(f"`{c}`").cast("string").alias(c) for c in lines.columns]).alias("_list"),
        F.col(f"`{identifier_column}`").alias("_identifier"),
    )
    checked = check_identifiers(packed, "_identifier").drop("_identifier")
    return ControlResult(checked, registry, options, identifier_column, tuple(lines.columns))
