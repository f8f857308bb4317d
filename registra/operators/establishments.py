"""Lookups, counts and rankings over registry establishments.

Every ranking is a row_number() with a small limit. Spark cuts each map task to that limit before the
shuffle (WindowGroupLimit), so a legal unit holding a large share of the registry sends only a few
rows per task. Counts use partial aggregation for the same reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from registra.functions.text import date_or_null, is_true
from registra.sources.pruned import in_ranges_of
from registra.sources.registry import RANKING_FIELDS

STATE = "etatAdministratifEtablissement"
HEAD_OFFICE, ACTIVE_FALLBACK, NOT_FOUND = "SIREN_SIEGE", "SIREN_ACTIVE_FALLBACK", "SIREN_NOT_FOUND"


def state_code(state: Column) -> Column:
    return F.upper(F.trim(state))


def by_siret(establishments: DataFrame, keys: DataFrame) -> DataFrame:
    """Establishments whose `siret` is in `keys` (one column `siret`)."""
    opened = in_ranges_of(establishments, keys, "siret")
    return opened.join(keys.select("siret").distinct(), "siret", "left_semi")


def by_siren(table: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of any registry table whose `siren` is in `keys` (one column `siren`)."""
    return in_ranges_of(table, keys, "siren").join(keys.select("siren").distinct(), "siren", "left_semi")


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Keep the first row of each key under a total order, so that re-runs agree."""
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter("_rank = 1").drop("_rank")


def one_per_siret(establishments: DataFrame) -> DataFrame:
    """One row per SIRET: latest period first, remaining ties settled by the row's own content."""
    # Ranking columns first: a wide and a narrow projection then keep the same row.
    rest = [c for c in establishments.columns if c not in RANKING_FIELDS]
    others = [c for c in (*RANKING_FIELDS, *rest) if c not in ("siret", "dateDebut")]
    order = [F.col("dateDebut").desc_nulls_last(), *[F.col(c).asc_nulls_last() for c in others]]
    return first_per_key(establishments, ["siret"], order)


def one_per_siren(legal_units: DataFrame) -> DataFrame:
    others = [c for c in legal_units.columns if c != "siren"]
    return first_per_key(legal_units, ["siren"], [F.col(c).asc_nulls_last() for c in others])


def known_unique(df: DataFrame, key: str) -> DataFrame:
    """The rows of `df`, which has one per `key`, as an aggregate.

    The optimizer sees from it that the key is unique, and leaves out a left join, with the reads behind it, of which no
    column is asked for. The rows arrive by key already, so nothing is shuffled for it.
    """
    rest = [c for c in df.columns if c != key]
    row = F.first(F.struct(*rest)).alias("_row")
    return df.groupBy(key).agg(row).select(*[c if c == key else F.col(f"_row.`{c}`") for c in df.columns])


def sibling_counts(establishments: DataFrame) -> DataFrame:
    state = F.upper(F.col(STATE))
    return establishments.groupBy("siren").agg(
        F.count("*").alias("total_etablissements"),
        F.count_if(state == "A").alias("total_etablissements_actifs"),
        F.count_if(state == "F").alias("total_etablissements_fermes"),
    )


def _ranking(establishments: DataFrame) -> DataFrame:
    return (
        establishments.select(*RANKING_FIELDS)
        .filter((F.trim("siren") != "") & (F.trim("siret") != ""))
        .withColumns(
            {
                "_siege": is_true(F.col("etablissementSiege")),
                "_active": F.coalesce(F.upper(F.col(STATE)) == "A", F.lit(False)),
                "_start": date_or_null(F.col("dateDebut")),
                "_creation": date_or_null(F.col("dateCreationEtablissement")),
            }
        )
    )


def _recent_first() -> list[Column]:
    return [
        F.col("_siege").desc(),
        F.col("_start").desc_nulls_last(),
        F.col("_creation").desc_nulls_last(),
        F.col("siret").asc(),
    ]


def pick_for_siren(establishments: DataFrame) -> DataFrame:
    """Establishment answering for a SIREN: head office, else the most recent active one."""
    eligible = _ranking(establishments).filter(F.col("_siege") | F.col("_active"))
    window = Window.partitionBy("siren").orderBy(*_recent_first())
    return (
        eligible.withColumn("_rank", F.row_number().over(window))
        .filter("_rank = 1")
        .select(
            "siren",
            "siret",
            STATE,
            F.when(F.col("_siege"), HEAD_OFFICE).otherwise(ACTIVE_FALLBACK).alias("lookup_mode"),
        )
    )


def active_siblings(establishments: DataFrame) -> DataFrame:
    """Per SIREN: the two best active establishments and how many active ones there are.

    Two are enough: a row never recommends itself, so the second is used when the first is the row.
    """
    active = _ranking(establishments).filter("_active")
    window = Window.partitionBy("siren").orderBy(*_recent_first())
    # A SIRET listed twice must not take both places.
    single = first_per_key(active, ["siren", "siret"], _recent_first())
    entry = F.struct(
        "siret",
        F.col("_siege").alias("siege"),
        (F.trim(F.coalesce("dateDebut", F.lit(""))) != "").alias("started"),
        (F.trim(F.coalesce("dateCreationEtablissement", F.lit(""))) != "").alias("created"),
    )
    best = (
        single.withColumn("_rank", F.row_number().over(window))
        .filter("_rank <= 2")
        .groupBy("siren")
        .agg(
            F.max(F.when(F.col("_rank") == 1, entry)).alias("first_active"),
            F.max(F.when(F.col("_rank") == 2, entry)).alias("second_active"),
        )
    )
    counts = single.groupBy("siren").agg(F.count("*").alias("active_count"))
    return best.join(counts, "siren")


def sibling_choice(own: Column, own_active: Column) -> dict[str, Column]:
    """Replacement columns for a frame joined with `active_siblings`.

    `own` is the row's identifier and `own_active` whether it is itself an active establishment of
    that legal unit. A row that is the only active one gets itself.
    """
    first, second, count = F.col("first_active"), F.col("second_active"), F.col("active_count")
    own_is_first = first["siret"] == own
    chosen = F.when(own_is_first & second.isNotNull(), second).otherwise(first)
    others = F.when(F.coalesce(own_active, F.lit(False)) & (count > 1), count - 1).otherwise(count)
    reason = (
        F.when(others.isNull(), F.lit(None))
        .when(others == 1, "only active establishment of the legal unit")
        .when(chosen["siege"], "head office among several active establishments")
        .when(chosen["started"], "latest start date among several active establishments")
        .when(chosen["created"], "latest creation date among several active establishments")
        .otherwise("lowest identifier among several active establishments")
    )
    return {
        "sibling_siret": chosen["siret"],
        "sibling_candidates": F.coalesce(others, F.lit(0).cast("bigint")),
        "sibling_reason": reason,
    }
