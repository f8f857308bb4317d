"""Succession links: best link per predecessor and the walk to a usable successor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from registra.functions.text import is_true
from registra.operators.establishments import STATE, state_code
from registra.schema import PREDECESSOR, SUCCESSOR

MAX_DEPTH = 5

FOUND, DEPTH_REACHED = "found", "depth_reached"

# How a link touches the list.
BOTH = "INPUT_IS_PREDECESSOR_AND_SUCCESSOR"
AS_PREDECESSOR = "INPUT_IS_PREDECESSOR"
AS_SUCCESSOR = "INPUT_IS_SUCCESSOR"


def spread_key(key: Column, row: Column) -> Column:
    """Join key for rows that have nothing to look up.

    A null or shared key would send all of them to one task. They get a per-row value instead that
    matches nothing and spreads evenly.
    """
    return F.coalesce(key, F.concat(F.lit("-"), row.cast("string")))


def links_touching(links: DataFrame, keys: DataFrame) -> DataFrame:
    """Links with an input on either end. Each link is looked up as two rows, one an end, in one pass and one semi-join."""
    wanted = keys.select(F.col("siret").alias("_end")).filter("_end is not null").distinct()
    both = F.array(*[F.struct(F.col(c).alias("end"), F.lit(side).alias("side")) for side, c in enumerate((PREDECESSOR, SUCCESSOR))])
    # Numbered before the two rows are made, or each row would get a number of its own.
    ends = links.withColumn("_link", F.monotonically_increasing_id()).withColumn("_one", F.explode(both))
    ends = ends.select("_link", *links.columns, F.col("_one.end").alias("_end"), F.col("_one.side").alias("_side")).filter("_end is not null")
    found = ends.join(wanted, "_end", "left_semi").groupBy("_link").agg(
        *[F.any_value(c).alias(c) for c in links.columns], F.min("_side").alias("_first"), F.max("_side").alias("_last")
    )
    kind = F.when(F.col("_first") < F.col("_last"), BOTH).when(F.col("_first") == 0, AS_PREDECESSOR).otherwise(AS_SUCCESSOR)
    return found.select(*links.columns, kind.alias("input_match_type"))


def best_links(links: DataFrame) -> DataFrame:
    """One successor per predecessor: latest link, then economic continuity, then lowest successor.

    Ranked over every link of the table, so the result does not depend on the list being checked.
    """
    window = Window.partitionBy("predecessor").orderBy(
        F.col("_date").desc(), F.col("_continued").desc(), F.col("successor").asc()
    )
    return (
        links.filter(F.col(PREDECESSOR).isNotNull() & F.col(SUCCESSOR).isNotNull())
        .select(
            F.col(PREDECESSOR).alias("predecessor"),
            F.col(SUCCESSOR).alias("successor"),
            # ISO dates order as text and a missing one ("") comes last.
            F.trim(F.coalesce("dateLienSuccession", F.lit(""))).alias("_date"),
            is_true(F.col("continuiteEconomique")).alias("_continued"),
        )
        .withColumn("_rank", F.row_number().over(window))
        .filter("_rank = 1")
        .select("predecessor", "successor")
    )


def with_successor_state(best: DataFrame, establishments: DataFrame) -> DataFrame:
    """Add whether each successor ends a walk: active, or unknown to the registry."""
    closed = (
        establishments.filter(~state_code(F.col(STATE)).isin("", "A"))
        .select(F.col("siret").alias("successor"))
        .distinct()
        .withColumn("_closed", F.lit(True))
    )
    joined = best.join(closed, "successor", "left")
    return joined.select("predecessor", "successor", F.col("_closed").isNull().alias("usable"))


def resolve_successors(starts: DataFrame, edges: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Follow best links from each `siret` of `starts` to the first usable successor.

    Returns (siret, successor, hops, outcome): `found` for the starts that reach one, `depth_reached` without a
    successor for those whose chain was still open after `max_depth` links. A cycle or a dead end yields no row. The
    edge side of every hop is the same exchange, shuffled once and reused.
    """
    walk = starts.select("siret").distinct().select(
        "siret",
        F.col("siret").alias("_at"),
        F.array("siret").alias("_seen"),
        F.lit(None).cast("string").alias("_found"),
        F.lit(None).cast("int").alias("_hops"),
    )
    step = edges.select(
        F.col("predecessor").alias("_key"), F.col("successor").alias("_next"), F.col("usable").alias("_usable")
    )
    for depth in range(1, max_depth + 1):
        moved = walk.withColumn("_key", spread_key(F.col("_at"), F.col("siret"))).join(step, "_key", "left")
        fresh = F.col("_next").isNotNull() & ~F.array_contains("_seen", F.col("_next"))
        ends = fresh & F.col("_usable")
        goes_on = fresh & ~F.col("_usable")
        walk = moved.select(
            "siret",
            F.when(goes_on, F.col("_next")).alias("_at"),
            F.when(goes_on, F.array_append("_seen", F.col("_next"))).otherwise(F.col("_seen")).alias("_seen"),
            F.when(ends, F.col("_next")).otherwise(F.col("_found")).alias("_found"),
            F.when(ends, F.lit(depth)).otherwise(F.col("_hops")).alias("_hops"),
        )
    found = F.col("_found").isNotNull()
    return walk.filter(found | F.col("_at").isNotNull()).select(
        "siret",
        F.col("_found").alias("successor"),
        F.coalesce("_hops", F.lit(max_depth)).alias("hops"),
        F.when(found, FOUND).otherwise(DEPTH_REACHED).alias("outcome"),
    )


def link_counts() -> list[Column]:
    """Counts of one predecessor's links. Those of disjoint sets of links add up; the ends keep the lesser and greater."""
    same = F.substring(PREDECESSOR, 1, 9) == F.substring(SUCCESSOR, 1, 9)
    return [
        F.count("*").alias("links"),
        F.count_if(same).alias("same"),
        F.count_if(~same & is_true(F.col("continuiteEconomique"))).alias("other_continued"),
        F.min(F.substring(SUCCESSOR, 1, 9)).alias("lowest"),
        F.max(F.substring(SUCCESSOR, 1, 9)).alias("highest"),
    ]


def profile_of_counts(per_predecessor: DataFrame) -> DataFrame:
    """Volumes of a link table from one row per predecessor."""
    several = F.col("links") > 1
    return per_predecessor.agg(
        F.coalesce(F.sum("links"), F.lit(0)).alias("links"),
        F.coalesce(F.sum("same"), F.lit(0)).alias("same_siren_links"),
        F.coalesce(F.sum(F.col("links") - F.col("same")), F.lit(0)).alias("other_siren_links"),
        F.coalesce(F.sum("other_continued"), F.lit(0)).alias("other_siren_with_continuity"),
        F.count("*").alias("predecessors"),
        F.count_if(several).alias("predecessors_with_several_links"),
        F.count_if(several & (F.col("lowest") != F.col("highest"))).alias("predecessors_with_several_sirens"),
        F.coalesce(F.max("links"), F.lit(0)).alias("max_links"),
    )


def link_profile(links: DataFrame) -> DataFrame:
    """Volumes of the link table: two partial aggregations, the second over one row per predecessor."""
    complete = links.filter(F.col(PREDECESSOR).isNotNull() & F.col(SUCCESSOR).isNotNull())
    return profile_of_counts(complete.groupBy(PREDECESSOR).agg(*link_counts()))
