"""Best link and link counts per predecessor, kept from one publication to the next.

A state is a table with one row per predecessor. Counts add up, and the best link is the greatest of a struct, so states
of disjoint parts of the link table merge into the state of the whole: a monthly delta is merged instead of ranking all links
again. A greatest value cannot be taken back, so links that were withdrawn or corrected name their predecessors, which
alone are ranked anew (`replaced`).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from registra.functions.text import is_true
from registra.operators.succession import link_counts, profile_of_counts
from registra.schema import PREDECESSOR, SUCCESSOR

COUNTED = ("links", "same", "other_continued")


def _falling(text: Column) -> Column:
    """Text that orders the other way round: every half byte inverted, and an end mark that puts short texts last."""
    return F.concat(F.translate(F.hex(text), "0123456789ABCDEF", "FEDCBA9876543210"), F.lit("G"))


def link_state(links: DataFrame) -> DataFrame:
    """State of a link table. Links without either end count for nothing, a repeated link counts each time."""
    ranked = F.struct(
        # ISO dates order as text and a missing one ("") comes last.
        F.trim(F.coalesce("dateLienSuccession", F.lit(""))).alias("date"),
        is_true(F.col("continuiteEconomique")).alias("continued"),
        _falling(F.col(SUCCESSOR)).alias("order"),
        F.col(SUCCESSOR).alias("successor"),
    )
    complete = links.filter(F.col(PREDECESSOR).isNotNull() & F.col(SUCCESSOR).isNotNull())
    return complete.groupBy(F.col(PREDECESSOR).alias("predecessor")).agg(F.max(ranked).alias("best"), *link_counts())


def merged(first: DataFrame, *others: DataFrame) -> DataFrame:
    """State of all links behind the given states, whose link tables must not share links. In any order."""
    together = reduce(DataFrame.unionByName, others, first)
    return together.groupBy("predecessor").agg(
        F.max("best").alias("best"), *[F.sum(c).alias(c) for c in COUNTED], F.min("lowest").alias("lowest"), F.max("highest").alias("highest")
    )


def replaced(state: DataFrame, links: DataFrame, predecessors: DataFrame) -> DataFrame:
    """State after links of `predecessors` (column `predecessor`) were withdrawn or corrected.

    `links` is the new link table, of which only those predecessors' links are ranked. Predecessors without a link left go.
    """
    changed = predecessors.select("predecessor").filter("predecessor is not null").distinct()
    ranked = link_state(links.join(changed.withColumnRenamed("predecessor", PREDECESSOR), PREDECESSOR, "left_semi"))
    return state.join(changed, "predecessor", "left_anti").unionByName(ranked)


def best_of(state: DataFrame) -> DataFrame:
    """One successor per predecessor, as `best_links` ranks them."""
    return state.select("predecessor", F.col("best.successor").alias("successor"))


def profile_of(state: DataFrame) -> DataFrame:
    """Volumes of the link table, as `link_profile` counts them."""
    return profile_of_counts(state)
