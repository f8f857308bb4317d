"""A copy of the registry laid out by ranges of identifiers, of which a lookup opens only those its keys fall into.

A range is the first digits of the legal unit's identifier, so a SIRET and its SIREN share one. Rows whose two identifiers
disagree, or that have no such digits, are kept in a range of their own that every lookup opens: nothing is lost.
"""

from __future__ import annotations

import dataclasses

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from registra.sources.registry import KEY_RANGE, Registry, registry_from_frames

RANGE, OTHER = KEY_RANGE, "other"
#: Leading digits that make a range: at most 1,000 ranges and `OTHER`, whatever the registry holds.
WIDTH = 3

_LAID_OUT = ("establishments", "legal_units", "history")


def _first_digits(identifier: Column) -> Column:
    start = F.substring(identifier, 1, WIDTH)
    return F.when(start.rlike(f"^[0-9]{{{WIDTH}}}$"), start)


def _range_of_row(columns: list[str]) -> Column:
    present = [c for c in ("siret", "siren") if c in columns]
    ranges = [_first_digits(F.col(c)) for c in present]
    odd = F.lit(False)
    for c, digits in zip(present, ranges):
        odd = odd | (F.col(c).isNotNull() & digits.isNull())
    # A row with one identifier agrees with itself; one with none has no range. Plain comparisons compile, arrays do not.
    first, agreed = F.coalesce(*ranges), F.lit(True)
    for digits in ranges:
        agreed = agreed & F.coalesce(digits == first, F.lit(True))
    return F.coalesce(F.when(agreed & ~odd, first), F.lit(OTHER))


def save_pruned(registry: Registry, folder: str, partitions: int | None = None) -> None:
    """Write the canonical registry once per publication, into a folder that does not exist yet.

    Tasks hold neighbouring ranges and rows are sorted by key within them, so that files and row groups hold few keys each. A
    range that is larger than a task's share is spread over several. `<table>_columns` keeps the columns of a table, also of an
    empty one.
    """
    partitions = partitions or int(registry.establishments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for name in (*_LAID_OUT, "links"):
        table: DataFrame | None = getattr(registry, name)
        if table is None:
            continue
        table.limit(0).write.parquet(f"{folder}/{name}_columns")
        if name == "links":
            table.write.parquet(f"{folder}/{name}")
            continue
        key = "siret" if "siret" in table.columns else "siren"
        laid_out = table.withColumn(RANGE, _range_of_row(table.columns)).repartitionByRange(partitions, RANGE, key)
        laid_out.sortWithinPartitions(RANGE, key).write.partitionBy(RANGE).parquet(f"{folder}/{name}")


def read_pruned(spark: SparkSession, folder: str) -> Registry:
    """Open such a copy. Lookups of `registra.operators` then open the ranges of their keys only."""

    def stored(name: str) -> DataFrame | None:
        try:
            columns = spark.read.parquet(f"{folder}/{name}_columns").schema
        except AnalysisException:
            if name in ("establishments", "legal_units"):
                raise
            return None
        # The range is declared: Spark would read it as a number and lose its zeros.
        declared = columns if name == "links" else StructType([*columns.fields, StructField(RANGE, StringType())])
        return spark.read.schema(declared).parquet(f"{folder}/{name}")

    tables = {name: stored(name) for name in (*_LAID_OUT, "links")}
    registry = registry_from_frames(**tables, pad_ids=False)

    def with_range(name: str) -> DataFrame | None:
        canonical = getattr(registry, name)
        return None if canonical is None else tables[name].select(*canonical.columns, RANGE)

    return dataclasses.replace(registry, **{name: with_range(name) for name in _LAID_OUT})


def in_ranges_of(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows of the ranges that `keys` fall into, without the range column; a table without ranges as it is.

    The ranges wanted are at most 1,001 short rows, so they are broadcast, which lets Spark choose the folders to open while the
    query runs.
    """
    if RANGE not in table.columns:
        return table
    wanted = keys.select(F.explode(F.array(_first_digits(F.col(key)), F.lit(OTHER))).alias(RANGE))
    # The comparison drops nulls, and tells the optimizer that the ranges are worth pruning by.
    ranges = wanted.filter(F.col(RANGE) >= "").distinct()
    return table.join(F.broadcast(ranges), RANGE, "left_semi").drop(RANGE)
