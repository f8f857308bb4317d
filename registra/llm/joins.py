"""Joins that broadcast a side only after its size has been checked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes up to which a table is sent to all workers; beyond that Spark shuffles both sides.
BROADCAST_BYTES = 64 << 20


def join_by_size(left: DataFrame, right: DataFrame, on: list[str], size: int) -> DataFrame:
    """Inner join; `size` is the measured (or bounded) number of bytes of `right`."""
    return left.join(F.broadcast(right) if size <= BROADCAST_BYTES else right, on)
