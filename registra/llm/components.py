"""Connected components of a link table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from registra.operators.held import held


def _least_neighbour(links: DataFrame, name: str) -> DataFrame:
    # The least neighbour is a partial aggregate, and the join's other side has one row a node: a hub is never one group.
    return links.groupBy(F.col("a").alias(name)).agg(F.min("b").alias("least"))


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = _least_neighbour(both, "node").select("node", F.least("least", "node").alias("least"))
    return both.join(least, both.a == least.node).filter("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = _least_neighbour(down, "node")
    moved = down.join(least, down.a == least.node)
    return moved.select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(least.select(F.col("node").alias("a"), F.col("least").alias("b")))


def _settled(links: DataFrame) -> tuple[int, int]:
    row = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def components(links: DataFrame, a: Column, b: Column) -> DataFrame:
    """`node` and `root` (its component's least node) for every node with a link to another one.

    Each round is written to the shared folder, so plans stay short and a lost executor costs its own tasks only.
    """
    links = held(links.select(a.alias("a"), b.alias("b")).filter("a <> b").distinct(), "links")
    before = None
    while True:
        links = held(_small_star(_large_star(links)).filter("a <> b").distinct(), "stars")
        now = _settled(links)
        if now == before:
            # At rest every node points at its root, and roots point nowhere.
            roots = links.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
            return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
        before = now
