"""Column-by-column comparison of two runs over the same list, narrowed to the rows that can differ."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from registra.operators.held import held

ONLY_BEFORE, ONLY_AFTER = "(only before)", "(only after)"
#: Slices of the keys that are compared by digest. More slices: fewer equal rows beside a changed one; also the most rows a task's digests have per status.
SLICES = 65_536
NO_KEY = -1


def _slice(key: str, slices: int) -> Column:
    # Rows without a key match nothing, so their slice always counts as changed.
    return F.when(F.col(key).isNull(), F.lit(NO_KEY)).otherwise(F.pmod(F.xxhash64(key), F.lit(slices))).cast("int")


def slice_digests(before: DataFrame, after: DataFrame, key: str, compared: list[str], status: str | None, slices: int = SLICES) -> DataFrame:
    """`slice`, `status` and whether both runs hold `equal` rows there.

    A row is two 64-bit digests over its key and values. Within a slice and status they are combined with the same row of the other run
    by exclusive or, which leaves zero where every row has its equal; row counts must balance too. Both runs are one union, so
    this is one partial aggregation: what is shuffled grows with slices and tasks, not with rows or their width.
    """

    def side(run: DataFrame, sign: int) -> DataFrame:
        # Hashes skip nulls, so absence is hashed as a value of its own.
        values = [F.col(key), *[v for c in compared for v in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())]]
        return run.select(
            _slice(key, slices).alias("slice"),
            (F.col(f"`{status}`") if status else F.lit("")).alias("status"),
            F.lit(sign).alias("sign"),
            F.xxhash64(F.lit(1), *values).alias("first"),
            F.xxhash64(F.lit(2), *values).alias("second"),
        )

    sums = side(before, 1).unionByName(side(after, -1)).groupBy("slice", "status").agg(
        F.sum("sign").alias("surplus"), F.bit_xor("first").alias("first"), F.bit_xor("second").alias("second")
    )
    equal = (F.col("slice") != NO_KEY) & (F.col("surplus") == 0) & (F.col("first") == 0) & (F.col("second") == 0)
    return sums.select("slice", "status", equal.alias("equal"))


def changed_rows(run: DataFrame, key: str, digests: DataFrame, slices: int = SLICES) -> DataFrame:
    """Rows of the slices in which the two runs differ. At most `slices` + 1 numbers are broadcast; rows stay where they are."""
    changed = digests.filter(~F.col("equal")).select("slice").distinct()
    narrowed = run.withColumn("_slice", _slice(key, slices))
    return narrowed.join(F.broadcast(changed), F.col("_slice") == changed["slice"], "left_semi").drop("_slice")


def run_diff(before: DataFrame, after: DataFrame, key: str, status: str | None = None, slices: int = SLICES) -> DataFrame:
    """Changed values per column, and per status of the earlier run when one is named.

    `key` numbers the lines, so it is unique and spreads evenly. Rows of one run only are counted under
    their own names. Both runs should be written tables, since they are read twice: once for the digests of their slices, once for
    the slices that differ. Only rows of those meet in a full join. Two equal runs join no row. A difference would go unseen only if
    all 128 bits of a slice's digests came out equal by chance.
    """
    compared = [c for c in before.columns if c in after.columns and c != key]
    digests = held(slice_digests(before, after, key, compared, status, slices), "digests")
    left, right = (changed_rows(run, key, digests, slices) for run in (before, after))
    left = left.select(F.col(key), *[F.col(f"`{c}`").alias(f"a_{i}") for i, c in enumerate(compared)], F.lit(True).alias("_a"))
    right = right.select(F.col(key), *[F.col(f"`{c}`").alias(f"b_{i}") for i, c in enumerate(compared)], F.lit(True).alias("_b"))
    joined = left.join(right, key, "full")
    at = compared.index(status) if status else None
    group = F.lit("") if status is None else F.coalesce(F.col(f"a_{at}"), F.col(f"b_{at}"))
    both = F.col("_a") & F.col("_b")
    counts = joined.groupBy(group.alias("status")).agg(
        F.count_if(F.col("_b").isNull()).alias("only_a"),
        F.count_if(F.col("_a").isNull()).alias("only_b"),
        *[F.count_if(both & ~F.col(f"a_{i}").eqNullSafe(F.col(f"b_{i}"))).alias(f"n_{i}") for i in range(len(compared))],
    )
    # A status whose rows are all equal has its zeros too.
    unchanged = digests.filter("equal").select("status").distinct()
    counts = unchanged.unionByName(counts, allowMissingColumns=True).groupBy("status").agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts.columns[1:]]
    )
    entries = [
        F.struct(F.lit(name).alias("column_name"), F.col(count).alias("changed_rows"))
        for name, count in [(ONLY_BEFORE, "only_a"), (ONLY_AFTER, "only_b"), *[(c, f"n_{i}") for i, c in enumerate(compared)]]
    ]
    return counts.select("status", F.inline(F.array(*entries)))
