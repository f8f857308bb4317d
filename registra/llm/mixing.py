"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

Sources share the whole volume by weight. A source stops at `max_epochs` times its own size and the others share the excess
by weight until none is above its stop. Sorted by the level at which each source fills up, that fixed point is a running
sum: the water level is the remaining volume over the remaining weight. A source's target is then met by whole
repetitions of every document and one more of some: documents in the order of a seeded hash, up to the one nearest
to the target. The order is cut in 4096 buckets; their sums find the bucket where the target falls, and only that
bucket's documents are ordered, so a source with a third of all rows never meets in one task.

Built-in functions only. Defined cases: a null text has size 0 and a null source is a source of its own, the last; a source
without words has target 0; rows alike in doc_id and text are taken alike; an empty table gives an empty table; results
depend on content and seed only, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from registra.operators.held import held

WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
SEED = "mix"
#: Leading hexadecimal digits of a document's hash that name its bucket.
BUCKET_DIGITS = 3

WORD = r"[^\x20\x09-\x0D]+"


def measured(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", seed: str = SEED) -> DataFrame:
    """`docs` as a struct `row`, with its source, its size in words and its seeded place in the source."""
    row = docs.select(F.struct("*").alias("row"))
    body = F.coalesce(F.col(f"row.`{text}`").cast("string"), F.lit(""))
    place = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(f"row.`{key}`").cast("string"), F.lit("")), body))
    return row.select(
        "row",
        F.col(f"row.`{source}`").alias("source"),
        F.regexp_count(body, F.lit(WORD)).cast("long").alias("size"),
        place.alias("place"),
    )


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Water-filling over (`source`, `source_size`): adds `target`.

    One row a source: a mixture's list of sources, not its documents, is what one task sorts here.
    """
    order = F.col("source").asc_nulls_last()
    cycle = F.array(*[F.lit(w).cast("long") for w in weights])
    everything = Window.partitionBy(F.lit(0))
    weighed = sizes.select(
        "source",
        "source_size",
        F.get(cycle, ((F.row_number().over(everything.orderBy(order)) - 1) % len(weights)).cast("int")).alias("weight"),
        (F.col("source_size") * max_epochs).alias("cap"),
        F.sum("source_size").over(everything).alias("total"),
    )
    full_at = F.col("cap") / F.col("weight")
    filling = everything.orderBy(full_at, order)
    filled = F.coalesce(F.sum("cap").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    open_weight = F.sum("weight").over(filling.rowsBetween(0, Window.unboundedFollowing))
    levels = weighed.withColumn("level", (F.col("total") - filled) / open_weight)
    level = F.max(F.when(F.col("level") <= full_at, F.col("level"))).over(everything)
    return levels.withColumn("water", level).select(
        "source", "source_size", F.coalesce(F.least(F.col("cap").cast("double"), F.col("weight") * F.col("water")), F.col("cap").cast("double")).alias("target")
    )


def plan_mixture(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Per source of (`source`, `size`, `place`): size, target, whole repetitions, and the last place repeated once more."""
    bucket = F.substring("place", 1, BUCKET_DIGITS)
    buckets = held(rows.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("size")), "buckets")
    sizes = buckets.groupBy("source").agg(F.sum("size").alias("source_size"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    wanted = held(
        targets(sizes, weights, max_epochs)
        .withColumn("whole", whole)
        .withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")),
        "targets",
    )
    of_source = wanted.select(F.col("source").alias("of"), "rest")
    running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    met = held(
        buckets.join(of_source, F.col("source").eqNullSafe(F.col("of")))
        .withColumn("before", F.coalesce(F.sum("size").over(running), F.lit(0)))
        .filter((F.col("before") < F.col("rest")) & (F.col("rest") <= F.col("before") + F.col("size")))
        .select("of", F.col("bucket").alias("cut"), "before", "rest"),
        "met",
    )
    inside = rows.select("source", "size", "place").join(met, F.col("source").eqNullSafe(F.col("of")) & (bucket == F.col("cut")))
    in_order = Window.partitionBy("source").orderBy("place", "size").rowsBetween(Window.unboundedPreceding, 0)
    nearest = 2 * (F.col("before") + F.sum("size").over(in_order)) - F.col("size") < 2 * F.col("rest")
    last = (
        inside.withColumn("taken", nearest)
        .groupBy("source")
        .agg(F.coalesce(F.max(F.when(F.col("taken"), F.col("place"))), F.first("cut")).alias("last"))
        .withColumnRenamed("source", "of")
    )
    return held(
        wanted.join(last, F.col("source").eqNullSafe(F.col("of")), "left").select(
            F.col("source").alias("of"), "source_size", "target", "whole", "last"
        ),
        "mixture",
    )


def repetitions() -> Column:
    """Times a document is taken, on rows joined with their source's plan."""
    return F.col("whole") + F.when(F.col("place") <= F.col("last"), F.lit(1)).otherwise(F.lit(0))


def mix(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """`rows` (of `measured`) with their source's size and target, and `times`, how often the mixture takes each."""
    joined = rows.join(plan, F.col("source").eqNullSafe(F.col("of")))
    return joined.withColumn("times", repetitions()).drop("of", "whole", "last")
