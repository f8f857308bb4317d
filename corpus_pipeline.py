"""Cleaning a corpus of documents in stages, each written to shared storage and read again as the next one's input.

Every stage takes all that the one before kept. All but the last return the columns of `documents`; the last adds `shard` and
`slot`. Columns of the documents are carried in a struct inside the stages, so extra columns of any name pass through;
null texts fail the quality rules like empty ones, and an empty table passes through as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from registra.llm import decontaminate, mixing, quality_rules, sharding, simhash
from registra.operators.held import held


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the threshold table keeps."""
    return quality_rules.judge(docs).filter("kept").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints: the one with the smallest doc_id, of repeated ones any one."""
    return simhash.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return decontaminate.contamination(docs, benchmark).filter(F.size("hits") == 0).select("row.*")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them."""
    rows = mixing.measured(docs)
    plan = mixing.plan_mixture(held(rows.select("source", "size", "place"), "measured"))
    mixed = mixing.mix(rows, plan).filter("times > 0")
    return mixed.select("row", F.explode(F.array_repeat(F.lit(0), F.col("times").cast("int")))).select("row.*")


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their shard and their place in it."""
    placed = sharding.assign_shards(sharding.prepared(docs))
    taken = {c.lower() for c in docs.columns}
    names = [name if name not in taken else f"assigned_{name}" for name in ("shard", "slot")]
    return placed.select("row.*", F.col("shard").alias(names[0]), F.col("slot").alias(names[1]))


STAGES = [
    ("quality rules", rules),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources", mixture),
    ("sharding", shards),
]

#: Fingerprints, seeded repetitions and label propagation have no SQL form; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = held(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
