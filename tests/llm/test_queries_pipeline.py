"""Every query with SQL against it, and the pipeline against its parts."""

import collections
import glob
import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from registra.llm import simhash
from registra.llm.queries import CHECKS, JOBS
from registra.operators.held import held
from tests.llm.conftest import SCHEMA, SF, rows
from tests.llm.test_copies import contaminated
from tests.llm.test_rules_secrets import all_spans, text_of


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_query_against_sql(spark, database, name):
    got, expected = JOBS[name](spark, SF).toPandas(), database.execute(CHECKS[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(expected.columns)
    assert sorted(map(str, got[columns].values.tolist())) == sorted(map(str, expected[columns].values.tolist()))


def test_queries_without_sql_return_a_row_per_document(spark, documents):
    ids = sorted(r.doc_id for r in documents.select("doc_id").collect())
    for name in ("op2_secrets", "op5_token_counts", "op6_sharding", "op7_simhash"):
        found = JOBS[name](spark, SF).collect()
        assert sorted(r.doc_id for r in found) == ids, name
        if name == "op2_secrets":
            texts = {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}
            assert all(r.spans == text_of(all_spans(texts[r.doc_id])[1]) for r in found)


def test_pipeline_stage_by_stage(spark, documents):
    docs, columns = documents, documents.columns
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.select("doc_id", "text").collect()
        docs = held(stage(spark, docs, SF), "stage")
        after = docs.collect()
        ids = collections.Counter(r.doc_id for r in after)
        if number < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns, name
        if name == "SimHash near-dedup":
            prints = simhash.fingerprints(spark.createDataFrame(before), F.col("doc_id"), F.col("text"))
            groups = {r.component_id for r in prints.join(simhash.near_duplicates(prints), "bits").select("component_id").collect()}
            assert set(ids) == groups and set(ids.values()) == {1}
        elif name == "benchmark decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            clean = [r.doc_id for r, (_, hit, _) in zip(before, contaminated([r.text for r in before], items)) if not hit]
            assert sorted(clean) == sorted(ids)
        elif name == "mixing sources":
            assert max(ids.values()) <= 3 and set(ids) <= {r.doc_id for r in before}
        elif name == "sharding":
            assert ids == collections.Counter(r.doc_id for r in before)
            sizes = collections.Counter(r.shard for r in after)
            assert max(sizes.values()) - min(sizes.values()) <= 1


def test_pipeline_on_edge_cases(spark, edge_rows, no_docs, tmp_path):
    spark.createDataFrame([*edge_rows, *rows([(50, " ".join(f"the word{i} of" for i in range(40)))])], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in out.collect()} and "assigned_shard" in out.columns
    folder = tmp_path / "empty"
    no_docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(folder)).count() == 0


def test_the_package_is_removable():
    """Only the entry module knows of it."""
    top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    sources = [p for p in glob.glob(f"{top}/**/*.py", recursive=True) if "/llm/" not in p and not p.endswith(("__spark_entry__.py", "corpus_pipeline.py"))]
    assert not [p for p in sources if "llm" in open(p, encoding="utf-8").read()]
