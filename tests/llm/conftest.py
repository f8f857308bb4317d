import os
import random

import duckdb
import pytest
from pyspark.sql import types as T

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))

# The documents' columns, and extra ones that carry names the operators use inside.
SCHEMA = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("doc_id",)]
    + [T.StructField(n, T.StringType()) for n in ("text", "lang", "source")]
    + [T.StructField("n_chars", T.LongType())]
    + [T.StructField(n, T.StringType()) for n in ("row", "counts", "body", "size", "at", "id", "hits", "shard", "times", "place", "bits")]
)


def rows(texts):
    extra = tuple("x" for _ in range(11))
    return [(i, t, None if i and i % 5 == 0 else "en", None if i is None or i % 3 == 0 else f"s{i % 4}", 0 if t is None else len(t), *extra) for i, t in texts]


@pytest.fixture(scope="session")
def edge_rows():
    rng = random.Random(5)
    vocabulary = [f"{a}{b}" for a in ("an", "the", "of", "und", "la") for b in range(40)]
    prose = " ".join(rng.choice(vocabulary) for _ in range(120))
    texts = [None, "", " \t\n", "one", "Two words", prose, prose, prose.upper(), prose + " tail", LONG, "a " * 60, "é　ü ß\x0bend", "line\nline\nline"]
    out = rows(list(enumerate(texts)))
    # A repeated row, and keys that are null.
    return [*out, out[5], rows([(None, prose)])[0], rows([(None, None)])[0]]


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    return spark.createDataFrame(edge_rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def database():
    con = duckdb.connect()
    for table in ("documents", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return con


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
