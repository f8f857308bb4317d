"""Every query against its SQL, on the smallest driver data."""

import math
import os

import duckdb
import pytest

import workload.queries as workload

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
)
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver data not present")


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return con


@pytest.fixture(scope="module", autouse=True)
def one_run(spark):
    """The queries share one control run here; the driver gives each its own."""
    original, runs = workload.control, {}

    def shared(session, sf, **options):
        key = (sf, tuple(sorted(options.items())))
        if key not in runs:
            runs[key] = original(session, sf, **options)
        return runs[key]

    workload.control = shared
    yield
    workload.control = original


def cell(value):
    if value is None or value != value:
        return None
    if isinstance(value, (bool, str)):
        return value
    number = float(value)
    return None if math.isnan(number) else round(number, 8)


def table(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([cell(r[i]) for i in order] for r in records), key=repr)


def test_every_query_has_a_check():
    assert set(workload.JOBS) == set(workload.CHECKS)


@pytest.mark.parametrize("name", sorted(workload.JOBS))
def test_query(spark, database, name):
    frame = workload.JOBS[name](spark, SF)
    cursor = database.execute(workload.CHECKS[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(frame.columns) == sorted(columns)
    expected = table(columns, cursor.fetchall())
    assert expected, "an empty result checks nothing"
    assert table(frame.columns, [tuple(r) for r in frame.collect()]) == expected
