"""Staging: neighbours of an order are found once, not joined again for each kind of link."""

import os

import pytest
from pyspark.sql import functions as F

from registra.functions.identifiers import luhn_valid
from workload import derive

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver data not present")


def exchanges(frame):
    return frame._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_links_and_list_shuffle_establishments_once(spark, tmp_path):
    derive.establishments(spark, SF).write.parquet(f"{tmp_path}/derived")
    etab = spark.read.parquet(f"{tmp_path}/derived")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        # The two sides of the one join by order number.
        assert exchanges(derive.links(etab)) <= 2
        assert exchanges(derive.user_list(etab)) == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert derive.links(etab).filter("siretSuccesseur IS NULL OR siretPredecesseur IS NULL").isEmpty()


def test_sirets_take_the_customers_part_of_the_check_digit_once(spark, tmp_path):
    frame = derive.establishments(spark, SF)
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    # Digits of the legal unit are taken below the join with its orders, where a customer has one row.
    above = plan[: plan.index("Join Inner")]
    assert "siren_sum" in above
    assert "substring(siren" not in above and "cast(siren" not in above and "substring(concat" not in above
    numbers = frame.select(F.explode(F.array("siret", "previous_siret", "next_siret")).alias("number")).filter("number IS NOT NULL")
    assert numbers.filter(~luhn_valid(F.col("number")) | (F.length("number") != 14)).isEmpty()


def test_history_shuffles_a_line_as_two_numbers(spark):
    items = [
        (1, "O", "2001-03-04"), (1, "F", "2001-12-31"), (2, "F", "1969-12-30"), (2, None, "1970-01-01"), (2, "F", None), (3, "F", "2001-01-01"),
    ]
    lines = spark.createDataFrame(items, "l_orderkey long, l_linestatus string, l_shipdate string")
    lines = lines.withColumn("l_shipdate", F.to_timestamp("l_shipdate"))
    etab = spark.createDataFrame([(1, "30000001800017"), (2, "30000001800025")], "o_orderkey long, siret string")
    found = derive.history(lines, etab)
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(
        [
            ("30000001800017", "300000018", "2001-03-04", None), ("30000001800017", "300000018", "2001-12-31", "2002-01-30"),
            ("30000001800025", "300000018", "1969-12-30", "1970-01-29"), ("30000001800025", "300000018", "1970-01-01", None),
            ("30000001800025", "300000018", None, None),
        ],
        key=repr,
    )
    join = found._jdf.queryExecution().optimizedPlan().toString().split("Join Inner")[1]
    left = next(line for line in join.splitlines()[1:] if "Project" in line)
    assert "l_orderkey" in left and "period" in left and left.count(",") >= 1 and "substring" not in left
