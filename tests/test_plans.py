"""What the plans must and must not contain at scale."""

import pytest
from pyspark.sql import functions as F

from registra import ControlOptions, run_control
from registra.functions.identifiers import check_identifiers
from registra.operators import establishments as est
from registra.operators import reports, scoping
from registra.operators.held import held
from registra.operators.history import history_slice
from registra.operators.succession import best_links, links_touching
from registra.plans.control import decide
from registra.schema import PREDECESSOR
from registra.sources.pruned import OTHER, RANGE, _range_of_row, read_pruned, save_pruned
from registra.sources.registry import Registry, read_bucketed, registry_from_frames, save_bucketed
from tests.samples import est as row
from tests.samples import registry, rows, siren, siret
from workload.derive import history


def plan(df) -> str:
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.fixture()
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.fixture()
def run(spark):
    sample = registry(
        spark, [row(1, 1), row(1, 2, "F"), row(2, 1, "F")], links=[(siret(1, 2), siret(1, 1), "2020-01-01", "true")],
        history=[(siret(1, 1), siren(1), "2001-01-01", None)],
    )
    lines = spark.createDataFrame([("1", siret(1, 2)), ("2", siren(2)), ("3", "x")], "ref string, id string")
    return lines, run_control(lines, "id", sample, ControlOptions(row_id="ref"))


def test_no_product_joins_and_no_python(spark, run, no_broadcast):
    lines, result = run
    scope = scoping.scope_counts(lines, None, "id")
    frames = [
        result.overview, result.control_table, result.metrics, result.move_candidates, result.succession_links,
        reports.statistics_table(result.overview, scope), reports.duplicates_table(result.overview, ["ref"]),
        reports.anomalies_table(result.overview, ["ref"]), reports.to_close_table(result.overview),
    ]
    for frame in frames:
        text = plan(frame)
        for refused in ("CartesianProduct", "BroadcastNestedLoopJoin", "BroadcastHashJoin", "EvalPython", "InPandas"):
            assert refused not in text


def test_columns_without_registry_data_need_no_wide_read(spark, no_broadcast):
    """Asking for decisions only joins them with the list; the registry's wide tables and the history are left out."""
    twice = [row(1, 2, "F", start="2001-01-01"), row(1, 2, "F", start="2002-01-01")]
    sample = registry(
        spark, [row(1, 1), *twice], links=[(siret(1, 2), siret(1, 1), "2020-01-01", "true")],
        history=[(siret(1, 1), siren(1), "2001-01-01", None)],
    )
    lines = spark.createDataFrame([("1", siret(1, 2)), ("2", siren(1)), ("3", "x")], "ref string, id string")
    result = run_control(lines, "id", sample, ControlOptions(row_id="ref"))
    columns = ("row_id", "siret_remplacement_recommande", "analysis_alerte_siren_different")
    narrow = result.overview.select(*columns)
    text = plan(narrow).split("\n\n")[0]
    assert text.count("Join") == 1 and "Window" not in text
    assert rows(narrow, *columns) == rows(held(result.overview, "overview"), *columns)
    assert len(rows(narrow, *columns)) == 3


def test_control_table_walks_no_links_for_registry_data(spark, run, no_broadcast):
    _, result = run
    table = result.control_table.select("row_id", "nic", "historique_records_count")
    assert "decided" not in vars(result)
    assert "predecessor" not in plan(table) and PREDECESSOR not in plan(table)
    whole = rows(held(result.control_table, "table"), *result.control_table.columns)
    del vars(result)["control_table"]
    assert result.decided is not None
    assert whole == rows(result.control_table, *result.control_table.columns)


def test_only_closed_identifiers_are_shuffled_to_their_successors(spark, run, no_broadcast):
    _, result = run
    found = decide(result.matched, result.registry)
    text = found._jdf.queryExecution().optimizedPlan().toString()
    closed = text.split("Join LeftOuter, (siret_normalized")[1]
    assert "Union" in text.split("Join LeftOuter, (siret_normalized")[0] and "siret_status" in closed.split("Relation")[0]
    assert rows(found, "siret_normalized", "successor_siret") == [(siret(1, 2), siret(1, 1)), (siren(2), None)]


def test_tables_of_the_run_are_compressed_beyond_repeats(spark, run):
    _, result = run
    assert all(".zstd." in name for df in (result.matched, result.decided) for name in df.inputFiles())


def test_run_log_looks_nothing_up(spark, run):
    _, result = run
    assert {r.parameter: r.value for r in result.run_log.collect()}["input_row_count"] == "3"
    assert not {"matched", "decided"} & set(vars(result))


def test_ranges_of_a_pruned_copy_compile(spark):
    sample = registry(spark, [row(1, 1)])
    text = plan(sample.establishments.withColumn(RANGE, _range_of_row(sample.establishments.columns)))
    assert "lambda" not in text and "array_distinct" not in text


def test_rankings_are_cut_before_the_shuffle(spark):
    sample = registry(spark, [row(1, 1)], links=[(siret(1, 1), siret(2, 1), "", "")])
    for frame in (est.pick_for_siren(sample.establishments), best_links(sample.links), est.active_siblings(sample.establishments)):
        text = plan(frame)
        assert text.count("WindowGroupLimit") >= 2
        assert "Partial" in text


def test_links_touching_the_list_are_one_semi_join(spark):
    sample = registry(spark, [row(1, 1)], links=[(siret(1, 1), siret(2, 1), "", "")])
    text = plan(links_touching(sample.links, spark.createDataFrame([(siret(1, 1),)], "siret string")))
    assert text.count("SortMergeJoin LeftSemi") == 1 and "LeftOuter" not in text and "LeftAnti" not in text


def test_counts_are_partial_hash_aggregates(spark):
    from registra.operators.history import history_summary

    sample = registry(spark, [row(1, 1)], history=[(siret(1, 1), siren(1), "2001-01-01", None)])
    for frame in (est.sibling_counts(sample.establishments), history_summary(sample.history)):
        text = plan(frame)
        assert text.count("HashAggregate") >= 2 and "SortAggregate" not in text


def test_scan_reads_only_the_columns_in_use(spark, tmp_path):
    sample = registry(spark, [row(1, 1), row(1, 2, "F")])
    sample.establishments.write.parquet(str(tmp_path / "e"))
    stored = registry_from_frames(spark.read.parquet(str(tmp_path / "e")), sample.legal_units, pad_ids=False)
    text = plan(est.sibling_counts(stored.establishments))
    assert "ReadSchema: struct<siren:string,etatAdministratifEtablissement:string>" in text
    text = plan(stored.establishments.filter(f"siret = '{siret(1, 1)}'"))
    assert "EqualTo(siret" in text.split("PushedFilters")[1].splitlines()[0]


def far(n):
    """Numbers whose identifiers begin with different digits."""
    return n * 1_000_000 + n


def test_pruned_copy_opens_only_the_ranges_of_the_keys(spark, no_broadcast, tmp_path):
    sample = registry(
        spark, [row(far(n), k) for n in range(20) for k in (1, 2)],
        history=[(siret(far(n), 1), siren(far(n)), "2001-01-01", None) for n in range(20)],
    )
    save_pruned(sample, str(tmp_path / "copy"))
    stored = read_pruned(spark, str(tmp_path / "copy"))
    sirets = spark.createDataFrame([(siret(far(3), 1),), (siret(far(7), 1),)], "siret string")
    sirens = spark.createDataFrame([(siren(far(3)),), (siren(far(7)),)], "siren string")
    for whole, cut, found in (
        (stored.establishments, est.by_siret(stored.establishments, sirets), 2),
        (stored.establishments, est.by_siren(stored.establishments, sirens), 4),
        (stored.narrow, est.by_siren(stored.ranking, sirens), 4),
        (stored.legal_units, est.by_siren(stored.legal_units, sirens), 2),
        (stored.history, history_slice(stored.history, sirets=sirets), 2),
        (stored.history, history_slice(stored.history, sirens=sirens), 2),
    ):
        assert RANGE not in cut.columns
        assert "dynamicpruning" in plan(cut).split("PartitionFilters")[1].splitlines()[0]
        assert cut.count() == found
        files = whole.inputFiles()
        wanted = [f for f in files if any(f"{RANGE}={r}/" in f for r in (siren(far(3))[:3], siren(far(7))[:3], OTHER))]
        assert files_read(cut) == len(wanted) < len(files) / 2


def files_read(df):
    """Files the scans of `df` opened, once it has run."""
    df.collect()
    todo, count = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
            continue
        if node.getClass().getSimpleName().endswith("QueryStageExec"):
            todo.append(node.plan())
            continue
        metric = node.metrics().get("numFiles")
        count += metric.get().value() if metric.isDefined() else 0
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return count


def test_pruned_copy_gives_the_same_run(spark, tmp_path):
    sample = registry(
        spark, [row(far(n), k, "A" if k == 1 else "F") for n in range(20) for k in (1, 2)],
        links=[(siret(far(1), 2), siret(far(3), 1), "2020-01-01", "true")],
    )
    save_pruned(sample, str(tmp_path / "copy"))
    stored = read_pruned(spark, str(tmp_path / "copy"))
    assert stored.history is None
    lines = spark.createDataFrame([(str(n), siret(far(n), 2)) for n in range(5)] + [("9", siren(far(9))), ("10", "x")], "ref string, id string")
    results = [run_control(lines, "id", r, ControlOptions(row_id="ref")).overview for r in (sample, stored)]
    assert results[0].columns == results[1].columns
    assert rows(results[0], *results[0].columns) == rows(results[1], *results[0].columns)


def test_pruned_copy_keeps_odd_identifiers_and_empty_tables(spark, tmp_path):
    fields = "siret string, siren string, etatAdministratifEtablissement string"
    odd = [
        ("12A45678900011", "12A456789", "A"), ("12345678900011", "999456789", "A"), ("7", None, "A"), (None, None, "A"),
        (None, "123456789", "A"), ("12345678900029", None, "A"), ("٣٣٣", "123456789", "A"),
    ]
    none = spark.createDataFrame([], "siren string, denominationUniteLegale string")
    links = spark.createDataFrame([], "siretEtablissementPredecesseur string, siretEtablissementSuccesseur string")
    sample = registry_from_frames(spark.createDataFrame(odd, fields), none, links, pad_ids=False)
    save_pruned(sample, str(tmp_path / "copy"))
    stored = read_pruned(spark, str(tmp_path / "copy"))
    assert stored.establishments.count() == len(odd) and stored.establishments.filter(F.col(RANGE) == OTHER).count() == 5
    assert stored.legal_units.count() == 0 and stored.links.count() == 0 and stored.history is None
    for key, lookup in (("siret", est.by_siret), ("siren", est.by_siren)):
        for value in {r[0 if key == "siret" else 1] for r in odd} | {"555"}:
            keys = spark.createDataFrame([(value,), (None,), (value,)], f"{key} string")
            assert rows(lookup(stored.establishments, keys), "siret", "siren") == rows(lookup(sample.establishments, keys), "siret", "siren")


def test_bucketed_copy_gives_the_same_without_being_shuffled(spark, no_broadcast, tmp_path):
    sample = registry(
        spark, [row(n, k, "A" if k == 1 else "F") for n in range(20) for k in (1, 2)],
        links=[(siret(1, 2), siret(3, 1), "2020-01-01", "true")],
    )
    lines = spark.createDataFrame([(str(n), siret(n, 2)) for n in range(5)] + [("9", siren(9))], "ref string, id string")
    columns = ("row_id", "siret_status", "siret_remplacement_recommande", "analysis_data_applied", "denomination_entreprise")
    spark.sql(f"CREATE DATABASE IF NOT EXISTS bucketed LOCATION '{tmp_path}/db'")
    try:
        stored = read_bucketed(spark, save_bucketed(sample, "bucketed.r", 4))
        assert stored.history is None
        for table, key in ((stored.establishments, "siret"), (stored.ranking, "siren"), (stored.legal_units, "siren")):
            keys = spark.createDataFrame([(siret(n, 1)[: 14 if key == "siret" else 9],) for n in range(5)], f"{key} string")
            joined = table.join(keys.repartition(4, key), key, "left_semi")
            text = plan(joined)
            assert "SelectedBucketsCount: 4 out of 4" in text
            assert text.split("\n\n")[0].count("Exchange") == 1  # the keys only
            assert joined.select(key).distinct().count() == 5
        results = [
            rows(run_control(lines, "id", r, ControlOptions(row_id="ref")).overview, *columns) for r in (sample, stored)
        ]
        assert results[0] == results[1] and len(results[0]) == 6
    finally:
        spark.sql("DROP DATABASE IF EXISTS bucketed CASCADE")


def test_hot_key_join_is_split(spark, no_broadcast, tmp_path):
    """A third of the list carries one identifier; the join splits that partition instead of one task taking it."""
    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        sample = registry(spark, [row(n, 1) for n in range(400)])
        lines = [(str(i), siret(7, 1) if i % 3 == 0 else siret(i % 400, 1)) for i in range(30000)]
        frame = spark.createDataFrame(lines, "ref string, id string").repartition(16)
        result = run_control(held(frame, "hot"), "id", sample, ControlOptions(row_id="ref"))
        overview = result.overview.select("row_id", "siret_status", "analysis_status_note")
        assert overview.groupBy("siret_status").count().collect()[0]["count"] == 30000
        overview.write.format("noop").mode("overwrite").save()
        executed = result.overview.select("row_id", "siret_status", "analysis_status_note")
        executed.collect()
        assert "skew=true" in executed._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_rows_without_a_key_are_spread(spark):
    """Lines without a valid identifier must not meet in one join task."""
    from pyspark.sql import functions as F

    from registra.operators.succession import spread_key

    frame = check_identifiers(spark.range(1000).select("id", F.lit("bad").alias("v")), "v")
    keyed = frame.withColumn("k", spread_key(F.when(F.col("siret_format_ok"), F.col("siret_normalized")), F.col("id")))
    assert keyed.select("k").distinct().count() == 1000


def test_held_table_keeps_schema_and_rows(spark):
    frame = spark.createDataFrame([(1, None), (2, "x")], "a long, b string")
    kept = held(frame, "t")
    assert kept.schema == frame.schema and rows(kept, "*") == rows(frame, "*")
    assert isinstance(registry(spark, [row(1, 1)]), Registry)


def test_sides_small_as_files_and_large_as_rows_are_not_broadcast(spark, tmp_path):
    """Key and SIRET of a wide, well compressed table: 5 MB of rows, a share of some 60 KB of its file."""
    other = [F.lit("the same").alias(f"column_{i}") for i in range(20)]
    spark.range(200_000).select(F.col("id").alias("o_orderkey"), (F.col("id") + 30_000_000_000_000).cast("string").alias("siret"), *other).write.parquet(f"{tmp_path}/wide")
    spark.range(200_000).select(
        F.col("id").alias("l_orderkey"), F.lit("O").alias("l_linestatus"), F.timestamp_seconds("id").alias("l_shipdate"), *other
    ).write.parquet(f"{tmp_path}/lines")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1m")
    try:
        wide, lines = (spark.read.parquet(f"{tmp_path}/{name}") for name in ("wide", "lines"))
        for frame, rows_ in ((history(lines, wide), 200_000), (held(wide.select("siret"), "sirets").join(wide, "siret").select("o_orderkey"), 200_000)):
            assert len(frame.collect()) == rows_
            assert "Join" in plan(frame) and "Broadcast" not in plan(frame)
        # Rows that are few are broadcast still, once they have been counted.
        few = lines.join(wide.filter("o_orderkey < 10"), F.col("l_orderkey") == F.col("o_orderkey")).select("siret")
        assert len(few.collect()) == 10
        assert "BroadcastHashJoin" in plan(few)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
